"""Transit seat-risk analytics as Spark DataFrame, Structured Streaming and MLlib operators."""
