"""From raw documents to packed sequences: the stages, each a function of (spark, docs, sf_dir), and the run over all of them."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import quality
from kerbline.llm.common import table, written
from kerbline.llm.decontamination import without_leaks
from kerbline.llm.line_dedup import dedup_lines
from kerbline.llm.near_dedup import near_duplicates
from kerbline.llm.packing import pack

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines like earlier ones; a document of which this leaves nothing but blanks goes, a blank one stays."""
    names = docs.columns
    lines, removed = (f"{name} {'_' * max(map(len, names))}" for name in ("lines", "removed"))  # longer than any name there is
    kept = dedup_lines(docs, (lines, removed))
    untouched = F.col(f"`{removed}`") == 0
    kept = kept.where(untouched | (F.regexp_replace("text", r"\s+", "") != ""))
    if "n_chars" in names:
        kept = kept.withColumn("n_chars", F.when(untouched, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return kept.select(*(f"`{c}`" for c in names))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id; rows without doc_id stay."""
    kept = written(near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id")), "kept-documents")
    repeated = kept.where("kept_id IS NOT NULL").groupBy("kept_id").count().where("count > 1")
    out = docs.join(kept.distinct(), docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")
    if not repeated.isEmpty():  # a document that is there several times is a group too
        out = out.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(out.where("doc_id IS NULL"))
    return out


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in windows of 2048."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each to what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
