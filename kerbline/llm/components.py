"""Connected components and complete linking of candidate buckets, with DataFrame operations only."""

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.common import discard, written


def components(links: DataFrame) -> DataFrame:
    """``(id, label)`` for every id of ``links (a, b)``: the smallest id of its component.

    Union-find by alternating stars: each node hangs its larger neighbours, then its smaller ones, on its smallest
    neighbour, until every edge points at a root. Each step is a map-side combined minimum and one join; a hub's edges are
    never gathered in one row. Ids may be of any type that has an order. Null ids and self-links are ignored; an empty
    input gives an empty result.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        # Large star: every neighbour above u hangs on the smallest of u's neighbourhood.
        large = both.join(low, both["a"] == low["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a <> b").distinct(), "large-star")
        discard(edges)
        # Small star: u and its neighbours below it hang on the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(least, large["a"] == least["u"]).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        stars = written(small.select("e.a", "e.b").where("a <> b").distinct(), "small-star")
        discard(large)
        # Done when no root hangs on another node and no node has two roots.
        loose = stars.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
        if loose.isEmpty() and stars.select(F.col("b").alias("a")).join(stars.select("a"), "a", "left_semi").isEmpty():
            break
        edges = stars
    return stars.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(stars.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())


def bucket_components(
    members: DataFrame,
    confirm: Callable[[DataFrame], DataFrame],
    rest: Callable[[DataFrame], DataFrame],
    known: DataFrame | None = None,
    rounds: int = 1,
    able: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``(id, label)``, as ``components`` gives them, of the graph of all links between ids that share a bucket.

    ``members (bucket, id)`` may repeat rows. In each of ``rounds`` rounds one member of every bucket, at first the smallest,
    meets all others of it that lie in other components, and leaves the bucket: ``confirm`` gets these distinct pairs ``(a, b)``,
    no more than there are members, and returns those that are links. That settles most buckets, large groups of copies above
    all, since pairs inside a component can't change the result. Buckets that still hold several components go to ``rest`` as
    ``(bucket, id, label)``; it returns the links ``(a, b)`` between their members of different components. So every pair of a
    bucket is tried or lies in one component at the end. ``able`` gets such rows after the first round and leaves out members
    that can't be linked with any of another component in their bucket. ``known`` are links found elsewhere.
    """
    whole = Window.partitionBy("bucket")
    counted = members.select("bucket", "id", F.min("id").over(whole).alias("pivot"), F.count("*").over(whole).alias("n"))
    met = written(counted.where("id <> pivot"), "bucket-members")
    links = confirm(met.select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()).select("a", "b")
    labels = _merged(None, written(links if known is None else links.unionByName(known), "links"))
    # A bucket of two has met.
    held = written(met.where("n > 2").select("bucket", "id").distinct(), "bucket-members")
    discard(met)
    for step in range(1, rounds + 1):
        live = _open(held, labels)
        if able is not None and step == 1:
            every, live = live, written(able(live), "open-buckets")
            discard(every)
        if live.isEmpty():
            discard(live)
            return labels
        if step == rounds:
            out = _merged(labels, written(rest(live).select("a", "b").distinct(), "links"))
            discard(live)
            return out
        by = F.xxhash64("id", F.lit(step))
        pivots = live.groupBy("bucket").agg(F.min_by(F.struct("id", "label"), by).alias("p")).select("bucket", F.col("p.id").alias("pivot"), F.col("p.label").alias("other"))
        held = written(live.join(pivots, "bucket").where("id <> pivot"), "bucket-members")
        discard(live)
        pairs = held.where("label <> other").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
        labels = _merged(labels, written(confirm(pairs).select("a", "b"), "links"))
    return labels


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels with further links: only the roots that these join are looked at again; both, which are written, are deleted."""
    given = links
    if labels is None:
        out = written(components(links), "labels")
        discard(given)
        return out
    root = labels.select(F.col("id").alias("of"), "label")
    for end in ("a", "b"):
        links = links.join(root, links[end] == root["of"], "left").select(F.coalesce("label", end).alias(end), "b" if end == "a" else "a")
    roots = written(components(links), "roots")
    grown = labels.join(roots.select(F.col("id").alias("of"), F.col("label").alias("root")), F.col("label") == F.col("of"), "left").select("id", F.coalesce("root", "label").alias("label"))
    out = written(grown.unionByName(roots.join(labels, "id", "left_anti")), "labels")
    discard(given, roots, labels)
    return out


def _open(held: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with their present labels, of the buckets that hold more than one; ``held``, which is written, is deleted."""
    now = held.select("bucket", "id").join(labels.select(F.col("id").alias("of"), F.col("label").alias("root")), F.col("id") == F.col("of"), "left")
    whole = Window.partitionBy("bucket")
    now = now.select("bucket", "id", F.coalesce("root", "id").alias("label")).withColumns({"low": F.min("label").over(whole), "high": F.max("label").over(whole)})
    live = written(now.where("low <> high").select("bucket", "id", "label"), "open-buckets")
    discard(held)
    return live
