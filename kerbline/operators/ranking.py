"""Exact "first k rows" selection without sorting everything into one task.

A global ``row_number`` or a large ``limit`` sends all rows through one task, and a per-group one does so for a hot
group. Instead the position is found by histograms: coarse bucket of the order key, then finer ones inside the bucket
that holds the wanted position. Each histogram is a map-side-combined ``groupBy``; a running sum only ever sees the
buckets of one parent bucket. The last step numbers the rows of one finest bucket.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

HOUR = 3_600_000_000
SECOND = 1_000_000
ID_RUN = 1 << 20


def time_levels(micros: Column, row_id: Column) -> list[Column]:
    """Coarse to fine keys whose lexicographic order is (time, id)."""
    return [
        F.floor(micros / F.lit(HOUR)).cast("bigint"),
        F.floor(micros / F.lit(SECOND)).cast("bigint"),
        micros.cast("bigint"),
        F.floor(row_id / F.lit(ID_RUN)).cast("bigint"),
        row_id.cast("bigint"),
    ]


def score_levels(score: Column, micros: Column, row_id: Column) -> list[Column]:
    """Coarse to fine keys for (score descending, time, id), score in [0, 1]."""
    return [F.floor((1 - score) * F.lit(1 << 20)).cast("bigint"), -score, *time_levels(micros, row_id)]


def cut_keys(
    rows: DataFrame, group: Sequence[str], levels: Sequence[Column], wanted: Callable[[Column], Column]
) -> DataFrame:
    """Per group, the key of row number ``wanted(group size)`` (from 1) in level order.

    Returns ``group``, ``group_rows``, ``wanted_rows`` and ``cut`` (struct of level values); with no group one row. Rows without
    a group are a group too; null keys come first.
    """
    group = list(group)
    names = [f"_k{i}" for i in range(len(levels))]
    keyed = rows.select(*group, *[level.alias(name) for level, name in zip(levels, names)])
    bound = None
    for depth, name in enumerate(names):
        parents = group + names[:depth]
        inside = keyed if bound is None else with_group(keyed, bound, parents)
        carried = [] if bound is None else [F.first(c).alias(c) for c in ("group_rows", "wanted_rows", "_left")]
        hist = inside.groupBy(*parents, name).agg(F.count(F.lit(1)).alias("_n"), *carried)
        span = Window.partitionBy(*parents)
        hist = hist.withColumn("_upto", F.sum("_n").over(span.orderBy(name)))
        if bound is None:
            hist = hist.withColumn("group_rows", F.sum("_n").over(span))
            hist = hist.withColumn("wanted_rows", wanted(F.col("group_rows")).cast("bigint"))
            hist = hist.withColumn("_left", F.col("wanted_rows"))
        bound = hist.where((F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_n") < F.col("_left"))).select(
            *parents, name, "group_rows", "wanted_rows", (F.col("_left") - (F.col("_upto") - F.col("_n"))).alias("_left")
        )
    return bound.select(*group, "group_rows", "wanted_rows", F.struct(*names).alias("cut"))


def with_group(rows: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` joined with one row of facts for each key, null keys included."""
    renamed = facts.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return rows.join(renamed, same).drop(*(f"_of_{k}" for k in keys))


def key_struct(levels: Sequence[Column]) -> Column:
    return F.struct(*[level.alias(f"_k{i}") for i, level in enumerate(levels)])


def first_rows(
    rows: DataFrame, group: Sequence[str], levels: Sequence[Column], wanted: Callable[[Column], Column], *carried: str
) -> DataFrame:
    """``rows`` plus ``in_first``: whether the row is among the first ``wanted(n)`` of its group; plus columns of ``cut_keys``."""
    cuts = cut_keys(rows, group, levels, wanted)
    if group:
        marked = with_group(rows, cuts.select(*group, "cut", *carried), list(group))
        return marked.withColumn("in_first", key_struct(levels) <= F.col("cut")).drop("cut")
    return rows.withColumn("in_first", key_struct(levels) <= cuts.select("cut").scalar())
