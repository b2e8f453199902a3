"""Look-up on several grains, the first grain with data wins.

All grains live in one frame: a level name, the level's key columns, and null in the others. Probes are spread over the
levels the same way, so one join serves all of them and the statistics are computed once. Probes are distinct keys, not
rows; coarse levels share few keys, which adaptive skew handling splits.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

Levels = Sequence[tuple[str, Sequence[str]]]


def level_cell(level: str, keys: Sequence[str], all_keys: Sequence[str], types: dict[str, str], **values: Column) -> Column:
    cells = [F.lit(level).alias("level")]
    for k in all_keys:
        value = values.get(k, F.col(k)) if k in keys else F.lit(None)
        cells.append(value.cast(types.get(k, "bigint")).alias(k))
    return F.struct(*cells)


def matching(left: str, right: str, columns: Sequence[str]) -> Column:
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return condition


def first_level(
    rows: DataFrame, statistics: DataFrame, levels: Levels, keys: Sequence[str], values: Sequence[str], types: dict[str, str]
) -> DataFrame:
    """``rows`` plus a struct ``_found`` of (level, values) from the first level that knows the row's key, else null.

    A level is skipped for a row that lacks one of the level's keys.
    """
    wanted = rows.select(*[F.col(k).cast(types.get(k, "bigint")).alias(k) for k in keys]).distinct()
    cells = []
    for rank, (level, own) in enumerate(levels):
        usable = F.lit(True)
        for k in own:
            usable = usable & F.col(k).isNotNull()
        cells.append(F.when(usable, F.struct(F.lit(rank).alias("rank"), level_cell(level, own, keys, types).alias("at"))))
    asked = wanted.select(F.struct(*keys).alias("want"), F.inline(F.array_compact(F.array(*cells))))
    asked = asked.select("want", "rank", "at.*").alias("_a")
    hits = asked.join(statistics.alias("_s"), matching("_a", "_s", ["level", *keys]))
    found = F.struct("_s.level", *[F.col(f"_s.{v}") for v in values])
    best = hits.groupBy("_a.want").agg(F.min_by(found, "_a.rank").alias("_found")).select("want.*", "_found").alias("_b")
    joined = rows.alias("_r").join(best, matching("_r", "_b", keys), "left")
    return joined.select("_r.*", "_b._found")
