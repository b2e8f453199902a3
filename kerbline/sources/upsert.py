"""Keyed upsert and de-duplication on plain Parquet."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def latest_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Last write per key. ``max_by`` combines on the map side, so a key with very many copies costs one row per task."""
    payload = [c for c in rows.columns if c not in key]
    latest = rows.groupBy(*key).agg(F.max_by(F.struct(*payload), F.struct(*order)).alias("_last"))
    return latest.select(*[F.col(c) if c in key else F.col(f"_last.{c}").alias(c) for c in rows.columns])


def upsert(old: DataFrame | None, new: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key; inside ``new`` the largest ``order`` wins.

    Old rows keep their place: only the new side is reduced, then the old side loses the replaced keys.
    """
    fresh = latest_per_key(new, key, [order])
    if old is None:
        return fresh
    same = _null_safe(key, "_o", "_n")
    keys = fresh.select(*key).alias("_n")
    kept = old.alias("_o").join(keys, same, "left_anti")
    return kept.unionByName(fresh)


def _null_safe(key: Sequence[str], left: str, right: str) -> Column:
    condition = F.lit(True)
    for name in key:
        condition = condition & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return condition


def drop_known(batch: DataFrame, known: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose natural key is not stored yet, one per key; nulls compare equal."""
    fresh = batch.dropDuplicates(list(key)).alias("_b")
    stored = known.select(*key).distinct().alias("_k")
    return fresh.join(stored, _null_safe(key, "_b", "_k"), "left_anti")


def tag_outcomes(batch: DataFrame, known: DataFrame, key: Sequence[str], order: str, wanted: Column) -> DataFrame:
    """Adds ``outcome``: ``non_target``, ``existing`` or ``imported`` (the first copy of a new key).

    The first copy is found with a map-side-combined minimum and joined back, not with a window over all copies.
    """
    tagged = batch.withColumn("_wanted", F.coalesce(wanted, F.lit(False)))
    stored = known.select(*key).distinct().withColumn("_stored", F.lit(1)).alias("_k")
    first = tagged.where("_wanted").groupBy(*key).agg(F.min(order).alias("_first")).alias("_f")
    joined = (
        tagged.alias("_b")
        .join(stored, _null_safe(key, "_b", "_k"), "left")
        .join(first, _null_safe(key, "_b", "_f"), "left")
    )
    outcome = (
        F.when(~F.col("_b._wanted"), "non_target")
        .when(F.col("_k._stored").isNotNull() | (F.col(f"_b.{order}") > F.col("_f._first")), "existing")
        .otherwise("imported")
    )
    return joined.select("_b.*", outcome.alias("outcome")).drop("_wanted")


def missing_names(expected: DataFrame, found: DataFrame, column: str) -> DataFrame:
    return expected.join(found.select(column).distinct(), column, "left_anti")


def append_batch(rows: DataFrame, path: str, batch_seq: int, partition: Sequence[str] = ()) -> None:
    """Write one batch of a keyed table. The cost follows the batch, not the table; a replay replaces its own folder."""
    rows.write.mode("overwrite").partitionBy(*partition).parquet(f"{path}/batch_seq={batch_seq}")


def read_latest(spark: SparkSession, path: str, key: Sequence[str], where: Column | None = None) -> DataFrame:
    """Last write per key over all batches.

    ``where`` is applied before older writes are dropped, so that it prunes folders and reaches the scan; it may only
    look at columns that all writes of a key agree on (the collection time of a snapshot id, for one).
    """
    rows = spark.read.option("basePath", path).parquet(path)
    return latest_per_key(rows if where is None else rows.where(where), key, ["batch_seq"]).drop("batch_seq")


def compact(spark: SparkSession, path: str, target: str, key: Sequence[str], partition: Sequence[str] = ()) -> None:
    """Rewrite a table as one batch in a new folder (a plan must not overwrite what it reads)."""
    newest = spark.read.parquet(path).agg(F.max("batch_seq")).first()[0]
    append_batch(read_latest(spark, path, key), target, newest, partition)
