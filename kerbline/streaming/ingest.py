"""Position snapshots as a stream: landing files in, de-duplicated rows, features and labels out."""

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from kerbline.constants import CONTEXT_TOLERANCE_SECONDS, HORIZONS, NEXT_STOP_SECONDS
from kerbline.functions import times
from kerbline.operators import features, labels
from kerbline.sources.dump import SNAPSHOT_KEY
from kerbline.sources.schemas import LOCATION_ITEM
from kerbline.sources.snapshots import location_snapshots
from kerbline.sources.upsert import append_batch, read_latest


def read_landing(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Landed position items, one JSON object per line with its ``collected_at``."""
    items = (
        spark.readStream.schema(f"collected_at STRING, {LOCATION_ITEM}").option("maxFilesPerTrigger", files_per_trigger).json(path)
    )
    return location_snapshots(items)


def new_rows(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """One row for each natural key of the batch that ``stored`` lacks, however late it comes."""
    same = F.lit(True)
    for part in SNAPSHOT_KEY:
        same = same & F.col(f"_b.{part}").eqNullSafe(F.col(f"_s.{part}"))
    return batch.dropDuplicates(list(SNAPSHOT_KEY)).alias("_b").join(stored.select(*SNAPSHOT_KEY).alias("_s"), same, "left_anti")


def _started(writer, checkpoint: str, seconds: int | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def append_stream(snapshots: DataFrame, path: str, checkpoint: str, every_seconds: int | None = None) -> StreamingQuery:
    """Append to the day-partitioned snapshot log what it lacks; all landed data once, or every ``every_seconds``.

    Keys are compared with the stored rows of the batch's own days only. A replayed batch finds its rows and adds nothing.
    """
    def one(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("ingest_date", F.to_date("collected_at")).persist()
        first, last = rows.agg(F.min("ingest_date"), F.max("ingest_date")).first()
        empty = rows.sparkSession.createDataFrame([], rows.schema)
        empty.write.mode("append").partitionBy("ingest_date").parquet(path)  # the log exists from the first batch on
        log = rows.sparkSession.read.schema(rows.schema).parquet(path)
        stored = log.where(F.col("ingest_date").between(F.lit(first), F.lit(last)) | F.col("ingest_date").isNull())
        new_rows(rows, stored).write.mode("append").partitionBy("ingest_date").parquet(path)
        rows.unpersist()

    return _started(snapshots.writeStream.foreachBatch(one).outputMode("append"), checkpoint, every_seconds)


def bucket_counts(snapshots: DataFrame) -> DataFrame:
    """Rows per route and ten-minute window, for update mode: late rows raise the count of their window, whatever their age."""
    counted = snapshots.groupBy("route_id", F.window("collected_at", "10 minutes").alias("w")).agg(F.count(F.lit(1)).alias("rows"))
    return counted.select("route_id", F.col("w.start").alias("bucket"), "rows")


def with_snapshot_id(rows: DataFrame) -> DataFrame:
    """Ids that replays reproduce: a 256-bit digest of the natural key's names and values, so a null is unlike a missing part."""
    key = [F.unix_micros(c).alias(c) if c == "collected_at" else F.col(c) for c in SNAPSHOT_KEY]
    return rows.withColumn("snapshot_id", F.sha2(F.to_json(F.struct(*key)), 256))


def context_changes(context: DataFrame, observed: str | None = None, day: str | None = None) -> DataFrame:
    """What context rows can change: the snapshots around ``observed`` times, or those of the ``day`` that rows name."""
    return context.select(
        (F.col(observed) if observed else F.lit(None)).cast("timestamp").alias("observed_at"), (F.col(day) if day else F.lit(None)).cast("date").alias("service_date")
    )


def feature_stream(
    snapshots: DataFrame,
    tables: Callable[[], Mapping[str, DataFrame]],
    path: str,
    checkpoint: str,
    every_seconds: int | None = None,
    changes: DataFrame | None = None,
) -> StreamingQuery:
    """Features of new snapshots and of those stored ones that a batch changes, upserted by snapshot id.

    ``tables`` gives the current dimensions and context; ``changes (observed_at, service_date)``, a stream that
    ``context_changes`` makes of the context's own landing, tells which hours and days of it are new. Three stores lie next to
    ``path``: the snapshots by service day, and what each vehicle's days say of its capacity (``VehicleDays``). A vehicle whose
    capacity rises has its stored rows built again, from the days it was seen on; late context has the rows of the hours in
    its reach built again. So the table equals a batch over all that has come, in whatever order it came, and the cost
    follows the batch and the rows it changes. A ``log`` among the tables seeds the capacities before the first batch.
    """
    spark, kept = snapshots.sparkSession, with_snapshot_id(snapshots).schema.add("service_date", "date")
    create_batches(spark, kept, f"{path}-rows", ["service_date"])
    VehicleDays(spark, f"{path}-vehicle-days").create()
    row = F.struct(*snapshots.columns)
    tagged = snapshots.select(row.alias("row"), F.lit(None).cast("timestamp").alias("observed_at"), F.lit(None).cast("date").alias("service_date"))
    if changes is not None:
        tagged = tagged.unionByName(changes, allowMissingColumns=True)

    def one(batch: DataFrame, batch_id: int) -> None:
        known, spark, days = tables(), batch.sparkSession, VehicleDays(batch.sparkSession, f"{path}-vehicle-days")
        both = batch.persist()
        rows = with_snapshot_id(both.where("row IS NOT NULL").select("row.*").dropDuplicates(list(SNAPSHOT_KEY)))
        rows = rows.withColumn("service_date", times.kst_parts(F.col("collected_at"))["service_date"]).persist()
        if batch_id == 0 and "log" in known:
            days.add(known["log"], -1)
        risen = days.risen(rows, batch_id).persist()
        stored = stored_batches(spark, rows.schema, f"{path}-rows", batch_id)
        seen_on = days.before(batch_id).join(risen, _same(VEHICLE_PLATE), "left_semi") if not risen.isEmpty() else None
        todo = [rows]
        if seen_on is not None:
            todo.append(_of_days(stored, seen_on).alias("_l").join(risen.alias("_r"), _same(VEHICLE_PLATE, "_l", "_r"), "left_semi").select("_l.*"))
        hours = both.where("observed_at IS NOT NULL").select(F.explode(F.sequence(
            F.date_trunc("hour", F.col("observed_at") - F.expr(f"INTERVAL {CONTEXT_TOLERANCE_SECONDS} SECONDS")),
            F.col("observed_at") + F.expr(f"INTERVAL {CONTEXT_TOLERANCE_SECONDS} SECONDS"), F.expr("INTERVAL 1 HOUR"))).alias("hour_at")).distinct()
        near = hours.withColumn("service_date", times.kst_parts(F.col("hour_at"))["service_date"])
        todo.append(_of_days(stored, near).withColumn("hour_at", features.kst_hour(F.col("collected_at"))).join(hours, "hour_at", "left_semi").drop("hour_at"))
        todo.append(_of_days(stored, both.select("service_date").distinct()))
        every = todo[0]
        for more in todo[1:]:
            every = every.unionByName(more)
        every = every.dropDuplicates(["snapshot_id"]).persist()
        days.add(rows, batch_id)
        base = features.location_features(every.drop("service_date"), known["routes"], known["stops"], days.capacity(every, batch_id))
        append_batch(features.model_features(base, *[known[c] for c in ("weather", "air", "traffic", "holidays", "events")]), path, batch_id, ["service_date"])
        append_batch(rows, f"{path}-rows", batch_id, ["service_date"])
        for held in (every, risen, rows, both):
            held.unpersist()

    return _started(tagged.writeStream.foreachBatch(one).outputMode("append"), checkpoint, every_seconds)


def _same(names: Sequence[str], left: str = "", right: str = "") -> list[str] | Column:
    """Plain names, or an equality of two aliased sides that holds for two nulls as well."""
    if not left:
        return list(names)
    same = F.lit(True)
    for name in names:
        same = same & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return same


def create_batches(spark: SparkSession, schema: StructType, path: str, partition: Sequence[str] = ()) -> None:
    """An empty table of batches, so that readers find it before anything is written."""
    append_batch(spark.createDataFrame([], schema), path, -2, partition)


def stored_batches(spark: SparkSession, schema: StructType, path: str, before: int) -> DataFrame:
    """What batches before a given one have written."""
    rows = spark.read.schema(StructType([*schema.fields]).add("batch_seq", "long")).option("basePath", path).parquet(path)
    return rows.where(F.col("batch_seq") < before).drop("batch_seq")


def _of_days(stored: DataFrame, days: DataFrame) -> DataFrame:
    """Stored rows of the service days that a small frame names; other folders are not read."""
    named = [r[0] for r in days.select("service_date").where("service_date IS NOT NULL").distinct().collect()]
    return stored.where(F.col("service_date").isin(named)) if named else stored.limit(0)


VEHICLE_PLATE = ("route_id", "plate_no")


class VehicleDays:
    """Most free seats per route, plate and service day, kept as batches that merge by maximum.

    Every ``FULL_EVERY`` batches all are merged into one folder, and readers start from the newest of these.
    """

    FULL_EVERY = 64
    SCHEMA = StructType().add("route_id", "long").add("plate_no", "string").add("service_date", "date").add("seats", "integer")

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def create(self) -> None:
        for kind in ("delta", "full"):
            create_batches(self.spark, self.SCHEMA, f"{self.path}/{kind}")

    def _read(self, kind: str) -> DataFrame:
        folder = f"{self.path}/{kind}"
        return self.spark.read.schema(StructType([*self.SCHEMA.fields]).add("batch_seq", "long")).option("basePath", folder).parquet(folder)

    def before(self, batch_id: int) -> DataFrame:
        """The merged state that earlier batches left: ``(route_id, plate_no, service_date, seats)``."""
        whole = self._read("full").where(F.col("batch_seq") < batch_id)
        newest = whole.agg(F.max("batch_seq")).first()[0]
        since = self._read("delta").where((F.col("batch_seq") < batch_id) & (F.col("batch_seq") > F.lit(-2 if newest is None else newest)))
        if newest is not None:
            since = since.unionByName(whole.where(F.col("batch_seq") == newest))
        return since.groupBy(*VEHICLE_PLATE, "service_date").agg(F.max("seats").alias("seats"))

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Write what ``rows`` of snapshots say; now and then all that is known so far as well."""
        day = F.col("service_date") if "service_date" in rows.columns else F.lit(None).cast("date")
        counted = rows.where("plate_no IS NOT NULL").groupBy(*VEHICLE_PLATE, day.alias("service_date"))
        append_batch(counted.agg(F.max(F.when(F.col("remain_seat_cnt") >= 0, F.col("remain_seat_cnt"))).alias("seats")), f"{self.path}/delta", batch_id)
        if batch_id > 0 and batch_id % self.FULL_EVERY == 0:
            append_batch(self.before(batch_id + 1), f"{self.path}/full", batch_id)

    def risen(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """``(route_id, plate_no)`` of vehicles known before, of which ``rows`` show more free seats than all earlier ones."""
        now = features.observed_capacity(rows).withColumnRenamed("observed_capacity", "now")
        old = self.before(batch_id).join(now, list(VEHICLE_PLATE)).groupBy(*VEHICLE_PLATE).agg(F.max("seats").alias("old"), F.max("now").alias("now"))
        return old.where("old IS NULL OR now > old").select(*VEHICLE_PLATE)

    def capacity(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """Observed capacity of the vehicles of ``rows``, this batch included."""
        merged = self.before(batch_id + 1).join(rows.select(*VEHICLE_PLATE).distinct(), list(VEHICLE_PLATE), "left_semi")
        return merged.groupBy(*VEHICLE_PLATE).agg(F.max("seats").alias("observed_capacity")).where("observed_capacity IS NOT NULL")


def look_back(batch: DataFrame, reach_seconds: int) -> Column | None:
    """Filter for the stored rows that labels a batch can change depend on: up to a look-ahead before it and behind it.

    The two bounds are whole multiples of the look-ahead, so that ``relabel`` finds all rows of the time slots it asks for.
    """
    oldest, newest = batch.agg(F.min(F.unix_micros("collected_at")), F.max(F.unix_micros("collected_at"))).first()
    if oldest is None:
        return None
    reach = reach_seconds * 1_000_000
    since, until = (F.timestamp_micros(F.lit(slot * reach)) for slot in (oldest // reach - 1, newest // reach + 2))
    day = F.col("service_date").between(F.date_sub(F.to_date(since), 1), F.date_add(F.to_date(until), 1))
    return day & (F.col("collected_at") >= since) & (F.col("collected_at") < until)


def relabel(
    stored: DataFrame,
    batch: DataFrame,
    *,
    horizons: Sequence[tuple[str, int]] = HORIZONS,
    next_stop_seconds: int = NEXT_STOP_SECONDS,
) -> DataFrame:
    """Labels that a batch can change: those of its vehicles' stored rows in the time slots of its rows and just before.

    Slots are as long as the look-ahead. Only rows of these slots and of the one behind, which their labels look into, are read
    into the label windows.
    """
    reach = max([s for _, s in horizons] + [next_stop_seconds]) * 1_000_000
    slot = F.floor(F.unix_micros("collected_at") / F.lit(reach))
    around = F.inline(F.array(*[F.struct((slot + k).alias("_slot"), F.lit(k < 1).alias("_changed")) for k in (-1, 0, 1)]))
    touched = batch.select(*labels.VEHICLE, around).groupBy(*labels.VEHICLE, "_slot").agg(F.max("_changed").alias("_changed"))
    same = _same(labels.VEHICLE, "_s", "_v") & (F.col("_s._own") == F.col("_v._slot"))
    rows = stored.withColumn("_own", slot).alias("_s").join(touched.alias("_v"), same).select("_s.*", "_v._changed").drop("_own")
    rows = rows.dropDuplicates(["snapshot_id"])
    labelled = labels.label_table(rows, micros=F.unix_micros("collected_at"), horizons=horizons, next_stop_seconds=next_stop_seconds)
    return labelled.join(rows.where("_changed").select("snapshot_id"), "snapshot_id", "left_semi")


def label_stream(built: DataFrame, feature_path: str, path: str, checkpoint: str, every_seconds: int | None = None) -> StreamingQuery:
    """Keep labels up to date as feature rows arrive, late ones included: each batch upserts the labels it changes.

    A label is there at once and changes while its future arrives; ``stateful.final_label_stream`` gives it when it is final.
    """
    def one(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        recent = look_back(rows, max([s for _, s in HORIZONS] + [NEXT_STOP_SECONDS]))
        if recent is not None:
            stored = read_latest(rows.sparkSession, feature_path, ["snapshot_id"], recent)
            append_batch(relabel(stored, rows), path, batch_id)
        rows.unpersist()

    return _started(built.writeStream.foreachBatch(one).outputMode("append"), checkpoint, every_seconds)


def read_feature_batches(spark: SparkSession, path: str) -> DataFrame:
    """The feature table's batches as a stream."""
    schema = spark.read.option("basePath", path).parquet(path).schema
    return spark.readStream.schema(schema).option("basePath", path).parquet(path)


def mature(labelled: DataFrame, feature_rows: DataFrame, watermark: object, reach_seconds: int = NEXT_STOP_SECONDS) -> DataFrame:
    """Labels no later row can change: their snapshot lies a full look-ahead before the watermark."""
    final = feature_rows.where(F.unix_micros("collected_at") < F.unix_micros(F.lit(watermark).cast("timestamp")) - reach_seconds * 1_000_000)
    return labelled.join(final.select("snapshot_id"), "snapshot_id", "left_semi")
