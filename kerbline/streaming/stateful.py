"""Streams whose state ends with the watermark, and whose late rows still count.

Spark's stateful operators drop rows that come behind the watermark. Each stream here also passes its rows on beside the
operator; what the operator didn't take is found by comparing ids, whatever made it late, and goes another way: repeats are
recognised by stored digests of their hours only, counts are added to, and labels in reach are built again.
"""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from kerbline.constants import HORIZONS, NEXT_STOP_SECONDS
from kerbline.operators import labels, live
from kerbline.sources.dump import SNAPSHOT_KEY
from kerbline.sources.upsert import append_batch, read_latest
from kerbline.streaming.ingest import _same, _started, create_batches, relabel, stored_batches, with_snapshot_id

_KEYS = StructType().add("snapshot_id", "string").add("event_hour", "string")


def _fresh(snapshots: DataFrame, delay: str) -> DataFrame:
    """The first row of each natural key, unless it comes behind the watermark; keys are held until the watermark is ``delay`` past them."""
    timed = snapshots.where("collected_at IS NOT NULL").withWatermark("collected_at", delay)
    return timed.dropDuplicatesWithinWatermark(list(SNAPSHOT_KEY))


def _late(raw: DataFrame, fresh: DataFrame, keys: str, batch_id: int) -> DataFrame:
    """Rows of a batch that the state didn't take and that no earlier batch has stored either.

    Only digests of the hours of such rows are read: none at all while nothing is late or repeated.
    """
    left = raw.dropDuplicates(["snapshot_id"]).join(fresh.select("snapshot_id"), "snapshot_id", "left_anti").persist()
    hours = [r[0] for r in left.select("event_hour").distinct().collect()]
    known = stored_batches(raw.sparkSession, _KEYS, keys, batch_id).where(F.col("event_hour").isin(hours))
    return left.join(known.select("snapshot_id"), "snapshot_id", "left_anti")


def _identified(rows: DataFrame) -> DataFrame:
    hour = F.coalesce(F.date_format("collected_at", "yyyy-MM-dd-HH"), F.lit("none"))
    return with_snapshot_id(rows).withColumn("event_hour", hour)


def ingest_stream(
    snapshots: DataFrame, log: str, counts: str, checkpoint: str, every_seconds: int | None = None, delay: str = "1 hour"
) -> StreamingQuery:
    """De-duplicated snapshots and their ten-minute counts per route, with state that the watermark bounds.

    Fresh rows are told from repeats by ``dropDuplicatesWithinWatermark`` and read nothing that is stored. Rows behind the
    watermark, or without a time, are looked up among the digests of their own hours, next to ``log``. Windows are counted in
    append mode over the same fresh rows; late rows become counts of their own, and ``read_counts`` adds both up. A batch
    that is run again replaces its own folders.
    """
    spark, keys = snapshots.sparkSession, f"{log}-keys"
    create_batches(spark, _KEYS, keys, ["event_hour"])
    window = F.window("collected_at", "10 minutes")
    closed = _fresh(snapshots, delay).groupBy("route_id", window.alias("window")).agg(F.count(F.lit(1)).alias("rows"))
    closed = closed.select("route_id", F.col("window.start").alias("bucket"), "rows", F.lit("window").alias("part"))
    row = F.struct(*snapshots.columns)
    parts = _fresh(snapshots, delay).select(row.alias("row"), F.lit("fresh").alias("part"))
    parts = parts.unionByName(snapshots.select(row.alias("row"), F.lit("raw").alias("part"))).unionByName(closed, allowMissingColumns=True)

    def one(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        fresh = _identified(held.where("part = 'fresh'").select("row.*"))
        late = _late(_identified(held.where("part = 'raw'").select("row.*")), fresh, keys, batch_id).persist()
        new = fresh.unionByName(late.select(*fresh.columns))
        append_batch(new.drop("snapshot_id", "event_hour").withColumn("ingest_date", F.to_date("collected_at")), log, batch_id, ["ingest_date"])
        bucket = F.window("collected_at", "10 minutes")["start"]
        behind = late.where("collected_at IS NOT NULL").groupBy("route_id", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))
        append_batch(held.where("part = 'window'").select("route_id", "bucket", "rows").unionByName(behind), counts, batch_id)
        append_batch(new.select("snapshot_id", "event_hour"), keys, batch_id, ["event_hour"])
        late.unpersist()
        held.unpersist()

    return _started(parts.writeStream.foreachBatch(one).outputMode("append"), checkpoint, every_seconds)


def read_counts(counts: DataFrame) -> DataFrame:
    """Rows per route and ten-minute window: closed windows and what came late, of the frame that ``ingest_stream`` has written."""
    return counts.groupBy("route_id", "bucket").agg(F.sum("rows").alias("rows"))


_HELD = "t array<bigint>, seq array<bigint>, id array<string>, no_seat array<int>, low_seat_2 array<int>, low_seat_5 array<int>, home array<boolean>"
_FIELDS = ("t", "seq", "id", "no_seat", "low_seat_2", "low_seat_5", "home")


def future_labels(rows: pd.DataFrame, horizons: tuple[tuple[str, int], ...], next_stop_seconds: int) -> pd.DataFrame:
    """Labels of one vehicle's rows, sorted by (t, seq, id), from the rows themselves."""
    t, seq = rows["t"].to_numpy(), rows["seq"].to_numpy()
    no_seat, low = rows["no_seat"].to_numpy(), rows["low_seat_2"].to_numpy()
    out = {"target_no_seat_now": no_seat, "target_low_seat_2_now": low, "target_low_seat_5_now": rows["low_seat_5"].to_numpy()}
    places = range(len(t))

    def seen(name: str, ahead: list[int], flag: str) -> None:
        out[f"target_no_seat_next_{name}"] = [int(no_seat[j]) if j >= 0 else 0 for j in ahead]
        out[f"target_low_seat_2_next_{name}"] = [int(low[j]) if j >= 0 else 0 for j in ahead]
        out[flag] = [int(j >= 0) for j in ahead]

    for name, seconds in horizons:
        last = t.searchsorted(t + seconds * 1_000_000, "right") - 1
        seen(name, [int(last[i]) if t[last[i]] > t[i] else -1 for i in places], f"has_future_{name}")
    larger, waiting = [-1] * len(t), []
    for j in places:  # rows wait until one with a larger sequence comes
        while waiting and seq[waiting[-1]] < seq[j]:
            i = waiting.pop()
            larger[i] = j if t[j] - t[i] <= next_stop_seconds * 1_000_000 else -1
        waiting.append(j)
    seen("station", larger, "has_next_station")
    return pd.DataFrame(out)


def _label_names(horizons: tuple[tuple[str, int], ...]) -> list[str]:
    names = ["target_no_seat_now", "target_low_seat_2_now", "target_low_seat_5_now"]
    for name, flag in [*((n, f"has_future_{n}") for n, _ in horizons), ("station", "has_next_station")]:
        names += [f"target_no_seat_next_{name}", f"target_low_seat_2_next_{name}", flag]
    return names


def _labels_schema(horizons: tuple[tuple[str, int], ...]) -> str:
    return ", ".join(f"{n} int" for n in _label_names(horizons))


def _finals(horizons: tuple[tuple[str, int], ...], next_stop_seconds: int):
    """State function: rows wait until the watermark is a full look-ahead past them, then leave with their labels.

    What it takes it says at once, as ``held`` rows, so that what it was never shown can be told. Repeated ids are taken once.
    """
    reach = max([s for _, s in horizons] + [next_stop_seconds]) * 1_000_000
    columns = ["part", "snapshot_id", "t", *_label_names(horizons)]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs() * 1000
        parts = [pd.DataFrame(dict(zip(_FIELDS, state.get)))] if state.exists else []
        for batch in batches:
            if len(batch):
                parts.append(batch[list(_FIELDS)])
                yield pd.DataFrame({"part": "held", "snapshot_id": batch["id"], "t": batch["t"]}).reindex(columns=columns)
        if not parts:
            return
        rows = pd.concat(parts).drop_duplicates("id").sort_values(["t", "seq", "id"]).reset_index(drop=True)
        final = rows["t"] + reach <= now
        out = pd.DataFrame({"part": "final", "snapshot_id": rows["id"], "t": rows["t"]})
        out = pd.concat([out, future_labels(rows, horizons, next_stop_seconds)], axis=1)
        yield out.loc[final & rows["home"], columns]
        rest = rows[~final]
        if len(rest):
            state.update(tuple(rest[f].tolist() for f in _FIELDS))
            state.setTimeoutTimestamp(max(int((rest["t"].min() + reach) // 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    return run


def final_label_stream(
    built: DataFrame,
    feature_path: str,
    path: str,
    checkpoint: str,
    every_seconds: int | None = None,
    delay: str = "1 hour",
    horizons: tuple[tuple[str, int], ...] = HORIZONS,
    next_stop_seconds: int = NEXT_STOP_SECONDS,
) -> StreamingQuery:
    """Labels that are written when they are final: the watermark has passed the row by a full look-ahead.

    State holds a vehicle's rows of one time slice for that long and no longer, event-time timers empty it. A row behind the
    watermark never gets there: it is labelled from the stored features at ``feature_path``, as are the rows in
    its reach, those written before and those that become final later; rows that come into the reach of a late row label that one
    again. ``path`` takes upserts by snapshot id with ``collected_at``, ``path``-late the late rows.
    """
    reach = max([s for _, s in horizons] + [next_stop_seconds])
    spark, late_path = built.sparkSession, f"{path}-late"
    late_row = StructType([built.schema[c] for c in ("snapshot_id", *labels.VEHICLE, "collected_at")])
    create_batches(spark, late_row, late_path)
    columns = f"snapshot_id string, collected_at timestamp, {_labels_schema(horizons)}"
    create_batches(spark, spark.createDataFrame([], columns).schema, path)
    micros = reach * 1_000_000
    timed = built.where("collected_at IS NOT NULL").withWatermark("collected_at", delay)
    states = timed.select(
        "collected_at", *labels.VEHICLE, F.unix_micros("collected_at").alias("t"), F.coalesce("station_seq", F.lit(0)).cast("bigint").alias("seq"),
        F.col("snapshot_id").alias("id"), F.col("is_no_seat").alias("no_seat"), F.col("is_low_seat_2").alias("low_seat_2"), F.col("is_low_seat_5").alias("low_seat_5"),
    )
    states = labels.sliced(states, 4 * micros, micros).withColumn("home", F.col("_slice") == F.col("_home")).drop("_home")
    out = states.groupBy(*labels.VEHICLE, "_slice").applyInPandasWithState(
        _finals(horizons, next_stop_seconds), f"part string, snapshot_id string, t bigint, {_labels_schema(horizons)}", _HELD, "append", GroupStateTimeout.EventTimeTimeout
    )
    raw = built.where("collected_at IS NOT NULL").select(F.lit("raw").alias("part"), *late_row.fieldNames())
    both = out.unionByName(raw, allowMissingColumns=True)

    def one(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        finals = held.where("part = 'final'").withColumn("collected_at", F.timestamp_micros("t")).drop("part", "t", *labels.VEHICLE)
        raw = held.where("part = 'raw'").select(*late_row.fieldNames()).dropDuplicates(["snapshot_id"])
        behind = raw.join(held.where("part = 'held'").select("snapshot_id"), "snapshot_id", "left_anti").persist()
        append_batch(behind, late_path, batch_id)
        span = held.agg(F.min(F.coalesce(F.unix_micros("collected_at"), "t")), F.max(F.coalesce(F.unix_micros("collected_at"), "t"))).first()
        if span[0] is not None:
            near = F.col("collected_at").between(F.timestamp_micros(F.lit(span[0] - 2 * micros)), F.timestamp_micros(F.lit(span[1] + 2 * micros)))
            late = stored_batches(spark, late_row, late_path, batch_id + 1).where(near).dropDuplicates(["snapshot_id"]).persist()
            if not late.isEmpty():
                # Labels to build: the new late rows, late rows that have a batch row in reach, and rows with a late row in reach.
                stored = read_latest(spark, feature_path, ["snapshot_id"], F.col("collected_at").between(
                    F.timestamp_micros(F.lit(span[0] - 4 * micros)), F.timestamp_micros(F.lit(span[1] + 4 * micros)))).persist()
                old = spark.read.schema(columns + ", batch_seq long").option("basePath", path).parquet(path).where(near & (F.col("batch_seq") < batch_id))
                out_before = old.select("snapshot_id", "collected_at").join(stored.select("snapshot_id", *labels.VEHICLE), "snapshot_id")
                now_final = finals.select("snapshot_id", "collected_at").join(stored.select("snapshot_id", *labels.VEHICLE), "snapshot_id")
                again = behind.select("snapshot_id").unionByName(_reached(late, raw, micros)).unionByName(_reached(out_before, behind, micros))
                again = again.unionByName(_reached(now_final, late, micros)).distinct().persist()
                rows = stored.join(again, "snapshot_id", "left_semi")
                built_again = relabel(stored, rows, horizons=horizons, next_stop_seconds=next_stop_seconds).join(again, "snapshot_id", "left_semi")
                built_again = built_again.join(stored.select("snapshot_id", "collected_at"), "snapshot_id")
                finals = finals.join(again, "snapshot_id", "left_anti").unionByName(built_again.select(*finals.columns))
        append_batch(finals, path, batch_id)
        held.unpersist()
        behind.unpersist()

    return _started(both.writeStream.foreachBatch(one).outputMode("append"), checkpoint, every_seconds)


def _reached(rows: DataFrame, others: DataFrame, micros: int) -> DataFrame:
    """Ids of ``rows`` that have one of ``others`` of their vehicle at their time or up to a look-ahead later: an equi-join on time slots."""
    slot = F.floor(F.unix_micros("collected_at") / F.lit(micros))
    one = rows.select("snapshot_id", *labels.VEHICLE, F.unix_micros("collected_at").alias("t"), F.explode(F.array(slot, slot + 1)).alias("slot")).alias("_a")
    two = others.select(*labels.VEHICLE, F.unix_micros("collected_at").alias("t"), slot.alias("slot")).alias("_b")
    same = _same(labels.VEHICLE, "_a", "_b") & (F.col("_a.slot") == F.col("_b.slot"))
    return one.join(two, same & (F.col("_b.t") - F.col("_a.t")).between(0, micros), "left_semi").select("snapshot_id").distinct()


def seen_slots(arrivals: DataFrame, positions: DataFrame, delay: str = "5 minutes", reach: str = "10 minutes") -> DataFrame:
    """Both slots of each streamed arrival, with ``has_candidate`` and the last position of its vehicle as ``_seen``.

    A stream-stream left outer join on route and vehicle, or route and plate, of positions up to ``reach`` before the arrival;
    the vehicle's position goes before the plate's. A slot leaves once the watermark is ``reach`` past its arrival, which is
    when Spark's interval join gives no older row any more, and its state with it. An arrival that is there twice counts once; arrivals and positions
    behind the watermark are too late for a live forecast and are dropped.
    """
    slots = live.arrival_slots(arrivals.withWatermark("collected_at", delay), keep_empty=True)
    names = slots.columns

    def keys() -> Column:
        vehicle = F.when(F.col("veh_id").isNotNull(), F.concat(F.lit("v"), F.col("veh_id").cast("string")))
        return F.array_compact(F.array(vehicle, F.when(F.col("plate_no").isNotNull(), F.concat(F.lit("p"), "plate_no"))))

    asked = slots.withColumn("_key", F.explode_outer(F.when(F.col("has_candidate") == 1, keys())))
    state = F.struct("station_seq", "station_id", "remain_seat_cnt", "crowded", "veh_id", "plate_no")
    known = positions.select(F.col("route_id").alias("_route"), F.col("collected_at").alias("_at"), "snapshot_id", state.alias("_state"), F.explode(keys()).alias("_sign"))
    known = known.withWatermark("_at", delay)
    near = (F.col("_at") <= F.col("collected_at")) & (F.col("_at") >= F.col("collected_at") - F.expr(f"INTERVAL {reach}"))
    met = asked.join(known, (F.col("route_id") == F.col("_route")) & (F.col("_key") == F.col("_sign")) & near, "left_outer")
    order = F.when(F.col("_route").isNotNull(), F.struct(F.unix_micros("_at").alias("at"), F.col("snapshot_id")))
    met = met.select(*names, "_state", order.alias("_order"), F.col("_key").startswith("v").alias("_by_vehicle"))
    by = [F.max_by("_state", F.when(F.col("_by_vehicle") == vehicle, F.col("_order"))) for vehicle in (True, False)]
    return met.groupBy(*names).agg(F.coalesce(*by).alias("_seen"))


def live_stream(
    arrivals: DataFrame,
    positions: DataFrame,
    build: Callable[[DataFrame, DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    every_seconds: int | None = None,
    delay: str = "5 minutes",
    reach: str = "10 minutes",
) -> StreamingQuery:
    """Rows to score of each request, written when the watermark is ``reach`` past its poll.

    All arrivals of a request carry the time of its poll, so their slots leave in one batch, and ``build(arrivals, slots)``
    (``pipeline.build_slot_rows`` on its tables) decides between live, timetable and none as for a whole poll. A batch that is
    run again replaces its own folder.
    """
    def one(batch: DataFrame, batch_id: int) -> None:
        # Dealt by request for what follows; the sorted output of the state's aggregate can't be kept as it is.
        held = batch.repartition("request_id").persist()
        if not held.isEmpty():
            slots = held.where("has_candidate = 1").drop("has_candidate")
            asked = held.drop("arrival_slot", *live.SLOT_FIELDS, "has_candidate", "_seen").distinct()
            append_batch(build(asked, slots), path, batch_id)
        held.unpersist()

    return _started(seen_slots(arrivals, positions, delay, reach).writeStream.foreachBatch(one).outputMode("append"), checkpoint, every_seconds)
