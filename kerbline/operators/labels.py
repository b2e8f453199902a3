"""Future-seat labels per vehicle.

A vehicle's rows are a time series. Every row needs the last state within each horizon and the first later row at a
larger stop sequence. Unknown vehicles share one key per route, so a single key can be very long: series are therefore
cut into time slices, and a row whose time lies within the largest look-ahead of a slice's start is also shown to the
slice before. One shuffle on (vehicle, slice) then serves all windows, and all frames run forward only, so the cost is
linear in the slice even when it is dense.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from kerbline.constants import HORIZONS, NEXT_STOP_SECONDS

VEHICLE = ("route_id", "veh_id", "plate_no")
#: Rows of states that a task of the windows should hold, at some 2 kB each in its sorts.
TASK_ROWS = 100_000
_RADIX_BITS = 4
_RADIX = 1 << _RADIX_BITS


def sliced(states: DataFrame, width: int, reach: int) -> DataFrame:
    home = F.floor(F.col("t") / F.lit(width)).cast("bigint")
    shown = F.when(F.col("t") - home * width <= reach, F.array(home, home - 1)).otherwise(F.array(home))
    return states.select("*", home.alias("_home"), F.explode(shown).alias("_slice"))


def _last_within(frame: DataFrame, part: list[str], horizons: Sequence[tuple[str, int]]) -> DataFrame:
    """Last state with ``t < t' <= t + horizon``: the largest (t, seq, id) up to the horizon, if it is later than t."""
    by_time = Window.partitionBy(*part).orderBy("t")
    state = F.struct("t", "seq", "row_id", "no_seat", "low_seat_2")
    ahead = {
        f"_h_{name}": F.max(state).over(by_time.rangeBetween(Window.unboundedPreceding, seconds * 1_000_000))
        for name, seconds in horizons
    }
    frame = frame.select("*", *[c.alias(n) for n, c in ahead.items()])
    return frame.withColumns({n: F.when(F.col(f"{n}.t") > F.col("t"), F.col(n)) for n in ahead})


def _next_larger(frame: DataFrame, part: list[str], levels: int, reach: int) -> DataFrame:
    """First later row (time, seq, id order) with a larger stop sequence, within ``reach`` micros.

    Two numbers differ first at some base-16 digit: the larger one shares the digits above it. So for every digit
    position, rows with equal higher digits remember the nearest later row per digit value; the earliest remembered
    row among larger digit values, over all positions, is the answer.
    """
    state = F.struct("t", "seq", "row_id", "no_seat", "low_seat_2")
    backwards = [F.col("t").desc(), F.col("seq").desc(), F.col("row_id").desc()]
    found = []
    for level in reversed(range(levels)):
        shift = _RADIX_BITS * level
        digit, prefix = F.col(f"_d{level}"), f"_p{level}"
        frame = frame.withColumn(prefix, F.shiftright("_rank", shift + _RADIX_BITS))
        frame = frame.withColumn(f"_d{level}", F.shiftright("_rank", shift).bitwiseAND(F.lit(_RADIX - 1)))
        later = Window.partitionBy(*part, prefix).orderBy(*backwards).rowsBetween(Window.unboundedPreceding, -1)
        seen = {
            v: F.last(F.when(digit == v, state), ignorenulls=True).over(later) for v in range(1, _RADIX)
        }
        frame = frame.select("*", *[c.alias(f"_s{v}") for v, c in seen.items()])
        frame = frame.withColumn(f"_n{level}", F.least(*[F.when(digit < v, F.col(f"_s{v}")) for v in seen], F.lit(None)))
        frame = frame.drop(*[f"_s{v}" for v in seen], prefix, f"_d{level}")
        found.append(F.col(f"_n{level}"))
    frame = frame.withColumn("_next", F.least(*found, F.lit(None))).drop(*[f"_n{level}" for level in range(levels)])
    return frame.withColumn("_next", F.when(F.col("_next.t") - F.col("t") <= reach, F.col("_next")))


def dealt(frame: DataFrame, part: Sequence[str], rows: int) -> DataFrame:
    """``frame`` dealt by ``part`` over as many tasks as ``rows`` need, so that a task's memory doesn't grow with the table."""
    if rows <= TASK_ROWS:
        return frame
    return frame.repartition(max(frame.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *part)


def sequence_bounds(rows: DataFrame, seq: str = "station_seq") -> tuple[int, int]:
    """Smallest and largest stop sequence; one column is read and one row comes back."""
    return _counted_bounds(rows, seq)[1:]


def _counted_bounds(rows: DataFrame, seq: str = "station_seq") -> tuple[int, int, int]:
    """Number of rows and what ``sequence_bounds`` gives, by one pass."""
    n, low, high = rows.agg(F.count(F.lit(1)), F.min(F.coalesce(seq, F.lit(0))), F.max(F.coalesce(seq, F.lit(0)))).first()
    return (n, 0, 0) if low is None else (n, int(low), int(high))


def vehicle_futures(
    rows: DataFrame,
    *,
    micros: Column,
    row_id: str = "snapshot_id",
    vehicle: Sequence[str] = VEHICLE,
    horizons: Sequence[tuple[str, int]] = HORIZONS,
    next_stop_seconds: int | None = NEXT_STOP_SECONDS,
    slice_seconds: int | None = None,
    seq_bounds: tuple[int, int] | None = None,
) -> DataFrame:
    """Per row the future states: ``_h_<horizon>`` and ``_next`` structs (null when not seen).

    A stop sequence outside given ``seq_bounds`` is an error.
    """
    reach = max([s for _, s in horizons] + [next_stop_seconds or 0]) * 1_000_000
    width = max((slice_seconds or 0) * 1_000_000, 4 * reach if slice_seconds is None else reach)
    states = rows.select(
        F.col(row_id).alias("row_id"),
        *vehicle,
        micros.alias("t"),
        F.coalesce("station_seq", F.lit(0)).cast("bigint").alias("seq"),
        F.col("is_no_seat").alias("no_seat"),
        F.col("is_low_seat_2").alias("low_seat_2"),
        F.col("is_low_seat_5").alias("low_seat_5"),
    )
    # A missing vehicle part is its own value, as it is once features are default-filled.
    part = [*vehicle, "_slice"]
    count, *bounds = _counted_bounds(rows)
    frame = dealt(sliced(states, width, reach), part, count)
    frame = _last_within(frame, part, horizons)
    if next_stop_seconds is not None:
        low, high = seq_bounds or bounds
        levels = max(1, -(-(high - low).bit_length() // _RADIX_BITS))
        inside = F.col("seq").between(F.lit(low).cast("bigint"), F.lit(high).cast("bigint"))
        wrong = F.raise_error(F.format_string(f"stop sequence %d lies outside {low} to {high}", "seq")).cast("bigint")
        frame = frame.withColumn("_rank", F.when(inside, F.col("seq") - F.lit(low).cast("bigint")).otherwise(wrong))
        frame = _next_larger(frame, part, levels, next_stop_seconds * 1_000_000).drop("_rank")
    return frame.where("_slice = _home").drop("_slice", "_home")


def label_table(rows: DataFrame, *, micros: Column, row_id: str = "snapshot_id", **options) -> DataFrame:
    """Nine targets and three availability flags per snapshot; an unseen future gives label 0 and flag 0."""
    horizons = options.get("horizons", HORIZONS)
    futures = vehicle_futures(rows, micros=micros, row_id=row_id, **options)

    def value(source, field):
        return F.coalesce(F.col(f"{source}.{field}"), F.lit(0)).cast("int")

    columns = [
        F.col("row_id").alias(row_id),
        F.col("no_seat").alias("target_no_seat_now"),
        F.col("low_seat_2").alias("target_low_seat_2_now"),
        F.col("low_seat_5").alias("target_low_seat_5_now"),
    ]
    for name, _ in horizons:
        columns += [
            value(f"_h_{name}", "no_seat").alias(f"target_no_seat_next_{name}"),
            value(f"_h_{name}", "low_seat_2").alias(f"target_low_seat_2_next_{name}"),
            F.col(f"_h_{name}").isNotNull().cast("int").alias(f"has_future_{name}"),
        ]
    if options.get("next_stop_seconds", NEXT_STOP_SECONDS) is not None:
        columns += [
            value("_next", "no_seat").alias("target_no_seat_next_station"),
            value("_next", "low_seat_2").alias("target_low_seat_2_next_station"),
            F.col("_next").isNotNull().cast("int").alias("has_next_station"),
        ]
    return futures.select(*columns)


def label_summary(labels: DataFrame) -> DataFrame:
    """Counters of a label build."""
    flags = [c for c in labels.columns if c.startswith("has_")]
    return labels.agg(
        F.count(F.lit(1)).alias("processed"), *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in flags]
    )
