"""Tables from SQL dumps, read with Spark's own text and CSV readers."""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from kerbline.constants import TARGET_ROUTE_NAMES
from kerbline.functions import seats, text, times
from kerbline.sources.dimensions import route_stations, target_routes
from kerbline.sources.schemas import DUMP_TABLES
from kerbline.sources.upsert import latest_per_key, tag_outcomes

# A quoted text with its escapes and doubled quotes, a tuple of an INSERT after its opening parenthesis, and a field of it.
# The runs are possessive, so a long field needs no stack.
QUOTED = r"'(?:[^'\\]++|\\.|'')*+'"
BODY = rf"^(?:[^'()]++|{QUOTED})*+\)"
FIELD = rf",\s*((?:_\w+\s+)?{QUOTED}|[^,']*+)"
HEAD = r"(?is)(CREATE TABLE|INSERT INTO)\s+`?(\w+)`?\s*(?:VALUES\s*)?$"
COMMENT = r"(?<=\n)--[ \t][^\n]*"
SNAPSHOT_KEY = ("collected_at", "route_id", "veh_id", "station_id", "station_seq", "plate_no")


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """``(of, value, _order)``: a dump's texts between opening parentheses, and which table's statement each stands in.

    One statement may be the whole dump: the file is cut at every parenthesis, so its blocks are read side by side. Whether
    a block begins inside of a quoted text, and in which statement, follows from counts of the blocks before it, one narrow row
    a block; fragments that a quoted parenthesis has cut are joined again. Line comments may hold quotes, quoted
    texts no line that begins like a comment. ``of`` is ``insert <table>`` or ``create <table>``; order is that of the file.
    """
    cut = spark.read.option("lineSep", "(").text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value"
    )
    bare = F.regexp_replace("value", COMMENT, "")
    quotes = F.regexp_replace(F.regexp_replace(bare, r"(?s)\\.", ""), "[^']++", "")
    named = F.lower(F.concat_ws(" ", F.substring(F.regexp_extract(bare, HEAD, 1), 1, 6), F.regexp_extract(bare, HEAD, 2)))
    mark = F.when(bare.rlike(HEAD), named).when(bare.rlike(r";[^']*$"), "")
    cut = cut.withColumns({"_odd": F.length(quotes) % 2, "_mark": mark})
    inside = Window.partitionBy("_file", "_block").orderBy("_at")
    earlier, until_here = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0)
    # Quoted or not, as if the block began outside of quotes.
    cut = cut.withColumn("_quoted", F.coalesce(F.sum("_odd").over(earlier), F.lit(0)) % 2)
    ends = (F.col("_quoted") + F.col("_odd")) % 2

    def last_mark(state: int) -> Column:
        return F.max_by("_mark", F.when(F.col("_mark").isNotNull() & (ends == state), F.col("_at")))

    blocks = cut.groupBy("_file", "_block").agg(
        (F.sum("_odd") % 2).alias("_total"), *(F.count_if(F.col("_quoted") == k).alias(f"_starts_{k}") for k in (0, 1)), *(last_mark(k).alias(f"_mark_{k}") for k in (0, 1))
    )
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_begins", F.coalesce(F.sum("_total").over(before), F.lit(0)) % 2)
    starts, marked = (F.when(F.col("_begins") == 0, F.col(f"_{name}_0")).otherwise(F.col(f"_{name}_1")) for name in ("starts", "mark"))
    blocks = blocks.select(
        "_file", "_block", "_begins", F.last(F.when(starts > 0, F.struct(F.col("_block").alias("block"), starts.alias("n"))), ignorenulls=True).over(before).alias("_open"),
        F.last(marked, ignorenulls=True).over(before).alias("_within"),
    )
    rows = cut.join(blocks, ["_file", "_block"])
    first, known = F.col("_quoted") == F.col("_begins"), F.when(ends == F.col("_begins"), F.col("_mark"))
    rows = rows.withColumns({"_n": F.sum(first.cast("long")).over(until_here), "_of": F.coalesce(F.last(known, ignorenulls=True).over(earlier), "_within")})
    own = F.col("_n") > 0
    rows = rows.select(
        "_file", F.when(own, F.col("_block")).otherwise(F.col("_open.block")).alias("_home"), F.when(own, F.col("_n")).otherwise(F.col("_open.n")).alias("_n"),
        F.when(first, F.col("_of")).alias("_of"), F.struct("_block", "_at", "value").alias("_part"),
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("_part")), lambda part: part["value"]), "(")
    pieces = rows.repartition("_file", "_home").groupBy("_file", "_home", "_n").agg(F.max("_of").alias("of"), joined.alias("value"))
    return pieces.select("of", "value", F.struct("_file", "_home", "_n").alias("_order"))


def _field(raw: Column) -> Column:
    """Value of a field's SQL text: a bare NULL is null, quoted text loses its quotes and escapes."""
    inner = F.regexp_extract(raw, r"(?s)^(?:_\w+\s+)?'(.*)'\s*$", 1)
    # A doubled backslash waits as a character that no dump holds until the other escapes are read.
    for escape, plain in ((r"\\\\", "\u0001"), (r"\\n", "\n"), (r"\\r", "\r"), (r"\\t", "\t"), (r"\\(.)", "$1"), ("''", "'"), ("\u0001", r"\\")):
        inner = F.regexp_replace(inner, escape, plain)
    return F.when(raw.rlike(r"'\s*$"), inner).when(F.upper(F.trim(raw)) != "NULL", F.trim(raw))


def dump_table(dumped: DataFrame, table: str, columns: str | None = None) -> DataFrame:
    """Rows of one table of ``read_dump``, all columns as text (SQL NULL is null), plus ``_order`` of appearance."""
    fields = [c.strip() for c in (columns or DUMP_TABLES[table]).split(",")]
    body = F.regexp_extract("value", BODY, 0)
    mine = dumped.where(F.col("of") == f"insert {table.lower()}").withColumn("_body", body).where("_body <> ''")
    # A list of columns before VALUES stands in parentheses too.
    mine = mine.where(~F.expr("substr(value, length(_body) + 1)").rlike(r"(?i)^\s*VALUES\s*$"))
    tuples = mine.select("_order", F.regexp_extract_all(F.concat(F.lit(","), F.expr("left(_body, length(_body) - 1)")), F.lit(FIELD), F.lit(1)).alias("_fields"))
    return tuples.select(*[_field(F.get("_fields", F.lit(i))).alias(f) for i, f in enumerate(fields)], "_order")


def dump_columns(dumped: DataFrame, table: str) -> str:
    """Column list of a table from its CREATE TABLE (one row; a dump has one such statement per table)."""
    parts = dumped.where(F.col("of") == f"create {table.lower()}").agg(F.array_sort(F.collect_list(F.struct("_order", "value"))).alias("parts"))
    statement = F.array_join(F.transform("parts", lambda part: part["value"]), "(")
    names = F.array_distinct(F.regexp_extract_all(statement, F.lit(r"(?m)^\s*`([^`]+)`"), F.lit(1)))
    found = parts.select(F.array_join(names, ", ").alias("names")).first()
    if not found["names"]:
        raise ValueError(f"the dump does not define {table}")
    return found["names"]


def dump_routes(raw: DataFrame) -> DataFrame:
    """Dump routes that have an external id, with the canonical name."""
    kept = raw.where(text.present(F.col("external_route_id")).isNotNull())
    return kept.withColumn("canonical_route_name", text.canonical_route(F.col("route_name")))


def _chosen(target_only: bool) -> Column:
    return F.col("canonical_route_name").isin(*TARGET_ROUTE_NAMES) if target_only else F.lit(True)


def dump_target_routes(routes: DataFrame, target_only: bool = True) -> DataFrame:
    """Chosen dump routes as the route dimension; the last one of an external id wins."""
    items = routes.where(_chosen(target_only)).select(
        F.col("external_route_id").alias("routeId"),
        F.col("route_name").alias("routeName"),
        seats.route_type_code(F.col("route_type")).alias("routeTypeCd"),
        seats.route_type_label(F.col("route_type")).alias("routeTypeName"),
        F.lit("import:dump").alias("regionName"),
        F.col("start_station_name").alias("startStationName"),
        F.col("end_station_name").alias("endStationName"),
        text.loose_int(F.col("default_capacity")).alias("defaultCapacity"),
        F.col("destination_zone").alias("destinationZone"),
        "_order",
    )
    newest = latest_per_key(items, ["routeId"], ["_order"]).drop("_order")
    return target_routes(newest)


def dump_route_stations(raw: DataFrame, routes: DataFrame, stations: DataFrame, target_only: bool = True) -> DataFrame:
    """Stops of the chosen routes: route by surrogate key (inner), station by surrogate key (left)."""
    route = routes.where(_chosen(target_only)).select(
        F.col("id").alias("_route"), text.loose_int(F.col("external_route_id")).alias("_external"), "canonical_route_name"
    )
    station = stations.select(F.col("id").alias("_station"), "external_station_id", "station_name", "station_number", "longitude", "latitude", "city_name")
    joined = raw.join(route, F.col("route_id") == F.col("_route")).join(station, F.col("station_id") == F.col("_station"), "left")
    items = joined.select(
        "_external",
        "canonical_route_name",
        F.col("station_sequence").alias("stationSeq"),
        F.lit(None).cast("string").alias("staOrder"),
        F.col("external_station_id").alias("stationId"),
        F.col("station_name").alias("stationName"),
        F.col("station_number").alias("mobileNo"),
        F.col("longitude").alias("x"),
        F.col("latitude").alias("y"),
        F.col("city_name").alias("regionName"),
        F.lit(None).cast("string").alias("centerYn"),
        F.lit(None).cast("string").alias("turnYn"),
        "direction",
        F.col("toward_name").alias("towardName"),
        "_order",
    )
    items = items.withColumn("_seq", text.loose_int(F.col("stationSeq")))
    newest = latest_per_key(items, ["_external", "_seq"], ["_order"]).drop("_order", "_seq")
    return route_stations(newest, F.col("_external"), F.col("canonical_route_name"))


def dump_snapshots(raw: DataFrame, routes: DataFrame, known: DataFrame, *, target_only: bool = True, minus_one_as_zero: bool = True) -> DataFrame:
    """Every dump snapshot with its ``outcome``; -1 free seats become 0, the original stays in the raw JSON.

    A snapshot without a collection time is ``rejected``: there is no sensible time to give it.
    """
    route = (
        routes.where(_chosen(target_only))
        .groupBy(text.loose_int(F.col("external_route_id")).alias("_target"))
        .agg(F.min_by("route_type", "_order").alias("_type"))
    )
    seen = text.loose_int(F.col("remaining_seat_count"))
    converted = F.coalesce(seen == -1, F.lit(False)) & F.lit(minus_one_as_zero)
    payload = [c for c in raw.columns if c != "_order"]
    rows = raw.join(route, text.loose_int(F.col("external_route_id")) == F.col("_target"), "left").select(
        times.local_datetime_to_utc(F.col("collected_at")).alias("collected_at"),
        text.loose_int(F.col("external_route_id")).alias("route_id"),
        text.loose_int(F.col("external_vehicle_id")).alias("veh_id"),
        text.present(F.col("plate_no")).alias("plate_no"),
        text.loose_int(F.col("external_station_id")).alias("station_id"),
        text.loose_int(F.col("station_sequence")).cast("int").alias("station_seq"),
        F.when(converted, 0).otherwise(seen).cast("int").alias("remain_seat_cnt"),
        text.loose_int(F.col("crowded_code")).cast("int").alias("crowded"),
        seats.route_type_code(F.col("_type")).alias("route_type_cd"),
        text.loose_int(F.col("low_plate")).cast("int").alias("low_plate"),
        text.loose_int(F.col("state_code")).cast("int").alias("state_cd"),
        text.loose_int(F.col("tagless_code")).cast("int").alias("tagless_cd"),
        F.to_json(
            F.struct(
                *payload,
                seen.alias("original_remaining_seat_count"),
                F.when(converted, 0).otherwise(seen).alias("normalized_remaining_seat_count"),
                converted.alias("normalized_from_minus_one"),
            )
        ).alias("raw_json"),
        converted.alias("from_minus_one"),
        F.col("_target").isNotNull().alias("_is_target"),
        "_order",
    )
    tagged = tag_outcomes(rows, known, SNAPSHOT_KEY, "_order", F.col("_is_target") & F.col("collected_at").isNotNull())
    no_time = F.col("_is_target") & F.col("collected_at").isNull()
    return tagged.withColumn("outcome", F.when(no_time, "rejected").otherwise(F.col("outcome"))).drop("_is_target", "_order")


def import_summary(tagged: DataFrame) -> DataFrame:
    """Counters of an import."""
    def counted(outcome):
        return F.count_if(F.col("outcome") == outcome)

    return tagged.agg(
        F.count(F.lit(1)).alias("seen"),
        counted("imported").alias("imported"),
        counted("existing").alias("skipped_existing"),
        counted("non_target").alias("skipped_non_target"),
        counted("rejected").alias("rejected"),
        F.count_if(F.col("from_minus_one") & (F.col("outcome") == "imported")).alias("minus_one_as_zero"),
    )


def import_dump(spark: SparkSession, path: str, known: DataFrame, *, target_only: bool = True, minus_one_as_zero: bool = True) -> dict[str, DataFrame]:
    """The four dump tables as dimensions and tagged snapshots."""
    dumped = read_dump(spark, path)
    raw = {t: dump_table(dumped, t, dump_columns(dumped, t)) for t in DUMP_TABLES}
    routes = dump_routes(raw["bus_route"])
    snapshots = dump_snapshots(raw["bus_snapshot"], routes, known, target_only=target_only, minus_one_as_zero=minus_one_as_zero)
    return {
        "routes": dump_target_routes(routes, target_only),
        "route_stations": dump_route_stations(raw["route_station"], routes, raw["station"], target_only),
        "snapshots": snapshots,
        "summary": import_summary(snapshots),
    }
