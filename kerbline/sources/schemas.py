"""Column types of landed payloads (everything a payload may give as text is read as text)."""

LOCATION_ITEM = (
    "routeId STRING, vehId STRING, plateNo STRING, stationId STRING, stationSeq STRING, remainSeatCnt STRING, "
    "crowded STRING, routeTypeCd STRING, lowPlate STRING, stateCd STRING, taglessCd STRING"
)
ARRIVAL_ITEM = (
    "stationId STRING, routeId STRING, routeName STRING, routeTypeCd STRING, staOrder STRING, turnSeq STRING, flag STRING, "
    + ", ".join(
        f"predictTime{s} STRING, predictTimeSec{s} STRING, remainSeatCnt{s} STRING, crowded{s} STRING, plateNo{s} STRING, vehId{s} STRING"
        for s in (1, 2)
    )
)
ROUTE_ITEM = (
    "routeId STRING, routeName STRING, routeTypeCd STRING, routeTypeName STRING, regionName STRING, districtCd STRING, "
    "adminName STRING, startStationName STRING, endStationName STRING"
)
STATION_ITEM = (
    "stationSeq STRING, staOrder STRING, stationId STRING, stationName STRING, mobileNo STRING, x STRING, y STRING, "
    "regionName STRING, centerYn STRING, turnYn STRING, direction STRING"
)
TIMETABLE_FIELDS = [
    f"{prefix}{side}{edge}Time" for prefix in ("we", "sat", "sun") for side in ("Up", "Down") for edge in ("First", "Last")
] + [f"{side}{edge}Time" for side in ("up", "down") for edge in ("First", "Last")]
HEADWAY_FIELDS = [f"{prefix}{kind}" for prefix in ("we", "sat", "sun") for kind in ("PeekAlloc", "NPeekAlloc")] + ["peekAlloc", "nPeekAlloc"]

# Columns of the four dump tables, in their CREATE TABLE order.
DUMP_TABLES = {
    "bus_route": (
        "id, created_at, updated_at, active, default_capacity, end_station_name, external_route_id, route_name, route_type, "
        "start_station_name, destination_zone"
    ),
    "station": "id, created_at, updated_at, city_name, external_station_id, latitude, longitude, station_name, station_number",
    "route_station": "id, created_at, updated_at, direction, station_sequence, toward_name, route_id, station_id",
    "bus_snapshot": (
        "id, created_at, updated_at, collected_at, crowded_code, estimated_occupancy_rate, external_route_id, external_station_id, "
        "external_vehicle_id, low_plate, plate_no, remaining_seat_count, route_type_code, state_code, station_sequence, "
        "tagless_code, route_id"
    ),
}
