"""Results only match when these are exactly as given."""

# Canonical names of the routes under study, and the search terms that find them.
TARGET_ROUTE_NAMES = ("5000", "5001A", "5001B", "5001-1A", "5001-1B", "5003A", "5003B", "5005")

# Crowding codes.
CROWDING_LABELS = {1: "여유", 2: "보통", 3: "혼잡", 4: "매우혼잡"}

# Route type codes.
ROUTE_TYPE_LABELS = {
    11: "직행좌석형시내버스",
    12: "좌석형시내버스",
    13: "일반형시내버스",
    14: "광역급행형시내버스",
    15: "따복형시내버스",
    16: "경기순환버스",
    17: "준공영제직행좌석시내버스",
    21: "직행좌석형농어촌버스",
    22: "좌석형농어촌버스",
    23: "일반형농어촌버스",
    30: "마을버스",
    41: "고속형시외버스",
    42: "좌석형시외버스",
    43: "일반형시외버스",
    51: "리무진공항버스",
    52: "좌석형공항버스",
    53: "일반형공항버스",
}
SEATED_ROUTE_TYPES = (11, 12, 14, 16, 17, 21, 22, 41, 42, 51, 52)
DEFAULT_SEATS = 45
SCARCITY_GAMMA = 2.15

# Weekday names, Monday first.
DAY_NAMES_KO = ("월", "화", "수", "목", "금", "토", "일")

# Share of a day's boardings per hour (they sum to 1.027, kept as published).
HOUR_DEMAND_RATIOS = (
    0.010, 0.006, 0.004, 0.003, 0.004, 0.015, 0.045, 0.090, 0.105, 0.065, 0.040, 0.035,
    0.040, 0.035, 0.035, 0.045, 0.060, 0.090, 0.105, 0.075, 0.045, 0.035, 0.025, 0.015,
)
DEFAULT_VEHICLES_PER_HOUR = 6.0
BOARDINGS_FORMULA = "station_daily_avg*hour_ratio*route_share/vehicles_per_hour"

# Time limits in seconds.
CONTEXT_TOLERANCE_SECONDS = 3 * 3600
NEXT_STOP_SECONDS = 30 * 60
HORIZONS = (("5min", 300), ("10min", 600))

# Label columns and the flag that says whether their future was seen.
TARGET_FLAGS = {
    "target_no_seat_now": None,
    "target_low_seat_2_now": None,
    "target_low_seat_5_now": None,
    "target_no_seat_next_5min": "has_future_5min",
    "target_low_seat_2_next_5min": "has_future_5min",
    "target_no_seat_next_10min": "has_future_10min",
    "target_low_seat_2_next_10min": "has_future_10min",
    "target_no_seat_next_station": "has_next_station",
    "target_low_seat_2_next_station": "has_next_station",
}
DEFAULT_TARGET = "target_no_seat_next_station"

# Largest imputed share at which a feature group is still recommended.
QUALITY_GROUPS = {
    "weather": ("weather_imputed", 0.30, ("temperature", "precipitation", "humidity", "wind_speed", "cloud_amount", "weather_text")),
    "airQuality": ("air_quality_imputed", 0.50, ("pm10", "pm25", "o3", "khai", "air_quality_grade")),
    "traffic": ("traffic_imputed", 0.50, ("avg_speed", "traffic_volume", "delay_time", "congestion_level")),
    "event": ("event_imputed", 0.80, ("event_count", "event_nearby_count")),
}

# Model feature groups as (numeric columns, categorical columns).
MODEL_FEATURE_GROUPS = {
    "bus_state": (
        ("remain_seat_cnt", "seat_scarcity_score", "crowded", "estimated_capacity", "is_no_seat", "is_low_seat_2", "is_low_seat_5"),
        ("crowded_label",),
    ),
    "route": ((), ("canonical_route_name",)),
    "station_seq": (("station_seq",), ()),
    "time": (("hour_sin", "hour_cos", "day_sin", "day_cos", "is_weekend", "is_holiday"), ("time_period",)),
    "expected_boardings": (("expected_boardings_at_stop",), ()),
    "weather": (("temperature", "precipitation", "humidity", "wind_speed", "cloud_amount", "weather_imputed"), ("weather_text",)),
    "air_quality": (("pm10", "pm25", "o3", "khai", "air_quality_imputed"), ("air_quality_grade",)),
    "traffic": (("avg_speed", "traffic_volume", "delay_time", "congestion_level", "traffic_imputed"), ()),
    "event": (("event_count", "event_nearby_count", "event_imputed"), ()),
}
# Groups gated by the share of rows whose flag is set.
GATED_GROUPS = {
    "expected_boardings": ("expected_boardings_missing", 0.50),
    "weather": ("weather_imputed", 0.30),
    "air_quality": ("air_quality_imputed", 0.50),
    "traffic": ("traffic_imputed", 0.50),
    "event": ("event_imputed", 0.80),
}

# Decision thresholds swept by the reports.
THRESHOLDS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
SEGMENT_THRESHOLDS = (0.01, 0.02, 0.05) + THRESHOLDS
SEGMENTS = ("origin_0_25", "early_mid_25_50", "late_mid_50_75", "terminal_75_100", "unknown")

# Boosting and logistic settings.
BOOSTING = {"maxIter": 220, "stepSize": 0.045, "maxDepth": 5, "subsamplingRate": 0.9, "featureSubsetStrategy": "0.9", "seed": 20260524}
LOGISTIC_L2 = 0.0005
PLATT_L2 = 0.001
ARTIFACT_VERSION = "boosted_full_risk_v1"

# Korean forecast grid (Lambert conformal conic).
GRID_EARTH_RADIUS_KM = 6371.00877
GRID_STEP_KM = 5.0
GRID_PARALLELS = (30.0, 60.0)
GRID_ORIGIN = (126.0, 38.0)
GRID_OFFSET = (43.0, 136.0)
