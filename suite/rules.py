"""Queries over validation, calendar, index and selection functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazeline import schemas as S
from hazeline.functions import calendar, indices
from hazeline.operators import daily, features, profile, validate
from hazeline.operators.ordered import keep_last
from suite.bindings import NUDGE, SENSOR, STATION, Suite, rounded, sensor, station_as_stored, table

suite = Suite()
AS_OF = "2024-02-01T00:00:00Z"


def raw_records(spark, sf_dir):
    """Observation text as it arrives, with every kind of defect in it."""
    seq = F.col("ingest_seq")
    iso = F.date_format("collection_timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    late = F.date_format(F.col("collection_timestamp") + F.make_dt_interval(days=F.lit(400)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = sensor(spark, sf_dir)
    return rows.select(
        "ingest_seq",
        F.when(seq % 97 == 0, "yesterday").when(seq % 89 == 0, late).otherwise(iso).alias("timestamp"),
        iso.alias("collection_timestamp"),
        F.when(seq % 83 != 0, F.col("city")).alias("city"),
        (seq % 190 - 95).cast("string").alias("latitude"),
        (seq % 370 - 185).cast("string").alias("longitude"),
        F.when(seq % 79 == 0, "warm").otherwise("21.5").alias("temperature"),
        (F.col("user_id") % 90 - 5).cast("string").alias("humidity"),
        F.when(seq % 53 == 0, "true").otherwise("1008").alias("pressure"),
        (seq % 12 - 1).cast("string").alias("wind_speed"),
        F.lit("180").alias("wind_direction"),
        F.lit("10000").alias("visibility"),
        F.lit("40").alias("clouds"),
        F.lit("haze").alias("weather"),
        F.when(seq % 31 != 0, (seq % 300).cast("string")).alias("aqi"),
        F.when(seq % 37 == 0, "n/a").otherwise("35").alias("pm2_5"),
        F.when(seq % 3 == 0, F.when(seq % 41 == 0, "-1").otherwise("50")).alias("pm10"),
        *[F.lit(None).cast("string").alias(c) for c in ("co", "so2", "no2", "o3")],
    )


RAW = """raw AS (SELECT event_id AS ingest_seq,
  CASE WHEN event_id % 97 = 0 THEN 'bad' WHEN event_id % 89 = 0 THEN 'late' ELSE 'fine' END AS time_kind,
  CASE WHEN event_id % 83 <> 0 THEN event_type END AS city, event_id % 190 - 95 AS latitude, event_id % 370 - 185 AS longitude,
  user_id % 90 - 5 AS humidity, event_id % 12 - 1 AS wind_speed FROM events)"""

RULES = {
    "required": {"required:city": "city IS NULL", "required:aqi": "ingest_seq % 31 = 0"},
    "datatypes": {
        "numeric:temperature": "ingest_seq % 79 = 0", "numeric:pressure": "ingest_seq % 53 = 0", "numeric:pm2_5": "ingest_seq % 37 = 0",
    },
    "non_negative": {
        "negative:humidity": "humidity < 0", "negative:wind_speed": "wind_speed < 0",
        "negative:pm10": "ingest_seq % 3 = 0 AND ingest_seq % 41 = 0",
    },
    "coordinates": {
        "range:latitude": "latitude NOT BETWEEN -90 AND 90", "range:longitude": "longitude NOT BETWEEN -180 AND 180",
    },
    "timestamp": {"format:timestamp": "time_kind = 'bad'", "future:timestamp": "time_kind = 'late'"},
}


def rule_sql(*names: str) -> str:
    return " UNION ALL ".join(
        f"SELECT ingest_seq, '{reason}' AS reason FROM raw WHERE {condition}"
        for name in names
        for reason, condition in RULES[name].items()
    )


def reasons(df, column):
    return df.select("ingest_seq", F.explode(column).alias("reason"))


@suite.query("rule_required", f"WITH {RAW} {rule_sql('required')}")
def rule_required(spark, sf_dir):
    return reasons(raw_records(spark, sf_dir), validate.rule_required())


@suite.query(
    "rule_optional_keys",
    "SELECT count(*) AS n, count(*) FILTER (WHERE event_id % 3 = 0) AS pm10_present FROM events",
)
def rule_optional_keys(spark, sf_dir):
    raw = raw_records(spark, sf_dir)
    validate.rule_optional_keys(raw)
    return raw.agg(F.count("*").alias("n"), F.count("pm10").alias("pm10_present"))


@suite.query("rule_datatypes", f"WITH {RAW} {rule_sql('datatypes')}")
def rule_datatypes(spark, sf_dir):
    raw = raw_records(spark, sf_dir)
    return reasons(raw, validate.rule_datatypes(raw))


@suite.query("rule_non_negative", f"WITH {RAW} {rule_sql('non_negative')}")
def rule_non_negative(spark, sf_dir):
    raw = raw_records(spark, sf_dir)
    return reasons(raw, validate.rule_non_negative(raw))


@suite.query("rule_coordinates", f"WITH {RAW} {rule_sql('coordinates')}")
def rule_coordinates(spark, sf_dir):
    raw = raw_records(spark, sf_dir)
    return reasons(raw, validate.rule_coordinates(raw))


@suite.query("rule_timestamp", f"WITH {RAW} {rule_sql('timestamp')}")
def rule_timestamp(spark, sf_dir):
    return reasons(raw_records(spark, sf_dir), validate.rule_timestamp(F.lit(AS_OF).cast("timestamp")))


@suite.query(
    "validate_records",
    f"""WITH {RAW}, found AS ({rule_sql(*RULES)}), per_row AS (
      SELECT r.ingest_seq, count(f.reason) AS n_violations, string_agg(f.reason, ',' ORDER BY f.reason) AS reasons
      FROM raw r LEFT JOIN found f ON r.ingest_seq = f.ingest_seq GROUP BY r.ingest_seq)
    SELECT ingest_seq, n_violations = 0 AS valid, coalesce(reasons, '') AS reasons FROM per_row""",
)
def validate_records(spark, sf_dir):
    valid, quarantine = validate.validate_records(raw_records(spark, sf_dir), F.lit(AS_OF).cast("timestamp"))
    good = valid.select("ingest_seq", F.lit(True).alias("valid"), F.lit("").alias("reasons"))
    bad = quarantine.select(
        "ingest_seq", F.lit(False).alias("valid"), F.concat_ws(",", F.array_sort(validate.VIOLATIONS)).alias("reasons")
    )
    return good.unionByName(bad)


@suite.query(
    "align_interval",
    "SELECT event_id, date_trunc('day', ts) + to_hours(CAST(floor(hour(ts) / 3) * 3 AS INTEGER)) AS h3, "
    "date_trunc('day', ts) + to_hours(CAST(floor(hour(ts) / 5) * 5 AS INTEGER)) AS h5 FROM events",
)
def align_interval(spark, sf_dir):
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select(
        "event_id", calendar.align_interval(ts, 3).alias("h3"), calendar.align_interval(ts, 5).alias("h5")
    )


GRID = """grid AS (SELECT city, unnest(generate_series(date_trunc('day', a) + to_hours(CAST(floor(hour(a) / 3) * 3 AS INTEGER)), b,
  INTERVAL 3 HOUR)) AS collection_timestamp FROM (SELECT event_type AS city, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1))"""


def grid(spark, sf_dir, hours=3):
    spans = sensor(spark, sf_dir).groupBy("city").agg(
        F.min("collection_timestamp").alias("start"), F.max("collection_timestamp").alias("end")
    )
    return calendar.interval_grid(spans, "start", "end", hours)


@suite.query("interval_grid", f"WITH {GRID} SELECT city, collection_timestamp FROM grid")
def interval_grid(spark, sf_dir):
    return grid(spark, sf_dir)


@suite.query("city_slug", "SELECT p_partkey, replace(lower(p_name), ' ', '_') AS slug FROM part")
def city_slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", calendar.city_slug(F.col("p_name")).alias("slug"))


@suite.query(
    "select_features",
    " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS feature WHERE EXISTS (SELECT 1 FROM events WHERE value IS NOT NULL)"
        for i, c in enumerate(S.model_features(), 1)
    ),
)
def select_features(spark, sf_dir):
    chosen = features.select_features(features.build_features(sensor(spark, sf_dir), complete_only=False))
    return spark.createDataFrame(list(enumerate(chosen, 1)), "position int, feature string")


MEASURES = ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@suite.query(
    "numeric_columns",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, round(max(CAST({c} AS DOUBLE)) + {NUDGE}, 6) AS largest FROM lineitem" for c in MEASURES
    ),
)
def numeric_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    found = profile.numeric_columns(rows, drop=["l_linenumber"])
    values = rows.select(*[F.col(c).cast("double").alias(c) for c in found]).unpivot([], found, "column", "value")
    return values.groupBy("column").agg(F.count("value").alias("n"), F.max("value").alias("largest"))


@suite.query(
    "train_cutoff",
    f"WITH {STATION} SELECT city, collection_timestamp, {rounded('aqi')}, ingest_seq FROM station "
    "WHERE collection_timestamp <= TIMESTAMP '1999-06-30 23:00:00'",
)
def train_cutoff(spark, sf_dir):
    return daily.train_cutoff(station_as_stored(spark, sf_dir), "1999-06-30 23:00:00+00:00").select(
        "city", "collection_timestamp", "aqi", "ingest_seq"
    )


@suite.query(
    "history_window",
    f"WITH {STATION} SELECT city, collection_timestamp, {rounded('aqi')}, ingest_seq FROM station "
    "WHERE collection_timestamp >= (SELECT max(collection_timestamp) FROM station) - INTERVAL 365 DAY",
)
def history_window(spark, sf_dir):
    return profile.history_window(station_as_stored(spark, sf_dir), 365).select("city", "collection_timestamp", "aqi", "ingest_seq")


@suite.query(
    "time_fields",
    "SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, "
    "CAST(day(ts) AS INTEGER) AS day_of_month, CAST(month(ts) AS INTEGER) AS month, CAST(dayofyear(ts) AS INTEGER) AS day_of_year FROM events",
)
def time_fields(spark, sf_dir):
    rows = calendar.time_fields(table(spark, sf_dir, "events"), "ts")
    return rows.select("event_id", "hour", "day_of_week", "day_of_month", "month", F.dayofyear("ts").alias("day_of_year"))


@suite.query(
    "cyclical",
    "SELECT ingest_seq, " + ", ".join(
        f"round({f}(2 * pi() * {v} / {p}) + {NUDGE}, 6) AS {n}_{f}"
        for n, v, p in (("hour", "hour(ts)", 24), ("day_of_week", "(isodow(ts) - 1)", 7), ("month", "month(ts)", 12)) for f in ("sin", "cos")
    ) + " FROM (SELECT event_id AS ingest_seq, ts FROM events)",
)
def cyclical(spark, sf_dir):
    rows = calendar.cyclical(calendar.time_fields(sensor(spark, sf_dir)))
    return rows.select("ingest_seq", *[f"{n}_{f}" for n in S.CYCLES for f in ("sin", "cos")])


UNITS = "CASE WHEN event_id % 2 = 0 THEN 'µg/m³' ELSE 'ppb' END"


@suite.query(
    "unit_conversion",
    "SELECT event_id, " + ", ".join(
        f"round(CASE WHEN event_id % 2 = 0 THEN value / {d}::DOUBLE ELSE value END + {NUDGE}, 6) AS {g}"
        for g, d in indices.MASS_DIVISORS.items()
    ) + " FROM events",
)
def unit_conversion(spark, sf_dir):
    unit = F.when(F.col("event_id") % 2 == 0, "µg/m³").otherwise("ppb")
    return table(spark, sf_dir, "events").select(
        "event_id", *[indices.unit_conversion(F.col("value"), unit, g).alias(g) for g in indices.MASS_DIVISORS]
    )


def subindex_sql(value: str, pollutant: str) -> str:
    arms = " ".join(
        f"WHEN {value} BETWEEN {float(lo)}::DOUBLE AND {float(hi)}::DOUBLE THEN CAST(round_even(({i_hi} - {i_lo}) / "
        f"({float(hi)}::DOUBLE - {float(lo)}::DOUBLE) * ({value} - {float(lo)}::DOUBLE) + {i_lo}, 0) AS INTEGER)"
        for lo, hi, i_lo, i_hi in indices.EPA_BREAKPOINTS[pollutant]
    )
    return f"CASE {arms} END"


@suite.query(
    "epa_subindex",
    "SELECT event_id, " + ", ".join(f"{subindex_sql('value', p)} AS {p}" for p in indices.EPA_BREAKPOINTS) + " FROM events",
)
def epa_subindex(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", *[indices.epa_subindex(F.col("value"), p).alias(p) for p in indices.EPA_BREAKPOINTS]
    )


CONCENTRATIONS = {"pm2_5": "value", "pm10": "value * 1.5::DOUBLE", "co": "value / 20", "so2": "value * 2", "no2": "value * 3", "o3": "value / 2"}


@suite.query(
    "epa_aqi",
    "SELECT event_id, greatest(" + ", ".join(subindex_sql(f"({v})", p) for p, v in CONCENTRATIONS.items()) + ") AS aqi FROM events",
)
def epa_aqi(spark, sf_dir):
    value = F.col("value")
    parts = {"pm2_5": value, "pm10": value * 1.5, "co": value / 20, "so2": value * 2, "no2": value * 3, "o3": value / 2}
    return table(spark, sf_dir, "events").select("event_id", indices.epa_aqi(**parts).alias("aqi"))


@suite.query(
    "pollution_index",
    f"WITH {SENSOR} SELECT ingest_seq, round((pm2_5 / 35.4::DOUBLE + coalesce(pm10 / 154.0::DOUBLE, 0)) / "
    f"(1 + CASE WHEN pm10 IS NULL THEN 0 ELSE 1 END) + {NUDGE}, 6) AS pollution_index FROM sensor",
)
def pollution_index(spark, sf_dir):
    rows = sensor(spark, sf_dir)
    return rows.select("ingest_seq", indices.pollution_index(indices.available_pollutants(rows)).alias("pollution_index"))


BANDS = "CASE " + " ".join(f"WHEN value <= {b[0]} THEN '{{{i}}}'" for i, b in enumerate(indices.AQI_BANDS[:-1])) + " ELSE '{5}' END"


@suite.query(
    "aqi_category",
    f"SELECT event_id, {BANDS.format(*[b[1] for b in indices.AQI_BANDS])} AS category, "
    f"{BANDS.format(*[b[2] for b in indices.AQI_BANDS])} AS colour FROM events",
)
def aqi_category(spark, sf_dir):
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", indices.aqi_category(value).alias("category"), indices.aqi_category(value, "colour").alias("colour")
    )


@suite.query(
    "trend_delta",
    f"WITH {SENSOR} SELECT ingest_seq, CASE WHEN abs(aqi - pm2_5) < 2 THEN 'Stable' WHEN aqi > pm2_5 THEN 'Increasing' "
    f"ELSE 'Decreasing' END AS direction, round(aqi - pm2_5 + {NUDGE}, 6) AS delta FROM sensor",
)
def trend_delta(spark, sf_dir):
    now, before = F.col("aqi"), F.col("pm2_5")
    return sensor(spark, sf_dir).select("ingest_seq", indices.trend_delta(now, before).alias("direction"), (now - before).alias("delta"))


@suite.query(
    "alert_level",
    f"SELECT event_id, CASE WHEN value >= 150 THEN {BANDS.format(*[b[1] for b in indices.AQI_BANDS])} END AS alert FROM events",
)
def alert_level(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", indices.alert_level(F.col("value")).alias("alert"))


@suite.query("numeric_coerce", "SELECT o_orderkey, TRY_CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS level, "
             "TRY_CAST(o_orderpriority AS DOUBLE) AS none FROM orders")
def numeric_coerce(spark, sf_dir):
    text = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", indices.numeric_coerce(F.split(text, "-")[0]).alias("level"), indices.numeric_coerce(text).alias("none")
    )


@suite.query("clip_percent", f"SELECT event_id, round(least(greatest(value - 20, 0), 100) + {NUDGE}, 6) AS percent FROM events")
def clip_percent(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", indices.clip_percent(F.col("value") - 20).alias("percent"))


@suite.query(
    "source_coverage",
    f"WITH {SENSOR} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) + {NUDGE}, 6) AS coverage FROM sensor"
        for c in ("aqi", "pm2_5", "pm10", "temperature", "humidity")
    ),
)
def source_coverage(spark, sf_dir):
    return features.source_coverage(sensor(spark, sf_dir), S.CHANGE_COLUMNS)


@suite.query(
    "dedup_keep_last",
    "SELECT o_orderpriority AS city, o_orderdate AS collection_timestamp, max(o_orderkey) AS ingest_seq, "
    f"round(max_by(o_totalprice, o_orderkey) + {NUDGE}, 6) AS aqi FROM orders GROUP BY 1, 2",
)
def dedup_keep_last(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("city"), F.col("o_orderdate").alias("collection_timestamp"),
        F.col("o_orderkey").alias("ingest_seq"), F.col("o_totalprice").alias("aqi"),
    )
    return keep_last(rows, S.KEY, "ingest_seq")


@suite.query(
    "sort_city_time",
    f"WITH {SENSOR} SELECT city, collection_timestamp, ingest_seq, {rounded('aqi')} FROM sensor ORDER BY city, collection_timestamp",
)
def sort_city_time(spark, sf_dir):
    return sensor(spark, sf_dir).select("city", "collection_timestamp", "ingest_seq", "aqi").orderBy("city", "collection_timestamp")
