"""Sinks, tables, audit, registry and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from hazeline.operators import features, joins, profile
from hazeline.sources import audit, payloads, registry, tables
from hazeline.streaming import live

START = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
OBS = "city string, collection_timestamp timestamp, aqi double, pm2_5 double, pm10 double, temperature double, humidity double, ingest_seq long"


def observations(spark, hours, city="x", first=0, bump=0.0):
    rows = [(city, START + dt.timedelta(hours=h), h % 50 + bump, h % 7 + 0.5, None, 20.0, 50.0, first + i) for i, h in enumerate(hours)]
    return spark.createDataFrame(rows, OBS)


def test_scan_drops_unusable_times(spark, tmp_path):
    path = tmp_path / "o.csv"
    path.write_text("collection_timestamp,city,aqi\n 2026-01-01T00:00:00+00:00 ,x,1\nnever,x,2\n2026-01-01 02:00:00,x,\n2026-01-01T05:00:00+03:00,x,NaN\n")
    rows = tables.scan_observations(spark, str(path)).orderBy("collection_timestamp", F.desc("aqi")).collect()
    assert [(r.collection_timestamp.hour, r.aqi) for r in rows] == [(0, 1.0), (2, None), (2, None)]
    path.write_text("collection_timestamp,aqi\n1,2\n")
    with pytest.raises(ValueError, match="city"):
        tables.scan_observations(spark, str(path))
    path.write_text("collection_timestamp,city,aqi\n")
    with pytest.raises(ValueError, match="empty"):
        tables.scan_observations(spark, str(path))


def test_last_appended_row_wins(spark, tmp_path):
    import os

    from hazeline.operators.ordered import keep_last

    lines = [f"2026-01-01T{i % 3:02d}:00:00Z,x,{i}" for i in range(30)]
    for n, (name, part) in enumerate((("b.csv", lines[:15]), ("a.csv", lines[15:]))):
        (tmp_path / name).write_text("\n".join(["collection_timestamp,city,aqi", *part]) + "\n")
        os.utime(tmp_path / name, (1_700_000_000 + n * 60,) * 2)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128")
    try:
        kept = keep_last(tables.scan_observations(spark, str(tmp_path)), ["city", "collection_timestamp"], "ingest_seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r.aqi for r in kept) == [27.0, 28.0, 29.0]


def test_append_checks_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.sink_append(spark.sql("select 1 a, 'x' b"), path, "csv")
    tables.sink_append(spark.sql("select 'y' b, 2 a"), path, "csv")
    assert sorted(tuple(r) for r in tables.scan_csv_strings(spark, path).select("a", "b").collect()) == [("1", "x"), ("2", "y")]
    with pytest.raises(ValueError, match="'c'"):
        tables.sink_append(spark.sql("select 1 a, 2 c"), path, "csv")
    with pytest.raises(ValueError, match="nothing"):
        tables.sink_append(spark.sql("select 1 a, 'x' b").limit(0), path, "csv")


def test_feature_sources(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown"):
        tables.scan_features(spark, "elsewhere", "x")
    path = str(tmp_path / "store")
    tables.feature_table_upsert(observations(spark, range(3)), path, "ingest_seq")
    assert tables.scan_features(spark, "store", path).count() == 3
    with pytest.raises(ValueError, match="expected 4"):
        tables.feature_table_read(spark, path, 4)


def test_upsert_touches_only_its_dates(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.feature_table_upsert(observations(spark, range(72)), path, "ingest_seq")
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").glob("date=*/*.parquet")}
    tables.feature_table_upsert(observations(spark, range(30, 40), first=500, bump=0.25), path, "ingest_seq")
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").glob("date=*/*.parquet")}
    untouched = [p for p in before if "2026-01-02" not in str(p)]
    assert untouched and all(after.get(p) == before[p] for p in untouched)
    rows = tables.feature_table_read(spark, path, 72)
    assert rows.filter("aqi % 1 = 0.25").count() == 10


def test_prepare_is_strict(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        tables.feature_table_prepare(spark.sql("select 'soon' collection_timestamp")).collect()
    with pytest.raises(ValueError):
        tables.feature_table_prepare(spark.sql("select 1 a"))
    row = tables.feature_table_prepare(spark.sql("select '2026-01-01T03:00:00+03:00' collection_timestamp, 'z' timestamp"))
    assert row.columns == ["collection_timestamp"] and row.first()[0] == dt.datetime(2026, 1, 1)


def test_json_documents_skip_corrupt_files(spark, tmp_path):
    (tmp_path / "run_1.json").write_text('{\n "status": "SUCCESS",\n "records": 1\n}')
    (tmp_path / "run_2.json").write_text('{"status": "FAILED", "records": 0}')
    (tmp_path / "run_3.json").write_text('{"status": ')
    docs = tables.scan_json_docs(spark, str(tmp_path / "*.json"), "status string, records int")
    assert [r.file_name for r in docs.orderBy("file_name").collect()] == ["run_1.json", "run_2.json"]
    assert audit.latest_run_audit(docs).first().status == "FAILED"


def test_audits_of_both_kinds(spark):
    steps = spark.createDataFrame(
        [("x", START + dt.timedelta(hours=i), "error" if i < 25 else "new", "w", "b" if i % 2 else "a", f"e{i}") for i in range(30)],
        "city string, collection_timestamp timestamp, status string, weather_source string, aqi_source string, error string",
    )
    run = (START, START + dt.timedelta(seconds=32.178), "2026-01-01", "2026-01-02")
    row = audit.backfill_audit(steps, *run).first()
    assert (row.execution_time_seconds, row.pipeline_type, row.force_mode, len(row)) == (32.18, "historical", False, 17)
    assert (row.aqi_source, row.status, row.error_count, len(row.errors), row.errors[0]) == ("a, b", "PARTIAL", 25, 20, "[2026-01-01T00:00:00] e0")
    none = audit.backfill_audit(steps.withColumn("status", F.lit("skipped")), *run).first()
    assert (none.weather_source, none.status, none.errors) == ("Unknown", "SUCCESS", [])
    both = audit.union_audits(audit.live_audit(steps.withColumn("problem", F.lit("down")), F.lit(START)), audit.backfill_audit(steps, *run))
    assert both.count() == 2 and sorted(r.status for r in both.collect()) == ["FAILED", "PARTIAL"]


def test_registry_documents_and_latest(spark, tmp_path):
    for run, rmse in (("a_20260101T000000Z", 1.0), ("z_20250101T000000Z", 9.0), ("ridge_3day_dailyavg_v6_20240101T000000Z", 2.0)):
        (tmp_path / run).mkdir()
        entry = {"target": "t", "feature_cols": ["p", "q"], "test_metrics": {"rmse": rmse}, "naive_baseline": {"rmse": 5.0}}
        (tmp_path / run / "metadata.json").mkdir()
        (tmp_path / run / "metadata.json" / "part-0.txt").write_text(json.dumps({"day1_avg": entry}))
    docs = registry.registry_documents(spark, str(tmp_path))
    rows = {r.run: (r.features, r.beats_baseline) for r in registry.registry_scan(docs).collect()}
    assert rows["a_20260101T000000Z"] == (2, True) and rows["z_20250101T000000Z"] == (2, False)
    latest = registry.registry_latest(docs).first()
    assert (latest.by_stamp, latest.by_name) == ("a_20260101T000000Z", "ridge_3day_dailyavg_v6_20240101T000000Z")


def test_quality_and_sources(spark):
    df = spark.createDataFrame([("x", 1, "501", "a"), ("x", 1, "n/a", None), ("x", 2, "-1", "a")], "city string, collection_timestamp int, aqi string, aqi_source string")
    row = profile.dataset_quality(df).first()
    assert (row.rows, row.duplicates, row.invalid_aqi) == (3, 1, 2)
    shares = {r.source: r.percent for r in profile.source_summary(df).collect()}
    assert shares["Unavailable"] == pytest.approx(100 / 3)


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, 3.0, 4.0), (1.0, None, 9.0)], "a double, b double, c double")
    r = {(x.feature_1, x.feature_2): x.r for x in profile.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert r[("a", "b")] is None and r[("b", "c")] == pytest.approx(1.0)
    apart = spark.createDataFrame([(1.0, None), (2.0, None), (None, 3.0)], "a double, b double")
    assert profile.correlation_matrix(apart, ["a", "b"]).first().r is None
    empty = profile.iqr_outliers(df.withColumn("d", F.lit(None).cast("double")), ["d"]).first()
    assert (empty["count"], empty.pct, empty.lower_bound) == (0, 0.0, None)


def test_short_store_gives_way(spark):
    stored, fallback, live_rows = observations(spark, range(5)), observations(spark, range(20)), observations(spark, [19], bump=0.5)
    merged = joins.append_live(stored, fallback, live_rows, min_rows=10)
    assert merged.count() == 20 and merged.filter("aqi % 1 = 0.5").count() == 1
    assert joins.append_live(stored, fallback, live_rows, min_rows=5).count() == 6


def arrive(df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)


def feature_rows(df):
    keep = [c for c in df.columns if c.startswith("aqi_") and c != "aqi_target"]
    return {(r.city, r.collection_timestamp): tuple(None if r[c] is None else round(r[c], 8) for c in keep) for r in df.collect()}


def test_streamed_features_equal_batch_features(spark, tmp_path):
    """Arrivals in three runs, with late rows and a corrected row."""
    inbox, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    parts = [
        observations(spark, range(0, 300)).union(observations(spark, range(0, 250, 2), "y", 1000)),
        observations(spark, range(300, 420), first=2000),
        observations(spark, [421, 250, 77], first=3000, bump=0.5).union(observations(spark, range(251, 260), "y", 4000)),
    ]
    total = None
    for part in parts:
        arrive(part, inbox)
        stream = spark.readStream.schema(OBS).parquet(inbox)
        live.stream_features(stream, out, progress)
        total = part if total is None else total.union(part)
    from hazeline.operators.ordered import keep_last

    expected = features.series_features(keep_last(total, ["city", "collection_timestamp"], "ingest_seq"), horizon=None)
    assert feature_rows(live.read_versions(spark, out)) == feature_rows(expected)


def test_streamed_features_look_far_back_for_sparse_cities(spark, tmp_path):
    """Readings ten days apart: state counts rows, not days."""
    inbox, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    sparse = observations(spark, range(0, 240 * 200, 240))
    dense = observations(spark, range(240 * 199 - 300, 240 * 199), "y", 500)
    parts = [sparse.union(dense), observations(spark, [240 * 200 + 3], first=900).union(observations(spark, [240 * 200 + 1], "y", 950))]
    for part in parts:
        arrive(part, inbox)
        live.stream_features(spark.readStream.schema(OBS).parquet(inbox), out, progress)
    expected = features.series_features(parts[0].union(parts[1]), horizon=None)
    assert feature_rows(live.read_versions(spark, out)) == feature_rows(expected)


def test_a_late_row_rewrites_what_its_windows_reach_and_a_too_late_one_nothing(spark, tmp_path):
    """State holds 168 + 50 rows: the newest 50 may still change."""
    inbox, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    hours = [h for h in range(500) if h not in (100, 460)]
    parts = [observations(spark, hours[:400]), observations(spark, hours[400:], first=600), observations(spark, [460, 100], first=900)]
    for part in parts:
        arrive(part, inbox)
        live.stream_features(spark.readStream.schema(OBS).parquet(inbox), out, progress, open_rows=50)
    expected = features.series_features(parts[0].union(parts[1]).union(parts[2].filter("ingest_seq = 900")), horizon=None)
    assert feature_rows(live.read_versions(spark, out)) == feature_rows(expected)
    assert [r.ingest_seq for r in live.late_rows(spark, out).collect()] == [901]
    written = {r.version: r["count"] for r in spark.read.parquet(out).groupBy("version").count().collect()}
    # The 40 rows from hour 460 on, and the row that came too late.
    assert written == {1: 400, 2: 98, 3: 41}
    assert live.late_rows(spark, out).columns == parts[0].columns


def test_stream_dedup_across_runs(spark, tmp_path):
    inbox = str(tmp_path / "in")
    arrive(observations(spark, range(5)), inbox)
    run = lambda: live.run_available(
        live.stream_dedup(spark.readStream.schema(OBS).parquet(inbox)), str(tmp_path / "out"), str(tmp_path / "progress"))
    assert run().count() == 5
    arrive(observations(spark, range(3, 8)), inbox)
    assert run().select("city", "collection_timestamp").distinct().count() == 8 and run().count() == 8


def test_stream_daily_waits_for_the_day_to_end(spark, tmp_path):
    inbox = str(tmp_path / "in")
    arrive(observations(spark, range(0, 47)), inbox)
    run = lambda: live.run_available(
        live.stream_daily(spark.readStream.schema(OBS).parquet(inbox)), str(tmp_path / "out"), str(tmp_path / "progress")).count()
    assert run() == 1
    arrive(observations(spark, range(47, 60)), inbox)
    assert run() == 2


PAYLOADS = "city string, collection_timestamp timestamp, provider string, seq long, payload string"


def answers(hour, *given):
    weather = '{"coord": {"lat": 1.0, "lon": 2.0}, "weather": [{"description": "haze"}], "main": {"temp": 20.5, "humidity": 50.0, "pressure": 1000.0}, "wind": {"speed": 3.0}, "name": "elsewhere"}'
    station = '{"status": "ok", "data": {"aqi": %s, "city": {"name": "x"}, "iaqi": {"pm25": {"v": 12.25}}}}'
    texts = {
        "w": (payloads.WEATHER_CURRENT, weather), "w-": (payloads.WEATHER_CURRENT, "{}"), "c": (payloads.AQ_STATION_CITY, station % 150), "c2": (payloads.AQ_STATION_CITY, station % 160),
        "c-": (payloads.AQ_STATION_CITY, '{"status": "error", "data": "Unknown station"}'), "g": (payloads.AQ_STATION_GEO, station % 90), "g-": (payloads.AQ_STATION_GEO, "not json"),
        "p": (payloads.AQ_COMPONENTS, '{"list": [{"main": {"aqi": 3}, "components": {"pm2_5": 40.1}}]}'), "p-": (payloads.AQ_COMPONENTS, '{"list": []}'),
    }
    start = dt.datetime(2026, 3, 1, tzinfo=dt.timezone.utc)
    return [("town", start + dt.timedelta(hours=hour), texts[g][0], i, texts[g][1]) for i, g in enumerate(given)]


def test_ingest_waits_for_the_city_station_then_falls_back(spark, tmp_path):
    inbox, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def run(*rows):
        arrive(spark.createDataFrame([r for hour in rows for r in hour], PAYLOADS), inbox)
        live.stream_ingest(spark.readStream.schema(PAYLOADS).parquet(inbox), out, progress)
        return {r.collection_timestamp.hour: (r.aqi_source, r.aqi, r.pm2_5) for r in spark.read.parquet(f"{out}/valid").collect()}

    city, geo, parts = payloads.AQ_STATION_CITY, payloads.AQ_STATION_GEO, payloads.AQ_COMPONENTS
    first = run(answers(0, "g", "p", "w"), answers(1, "c", "w", "c2"), answers(2, "c-", "g-", "w", "p"), answers(3, "g", "w"))
    # Hour 1 has its city station and does not wait; hour 0 is two hours past, hours 2 and 3 are not.
    assert first == {0: (geo, 90.0, 12.25), 1: (city, 160.0, 12.25)}
    second = run(answers(1, "c"), answers(3, "c"), answers(4, "c-", "g-", "p-", "w"), answers(5, "c", "g", "w-"), answers(9, "c", "w"))
    assert second == {0: (geo, 90.0, 12.25), 1: (city, 160.0, 12.25), 2: (parts, 3.0, 40.1), 3: (city, 150.0, 12.25), 9: (city, 150.0, 12.25)}
    assert spark.read.parquet(f"{out}/valid").count() == 5
    assert {r.city for r in spark.read.parquet(f"{out}/valid").collect()} == {"elsewhere"}
    failed = [r.error for r in spark.read.parquet(f"{out}/audit").collect() if r.error]
    assert failed == [f"{city}: missing status ok | {geo}: missing status ok | {parts}: missing list"]
    assert spark.read.parquet(f"{out}/audit").agg(F.sum("records")).first()[0] == 5
    again = run(answers(9, "c2"))
    assert len(again) == 5 and spark.read.parquet(f"{out}/valid").count() == 5


def test_ingest_run_repeats_cleanly(spark, tmp_path):
    from suite.streams import arriving_payloads

    source = observations(spark, range(1, 60)).withColumns({"pressure": F.lit(1000.0), "wind_speed": F.lit(3.0)})
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    arrive(arriving_payloads(source.withColumn("ingest_seq", F.hour("collection_timestamp").cast("long"))), inbox)
    schema = spark.read.parquet(inbox).schema
    for progress in ("p1", "p2"):  # a lost progress log replays its batches into the same folders
        live.stream_ingest(spark.readStream.schema(schema).parquet(inbox), out, str(tmp_path / progress))
    valid, bad = spark.read.parquet(f"{out}/valid"), spark.read.parquet(f"{out}/quarantine")
    hours = [h % 24 for h in range(1, 60)]
    assert valid.count() == sum(h % 23 != 0 for h in hours)
    assert bad.count() == sum(h % 23 == 0 for h in hours)
    assert {r.status for r in spark.read.parquet(f"{out}/audit").collect() if r.records} == {"SUCCESS"}


class Held:
    """State of one key as a stream keeps it."""

    def __init__(self, watermark):
        self.watermark, self.value, self.hasTimedOut, self.timeout = watermark, None, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutTimestamp(self, at):
        assert at > self.watermark
        self.timeout = at

    def getCurrentWatermarkMs(self):
        return self.watermark


def test_one_state_key_settles_many_hours_at_their_own_times():
    import pandas as pd

    def frame(*rows):
        return pd.DataFrame(rows, columns=["request_city", "at", "rank", "seq", "problem", "body"])

    def settled(state, *frames):
        return sorted(tuple(r) for f in live.settle((7,), iter(frames), state) for r in f.itertuples(index=False))

    state = Held(0)
    early, late = 5_000_000, 9_000_000
    first = settled(
        state, frame(("x", early, 0, 0, None, "w"), ("x", early, 1, 1, None, "c"), ("y", early, 0, 0, None, "v"), ("y", early, 2, 1, None, "g")),
        frame(("x", late, 0, 0, None, "u"), ("x", late, 1, 1, "refused", None)),
    )
    assert first == [("x", early, "w", "c", None)] and state.timeout == 5001
    # The hour that has passed falls back although the key gets rows for another one; the later hour waits.
    state.watermark = 6000
    assert settled(state, frame(("x", late, 3, 2, None, "p"))) == [("y", early, "v", "g", None)] and state.timeout == 9001
    state.watermark, state.hasTimedOut = 9500, True
    assert settled(state) == [("x", late, "u", "p", None)] and not state.exists


def test_the_expected_rows_of_a_feature_table_are_its_keys(spark, tmp_path):
    from suite import sources

    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(hours=i // 2), 1, "view", 90.0 + 10 * i, '{"k": 1}') for i in range(6)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    found = {r.city: (r.n, r.aqi) for r in sources.suite.queries["feature_table_read"](spark, str(tmp_path)).collect()}
    # The raised arrivals 91, 111 and 131 replace the others; of those above 100 the later of a pair is stored for the new city.
    assert found == {"view": (3, 111.0), "view-new": (2, 130.0)}
