"""Physical plans: shuffles, pushdown and no Python in the hot path."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hazeline.functions import calendar, indices
from hazeline.operators import daily, features, joins, profile, splits
from hazeline.operators.ordered import keep_last
from suite.bindings import sensor, station, table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return plan(df).count("Exchange hashpartitioning")


@pytest.fixture(scope="module")
def rows(spark, small):
    return sensor(spark, small)


@pytest.fixture(scope="module")
def orders(spark, small):
    return station(spark, small)


@pytest.fixture()
def no_broadcast(spark):
    """Joins as they are when no side is small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_series_features_sort_their_rows_once(rows):
    text = plan(features.series_features(rows))
    # Of the rows themselves; the small table of days is grouped and sorted beside them.
    assert text.count("Exchange hashpartitioning(city") == 3 and "_block" in text
    assert len([line for line in text.splitlines() if "Sort [city" in line and "_block" in line]) == 1
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_series_plans_run_nothing_before_they_are_asked(spark, rows):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "plans only")
    try:
        plan(features.series_features(rows))
        plan(splits.split_three(rows))
        assert not tracker.getJobIdsForGroup("lazy")
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_large_series_are_dealt_by_day_then_by_block(rows, no_broadcast):
    text = plan(features.series_features(rows))
    assert "BroadcastHashJoin" not in text and "SortMergeJoin" in text
    dealt = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert sum("_block" in line for line in dealt) == 1 and not any("hashpartitioning(city" in line and "_day" not in line and "_block" not in line and "aqi" in line for line in dealt)


def test_daily_features_shuffle_once_to_aggregate_and_once_for_windows(orders):
    assert shuffles(daily.daily_features(orders)) == 2


def test_a_split_numbers_rows_within_days(rows):
    text = plan(splits.split_three(rows))
    windows = [line for line in text.splitlines() if "Window [row_number" in line]
    assert windows and all("_day" in line.split("windowspecdefinition(")[1].split(" ASC")[0] for line in windows)


def test_dedupe_reduces_before_the_shuffle(rows):
    text = plan(keep_last(rows, ["city", "collection_timestamp"], "ingest_seq"))
    assert "partial_max_by" in text and "Window" not in text


def test_column_pruning_reaches_the_scan(rows):
    text = plan(features.change_rate(rows.select("city", "collection_timestamp", "aqi")))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in text


def test_cutoffs_reach_the_scan(spark, small):
    plain = spark.read.parquet(f"{small}/orders.parquet").select(
        F.col("o_orderstatus").alias("city"), F.col("o_orderdate").alias("collection_timestamp"), F.col("o_totalprice").alias("aqi")
    )
    text = plan(profile.history_window(plain, 30))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in text
    text = plan(daily.train_cutoff(plain, "1999-06-30 23:00:00+00:00"))
    assert "PushedFilters: [IsNotNull(o_orderdate), LessThanOrEqual(o_orderdate" in text


def test_scalars_stay_in_generated_code(spark, small):
    events = table(spark, small, "events")
    value = F.col("value")
    scalars = events.select(
        indices.epa_aqi(pm2_5=value, o3=value), indices.aqi_category(value), indices.alert_level(value), indices.trend_delta(value, value / 2),
        calendar.align_interval(F.col("ts"), 3), calendar.cycle(value, 24.0)[0], joins.wmo_lookup(F.col("user_id")),
    )
    text = plan(scalars)
    assert "Python" not in text and "Exchange" not in text and "*(1) Project" in text


def test_relational_operators_use_no_python(rows, orders):
    near = joins.nearest_in_time(
        rows.select("city", "collection_timestamp", "user_id"), rows.select("city", "collection_timestamp", "aqi", F.col("ingest_seq").alias("seq")), ["city"]
    )
    for df in (near, daily.daily_features(orders), profile.acf(rows, 3), splits.ts_cv_folds(rows)):
        text = plan(df)
        assert "Python" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_nearest_forms_no_pairs(rows):
    near = joins.nearest_in_time(
        rows.select("city", "collection_timestamp", "user_id"), rows.select("city", "collection_timestamp", "aqi", F.col("ingest_seq").alias("seq")), ["city"]
    )
    text = plan(near)
    # The one join brings what the parts before and after a part hold.
    assert text.count("HashJoin") + text.count("MergeJoin") <= 2 and "_part" in text and "NestedLoop" not in text


def test_anti_join_and_fallback_shapes(rows):
    keys = rows.select("city", "collection_timestamp")
    assert "LeftAnti" in plan(joins.incremental_anti(keys, keys))
    chosen, rejected = joins.source_fallback([("a", rows.withColumn("problem", F.lit(None).cast("string"))), ("b", rows.withColumn("problem", F.lit("x")))])
    assert shuffles(chosen) == 1 and "partial_min_by" in plan(chosen) and rejected.isEmpty()


def test_scratch_folder_needs_a_shared_place(monkeypatch, spark):
    from hazeline import session

    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getConf(self):
            return {}

    class Cluster:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_dir(Cluster())


def test_start_of_time_is_utc(spark):
    row = spark.sql("select timestamp'2026-01-01 00:00:00Z' t").first()
    assert row.t.astimezone(dt.timezone.utc) == dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
