"""Series operators give the same results for blocks of any size, and match plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hazeline.operators import features, joins, metrics, ordered, profile, splits
from hazeline.operators.ordered import in_blocks, keep_last, neighbours, running_sum, series_index
from hazeline.operators.ranks import quantiles

START = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="module")
def skewed(spark):
    """One city with most rows, two small ones, gaps and random nulls."""
    rng = random.Random(7)
    rows = []
    for city, n in (("big", 900), ("small", 40), ("tiny", 3)):
        for i in sorted(rng.sample(range(2 * n), n)):
            value = lambda p=0.1: None if rng.random() < p else round(rng.uniform(0, 300), 2)
            rows.append((city, START + dt.timedelta(hours=i), value(), value(), value(0.9), value(0.0), value(), len(rows)))
    schema = "city string, collection_timestamp timestamp, aqi double, pm2_5 double, pm10 double, temperature double, humidity double, ingest_seq long"
    return spark.createDataFrame(rows, schema).repartition(5).cache()


def rows_of(df):
    def plain(v):
        return round(v, 7) if isinstance(v, float) else v

    return sorted((tuple(plain(v) for v in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


CASES = {
    "features": lambda d: features.series_features(d, 24),
    "target": lambda d: features.target_ahead(d, 72),
    "rolling": metrics.rolling_naive,
    "index": lambda d: series_index(d, ["city"], ["collection_timestamp"]),
    "split": splits.split_three,
    "folds": lambda d: splits.ts_cv_folds(d, 5, 10),
    "blocks": lambda d: splits.walk_forward_blocks(d, ["temperature"], 30, 20),
    "acf": lambda d: profile.acf(d.na.fill(0.0, ["aqi"]), 5),
    "drift": profile.volatility_drift,
    "describe": lambda d: profile.describe(d, ["aqi", "pm10", "temperature"]),
    "box": lambda d: profile.box_stats(d, "city"),
    "shift": lambda d: profile.distribution_shift(splits.split_three(d.filter("city <> 'tiny'")), ["aqi", "temperature"]),
    "targets": lambda d: metrics.target_stats(d.filter("city = 'big'"), (6, 24)),
}


@pytest.mark.parametrize("name", list(CASES))
def test_small_blocks_equal_one_block(monkeypatch, skewed, name):
    source = skewed.filter("city <> 'tiny'") if name == "split" else skewed
    whole = rows_of(CASES[name](source))
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 30)
    monkeypatch.setattr(ordered, "REACHES", 1)
    assert whole and rows_of(CASES[name](source)) == whole


@pytest.mark.parametrize(("back", "ahead"), [(0, 0), (7, 0), (0, 9), (30, 30), (100, 3)])
def test_blocks_hold_what_their_windows_reach(spark, monkeypatch, back, ahead):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 20)
    monkeypatch.setattr(ordered, "REACHES", 1)
    rng = random.Random(back + ahead)
    days = [d for d in range(120) for _ in range(rng.choice([0, 0, 1, 3, 3, 60]))]
    rows = [("c", START + dt.timedelta(days=d, seconds=i), i) for i, d in enumerate(days)] + [(None, START, 0), (None, None, -1)]
    df = spark.createDataFrame(rows, "city string, collection_timestamp timestamp, i int")
    held = {}
    for r in in_blocks(df, ["city"], "collection_timestamp", back, ahead).collect():
        held.setdefault((r.city, r["_block"]), []).append((r.i, r["_own"] == r["_block"]))
    own = [i for (city, _), block in held.items() if city for i, mine in block if mine]
    assert sorted(own) == list(range(len(days)))
    for (city, _), block in held.items():
        if city and any(mine for _, mine in block):
            there = {i for i, _ in block}
            for i, mine in block:
                assert not mine or there.issuperset(range(max(0, i - back), min(len(days), i + ahead + 1)))
    assert len([b for b in held if b[0]]) > 3
    assert sorted(i for (city, _), block in held.items() if city is None for i, mine in block if mine) == [-1, 0]


def test_positions_match_a_plain_count(skewed):
    got = {(r.city, r.collection_timestamp): (r.row_index, r.n_rows) for r in series_index(skewed, ["city"], ["collection_timestamp"]).collect()}
    keys = sorted(got)
    assert len(keys) == 943
    for city, n in (("big", 900), ("small", 40), ("tiny", 3)):
        assert [got[k] for k in keys if k[0] == city] == [(i + 1, n) for i in range(n)]


def test_autocorrelation_matches_numpy(spark, skewed):
    import numpy as np

    got = {(r.city, r.lag): r.acf for r in profile.acf(skewed, 5).collect()}
    for city in ("big", "small", "tiny"):
        x = [r.aqi for r in sorted(skewed.collect(), key=lambda r: r.collection_timestamp) if r.city == city]
        mean = np.mean([v for v in x if v is not None])
        x = np.array([0.0 if v is None else v - mean for v in x])
        for k in range(1, 6):
            assert got[city, k] == pytest.approx((x[k:] * x[:-k]).sum() / (x * x).sum())
    empty = spark.createDataFrame([("c", START, None)], "city string, collection_timestamp timestamp, aqi double")
    assert [r.acf for r in profile.acf(empty, 2).collect()] == [None, None]


def test_running_sum_counts_null_as_nothing(skewed):
    got = running_sum(skewed, ["city"], ["collection_timestamp"], {"total": "temperature", "n": F.lit(1)})
    expected, seen = {}, {}
    for r in sorted(skewed.collect(), key=lambda r: (r.city, r.collection_timestamp)):
        seen[r.city] = seen.get(r.city, 0.0) + (r.temperature or 0.0)
        expected[(r.city, r.collection_timestamp)] = seen[r.city]
    for r in got.collect():
        assert r.total == pytest.approx(expected[(r.city, r.collection_timestamp)])


def test_neighbours_split(skewed):
    got = neighbours(skewed, ["city"], ["collection_timestamp"], ["pm10", "aqi"])
    ordered = sorted(skewed.collect(), key=lambda r: (r.city, r.collection_timestamp))
    for r in got.collect():
        past = [o.pm10 for o in ordered if o.city == r.city and o.collection_timestamp <= r.collection_timestamp and o.pm10 is not None]
        next_ = [o.pm10 for o in ordered if o.city == r.city and o.collection_timestamp >= r.collection_timestamp and o.pm10 is not None]
        assert (r.pm10_before, r.pm10_after) == (past[-1] if past else None, next_[0] if next_ else None)


def test_nearest_equals_brute_force(spark):
    rng = random.Random(3)
    at = lambda: START + dt.timedelta(minutes=10 * rng.randrange(2000))
    requests = [(rng.choice(["hot", "hot", "cold"]), at(), i) for i in range(300)]
    measured = [(rng.choice(["hot", "hot", "cold", "none"]), at(), i, float(i)) for i in range(250)]
    got = joins.nearest_measurement(
        spark.createDataFrame(requests, "sensor string, collection_timestamp timestamp, request long"),
        spark.createDataFrame(measured, "sensor string, collection_timestamp timestamp, seq long, value double"),
        ["sensor"], hours=6,
    ).collect()
    assert len(got) == len(requests)
    wanted = {r[2]: r for r in requests}
    for r in got:
        sensor, ts, _ = wanted[r.request]
        near = [(abs(m[1] - ts), m[2]) for m in measured if m[0] == sensor and abs(m[1] - ts) <= dt.timedelta(hours=6)]
        assert (r.hit.seq if r.hit else None) == (min(near)[1] if near else None)


def test_long_days_are_not_copied_whole(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 400)
    rows = [("c", START + dt.timedelta(minutes=i)) for i in range(3 * 1440)]
    df = spark.createDataFrame(rows, "city string, collection_timestamp timestamp")
    held = in_blocks(df, ["city"], "collection_timestamp", 10, 10).collect()
    # A block holds its own rows and an hour of 60 rows on either side, no day of 1,440.
    assert sum(r["_own"] == r["_block"] for r in held) == len(rows) and len(held) <= 1.4 * len(rows)
    own = [sum(r["_own"] == r["_block"] == b for r in held) for b in {r["_block"] for r in held}]
    assert max(own) <= 400 + 60


def test_keep_last_takes_greatest_order(spark):
    rows = [("a", 1, 5, "x"), ("a", 1, 9, "y"), ("a", 2, 1, "z"), ("b", 1, 3, None)]
    got = keep_last(spark.createDataFrame(rows, "city string, t int, seq int, v string"), ["city", "t"], "seq")
    assert got.columns == ["city", "t", "seq", "v"]
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1, 9, "y"), ("a", 2, 1, "z"), ("b", 1, 3, None)]


@pytest.mark.parametrize("values", [[4.0], [1.0, 2.0], [3.0, 3.0, 3.0, 9.0], [float(i * i) for i in range(101)]])
def test_quantiles_interpolate_like_numpy(spark, values):
    import numpy as np

    probabilities = {"q1": 0.25, "median": 0.5, "q3": 0.75, "p9": 0.9}
    df = spark.createDataFrame([("c", v) for v in values], "k string, value double")
    got = quantiles(df, ["k"], probabilities).first()
    for name, p in probabilities.items():
        assert got[name] == pytest.approx(np.quantile(values, p))


def test_no_lag_crosses_a_city(spark, skewed):
    got = features.lag_features(skewed)
    first = got.groupBy("city").agg(F.min_by(F.struct("temperature_lag_1", "temperature_lag_168"), "collection_timestamp").alias("f"))
    assert all(r.f.temperature_lag_1 is None and r.f.temperature_lag_168 is None for r in first.collect())
