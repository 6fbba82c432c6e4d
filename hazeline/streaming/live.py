"""Hourly arrivals as Structured Streaming jobs."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hazeline import schemas as S
from hazeline.functions.indices import aqi_category, alert_level
from hazeline.operators.features import series_features
from hazeline.operators.joins import merge_weather_aqi, observation_of
from hazeline.operators.ordered import keep_last
from hazeline.operators.validate import VIOLATIONS, with_violations
from hazeline.session import materialize
from hazeline.sources.audit import live_audit
from hazeline.sources.payloads import (
    AQ_COMPONENTS, AQ_STATION_CITY, AQ_STATION_GEO, WEATHER_CURRENT, norm_aq_components, norm_aq_station, norm_weather_current,
)

DELAY = "2 hours"
BATCH = "batch_id"


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process everything that has arrived into a Parquet folder, then read it."""
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything that has arrived, one callback per micro-batch."""
    query = (
        stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def write_batch(df: DataFrame, path: str, batch: int, fmt: str = "parquet", by: Sequence[str] = ()) -> None:
    """Write a batch to its own folder; a repeated batch replaces itself."""
    target = f"{path}/{BATCH}={batch}"
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*by).format(fmt).save(target)


REQUEST = ("request_city", S.TIME)
#: Providers in the order in which they are asked: weather, then air quality until one answers.
PROVIDERS = (WEATHER_CURRENT, AQ_STATION_CITY, AQ_STATION_GEO, AQ_COMPONENTS)
NORMALISED = {
    WEATHER_CURRENT: norm_weather_current,
    AQ_STATION_CITY: lambda raw: norm_aq_station(raw, AQ_STATION_CITY),
    AQ_STATION_GEO: lambda raw: norm_aq_station(raw, AQ_STATION_GEO),
    AQ_COMPONENTS: norm_aq_components,
}


def arrivals(payloads: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    """`request_city, time, rank, seq, problem, body` of each payload: the provider's rank and the standard columns as text, and the columns `kept`.

    Every provider's columns are made in one pass, from its own payloads alone.
    """
    rows = payloads.select(F.col("city").alias("request_city"), S.TIME, "provider", "seq", F.col("payload").alias("_raw"), *kept)
    problem, body = F.lit(None).cast("string"), F.lit(None).cast("string")
    for label, normalise in NORMALISED.items():
        mine = F.when(F.col("provider") == label, F.col("_raw")).alias("payload")
        done = normalise(rows.select("*", F.col("request_city").alias("city"), mine))
        standard = [c for c in done.columns if c not in (*rows.columns, "problem")]
        is_mine = F.col("provider") == label
        text = F.when(is_mine, F.to_json(F.struct(*standard))).otherwise(F.col("_body") if "_body" in rows.columns else body)
        why = F.when(is_mine, F.col("problem")).otherwise(F.col("_problem") if "_problem" in rows.columns else problem)
        same = [c for c in rows.columns if c not in ("_body", "_problem")]
        rows = done.select(*same, text.alias("_body"), why.alias("_problem"))
    known = F.array_position(F.array(*[F.lit(p) for p in PROVIDERS]), F.col("provider")) - 1
    return rows.withColumn("rank", known.cast("int")).filter(F.col("rank") >= 0).select(
        *REQUEST, "rank", "seq", F.col("_problem").alias("problem"), F.col("_body").alias("body"), *kept
    )


def _body_type(normalise: Callable[[DataFrame], DataFrame], spark: SparkSession) -> T.StructType:
    """Type of a provider's standard columns."""
    done = normalise(spark.createDataFrame([], f"city string, {S.TIME} timestamp, payload string"))
    return T.StructType([f for f in done.schema.fields if f.name not in (S.TIME, "problem")])


def _better(new: tuple[int, str | None, str | None], old: list | None) -> bool:
    """A usable answer beats a refused one, a later arrival an earlier one."""
    return old is None or ((new[1] is None, new[0]) >= (old[1] is None, old[0]))


def _verdict(got: dict[str, list]) -> tuple[str | None, str | None, str | None]:
    """(weather, air, problem) of what has arrived for an hour."""
    weather = got.get("0")
    if weather is None or weather[1] is not None:
        return None, None, f"{PROVIDERS[0]}: {weather[1] if weather else 'no answer'}"
    reasons = []
    for rank in range(1, len(PROVIDERS)):
        answer = got.get(str(rank))
        if answer is not None and answer[1] is None:
            return weather[2], answer[2], None
        reasons.append(f"{PROVIDERS[rank]}: {answer[1] if answer else 'no answer'}")
    return weather[2], None, " | ".join(reasons)


#: Hours of all cities are dealt to so many state keys by hash, so that one call of Python serves many hours.
#: Fixed, as the keys of a running job must not change.
STATE_KEYS = 4096


def settle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One row for an hour of a city: as soon as weather and city station have answered, or
    when the watermark has passed the hour, from the first provider that did.

    State holds [city, hour, due, done, answers] of each hour of the key that has not passed.
    """
    held = {(h[0], h[1]): h for h in json.loads(state.get[0])} if state.exists else {}
    passed, fresh, settled = state.getCurrentWatermarkMs(), set(), []
    for pdf in () if state.hasTimedOut else frames:
        for city, at, rank, seq, problem, body in zip(pdf["request_city"], pdf["at"], pdf["rank"], pdf["seq"], pdf["problem"], pdf["body"], strict=True):
            hour = (None if pd.isna(city) else str(city), int(at))
            answer = (int(seq), None if pd.isna(problem) else str(problem), None if pd.isna(body) else str(body))
            entry = held.setdefault(hour, [*hour, 0, False, {}])
            if not entry[3] and _better(answer, entry[4].get(str(rank))):
                entry[4][str(rank)] = list(answer)
            fresh.add(hour)
    for hour in fresh:
        entry = held[hour]
        entry[2] = max(hour[1] // 1000 + 1, passed + 1)
        answered = [entry[4].get(rank) for rank in ("0", "1")]
        if all(a is not None and a[1] is None for a in answered):
            settled.append((*hour, *_verdict(entry[4])))
            # Kept until the hour has passed, so that what still arrives for it adds no second row.
            entry[3:] = [True, {}]
    for hour in [h for h, entry in held.items() if entry[2] < passed]:
        _, _, _, done, got = held.pop(hour)
        if not done:
            settled.append((*hour, *_verdict(got)))
    if held:
        state.update((json.dumps(list(held.values())),))
        state.setTimeoutTimestamp(max(min(entry[2] for entry in held.values()), passed + 1))
    elif state.exists:
        state.remove()
    if settled:
        yield pd.DataFrame(settled, columns=["request_city", "at", "weather", "air", "problem"])


def settled_hours(payloads: DataFrame, delay: str = DELAY) -> DataFrame:
    """Stream of `request_city, at, weather, air, problem`, one row for each hour of a city.

    `payloads` has city, collection_timestamp, provider, payload and seq, the order of arrival.
    Hours wait in keyed state for their city station; the event-time timer of their key
    makes the fallback to the geographic station and to the components.
    """
    # Dealt to the tasks by key before they are parsed: a large file is not one task's work, and the state needs no second shuffle.
    at = F.unix_micros(S.TIME)
    keyed = payloads.filter(F.col(S.TIME).isNotNull()).withColumns({"at": at, "_key": F.pmod(F.xxhash64("city", at), F.lit(STATE_KEYS))})
    timed = arrivals(keyed.repartition("_key"), ("at", "_key")).withWatermark(S.TIME, delay)
    return timed.groupBy("_key").applyInPandasWithState(
        settle, "request_city string, at long, weather string, air string, problem string", "held string", "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def stream_ingest(payloads: DataFrame, out: str, checkpoint: str, delay: str = DELAY) -> None:
    """Payloads of four providers to valid, quarantine, bronze and audit tables.

    `payloads` is what `settled_hours` takes; the sides of an hour are paired by the place that was
    requested, since providers may name it differently.
    """
    spark = payloads.sparkSession
    sides = {"w": _body_type(norm_weather_current, spark), "a": _body_type(norm_aq_station, spark)}

    def each(batch: DataFrame, number: int) -> None:
        paired = batch.select(
            F.col("request_city"), F.timestamp_micros("at").alias(S.TIME), F.col("problem").alias("_problem"),
            F.from_json("weather", sides["w"]).withField(S.TIME, F.timestamp_micros("at")).alias("w"), F.from_json("air", sides["a"]).alias("a"),
        )
        merged = F.struct(*observation_of([S.TIME, *sides["w"].names])).alias("merged")
        whole = paired.select(*[F.col(k).alias(f"_{k}") for k in REQUEST], "_problem", F.col("w").alias("weather_raw"), F.col("a").alias("aqi_raw"), merged)
        checked = materialize(
            with_violations(whole.select("_request_city", f"_{S.TIME}", "_problem", "weather_raw", "aqi_raw", "merged.*"), F.current_timestamp()), "settled"
        )
        served = F.col("_problem").isNull()
        usable = F.size(VIOLATIONS) == 0
        write_batch(checked.filter(served & usable).select(*S.OBSERVATION_FIELDS), f"{out}/valid", number)
        write_batch(checked.filter(served & ~usable).select(*S.OBSERVATION_FIELDS, VIOLATIONS), f"{out}/quarantine", number)
        bronze = checked.filter(served & usable).select("weather_raw", "aqi_raw", F.struct(*S.OBSERVATION_FIELDS).alias("merged"))
        write_batch(bronze, f"{out}/bronze", number, "json")
        outcome = checked.select(
            F.col("_request_city").alias("city"), F.col(f"_{S.TIME}").alias(S.TIME), "weather_source", "aqi_source",
            F.coalesce("_problem", F.get(VIOLATIONS, F.lit(0))).alias("problem"),
        )
        write_batch(live_audit(outcome, F.current_timestamp()), f"{out}/audit", number)

    run_batches(settled_hours(payloads, delay), each, checkpoint)


def stream_dedup(stream: DataFrame, delay: str = DELAY) -> DataFrame:
    """One row per (city, hour) within the watermark."""
    return stream.withWatermark(S.TIME, delay).dropDuplicatesWithinWatermark(list(S.KEY))


def stream_merge(weather: DataFrame, aqi: DataFrame, delay: str = DELAY) -> DataFrame:
    """Inner join of the two streams on city and hour.

    Both sides are deduplicated first, so a key yields one row; the equal event
    times let the watermark drop old state.
    """
    left = stream_dedup(weather, delay)
    right = stream_dedup(aqi, delay)
    return merge_weather_aqi(left, right)


def stream_daily(stream: DataFrame, delay: str = DELAY) -> DataFrame:
    """Daily AQI per city, emitted once the watermark has passed the day."""
    day = F.window(S.TIME, "1 day")
    return (
        stream.withWatermark(S.TIME, delay)
        .groupBy("city", day)
        .agg(
            F.avg("aqi").alias("aqi"), F.max("aqi").alias("aqi_max"), F.min("aqi").alias("aqi_min"),
            F.count("aqi").alias("n"),
        )
        .filter(F.col("n") > 0)
        .select("city", F.col("window.start").alias(S.TIME), "aqi", "aqi_max", "aqi_min", "n")
    )


def stream_alerts(stream: DataFrame) -> DataFrame:
    """Rows at alert level with their band."""
    level = alert_level(F.col("aqi"))
    return stream.filter(level.isNotNull()).select(
        "city", S.TIME, "aqi", level.alias("alert"), aqi_category(F.col("aqi"), "colour").alias("colour")
    )


#: Rows that the longest lag looks back.
REACH = max(S.LAGS)
#: The newest rows of a city that a late or corrected row may still join; beside them state holds the REACH rows before.
OPEN_ROWS = 720
#: Rows of a city that are sorted in memory, rows read at a time of each sorted run, and rows whose features are made at once.
RUN_ROWS, READ_ROWS, DERIVED_ROWS = 100_000, 2_000, 10_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _derived(frame: pd.DataFrame) -> dict[str, np.ndarray]:
    """Change, lag and rolling columns of the rows of one city in time order."""
    out = {}
    for c in S.CHANGE_COLUMNS:
        if c in frame:
            x = frame[c].to_numpy(np.float64)
            lagged = {n: np.concatenate([np.full(min(n, len(x)), np.nan), x[: max(len(x) - n, 0)]]) for n in S.LAGS}
            out[f"{c}_change_rate"] = x - lagged[1]
            out |= {f"{c}_lag_{n}": values for n, values in lagged.items()}
    for label, rows in S.ROLLING_ROWS.items():
        for c in S.ROLLING_COLUMNS:
            if c in frame:
                x = np.concatenate([np.full(rows - 1, np.nan), frame[c].to_numpy(np.float64)])
                recent = np.lib.stride_tricks.sliding_window_view(x, rows)
                known = ~np.isnan(recent)
                n = known.sum(1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    mean = np.where(known, recent, 0).sum(1) / n
                    spread = (np.where(known, recent - mean[:, None], 0) ** 2).sum(1)
                    out[f"{c}_rolling_mean_{label}"] = mean
                    out[f"{c}_rolling_std_{label}"] = np.where(n > 1, np.sqrt(spread / (n - 1)), np.nan)
    return out


def _newest(frames: Sequence[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """Rows in order of time, the last by `by` of those of one time."""
    return pd.concat(list(frames)).sort_values(by, kind="stable").drop_duplicates(S.TIME, keep="last").reset_index(drop=True)


def _run_of(folder: str, number: int, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Write sorted rows, to be read a few at a time."""
    table = pa.Table.from_pandas(rows, preserve_index=False)
    path = f"{folder}/{number}.arrow"
    with pa.OSFile(path, "wb") as sink, pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table, READ_ROWS)

    def read() -> Iterator[pd.DataFrame]:
        with pa.OSFile(path) as source, pa.ipc.open_stream(source) as reader:
            for batch in reader:
                yield batch.to_pandas()

    return read()


def _merged(runs: Sequence[Iterator[pd.DataFrame]], by: list[str]) -> Iterator[pd.DataFrame]:
    """Runs, each in order of time and with one row a time, as one such run; of every run a few rows are held."""
    if len(runs) == 1:
        yield from runs[0]
        return
    held = {i: head for i, run in enumerate(runs) if (head := next(run, None)) is not None and len(head)}
    while held:
        # Every run has been read up to this time.
        upto = min(head[S.TIME].iloc[-1] for head in held.values())
        ready = []
        for i, head in list(held.items()):
            n = int(head[S.TIME].searchsorted(upto, side="right"))
            ready.append(head.iloc[:n])
            held[i] = head.iloc[n:]
            if n == len(head):
                following = next(runs[i], None)
                if following is None:
                    del held[i]
                else:
                    held[i] = following
        yield _newest(ready, by)


class RecentRows(StatefulProcessor):
    """The newest rows of each city, as one Arrow table, and the features that new rows change.

    A batch may bring any number of rows of a city: they are sorted in runs on disk and merged, and
    features are made of a few thousand rows at a time.
    """

    def __init__(self, columns: list[str], order: str, open_rows: int) -> None:
        self.columns, self.order, self.open_rows = columns, order, open_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        # `cut` tells that older rows have left the state.
        self.held = handle.getValueState("held", "rows binary, version long, cut boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.held.get()
        old, version, cut = (pa.ipc.open_stream(held[0]).read_pandas(), held[1] + 1, held[2]) if held else (None, 1, False)
        oldest = old[S.TIME].iloc[REACH] if cut else None
        with tempfile.TemporaryDirectory(prefix="recent-") as folder:
            late, new = [], []
            for run in self.sorted_runs(rows):
                if cut:
                    late.append(_run_of(folder, 2 * len(late), run[run[S.TIME] < oldest]))
                    run = run[run[S.TIME] >= oldest]
                new.append(_run_of(folder, 2 * len(new) + 1, run))
            arrived = (frame.assign(_new=True) for frame in _merged(new, [S.TIME, self.order]))
            both = arrived if old is None else _merged([iter([old.assign(_new=False)]), arrived], [S.TIME, "_new"])
            kept, seen = None, 0
            for frame, fresh in self.changed(both):
                seen += len(frame)
                kept = frame if kept is None else pd.concat([kept, frame])
                kept = kept.iloc[-(REACH + self.open_rows) :]
                if len(fresh):
                    yield fresh.assign(version=version, late=False).reindex(columns=self.columns)
            for frame in _merged(late, [S.TIME, self.order]) if late else ():
                if len(frame):
                    yield frame.assign(version=version, late=True).reindex(columns=self.columns)
        sink = pa.BufferOutputStream()
        table = pa.Table.from_pandas(kept, preserve_index=False)
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        self.held.update((sink.getvalue().to_pybytes(), version, cut or len(kept) < seen))

    def sorted_runs(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What arrived, some rows at a time, each run in order of time and with one row a time."""
        by, some = [S.TIME, self.order], []
        for frame in frames:
            some.append(frame)
            if sum(map(len, some)) >= RUN_ROWS:
                yield _newest(some, by)
                some = []
        if some:
            yield _newest(some, by)

    def changed(self, both: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
        """Rows in order of time, some at a time, and those of them that a new row reaches, with their features."""
        before, waiting = None, []

        def made() -> tuple[pd.DataFrame, pd.DataFrame]:
            nonlocal before
            start = 0 if before is None else len(before)
            whole = pd.concat(([] if before is None else [before]) + waiting).reset_index(drop=True)
            reached = np.zeros(len(whole) + REACH + 1, bool)
            for at in np.flatnonzero(whole["_new"]):
                reached[at : at + REACH + 1] = True
            reached = reached[: len(whole)]
            reached[:start] = False
            plain = whole.drop(columns="_new")
            before = whole.iloc[-REACH:]
            return plain.iloc[start:], plain.assign(**_derived(plain))[reached]

        for frame in both:
            waiting.append(frame)
            if sum(map(len, waiting)) >= DERIVED_ROWS:
                yield made()
                waiting = []
        if waiting:
            yield made()

    def close(self) -> None:
        pass


def stream_features(observations: DataFrame, out: str, checkpoint: str, order: str = "ingest_seq", open_rows: int = OPEN_ROWS) -> None:
    """Series features of arriving rows, as versions in `out`, from keyed state alone.

    State holds the newest rows of each city. A new row is put among them by time, replaces
    one of the same time, and rewrites itself and the rows whose windows hold it, REACH at
    most. A row older than the newest `open_rows` of its city, once older ones have left the
    state, changes nothing: it comes out as it is, marked `late`, for a batch
    run over the stored observations. Of rows of one time in one batch the greatest `order` counts. A
    batch's rows of one city go through one task, which sorts them on disk and holds a part of them.
    """
    spark = observations.sparkSession
    # Keyed state of this kind needs this store; other streams of the session can use it too.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    empty = spark.createDataFrame([], observations.schema)
    schema = series_features(empty, horizon=None).schema.add("version", "long").add("late", "boolean")
    changed = observations.filter(F.col(S.TIME).isNotNull()).groupBy("city").transformWithStateInPandas(
        RecentRows(schema.names, order, open_rows), schema, "append", "none"
    )
    run_available(changed, out, checkpoint)


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of every row written by `stream_features`."""
    rows = spark.read.parquet(path).filter(~F.col("late"))
    return keep_last(rows, S.KEY, "version").drop("version", "late")


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """Observations that came too late for `stream_features` to place them."""
    rows = spark.read.parquet(path).filter("late")
    derived = {f"{c}_change_rate" for c in S.CHANGE_COLUMNS} | {f"{c}_lag_{n}" for c in S.CHANGE_COLUMNS for n in S.LAGS}
    derived |= {f"{c}_rolling_{stat}_{label}" for c in S.ROLLING_COLUMNS for stat in ("mean", "std") for label in S.ROLLING_ROWS}
    return rows.drop("version", "late", *derived)
