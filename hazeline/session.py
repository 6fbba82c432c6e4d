"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_named_scratch: dict[str, str] = {}


def build_session(app: str = "hazeline", **extra: str) -> SparkSession:
    """A session with the engine's settings; `extra` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> SparkSession:
    """All timestamps in the engine are UTC instants."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def use_scratch(spark: SparkSession, folder: Callable[[], str]) -> None:
    """Name the folder for intermediate tables of a session that sets no
    spark.checkpoint.dir; the first name given to an application stays."""
    app = spark.sparkContext.applicationId
    if not _configured(spark) and app not in _named_scratch:
        _named_scratch[app] = folder()


def _configured(spark: SparkSession) -> str | None:
    return spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)


def scratch_dir(spark: SparkSession) -> str:
    """The folder the cluster shares for intermediate tables: `spark.checkpoint.dir`,
    or the one that the caller named with `use_scratch`."""
    shared = _configured(spark) or _named_scratch.get(spark.sparkContext.applicationId)
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return shared


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the application's own folder, which a retention job may
    drop once the application has ended."""
    return f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write `df` to the shared folder and read it back.

    The result no longer depends on the plan that made it, so a lost executor
    costs a re-read, and values such as partition ids stay as they were
    written.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go when the action that made them ends, not when the driver
    collects its garbage. For steps that write what they read again."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)
