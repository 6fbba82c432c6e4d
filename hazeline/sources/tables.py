"""Reading and writing observation, feature and prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline import schemas as S
from hazeline.functions.calendar import city_slug, to_utc
from hazeline.functions.indices import nan_to_null
from hazeline.operators.ordered import keep_last
from hazeline.session import materialize


def scan_observations(spark: SparkSession, path: str, schema: T.StructType = S.OBSERVATIONS) -> DataFrame:
    """Observation CSV with parsed UTC time; rows without a usable time are dropped.

    `ingest_seq` orders the rows as they were appended: by file time, file,
    position of the block in the file and row. Files may differ in their columns
    and the order of them: each is read by its own header. An empty input and a
    header without the key columns are errors.
    """
    known = {f.name: f for f in schema.fields}
    lines = None
    for header, files in files_by_header(spark, path).items():
        absent = [c for c in S.KEY if c not in header]
        if absent:
            raise ValueError(f"missing columns: {absent}")
        fields = T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in header])
        part = spark.read.schema(fields).option("header", True).csv(files).select("*", "_metadata")
        lines = part if lines is None else lines.unionByName(part, allowMissingColumns=True)
    if lines is None or lines.isEmpty():
        raise ValueError(f"input is empty: {path}")
    appended = F.struct(
        "_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start",
        F.monotonically_increasing_id().alias("row"),
    )
    rows = nan_to_null(lines.select("*", appended.alias("ingest_seq")).drop("_metadata"))
    return rows.withColumn(S.TIME, to_utc(F.col(S.TIME))).filter(F.col(S.TIME).isNotNull())


def files_by_header(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """CSV files below `path` by their columns; one short row per file and layout."""
    first = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start").where("file_block_start = 0")
    row = F.monotonically_increasing_id()
    heads = first.withColumn("row", row).groupBy("file_path").agg(F.min_by("value", "row").alias("head"))
    found: dict[tuple[str, ...], list[str]] = {}
    for head, files in sorted((r["head"], r["files"]) for r in heads.groupBy("head").agg(F.sort_array(F.collect_list("file_path")).alias("files")).collect()):
        columns = tuple(spark.read.option("header", True).csv(files[0]).columns)
        found.setdefault(columns, []).extend(files)
    return found


def scan_csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with every value as text."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def scan_features(spark: SparkSession, source: str, location: str) -> DataFrame:
    """Feature table by source name: a `local` CSV, a `store` folder or a `table`."""
    if source == "local":
        rows = spark.read.option("header", True).csv(location)
        text = {*S.TEXT_FIELDS} - {S.TIME}
        typed = [
            to_utc(F.col(c)).alias(c) if c == S.TIME
            else F.col(c) if c in text
            else F.col(c).try_cast("double").alias(c)
            for c in rows.columns
        ]
        return nan_to_null(rows.select(*typed))
    if source == "store":
        return feature_table_read(spark, location)
    if source == "table":
        return spark.table(location)
    raise ValueError(f"unknown feature source: {source}")


def sink_append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append rows; an empty batch or a different column set is an error."""
    if df.isEmpty():
        raise ValueError("nothing to append")
    stored = read_stored(df.sparkSession, path, fmt)
    if stored is not None:
        odd = set(stored.columns) ^ set(df.columns)
        if odd:
            raise ValueError(f"column sets differ: {sorted(odd)}")
        df = df.select(*stored.columns)
    df.write.mode("append").option("header", True).format(fmt).save(path)


def read_stored(spark: SparkSession, path: str, fmt: str) -> DataFrame | None:
    """The table at `path`, or None when nothing is stored there yet."""
    try:
        return spark.read.option("header", True).format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def scan_json_docs(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One JSON document per file with its `file_name`; corrupt files are skipped."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    with_corrupt = T.StructType([*kind.fields, T.StructField("_corrupt_record", T.StringType())])
    docs = spark.read.schema(with_corrupt).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    named = docs.withColumn("file_name", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return named.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def sink_bronze_json(records: DataFrame, path: str) -> None:
    """Raw and merged records as JSON under city and date folders."""
    placed = records.withColumns({"city_slug": city_slug(F.col("city")), "date": F.to_date(S.TIME)})
    placed.hint("rebalance", "city_slug", "date").write.mode("append").partitionBy("city_slug", "date").json(path)


def feature_table_prepare(df: DataFrame) -> DataFrame:
    """Strict UTC time without a zone, redundant `timestamp` dropped.

    A missing time column and a value that is no timestamp are errors.
    """
    if S.TIME not in df.columns:
        raise ValueError(f"missing column: {S.TIME}")
    strict = F.col(S.TIME).cast("timestamp").cast("timestamp_ntz")
    return df.withColumn(S.TIME, strict).drop("timestamp")


def feature_table_upsert(df: DataFrame, path: str, order: str, keys: Sequence[str] = S.KEY) -> None:
    """Insert or replace rows by key in a table partitioned by date.

    Only the dates of the new rows are read and rewritten. The merged rows are
    staged first, so a failed write leaves the table readable and repeatable.
    """
    new = df.withColumn("date", F.to_date(S.TIME))
    merged = new.withColumn("_new", F.lit(1))
    stored = read_stored(df.sparkSession, path, "parquet")
    if stored is not None:
        touched = stored.withColumn("_new", F.lit(0)).join(new.select("date").distinct(), "date", "left_semi")
        merged = touched.unionByName(merged, allowMissingColumns=True)
    latest = keep_last(merged, list(keys), ["_new", order]).drop("_new")
    staged = materialize(latest, "upsert")
    staged.hint("rebalance", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "date"
    ).parquet(path)


def feature_table_read(spark: SparkSession, path: str, expected_rows: int | None = None) -> DataFrame:
    """The stored feature table; a wrong row count is an error."""
    rows = spark.read.parquet(path).drop("date")
    if expected_rows is not None:
        found = rows.count()
        if found != expected_rows:
            raise ValueError(f"expected {expected_rows} rows, found {found}")
    return rows


def sink_predictions(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Scored rows with the forecast column `aqi_forecast_72h`."""
    named = df.withColumnRenamed("prediction", "aqi_forecast_72h")
    named.write.mode("overwrite").option("header", True).format(fmt).save(path)
