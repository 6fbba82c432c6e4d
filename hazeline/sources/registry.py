"""The model registry: run folders with artifacts and metadata documents."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Run naming.
RUN_PREFIXES = ("ridge_3day_dailyavg_v5", "ridge_3day_dailyavg_v6")
RUN_STAMP = r"_(\d{8}T\d{6}Z)$"

METRICS = "struct<rmse:double,mae:double,r2:double>"
RUN_SCHEMA = (
    f"map<string,struct<version:string,n_days:int,alpha:double,feature_cols:array<string>,n_train:bigint,"
    f"n_test:bigint,target:string,naive_baseline:{METRICS},test_metrics:{METRICS}>>"
)


def run_name(prefix: str, at: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"))


def model_save(spark: SparkSession, registry: str, run: str, models: Mapping[str, PipelineModel],
               metadata: Mapping[str, Mapping]) -> str:
    """Store a run: one pipeline model per label and one metadata document."""
    folder = f"{registry}/{run}"
    for label, model in models.items():
        model.write().overwrite().save(f"{folder}/{label}_model")
    document = spark.createDataFrame([(json.dumps(metadata),)], "value string")
    document.coalesce(1).write.mode("overwrite").text(f"{folder}/metadata.json")
    return folder


def save_coefficients(coefficients: DataFrame, registry: str, run: str) -> str:
    """Store a run of per-city linear models as one table."""
    path = f"{registry}/{run}/coefficients"
    coefficients.write.mode("overwrite").parquet(path)
    return path


def registry_documents(spark: SparkSession, registry: str) -> DataFrame:
    """(run, document text) of every run folder with metadata."""
    docs = spark.read.option("wholetext", True).text(f"{registry}/*/metadata.json")
    run = F.element_at(F.split(F.input_file_name(), "/"), -3)
    return docs.select(run.alias("run"), F.col("value").alias("document"))


def load_coefficients(spark: SparkSession, registry: str, run: str) -> DataFrame:
    return spark.read.parquet(f"{registry}/{run}/coefficients")


def run_document(spark: SparkSession, registry: str, run: str) -> dict[str, dict]:
    """The metadata document of a run; none is an error."""
    docs = registry_documents(spark, registry).filter(F.col("run") == run).head()
    if docs is None:
        raise ValueError(f"run '{run}' has no metadata")
    return json.loads(docs["document"])


def model_load(spark: SparkSession, registry: str, run: str) -> tuple[dict[str, PipelineModel], dict[str, dict]]:
    """Models and metadata of a run; a missing part is an error.

    Metadata without a feature list takes the one of the model's assembler.
    """
    metadata = run_document(spark, registry, run)
    models = {label: PipelineModel.load(f"{registry}/{run}/{label}_model") for label in metadata}
    for label, model in models.items():
        if not metadata[label].get("feature_cols"):
            metadata[label]["feature_cols"] = list(model.stages[0].getInputCols())
    return models, metadata


def registry_scan(documents: DataFrame) -> DataFrame:
    """Nested run metadata to one row per (run, horizon).

    A document that is no JSON object gives no rows.
    """
    parsed = documents.select("run", F.explode(F.from_json("document", RUN_SCHEMA)).alias("horizon", "m"))
    rmse = F.coalesce(F.col("m.test_metrics.rmse"), F.lit(float("inf")))
    naive = F.coalesce(F.col("m.naive_baseline.rmse"), F.lit(float("inf")))
    return parsed.select(
        "run", "horizon", F.col("m.target").alias("target"),
        F.greatest(F.size("m.feature_cols"), F.lit(0)).alias("features"),
        F.col("m.test_metrics.rmse").alias("rmse"), F.col("m.test_metrics.mae").alias("mae"),
        F.col("m.test_metrics.r2").alias("r2"), (rmse < naive).alias("beats_baseline"),
    )


def registry_latest(runs: DataFrame) -> DataFrame:
    """(by_stamp, by_name): newest run by its trailing timestamp, its name
    standing in when it has none, and the greatest name with a daily prefix."""
    stamp = F.regexp_extract("run", RUN_STAMP, 1)
    recency = F.when(stamp == "", F.col("run")).otherwise(stamp)
    daily = F.lit(False)
    for prefix in RUN_PREFIXES:
        daily = daily | F.startswith(F.col("run"), F.lit(prefix))
    return runs.agg(
        F.max_by("run", F.struct(recency.alias("at"), "run")).alias("by_stamp"),
        F.max(F.when(daily, F.col("run"))).alias("by_name"),
    )
