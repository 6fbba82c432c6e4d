"""One query for each operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.llm import audit, bpe, langid, licences, lines, middle, minhash, neighbours, packing, pii, quality, suffixes, threshold
from hazeline.llm.oracles import ORACLES

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train(docs, "doc_id", "text", "lang")
    held_out = F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    return langid.label(docs, "text", model, ["doc_id"]).select("doc_id", held_out, "lang_pred", "score", "n_words", F.size("runs").alias("n_runs"))


@query
def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(documents(spark, sf_dir), "doc_id", "text", VOCABULARY, decoded=True)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.deduplicate(documents(spark, sf_dir), "doc_id", "text", short=True)
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query
def op4_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), "doc_id", "text", size=3, percent=85)


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeats(documents(spark, sf_dir), "doc_id", "text", length=400)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op6_block_matrix_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours.search(vectors, "vec_id", "embedding", vectors.where("vec_id % 100 = 0"), k=10)


@query
def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir), "doc_id", "text")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op8_large_item_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), "doc_id", "text", VOCABULARY, capacity=2048)


@query
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(documents(spark, sf_dir), "text")
    spans = F.col("spans")
    counts = [pii.count_kind(spans, kind).alias(f"n_{kind}") for kind in pii.BASE]
    base = F.sha2(pii.digest(F.filter(spans, pii.is_base)), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), pii.digest(spans).alias("spans"))


@query
def op10_licence_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(documents(spark, sf_dir), "doc_id", "text")
    return found.select("doc_id", "licence", "score", "n_matches", F.col("matches.licence").alias("licences"), F.col("matches.first_line").alias("first_lines"))


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return audit.audit(documents(spark, sf_dir), labels, "doc_id", "text", "source")


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.fill_in_middle(documents(spark, sf_dir), "doc_id", "text")
    back = middle.restore(made, "output", "form")
    digests = [F.sha2(F.col(c), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


@query
def op13_threshold_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return threshold.search(vectors, "vec_id", "embedding", vectors.where("vec_id % 50 = 0"), k=5, scale=256)


__all__ = ["ORACLES", "QUERIES"]
