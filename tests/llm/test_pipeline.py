"""The pipeline's stages on a small table with every kind of document."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from hazeline.llm.queries import QUERIES


@pytest.fixture(scope="module")
def docs(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    first = docs.orderBy("doc_id").first()
    odd = spark.createDataFrame(
        [(10_000, None, "en", "s", 0), (10_001, "", "en", "s", 0), (10_002, "12 34 !!", None, "s", 8), (10_003, first["text"], "en", "s", first["n_chars"])],
        docs.schema,
    )
    return docs.unionByName(odd).withColumn("component_id", F.lit("x"))


def test_language_stage_drops_what_is_in_no_language(spark, docs, small):
    out = pipeline.language(spark, docs, small)
    assert out.columns == pipeline.COLUMNS
    kept = {r["doc_id"] for r in out.collect()}
    assert not kept & {10_000, 10_001, 10_002}
    lettered = {r["doc_id"] for r in docs.where(F.col("text").rlike(r"\p{L}")).collect()}
    assert kept == lettered


def test_line_stage_keeps_one_of_each_line(spark, docs, small):
    out = pipeline.line_dedup(spark, docs.where("text is not null"), small)
    assert out.columns == pipeline.COLUMNS
    rows = {r["doc_id"]: r for r in out.collect()}
    # Of the copy only lines too short to take part are left.
    assert 10_003 not in rows or all(len(line.split()) < 12 for line in rows[10_003]["text"].split("\n"))
    assert all(r["n_chars"] == len(r["text"]) for r in rows.values())
    lines = [line for r in rows.values() for line in r["text"].split("\n") if len(line.split()) >= 12]
    assert len(lines) == len(set(lines))


def test_near_duplicate_stage_keeps_one_of_each_group(spark, docs, small):
    repeated = docs.unionByName(docs.where("doc_id = 3"))
    out = pipeline.near_dedup(spark, repeated, small)
    ids = [r["doc_id"] for r in out.collect()]
    assert out.columns == pipeline.COLUMNS and len(ids) == len(set(ids)) and 10_003 not in ids
    assert {10_000, 10_001} <= set(ids)


def test_personal_data_stage_masks_and_keeps_every_document(spark, docs, small):
    extra = docs.limit(1).withColumns({"doc_id": F.lit(7).cast("long"), "text": F.lit("mail a@b.example or 4111111111111111 é")})
    rows = pipeline.personal_data(spark, docs.where("doc_id <> 7").unionByName(extra), small).collect()
    assert len(rows) == docs.where("doc_id <> 7").count() + 1
    mine = next(r for r in rows if r["doc_id"] == 7)
    assert mine["text"] == "mail <email> or <card> é" and mine["n_chars"] == 24


def test_run_packs_what_the_stages_keep(spark, tmp_path):
    rng = random.Random(1)
    words = {"en": ["the", "and", "with", "house", "river"], "fr": ["le", "avec", "maison", "être", "où"]}
    rows = [(i, "\n".join(" ".join(rng.choices(words[lang], k=12)) for _ in range(4)), lang, "s", 0) for i in range(40) for lang in [("en", "fr")[i % 2]]]
    rows += [(100 + i, rows[i][1], rows[i][2], "s", 0) for i in range(5)] + [(200, None, None, None, None), (201, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == set(range(40))
    assert sum(r["length"] for r in out) > 0


def test_every_query_is_registered_once():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= names
    assert len(pipeline.STAGES) == 5
