from __future__ import annotations

import importlib
from collections import Counter

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('sf')}"
    docs = corpus[0].withColumn("text", F.when(F.col("doc_id") == 30, F.concat("text", F.lit(" password = hunter2hunter2"))).otherwise(F.col("text")))
    docs = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    bad = docs.limit(150).select((F.col("doc_id") + 10_000).alias("doc_id"), F.regexp_replace("text", " ", "*** ").alias("text"), "lang", "source", "n_chars")
    docs.unionByName(bad).write.parquet(f"{at}/documents.parquet")
    docs.unionByName(bad).select("doc_id", (F.col("doc_id") < 10_000).cast("int").alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = before = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"file://{tmp_path}/{name}")
        docs = seen[name] = spark.read.parquet(f"file://{tmp_path}/{name}")
        if name != "best_fit_packing":
            assert docs.columns == before.columns
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    n = {k: v.count() for k, v in seen.items()}
    assert n["quality_classifier"] < before.count() and n["exact_copies"] < n["quality_classifier"] and n["near_copies"] < n["exact_copies"] and n["secret_scan"] == n["near_copies"]
    masked = seen["secret_scan"].where("text like '%[secret]%'").collect()
    assert [r["doc_id"] for r in masked] == [30] and masked[0]["n_chars"] == len(masked[0]["text"]) and "hunter" not in masked[0]["text"]
    assert {r["doc_id"] for r in seen["best_fit_packing"].select("doc_id").collect()} == {r["doc_id"] for r in seen["secret_scan"].select("doc_id").collect()}
    run = pipeline.run(spark, folder)
    assert run.select("doc_id", "piece", "ids_crc32").exceptAll(docs.select("doc_id", "piece", "ids_crc32")).count() == 0 and run.count() == n["best_fit_packing"]


def test_stages_on_an_empty_table(spark, folder):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).count() == 0
    assert pipeline.STAGES[-1][1](spark, docs, folder).count() == 0


def test_registered():
    from furrow.llm.queries import oracle_sql, queries

    assert {int(k[2:].split("_")[0]) for k in queries()} == {*range(1, 14)}
    assert {*oracle_sql()} <= {*queries()}


def test_stages_on_odd_rows(spark, folder, odd):
    """Nulls in any column, empty and very long texts, repeated rows and clashing columns: each stage keeps the columns and makes nothing up."""
    pipeline = importlib.import_module("corpus_pipeline")
    key = lambda df, *skip: Counter(tuple(r[c] for c in df.columns if c not in skip) for r in df.collect())
    given, seen = key(odd), {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, odd, folder)
        assert out.columns == odd.columns
        seen[name] = key(out, *(["text", "n_chars"] if name == "secret_scan" else []))
        whole = key(odd, "text", "n_chars") if name == "secret_scan" else given
        assert not seen[name] - whole
    assert sum(seen["secret_scan"].values()) == sum(given.values())
    texts = {" ".join((r[1] or "").split()) for r in given}
    assert len(seen["exact_copies"]) == sum(seen["exact_copies"].values()) <= len(texts) + 1
    ids = {r[0] for r in seen["near_copies"]}
    assert {4, 5, 6, 7, 12, 13, -5} <= ids and 8 not in ids and 2 not in ids
    packed = pipeline.STAGES[-1][1](spark, odd, folder).select("doc_id").distinct().collect()
    assert {r["doc_id"] for r in packed} == {r[0] for r in given}


def test_quality_stage_without_labels(spark, folder, odd):
    from furrow.llm import mil

    labels = spark.read.parquet(f"{folder}/labels.parquet").limit(0)
    assert mil.keep_good(odd, labels).count() == odd.count()
