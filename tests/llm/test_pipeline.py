from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline as C
from tideline.llm.queries import QUERIES


def test_queries_are_registered():
    names = set(E.queries())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} and {*QUERIES, "pipeline"} <= names


def test_every_stage_keeps_the_columns(spark, small):
    docs = small.withColumns({c: F.lit(i) for i, c in enumerate(["mark", "digest", "row", "kept", "dropped", "own_mark", "u", "gram"])})
    counts = [docs.count()]
    for name, stage in C.STAGES:
        after = stage(spark, docs, "")
        if name != C.STAGES[-1][0]:
            assert after.columns == docs.columns
        docs = after.cache()
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] >= counts[4] > 0.8 * counts[0]
    used = docs.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert used.filter("n > 1024").isEmpty()


def test_clean_documents_stay_and_rejects_go(spark, small):
    rows = small.filter("lang is not null").limit(60).select("doc_id", "text", "lang", "source", "n_chars")
    junk = spark.createDataFrame([(9001, "123 456 789", None, "s", 11), (9002, None, None, "s", 0)], rows.schema)
    kept = {r["doc_id"] for r in C.language(spark, rows.unionByName(junk), "").collect()}
    assert kept == {r["doc_id"] for r in rows.collect()}


@pytest.mark.parametrize("given", ["odd", "empty"])
def test_stages_on_odd_tables(spark, request, given):
    docs = request.getfixturevalue(given)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, "").cache()
        docs.count()
