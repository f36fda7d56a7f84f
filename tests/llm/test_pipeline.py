"""Stages on the small table, and the registration of the queries."""

from __future__ import annotations

import re

import corpus_pipeline
from millwatch.llm import oracle, queries
from millwatch.llm.common import table


def test_stages_take_effect(spark, small):
    docs = table(spark, small, "documents")
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, small)
        docs.write.mode("overwrite").parquet(path := f"{spark.sparkContext.getCheckpointDir() or '/tmp'}/stage_{name}")
        docs = spark.read.parquet(path)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    sizes = [seen[n].count() for n in ("toxicity", "quality", "near_copies", "passages")]
    assert sizes[0] >= sizes[1] >= sizes[2] == sizes[3] > 0
    packed = seen["packing"].groupBy("doc_id").sum("length").collect()
    words = {r.doc_id: len(re.findall("[^\x20\x09-\x0D]+", r.text or "")) + 1 for r in seen["passages"].collect()}
    assert {r.doc_id: r["sum(length)"] for r in packed} == words


def test_every_operator_has_a_query():
    names = list(queries.queries())
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 14))
    assert set(oracle.oracle_sql()) <= set(names)
