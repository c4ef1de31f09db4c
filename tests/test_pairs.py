"""Best matches and similarities by blocks against those by joins."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F
from test_weighing import corpus

from quillgraph.operators import lexical as x
from quillgraph.operators import pairs as p
from quillgraph.plans import ORACLE, QUERIES
from quillgraph.sources.scratch import materialize


@pytest.mark.parametrize("most,documents,queries,frequent", [(5, 7, 4, 4), (300, 2048, 512, 16), (1, 3, 100, 1000)])
def test_best_by_blocks(spark, monkeypatch, most, documents, queries, frequent):
    for name, value in (("QUERIES", queries), ("FREQUENT", frequent), ("PRODUCTS", 50)):
        monkeypatch.setattr(p, name, value)
    rows = corpus(spark)
    rows = rows.union(rows.where("doc_key in ('k3', 'k4')").withColumn("doc_key", F.concat("doc_key", F.lit("copy"))))
    counted = x.counts_by_document(rows)
    signature = materialize(x.signatures(x.weights(rows, counted)))
    found = materialize(x.candidates(x.query_terms(signature), signature, most))
    fields = x.field_vectors(counted, x.document_frequencies(counted), x.field_averages(rows, counted))
    like = {(r["query"], r.doc_key): round(r.similarity, 9) for r in x.similarities(found, fields, signature).collect()}
    want = {(r["query"], r.doc_key): (round(r.score, 9), like[r["query"], r.doc_key]) for r in found.collect()}
    blocks = materialize(p.in_blocks(p.vectors(rows), documents))
    got = {(r["query"], r.doc_key): (round(r.score, 9), round(r.similarity, 9)) for r in p.best(blocks, None, most).collect()}
    assert got == want and len(got) > 50
    some = spark.createDataFrame([("k3",), ("k1",), ("bare",)], "doc_key string")
    assert {(r["query"], r.doc_key) for r in p.best(blocks, some, most).collect()} == {k for k in want if k[0] in ("k3", "k1")}
    assert p.best(materialize(p.in_blocks(p.vectors(rows.limit(0)), documents)), None, most).count() == 0


def test_similarity_is_of_all_documents(spark, sf_dir):
    assert not re.search(r"doc_id % 100", ORACLE["similarity"])
    asked = {r[0] for r in QUERIES["similarity"](spark, sf_dir).select("query").distinct().collect()}
    assert len(asked) > 0.5 * spark.read.parquet(f"{sf_dir}/documents.parquet").count()
