"""Weights by cuts against those by joins, and what they leave on disk."""

from __future__ import annotations

import math
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import epochs as e
from quillgraph.operators import lexical as x
from quillgraph.operators import weighing as w
from quillgraph.plans import QUERIES
from quillgraph.sources.scratch import materialize

SCHEMA = "doc_key string, title string, abstract string, body string"


def shuffled(spark) -> int:
    return sum(f.stat().st_size for f in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data"))


def settled(spark, most: int) -> int:
    for _ in range(40):
        if shuffled(spark) <= most:
            break
        time.sleep(0.25)
    return shuffled(spark)


def corpus(spark, n=60, seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["the", "7", "x", "Graph", "naïve", "機械"]
    text = lambda m: rng.choice([" ", ", ", " - "]).join(rng.choice(words) for _ in range(rng.randrange(m)))
    rows = [(f"k{i}", text(6), text(20), text(60)) for i in range(n)]
    rows += [("k1", "graph graph", "w1", "w2 w3"), (None, "w1 w2", "", "w3"), ("bare", "", "", ""), ("none", None, None, None), ("long", "", "", text(4000) + " tail")]
    return spark.createDataFrame(rows, SCHEMA)


def by(rows):
    return {(r.doc_key, r.feature): (r.weight, r.in_title) for r in rows.collect()}


def same(got, want):
    assert got.keys() == want.keys() and len(got) > 100
    assert all(math.isclose(got[k][0], want[k][0], rel_tol=1e-9) and got[k][1] == want[k][1] for k in want)


@pytest.mark.parametrize("cut", [300, 4_000_000])
def test_weights_and_signatures_by_cuts(spark, monkeypatch, cut):
    monkeypatch.setattr(w, "CUT", cut)
    rows = corpus(spark)
    counted = x.counts_by_document(rows)
    weighed = materialize(x.weights(rows, counted))
    same(by(x.flat(w.signatures(rows, 3, 20))), by(x.normalised(x.picked(weighed, 3, 20))))
    want = {r.doc_key: (r.n, r.total, r.top) for r in weighed.groupBy("doc_key").agg(F.count("*").alias("n"), F.sum("weight").alias("total"), F.max("weight").alias("top")).collect()}
    got = {r.doc_key: (r.features, r.total, r.top) for r in w.totals(rows).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert w.totals(rows.limit(0)).count() == 0
    c = w.Corpus(rows)
    assert {r.feature: r.df for r in c.frequencies().collect()} == {r.feature: r.df for r in x.document_frequencies(counted).collect()}


def test_an_epoch_by_cuts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(w, "CUT", 400)
    rows, rule = corpus(spark), "doc_key is null or doc_key not like 'k1%'"
    old = rows.where(rule)
    c = w.Corpus(rows, rule)
    blocks = materialize(c.blocks())
    one, two = e.Epochs(spark, f"file://{tmp_path}/a"), e.Epochs(spark, f"file://{tmp_path}/b")
    now = one.rebuild(old, w.Statistics(c, blocks), lambda: 1)
    want = two.rebuild(old, x.counts(old), lambda: 1)
    assert now.n_docs == want.n_docs and now.averages.first() == want.averages.first()
    assert sorted(now.frequencies.collect()) == sorted(want.frequencies.collect())
    sums = {r.doc_key: r.total for r in e.weights(x.counts_by_document(rows), want).groupBy("doc_key").agg(F.sum("weight").alias("total")).collect()}
    assert {r.doc_key: r.total for r in e.totals(c, blocks, now).collect()} == pytest.approx(sums)


def test_nothing_shuffled_for_a_written_table_is_left(spark):
    materialize(spark.range(10)).count()
    before = settled(spark, 0)
    rows = materialize(spark.range(200_000).groupBy(F.col("id") % 100_000).count())
    assert settled(spark, before) <= before and rows.count() == 100_000


@pytest.mark.parametrize("name", ["signature", "bm25f_weights"])
def test_weights_shuffle_little_beside_their_texts(spark, sf_dir, name):
    chars = spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.sum(F.length("text"))).first()[0]
    before = shuffled(spark)
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - before < 2 * chars
