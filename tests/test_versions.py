"""Published versions, bucketed tables, and frozen statistics."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import epochs as e
from quillgraph.operators import lexical as x
from quillgraph.sources.versions import BucketedTable, Conflict, Versions


def test_one_of_two_writers(spark, tmp_path):
    a, b = Versions(spark, f"file://{tmp_path}/t"), Versions(spark, f"file://{tmp_path}/t")
    assert a.latest() == (0, {})
    a.publish(1, {"x": "é"})
    with pytest.raises(Conflict):
        b.publish(1, {"x": 2})
    assert b.latest() == (1, {"x": "é"})
    b.publish(2, {"x": 2})
    assert a.latest() == (2, {"x": 2})
    assert sorted(p.name for p in (tmp_path / "t/commits").iterdir() if not p.name.startswith(".")) == ["000000000001", "000000000002"]


def content(table):
    return {r.k: r.v for r in table.rows().collect()}


def test_upsert_writes_touched_buckets(spark, tmp_path):
    t = BucketedTable(spark, f"file://{tmp_path}/t", "k", 16)
    with pytest.raises(FileNotFoundError):
        t.rows()
    first = spark.range(200).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    assert t.upsert(first) == 16
    new = spark.createDataFrame([(3, "new"), (500, "new")], "k long, v string")
    touched = t.upsert(new, spark.createDataFrame([(7,), (900,)], "k long"))
    assert 1 <= touched <= 4
    assert content(t) == {k: "old" for k in range(200) if k not in (3, 7)} | {3: "new", 500: "new"}
    before, after = (set(t.versions.content(n)["buckets"].items()) for n in (1, 2))
    assert len(after - before) <= touched and len(before & after) == 16 - touched
    assert {r.k for r in t.rows(1).collect()} == set(range(200))  # the old version can still be read
    assert t.upsert(new.limit(0)) == 0 and t.versions.latest()[0] == 2


def test_a_failure_between_leaves_the_old_version(spark, tmp_path):
    t = BucketedTable(spark, f"file://{tmp_path}/t", "k", 8)
    t.upsert(spark.range(50).select(F.col("id").alias("k"), F.lit("old").alias("v")))
    change = spark.createDataFrame([(1, "new")], "k long, v string")

    def fail():
        raise OSError("no more")

    with pytest.raises(OSError):
        t.upsert(change, before_publishing=fail)
    assert content(t) == {k: "old" for k in range(50)}
    with pytest.raises(Conflict):  # someone else publishes between reading and publishing
        t.upsert(change, before_publishing=lambda: BucketedTable(spark, f"file://{tmp_path}/t", "k", 8).upsert(change.withColumn("v", F.lit("other"))))
    assert content(t)[1] == "other"
    t.upsert(change)
    assert content(t)[1] == "new"


def test_a_bucket_can_become_empty(spark, tmp_path):
    t = BucketedTable(spark, f"file://{tmp_path}/t", "k", 4)
    t.upsert(spark.createDataFrame([(1, "a"), (None, "b")], "k long, v string"))
    t.upsert(spark.createDataFrame([], "k long, v string"), spark.createDataFrame([(1,)], "k long"))
    assert content(t) == {None: "b"}


def corpus(spark, texts):
    return spark.createDataFrame([(f"en/{i}", "en", "title here", "", t) for i, t in enumerate(texts)], "doc_key string, library string, title string, abstract string, body string")


def test_epochs(spark, tmp_path):
    epochs = e.Epochs(spark, f"file://{tmp_path}/e")
    assert epochs.current() is None and epochs.due(0)
    old = corpus(spark, ["apple pear plum", "apple apple fig", "melon pear"])
    first = epochs.rebuild(old, x.counts(old), lambda: 1)
    assert first.number == 1 and first.n_docs == 3
    by = lambda rows: {(r.doc_key, r.feature): round(r.weight, 9) for r in rows.collect()}
    assert by(e.weights(x.counts(old), first)) == by(x.weights(old, x.counts(old)))
    new = corpus(spark, ["apple pear plum", "apple apple fig", "melon pear", "quince quince apple"])
    frozen = by(e.weights(x.counts(new), epochs.current()))
    assert {k: v for k, v in frozen.items() if k[0] != "en/3"} == by(x.weights(old, x.counts(old)))  # others keep theirs
    assert frozen["en/3", "w:quince"] > frozen["en/3", "w:apple"]
    moving = iter(range(9))
    assert epochs.rebuild(new, x.counts(new), lambda: next(moving)) is None  # the data changed meanwhile
    assert epochs.current().number == 1 and not epochs.due(49) and epochs.due(50)
    assert len(list((tmp_path / "e/data").iterdir())) == 1
    assert epochs.rebuild(new, x.counts(new), lambda: 2).number == 2
    assert by(e.weights(x.counts(new), epochs.current())) == by(x.weights(new, x.counts(new)))
