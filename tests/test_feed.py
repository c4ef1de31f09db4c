"""The change feed with state: repeats, restarts, order and priorities."""

from __future__ import annotations

import random

import pandas as pd
import pytest

from quillgraph.streaming import feed

SCHEMA = "card_id string, op string, at long, priority int"


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def run(spark, tmp_path):
    q = feed.follow(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in"), f"file://{tmp_path}/out", f"file://{tmp_path}/check")
    q.awaitTermination()
    return [(r.card_id, r.op, r.at, r.priority) for r in feed.queue(spark, f"file://{tmp_path}/out").collect()]


def written(spark, tmp_path):
    return spark.read.parquet(f"file://{tmp_path}/out").count()


def test_a_change_in_three_batches_counts_once(spark, tmp_path):
    same = [("a", "modify", 5, 1)]
    for _ in range(3):
        put(spark, tmp_path / "in", same * 2)
    assert run(spark, tmp_path) == [("a", "index", 5, 1)] and written(spark, tmp_path) == 1
    put(spark, tmp_path / "in", same)  # and again after a restart
    assert run(spark, tmp_path) == [("a", "index", 5, 1)] and written(spark, tmp_path) == 1


def test_last_operation_wins_and_priority_is_kept(spark, tmp_path):
    put(spark, tmp_path / "in", [("a", "add", 1, 5), ("b", "modify", 3, 0), ("c", "delete", 4, 0), (None, "add", 1, 1), ("e", "add", None, 1)])
    put(spark, tmp_path / "in", [("a", "modify", 2, 1), ("b", "trash", 9, 0), ("c", "modify", 3, 7), ("d", "index", 2, 2)])
    assert run(spark, tmp_path) == [("c", "remove", 4, 0), ("b", "remove", 9, 0), ("a", "index", 2, 5), ("d", "index", 2, 2)]
    put(spark, tmp_path / "in", [("a", "done", 2, 0), ("b", "done", 8, 0)])  # b changed after its work was done
    put(spark, tmp_path / "in", [("a", "modify", 2, 5), ("a", "modify", 3, 1)])
    assert run(spark, tmp_path) == [("c", "remove", 4, 0), ("b", "remove", 9, 0), ("d", "index", 2, 2), ("a", "index", 3, 1)]


@pytest.mark.parametrize("seed", range(3))
def test_the_order_within_a_batch_does_not_matter(spark, seed):
    rng = random.Random(seed)
    rows = [(f"c{rng.randrange(6)}", rng.choice(["add", "modify", "trash", "delete"]), rng.randrange(8), rng.randrange(3)) for _ in range(80)]
    want = {r.card_id: (r.op, r.at) for r in feed.queue_of(spark.createDataFrame(rows, SCHEMA)).collect()}
    for _ in range(5):
        rng.shuffle(rows)
        got = {}
        for c, op, at, p in rows:
            got[c] = feed.step(got.get(c), at, {"trash": "remove", "delete": "remove"}.get(op, "index"), p)
        assert {c: (op, at) for c, (at, op, _) in got.items()} == want


def test_a_card_of_many_changes_is_that_of_all_in_order(spark, tmp_path):
    """A card's changes of a batch come to its task in parts (of 500 rows, by the session); the order in a file is not that of time."""
    rng = random.Random(7)
    rows = [(c, rng.choice(["modify", "delete", "modify", "done"] if c == "b" else ["modify", "delete"]), rng.randrange(400), rng.choice([0, 0, 0, 1, 2, 3])) for c in "abc" for _ in range(1500)]
    rows += [("a", "done", 396, 0), ("c", "modify", 400, 5), ("c", "delete", 400, 1), ("d", "delete", 3, 0), ("d", "modify", 3, 2)]
    rng.shuffle(rows)
    put(spark, tmp_path / "in", rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = run(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {(r.card_id, r.op, r.at, r.priority) for r in feed.queue_of(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == want and ("c", "remove", 400, 5) in want and ("d", "remove", 3, 2) in want


def test_parts_of_any_size_leave_the_same_state():
    rng = random.Random(3)
    for _ in range(100):
        rows = [(rng.randrange(9), rng.choice(["remove", "index", "index", "done"]), rng.randrange(4)) for _ in range(rng.randrange(1, 25))]
        state = None
        for at, op, p in sorted(sorted(rows, key=lambda r: r[1], reverse=True), key=lambda r: r[0]):
            state = feed.step(state, at, op, p)
        kept, found = None, None
        for i in range(0, len(rows), 4):
            part = pd.DataFrame(rows[i : i + 4], columns=["at", "op", "priority"])
            kept = feed.counting(part if kept is None else pd.concat([kept, part]))
        for at, op, p in kept.itertuples(index=False):
            found = feed.step(found, at, op, p)
        assert found == state and len(kept) <= 6
