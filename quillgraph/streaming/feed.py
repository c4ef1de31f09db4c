"""A change feed with state: what has to be done again for each card.

A change (card_id, op, at, priority) may come again, in the same micro-batch, a
later one or after a restart, and out of order. For each card the state keeps the
last change that counts. One that isn't later than it is dropped; a later one
replaces it. What the consumer has to do is the last operation, with the highest
priority asked for since the work was last done (a change of op ``done`` ends the
work up to its own ``at``, and with it the priority).

``trash`` and ``delete`` mean ``remove``, as removing goes at once; everything else
means ``index``. Of changes at the same ``at``, removing wins, then the higher
priority.

Rows of a micro-batch go to to/micro=n, so a batch that comes again after a failure
replaces what it wrote. ``queue`` reads them as the present queue.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

REMOVE, INDEX, DONE = "remove", "index", "done"
STATE = "at long, op string, priority int"
OUT = "card_id string, at long, op string, priority int"


def meaning(op):
    return F.when(F.col(op).isin("trash", "delete"), REMOVE).when(F.col(op) == DONE, DONE).otherwise(INDEX)


def later(at: int, op: str, than: tuple[int, str, int]) -> bool:
    """Whether a change stands above the one in the state."""
    return at > than[0] or (at == than[0] and op == REMOVE and than[1] == INDEX)


def step(state: tuple[int, str, int] | None, at: int, op: str, priority: int) -> tuple[int, str, int] | None:
    """The state after one change; the same object if the change doesn't count."""
    if op == DONE:
        return (at, DONE, 0) if state is None or at > state[0] or (at == state[0] and state[1] != DONE) else state
    if state is None:
        return at, op, priority
    if later(at, op, state):
        return at, op, priority if state[1] == DONE else max(priority, state[2])
    if at == state[0] and state[1] != DONE and priority > state[2]:
        return at, state[1], priority  # asked for more urgently
    return state


def counting(x: pd.DataFrame) -> pd.DataFrame:
    """Of a card's changes (at, op, priority), in order of time, those that its state
    can depend on: the last ``done``, and of what is later the last at all and those
    more urgent than everything after them, no more than there are priorities."""
    x = x.sort_values(["at", "op"], ascending=[True, False], kind="stable")
    done = x[x["op"] == DONE].tail(1)
    left = x[x["op"] != DONE]
    if len(done):
        left = left[left["at"] > done["at"].iloc[0]]
    if len(left):
        urgent = left["priority"].to_numpy()
        after = np.append(np.maximum.accumulate(urgent[::-1])[::-1][1:], np.iinfo(np.int64).min)
        removed = ((left["at"] == left["at"].iloc[-1]) & (left["op"] == REMOVE) & ~left.duplicated(["at", "op"])).to_numpy()
        left = left[(urgent > after) | removed]
    return pd.concat([done, left])


def latest(key: tuple[str], parts: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
    state = before = tuple(kept.get) if kept.exists else None
    rows = None
    for x in parts:  # a card's changes of one batch come in parts of any order, so none counts before all are there
        rows = counting(x if rows is None else pd.concat([rows, x]))
    for at, op, priority in zip(rows["at"], rows["op"], rows["priority"]) if rows is not None else ():
        state = step(state, int(at), op, int(priority))
    if state != before:
        kept.update(state)
        yield pd.DataFrame({"card_id": [key[0]], "at": [state[0]], "op": [state[1]], "priority": [state[2]]})


def work(stream: DataFrame) -> DataFrame:
    """card_id, at, op (remove, index, done) and priority whenever a card's last change that counts became another. Changes without a card or a time don't count."""
    rows = stream.where("card_id is not null and at is not null").select("card_id", F.col("at").cast("long").alias("at"), meaning("op").alias("op"), F.coalesce(F.col("priority").cast("int"), F.lit(0)).alias("priority"))
    return rows.groupBy("card_id").applyInPandasWithState(latest, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def follow(stream: DataFrame, to: str, checkpoint: str) -> StreamingQuery:
    """Writes work() of each micro-batch under to/micro=n; ends when what is there is read."""

    def write(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{to}/micro={n}")

    return work(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def queue(spark: SparkSession, folder: str) -> DataFrame:
    """card_id, op, at, priority and place of what is still to be done: each card's last row, removals first, then by priority and time."""
    rows = spark.read.schema(f"{OUT}, micro long").parquet(folder)
    last = rows.groupBy("card_id").agg(F.max_by(F.struct("op", "at", "priority"), "micro").alias("x")).select("card_id", "x.*").where(F.col("op") != DONE)
    return last.orderBy(F.desc(F.col("op") == REMOVE), F.desc("priority"), "at", "card_id")


def queue_of(changes: DataFrame) -> DataFrame:
    """The queue after all of a finite table of changes, without a stream: the same rule by groups."""
    rows = changes.where("card_id is not null and at is not null").select("card_id", F.col("at").cast("long").alias("at"), meaning("op").alias("op"), F.coalesce(F.col("priority").cast("int"), F.lit(0)).alias("priority")).distinct()
    own = Window.partitionBy("card_id")
    done = F.max(F.when(F.col("op") == DONE, F.col("at"))).over(own)
    left = rows.withColumn("done", done).where((F.col("op") != DONE) & (F.col("done").isNull() | (F.col("at") > F.col("done"))))
    return left.groupBy("card_id").agg(F.max(F.struct("at", (F.col("op") == REMOVE).alias("gone"))).alias("x"), F.max("priority").alias("priority")).select("card_id", "x.at", F.when(F.col("x.gone"), REMOVE).otherwise(INDEX).alias("op"), "priority")
