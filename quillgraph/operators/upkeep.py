"""What changed, and what has to be done about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coalesced(changes: DataFrame) -> DataFrame:
    """One row a batch of changes (batch, card_id, field, all): the ids and
    fields (sorted, joined by '|'), whether everything changed, and a revision."""
    rows = changes.groupBy("batch").agg(F.max("all").alias("all"), F.array_join(F.array_sort(F.collect_set(F.col("card_id").cast("string"))), "|").alias("ids"), F.array_join(F.array_sort(F.collect_set("field")), "|").alias("fields"))
    return rows.withColumn("revision", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("batch")))


def revisions(changes: DataFrame, classes: dict[str, list[str]]) -> DataFrame:
    """A row for each class of fields: in how many batches one of its fields changed, or all."""
    named = [F.countDistinct(F.when(F.col("field").isin(fields) | F.col("all"), F.col("batch"))).alias(name) for name, fields in classes.items()]
    return changes.agg(*named)


def changed(current: DataFrame, previous: DataFrame) -> DataFrame:
    """key and status (new, changed, removed) of (key, hash) rows; equal hashes are left out."""
    rows = current.select("key", F.col("hash").alias("now")).join(previous.select("key", F.col("hash").alias("was")), "key", "full")
    status = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("was"), "changed")
    return rows.select("key", status.alias("status")).where("status is not null")


def snapshot(items: DataFrame, attachments: DataFrame, hidden: DataFrame) -> DataFrame:
    """key and stamp of the items (id, library, kind, modified) that are neither
    hidden (id) nor notes or annotations; the stamp names versions of the item
    and of its attachments (parent_id, id, modified)."""
    rows = items.where(~F.col("kind").isin("note", "annotation")).join(hidden.select("id"), "id", "left_anti")
    parts = attachments.groupBy(F.col("parent_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "id", "modified"))), ",").alias("parts"))
    rows = rows.join(parts, "id", "left")
    return rows.select(F.concat_ws("/", "library", "id").alias("key"), F.concat_ws(";", "modified", F.coalesce("parts", F.lit(""))).alias("stamp"))


def reverse_top_k(lists: DataFrame, scores: DataFrame, k: int = 100) -> DataFrame:
    """Cached lists (query, key, score) after keys were scored anew (query, key,
    score; null: no longer a match): old rows of these keys go, new ones enter,
    the best k stay; touched tells lists that changed."""
    anew = scores.select("query", "key", F.col("score").alias("now"), F.lit(True).alias("hit"))
    rows = lists.join(anew, ["query", "key"], "full")
    rows = rows.select("query", "key", F.when(F.col("hit"), F.col("now")).otherwise(F.col("score")).alias("score"), (F.coalesce("hit", F.lit(False)) & ~F.col("score").eqNullSafe(F.col("now"))).alias("moved"))
    own = Window.partitionBy("query")
    rows = rows.withColumn("touched", F.max("moved").over(own)).where("score is not null")
    place = F.row_number().over(own.orderBy(F.desc("score"), "key"))
    return rows.withColumn("place", place).where(F.col("place") <= k).select("query", "key", "score", "place", "touched")


def evicted(cache: DataFrame, keep: int = 1_000) -> DataFrame:
    """The keep latest entries (cache_key, computed_at); ties by key. The cut is
    found by a sort of the keys alone."""
    last = cache.select("computed_at", "cache_key").orderBy(F.desc("computed_at"), "cache_key").limit(keep)
    return cache.join(last, ["cache_key", "computed_at"], "left_semi")


def fresh(cache: DataFrame, epoch: int, revision: int, **more) -> DataFrame:
    """Entries of the present epoch and revision, and of the present value of
    whatever else they depend on (query_hash, vector_state, threshold, ...)."""
    rows = cache.where((F.col("epoch") == epoch) & (F.col("revision") == revision))
    for name, value in more.items():
        rows = rows.where(F.col(name).eqNullSafe(value if isinstance(value, Column) else F.lit(value)))
    return rows


def epoch_due(n_docs: int, changes: int, has_epoch: bool = True) -> bool:
    """Whether the frozen statistics have to be made anew: at 5 % of changes, 50 at least and 500 at most."""
    return not has_epoch or changes >= min(500, max(50, -(-n_docs // 20)))


SEARCHED = ("title", "body", "custom_key")


def dirty(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """card_id of the notes whose index has to be made again after changes
    (card_id, op, field, at), and of those that go from it: what was inserted, or
    updated in a field that is searched, unless the last change deletes it."""
    last = changes.groupBy("card_id").agg(F.max_by("op", "at").alias("last"))
    gone = last.where("last = 'delete'").select("card_id")
    touched = changes.where((F.col("op") == "insert") | ((F.col("op") == "update") & F.col("field").isin(*SEARCHED)) | ((F.col("op") == "delete") & F.col("field").isin(*SEARCHED)))
    return touched.select("card_id").distinct().join(gone, "card_id", "left_anti"), gone


def next_batch(queue: DataFrame, notes: DataFrame, most: int = 50) -> DataFrame:
    """The next notes of the queue (id), the first by id."""
    return notes.join(queue.select("id"), "id", "left_semi").orderBy("id").limit(most)


def upserted(rows: DataFrame, new: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """rows with new ones in place of those of the same key, without the keys removed."""
    kept = rows.join(new.select(key), key, "left_anti").unionByName(new)
    return kept.join(removed.select(key), key, "left_anti")


def quarantined(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (key, payload: JSON, value: a number of 0 or more, as text) that can
    be read, and those that can't, with the first reason."""
    number = F.expr("try_cast(value as double)")
    broken = F.col("payload").isNull() | F.expr("try_parse_json(payload)").isNull()
    reason = F.when(broken, "payload").when(number.isNull() | ~(number >= 0), "value")
    told = rows.withColumn("reason", reason)
    return told.where("reason is null").drop("reason"), told.where("reason is not null")
