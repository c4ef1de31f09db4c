"""Cached lists of the best matches, kept up when documents change.

A changed document has to find the lists that it can enter without scoring
itself against all of them. A list's floor is the score of its last place (0 if
it isn't full). A query's features are put in order of weight; those at the end
whose weights, taken together as a vector, are shorter than the floor can't bring
a unit vector up to it, so the query is entered in the index under the features
before them only. A document looks up its own features, and what it finds is
scored in full.

A list that loses a member, or whose member falls below the floor, may have to
take in a document that it doesn't know: unless enough new ones stand above the
old floor it is asked again, by score bounds. So the result is that of asking
all queries again.

Cases: ties by key; a query that changes itself is asked again by its caller; changed
documents that no list can take and that were in none touch nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from . import bounds
from .lexical import tied

SLACK = 1e-9


def floors(queries: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """query, floor and last of all queries: the k-th score of its list (query, key, score) and its key, 0 and null if there is none."""
    last = F.max(F.struct(-tied("score"), "key"))["key"]
    full = lists.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("floor"), last.alias("last")).where(F.col("n") >= k).select("query", "floor", "last")
    return queries.select("query").distinct().join(full, "query", "left").select("query", F.coalesce("floor", F.lit(0.0)).alias("floor"), "last")


def entered(queries: DataFrame, floor: DataFrame, norm: float = 1.0) -> DataFrame:
    """query, feature, query_weight of the features under which a list has to be
    looked up by documents whose vectors are no longer than norm."""
    end = Window.partitionBy("query").orderBy("query_weight", "feature").rowsBetween(Window.unboundedPreceding, 0)
    rows = queries.join(floor, "query").withColumn("rest", F.sqrt(F.sum(F.col("query_weight") * F.col("query_weight")).over(end)) * norm)
    return rows.where(F.col("rest") * (1 + SLACK) >= F.col("floor")).select("query", "feature", "query_weight")


def hits(queries: DataFrame, floor: DataFrame, changed: DataFrame, norm: float = 1.0) -> DataFrame:
    """query, key and score of changed documents (doc_key, feature, weight) for the lists whose floor they reach."""
    found = entered(queries, floor, norm).join(changed, "feature").where("query != doc_key").select("query", "doc_key").distinct()
    scored = found.join(queries, "query").join(changed, ["doc_key", "feature"]).groupBy("query", "doc_key").agg(F.sum(F.col("query_weight") * F.col("weight")).alias("score"))
    return scored.join(floor, "query").where(F.col("score") * (1 + SLACK) >= F.col("floor")).select("query", F.col("doc_key").alias("key"), "score")


def maintained(lists: DataFrame, queries: DataFrame, vectors: DataFrame, changed: DataFrame, gone: DataFrame, k: int, norm: float = 1.0) -> DataFrame:
    """The lists (query, key, score) after documents changed (doc_key, feature,
    weight: as they are now) and others went (key). queries: query, feature,
    query_weight; vectors: all documents as they are now; k: a list's places."""
    floor = materialize(floors(queries, lists, k))
    touched = changed.select(F.col("doc_key").alias("key")).union(gone.select("key")).distinct()
    lost = lists.join(touched, "key", "left_semi").select("query").distinct()
    kept = lists.join(touched, "key", "left_anti").select("query", "key", "score")
    rows = materialize(kept.union(hits(queries, floor, changed, norm)))
    # a list that lost a member is whole if as many as it had places stand no further back than its old last one, whose
    # score documents that it doesn't know may have too; one that wasn't full knew everybody
    ahead = (tied("score") > tied("floor")) | ((tied("score") == tied("floor")) & (F.col("key") <= F.col("last")))
    above = rows.join(floor, "query").where(ahead).groupBy("query").agg(F.count("*").alias("n"))
    dirty = lost.join(floor.where("floor > 0"), "query").join(above, "query", "left").where(F.coalesce("n", F.lit(0)) < k).select("query")
    dirty = materialize(dirty)
    again = bounds.top_k(queries.join(dirty, "query", "left_semi"), bounds.build(vectors), k)[0].select("query", F.col("doc_key").alias("key"), "score") if dirty.count() else None
    sound = rows.join(dirty, "query", "left_anti")
    place = F.row_number().over(Window.partitionBy("query").orderBy(tied("score").desc(), "key"))
    sound = sound.withColumn("place", place).where(F.col("place") <= k).drop("place")
    return sound if again is None else sound.union(again)
