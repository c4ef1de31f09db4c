"""Exact top k over sparse vectors without reading every posting of a query's features.

Postings (feature, block, chunk, doc_key, weight) lie in blocks by weight, two to
an octave, and large blocks in chunks, so that no feature is one task's. A block's
greatest weight bounds what it can give.

1. A query's blocks of the highest bounds, SEEDS postings or a little more, are
   read. The k-th best sum over them is a floor: k documents have as much.
2. A query's features are put in an order, those that give most for each posting
   first. A document whose first feature in that order lies in a block gets at
   most that block's bound and the greatest weights of all features after it. A
   block for which this is below the floor needn't be read: whoever else is in it
   and can reach the floor is found by an earlier feature.
3. Documents found so, whose sum with the unread blocks' bounds reaches the floor,
   are completed from the unread blocks of the query's features, by document.

The result is that of adding up all postings, ties by key. What is left out is
large where features are frequent and light; rare features are read whole.

Cases: a query without features, or none that the index holds, has no rows; a query
is never its own match; weights have to be positive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .lexical import tied

#: Postings that a query reads for its floor, in multiples of k.
SEEDS = 4
#: Postings of one feature and block that lie together.
CHUNK = 10_000
#: Sums of the same numbers in another order differ by less.
SLACK = 1e-9


class PostingIndex:
    """postings (feature, block, chunk, doc_key, weight) and blocks (feature, block, chunks, n, top: the greatest weight)."""

    def __init__(self, postings: DataFrame, blocks: DataFrame):
        self.postings, self.blocks = postings, blocks


def build(vectors: DataFrame) -> PostingIndex:
    """The index of vectors (doc_key, feature, weight)."""
    rows = vectors.select("doc_key", "feature", "weight", F.floor(-2 * F.log2("weight")).cast("int").alias("block"))
    blocks = rows.groupBy("feature", "block").agg(F.count("*").alias("n"), F.max("weight").alias("top"))
    blocks = materialize(blocks.withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int")))
    large = blocks.where("chunks > 1").select("feature", "block", "chunks")
    postings = rows.join(large, ["feature", "block"], "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("doc_key"), F.col("chunks")), F.lit(0)).cast("int")).drop("chunks")
    return PostingIndex(materialize(postings), blocks)


def plan(queries: DataFrame, index: PostingIndex, k: int) -> DataFrame:
    """Blocks of the queries' features (query, feature, query_weight, block, chunks, n, bound) with rest, what features later in the query's order give at most, and seed."""
    rows = queries.join(index.blocks, "feature").withColumn("bound", F.col("query_weight") * F.col("top"))
    features = rows.groupBy("query", "feature").agg(F.max("bound").alias("most"), F.sum("n").alias("df"))
    after = Window.partitionBy("query").orderBy(F.desc(F.col("most") / F.col("df")), "feature").rowsBetween(1, Window.unboundedFollowing)
    features = features.withColumn("rest", F.coalesce(F.sum("most").over(after), F.lit(0.0))).select("query", "feature", "rest")
    before = Window.partitionBy("query").orderBy(F.desc("bound"), "feature", "block").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("seed", F.coalesce(F.sum("n").over(before), F.lit(0)) < SEEDS * k)
    return rows.join(features, ["query", "feature"]).drop("top")


def read(planned: DataFrame, index: PostingIndex, without: DataFrame | None) -> DataFrame:
    """query, doc_key, feature and part of the postings in the planned blocks."""
    asked = planned.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("query", "feature", "block", "chunk", "query_weight")
    found = asked.join(index.postings, ["feature", "block", "chunk"]).where("query != doc_key")
    if without is not None:
        found = found.join(without, ["query", "doc_key"], "left_anti")
    return found.select("query", "doc_key", "feature", (F.col("query_weight") * F.col("weight")).alias("part"))


def top_k(queries: DataFrame, index: PostingIndex, k: int, without: DataFrame | None = None, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """query, doc_key and score, the k best of each query (query, feature,
    query_weight) with ties by key, among others than those in ``without`` (query,
    doc_key); and its plan: the blocks with ``read``. Scores that agree to
    ``digits`` count as ties, if given."""
    planned = materialize(plan(queries, index, k))
    best = Window.partitionBy("query").orderBy((tied("score") if digits is None else F.round("score", digits)).desc(), "doc_key")
    seeds = read(planned.where("seed"), index, without).groupBy("query", "doc_key").agg(F.sum("part").alias("score"))
    floors = seeds.withColumn("place", F.row_number().over(best)).where(F.col("place") == k).select("query", (F.col("score") * (1 - SLACK) - (0.0 if digits is None else 10.0**-digits)).alias("floor"))
    told = planned.join(floors, "query", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    told = materialize(told.withColumn("read", F.col("bound") + F.col("rest") >= F.col("floor")))
    # of each feature the greatest bound that isn't read
    unread = told.where("not read").groupBy("query", "feature").agg(F.max("bound").alias("unread"))
    open_ = unread.groupBy("query").agg(F.sum("unread").alias("open"))
    parts = read(told.where("read"), index, without).join(unread, ["query", "feature"], "left")
    # a document has one posting of a feature: where it was read, nothing of that feature is open any more
    sums = parts.groupBy("query", "doc_key").agg(F.sum("part").alias("part"), F.coalesce(F.sum("unread"), F.lit(0.0)).alias("closed"))
    sums = sums.join(told.groupBy("query").agg(F.max("floor").alias("floor")), "query").join(open_, "query", "left").withColumn("open", F.coalesce("open", F.lit(0.0)))
    able = materialize(sums.where((F.col("part") + F.greatest(F.col("open") - F.col("closed"), F.lit(0.0))) * (1 + SLACK) >= F.col("floor")).select("query", "doc_key", "part", "open"))
    # by document and feature, of which a query has some dozens
    left = told.where("not read").groupBy("query", "feature", "query_weight").agg(F.collect_set("block").alias("blocks"))
    missing = able.where("open > 0").select("query", "doc_key").join(left, "query").join(index.postings.select("doc_key", "feature", "block", "weight"), ["doc_key", "feature"])
    more = missing.where(F.array_contains("blocks", F.col("block"))).select("query", "doc_key", (F.col("query_weight") * F.col("weight")).alias("part"))
    whole = able.select("query", "doc_key", "part").union(more).groupBy("query", "doc_key").agg(F.sum("part").alias("score"))
    return whole.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place"), told
