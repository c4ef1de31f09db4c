"""Dense vectors: cosines, nearest neighbours, fusion of rankings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: str | Column) -> Column:
    """The vector at length 1; null for vectors without length or with values that aren't finite."""
    col = F.col(a) if isinstance(a, str) else a
    n = norm(col)
    # as an array the length is computed once, inside a function once for each element
    return F.when((n > 0) & (n < float("inf")), F.zip_with(col, F.array_repeat(n, F.size(col)), lambda x, m: x.cast("double") / m))


def fresh(vectors: DataFrame, docs: DataFrame) -> DataFrame:
    """Vectors (key, hash, ...) made from the text that a document (key, hash) has now."""
    return vectors.join(docs.select("key", "hash"), ["key", "hash"], "left_semi")


def tag_similarities(candidates: DataFrame, documents: DataFrame, tags: DataFrame) -> DataFrame:
    """query, name and similarity of candidates (query, name): the cosine of the
    document's vector (key, vector) and the tag's (key, vector)."""
    rows = candidates.join(documents.select(F.col("key").alias("query"), unit("vector").alias("q")), "query").join(tags.select(F.col("key").alias("name"), unit("vector").alias("t")), "name")
    return rows.select("query", "name", dot("q", "t").alias("similarity"))


def checked(k: int, most: int = 100) -> int:
    """k, if that many results may be asked for."""
    if not 1 <= k <= most:
        raise ValueError(f"1 to {most} results")
    return k


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query, key, score and place: the k vectors (key, library, vector) nearest
    to each query (key, library, vector) in its library, of positive cosine, 1 at most."""
    checked(k)
    v = vectors.select("key", "library", unit("vector").alias("v")).where("v is not null")
    q = queries.select(F.col("key").alias("query"), "library", unit("vector").alias("q")).where("q is not null")
    rows = v.join(q, "library").where("key != query").select("query", "key", F.least(F.lit(1.0), dot("v", "q")).alias("score")).where("score > 0")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def vector_pairs(vectors: DataFrame, least: float = 0.84, block: int = 2048) -> DataFrame:
    """a < b and score: all pairs of (key, library, vector) of a cosine of least
    or more. Meant for vocabularies: a task compares two blocks of a library,
    and each vector is sent to as many tasks as its library has blocks."""
    rows = vectors.select("key", "library", unit("vector").alias("v")).where("v is not null")
    blocks = rows.groupBy("library").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = rows.join(blocks, "library").withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("library", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "v")
    kind = dict(vectors.dtypes)["key"]

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        one, two = pdf[pdf.own == i], pdf[pdf.own == j]
        if not len(one) or not len(two):
            return pd.DataFrame({"a": [], "b": [], "score": []}).astype({"a": pdf.key.dtype, "b": pdf.key.dtype})
        scores = np.stack(one.v.values) @ np.stack(two.v.values).T
        x, y = one.key.to_numpy(), two.key.to_numpy()
        p, q = np.nonzero(scores >= least)
        found = pd.DataFrame({"a": x[p], "b": y[q], "score": scores[p, q]})
        keep = found.a < found.b if i == j else found.a != found.b
        found = found[keep]
        low = found.a < found.b
        return pd.DataFrame({"a": found.a.where(low, found.b), "b": found.b.where(low, found.a), "score": found.score})

    return rows.groupBy("library", "i", "j").applyInPandas(compare, f"a {kind}, b {kind}, score double")


def chunks(corpus: DataFrame, words: int = 120, chars: int = 1800) -> DataFrame:
    """doc_key, chunk and text: title and abstract in windows of words, three at
    most; without an abstract the body's beginning too, four in all. Windows
    without a letter are left out."""
    split = lambda c: F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    head = split(F.concat(F.lower("title"), F.lit(". "), F.lower("abstract")))
    body = split(F.substring(F.lower("body"), 1, 12_000))
    window = lambda c: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(c) / words) - 1, F.lit(0)).cast("int")), lambda i: F.substring(F.array_join(F.slice(c, i * words + 1, words), " "), 1, chars))
    first = F.slice(window(head), 1, 3)
    both = F.when(F.trim("abstract") == "", F.slice(F.concat(first, window(body)), 1, 4)).otherwise(first)
    rows = corpus.select("doc_key", F.posexplode(both).alias("chunk", "text"))
    return rows.where(F.col("text").rlike(r"\p{L}"))


def pooled(parts: DataFrame) -> DataFrame:
    """key and vector: the mean of a key's vectors (key, chunk, vector), the first one three times, at length 1."""
    w = F.when(F.col("chunk") == 0, 3.0).otherwise(1.0)
    rows = parts.select("key", w.alias("w"), F.posexplode("vector").alias("dim", "x")).groupBy("key", "dim").agg(F.sum(F.col("w") * F.col("x").cast("double")).alias("x"))
    vectors = rows.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("vector"))
    return vectors.select("key", unit("vector").alias("vector"))


def fused(rankings: DataFrame, channels: int, k: int = 50, most: int = 100) -> DataFrame:
    """Reciprocal rank fusion of rankings (query, channel, doc_key, score): the
    first most of each give 1 / (61 + rank), out of channels / 61; query,
    doc_key, fused, lexical_score (channel 0) and semantic_score."""
    rank = F.row_number().over(Window.partitionBy("query", "channel").orderBy(F.desc("score"), "doc_key")) - 1
    rows = rankings.withColumn("rank", rank).where(F.col("rank") < most)
    of = lambda c: F.max(F.when(F.col("channel") == c, F.col("score")))
    found = rows.groupBy("query", "doc_key").agg((F.sum(1 / (61 + F.col("rank"))) / (channels / 61)).alias("fused"), of(0).alias("lexical_score"), of(1).alias("semantic_score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("fused"), "doc_key"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def relevant(rows: DataFrame, kind: str, least: float = 0.05) -> DataFrame:
    """Rows (query, score, for hybrid lexical_score and semantic_score) above the
    floor: text max(least, a fifth of the best), semantic max(0.4, 0.7 of the
    best), hybrid either channel's own."""
    if not 0 < least < float("inf"):
        least = 0.05
    if kind == "hybrid":
        return rows.where((F.coalesce("lexical_score", F.lit(0.0)) >= least) | (F.coalesce("semantic_score", F.lit(0.0)) >= 0.4))
    floor, share = (least, 0.2) if kind == "text" else (0.4, 0.7)
    best = F.max("score").over(Window.partitionBy("query", *(["channel"] if "channel" in rows.columns else [])))
    return rows.where((F.col("score") > 0) & (F.col("score") < float("inf"))).withColumn("best", best).where(F.col("score") >= F.greatest(F.lit(floor), share * F.col("best"))).drop("best")


def hybrid(lexical: DataFrame, semantic: DataFrame | None, least: float = 0.05, k: int = 50) -> DataFrame:
    """Both rankings (query, doc_key, score) cut at their floors and fused; one alone counts as the only channel."""
    rows = relevant(lexical, "text", least).select("query", F.lit(0).alias("channel"), "doc_key", "score")
    if semantic is not None:
        rows = rows.union(relevant(semantic, "semantic").select("query", F.lit(1).alias("channel"), "doc_key", "score"))
    return fused(rows, 1 if semantic is None else 2, k)
