"""Fielded lexical retrieval over a corpus (doc_key, library, weak, title, abstract, body).

Features are counted by field, weighed as BM25F does it, and a document's
heaviest make its signature, a unit vector. Candidates share features of a
query's signature; similarity is a weighted mean of cosines of the fields.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS
from ..sources.scratch import materialize
from . import weighing
from .dense import checked
from .weighing import FIELDS, LENGTH_SHARES, WEIGHTS

SIGNATURE, TITLE_TERMS, ABSTRACT_TERMS = 256, 64, 128
QUERY_TERMS, QUERY_TITLE_TERMS, CANDIDATES = 48, 16, 300


#: What a row of a document holds: the lengths of its fields, and each feature with its counts in title, abstract and body.
BY_DOCUMENT = "doc_key string, len0 long, len1 long, len2 long, features array<struct<feature: string, tf0: long, tf1: long, tf2: long>>"


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of doc_key and the words of the three fields to batches of BY_DOCUMENT."""
    for batch in batches:
        n = batch.num_rows
        lists = batch.column(1).flatten()
        at = np.repeat(np.arange(3 * n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        words = lists.flatten().dictionary_encode()
        word, known = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
        good = np.array([len(w) >= 2 and w not in STOP_WORDS and not (w.isascii() and w.isdigit()) for w in known.to_pylist()], bool)[word] if len(word) else np.zeros(0, bool)
        pair = np.flatnonzero(good[:-1] & good[1:] & (at[:-1] == at[1:]))
        size = max(1, len(known))
        code = np.concatenate([word[good], size + word[pair] * size + word[pair + 1]])
        at = np.concatenate([at[good], at[pair]])
        codes, code = np.unique(code, return_inverse=True)
        held, place = np.unique(at // 3 * max(1, len(codes)) + code, return_inverse=True)
        tf = [np.bincount(place[at % 3 == k], minlength=len(held)) for k in range(3)]
        one, two = codes[codes < size], codes[codes >= size] - size
        text = lambda values: known.take(pa.array(values)).cast(pa.string())
        names = pa.concat_arrays([pc.binary_join_element_wise("w:", text(one), ""), pc.binary_join_element_wise(pc.binary_join_element_wise("b:", text(two // size), ""), text(two % size), " ")])
        ends = np.concatenate([[0], np.cumsum(np.bincount(held // max(1, len(codes)), minlength=n))]).astype(np.int32)
        features = pa.StructArray.from_arrays([names.take(pa.array(held % max(1, len(codes)))), *[pa.array(x, pa.int64()) for x in tf]], ["feature", "tf0", "tf1", "tf2"])
        lengths = [pa.array(np.bincount(at[at % 3 == k] // 3, minlength=n), pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *lengths, pa.ListArray.from_arrays(pa.array(ends), features)], names=["doc_key", "len0", "len1", "len2", "features"])


def counts_by_document(corpus: DataFrame) -> DataFrame:
    """A row (BY_DOCUMENT) for each document: its features are counted where its
    text is, so nothing is shuffled, unless rows share a key (which are one document)."""
    words = lambda name: F.regexp_extract_all(F.lower(name), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    rows = corpus.select("doc_key", F.array(*[words(n) for n in FIELDS]).alias("words")).mapInArrow(_count_words, BY_DOCUMENT)
    if corpus.groupBy("doc_key").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return rows
    return by_document(by_field_of(rows).groupBy("doc_key", "field", "feature").agg(F.sum("tf").alias("tf")))


def by_field_of(documents: DataFrame) -> DataFrame:
    """doc_key, field, feature and tf of rows as BY_DOCUMENT."""
    rows = documents.select("doc_key", F.explode("features").alias("f"))
    tf = F.array(*[F.struct(F.lit(k).alias("field"), F.col(f"f.tf{k}").alias("tf")) for k in range(3)])
    return rows.select("doc_key", F.col("f.feature").alias("feature"), F.explode(tf).alias("t")).where("t.tf > 0").select("doc_key", "t.field", "feature", "t.tf")


def by_document(counted: DataFrame) -> DataFrame:
    """counted as rows of BY_DOCUMENT, from those or from rows of doc_key, field, feature and tf."""
    if "features" in counted.columns:
        return counted
    tf = [F.sum(F.when(F.col("field") == k, F.col("tf")).otherwise(0)).alias(f"tf{k}") for k in range(3)]
    rows = counted.groupBy("doc_key", "feature").agg(*tf)
    return rows.groupBy("doc_key").agg(*[F.sum(f"tf{k}").alias(f"len{k}") for k in range(3)], F.collect_list(F.struct("feature", "tf0", "tf1", "tf2")).alias("features"))


def counts(corpus: DataFrame, features: Callable[[str], Column] | None = None) -> DataFrame:
    """doc_key, field (0 to 2), feature and tf. Without another function the
    features are words (w:) and pairs of neighbours (b:) without stems, for texts
    without CJK."""
    if features is not None:
        rows = [corpus.select("doc_key", F.lit(k).alias("field"), F.explode(features(name)).alias("feature")) for k, name in enumerate(FIELDS)]
        return reduce(DataFrame.union, rows).groupBy("doc_key", "field", "feature").agg(F.count("*").alias("tf"))
    return by_field_of(counts_by_document(corpus))


def document_frequencies(counted: DataFrame) -> DataFrame:
    """feature and df: how many documents hold it in any field; one without a key isn't counted."""
    return by_document(counted).select("doc_key", F.explode("features.feature").alias("feature")).groupBy("feature").agg(F.count("doc_key").alias("df"))


def field_averages(corpus: DataFrame, counted: DataFrame) -> DataFrame:
    """One row: n_docs and the mean length of each field (1 where that is 0; empty fields count)."""
    if "features" in counted.columns:
        sums = [F.coalesce(F.sum(f"len{k}"), F.lit(0)).alias(f"sum{k}") for k in range(3)]
    else:
        sums = [F.coalesce(F.sum(F.when(F.col("field") == k, F.col("tf"))), F.lit(0)).alias(f"sum{k}") for k in range(3)]
    n = corpus.agg(F.count("*").alias("n_docs"))
    means = [F.when(F.col(f"sum{k}") > 0, F.col(f"sum{k}") / F.col("n_docs")).otherwise(F.lit(1.0)).alias(f"avg{k}") for k in range(3)]
    return n.crossJoin(F.broadcast(counted.agg(*sums))).select("n_docs", *means)


def saturated(documents: DataFrame, averages: DataFrame) -> DataFrame:
    """doc_key, feature, n_docs, in_title and x: the sum of a feature's shares in the fields of a document."""
    rows = documents.where("doc_key is not null").crossJoin(F.broadcast(averages))  # one row
    rows = rows.select("doc_key", "n_docs", *[f"len{k}" for k in range(3)], *[f"avg{k}" for k in range(3)], F.explode("features").alias("f"))
    part = lambda k: F.when(F.col(f"f.tf{k}") > 0, WEIGHTS[k] * F.col(f"f.tf{k}") / (1 - LENGTH_SHARES[k] + LENGTH_SHARES[k] * F.col(f"len{k}") / F.col(f"avg{k}"))).otherwise(0.0)
    return rows.select("doc_key", F.col("f.feature").alias("feature"), "n_docs", (F.col("f.tf0") > 0).alias("in_title"), (part(0) + part(1) + part(2)).alias("x"))


def weights(corpus: DataFrame, counted: DataFrame) -> DataFrame:
    """doc_key, feature, weight and in_title: saturated BM25F weights. counted is
    read three times: rows by field are written by document before, rows by
    document should be."""
    documents = counted if "features" in counted.columns else materialize(by_document(counted))
    idf = F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rows = saturated(documents, field_averages(corpus, documents)).join(document_frequencies(documents), "feature")
    return rows.select("doc_key", "feature", (idf * F.col("x") * 2.2 / (F.col("x") + 1.2)).alias("weight"), "in_title")


def picked(weighed: DataFrame, title: int, total: int) -> DataFrame:
    """The title's heaviest features first, then the heaviest of all, up to total; ties by the feature."""
    doc = Window.partitionBy("doc_key")
    rows = weighed.withColumn("k", F.row_number().over(doc.orderBy(F.desc("in_title"), F.desc("weight"), "feature")))
    rows = rows.withColumn("own", F.col("in_title") & (F.col("k") <= title))
    return rows.withColumn("k", F.row_number().over(doc.orderBy(F.desc("own"), F.desc("weight"), "feature"))).where(F.col("k") <= total).drop("k", "own")


def normalised(rows: DataFrame) -> DataFrame:
    """Unit vectors, each weight kept as one of 65,535 steps."""
    doc = Window.partitionBy("doc_key")
    unit = F.col("weight") / F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(doc))
    rows = rows.withColumn("weight", F.greatest(F.lit(1.0), F.round(unit * 65535)) / 65535)
    return rows.withColumn("weight", F.col("weight") / F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(doc)))


def signatures(weighed: DataFrame) -> DataFrame:
    return normalised(picked(weighed, TITLE_TERMS, SIGNATURE))


def signature_rows(corpus: DataFrame) -> DataFrame:
    """weighing.WEIGHED: the signatures of a corpus of words and pairs of neighbours, a row for each document."""
    return weighing.signatures(corpus, TITLE_TERMS, SIGNATURE)


def flat(rows: DataFrame) -> DataFrame:
    """doc_key, feature, weight and in_title of rows as weighing.WEIGHED."""
    return rows.select("doc_key", F.explode("features").alias("f")).select("doc_key", "f.feature", "f.weight", "f.in_title")


def field_vectors(counted: DataFrame, frequencies: DataFrame, n_docs: DataFrame) -> DataFrame:
    """doc_key, field (0, 1), feature, weight: idf * (1 + ln tf) of the heaviest of title and abstract."""
    if "features" in counted.columns:  # of most documents the body's features are by far the most
        counted = by_field_of(counted.withColumn("features", F.filter("features", lambda f: (f["tf0"] > 0) | (f["tf1"] > 0))))
    rows = counted.where("field < 2").join(frequencies, "feature").crossJoin(F.broadcast(n_docs.select("n_docs")))
    idf = F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rows = rows.select(F.concat_ws("\t", "doc_key", "field").alias("doc_key"), "field", "feature", (idf * (1 + F.ln("tf"))).alias("weight"))
    best = rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_key").orderBy(F.desc("weight"), "feature")))
    kept = best.where(F.col("k") <= F.when(F.col("field") == 0, TITLE_TERMS).otherwise(ABSTRACT_TERMS)).drop("k")
    return normalised(kept).withColumn("doc_key", F.split_part("doc_key", F.lit("\t"), F.lit(1)))


def query_terms(signature: DataFrame) -> DataFrame:
    """query, feature and weight of the documents as queries: 16 of the title, 48 in all."""
    return picked(signature, QUERY_TITLE_TERMS, QUERY_TERMS).select(F.col("doc_key").alias("query"), "feature", F.col("weight").alias("query_weight"))


def tied(score: str | Column) -> Column:
    """Scores for an order: those that differ by less than sums of the same numbers in another order may do are equal."""
    return F.rint((F.col(score) if isinstance(score, str) else score) * 2.0**40)


def candidates(queries: DataFrame, signature: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """query, doc_key and score: the products of shared features summed; the best of each query, ties by key."""
    found = queries.join(signature.select("doc_key", "feature", "weight"), "feature").where("query != doc_key").groupBy("query", "doc_key").agg(F.sum(F.col("query_weight") * F.col("weight")).alias("score"))
    best = F.row_number().over(Window.partitionBy("query").orderBy(tied("score").desc(), "doc_key"))
    return found.withColumn("k", best).where(F.col("k") <= most).drop("k")


def cosines(pairs: DataFrame, vectors: DataFrame, name: str) -> DataFrame:
    """query, doc_key and the cosine of their vectors; 0 without a shared feature, null where one has no vector."""
    left = pairs.join(vectors.select(F.col("doc_key").alias("query"), "feature", F.col("weight").alias("w")), "query")
    both = left.join(vectors.select("doc_key", "feature", "weight"), ["doc_key", "feature"]).groupBy("query", "doc_key").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    have = vectors.select("doc_key").distinct()
    able = pairs.join(have, "doc_key", "left_semi").join(have.withColumnRenamed("doc_key", "query"), "query", "left_semi").select("query", "doc_key")
    return able.join(both, ["query", "doc_key"], "left").select("query", "doc_key", F.coalesce("dot", F.lit(0.0)).alias(name))


def similarities(pairs: DataFrame, fields: DataFrame, signature: DataFrame) -> DataFrame:
    """query, doc_key and similarity: 0.3 title, 0.3 abstract, 0.4 signature, over what both sides have."""
    pairs, fields = materialize(pairs.select("query", "doc_key")), materialize(fields)  # read for each field and side
    rows = pairs
    for name, vectors in (("title", fields.where("field = 0")), ("abstract", fields.where("field = 1")), ("whole", signature)):
        rows = rows.join(cosines(pairs, vectors, name), ["query", "doc_key"], "left")
    shares = {"title": 0.3, "abstract": 0.3, "whole": 0.4}
    total = reduce(Column.__add__, [F.coalesce(F.col(k) * v, F.lit(0.0)) for k, v in shares.items()])
    have = reduce(Column.__add__, [F.when(F.col(k).isNotNull(), v).otherwise(0.0) for k, v in shares.items()])
    return rows.select("query", "doc_key", F.when(have > 0, total / have).otherwise(0.0).alias("similarity"))


def simhashes(counted: DataFrame) -> DataFrame:
    """doc_key, simhash (64 bits of weighted votes) and length (weighted)."""
    merged = by_document(counted).select("doc_key", F.explode("features").alias("f")).select("doc_key", "f.feature", reduce(Column.__add__, [F.col(f"f.tf{k}") * w for k, w in enumerate(WEIGHTS)]).alias("n"))
    h, w = F.xxhash64("feature"), 1 + F.ln("n")
    votes = [F.sum(F.when(h.bitwiseAND(F.lit(1 << k if k < 63 else -(1 << 63))) != 0, w).otherwise(-w)).alias(f"v{k}") for k in range(64)]
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.col(f"v{k}") > 0, F.lit(1 << k if k < 63 else -(1 << 63))).otherwise(F.lit(0)) for k in range(64)])
    return merged.groupBy("doc_key").agg(*votes, F.sum("n").alias("length")).select("doc_key", bits.cast("long").alias("simhash"), "length")


def weak_flags(corpus: DataFrame, counted: DataFrame, least: int = 25) -> DataFrame:
    """doc_key and weak: no body, or fewer different features than least."""
    n = by_document(counted).select("doc_key", F.size("features").alias("n"))
    bare = corpus.select("doc_key", (F.trim("body") == "").alias("bare"))  # the texts stay where they are
    return bare.join(n, "doc_key", "left").select("doc_key", (F.col("bare") | (F.coalesce("n", F.lit(0)) < least)).alias("weak"))


def tables_of(simhash: str, bits: int) -> Column:
    """Keys of a simhash, one a table. 64 bits fall into bits + 3 blocks, and each
    choice of three of them is a table, so a key has about 32 bits for three bits
    of difference; two hashes with no more than ``bits`` different bits agree in
    three blocks at least, and so in a table."""
    n = bits + 3
    ends = [64 * i // n for i in range(n + 1)]
    part = lambda i: F.shiftleft(F.shiftrightunsigned(simhash, ends[i]), 64 - (ends[i + 1] - ends[i]))
    # left-aligned blocks, packed one behind the other
    keys = []
    for k, chosen in enumerate(combinations(range(n), 3)):
        at, key = 0, F.lit(0).cast("long")
        for i in chosen:
            key = key.bitwiseOR(F.shiftrightunsigned(part(i), at))
            at += ends[i + 1] - ends[i]
        keys.append(F.struct(F.lit(k).alias("table"), key.alias("key")))
    return F.array(*keys)


#: Hashes of one key that a task compares with as many others.
CROWD = 512


def near_hashes(hashes: DataFrame, bits: int = 3) -> DataFrame:
    """a < b of different simhashes (simhash) of which no more than ``bits`` bits
    differ, each pair once. A hash is looked at only in tables where another
    shares its key; a key of very many is cut into squares of CROWD."""
    rows = hashes.select("simhash").distinct().select("simhash", F.explode(tables_of("simhash", bits)).alias("t")).select("simhash", "t.table", "t.key")
    rows = materialize(rows)
    shared = rows.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("squares", F.ceil(F.col("n") / CROWD).cast("int")).drop("n")
    rows = materialize(rows.join(shared, ["table", "key"]).withColumn("own", F.pmod(F.xxhash64("simhash"), F.col("squares")).cast("int")))
    # each goes to the squares of its row and of its column
    one = rows.select("table", "key", F.col("simhash").alias("a"), F.col("own").alias("i"), F.explode(F.sequence(F.lit(0), F.col("squares") - 1)).alias("j"))
    two = rows.select("table", "key", F.col("simhash").alias("b"), F.col("own").alias("j"), F.explode(F.sequence(F.lit(0), F.col("squares") - 1)).alias("i"))
    met = one.join(two, ["table", "key", "i", "j"]).where(F.col("a") < F.col("b")).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    return met.select("a", "b").distinct()


def near_duplicates(hashes: DataFrame, signature: DataFrame, weak: DataFrame, least: float = 0.95, bits: int = 3, length: float = 100) -> tuple[DataFrame, DataFrame]:
    """Near duplicates among documents that are long enough and not weak, whose
    simhashes differ in few bits and whose signatures have a cosine of least or
    more. Documents of the same simhash and signature are one class before
    anything is compared: returns pairs doc_key < other of class representatives
    with their cosine, and doc_key and copy_of, the representative of each
    document. signature: by feature, or rows as weighing.WEIGHED."""
    by_row = "features" in signature.columns
    listed = F.transform("features", lambda f: F.struct(f["feature"], f["weight"])) if by_row else F.collect_list(F.struct("feature", "weight"))
    digest = F.md5(F.to_json(F.array_sort(listed)).cast("binary")).alias("digest")  # a signature has 256 features at most
    own = signature.select("doc_key", digest) if by_row else signature.groupBy("doc_key").agg(digest)
    sound = hashes.where(F.col("length") >= length).join(weak.where("weak").select("doc_key"), "doc_key", "left_anti").join(own, "doc_key")
    sound = materialize(sound)
    least_key = sound.groupBy("simhash", "digest").agg(F.min("doc_key").alias("copy_of"))
    members = materialize(sound.join(least_key, ["simhash", "digest"]).select("doc_key", "copy_of", "simhash"))
    heads = members.where("doc_key = copy_of").select("doc_key", "simhash")
    pairs = near_hashes(heads, bits)
    pairs = pairs.union(heads.groupBy("simhash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("simhash").alias("a"), F.col("simhash").alias("b")))
    rows = pairs.join(heads.select(F.col("doc_key").alias("x"), F.col("simhash").alias("a")), "a").join(heads.select(F.col("doc_key").alias("y"), F.col("simhash").alias("b")), "b").where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    near = materialize(rows.select(F.least("x", "y").alias("doc_key"), F.greatest("x", "y").alias("other")))
    # few documents are near another: only their signatures are sent anywhere
    alike = materialize(near.select("doc_key").union(near.select("other")).distinct())
    signature = signature.join(alike, "doc_key", "left_semi")
    signature = materialize(flat(signature) if by_row else signature)
    cos = cosines(near.select(F.col("doc_key").alias("query"), F.col("other").alias("doc_key")), signature, "cosine").where(F.col("cosine") >= least)
    return cos.select(F.col("query").alias("doc_key"), F.col("doc_key").alias("other"), "cosine"), members.select("doc_key", "copy_of")


def without_copies(ranked: DataFrame, copies: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """ranked (query, doc_key, similarity) without copies of the query or of what
    is ahead of them, the first k. copies and members are of near_duplicates();
    each row is told by its class and the classes near it. Only pairs of a
    query's own list matter, of which there are CANDIDATES at most."""
    pairs = copies.select(F.col("doc_key").alias("a"), F.col("other").alias("b"))
    pairs = pairs.union(pairs.select("b", "a"))
    of = members.select("doc_key", "copy_of")
    own = lambda rows, key, name: rows.join(of.select(F.col("doc_key").alias(key), F.col("copy_of").alias(name)), key, "left").withColumn(name, F.coalesce(name, key))
    rows = materialize(own(own(ranked, "doc_key", "class"), "query", "asked"))
    in_list = rows.select("query", F.col("class").alias("b")).union(rows.select("query", F.col("asked"))).distinct()
    near = rows.join(pairs, F.col("class") == F.col("a"), "left").join(in_list, ["query", "b"], "left_semi").groupBy("query", "doc_key").agg(F.collect_set("b").alias("like"))
    rows = rows.join(near, ["query", "doc_key"], "left")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["similarity", "doc_key"], ascending=[False, True])
        taken, seen = [], {pdf["asked"].iloc[0]}
        for key, score, own, like in zip(pdf.doc_key, pdf.similarity, pdf["class"], pdf.like):
            if len(taken) < k and own not in seen and (like is None or not seen.intersection(like)):
                taken.append((pdf["query"].iloc[0], key, score, np.int32(len(taken) + 1)))
                seen.add(own)
        return pd.DataFrame(taken, columns=["query", "doc_key", "similarity", "place"])

    return rows.groupBy("query").applyInPandas(choose, "query string, doc_key string, similarity double, place int")


def similar(corpus: DataFrame, queries: DataFrame, k: int = 20, features: Callable[[str], Column] | None = None) -> DataFrame:
    """query, doc_key, similarity and place: the k most similar documents of each query (doc_key), copies left out."""
    checked(k)
    if features is None:
        from . import pairs  # which is made of this

        blocks = materialize(pairs.in_blocks(pairs.vectors(corpus), pairs.DOCUMENTS))
        ranked = pairs.best(blocks, queries, CANDIDATES).select("query", "doc_key", "similarity").where("similarity > 0")
        return without_copies(ranked, *near_duplicates(simhashes(counts_by_document(corpus)), pairs.rows_of(blocks).select("doc_key", "features"), corpus.select("doc_key", "weak")), k)
    counted = materialize(by_document(counts(corpus, features)))
    signature = materialize(signatures(weights(corpus, counted)))
    asked = query_terms(signature.join(queries.select("doc_key"), "doc_key", "left_semi"))
    found = candidates(asked, signature)
    fields = field_vectors(counted, document_frequencies(counted), field_averages(corpus, counted))
    ranked = similarities(found, fields, signature).where("similarity > 0")
    return without_copies(ranked, *near_duplicates(simhashes(counted), signature, corpus.select("doc_key", "weak")), k)
