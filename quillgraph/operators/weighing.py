"""BM25F weights and signatures of a corpus with little data on the way.

A weight needs the number of documents that hold its feature. Sending each posting
to its feature and back takes many times the size of the texts. Here documents lie
in cuts of about CUT characters, by a hash of their keys:

1. Of each cut, each of its features goes once, in order and compressed, to its
   bucket (by a hash of its words) with the number of the cut's documents that hold it.
2. A bucket adds these up and answers each cut with the sums alone, in the order in
   which the cut named its features. Features are compared by their names.
3. The cut's texts are counted again, and get their weights where they are. A
   document's row has all of its features, so signatures need no further shuffle.

So what travels are the texts (twice), each cut's features once, and the sums.

Cases: rows that share a key are one document; a row without a key counts for the
lengths and the number of documents and gets no weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS
from ..sources.scratch import materialize

FIELDS = ("title", "abstract", "body")
WEIGHTS, LENGTH_SHARES = (4.0, 2.0, 1.0), (0.3, 0.6, 0.75)
#: Characters of the texts of a cut, about, and cuts to a bucket.
CUT, CUTS_A_BUCKET = 4_000_000, 4
#: Features of a table of frequencies that are put into blocks at once.
DEALT = 500_000

BLOCK = "bucket int, cut int, size int, raw int, block binary"
WEIGHED = "doc_key string, features array<struct<feature: string, weight: double, in_title: boolean>>"


def pack(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def unpack(data: bytes, size: int) -> bytes:
    return pa.decompress(data, size, codec="zstd", asbytes=True) if size else b""


def hashes_of(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(np.array(words.to_pylist(), object), categorize=False) if len(words) else np.zeros(0, np.uint64)


def buckets_of(one: np.ndarray, two: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of features, by the hashes of a pair's words (the second is 0 for a single word)."""
    h = one * np.uint64(0x9E3779B97F4A7C15) + two * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def buckets_of_names(names: pa.Array, buckets: int) -> np.ndarray:
    """Buckets of features by their names (w:word, b:word word)."""
    parts = pc.split_pattern(pc.utf8_slice_codeunits(names, 2), " ")
    words = parts.flatten().dictionary_encode()
    h = hashes_of(words.dictionary)[words.indices.to_numpy(zero_copy_only=False)]
    first = parts.offsets.to_numpy()
    pair = np.diff(first) == 2
    two = np.zeros(len(names), np.uint64)
    two[pair] = h[first[:-1][pair] + 1]
    return buckets_of(h[first[:-1]], two, buckets)


def block_of(names: pa.Array, n: np.ndarray) -> bytes:
    """Sizes of names, a number for each, and the names."""
    if not len(names):
        return b""
    offsets = np.frombuffer(names.buffers()[1], np.int32)[names.offset :][: len(names) + 1]
    chars = names.buffers()[2]
    return np.diff(offsets).tobytes() + n.tobytes() + (bytes(memoryview(chars)[offsets[0] : offsets[-1]]) if chars is not None else b"")


class Cut:
    """The counts of a cut's documents. keys: its documents; names: its features in
    the order of bucket, then name; bounds: where buckets begin in it; doc, feature
    and tf (three fields) of its postings, by document and then by name."""

    def __init__(self, table: pa.Table, buckets: int):
        table = table.combine_chunks()
        column = lambda name: table.column(name).combine_chunks() if table.num_rows else pa.array([], table.schema.field(name).type)
        encoded = pc.dictionary_encode(column("doc_key"), null_encoding="encode")
        self.keys = encoded.dictionary
        own = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.keyed = self.keys.is_valid().to_numpy(zero_copy_only=False)
        self.base = np.zeros(len(self.keys), bool)
        self.base[own[column("base").to_numpy(zero_copy_only=False).astype(bool)]] = True
        words, at = [], []
        for k, name in enumerate(FIELDS):
            lists = pc.split_pattern(pc.fill_null(column(name), ""), " ")
            words.append(lists.flatten())
            at.append(np.repeat(np.arange(len(own)) * 3 + k, np.diff(lists.offsets.to_numpy())))
        at = np.concatenate(at)
        encoded = pa.concat_arrays(words).dictionary_encode()
        order = pc.sort_indices(encoded.dictionary).to_numpy()
        known = encoded.dictionary.take(pa.array(order)).cast(pa.string())
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        word = rank[encoded.indices.to_numpy(zero_copy_only=False)] if len(at) else np.zeros(0, np.int64)
        good = np.array([len(w) >= 2 and w not in STOP_WORDS and not (w.isascii() and w.isdigit()) for w in known.to_pylist()], bool)[word] if len(at) else np.zeros(0, bool)
        pair = np.flatnonzero(good[:-1] & good[1:] & (at[:-1] == at[1:]))
        n = max(1, len(known))
        # by name: pairs (b:) before words (w:), and a space before all that words are made of
        code = np.concatenate([word[pair] * n + word[pair + 1], n * n + word[good]])
        place = np.concatenate([at[pair], at[good]])
        codes, code = np.unique(code, return_inverse=True)
        doc, field = own[place // 3], place % 3
        held, posting = np.unique(doc * max(1, len(codes)) + code, return_inverse=True)
        self.tf = [np.bincount(posting[field == k], minlength=len(held)) for k in range(3)]
        self.lengths = np.stack([np.bincount(doc[field == k], minlength=len(self.keys)) for k in range(3)])
        self.doc, by_name = held // max(1, len(codes)), held % max(1, len(codes))
        single = codes >= n * n
        one, two = np.where(single, codes - n * n, codes // n), codes % n
        h = hashes_of(known)
        second = np.zeros(len(codes), np.uint64)
        second[~single] = h[two[~single]]
        bucket = buckets_of(h[one], second, buckets) if len(codes) else np.zeros(0, np.int64)
        order = np.argsort(bucket, kind="stable")
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))
        self.feature, self.by_name = where[by_name], by_name
        text = lambda values: known.take(pa.array(values)).cast(pa.string())
        s = single[order]
        pairs = pc.binary_join_element_wise(pc.binary_join_element_wise("b:", text(one[order][~s]), ""), text(two[order][~s]), " ")
        singles = pc.binary_join_element_wise("w:", text(one[order][s]), "")
        spread = np.empty(len(order), np.int64)
        spread[~s], spread[s] = np.arange(len(pairs)), len(pairs) + np.arange(len(singles))
        self.names = pa.concat_arrays([pairs, singles]).take(pa.array(spread))
        self.bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))

    def blocks(self, cut: int) -> pa.Table:
        """A row (BLOCK) for each bucket with the cut's features and how many counted documents hold each, and one of bucket -1: lengths of the counted."""
        counts = self.base[self.doc] & self.keyed[self.doc]
        n = np.bincount(self.feature[counts], minlength=len(self.names)).astype(np.int32)
        rows = {"bucket": [-1], "cut": [cut], "size": [0], "raw": [24], "block": [pack(self.lengths[:, self.base].sum(axis=1).astype(np.int64).tobytes())]}
        for b in np.flatnonzero(np.diff(self.bounds)):
            i, j = self.bounds[b], self.bounds[b + 1]
            raw = block_of(self.names.slice(i, j - i), n[i:j])
            for name, value in zip(rows, (b, cut, j - i, len(raw), pack(raw))):
                rows[name].append(value)
        return pa.table({k: pa.array(v, pa.binary() if k == "block" else pa.int32()) for k, v in rows.items()})

    def frequencies(self, answers: pa.Table) -> np.ndarray:
        """df of the names, of the buckets' answers."""
        rows = sorted(zip(*[answers.column(c).to_pylist() for c in ("bucket", "size", "raw", "block")]))
        df = np.concatenate([np.zeros(0, np.int32), *[np.frombuffer(unpack(block, raw), np.int32) for b, _, raw, block in rows if b >= 0]])
        if len(df) != len(self.names):
            raise RuntimeError("the texts of a cut changed while they were read")
        return df.astype(np.float64)

    def weights(self, df: np.ndarray, n_docs: int, averages: list[float]) -> np.ndarray:
        """The weight of each posting."""
        part = lambda k: np.where(self.tf[k] > 0, WEIGHTS[k] * self.tf[k] / (1 - LENGTH_SHARES[k] + LENGTH_SHARES[k] * self.lengths[k][self.doc] / averages[k]), 0.0)
        x = part(0) + part(1) + part(2)
        idf = np.log(1 + (np.maximum(n_docs - df, 0) + 0.5) / (df + 0.5))
        return idf[self.feature] * x * 2.2 / (x + 1.2)

    def rows(self, chosen: np.ndarray, weight: np.ndarray) -> pa.Table:
        """Rows (WEIGHED) of the chosen postings (indexes, by document) of documents with a key; documents without one of them have no row."""
        docs, starts = np.unique(self.doc[chosen], return_index=True)
        features = pa.StructArray.from_arrays([self.names.take(pa.array(self.feature[chosen])), pa.array(weight, pa.float64()), pa.array(self.tf[0][chosen] > 0, pa.bool_())], ["feature", "weight", "in_title"])
        ends = pa.array(np.append(starts, len(chosen)).astype(np.int32))
        return pa.table({"doc_key": self.keys.take(pa.array(docs)), "features": pa.ListArray.from_arrays(ends, features)})


def first_of(group: np.ndarray) -> np.ndarray:
    """The place, from 0, of each element within its group; groups lie together."""
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    return np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))


def chosen_for_signature(cut: Cut, weight: np.ndarray, title: int, total: int) -> np.ndarray:
    """Postings of the title's heaviest features first, then the heaviest of all, up to total of each document; ties by name."""
    held = np.flatnonzero(cut.keyed[cut.doc])
    titled = held[cut.tf[0][held] > 0]
    titled = titled[np.lexsort((cut.by_name[titled], -weight[titled], cut.doc[titled]))]
    own = np.zeros(len(weight), bool)
    own[titled[first_of(cut.doc[titled]) < title]] = True
    held = held[np.lexsort((cut.by_name[held], -weight[held], ~own[held], cut.doc[held]))]
    return held[first_of(cut.doc[held]) < total]


def unit(doc: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Unit vectors by document, each weight kept as one of 65,535 steps."""
    length = lambda w: np.sqrt(np.bincount(doc, weights=w * w))[doc] if len(doc) else w
    weight = np.maximum(1.0, np.floor(weight / length(weight) * 65535 + 0.5)) / 65535
    return weight / length(weight)


class Corpus:
    """The texts (doc_key, title, abstract, body) in cuts; what ``base`` names is counted for the statistics, all of it if None."""

    def __init__(self, corpus: DataFrame, base: str | None = None):
        bare = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
        chars, docs, based = corpus.agg(F.sum(sum((F.length(F.coalesce(c, F.lit(""))) for c in FIELDS), F.lit(0))), F.count("*"), F.sum(F.expr(base or "true").cast("int"))).first()
        self.cuts = max(1, ceil((chars or 0) / CUT))
        self.buckets = max(1, ceil(self.cuts / CUTS_A_BUCKET))
        self.n_docs, self.base = based or 0, base
        self.texts = corpus.select("doc_key", *[bare(c).alias(c) for c in FIELDS], F.expr(base or "true").alias("base"), F.pmod(F.xxhash64("doc_key"), F.lit(self.cuts)).cast("int").alias("cut"))

    def blocks(self) -> DataFrame:
        buckets = self.buckets

        def make(key: tuple, table: pa.Table) -> pa.Table:
            return Cut(table, buckets).blocks(key[0].as_py())

        return self.texts.groupBy("cut").applyInArrow(make, BLOCK)

    def answers(self, blocks: DataFrame | None = None, frequencies: DataFrame | None = None) -> DataFrame:
        """df of each block's features (BLOCK, the sums instead of the features): counted here, or looked up (feature, df)."""
        blocks, buckets = self.blocks() if blocks is None else blocks, self.buckets
        if frequencies is None:
            return materialize(blocks.groupBy("bucket").applyInArrow(lambda table: answer(table, None), BLOCK))

        def dealt(batches):
            rows, held = [], 0
            for batch in batches:
                rows.append(batch)
                held += batch.num_rows
                if held >= DEALT:
                    yield from packed(pa.Table.from_batches(rows), buckets)
                    rows, held = [], 0
            if held:
                yield from packed(pa.Table.from_batches(rows), buckets)

        known = frequencies.select("feature", F.col("df").cast("int").alias("df")).mapInArrow(dealt, BLOCK)
        return materialize(blocks.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(answer, BLOCK))

    def frequencies(self, blocks: DataFrame | None = None) -> DataFrame:
        """feature and df."""
        blocks = self.blocks() if blocks is None else blocks
        return blocks.groupBy("bucket").applyInArrow(summed, "feature string, df long")

    def averages(self, blocks: DataFrame) -> list[float]:
        """The mean length of each field of what is counted, 1 where that is 0; of blocks or answers."""
        sums = np.zeros(3, np.int64)
        for r in blocks.where("bucket = -1").select("block").toLocalIterator():  # three numbers a cut
            sums += np.frombuffer(unpack(bytes(r.block), 24), np.int64)
        return [float(s) / self.n_docs if s > 0 else 1.0 for s in sums]

    def weighed(self, answers: DataFrame, averages: list[float], n_docs: int, give: Callable[..., pa.Table], schema: str, frequencies: bool = False) -> DataFrame:
        """What ``give`` makes of each cut and the weights of its postings, with ``frequencies`` of the cut, df of its names and the weights."""
        buckets = self.buckets

        def weigh(texts: pa.Table, sums: pa.Table) -> pa.Table:
            cut = Cut(texts, buckets)
            df = cut.frequencies(sums)
            weight = cut.weights(df, n_docs, averages)
            return give(cut, df, weight) if frequencies else give(cut, weight)

        return self.texts.groupBy("cut").cogroup(answers.where("bucket >= 0").groupBy("cut")).applyInArrow(weigh, schema)


def packed(known: pa.Table, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of feature and df as blocks (BLOCK) of their buckets, in order of names."""
    known = known.combine_chunks().sort_by("feature")
    bucket = buckets_of_names(known.column("feature").combine_chunks(), buckets)
    known, bucket = known.take(pa.array(np.argsort(bucket, kind="stable"))), np.sort(bucket)
    names, df = known.column("feature").combine_chunks(), known.column("df").to_numpy().astype(np.int32)
    rows = {name: [] for name in ("bucket", "cut", "size", "raw", "block")}
    for b in np.unique(bucket):
        i, j = np.searchsorted(bucket, [b, b + 1])
        raw = block_of(names.slice(i, j - i), df[i:j])
        for name, value in zip(rows, (b, -1, j - i, len(raw), pack(raw))):
            rows[name].append(value)
    yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "block" else pa.int32()) for k, v in rows.items()], names=list(rows))


class Statistics:
    """What an epoch keeps of the counted documents of a Corpus: averages (one row: n_docs and a mean for each field) and frequencies."""

    def __init__(self, corpus: Corpus, blocks: DataFrame):
        row = (corpus.n_docs, *corpus.averages(blocks))
        self.averages = blocks.sparkSession.createDataFrame([row], "n_docs long, avg0 double, avg1 double, avg2 double")
        self.frequencies = corpus.frequencies(blocks)


def read(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The names, counts and sizes of a bucket's blocks, one block behind the other."""
    sizes, n, chars, held = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [], []
    for size, raw, block in zip(*[table.column(c).to_pylist() for c in ("size", "raw", "block")]):
        data = unpack(block, raw)
        sizes.append(np.frombuffer(data, np.int32, size))
        n.append(np.frombuffer(data, np.int32, size, 4 * size))
        chars.append(data[8 * size :])
        held.append(size)
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)])
    names = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(chars)))
    return names, np.concatenate(n), np.array(held, np.int64)


def answer(table: pa.Table, known: pa.Table | None) -> pa.Table:
    """A bucket's answers to its blocks."""
    if not table.num_rows or table.column("bucket")[0].as_py() < 0:
        return table
    names, n, held = read(table)
    encoded = names.dictionary_encode()
    code = encoded.indices.to_numpy(zero_copy_only=False)
    if known is None:
        df = np.bincount(code, weights=n, minlength=len(encoded.dictionary)).astype(np.int32)
    else:
        features, sums, _ = read(known)
        place = pc.fill_null(pc.index_in(encoded.dictionary, value_set=features), len(features)).to_numpy(zero_copy_only=False)
        df = np.append(sums, np.int32(0))[place].astype(np.int32)
    ends = np.cumsum(held)
    sums = df[code]
    blocks = [sums[e - h : e].tobytes() for e, h in zip(ends, held)]
    return pa.table({"bucket": table.column("bucket"), "cut": table.column("cut"), "size": table.column("size"), "raw": pa.array([len(b) for b in blocks], pa.int32()), "block": pa.array([pack(b) for b in blocks], pa.binary())})


def summed(table: pa.Table) -> pa.Table:
    """feature and df of a bucket."""
    if not table.num_rows or table.column("bucket")[0].as_py() < 0:
        return pa.table({"feature": pa.array([], pa.string()), "df": pa.array([], pa.int64())})
    names, n, _ = read(table)
    encoded = names.dictionary_encode()
    df = np.bincount(encoded.indices.to_numpy(zero_copy_only=False), weights=n, minlength=len(encoded.dictionary)).astype(np.int64)
    order = pc.sort_indices(encoded.dictionary).to_numpy()
    order = order[df[order] > 0]
    return pa.table({"feature": encoded.dictionary.take(pa.array(order)).cast(pa.string()), "df": pa.array(df[order])})


def with_weights(corpus: DataFrame, give: Callable[[Cut, np.ndarray], pa.Table], schema: str) -> DataFrame:
    c = Corpus(corpus)
    answers = c.answers()
    return c.weighed(answers, c.averages(answers), c.n_docs, give, schema)


def totals_of(cut: Cut, weight: np.ndarray) -> pa.Table:
    held = cut.keyed[cut.doc]
    docs, starts = np.unique(cut.doc[held], return_index=True)
    w = weight[held]
    top = np.maximum.reduceat(w, starts) if len(starts) else w
    total = np.bincount(cut.doc[held], weights=w, minlength=len(cut.keys))[docs]
    return pa.table({"doc_key": cut.keys.take(pa.array(docs)), "features": pa.array(np.diff(np.append(starts, len(w))), pa.int64()), "total": pa.array(total, pa.float64()), "top": pa.array(top, pa.float64())})


TOTALS = "doc_key string, features long, total double, top double"


def totals(corpus: DataFrame) -> DataFrame:
    """doc_key, features, total and top: how many weights a document has, their sum and the greatest."""
    return with_weights(corpus, totals_of, TOTALS)


def signatures(corpus: DataFrame, title: int, total: int) -> DataFrame:
    """WEIGHED: the signatures of the documents, unit vectors of ``total`` features at most, a row each."""

    def give(cut: Cut, weight: np.ndarray) -> pa.Table:
        chosen = chosen_for_signature(cut, weight, title, total)
        return cut.rows(chosen, unit(cut.doc[chosen], weight[chosen]))

    return with_weights(corpus, give, WEIGHED)
