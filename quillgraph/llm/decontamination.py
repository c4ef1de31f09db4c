"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, in lower case. Every three-word sequence
of a test item is a seed, however often it occurs (items of fewer than three
words are one seed). A document that holds a seed of an item is aligned with
it: the words around the seeds against the item's words, +2 for equal words, -1
for others and for gaps. The score is the share of the item's own best score
(twice its words) that the alignment reaches; an item counts as leaked from
``least`` on. Passages that share too few words with the item to reach it are
not aligned; items are aligned as wholes, however long. Not found: copies edited
so densely that no three words in a row are left, though they may still score a
little over one half.

Documents don't move: the seeds of the items, sorted, are sent to the tasks in
blocks of at most ``block_bytes`` of text (16 bytes for each of a block's words),
and each document's seeds are looked up there. A benchmark beyond a block takes
another pass over the documents for each.

Cases: null or empty texts, and texts without words, match nothing, on either
side; repeated rows are each reported; items with the same words are each
reported; an empty table on either side gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, filtered, table

WORDS = re.compile(r"[^\W_]+")
SEED = 3
FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def words(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of a with b: its score, and where it begins and ends in b."""
    gaps = np.arange(len(b) + 1)
    row, began = np.zeros(len(b) + 1, np.int64), gaps.copy()
    best = (0, 0, 0)
    for x in a:
        up, diag = row - 1, np.concatenate(([0], row[:-1] + np.where(b == x, 2, -1)))
        t = np.maximum(np.maximum(up, diag), 0)
        from_ = np.where(t == 0, gaps, np.where(t == diag, np.concatenate(([0], began[:-1])), began))
        ahead = np.maximum.accumulate(t + gaps)  # a run of gaps in a costs one each
        at = np.maximum.accumulate(np.where(t + gaps == ahead, gaps, 0))
        row, began = ahead - gaps, from_[at]
        if (top := int(row.max())) > best[0]:
            j = int(row.argmax())
            best = (top, int(began[j]), j)
    return best


class Items:
    """A block of test items, as numbers of their own words, and where their seeds are."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.number: dict[str, int] = {}
        self.ids, self.words = [], []
        for i, t in rows:
            self.ids.append(i)
            self.words.append(np.array([self.number.setdefault(w, len(self.number) + 1) for w in words(t)], np.int64))
        made = [self.seeds_of(w) for w in self.words]
        size = [len(x) for x in made]
        seeds = np.concatenate([*made, np.zeros(0, np.uint64)])
        order = np.argsort(seeds, kind="stable")
        #: Seeds in order, and the item and the place in it of each.
        self.seeds, self.item = seeds[order], np.repeat(np.arange(len(made), dtype=np.int32), size)[order]
        self.place = np.concatenate([*(np.arange(n, dtype=np.int32) for n in size), np.zeros(0, np.int32)])[order]
        self.short = [(i, w) for i, w in enumerate(self.words) if 0 < len(w) < SEED]

    @staticmethod
    def seeds_of(numbers: np.ndarray) -> np.ndarray:
        """A hash for each three words in a row; unequal ones that meet cost an alignment."""
        w = numbers.astype(np.uint64)
        n = max(0, len(w) - SEED + 1)
        h = w[:n] * FACTORS[0]
        for k in range(1, SEED):
            h = (h ^ (h >> np.uint64(29))) * FACTORS[k] + w[k : k + n]
        return h

    def read(self, text: str | None) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, 0) for w in words(text)], np.int64)

    def hits(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items whose seeds own holds, and where each of them would begin by that, in order."""
        if len(own) < SEED or not len(self.seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = own > 0
        at = np.flatnonzero(known[:-2] & known[1:-1] & known[2:])
        s = self.seeds_of(own)[at]
        left, right = np.searchsorted(self.seeds, s, "left"), np.searchsorted(self.seeds, s, "right")
        n = right - left
        j = np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())
        item, start = self.item[j].astype(np.int64), np.repeat(at, n) - self.place[j]
        order = np.lexsort((start, item))
        return item[order], start[order]

    def leaks(self, text: str | None, least: float) -> list[tuple[int, float, int, int]]:
        """(item, score, first word, word after the last) of each item that the text leaks."""
        own = self.read(text)
        found, starts = self.hits(own)
        ends = np.flatnonzero(np.r_[found[1:] != found[:-1], True]) + 1 if len(found) else []
        near = {int(found[b - 1]): starts[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)} if len(found) else {}
        for i, w in self.short:
            n = len(w)
            same = np.flatnonzero(np.all([own[j : len(own) - n + 1 + j] == w[j] for j in range(n)], axis=0)) if len(own) >= n else []
            if len(same):
                near[i] = [int(same[0])]
        out: dict = {}
        for i, starts in near.items():
            item = self.words[i]
            need = least * 2 * len(item)
            slack = math.ceil(2 * len(item) - need)  # an alignment with more gaps scores less than need
            spans = []
            for s in starts:
                lo, hi = max(0, s - slack), min(len(own), s + len(item) + slack)
                if spans and lo <= spans[-1][1] and hi - spans[-1][0] <= 4 * len(item) + 4 * slack:
                    spans[-1][1] = max(hi, spans[-1][1])
                else:
                    spans.append([lo, hi])
            have, best = Counter(item.tolist()), (0, 0, 0)
            for lo, hi in spans:
                part = own[lo:hi]
                if 2 * (Counter(part[part > 0].tolist()) & have).total() < need:
                    continue
                score, a, b = align(item, part)
                if score > best[0]:
                    best = (score, lo + a, lo + b)
            if best[0] >= need:
                hit = (best[0] / (2 * len(item)), best[1], best[2])
                out[self.ids[i]] = max(out.get(self.ids[i], hit), hit)
        return [(i, *x) for i, x in out.items()]


def blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> list[Items]:
    """The items in blocks whose texts have block_bytes at most (or are one item)."""
    rows = items.where(F.col(text).rlike(r"[\p{L}\p{N}]")).select(F.col(item_id).alias("i"), F.col(text).alias("t"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = 2 * total // block_bytes + 1
    keyed = rows.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(n)))
    for b in range(n):
        if part := [(r["i"], r["t"]) for r in keyed.where(F.col("b") == b).orderBy("i", "t").collect()]:
            yield Items(part)


def find_leaks(docs: DataFrame, items: DataFrame, least: float = 0.5, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, item_id, score, first_word and end_word for each leak."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[doc_id].replace("bigint", "long")
    out = None
    for part in blocks(items, item_id, item_text, block_bytes):
        shared = spark.sparkContext.broadcast(part)

        def f(cols, shared=shared):
            rows = [(d, i, s, a, b) for d, t in zip(cols["d"], cols["t"]) for i, s, a, b in shared.value.leaks(t, least)]
            return dict(zip(("doc_id", "item_id", "score", "first_word", "end_word"), zip(*rows) if rows else ([],) * 5))

        found = by_batch(docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")), f"doc_id {kind}, item_id long, score double, first_word long, end_word long", f)
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], f"doc_id {kind}, item_id long, score double, first_word long, end_word long")


def without_leaks(docs: DataFrame, items: DataFrame, least: float = 0.5, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 32 << 20) -> DataFrame:
    """The rows of docs that leak no item."""
    for part in blocks(items, item_id, item_text, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        docs = filtered(docs, [text], lambda shared=shared: lambda texts: [not shared.value.leaks(t, least) for t in texts])
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that leak no item of the benchmark. Returns the columns of docs."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))
