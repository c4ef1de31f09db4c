"""Suffix-array dedup: every byte that a repeated 200-byte string covers goes.

The index is a logarithmic family: a batch gets suffix arrays (places of its
windows of ``length`` bytes, sorted by their bytes), is scanned for equal
neighbours, merge-scanned against the suffix arrays of every level there is, and
then becomes a level itself; levels of equal size merge, their sorted arrays
being merged, into one of twice the size. Levels are Parquet tables in a folder,
so batches that come later, in another session too, meet those of before
(``Family``).

The arrays are dealt to buckets by content. Every window names the place of its
least hashed ``GRAM`` bytes, its anchor, which depends on the window alone;
windows in a row with the same anchor are a segment. Segments are cut into
pieces of ``PIECE`` windows at places counted from the anchor, and a piece's key
is made of the anchor, the place and the bytes that all windows there have in
common. Equal windows stand in pieces of the same key, so of the same bucket.

When a whole corpus is there at once (``dedup``), what can't be repeated or is so
beyond doubt needs no array. Equal segments, then equal pieces, are classes (by
128 bits of hash) with a weight: those of two copies or more are repeated as
they are, and one stands for all in what follows. Anchors and keys that a single
class has to itself go. What is left are pieces that share a key and differ, by
a few bytes at their ends; a key that more than ``most`` of them share, too many
for a task, is cut into single windows, which again become classes.

Cases: a null text is empty; texts shorter than a window keep everything; rows
with equal texts are copies of each other, so all of a long enough text goes;
texts of any length are read in chunks that overlap by a window; an empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, table

LENGTH = 200
GRAM = 32
PIECE = 16
CHUNK = 1 << 19
#: Bits of a place in a chunk, which has less than CHUNK bytes and a window more.
PLACE = np.uint64((1 << 26) - 1)
TABLE = np.random.default_rng(11).integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
BACK = np.array([pow(int(b), -1, 1 << 64) for b in BASE], np.uint64)


class Powers:
    """Powers of the two bases and of their inverses, as far as needed."""

    def __init__(self):
        self.n = 0

    def upto(self, n: int) -> None:
        if n > self.n:
            grow = lambda b: np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, b, np.uint64))))
            self.n, self.up, self.down = n, [grow(b) for b in BASE], [grow(b) for b in BACK]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def segments(data: np.ndarray, begin: np.ndarray, length: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """Of texts that lie end to end: each segment's text, first window (within
    the text), number of windows, anchor (counted from the first window), hash
    of the anchor, and two hashes of all bytes."""
    n, w = len(data), length - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return (none,) * 7
    powers.upto(n + 1)
    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(TABLE[k][data] * powers.up[k][:n]))) for k in (0, 1)]
    grams = mixed((sums[0][GRAM:] - sums[0][:-GRAM]) * powers.down[0][: n - GRAM + 1])
    key = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    # the least of each w in a row, from running minima of blocks of w
    blocks = -(-len(key) // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    square = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    least = np.minimum(back[:windows], ahead[w - 1 : w - 1 + windows])
    at = (least & PLACE).astype(np.int64)
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    start = np.arange(windows)
    whole = doc[:windows] == doc[length - 1 : length - 1 + windows]
    start, at = start[whole], at[whole]
    if not len(start):
        return (none,) * 7
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])
    first, anchor = start[new], at[new]
    count = np.diff(np.r_[new, len(start)])
    end = first + count - 1 + length
    one, two = (mixed((sums[k][end] - sums[k][first]) * powers.down[k][first]) ^ (count.astype(np.uint64) << np.uint64(48)) for k in (0, 1))
    return doc[first], first - begin[doc[first]], count, anchor - first, grams[anchor].view(np.int64), one.view(np.int64), two.view(np.int64)


def texts(batch: pa.RecordBatch, at: int, length: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Of a string column: first row, bytes and offsets of pieces of about CHUNK
    bytes. With a length, texts beyond CHUNK come in parts that overlap by a
    window less a byte; then the last number says where in its text a part begins."""
    x = batch.column(at).cast(pa.large_string()).fill_null("")
    begin = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1]
    data = np.frombuffer(x.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(x):
        j = max(i + 1, int(np.searchsorted(begin, begin[i] + CHUNK, "right")) - 1)
        if length and begin[j] - begin[i] > CHUNK + length:
            for k in range(begin[i], begin[j] - length + 1, CHUNK):
                part = data[k : min(begin[j], k + CHUNK + length - 1)]
                yield i, part, np.array([0, len(part)], np.int64), int(k - begin[i])
        else:
            yield i, data[begin[i] : begin[j]], begin[i : j + 1] - begin[i], 0
        i = j


def key_of(b: bytes) -> tuple[int, int]:
    """128 bits of hash, as two numbers."""
    h = xxhash.xxh3_128_digest(b)
    return int.from_bytes(h[:8], signed=True), int.from_bytes(h[8:], signed=True)


def keys_of(column: pa.Array) -> list[tuple[int, int]]:
    return [key_of((t or "").encode()) for t in column.to_pylist()]


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """A row for each segment: anchor's hash m, hashes s and s2, text (x, y), lo
    and windows, weight (copies in the same batch)."""
    names = ["m", "s", "s2", "x", "y", "lo", "windows", "anchor", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            keys = keys_of(b.column(0))
            weight, once = Counter(keys), {k: i for i, k in enumerate(keys)}
            x, y = np.array(keys, np.int64).reshape(-1, 2).T
            copies = np.array([weight[k] if once[k] == i else 0 for i, k in enumerate(keys)], np.int64)
            for at, data, begin, base in texts(b, 0, length):
                doc, lo, windows, anchor, m, s, s2 = segments(data, begin, length, powers)
                doc = doc + at
                keep = copies[doc] > 0
                doc = doc[keep]
                yield pa.RecordBatch.from_arrays([pa.array(v[keep]) for v in (m, s, s2)] + [pa.array(x[doc]), pa.array(y[doc])] + [pa.array(v.astype(np.int32)) for v in (lo[keep] + base, windows[keep], anchor[keep], copies[doc])], names=names)

    return docs.select("text").mapInArrow(run, "m long, s long, s2 long, x long, y long, lo int, windows int, anchor int, weight int")


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, x and y, and the text, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for b in batches:
            for at, data, begin, _ in texts(b, 1):
                raw = [data[i:j].tobytes() for i, j in zip(begin[:-1], begin[1:])]
                x, y = np.array([key_of(t) for t in raw], np.int64).reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(raw)), pa.array(x), pa.array(y), pa.array([packer.compress(t) for t in raw], pa.binary())], names=["doc_id", "x", "y", "z"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x long, y long, z binary")


SEGMENT = {"g": pa.int64(), "x": pa.int64(), "y": pa.int64(), "lo": pa.int32(), "windows": pa.int32(), "anchor": pa.int32(), "multi": pa.bool_(), "data": pa.binary()}
CUT = {"g": pa.int64(), "h": pa.int64(), "h2": pa.int64(), "x": pa.int64(), "y": pa.int64(), "lo": pa.int32(), "windows": pa.int32(), "anchor": pa.int32(), "multi": pa.bool_(), "of": pa.int32()}
SQL = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.binary(): "binary"}


def schema(kinds: dict) -> str:
    return ", ".join(f"{k} {SQL[t]}" for k, t in kinds.items())


def rows_of(out: list[tuple], kinds: dict) -> pa.RecordBatch:
    cols = list(zip(*out)) if out else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.values())], names=list(kinds))


def with_bytes(found: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """SEGMENT rows of the segments found (g, x, y, lo, windows, anchor, multi)."""
    by_text = found.groupBy("x", "y").agg(F.collect_list(F.struct("g", "lo", "windows", "anchor", "multi")).alias("found"))
    z = packed(docs).select("x", "y", "z").join(by_text.select("x", "y").hint("shuffle_hash"), ["x", "y"], "left_semi").dropDuplicates(["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y, z, found in zip(*(b.column(k).to_pylist() for k in range(4))):
                text = zstandard.decompress(z)
                yield rows_of([(f["g"], x, y, f["lo"], f["windows"], f["anchor"], f["multi"], text[f["lo"] : f["lo"] + f["windows"] - 1 + length]) for f in found], SEGMENT)

    return z.join(by_text, ["x", "y"]).select("x", "y", "z", "found").mapInArrow(run, schema(SEGMENT))


def cut(g: int, lo: int, windows: int, anchor: int, data: bytes, most: int, length: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """Key, first window, number of windows, anchor and bytes of the pieces of at
    most ``most`` windows, at places counted from the anchor."""
    k = 0
    while k < windows:
        place = (anchor - k) // most
        nearest = anchor - place * most  # the window of this place that is nearest to the anchor
        last = min(windows - 1, nearest)
        common = data[nearest : nearest - most + 1 + length]
        yield key_of(b"%d %d " % (g, place) + common)[0], lo + k, last - k + 1, anchor - k, data[k : last + length]
        k = last + 1


def pieces_of(rows: DataFrame, most: int, length: int) -> DataFrame:
    """SEGMENT rows of the pieces of SEGMENT rows, with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield rows_of([(k, x, y, at, n, a, multi, part) for g, x, y, lo, windows, anchor, multi, data in zip(*(c.to_pylist() for c in b.columns)) for k, at, n, a, part in cut(g, lo, windows, anchor, data, most, length)], SEGMENT)

    return rows.select(*SEGMENT).mapInArrow(run, schema(SEGMENT))


def hashed_pieces(rows: DataFrame, most: int, length: int) -> DataFrame:
    """CUT rows: the pieces by hashes of their bytes; ``of`` is where their SEGMENT row begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield rows_of([(k, *key_of(part), x, y, at, n, a, multi, lo) for g, x, y, lo, windows, anchor, multi, data in zip(*(c.to_pylist() for c in b.columns)) for k, at, n, a, part in cut(g, lo, windows, anchor, data, most, length)], CUT)

    return rows.select(*SEGMENT).mapInArrow(run, schema(CUT))


def bytes_of_pieces(pieces: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """SEGMENT rows of CUT rows (g, x, y, lo, windows, anchor, multi, of), with bytes from the rows they were cut from."""
    wanted = pieces.groupBy("x", "y", F.col("of").alias("lo")).agg(F.collect_list(F.struct("g", F.col("lo").alias("at"), "windows", "anchor", "multi")).alias("found"))  # at most a row's own pieces
    whole = rows.select("x", "y", "lo", "data").join(wanted, ["x", "y", "lo"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield rows_of([(f["g"], x, y, f["at"], f["windows"], f["anchor"], f["multi"], data[f["at"] - lo : f["at"] - lo + f["windows"] - 1 + length]) for x, y, lo, data, found in zip(*(c.to_pylist() for c in b.columns)) for f in found], SEGMENT)

    return whole.select("x", "y", "lo", "data", "found").mapInArrow(run, schema(SEGMENT))


def covered(rows: DataFrame, length: int) -> DataFrame:
    return rows.select("x", "y", "lo", (F.col("lo") + F.col("windows") - 1 + length).cast("int").alias("hi"))


def in_groups(rows: DataFrame, most: int, length: int) -> tuple[DataFrame, list[DataFrame]]:
    """Pieces, at most ``most`` of a key, that the arrays have to tell apart, and
    SPAN rows of those that are equal as they are. rows: SEGMENT rows of different bytes."""
    small, spans = [], []
    least = F.min(F.struct("x", "y", "lo", "windows", "anchor", "of"))
    for size in (PIECE, 1):
        pieces = materialize(hashed_pieces(rows, size, length))
        one = pieces.groupBy("g", "h", "h2").agg(least.alias("r"), F.count("*").alias("n"), F.max("multi").alias("multi"))
        one = materialize(one.select("g", "h", "h2", "r.*", "n", (F.col("multi") | (F.col("n") > 1)).alias("multi")))
        spans.append(covered(pieces.where("not multi").join(one.where("n > 1").select("g", "h", "h2"), ["g", "h", "h2"]), length))
        classes = one.join(one.groupBy("g").agg(F.count("*").alias("kinds")).where("kinds > 1"), "g")
        # a key of single windows has one class, but for a collision of its hash
        crowded = F.col("kinds") > most if size > 1 else F.lit(False)
        small.append(bytes_of_pieces(classes.where(~crowded), rows, length))
        large = classes.where(crowded)
        if size == 1 or large.isEmpty():
            break
        rows = materialize(bytes_of_pieces(large, rows, length))
    return reduce(DataFrame.union, small), spans


LEVEL = "bucket long, data binary, begin binary, x binary, y binary, lo binary, multi binary, places binary"
LEVEL_COLUMNS = ("data", "begin", "x", "y", "lo", "multi", "places")
SPAN = "x long, y long, lo int, hi int"


class Suffixes:
    """One bucket of a level: pieces end to end, and the places of their windows
    in the order of the windows' bytes."""

    def __init__(self, data, begin, x, y, lo, multi, places, length):
        self.data, self.begin, self.x, self.y, self.lo, self.multi, self.places, self.length = data, begin, x, y, lo, multi, places, length

    @classmethod
    def of(cls, row: dict, length: int) -> Suffixes:
        kinds = (np.uint8, np.int64, np.int64, np.int64, np.int32, np.bool_, np.int32)
        return cls(*(np.frombuffer(row[k], t) for k, t in zip(LEVEL_COLUMNS, kinds)), length)

    def row(self) -> list[bytes]:
        return [v.tobytes() for v in (self.data, self.begin, self.x, self.y, self.lo, self.multi, self.places)]

    def keys(self, places: np.ndarray) -> np.ndarray:
        """The windows' bytes; one more each, so that none is zero, which numpy's strings can't end in (UTF-8 has no byte 255)."""
        if not len(places):
            return np.zeros(0, f"S{self.length}")
        windows = np.lib.stride_tricks.sliding_window_view(self.data + np.uint8(1), self.length)
        return np.ascontiguousarray(windows[places]).view(f"S{self.length}").ravel()

    def spans(self, places: np.ndarray) -> list[np.ndarray]:
        """x, y, lo, hi of the runs of the windows at places, without what is repeated as a whole anyway."""
        places = np.unique(places)
        piece = np.searchsorted(self.begin, places, "right") - 1
        keep = ~self.multi[piece]
        places, piece = places[keep], piece[keep]
        if not len(places):
            return [np.zeros(0, np.int64)] * 4
        first = np.flatnonzero(np.r_[True, (places[1:] != places[:-1] + 1) | (piece[1:] != piece[:-1])])
        last = np.r_[first[1:], len(places)] - 1
        own = piece[first]
        lo = self.lo[own] + places[first] - self.begin[own]
        return [self.x[own], self.y[own], lo, lo + (places[last] - places[first]) + self.length]


def bucketed(pieces: DataFrame, buckets: int, length: int) -> DataFrame:
    """A level: suffix arrays of the pieces (SEGMENT rows), one for each bucket."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        size = pdf["data"].map(len).to_numpy()
        begin = np.cumsum(size) - size
        n = pdf["windows"].to_numpy()
        places = (np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())).astype(np.int32)
        b = Suffixes(np.frombuffer(b"".join(pdf["data"]), np.uint8), begin.astype(np.int64), pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["lo"].to_numpy(np.int32), pdf["multi"].to_numpy(bool), places, length)
        b.places = places[np.argsort(b.keys(places), kind="stable")]
        return pd.DataFrame([[pdf["bucket"].iloc[0], *b.row()]], columns=["bucket", *LEVEL_COLUMNS])

    return pieces.withColumn("bucket", F.pmod("g", F.lit(buckets)).cast("long")).groupBy("bucket").applyInPandas(build, LEVEL)


def spans_of(df: DataFrame, found) -> DataFrame:
    """SPAN rows that found(row) gives for each row of df, as lists of four arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # one at a time: a row is a bucket
                for x, y, lo, hi in found(b.slice(i, 1).to_pylist()[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), *[pa.array(v.astype(np.int32)) for v in (lo, hi)]], names=["x", "y", "lo", "hi"])

    return df.mapInArrow(run, SPAN)


def equal_neighbours(level: DataFrame, length: int) -> DataFrame:
    def found(row):
        b = Suffixes.of(row, length)
        k = b.keys(b.places)
        same = k[1:] == k[:-1]
        return [b.spans(b.places[np.r_[False, same] | np.r_[same, False]])]

    return spans_of(level, found)


def beside(old: DataFrame, new: DataFrame, how: str) -> DataFrame:
    two = lambda df, name: df.select("bucket", F.struct(*LEVEL_COLUMNS).alias(name))
    return two(old, "old").hint("merge").join(two(new, "new"), "bucket", how)


def merge_scan(old: DataFrame, new: DataFrame, length: int) -> DataFrame:
    """SPAN rows of windows that stand in both levels."""

    def found(row):
        a, b = Suffixes.of(row["old"], length), Suffixes.of(row["new"], length)
        ka, kb = a.keys(a.places), b.keys(b.places)
        left, right = np.searchsorted(ka, kb, "left"), np.searchsorted(ka, kb, "right")
        hit = right > left
        edges = np.bincount(left[hit], minlength=len(ka) + 1) - np.bincount(right[hit], minlength=len(ka) + 1)
        return [b.spans(b.places[hit]), a.spans(a.places[np.cumsum(edges)[:-1] > 0])]

    return spans_of(beside(old, new, "inner"), found)


def merged(old: DataFrame, new: DataFrame, length: int) -> DataFrame:
    """One level of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                parts = [Suffixes.of(row[k], length) for k in ("old", "new") if row[k]]
                if len(parts) == 2:
                    a, b = parts
                    n = len(a.data)
                    places = np.concatenate((a.places, b.places + np.int32(n)))
                    order = np.argsort(np.concatenate((a.keys(a.places), b.keys(b.places))), kind="stable")  # two sorted runs
                    both = lambda k: np.concatenate((getattr(a, k), getattr(b, k)))  # noqa: B023, E731
                    parts = [Suffixes(both("data"), np.concatenate((a.begin, b.begin + n)), both("x"), both("y"), both("lo"), both("multi"), places[order], length)]
                yield pa.RecordBatch.from_arrays([pa.array([row["bucket"]], pa.int64()), *[pa.array([v], pa.binary()) for v in parts[0].row()]], names=["bucket", *LEVEL_COLUMNS])

    return beside(old, new, "full").mapInArrow(run, LEVEL)


class Family:
    """A logarithmic family of levels in a folder that all executors see.

    ``insert`` finds the windows that a batch repeats, in itself or of the levels,
    and adds it; a level has 2 ** rank batches, no two the same rank. What is in
    the folder stays, so a family can be opened again; ``levels.json`` there names
    the levels, by rank, and the number of buckets, which is set once."""

    def __init__(self, spark: SparkSession, folder: str, length: int = LENGTH, buckets: int = 1):
        self.spark, self.folder, self.length, self.buckets = spark, folder, length, buckets
        self.levels: list[tuple[int, str]] = []

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Family:
        rows = spark.read.schema("rank int, path string, length int, buckets long").json(f"{folder}/levels.json").collect()
        family = cls(spark, folder, rows[0]["length"], rows[0]["buckets"])
        family.levels = sorted(((r["rank"], r["path"]) for r in rows if r["path"]), reverse=True)
        return family

    def read(self, path: str) -> DataFrame:
        return self.spark.read.schema(LEVEL).parquet(path)

    def written(self, level: DataFrame) -> str:
        path = f"{self.folder}/level-{uuid.uuid4().hex}"
        level.write.option("compression", "zstd").parquet(path)
        return path

    def insert(self, pieces: DataFrame, last: bool = False) -> list[DataFrame]:
        """SPAN rows of the repeated windows of a batch (SEGMENT rows of pieces);
        after the last batch nothing is merged or named in the folder."""
        path, rank = self.written(bucketed(pieces, self.buckets, self.length)), 0
        new = self.read(path)
        spans = [covered(pieces.where("multi"), self.length), equal_neighbours(new, self.length), *[merge_scan(self.read(p), new, self.length) for _, p in self.levels]]
        while not last and self.levels and self.levels[-1][0] == rank:
            path, rank = self.written(merged(self.read(self.levels.pop()[1]), self.read(path), self.length)), rank + 1
        self.levels.append((rank, path))
        if not last:
            rows = [(r, p, self.length, self.buckets) for r, p in self.levels]
            self.spark.createDataFrame(rows, "rank int, path string, length int, buckets long").coalesce(1).write.mode("overwrite").json(f"{self.folder}/levels.json")
        return spans


def all_pieces(docs: DataFrame, length: int = LENGTH, text: str = "text") -> DataFrame:
    """SEGMENT rows of all pieces of all texts, for a family that goes on: what
    isn't repeated yet may be by a later batch. Equal texts of a batch count as
    one that is repeated."""
    docs = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = anchors(docs, length).groupBy("m", "x", "y", "lo", "windows", "anchor").agg((F.sum("weight") > 1).alias("multi")).withColumnRenamed("m", "g")
    return pieces_of(with_bytes(rows, docs, length), PIECE, length)


def repeated(docs: DataFrame, length: int, batches: int, most: int, windows_per_bucket: int = 25_000) -> DataFrame:
    """SPAN rows that cover every byte of a repeated string; x and y name a text."""
    spark = docs.sparkSession
    rows = anchors(docs, length)
    often = rows.groupBy("m").agg(F.sum("weight").alias("k")).where("k > 1").drop("k")
    rows = materialize(rows.join(often, "m"))
    # classes of equal segments, each named by its first
    least = F.min(F.struct("x", "y", "lo", "windows", "anchor"))
    classes = materialize(rows.groupBy("m", "s", "s2").agg((F.sum("weight") > 1).alias("multi"), least.alias("r")))
    kinds = classes.groupBy("m").agg(F.count("*").alias("kinds")).where("kinds > 1").drop("kinds")
    open_ = classes.join(kinds, "m").select(F.col("m").alias("g"), "r.*", "multi")
    full = rows.join(classes.where("multi").select("m", "s", "s2"), ["m", "s", "s2"])
    pieces, spans = in_groups(materialize(with_bytes(open_, docs, length)), most, length)
    pieces = materialize(pieces)
    total = pieces.agg(F.coalesce(F.sum("windows"), F.lit(0))).first()[0]
    family = Family(spark, f"{shared_dir(spark)}/family-{uuid.uuid4().hex}", length, total // windows_per_bucket + 1)
    spans = [covered(full, length), *spans]
    for k in range(batches):
        spans += family.insert(pieces.where(F.pmod("x", F.lit(batches)) == k), last=k + 1 == batches)
    return reduce(DataFrame.union, spans)


def dedup(docs: DataFrame, length: int = LENGTH, batches: int = 4, most: int = 5_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, kept (the bytes that stay), n_removed, and starts and
    ends of the runs removed, for each row of docs."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    spans = repeated(docs, length, batches, most).groupBy("x", "y").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    spans = spans.select("x", "y", F.col("spans.lo").alias("lo"), F.col("spans.hi").alias("hi"))
    rows = packed(docs).join(spans, ["x", "y"], "left").select("doc_id", "z", "lo", "hi")
    names = ["doc_id", "n_bytes", "kept", "n_removed", "starts", "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[] for _ in range(5)]
            for z, lo, hi in zip(*(b.column(k) for k in (1, 2, 3))):
                text = zstandard.decompress(z.as_py())
                starts, ends = joined(lo.values.to_numpy(), hi.values.to_numpy()) if lo.is_valid and len(lo) else ([], [])
                cuts = [0, *[v for pair in zip(starts, ends) for v in pair], len(text)]
                kept = b"".join(text[i:j] for i, j in zip(cuts[::2], cuts[1::2]))
                for k, v in enumerate((len(text), kept, len(text) - len(kept), starts, ends)):
                    out[k].append(v)
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v, t) for v, t in zip(out, kinds)]], names=names)

    return rows.mapInArrow(run, "doc_id long, n_bytes long, kept binary, n_removed long, starts array<int>, ends array<int>")


def joined(lo: np.ndarray, hi: np.ndarray) -> tuple[list[int], list[int]]:
    """Overlapping and touching spans as one."""
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    new = np.r_[True, lo[1:] > reach[:-1]]
    return lo[new].tolist(), reach[np.r_[np.flatnonzero(new)[1:], len(lo)] - 1].tolist()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
