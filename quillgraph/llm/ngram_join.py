"""N-gram Jaccard join: documents whose sets of five-word shingles are similar.

A document's words are its runs without ASCII white space, A-Z lower-cased; its
set holds the distinct shingles (a shorter text is one shingle, one without
words has none and links with nothing). Two documents link from a Jaccard
similarity of ``percent`` / 100 on. The result names each document's component.

Documents of equal sets are one class before anything is compared. All shingles
have one global order, and two classes can only link if the first
n - ceil(t * n) + 1 shingles of each (n: the set's size, t: the threshold) share
one. The order is: a hash-chosen part of the shingles, which is what is counted
over all documents, rarest first; then the others by hash; then those that a
thousandth of all documents or more hold, by hash. Few documents need any but
the first part, and shingles that only one document holds leave at once.

Candidates share a prefix shingle and pass the length filter, the positional
filter (what can still be common after the first common one) and the suffix
filter: a set's sketch says for each of 512 parts of the hash range whether an
odd number of its shingles falls there, and where two sketches differ, so do the
sets. Each pair is then verified once, on the texts. Large groups of
near copies don't become all their pairs: a class is first paired with its
neighbours in the order of sizes and with the class of fewest shingles of its
own; those further away and the nearest of the largest component follow only if
what is linked so far leaves the two apart, and the last round takes all pairs
that are still apart, so no link between components is lost.

Cases: null and empty texts have empty sets; rows that share a doc_id are one
document; a row without doc_id is named by its set and has a component_id only
if it links with a row that has one; an empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, materialize, small_batches, table

WORDS = 5
BITS = 512  # of a set's sketch
COUNTED = 3  # of 8: the share of shingles whose frequency is counted
NAMELESS = 1 << 62
LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(WORDS)]


class Hashes(dict):
    """Hashes of words, forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, hashes: Hashes) -> np.ndarray:
    """The set, as sorted hashes."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(w) - WORDS + 1
    h = w[:n].copy()
    for k in range(1, WORDS):
        h += w[k : k + n] * FACTORS[k]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    return np.unique(h)


def text_key(text: str | None) -> bytes:
    return xxhash.xxh3_128_digest((text or "").encode("utf-8", "surrogatepass"))


def prefix_size(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def described(docs: DataFrame, chunk: int = 1_500_000) -> DataFrame:
    """Rows of two kinds: each document's doc_id, text (x), set (c), size (n) and
    sketch; and shingles (t) that many documents (m) of a chunk hold."""

    def frequent(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        t, m = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, int))
        some = m >= max(3, len(held) // 2000)
        return t[some], m[some]

    names = ["doc_id", "x", "c", "n", "sketch", "t", "m"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, total = Hashes(), [], 0

        def often():
            t, m = frequent(held)
            k = len(t)
            return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.list_(pa.int64())), pa.array(t.view(np.int64)), pa.array(m.astype(np.int64))], names=names)

        for b in batches:
            x, c, n, sketch = [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingles(text, hashes)
                x.append(text_key(text))
                c.append(xxhash.xxh3_128_digest(s.tobytes()))
                n.append(len(s))
                odd = np.bincount((s >> np.uint64(65 - BITS.bit_length())).astype(np.int64), minlength=BITS) & 1
                sketch.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                held.append(s)
                total += len(s)
                if total >= chunk:
                    yield often()
                    held, total = [], 0
            k = len(c)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary()), pa.array(c, pa.binary()), pa.array(n, pa.int32()), pa.array(sketch, pa.list_(pa.int64())), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names=names)
        yield often()

    return docs.mapInArrow(run, "doc_id long, x binary, c binary, n int, sketch array<long>, t long, m long")


def first_shingles(docs: DataFrame, hot: np.ndarray, percent: int) -> DataFrame:
    """t, c, n, counted (how many shingles of the set are counted) and pos (the
    place of one that isn't, else -1), once for each set that a task meets."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    names = ["t", "c", "n", "counted", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, hot, seen = Hashes(), shared.value, set()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                t, c, n, counted, pos = [], [], [], [], []
                for text in b.column(1).slice(at, 500).to_pylist():
                    s = shingles(text, hashes)
                    if not len(s):
                        continue
                    key = xxhash.xxh3_128_digest(s.tobytes())
                    if key in seen:
                        continue
                    if len(seen) < 100_000:
                        seen.add(key)
                    common = np.zeros(len(s), bool)
                    if len(hot):
                        k = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                        common = hot[k] == s
                    order = np.where(common, 2, (s & np.uint64(7)) >= COUNTED)
                    first = s[order == 0]
                    more = max(0, prefix_size(len(s), percent) - len(first))
                    rest = np.concatenate((s[order == 1], s[order == 2]))[:more] if more else s[:0]
                    t += [first, rest]
                    pos += [np.full(len(first), -1, np.int32), len(first) + np.arange(len(rest), dtype=np.int32)]
                    c.append(key)
                    n.append(len(s))
                    counted.append(len(first))
                if c:
                    size = [len(x) + len(y) for x, y in zip(t[::2], t[1::2])]
                    one = np.repeat(np.arange(len(c)), size)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(t).view(np.int64)), pa.array(c, pa.binary()).take(pa.array(one)), pa.array(np.array(n, np.int32)[one]), pa.array(np.array(counted, np.int32)[one]), pa.array(np.concatenate(pos))], names=names)

    return docs.mapInArrow(run, "t long, c binary, n int, counted int, pos int")


def prefixes(docs: DataFrame, classes: DataFrame, hot: np.ndarray, percent: int) -> DataFrame:
    """t, c, r, n, pos of the prefix shingles that more than one class holds."""
    rows = first_shingles(docs, hot, percent)
    rows = rows.withColumn("f", F.count("*").over(Window.partitionBy("t"))).where("f > 1")
    rows = rows.repartition("c").dropDuplicates(["c", "t"])  # copies from several tasks
    own = Window.partitionBy("c")
    alone = F.col("counted") - F.count(F.when(F.col("pos") < 0, 1)).over(own)
    place = F.row_number().over(own.orderBy(F.col("pos") >= 0, "f", "t")) - 1
    rows = rows.withColumn("alone", alone).withColumn("place", place)
    rows = rows.withColumn("pos", F.when(F.col("pos") < 0, F.col("alone") + F.col("place")).otherwise(F.col("pos")))
    rows = rows.where(F.col("pos") < F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    return rows.join(classes.select("c", "r"), "c").select("t", "c", "r", "n", F.col("pos").cast("int").alias("pos"), F.col("alone").cast("int").alias("alone"))


def shared_by_classes(first: DataFrame) -> DataFrame:
    """Prefix shingles of two classes or more."""
    return first.join(first.groupBy("t").agg(F.count("*").alias("k")).where("k > 1").drop("k"), "t")


def may_link(percent: int, a: str = "", b: str = "2") -> Column:
    """Length and positional filters for two rows of a prefix shingle, as if it
    were the first that the two have in common: a pair that links passes there."""
    na, nb, pa_, pb = F.col(f"n{a}"), F.col(f"n{b}"), F.col(f"pos{a}"), F.col(f"pos{b}")
    need = F.ceil(percent * (na + nb) / (100 + percent))
    # at the first common shingle nothing before it is common
    most = F.least(na - pa_, nb - pb)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (most >= need)


#: What a row of a prefix shingle has of its class.
OF_CLASS = ("c", "r", "n", "pos", "alone")


def with_largest(rows: DataFrame) -> DataFrame:
    """Rows of the shingles that classes of several components (comp) hold, with
    the largest of these, major."""
    sizes = rows.groupBy("t", "comp").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("t").agg(F.max_by("comp", F.struct("m", "comp")).alias("major"), F.count("*").alias("comps")).where("comps > 1").drop("comps")
    return rows.join(largest, "t")


def neighbours(rows: DataFrame, percent: int, distances: list[int], apart: bool) -> DataFrame:
    """Pairs that stand so far from each other among the classes of a shingle, by
    size, and each class with the one of fewest shingles of its own, which copies
    with other edits are likely to have in common. With apart, components (comp)
    are known: then each class outside the shingle's largest component with the
    nearest in it takes that one's place, and pairs within a component are out."""
    by_size = Window.partitionBy("t").orderBy("n", "c")
    x = (with_largest(rows) if apart else rows).withColumn("x", F.struct(*OF_CLASS, *(["comp"] if apart else [])))
    others = [F.lag("x", d).over(by_size) for d in distances]
    if apart:
        major = F.when(F.col("comp") == F.col("major"), F.col("x"))
        others.append(F.last(major, ignorenulls=True).over(by_size.rowsBetween(Window.unboundedPreceding, -1)))
        others.append(F.last(major, ignorenulls=True).over(Window.partitionBy("t").orderBy(F.desc("n"), F.desc("c")).rowsBetween(Window.unboundedPreceding, -1)))
    else:
        others.append(F.first("x").over(Window.partitionBy("t").orderBy("alone", "n", "c")))
    for k, y in enumerate(others):
        x = x.withColumn(f"y{k}", y)
    x = x.select("x", F.explode(F.array(*[f"y{k}" for k in range(len(others))])).alias("y")).where("y is not null")
    if apart:
        x = x.where("x.comp != y.comp")
    x = x.select("x.*", *[F.col(f"y.{k}").alias(f"{k}2") for k in OF_CLASS])
    return pairs(x.where(may_link(percent)).where("c != c2"))


def pairs(x: DataFrame) -> DataFrame:
    """Each pair once."""
    swap = F.col("c") > F.col("c2")
    pick = lambda k, first: F.when(swap, F.col(f"{k}2") if first else F.col(k)).otherwise(F.col(k) if first else F.col(f"{k}2"))
    return x.select(pick("c", True).alias("a"), pick("c", False).alias("b"), pick("r", True).alias("ra"), pick("r", False).alias("rb")).dropDuplicates(["a", "b"])


def similar_sketches(percent: int) -> Column:
    """Suffix filter: the sets can't differ in less than their sketches do, which
    must leave room for as much in common as a link needs."""
    n = F.col("n") + F.col("n2")
    differ = F.aggregate(F.zip_with("sketch", "sketch2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return differ <= n - 2 * F.ceil(percent * n / (100 + percent))


def still_apart(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """All pairs of a shingle's classes whose components differ: those outside
    the shingle's largest component, with all others."""
    mixed = with_largest(rows).join(classes.select("c", "sketch"), "c")
    minor = mixed.where("comp != major")
    other = mixed.select("t", *[F.col(k).alias(f"{k}2") for k in (*OF_CLASS, "comp", "major", "sketch")])
    once = (F.col("comp") != F.col("comp2")) & ((F.col("comp2") == F.col("major2")) | (F.col("comp") < F.col("comp2")))
    return pairs(minor.join(other, "t").where(once & may_link(percent) & similar_sketches(percent)))


def verified(found: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """ra, rb of the pairs that do link."""
    one = classes.select(F.col("c").alias("a"), "n", "sketch")
    two = classes.select(F.col("c").alias("b"), F.col("n").alias("n2"), F.col("sketch").alias("sketch2"))
    likely = found.join(one, "a").join(two, "b").where(similar_sketches(percent)).select("a", "b", "ra", "rb")
    both = likely.join(texts.select(F.col("c").alias("a"), F.col("z").alias("za")), "a").join(texts.select(F.col("c").alias("b"), F.col("z").alias("zb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known, size = Hashes(), {}, 0

        def of(key: bytes, z: bytes) -> np.ndarray:
            nonlocal size
            if key not in known:
                if size > 1_000_000:
                    known.clear()
                    size = 0
                known[key] = shingles(zstandard.decompress(z).decode("utf-8", "surrogatepass"), hashes)
                size += len(known[key])
            return known[key]

        for b in batches:
            a, c, za, zb = (b.column(k).to_pylist() for k in (0, 1, 4, 5))
            ok = []
            for x, y, zx, zy in zip(a, c, za, zb):
                s, t = of(x, zx), of(y, zy)
                same = len(s) + len(t) - len(np.union1d(s, t))
                ok.append(100 * same >= percent * (len(s) + len(t) - same))
            yield b.select(["ra", "rb"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "ra", "rb", "za", "zb").mapInArrow(run, "ra long, rb long")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """c and z, a packed text of each of the wanted classes (c, x: one of its texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen = zstandard.ZstdCompressor(level=3), set()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                x, z = [], []
                for text in b.column(1).slice(at, 500).to_pylist():
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    key = xxhash.xxh3_128_digest(raw)
                    if key not in seen:
                        if len(seen) < 100_000:
                            seen.add(key)
                        x.append(key)
                        z.append(packer.compress(raw))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(z, pa.binary())], names=["x", "z"])

    packed = docs.mapInArrow(run, "x binary, z binary")
    return packed.join(wanted.hint("shuffle_hash"), "x").select("c", "z").dropDuplicates(["c"])


def near_documents(docs: DataFrame, percent: int = 80, hot_share: float = 0.001, max_hot: int = 500_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    seen = materialize(described(docs))
    members = seen.where("c is not null").select("doc_id", "x", "c", "n", "sketch")
    rows = members.count()
    # at most max_hot; which they are steers the order of shingles only
    often = seen.where("t is not null").groupBy("t").agg(F.sum("m").alias("m")).where(F.col("m") >= max(3, hot_share * rows)).orderBy(F.desc("m"), "t").limit(max_hot).select("t").toPandas()["t"]
    hot = np.sort(often.to_numpy(np.int64).view(np.uint64))
    nameless = F.lit(NAMELESS).bitwiseOR(F.shiftrightunsigned(F.xxhash64("c"), 2))
    classes = materialize(members.where("n > 0").groupBy("c").agg(F.coalesce(F.min("doc_id"), nameless).alias("r"), F.any_value("n").alias("n"), F.any_value("x").alias("x"), F.any_value("sketch").alias("sketch")))
    first = materialize(prefixes(docs, classes, hot, percent))
    shared = materialize(shared_by_classes(first))
    texts = materialize(texts_of(docs, shared.select("c").distinct().join(classes.select("c", "x"), "c")))
    # rows that share a doc_id are one document
    ids = members.where("doc_id is not null and n > 0").join(classes.select("c", "r"), "c").where("doc_id != r").select(F.col("doc_id").alias("ra"), F.col("r").alias("rb")).distinct()
    links, comps = ids, None
    for distances in ([1], [2, 4, 16], None):
        if comps is None:
            found = neighbours(shared, percent, distances, apart=False)
        else:
            own = shared.join(comps, F.col("r") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "r")).drop("node", "component")
            found = neighbours(own, percent, distances, apart=True) if distances else still_apart(own, classes, percent)
        new = materialize(verified(found, classes, texts, percent))
        if comps is None:
            links = links.union(new)
        elif new.isEmpty():
            continue
        else:  # what is linked so far is a star already, so few rounds are left
            links = comps.select("node", "component").union(new)
        comps = materialize(components(links.toDF("a", "b")))
    named = members.join(classes.select("c", "r"), "c", "left").join(comps, F.col("r") == F.col("node"), "left")
    component = F.coalesce("component", "r", "doc_id")
    return named.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(component < NAMELESS, component).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the row whose doc_id names it. Rows
    without doc_id stay, and so do rows without words. Returns the columns of docs."""
    small_batches(spark)
    found = near_documents(docs).where("component_id != doc_id").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(found, F.col("doc_id") == F.col("__id"), "left_anti")
