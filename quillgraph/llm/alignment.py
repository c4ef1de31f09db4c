"""Alignment of two tokenizers over the same bytes, and the statistics of their links.

Each text is encoded by A (a byte-level vocabulary) and by B (pieces, whose
program puts a space before the text, so A gets the text with one). The texts of
an Arrow batch are laid end to end; one packed bitset marks where A's tokens end,
one where B's do, a bit for each byte.

- A & B are the shared cuts, which close the groups.
- A | B are the ends of the links: between two neighbouring ends lie bytes of
  one token of A and one of B, and each overlapping pair has exactly one such
  stretch, so there is a link for each bit.
- rank (set bits before a word by running popcounts, within it by the popcount
  of the masked word) tells at any cut how many tokens of A or B lie before it;
  select lists the set bits.

A pair of ids counts as often as it is linked in the whole corpus. Counts are
summed in each batch, in each task and then over all. For the documents' sums
the most frequent pairs, those counted 2**e times or more with the least e that
leaves at most COMMON of them, go to all tasks (at most 9 MB, however large the
corpus); whatever is rarer is joined by pair, where no key is hot any more.

Cases: a null or empty text, and one whose tokens' bytes are not the text's with the
space (a literal U+2581, say), has no tokens; special tokens' strings in a text are
text; repeated rows count each for itself; an empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_automaton import BYTE_LEVEL, byte_letters
from .common import materialize, small_batches, table

#: Pairs that go to all tasks.
COMMON = 1 << 20
#: Bytes of text that are aligned at once, a text at least.
BYTES = 1 << 18
#: An id of B fits in so many bits.
BITS = 20
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"
SUMS = "row long, n_best long, count_sum long, pairs array<long>, times array<int>"


class Bits:
    """A packed bitset with rank and select."""

    def __init__(self, words: np.ndarray):
        self.words = words
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.count = int(ones.sum())

    @classmethod
    def at(cls, places: np.ndarray, size: int) -> Bits:
        flags = np.zeros(-(-size // 64) * 64, bool)
        flags[places] = True
        return cls(np.packbits(flags, bitorder="little").view("<u8"))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def __or__(self, other: Bits) -> Bits:
        return Bits(self.words | other.words)

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        if not len(self.words):
            return np.zeros(len(places), np.int64)
        inside = word < len(self.words)
        word = np.where(inside, word, 0)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return np.where(inside, self.before[word] + np.bitwise_count(self.words[word] & mask), self.count)

    def select(self) -> np.ndarray:
        """The places of all set bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


class Encoders:
    """Both tokenizers, opened in each task's Python from the bytes of their files.
    A's merges have to be in the order of the ids they make, as in byte-level
    files they are: then ids are ranks, for which there is a quicker library."""

    def __init__(self, a: bytes, b: bytes):
        import sentencepiece
        import tiktoken

        model = json.loads(a)["model"]
        of = {c: i for i, c in enumerate(byte_letters())}
        ranks = {bytes(of[c] for c in s): i for s, i in model["vocab"].items()}
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        if len(ranks) != len(model["vocab"]) or [model["vocab"][x + y] for x, y in merges] != [*range(256, 256 + len(merges))]:
            raise ValueError("A's ids are not the order of its merges")
        self.a = tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for x, i in ranks.items():
            self.bytes_a[i] = x
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.len_a, self.len_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        if len(self.bytes_b) >= 1 << BITS or len(self.bytes_a) >= 1 << 62 - BITS:
            raise ValueError("ids are too large for a packed pair")
        #: What stands for a token that isn't, and that is, the last of its side of a group: A's, then B's.
        self.said = [f"{i}{c}" for i in range(len(self.bytes_a)) for c in ",|"] + [f"{i}{c}" for i in range(len(self.bytes_b)) for c in ",;"]

    def encode(self, text: str | None) -> tuple[list[int], list[int]]:
        """The ids by A and B, none where the bytes differ."""
        if not text:
            return [], []
        raw = f" {text}"
        a, b = self.a.encode_ordinary(raw), self.b.encode(text, num_threads=1)
        raw = raw.encode()
        same = b"".join([self.bytes_a[i] for i in a]) == raw and b"".join([self.bytes_b[i] for i in b]) == raw
        return (a, b) if same else ([], [])


def aligned_batch(e: Encoders, texts: list[str | None]) -> dict[str, list]:
    """The columns of ALIGNED from n_a on, for each text."""
    n_a, n_b, parts_a, parts_b = [], [], [], []
    for t in texts:
        x, y = e.encode(t)
        n_a.append(len(x))
        n_b.append(len(y))
        parts_a.append(np.array(x, np.int64))
        parts_b.append(np.array(y, np.int64))
    a, b = np.concatenate(parts_a), np.concatenate(parts_b)
    ends_a, ends_b = np.cumsum(e.len_a[a]), np.cumsum(e.len_b[b])
    size = int(ends_a[-1]) if len(a) else 0
    # bit i: a token ends after byte i
    bits_a, bits_b = Bits.at(ends_a - 1, size), Bits.at(ends_b - 1, size)
    cuts, links = bits_a & bits_b, bits_a | bits_b
    last = links.select()
    first = np.r_[0, last[:-1] + 1] if len(last) else last
    pair = a[bits_a.rank(first)] << BITS | b[bits_b.rank(first)]
    token_to = np.cumsum(n_a)
    stop = np.r_[0, ends_a][token_to]  # each text's end, a cut of both
    group_to, link_to = cuts.rank(stop), links.rank(stop)
    cut = cuts.select() + 1
    upto_a, upto_b = bits_a.rank(cut), bits_b.rank(cut)  # tokens up to each group's end
    # tokens in the order of writing: a group's of A, then its of B
    final_a, final_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    final_a[upto_a - 1], final_b[upto_b - 1] = 1, 1
    group_a, group_b = np.cumsum(final_a) - final_a, np.cumsum(final_b) - final_b
    order = np.empty(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + np.r_[0, upto_b][group_a]] = 2 * a + final_a
    order[np.arange(len(b)) + np.r_[upto_a, 0][group_b]] = 2 * (len(e.bytes_a) + b) + final_b
    out = {"n_a": np.array(n_a), "n_b": np.array(n_b), "n_groups": np.diff(group_to, prepend=0), "n_links": np.diff(link_to, prepend=0), "groups": [], "pairs": [], "times": []}
    said_to = token_to + np.cumsum(n_b)
    g = k = 0
    for to, link in zip(said_to.tolist(), link_to.tolist()):
        out["groups"].append("".join(map(e.said.__getitem__, order[g:to].tolist()))[:-1])
        own, times = np.unique(pair[k:link], return_counts=True)
        out["pairs"].append(own)
        out["times"].append(times)
        g, k = to, link
    return out


def lists(x: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *map(len, x)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(x) if x else [], kind))


def in_slices(b: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Slices of about BYTES, a row at least."""
    begin = 0
    while begin < len(sizes):
        end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), BYTES, "right")))
        yield b.slice(begin, end - begin)
        begin = end


def align(docs: DataFrame, a: bytes, b: bytes) -> DataFrame:
    """ALIGNED for each row of docs (doc_id, text): groups as ``a1,a2|b1;a3|b2,b3``,
    pairs (A's id << BITS | B's id), each once, and how many links have them."""
    small_batches(docs.sparkSession)
    files = docs.sparkSession.sparkContext.broadcast((a, b))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoders(*files.value)
        for whole in batches:
            sizes = np.array([len(t.as_buffer()) if (t := x).is_valid else 0 for x in whole.column(2)], np.int64)
            for part in in_slices(whole, sizes):
                out = aligned_batch(e, part.column(2).to_pylist())
                kinds = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string())]
                made = [*[pa.array(out[n], k) for n, k in kinds], lists(out["pairs"], pa.int64()), lists(out["times"], pa.int32())]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *made], names=[x.split()[0] for x in ALIGNED.split(", ")])

    return rows.mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (links in the whole corpus) and best, whether n is the highest of B's id."""
    single = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = materialize(single.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n")))
    id_b = F.col("pair").bitwiseAND((1 << BITS) - 1)
    most = counts.groupBy(id_b.alias("b")).agg(F.max("n").alias("most"))
    return counts.join(most, id_b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def common_pairs(counts: DataFrame, most: int) -> int:
    """The least count of which at most ``most`` pairs have as much or more, a power of two."""
    sizes = dict(counts.groupBy(F.floor(F.log2(F.col("n").cast("double"))).alias("e")).count().collect())  # a row for each power
    total, e = 0, max(sizes, default=-1) + 1
    while e > 0 and total + sizes.get(e - 1, 0) <= most:
        e -= 1
        total += sizes.get(e, 0)
    return 1 << e


def digested(aligned: DataFrame) -> DataFrame:
    """aligned with groups_sha256 in place of groups ('' without tokens)."""
    return aligned.withColumn("groups", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).withColumnRenamed("groups", "groups_sha256")


def totals(aligned: DataFrame, common: int = COMMON) -> DataFrame:
    """Of each row of ``aligned``, which is read three times: n_best (links that are
    the most frequent of B's id in the corpus) and count_sum (over its links),
    beside all columns but pairs and times."""
    spark = aligned.sparkSession
    counts = materialize(pair_counts(aligned))
    least = common_pairs(counts, common)
    top = counts.where(F.col("n") >= least).toPandas().sort_values("pair")  # at most ``common`` rows
    sent = spark.sparkContext.broadcast((top["pair"].to_numpy(np.int64), np.where(top["best"], -1, 1) * top["n"].to_numpy(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, signed = sent.value
        for x in batches:
            size = np.diff(x.column("pairs").offsets.to_numpy())
            pairs, times = x.column("pairs").flatten().to_numpy(), x.column("times").flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(size)), size)
            at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            n = np.where(hit, signed[at] if len(known) else 0, 0)
            best, total = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            np.add.at(best, row, np.where(n < 0, times, 0))
            np.add.at(total, row, np.abs(n) * times)
            rest = pa.array(np.r_[0, np.cumsum(np.bincount(row, ~hit, len(size)))].astype(np.int32))
            more = [pa.ListArray.from_arrays(rest, pa.array(y[~hit], k)) for y, k in ((pairs, pa.int64()), (times, pa.int32()))]
            yield pa.RecordBatch.from_arrays([x.column("row"), pa.array(best), pa.array(total), *more], names=[c.split()[0] for c in SUMS.split(", ")])

    found = materialize(aligned.select("row", "pairs", "times").mapInArrow(run, SUMS))
    rest = found.where(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").cast("long").alias("k"))
    rare = rest.join(counts.where(F.col("n") < least), "pair").select("row", F.when(F.col("best"), F.col("k")).otherwise(0).alias("n_best"), (F.col("k") * F.col("n")).alias("count_sum"))
    sums = found.select("row", "n_best", "count_sum").union(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.drop("pairs", "times").join(sums, "row").drop("row")


def query(spark: SparkSession, sf_dir: str, a: str | None = None, b: str | None = None) -> DataFrame:
    """The totals of all documents, by byte_bpe_50k.json and piece_bpe_32k.model or the files at ``a`` and ``b``."""
    import public_tokenizers

    files = []
    for path in (a or public_tokenizers.path("byte_bpe_50k.json"), b or public_tokenizers.path("piece_bpe_32k.model")):
        with open(path, "rb") as f:
            files.append(f.read())
    aligned = materialize(digested(align(table(spark, sf_dir, "documents").select("doc_id", "text"), *files)))
    return totals(aligned).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
