"""Document quality by a conditional random field over lines.

Each line of a text (what stands between newlines) is good or bad. A line's
features are counts of byte classes, cut into bins; the field sees those of the
line and of its two neighbours, and how labels follow each other. Training
labels are of documents: lines of good ones are good; lines of bad ones are
taken as bad at first, then as the field itself sees them (at least one line of
each stays bad). A document's quality comes from the forward-backward marginals,
weighted by the lines' lengths, through a logistic curve fitted on the same
sample.

The field is fitted on about ``docs_per_class`` labelled documents of each
class, chosen by a hash of their ids; of one with more than ``RUNS * RUN`` lines,
on RUNS runs of RUN lines spread over all of it. So what the driver gets is
bounded by the number of documents, however long they are.

Cases: null and empty texts have no line to weigh and get the curve's value at
the sample's mean; without labels of both classes every score is 0.5; documents
with several labels count as their lowest; repeated rows are each scored.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, id_remainder, table

UPPER, LOWER, DIGIT, SPACE, WIDE, STOP, PIPE, SYMBOL = range(8)
KIND = np.full(256, SYMBOL, np.uint8)
KIND[65:91], KIND[97:123], KIND[48:58], KIND[128:] = UPPER, LOWER, DIGIT, WIDE
KIND[[32, 9, 11, 12, 13]] = SPACE
KIND[[44, 46]], KIND[124] = STOP, PIPE
SHARES = np.array([0.0, 0.01, 0.03, 0.08, 0.2, 0.4, 0.7])
BINS = 18
N_FEATURES = 9
SLOTS = 3 * N_FEATURES
RUNS, RUN = 16, 32


def line_codes(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts that lie end to end in data, from begin[i] to begin[i + 1]:
    bins of each line's features, its length, and the first line of each text
    (each text has a line at least)."""
    n = len(begin) - 1
    breaks = np.flatnonzero(data == 10)
    # each text ends in a break of its own, put after it
    place = np.searchsorted(breaks, begin[1:], "left")
    ends = np.insert(breaks, place, begin[1:])
    own = np.searchsorted(begin[1:], breaks, "right")
    doc = np.insert(own, place, np.arange(n))
    first = np.searchsorted(doc, np.arange(n))
    starts = np.r_[0, ends[:-1] + 1]
    starts[first] = begin[:-1]
    size = ends - starts
    kind = KIND[data]
    upto = lambda mask: np.r_[0, np.cumsum(mask, dtype=np.int32 if len(data) < 2**31 else np.int64)]

    def count(mask):
        c = upto(mask)
        return (c[ends] - c[starts]).astype(np.float64)

    upper, digit, space, symbol, pipe = (count(kind == k) for k in (UPPER, DIGIT, SPACE, SYMBOL, PIPE))
    letters = upper + count(kind == LOWER) + count(kind == WIDE) / 2
    twice = np.zeros(len(data), bool)
    twice[1:] = (data[1:] == data[:-1]) & (kind[1:] == SYMBOL)
    long = np.maximum(size, 1)
    share = lambda x, of=long: np.searchsorted(SHARES, x / np.maximum(of, 1), "right")
    edge = lambda at: np.where(size > 0, kind[np.minimum(at, max(len(data) - 1, 0))] + 1 if len(data) else 0, 0)
    codes = [np.minimum(np.log2(size + 1).astype(int), BINS - 1), share(upper, letters), share(symbol), share(count(twice)), share(pipe), share(digit), np.minimum(((size - space) / (space + 1)).astype(int), BINS - 1), edge(starts), edge(np.maximum(ends - 1, starts))]
    return np.stack(codes, 1).astype(np.uint8), size, first


def slots(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The bins of each line and of the lines before and after it, as places in one table of weights."""
    none = np.full((1, N_FEATURES), BINS - 1, np.int64)
    own = codes.astype(np.int64)
    before, after = np.concatenate((none, own[:-1])), np.concatenate((own[1:], none))
    before[first] = none
    after[first[1:] - 1] = none
    return np.concatenate((own, before, after), 1) + np.arange(SLOTS) * BINS


class Chains:
    """Lines of many texts, so laid out that step t takes line t of every text that has one."""

    def __init__(self, first: np.ndarray, n: int):
        length = np.diff(np.r_[first, n])
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        going = len(length) - np.searchsorted(length[::-1], np.arange(1, (length[0] if len(length) else 0) + 1), "left")
        self.steps = [first[:m] + t for t, m in enumerate(going)]

    def marginals(self, score: np.ndarray, follow: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Of two labels with scores (lines x 2): the marginals, the expected
        number of each pair of labels in a row, and the log of the partition sum."""
        top = score.max(1)
        e, t = np.exp(score - top[:, None]), np.exp(follow)
        ahead, back = np.empty_like(e), np.ones_like(e)
        log = top.sum()
        for k, at in enumerate(self.steps):
            a = e[at] if k == 0 else e[at] * (ahead[at - 1] @ t)
            s = a.sum(1)
            log += np.log(s).sum()
            ahead[at] = a / s[:, None]
        pairs = np.zeros((2, 2))
        for at in self.steps[:0:-1]:
            x = e[at] * back[at]
            b = x @ t.T
            s = (ahead[at - 1] * b).sum(1)
            pairs += ((ahead[at - 1] / s[:, None]).T @ x) * t
            back[at - 1] = b / b.sum(1)[:, None]
        p = ahead * back
        return p / p.sum(1)[:, None], pairs, log


class Model:
    """Weights by slot and label, follow (label after label), and the curve's two numbers."""

    def __init__(self):
        self.w, self.follow, self.curve, self.mean = np.zeros((SLOTS * BINS, 2)), np.zeros((2, 2)), (0.0, 0.0), 0.0

    def bad(self, codes, size, first) -> np.ndarray:
        """Log odds of the share of bad lines in each text, by length; nan without text."""
        p = Chains(first, len(codes)).marginals(self.w[slots(codes, first)].sum(1), self.follow)[0]
        total = np.add.reduceat(size.astype(np.float64), first)
        with np.errstate(invalid="ignore"):
            q = np.add.reduceat(p[:, 0] * size, first) / total
        return np.log((q + 0.001) / (1 - q + 0.001))

    def score(self, data, begin) -> np.ndarray:
        if len(begin) < 2:
            return np.zeros(0)
        x = self.bad(*line_codes(data, begin))
        a, b = self.curve
        return 1 / (1 + np.exp(np.clip(-(a + b * np.where(np.isnan(x), self.mean, x)), -500, 500)))


def climb(model: Model, s: np.ndarray, chains: Chains, good: np.ndarray, weight: float, rounds: int, rate: float = 0.1) -> None:
    """Adam on the log likelihood of the labels, with a quadratic penalty."""
    n = len(good)
    y = np.stack((~good, good), 1).astype(float)
    seen = np.zeros((2, 2))
    for at in chains.steps[1:]:
        np.add.at(seen, (good[at - 1].astype(int), good[at].astype(int)), 1)
    theta = [model.w, model.follow]
    m, v = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    for i in range(1, rounds + 1):
        p, pairs, _ = chains.marginals(model.w[s].sum(1), model.follow)
        d = y - p
        own = np.stack([np.bincount(s.ravel(), np.repeat(d[:, k], SLOTS), SLOTS * BINS) for k in (0, 1)], 1)
        for j, g in enumerate((own / n - weight * model.w, (seen - pairs) / n - weight * model.follow)):
            m[j] = 0.9 * m[j] + 0.1 * g
            v[j] = 0.99 * v[j] + 0.01 * g * g
            theta[j] += rate * (m[j] / (1 - 0.9**i)) / (np.sqrt(v[j] / (1 - 0.99**i)) + 1e-8)


def train(docs: list[tuple[np.ndarray, np.ndarray, int]], passes: int = 3, rounds: int = 40, weight: float = 1e-4) -> Model:
    """docs: bins of the lines' features, lengths of the lines, and 1 for a good document."""
    model = Model()
    codes, size = np.concatenate([d[0] for d in docs]), np.concatenate([d[1] for d in docs])
    counts = np.array([len(d[0]) for d in docs])
    first, label = np.r_[0, np.cumsum(counts)[:-1]], np.array([d[2] for d in docs], bool)
    s, chains = slots(codes, first), Chains(first, len(codes))
    good = np.repeat(label, counts)
    for _ in range(passes):
        climb(model, s, chains, good, weight, rounds)
        p = chains.marginals(model.w[s].sum(1), model.follow)[0][:, 1]
        worst = np.repeat(np.minimum.reduceat(p, first), counts)
        good = np.repeat(label, counts) | ((p > 0.5) & (p > worst))
    x = model.bad(codes, size, first)
    some = ~np.isnan(x)
    x, y = x[some], label[some].astype(float)
    model.mean = float(x.mean()) if len(x) else 0.0
    a = b = 0.0
    for _ in range(50):  # Newton's steps
        p = 1 / (1 + np.exp(-(a + b * x)))
        g = np.array([(y - p).sum() - 1e-2 * a, ((y - p) * x).sum() - 1e-2 * b])
        h = p * (1 - p)
        step = np.linalg.solve([[h.sum() + 1e-2, (h * x).sum()], [(h * x).sum(), (h * x * x).sum() + 1e-2]], g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    model.curve = (float(a), float(b))
    return model


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    x = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
    x = x.fill_null("")
    begin = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1]
    data = np.frombuffer(x.buffers()[2] or b"", np.uint8)[begin[0] : begin[-1]] if len(x) else np.zeros(0, np.uint8)
    return data, begin - begin[0] if len(x) else np.zeros(1, np.int64)


def spread(n: int) -> np.ndarray:
    """Places of at most RUNS * RUN of n lines: all, or runs of RUN in equal distances from the first to the last."""
    if n <= RUNS * RUN:
        return np.arange(n)
    starts = np.linspace(0, n - RUN, RUNS).astype(np.int64)
    return np.unique(starts[:, None] + np.arange(RUN))


def fit(docs: DataFrame, labels: DataFrame, docs_per_class: int = 2_000) -> Model:
    """From docs (doc_id, text) and labels (doc_id, quality)."""
    own = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    sizes = {r["quality"]: r["count"] for r in own.groupBy("quality").count().collect()}
    if len(sizes) < 2:
        return Model()
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    share = F.when(F.col("quality") == 1, docs_per_class / sizes[1]).otherwise(docs_per_class / sizes[0])
    some = own.where(u < share).limit(4 * docs_per_class)
    picked = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")

    def f(cols):
        data, begin = buffers(cols["text"])
        codes, size, first = line_codes(data, begin)
        kept = [a + spread(b - a) for a, b in zip(first, [*first[1:], len(codes)])]
        return {"doc_id": cols["doc_id"], "codes": [codes[k].tobytes() for k in kept], "size": [size[k].astype(np.int64).tobytes() for k in kept], "quality": cols["quality"]}

    rows = by_batch(picked, "doc_id long, codes binary, size binary, quality int", f).orderBy("doc_id", "size").collect()
    if len({r["quality"] for r in rows}) < 2:
        return Model()
    return train([(np.frombuffer(r["codes"], np.uint8).reshape(-1, N_FEATURES), np.frombuffer(r["size"], np.int64), r["quality"]) for r in rows])


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[doc_id].replace("bigint", "long")
    f = lambda cols: {"doc_id": cols["doc_id"], "score": pa.array(shared.value.score(*buffers(cols["text"])))}
    return by_batch(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), f"doc_id {kind}, score double", f, to_py=False)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs.where(id_remainder("doc_id", 5) != 0), labels.where(id_remainder("doc_id", 5) != 0))
    held_out = (id_remainder("doc_id", 5) == 0).alias("held_out")
    return score(docs, model).select("doc_id", held_out, "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
