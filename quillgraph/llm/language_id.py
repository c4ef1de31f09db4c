"""Language identification by words, with a backoff to character n-grams.

A model holds, for each language, log frequencies of known words and of
character n-grams of one to four letters. A known word scores by its own log
frequency. An unseen word scores by its longest known n-grams: four letters,
and if none of these is known three, then two, then one.

What is learned comes from a bounded sample of distinct texts of each language;
copies don't count in it, so a language of few texts in many copies is learned
from all of them. Everything in the sample is kept.

Cases: a text that is null or has no letter gets ``und`` and score 0, as does
every text if there is nothing to learn from. A language whose sample has no
letter is never predicted. Ties go to the language that sorts first. Repeated
rows are each predicted. Columns of the documents that are called as the new ones
stay, with underscores in front.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import appended, by_batch, filtered, id_remainder, small_batches, table

#: A word: letters with the marks that belong to them.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
HALF = 0.5
UNKNOWN = "und"
LONGEST = 4


def grams(word: str, n: int) -> list[str]:
    padded = f"<{word}>" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Model:
    """Languages in order; for each kind (words, then n-grams by length) the
    items' numbers, and base, the log probability of an item that a language's
    sample lacks. Item i adds gain[j] for language lang[j], start[i] <= j <
    start[i + 1], so the model grows with the items that languages have."""

    def __init__(self, langs: list[str], kind: np.ndarray, items: list[str], lang: np.ndarray, n: np.ndarray):
        """Rows in the order of kind and item: kind, item, the language's number and count."""
        self.langs, self.lang = langs, lang
        totals = np.bincount(kind * max(len(langs), 1) + lang, n, (LONGEST + 1) * max(len(langs), 1)).reshape(LONGEST + 1, -1)
        new = np.array([i == 0 or items[i] != items[i - 1] for i in range(len(items))], bool)
        new[1:] |= kind[1:] != kind[:-1]
        start = np.flatnonzero(new)
        self.kind, self.start, self.size = kind[start], start, np.diff(np.r_[start, len(items)])
        self.items: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        for i, (k, at) in enumerate(zip(self.kind.tolist(), start.tolist())):
            self.items[k][items[at]] = i
        self.gain = np.log(n + HALF) - np.log(HALF)
        distinct = np.array([len(x) for x in self.items], float)
        self.base = np.log(HALF) - np.log(totals + HALF * distinct[:, None] + 1)

    def total(self, ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Weighted sum of the items' log probabilities, by language."""
        size = self.size[ids]
        ends = np.cumsum(size)
        j = np.repeat(self.start[ids] - ends + size, size) + np.arange(ends[-1])
        gains = np.bincount(self.lang[j], self.gain[j] * np.repeat(weights, size), len(self.langs))
        return gains + np.bincount(self.kind[ids], weights, LONGEST + 1) @ self.base


def fit(train: DataFrame, text: str = "text", lang: str = "lang", docs_per_lang: int = 1_000) -> Model:
    """Learns every language from a sample of about docs_per_lang distinct texts of
    each at most, the only bound there is; of all words and n-grams in it."""
    train = train.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    # the sample draws texts, so texts are counted, not rows: by sketches, a row for each language
    sizes = train.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("texts"))
    u = F.xxhash64("text").bitwiseAND((1 << 52) - 1) / float(1 << 52)
    sample = train.join(F.broadcast(sizes), "lang").where(u * F.col("texts") < docs_per_lang).select("lang", "text").dropDuplicates()

    def count(cols):
        by = {}
        for k, t in zip(cols["lang"], cols["text"]):
            by.setdefault(k, Counter()).update(LETTERS.findall(t.lower()))
        out = {"lang": [], "kind": [], "item": [], "n": []}
        for k, words in by.items():
            got = [Counter() for _ in range(LONGEST + 1)]
            got[0] = words
            for w, c in words.items():
                for n in range(1, LONGEST + 1):
                    for g in grams(w, n):
                        got[n][g] += c
            for kind, items in enumerate(got):
                out["lang"] += [k] * len(items)
                out["kind"] += [kind] * len(items)
                out["item"] += items.keys()
                out["n"] += items.values()
        return out

    counts = by_batch(sample, "lang string, kind int, item string, n long", count).groupBy("kind", "item", "lang").agg(F.sum("n").alias("n"))
    found = counts.orderBy("kind", "item", "lang").toArrow()
    langs = sorted(set(found["lang"].to_pylist()))
    at = {x: i for i, x in enumerate(langs)}
    number = np.array([at[x] for x in found["lang"].to_pylist()], np.int64)
    return Model(langs, found["kind"].to_numpy().astype(np.int64), found["item"].to_pylist(), number, found["n"].to_numpy().astype(float))


class Scorer:
    """Scores texts; remembers which n-grams stand for an unseen word, for at most room words."""

    def __init__(self, model: Model, room: int = 50_000):
        self.m, self.room, self.backed = model, room, {}

    def back_off(self, word: str) -> list[int]:
        for n in range(LONGEST, 0, -1):
            rows = self.m.items[n]
            if ids := [rows[g] for g in grams(word, n) if g in rows]:
                return ids
        return []

    def score(self, text: str | None) -> tuple[str, float]:
        words = Counter(LETTERS.findall(text.lower())) if text and self.m.langs else None
        if not words:
            return UNKNOWN, 0.0
        ids, weights, known, backed = [], [], self.m.items[0], self.backed
        for w, c in words.items():
            if (i := known.get(w)) is not None:
                ids.append(i)
                weights.append(c)
                continue
            if (own := backed.get(w)) is None:
                if len(backed) >= self.room:
                    backed.clear()
                own = backed[w] = self.back_off(w)
            if own:
                ids += own
                weights += [c / len(own)] * len(own)
        total = self.m.total(np.array(ids), np.array(weights, float)) if ids else np.zeros(len(self.m.langs))
        number = words.total()
        total *= min(number, 30) / number  # long texts are not that much surer
        p = np.exp(total - total.max())
        best = int(p.argmax())
        return self.m.langs[best], float(p[best] / p.sum())


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score; columns of docs of these names get underscores in front."""
    own = [c for c in docs.columns if c in ("lang_pred", "score")]
    for c in own:
        to = f"_{c}"
        while to in docs.columns:
            to = f"_{to}"
        docs, text = docs.withColumnRenamed(c, to), to if text == c else text
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)
        return lambda texts: list(zip(*map(scorer.score, texts)))

    return appended(docs, [text], "lang_pred string, score double", make)


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where(id_remainder("doc_id", 3) != 1)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(learnable(docs))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Keeps the documents whose language is recognised: not ``und``, and with
    a score of ``least`` or more. Returns the columns of docs."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(fit(learnable(docs)))

    def make():
        scorer = Scorer(shared.value)
        return lambda texts: [lang != UNKNOWN and score >= least for lang, score in map(scorer.score, texts)]

    return filtered(docs, ["text"], make)
