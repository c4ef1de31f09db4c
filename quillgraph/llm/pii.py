"""Personal data, and the terms around it that give it away.

Base spans are e-mail addresses, IP addresses, card and phone numbers. Each
value found (kind and text, lower-case, and of numbers the digits alone) is a
protected entity. The corpus then tells which terms reveal one: with p(x) the
share of documents that hold x, a term t within ``reach`` words of the entity e
discloses PMI(e, t) / IC(e) of it, where PMI = log(p(e, t) / (p(e) p(t))) and
IC = -log p(e), times n / (n + 1) for n documents that hold both near each
other: what a single document says is worth half. From ``remove`` on the term is
to be removed, from ``generalise`` on to be replaced by a general word. Such a
term becomes a span where it stands near that entity, and nowhere else.

A term is a run of two or more letters and their marks; where words are written
without spaces, two characters of a run at a time.

Cases: a null text is empty; texts without personal data have no spans; an
entity that all documents hold has no information to disclose; repeated rows
count as documents and are each reported; an empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_batch, materialize, table

KINDS = ("email", "ip", "card", "phone", "term")
UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}"
TERMS = regex.compile(rf"[{UNSPACED}]{{1,2}}|(?:(?![{UNSPACED}])\p{{L}}\p{{M}}*){{2,}}")
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NON_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    twice = [int(x) * 2 for x in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(x - 9 if x > 9 else x for x in twice)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, end = [], 0
    for m in AT.finditer(text):
        at = start = m.start()
        while start > end and text[start - 1] in LOCALS:
            start -= 1
        if start < at:
            out.append((start, m.end()))
            end = m.end()
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), in order."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = NON_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NON_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def named(text: str, start: int, kind: int, end: int) -> str:
    """The entity that a base span stands for."""
    return f"{KINDS[kind]}:{text[start:end].lower() if kind < 2 else NON_DIGIT.sub('', text[start:end])}"


def around(text: str, spans: list[tuple[int, int, int]], reach: int) -> list[tuple[str, str, int, int]]:
    """(entity, term, start, end) of the terms near each span, apart from what
    lies in a span. The text's terms are found once; a span looks its own up."""
    out, starts = [], [s for s, _, _ in spans]
    reached, furthest = [], 0
    for _, _, e in spans:
        furthest = max(furthest, e)
        reached.append(furthest)
    terms = [m.span() for m in TERMS.finditer(text)]
    begins, ends = [a for a, _ in terms], [b for _, b in terms]
    cut = lambda a, b: [m.span() for m in TERMS.finditer(text, a, b)]  # noqa: E731  of a term that a span cuts
    for start, kind, end in spans:
        entity = named(text, start, kind, end)
        i, j = bisect_right(ends, start), bisect_left(begins, end)
        left = terms[max(0, i - reach) : i] + (cut(begins[i], start) if i < len(terms) and begins[i] < start else [])
        right = (cut(end, ends[j - 1]) if j and ends[j - 1] > end else []) + terms[j : j + reach]
        for a, b in left[-reach:][::-1] + right[:reach]:
            k = bisect_left(starts, b) - 1  # the last span that begins before the term's end
            if k < 0 or reached[k] <= a:
                out.append((entity, text[a:b].lower(), a, b))
    return out


def row_key(doc_id: str, text: str) -> list[Column]:
    """128 bits that tell rows apart; equal rows have equal spans."""
    return [F.xxhash64(doc_id, text).alias("at"), F.xxhash64(F.lit("again"), text, doc_id).alias("at2")]


def found_in(docs: DataFrame, reach: int, doc_id: str, text: str) -> DataFrame:
    """A row for each row of docs: id, at and at2 (the row's key), base spans and terms around them, as parallel arrays."""

    def f(cols):
        out = {k: [] for k in ("id", "at", "at2", "start", "kind", "end", "value", "entity", "term", "term_start", "term_end")}
        for d, h, h2, t in zip(cols["id"], cols["at"], cols["at2"], cols["text"]):
            spans = base_spans(t) if t else []
            near = around(t, spans, reach) if spans else []
            out["id"].append(d)
            out["at"].append(h)
            out["at2"].append(h2)
            out["value"].append([named(t, *s) for s in spans])
            for k, v in zip(("start", "kind", "end"), zip(*spans) if spans else ([], [], [])):
                out[k].append(list(v))
            for k, v in zip(("entity", "term", "term_start", "term_end"), zip(*near) if near else ([], [], [], [])):
                out[k].append(list(v))
        return out

    kind = dict(docs.dtypes)[doc_id].replace("bigint", "long")
    rows = docs.select(F.col(doc_id).alias("id"), *row_key(doc_id, text), F.col(text).alias("text"))
    return by_batch(rows, f"id {kind}, at long, at2 long, start array<int>, kind array<int>, end array<int>, value array<string>, entity array<string>, term array<string>, term_start array<int>, term_end array<int>", f)


def term_counts(docs: DataFrame, text: str, room: int = 200_000) -> DataFrame:
    """term, n: in how many documents it stands. A task sends its counts whenever it holds room terms."""

    def f(cols):
        got, out = Counter(), {"term": [], "n": []}
        for t in cols["t"]:
            got.update(set(TERMS.findall(t.lower())) if t else ())
            if len(got) >= room:
                out["term"] += got.keys()
                out["n"] += got.values()
                got.clear()
        out["term"] += got.keys()
        out["n"] += got.values()
        return out

    return by_batch(docs.select(F.col(text).alias("t")), "term string, n long", f).groupBy("term").agg(F.sum("n").alias("n_term"))


def risky_terms(found: DataFrame, docs: DataFrame, text: str, generalise: float, remove: float) -> DataFrame:
    """entity, term, disclosure, action."""
    near = found.where("size(entity) > 0").select(F.explode(F.array_distinct(F.arrays_zip("entity", "term"))).alias("x")).select("x.entity", "x.term")
    # n documents are worth n / (n + 1) at most, so fewer can't reach the threshold
    fewest = math.ceil(generalise / (1 - generalise) - 1e-9) if generalise < 1 else 1 << 62
    together = near.groupBy("entity", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= fewest)
    entities = found.where("size(value) > 0").select(F.explode(F.array_distinct("value")).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    all_docs = found.groupBy().agg(F.count("*").alias("n_docs"))
    x = together.join(entities, "entity").join(term_counts(docs, text), "term").crossJoin(F.broadcast(all_docs))
    pmi = F.log(F.col("n_docs") * F.col("n_both") / (F.col("n_entity") * F.col("n_term")))
    x = x.withColumn("disclosure", pmi / F.log(F.col("n_docs") / F.col("n_entity")) * F.col("n_both") / (F.col("n_both") + 1))
    x = x.where((F.col("n_entity") < F.col("n_docs")) & (F.col("disclosure") >= generalise))
    return x.select("entity", "term", "disclosure", F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise").alias("action"))


def scan(docs: DataFrame, reach: int = 5, generalise: float = 0.6, remove: float = 0.9, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, at and at2, base and spans for each row of docs: arrays of structs (start,
    kind, end), spans with the revealing terms (kind 4) and their actions."""
    found = materialize(found_in(docs, reach, doc_id, text))
    risky = risky_terms(found, docs, text, generalise, remove)
    near = found.where("size(entity) > 0").select("at", "at2", F.explode(F.arrays_zip("entity", "term", "term_start", "term_end")).alias("x"))
    terms = near.select("at", "at2", "x.*").join(risky, ["entity", "term"]).groupBy("at", "at2").agg(
        F.collect_set(F.struct(F.col("term_start").alias("start"), F.lit(4).alias("kind"), F.col("term_end").alias("end"))).alias("terms"),
        F.collect_set(F.when(F.col("action") == "remove", F.col("term_start"))).alias("removed"),
    )
    base = F.transform(F.arrays_zip("start", "kind", "end"), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    rows = found.select("id", "at", "at2", base.alias("base"))
    with_terms = rows.where("size(base) > 0").join(terms, ["at", "at2"], "left")
    without = rows.where("size(base) = 0").select("id", "at", "at2", "base", F.lit(None).cast(terms.schema["terms"].dataType).alias("terms"), F.lit(None).cast("array<int>").alias("removed"))
    both = with_terms.select("id", "at", "at2", "base", "terms", "removed").unionByName(without)
    return both.select("id", "at", "at2", "base", F.array_sort(F.concat("base", F.coalesce("terms", F.expr("filter(base, x -> false)")))).alias("spans"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def listed(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def general(term: str) -> str:
    """What a term that reveals too much is replaced by: a word for its kind."""
    return "<NAME>" if term[:1].isupper() and not term.isupper() else "<ACRONYM>" if term.isupper() and len(term) > 1 else "<TERM>"


@F.pandas_udf(T.StringType())
def cleaned(texts: pd.Series, spans: pd.Series, removed: pd.Series) -> pd.Series:
    """Texts in which base spans are <KIND>, and revealing terms a general word or nothing."""
    out = []
    for t, found, gone in zip(texts, spans, removed):
        if t is None or found is None or not len(found):
            out.append(t)
            continue
        parts, at, gone = [], 0, set(gone)
        for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
            if s["start"] < at:
                continue
            term = s["kind"] == 4
            parts += [t[at : s["start"]], ("" if s["start"] in gone else general(t[s["start"] : s["end"]])) if term else f"<{KINDS[s['kind']].upper()}>"]
            at = s["end"]
        out.append("".join(parts) + t[at:])
    return pd.Series(out, dtype=object)


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """docs with text_clean, in which what scan() finds is replaced."""
    found = scan(docs, doc_id=doc_id, text=text, **parameters).where("size(spans) > 0").dropDuplicates(["at", "at2"]).select(F.col("at").alias("__at"), F.col("at2").alias("__at2"), F.col("spans").alias("__spans"), F.col("removed").alias("__removed"))
    one, two = row_key(doc_id, text)
    keyed = docs.withColumn("__one", one).withColumn("__two", two).join(found, (F.col("__one") == F.col("__at")) & (F.col("__two") == F.col("__at2")), "left")
    return keyed.withColumn("text_clean", cleaned(F.col(text), "__spans", "__removed")).drop("__one", "__two", "__at", "__at2", "__spans", "__removed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    number = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    counts = [number(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
