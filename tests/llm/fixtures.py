"""Small tables with awkward rows, and plain versions of the operators."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

PROSE = (
    "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potions near the frozen lake and "
    "every evening old sailors tell stories about storms that broke their ships upon unknown northern shores"
).split()


def text(k: int, n: int = 60) -> str:
    return " ".join(PROSE[(i * (k + 3) + k) % len(PROSE)] + (str(k) if i % 4 == 0 else "") for i in range(n))


def awkward(spark, extra: str = ""):
    """Copies, near copies, nulls, empty and long texts, and columns with clashing names."""
    rows = [(0, text(0)), (1, text(0)), (2, text(0) + " more"), (3, text(3)), (4, None), (5, ""), (6, " \n\t "), (7, "two words"), (8, "two words"), (9, "Two WORDS"), (None, text(9)), (None, None), (10, text(1, 3000)), (11, text(0)), (11, text(0)), (12, text(5) + " " + text(6)), (13, "é" * 300 + " x"), (14, "é" * 300 + " y")]
    df = spark.createDataFrame([(d, t, "en", f"s{i % 2}" if i % 5 else None, len(t or "")) for i, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    for name in ("d", "t", "c", "n", "x", "h", "k", "size", "at", "score", "lang_pred", "rank"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def jaccard_components(docs):
    """doc_id: (set size, component) of (doc_id, text) rows, all pairs compared."""
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    own = {d: d for d in sets}

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                own[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def repeated_bytes(texts, length):
    """For each text: flags of the bytes that a repeated string of that length covers."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        flags = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                flags[i : i + length] = [True] * length
        out.append(flags)
    return out


def deduped_lines(docs, n=3):
    """Texts (of (doc_id, text) rows in order) without the lines of later windows."""
    first, marks = {}, defaultdict(set)
    for d, t in docs:
        lines = [x for x in (t or "").split("\n") if x.strip()]
        for k in range(len(lines) - n + 1):
            w = tuple(lines[k : k + n])
            if first.setdefault(w, (d, k)) != (d, k):
                marks[d].update(range(k, k + n))
    out = {}
    for d, t in docs:
        kept, at, some = [], 0, False
        for x in (t or "").split("\n"):
            if x.strip():
                if at not in marks[d]:
                    kept.append(x)
                    some = True
                at += 1
            else:
                kept.append(x)
        out[d] = t if not marks[d] else "\n".join(kept) if some else ""
    return out
