"""Links of Markdown: wiki links, links and images with an address, and by reference.

One pass over a text with a stack of open brackets, so brackets may nest and the
time is linear. What stands in fenced blocks or in code between backticks, and
brackets behind a backslash, is no link. A link holds no other link, but may hold
an image; of two that overlap the inner one counts. Brackets and parentheses more
than DEPTH deep are not followed, which keeps the sum of all links' texts linear too.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.StructType([T.StructField(n, T.IntegerType() if n in ("start", "end") else T.StringType()) for n in ("start", "end", "kind", "text", "href", "title")])
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[^\n]*", re.M)
DEPTH = 32
TICKS = re.compile(r"`+")
WIKI = re.compile(r"\[\[([^\[\]\n]+)\]\]")
TITLE = r"""(?:"((?:\\.|[^"\\])*)"|'((?:\\.|[^'\\])*)'|\(((?:\\.|[^()\\])*)\))"""
DEFINITION = re.compile(rf"^ {{0,3}}\[((?:\\.|[^\[\]\\\n])+)\]:[ \t]*\n?[ \t]*(<[^<>\n]*>|[^\s<]\S*)(?:[ \t]+{TITLE})?[ \t]*$", re.M)
AFTER = re.compile(rf"[ \t\n]+{TITLE}")
REFERENCE = re.compile(r"\[((?:\\.|[^\[\]\\])*)\]")
ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")
ADDRESS = re.compile(r"<([^<>\n]*)>")


def without_code(text: str) -> str:
    """The text with spaces in place of code, as long as before."""
    out = list(text)

    def blank(a: int, b: int) -> None:
        out[a:b] = [c if c == "\n" else " " for c in text[a:b]]

    at = 0
    while m := FENCE.search(text, at):
        end = re.compile(rf"^ {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$", re.M).search(text, m.end())
        at = end.end() if end else len(text)
        blank(m.start(), at)
    # runs of backticks close with the next run as long
    runs = [(m.start(), m.end()) for m in TICKS.finditer("".join(out)) if not m.start() or text[m.start() - 1] != "\\"]
    after: dict[int, int] = {}
    mate = [0] * len(runs)
    for i in reversed(range(len(runs))):
        size = runs[i][1] - runs[i][0]
        mate[i] = after.get(size, -1)
        after[size] = i
    i = 0
    while i < len(runs):
        if mate[i] < 0:
            i += 1
        else:
            blank(runs[i][0], runs[mate[i]][1])
            i = mate[i] + 1
    return "".join(out)


def plain(x: str | None) -> str | None:
    return None if x is None else ESCAPE.sub(r"\1", x)


def label(x: str) -> str:
    return " ".join(x.split()).casefold()


def address(text: str, at: int) -> tuple[int, str, str | None] | None:
    """End, address and title of ``(address "title")`` at a place."""
    n, i = len(text), at + 1
    while i < n and text[i] in " \t\n":
        i += 1
    if m := ADDRESS.match(text, i):
        href, i = m[1], m.end()
    else:
        begin, depth = i, 0
        while i < n and text[i] not in " \t\n" and (text[i] != ")" or depth) and depth <= DEPTH:
            depth += (text[i] == "(") - (text[i] == ")")
            i += 2 if text[i] == "\\" and i + 1 < n else 1
        if depth:
            return None
        href = text[begin:i]
    title = None
    if m := AFTER.match(text, i):
        title, i = next(x for x in m.groups() if x is not None), m.end()
    while i < n and text[i] in " \t\n":
        i += 1
    return (i + 1, plain(href), plain(title)) if i < n and text[i] == ")" else None


def scan(text: str | None) -> list[tuple[int, int, str, str, str, str | None]]:
    """start, end, kind (wiki, link, image), text, href and title of each link, by start."""
    if not text or "[" not in text:
        return []
    bare = without_code(text)
    known: dict[str, tuple[str, str | None]] = {}
    taken = []
    for m in DEFINITION.finditer(bare):
        title = next((x for x in m.groups()[2:] if x is not None), None)
        known.setdefault(label(m[1]), (plain(m[2].strip("<>") if m[2][0] == "<" else m[2]), plain(title)))
        taken.append((m.start(), m.end()))
    for a, b in taken:
        bare = bare[:a] + " " * (b - a) + bare[b:] if len(taken) < 8 else bare
    if len(taken) >= 8:  # one copy for all
        parts, at = [], 0
        for a, b in taken:
            parts += [bare[at:a], " " * (b - a)]
            at = b
        bare = "".join([*parts, bare[at:]])
    out, open_, live = [], [], 0  # open_: place and whether an image; those below live hold a link already
    i, n = 0, len(bare)
    while i < n:
        c = bare[i]
        if c == "\\":
            i += 2
            continue
        if c == "[":
            if m := WIKI.match(bare, i):
                ref, _, said = m[1].partition("|")
                out.append((i, m.end(), "wiki", (said or ref).strip(), ref.strip(), None))
                live = len(open_)
                i = m.end()
                continue
            if len(open_) == DEPTH:
                del open_[0]
                live = max(0, live - 1)
            open_.append((i, i > 0 and bare[i - 1] == "!" and (i < 2 or bare[i - 2] != "\\")))
        elif c == "]" and open_:
            begin, image = open_.pop()
            dead = len(open_) < live
            live = min(live, len(open_))
            inside, found = bare[begin + 1 : i], None
            if i + 1 < n and bare[i + 1] == "(":
                found = address(bare, i + 1)
            if found is None:
                end, name = i + 1, inside
                if m := REFERENCE.match(bare, i + 1):
                    end, name = m.end(), m[1] or inside
                if len(name) < 1_000 and (to := known.get(label(name))):
                    found = (end, *to)
            if found and (image or not dead):
                out.append((begin - image, found[0], "image" if image else "link", plain(text[begin + 1 : i]), found[1], found[2]))
                if not image:
                    live = len(open_)  # what is open around can't be a link any more
                i = found[0]
                continue
        i += 1
    return sorted(out)


@F.pandas_udf(T.ArrayType(SPAN))
def markdown_links(text: pd.Series) -> pd.Series:
    """start, end (code points), kind, text, href and title of a text's links, images and wiki links; empty for null."""
    return pd.Series([[dict(zip(SPAN.names, x)) for x in scan(t)] for t in text], dtype=object)
