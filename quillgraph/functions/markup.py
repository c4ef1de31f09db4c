"""Links, citations, math, HTML, and merging of texts."""

from __future__ import annotations

import re
from bisect import bisect_right
from html.parser import HTMLParser
from itertools import chain, pairwise, product
from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CODE = r"(?s)```.*?```|`[^`\n]*`"


def links(text: str | Column) -> Column:
    """ref and alias of [[ref|alias]] outside code, the first of each ref."""
    bare = F.regexp_replace(text, CODE, " ")
    found = F.transform(F.regexp_extract_all(bare, F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1)), lambda x: F.struct(F.trim(F.split_part(x, F.lit("|"), F.lit(1))).alias("ref"), F.trim(F.split_part(x, F.lit("|"), F.lit(2))).alias("alias")))
    refs = F.transform(found, lambda x: x["ref"])
    return F.filter(found, lambda x, i: F.array_position(refs, x["ref"]) == i + 1)


def citation_keys(text: str | Column) -> Column:
    """Distinct keys of [@key], unless a link's address follows."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(text, CODE, " "), F.lit(r"\[@([^\[\]\s]+)\](?!\()"), F.lit(1)))


def asset_names(text: str | Column) -> Column:
    """Names of files under assets/ that links, images, and src or href of HTML lead to, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"""(?:\]\(|(?:src|href)=["'])assets/([^)"'\s]+)"""), F.lit(1)))


LINK = r"\[\[[^\[\]]+\]\]"


def refreshed(text: str | Column, labels: str | Column) -> Column:
    """The text with the links [[ref]] and [[ref|label]] that labels (a map of
    ref: struct(reference, label, old)) names written as [[reference|label]];
    a label that a user has chosen, other than the old one, stays."""
    text, labels = (x if isinstance(x, Column) else F.col(x) for x in (text, labels))
    between = F.split(text, LINK)

    def again(link: Column) -> Column:
        inside = F.substring(link, F.lit(3), F.length(link) - 4)
        ref, alias = F.trim(F.split_part(inside, F.lit("|"), F.lit(1))), F.trim(F.split_part(inside, F.lit("|"), F.lit(2)))
        now = F.try_element_at(labels, ref)
        own = (alias != "") & (alias != F.coalesce(now["old"], F.lit("")))
        return F.when(now.isNull(), link).otherwise(F.concat(F.lit("[["), now["reference"], F.lit("|"), F.when(own, alias).otherwise(now["label"]), F.lit("]]")))

    links = F.transform(F.regexp_extract_all(text, F.lit(LINK), F.lit(0)), again)
    return F.array_join(F.transform(F.arrays_zip(between.alias("a"), links.alias("b")), lambda p: F.concat(p["a"], F.coalesce(p["b"], F.lit("")))), "")


def plain(text: str | Column) -> Column:
    """Text without the marks of Markdown."""
    x = F.regexp_replace(text, r"\[\[([^\[\]|]+\|)?([^\[\]]+)\]\]", "$2")
    x = F.regexp_replace(x, r"!?\[([^\[\]]*)\]\([^)]*\)", "$1")
    x = F.regexp_replace(x, r"(?m)^\s{0,3}(?:#{1,6}|>|[-*+])\s+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[*`~]+", ""), r"\s+", " "))


def snippet(text: str | Column, keywords: list[str], length: int = 110, before: int = 30) -> Column:
    """length characters from a little before the first keyword, with ellipses where something is left out."""
    x = plain(text)
    at = F.coalesce(F.array_min(F.filter(F.array(*[F.instr(F.lower(x), k.lower()) for k in keywords]), lambda p: p > 0)), F.lit(1)) if keywords else F.lit(1)
    start = F.greatest(F.lit(1), at - before)
    return F.concat(F.when(start > 1, "…").otherwise(""), F.substring(x, start, F.lit(length)), F.when(F.length(x) >= start + length, "…").otherwise(""))


def contexts(text: str | Column, ref: str | Column, most: int = 3) -> Column:
    """Distinct paragraphs that hold the reference, the first few."""
    paragraphs = F.split(text, r"\n\s*\n")
    return F.slice(F.array_distinct(F.filter(paragraphs, lambda p: F.contains(p, ref if isinstance(ref, Column) else F.col(ref)))), 1, most)


def citation_block(text: str | Column, title: str | Column, page: str | Column) -> Column:
    """A quotation, each line after '> ', with its source's title (60 characters) and page."""
    quoted = F.regexp_replace(F.regexp_replace(text, r"([\\`*_\[\]<>])", r"\\$1"), r"(?m)^", "> ")
    head = F.when(F.length(title) > 60, F.concat(F.substring(title, 1, 60), F.lit("…"))).otherwise(title)
    return F.concat(quoted, F.lit("\n\n"), head, F.coalesce(F.concat(F.lit(", p. "), page), F.lit("")))


def source_line(creator: str | Column, year: str | Column, title: str | Column, publication: str | Column) -> Column:
    """Creator year. <i>title</i>. publication."""
    escaped = F.replace(F.replace(F.replace(title, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    who = F.nullif(F.trim(F.concat_ws(" ", creator, year)), F.lit(""))
    return F.concat(F.array_join(F.array_compact(F.array(who, F.concat(F.lit("<i>"), escaped, F.lit("</i>")), F.nullif(publication, F.lit("")))), ". "), F.lit("."))


# ---- math

# What formulas may not touch (note links, citations, addresses), and code.
OPAQUE = re.compile(r"(?i)\[\[[^\]\n]+\]\]|\[@[^\]\n]+\]|\b[a-z][a-z0-9+.-]*://[^\s<>]+|```(?s:.*?)```|`[^`\n]*`")
#: A character with its backslash, or a run of dollars.
MARK = re.compile(r"\\(?s:.)|\$+")
#: Of each opening mark: whether the formula is displayed, and the pieces in which its end is looked for.
PIECES = {
    r"\(": (False, re.compile(r"\\(?s:.)|[{}\r\n]")),
    r"\[": (True, re.compile(r"\\(?s:.)|[{}]")),
    "$": (False, re.compile(r"\\(?s:.)|[{}\r\n$]")),
    "$$": (True, re.compile(r"\\(?s:.)|[{}]|\$\$")),
}
CLOSING = {r"\(": r"\)", r"\[": r"\]", "$": "$", "$$": "$$"}


def formula_end(text: str, opening: str, start: int) -> int | None:
    """Where the mark that closes a formula stands, outside braces; None if a
    line ends before (unless displayed) or braces close that weren't opened."""
    open_braces = 0
    for m in PIECES[opening][1].finditer(text, start):
        if m[0] == CLOSING[opening] and not open_braces:
            return m.start()
        if m[0] in "\r\n":
            return None
        open_braces += {"{": 1, "}": -1}.get(m[0], 0)
        if open_braces < 0:
            return None
    return None


def math_spans(text: str | None) -> list[tuple[int, int, str, bool]]:
    r"""start, end, formula and whether it is displayed, of \(..\), \[..\], $..$
    and $$..$$. Escaped marks open nothing, formulas touch no link, citation,
    address or code, those within a line don't leave it, and a lone dollar needs
    text right behind it, right before its partner, and no digit after that."""
    t, out, at = text or "", [], 0
    opaque = [m.span() for m in OPAQUE.finditer(t)]
    ends = [b for _, b in opaque]
    while m := MARK.search(t, at):
        start, at = m.span()
        k = bisect_right(ends, start)  # the first that ends after the mark begins
        if k < len(opaque) and opaque[k][0] <= start:
            at = ends[k]
            continue
        opening = m[0][:2]
        if opening not in PIECES or (end := formula_end(t, opening, start + len(opening))) is None:
            continue
        inner, close = t[start + len(opening) : end], end + len(CLOSING[opening])
        loose = opening == "$" and (inner != inner.strip() or t[close : close + 1] == "$" or t[close : close + 1].isdecimal())
        if not inner.strip() or loose or (k < len(opaque) and opaque[k][0] < close):
            continue
        out.append((start, close, inner.strip(), PIECES[opening][0]))
        at = close
    return out


@F.udtf(returnType=T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("latex", T.StringType()), T.StructField("display", T.BooleanType())]))
class MathSpans:
    """A row for each formula of a text."""

    def eval(self, text: str):
        yield from math_spans(text)


# ---- HTML


class Markdown(HTMLParser):
    """Collects a page as Markdown."""

    HEADS = {f"h{k}": "#" * k + " " for k in range(1, 7)}
    ROUND = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "del": "~~", "s": "~~"}
    BLOCKS = {"p", "div", "section", "article", "ul", "ol", "table", "tr", "blockquote", "pre", "header", "footer", "main", "nav", *HEADS}
    HIDDEN = {"script", "style", "head", "noscript", "template"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden, self.lists, self.href = [], 0, [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag in self.BLOCKS:
            self.out.append("\n\n" + self.HEADS.get(tag, "> " if tag == "blockquote" else ""))
            if tag in ("ul", "ol"):
                self.lists.append([tag, 0])
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + ("- " if kind[0] == "ul" else f"{kind[1]}. "))
        elif tag == "br":
            self.out.append("\n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag in self.ROUND:
            self.out.append(self.ROUND[tag])
        elif tag == "a":
            self.href.append(a.get("href") or "")
            self.out.append("[")
        elif tag == "img":
            self.out.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag in ("td", "th"):
            self.out.append(" | ")

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.BLOCKS:
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
            self.out.append("\n\n")
        elif tag in self.ROUND:
            self.out.append(self.ROUND[tag])
        elif tag == "a" and self.href:
            self.out.append(f"]({self.href.pop()})")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(re.sub(r"\s+", " ", data))

    def text(self) -> str:
        t = re.sub(r"[ \t]*\n[ \t]*(?=\S|\n)", lambda m: "\n" + m[0].rpartition("\n")[2], "".join(self.out))
        return re.sub(r"\n{3,}", "\n\n", t).strip()


def html_to_markdown(html: str | None) -> str:
    p = Markdown()
    p.feed(html or "")
    p.close()
    return p.text()


@F.pandas_udf(T.StringType())
def markdown_of(html: pd.Series) -> pd.Series:
    return html.map(html_to_markdown)


# ---- three-way merge of lines

MOST_CELLS = 1_000_000


def common_lines(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence. The table's rows are made as
    wholes: the best without this line, or with it, from here to the end on."""
    code = {line: k for k, line in enumerate({*x, *y})}
    a, b = (np.array([code[line] for line in z], np.int64) for z in (x, y))
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in reversed(range(len(a))):
        best = np.where(b == a[i], table[i + 1, 1:] + 1, table[i + 1, :-1])
        table[i, :-1] = np.maximum.accumulate(best[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif table[i, j + 1] > table[i + 1, j]:
            j += 1
        else:
            i += 1
    return out


def changes(base: list[str], other: list[str]) -> list[tuple[int, int, tuple[str, ...]]] | None:
    """Ranges of base with the lines that stand there instead: the gaps between
    the lines in common. None if a table of MOST_CELLS can't tell."""
    head = len(commonprefix([base, other]))
    tail = len(commonprefix([base[head:][::-1], other[head:][::-1]]))
    x, y = base[head : len(base) - tail], other[head : len(other) - tail]
    if x and y and (len(x) + 1) * (len(y) + 1) > MOST_CELLS:
        return None
    same = [(-1, -1), *common_lines(x, y), (len(x), len(y))]
    gaps = ((i + 1, j + 1, i2, j2) for (i, j), (i2, j2) in pairwise(same))
    return [(head + i, head + i2, tuple(y[j:j2])) for i, j, i2, j2 in gaps if i < i2 or j < j2]


def collide(p: tuple, q: tuple) -> bool:
    """Whether two changes can't both be made: their ranges share a line, or one inserts where the other ends or begins."""
    reach = 0 if p[0] == p[1] or q[0] == q[1] else 1
    return max(p[0], q[0]) + reach <= min(p[1], q[1])


def merge3(base: str | None, local: str | None, remote: str | None) -> str | None:
    """Both sides' changes of base, or None if any collide; the same change on both sides counts once."""
    base, local, remote = base or "", local or "", remote or ""
    if base in (local, remote) or local == remote:
        return local if remote == base else remote
    old = base.split("\n")
    ours, theirs = (changes(old, side.split("\n")) for side in (local, remote))
    if ours is None or theirs is None or any(collide(p, q) for p, q in product(ours, {*theirs} - {*ours})):
        return None
    made = sorted({*ours, *theirs})
    starts, ends = [c[0] for c in made], [c[1] for c in made]
    kept = [old[i:j] for i, j in zip([0, *ends], [*starts, len(old)])]
    return "\n".join([*kept[0], *chain.from_iterable((*new, *rest) for (_, _, new), rest in zip(made, kept[1:]))])


@F.pandas_udf(T.StringType())
def merge3_of(base: pd.Series, local: pd.Series, remote: pd.Series) -> pd.Series:
    return pd.Series([merge3(*x) for x in zip(base, local, remote)], dtype=object)
