"""Spans of Markdown's links against goldens."""

from __future__ import annotations

import time

import pytest

from quillgraph.functions.links import markdown_links, scan

CASES = {
    "see [a](http://x) now": [(4, 17, "link", "a", "http://x", None)],
    '[a b](<x y> "t \\" u")': [(0, 21, "link", "a b", "x y", 't " u')],
    "[a [b] c](d)": [(0, 12, "link", "a [b] c", "d", None)],
    "[a](b(c)d)": [(0, 10, "link", "a", "b(c)d", None)],
    "[a](b": [],
    "\\[a](b) [c\\]d](e)": [(8, 17, "link", "c]d", "e", None)],
    "`[a](b)` [c](d)": [(9, 15, "link", "c", "d", None)],
    "``x ` [a](b)`` [c](d) `[e](f)": [(15, 21, "link", "c", "d", None), (23, 29, "link", "e", "f", None)],
    "```\n[a](b)\n```\n[c](d)": [(15, 21, "link", "c", "d", None)],
    "~~~\n[a](b)": [],
    "![p](q.png 'T')": [(0, 15, "image", "p", "q.png", "T")],
    "[![p](q)](r)": [(0, 12, "link", "![p](q)", "r", None), (1, 8, "image", "p", "q", None)],
    "[a [b](c) d](e)": [(3, 9, "link", "b", "c", None)],
    "[[ref|name]] and [[ other ]]": [(0, 12, "wiki", "name", "ref", None), (17, 28, "wiki", "other", "other", None)],
    "[a][R1] [r1][] [r1] [zz]\n\n[r1]: http://y 'T'": [(0, 7, "link", "a", "http://y", "T"), (8, 14, "link", "r1", "http://y", "T"), (15, 19, "link", "r1", "http://y", "T")],
    "![x][i]\n\n  [I]: <a b>\n": [(0, 7, "image", "x", "a b", None)],
    "": [],
    "no links [at all] (here)": [],
    "é [ü](ß)": [(2, 8, "link", "ü", "ß", None)],
    "[@key](not a link) [@key]": [],
}


@pytest.mark.parametrize("text", CASES)
def test_spans(text):
    assert scan(text) == CASES[text]


@pytest.mark.parametrize("text", ["[" * 200_000, "[a](" * 50_000, "`" * 100_000 + "[a](b)", "[[" * 100_000, "[a]" * 60_000, "![" * 60_000 + "](x)" * 60_000])
def test_time_is_linear(text):
    began = time.time()
    scan(text)
    assert time.time() - began < 10


def test_as_a_column(spark):
    df = spark.createDataFrame([("[a](b)",), (None,), ("x",)], "t string")
    assert [[tuple(x) for x in r.l] for r in df.select(markdown_links("t").alias("l")).collect()] == [[(0, 6, "link", "a", "b", None)], [], []]
