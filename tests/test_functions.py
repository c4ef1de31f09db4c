from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.functions import markup as m
from quillgraph.functions import tagging as g
from quillgraph.functions import text as t
from quillgraph.operators import notes, upkeep

STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size
hopping hop tanned tan falling fall hissing hiss failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit radicalli radic
differentli differ analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit
sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop
adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ effective effect bowdlerize bowdler probate probat
rate rate cease ceas controll control roll roll""".split()


@pytest.mark.parametrize("word,stem", list(zip(STEMS[::2], STEMS[1::2])))
def test_stem(word, stem):
    assert t.stem(word) == stem


def test_tokens():
    got = t.tokens("机器学习方法与深度学习方法")
    assert [got.count(x) for x in ("机器", "学习", "方法", "法与", "与深")] == [1, 2, 2, 0, 0]
    assert t.tokens(None) == [] and t.tokens("The 12 x Networks") == ["network"]
    assert t.features("deep nets of 机器学") == ["w:deep", "w:net", "b:deep net", "c:机器", "c:器学", "c:机器学"]


def test_clean(spark):
    lead = "body text that is long enough to count here"
    cases = {
        "hyphen-\nated see https://x.org/a 10.1000/xyz": "hyphenated see    ",
        "same line\n" * 4 + "other": "other",
        "same line\n" * 3 + "other": "same line\n" * 3 + "other",
        f"{lead}\nReferences\nx": lead,
        f"{lead}\n References \n": lead,
        f"x\nReferences\n{lead}": f"x\nreferences\n{lead}",
        "ＡＢ": "ab",
        None: "",
    }
    rows = t.clean(spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, text string"), "text", "clean").collect()
    assert {r.i: r.clean.strip() for r in rows} == {i: c.strip() for i, c in enumerate(cases.values())}


def test_merge3():
    assert m.merge3("a\nb\nc\nd\ne", "A\nb\nc\nd\ne", "a\nb\nc\nd\nE") == "A\nb\nc\nd\nE"
    assert m.merge3("a\nb", "a\nx", "a\ny") is None
    assert m.merge3("a", "a\nb", "a\nc") is None
    assert m.merge3("a\nb\nc", "a\nx\nc", "a\nx\nc") == "a\nx\nc"
    assert m.merge3("a", "a", "b") == "b"
    assert m.merge3("a\nb\nc", "A\nb\nc", "a\nB\nc") == "A\nB\nc"  # neighbours don't collide
    base = "# T\n\nFirst paragraph.\n\nSecond paragraph.\n"
    assert m.merge3(base, base.replace("First paragraph.\n\n", ""), base.replace("Second", "Remote")) == base.replace("First paragraph.\n\n", "").replace("Second", "Remote")
    assert m.merge3(base, base + "A", base + "B") is None and m.merge3(base, base + "New\n", base.replace("First", "Other")) == base.replace("First", "Other") + "New\n"
    large = "\n".join(f"Line {i}" for i in range(1500))
    assert m.merge3(large, f"L\n{large}\nL", f"R\n{large}\nR") is None
    for i in range(30):
        old = [f"line {j}" for j in range(20)]
        left, right, both = list(old), list(old), list(old)
        left[i % 10] = both[i % 10] = "left"
        right[10 + i % 10] = both[10 + i % 10] = "right"
        assert m.merge3("\n".join(old), "\n".join(left), "\n".join(right)) == "\n".join(both)


lines = st.lists(st.sampled_from("abcd"), min_size=1, max_size=8).map("\n".join)


@given(lines, lines)
def test_merge_with_one_side(base, other):
    assert m.merge3(base, other, base) == other == m.merge3(base, base, other)
    parts = m.changes(base.split("\n"), other.split("\n"))
    out, at, old = [], 0, base.split("\n")
    for a, b, new in parts:
        out += [*old[at:a], *new]
        at = b
    assert out + old[at:] == other.split("\n")


def test_math_spans():
    assert [x[2:] for x in m.math_spans(r"a $x+1$ \(y\) $$z$$ \$5 `$c$`")] == [("x+1", False), ("y", False), ("z", True)]
    assert m.math_spans(r"$x_{a$b}$")[0][2] == "x_{a$b}"
    assert m.math_spans(None) == []
    assert m.math_spans(r"Prices $5 and $10; escaped \$20; literal \\(x\\) and \\[x\\].") == []
    for none in (r"Broken \(x and \[x", "\\(x\ny\\)", r"\(\frac{x}{y\)", r"[[Note\(id\)]] [@Cite\(id\)] https://example.test/\(path\)", "[[a $x$ b]]", "$ x$", "$x $", "$x$5", r"\( \)"):
        assert m.math_spans(none) == [], none
    assert m.math_spans(r"\[\text{\]} + x\]")[0][2] == r"\text{\]} + x"
    assert [x[2] for x in m.math_spans("\\[y\n z\\] and $$a$b$$")] == ["y\n z", "a$b"]


def test_html():
    assert m.html_to_markdown("<h1>Hi</h1><p>a <b>b</b> <a href='u'>c</a></p><ul><li>x</li><li>y</li></ul><script>no</script>") == "# Hi\n\na **b** [c](u)\n\n- x\n- y"
    assert m.html_to_markdown(None) == ""


def test_tag_names():
    assert g.key("#deepLearning_nets") == "deep learning nets"
    assert g.key("ＡＩ") == g.key("AI") == "ai"
    terms = g.Terms.of(["CNN"], [{"name": "Convolutional Network", "forms": ["convnet"]}])
    reason = lambda a, b: g.duplicate_reason(g.key(a), g.key(b), terms)
    assert reason("deep-learning", "Deep Learning") == "name"
    assert reason("convnet", "convolutional network") == "alias"
    assert reason("graph neural network (gnn)", "GNN") == "abbreviation"
    assert reason("neural networks", "neural network") == "plural"
    assert reason("optimisation", "optimization") == "spelling"
    assert reason("GPT-2", "GPT-3") is None and reason("C++", "C#") is None and reason("supervised", "unsupervised") is None
    with pytest.raises(ValueError):
        g.Terms.of(["a", "A"], [])
    with pytest.raises(ValueError):
        g.Terms.of([], [{"name": "x", "forms": ["z"]}, {"name": "y", "forms": ["z"]}])


@given(st.text(alphabet="abcxyz", min_size=7, max_size=10), st.text(alphabet="abcxyz", min_size=7, max_size=10))
def test_spelling_pairs_share_a_signature(a, b):
    if g.duplicate_reason(a, b):
        assert set(g.signatures(a)) & set(g.signatures(b))


def test_tag_format():
    terms = g.Terms.of(["LaTeX"], [])
    assert g.formatted("  #deep   Learning  ") == "Deep learning"
    assert g.formatted("co-attention (graph-based)", "title", True) == "#Co-Attention (Graph-Based)"
    assert g.formatted("a/b c") == "a/b c" and g.formatted("use of latex", terms=terms) == "Use of LaTeX"
    assert g.formatted(g.formatted("NLP for iOS apps")) == g.formatted("NLP for iOS apps") == "NLP for iOS apps"


def test_phrases(spark):
    texts = ["We study graph neural networks and 3 deep models in practice. Fast image retrieval", "", None]
    got = spark.createDataFrame([(x,) for x in texts], "t string").select(g.phrase_candidates("t").alias("p")).collect()
    assert sorted(got[0].p) == ["3 deep", "3 deep models", "Fast image", "Fast image retrieval", "graph neural", "graph neural networks", "image retrieval", "neural networks"] and got[1].p == [] and got[2].p is None
    names = [("graph neural networks", False), ("graph neural", False), ("models", True), ("retrieval", True), ("retrieval", False), ("GNN", False), ("AI", False), ("C++", False), ("研究方法", True), ("图神经网络", False), ("proposed method", False), ("et al data", False), ("via graphs ok", False)]
    rows = spark.createDataFrame(names, "name string, existing boolean").withColumn("normal", g.normal_text("name"))
    kept = {(r.name, r.existing) for r in rows.where(g.specific("name", "normal", "existing")).select("name", "existing").collect()}
    assert kept == {("graph neural networks", False), ("retrieval", True), ("GNN", False), ("C++", False), ("图神经网络", False)}
    counts = spark.createDataFrame([("a b a b", "a b", 2), ("a a a", "a a", 1), ("x ab", "a", 0), ("", "a", 0), ("a", "", 0), ("a", "a", 1)], "t string, p string, n int")
    assert counts.where(g.occurrences("t", "p") != F.col("n")).count() == 0


def test_exclusions():
    r = g.Exclusions.of("Foo Bar, tmp*\n@auto，@colored", ("Red",))
    assert r.automatic and r.colored and r.keys == {"foo bar", "red"} and r.patterns == ["^tmp.*$"]


def test_query_terms():
    assert notes.query_terms('Foo "bar baz" foo') == ["foo", "bar baz"]
    with pytest.raises(ValueError):
        notes.query_terms("x" * 3000)
    with pytest.raises(ValueError):
        notes.query_terms(" ".join(map(str, range(17))))


def test_epochs():
    assert not upkeep.epoch_due(10_000, 499) and upkeep.epoch_due(10_000, 500) and upkeep.epoch_due(10, 0, False) and upkeep.epoch_due(100, 50)
