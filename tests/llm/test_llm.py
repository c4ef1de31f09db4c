from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from fixtures import awkward, deduped_lines, jaccard_components, repeated_bytes, text
from pyspark.sql import functions as F

llm = pytest.importorskip("quillgraph.llm")

from quillgraph.llm import chat, common, decontamination, embedding_dedup, language_id, line_dedup, mixing, ngram_join, pii, quality, suffix_dedup  # noqa: E402

# ---- shared helpers


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 240)]
    links = spark.createDataFrame(pairs, "a long, b long")
    own = {x: x for p in pairs for x in p}

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        own[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in common.components(links).collect()}
    want = {x: find(x) for a, b in pairs if a != b for x in (a, b)}
    assert got == want
    assert common.components(links.limit(0)).count() == 0


# ---- 1 decontamination


def score_by_table(a, b):
    """Smith-Waterman, cell by cell."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
    return max(map(max, h))


def test_alignment_against_the_table():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.integers(1, 5, rng.integers(1, 12)), rng.integers(1, 5, rng.integers(1, 20))
        score, start, end = decontamination.align(a, b)
        assert score == score_by_table(a, b)
        if score:
            assert 0 <= start < end <= len(b) and score_by_table(a, b[start:end]) == score


def test_leaks(spark):
    items = [(1, text(20, 30)), (2, text(21, 30)), (3, "ok go"), (4, None), (5, "..."), (2, text(21, 30)), (6, text(22, 700))]
    words = text(20, 30).split()
    edited = " ".join(w if i % 9 else "changed" for i, w in enumerate(words))
    docs = [(0, f"{text(1)} {text(20, 30).upper()}! {text(2)}"), (1, f"{text(3)} {edited} {text(4)}"), (2, text(5)), (3, " ".join(words[:6]) + " " + text(6)), (4, None), (5, ""), (6, "say OK, go now"), (7, text(22, 700)), (7, text(22, 700))]
    got = decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = sorted((r.doc_id, r.item_id) for r in got.collect())
    assert found == [(0, 1), (1, 1), (6, 3), (7, 6), (7, 6)]
    assert all(r.score == 1.0 for r in got.collect() if r.doc_id != 1)
    blocks = decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=400)
    assert sorted((r.doc_id, r.item_id) for r in blocks.collect()) == found


def test_leaks_by_few_seeds(spark):
    words = text(20, 30).split()
    edited = " ".join("changed" if i % 4 == 0 else w for i, w in enumerate(words))
    items = spark.createDataFrame([(1, " ".join(words)), (2, text(23, 8))], "item_id long, text string")
    half = " ".join(text(23, 8).split()[:4])
    docs = spark.createDataFrame([(0, f"{text(1)} {edited} {text(2)}"), (1, f"{text(3)} {half} {text(4)}"), (2, text(5))], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.find_leaks(docs, items).collect()}
    assert got == {(0, 1): 37 / 60, (1, 2): 0.5}
    assert [r.doc_id for r in decontamination.without_leaks(docs, items).collect()] == [2]


def test_leaks_over_a_long_gap():
    item = [f"w{i}" for i in range(100)]
    words = item[:28] + [f"x{i}" for i in range(60)] + ["y" if i % 3 == 0 else item[i] for i in range(28, 100)]
    (got,) = decontamination.Items([(1, " ".join(item))]).leaks(" ".join(words), 0.3)
    assert got[1] == score_by_table(item, words) / 200


def test_leaks_against_all_pairs(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 9, 14, 30])))) for i in range(30)] + [(30, " ".join(rng.choice(vocabulary) for _ in range(400)))]
    docs = []
    for d in range(40):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(30))]
        copy = items[rng.randrange(len(items))][1].split()
        for _ in range(rng.randrange(1 + len(copy) // 3)):
            copy[rng.randrange(len(copy))] = rng.choice([*vocabulary, "other"])
        docs.append((d, " ".join([*w, *copy[rng.randrange(len(copy)) if d % 4 == 0 else 0 :], *w[::-1]])))
    number = {w: i + 1 for i, w in enumerate([*vocabulary, "other"])}
    coded = lambda t: [number[w] for w in t.split()]
    want = {}
    for d, t in docs:
        for i, u in items:
            a, b = coded(u), coded(t)
            n = min(3, len(a))
            if {tuple(a[k : k + n]) for k in range(len(a) - n + 1)} & {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} and (s := score_by_table(a, b)) >= len(a):
                want[d, i] = s / (2 * len(a))
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and len(want) > 40


@pytest.mark.parametrize("n", [384, 385, 700, 3000])
def test_leaks_of_long_items(n):
    item = [f"w{i}" for i in range(n)]
    leaks = lambda k: decontamination.Items([(1, " ".join(item))]).leaks(" ".join(["a"] * 50 + item[:k] + ["b"] * 50), 0.5)
    half = -(-n // 2)
    assert leaks(half) == [(1, half / n, 50, 50 + half)] and leaks(half - 1) == []


def test_leaks_of_nothing(spark):
    docs, none = awkward(spark), spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_leaks(docs, none).count() == 0
    kept = decontamination.without_leaks(docs, spark.createDataFrame([(0, text(0))], "item_id long, text string"))
    assert kept.columns == docs.columns and kept.where("doc_id in (0, 1, 2, 11)").count() == 0 and kept.count() == docs.count() - 5
    assert decontamination.find_leaks(docs.limit(0), spark.createDataFrame([(0, text(0))], "item_id long, text string")).count() == 0


# ---- 2 personal data


def base_by_patterns(t):
    t, out = t or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = digits(m[0])
        total = sum(int(x) if i % 2 == 0 else sum(map(int, str(2 * int(x)))) for i, x in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_base_spans():
    for t in ("a@b@c.d", "@b.c@d.e", "x@y.z@q.r", "1.2.3.4.5.6.7.8", "999.1.1.1.1", "4111 1111 1111 1111", "+1 (415) 555-2671 x", "+1+1 (415) 555-2671", "001.002.003.0255", "1.1.1.0000000256", "", "4111-1111-1111-1111 4"):
        assert pii.base_spans(t) == base_by_patterns(t), t
    rng = random.Random(5)
    for _ in range(3000):
        t = "".join(rng.choice("a1@.+- (2)0é") for _ in range(rng.randrange(40)))
        assert pii.base_spans(t) == base_by_patterns(t), t


def test_terms_that_disclose(spark):
    docs = [(i, f"filler{i} words about Zanzibar call +1 415 555 2671 please everyone{i}") for i in range(4)] + [(i, f"nothing here about filler{i} everyone please") for i in range(4, 60)] + [(99, None), (98, ""), (4, "Zanzibar alone")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.id: r.spans for r in pii.scan(df).collect()}
    terms = {docs[i][1][s["start"] : s["end"]] for i in range(4) for s in got[i] if s["kind"] == 4}
    assert "Zanzibar" in terms and not terms & {"about", "please"}
    assert got[99] == [] and got[98] == []
    clean = {r.doc_id: r.text_clean for r in pii.sanitise(df).where("doc_id < 3").collect()}
    assert all("<PHONE>" in t and "Zanzibar" not in t for t in clean.values())
    assert pii.scan(awkward(spark)).count() == awkward(spark).count() and pii.scan(df.limit(0)).count() == 0


def disclosures(docs, reach, generalise):
    """(doc, start, end) of revealing terms, with all pairs of entities and terms recounted."""
    term = re.compile(r"[^\W\d_]{2,}")
    near, entities, terms = defaultdict(set), defaultdict(set), defaultdict(set)
    at = []
    for i, (_, t) in enumerate(docs):
        t = t or ""
        words = [m.span() for m in term.finditer(t)]
        for a, b in words:
            terms[t[a:b].lower()].add(i)
        spans = base_by_patterns(t)
        for s, kind, e in spans:
            name = pii.named(t, s, kind, e)
            entities[name].add(i)
            left, right = [w for w in (m.span() for m in term.finditer(t[:s]))][::-1][:reach], [(a + e, b + e) for a, b in (m.span() for m in term.finditer(t[e:]))][:reach]
            for a, b in left + right:
                if not any(x < b and a < y for x, _, y in spans):
                    near[name, t[a:b].lower()].add(i)
                    at.append((i, a, b, name, t[a:b].lower()))
    out, n = set(), len(docs)
    for i, a, b, name, w in at:
        both, p, q = len(near[name, w]), len(entities[name]), len(terms[w])
        if p < n and np.log(n * both / (p * q)) / np.log(n / p) * both / (both + 1) >= generalise:
            out.add((i, a, b))
    return out


def test_disclosure_against_a_recount(spark):
    rng = random.Random(12)
    names, numbers = ["Ada", "Bo", "Chen", "Dora", "Xi"], [f"+1 415 555 26{k:02}" for k in range(5)]
    docs = []
    for i in range(120):
        k = rng.randrange(5)
        filler = [rng.choice(["alpha", "beta", "gamma", "the", "of", "we"]) for _ in range(rng.randrange(12))]
        docs.append((i, " ".join([*filler, names[k] if rng.random() < 0.8 else "", numbers[k] if rng.random() < 0.5 else "", *filler[::-1], f"mail{k % 2}@x.org" if rng.random() < 0.2 else ""])))
    docs += [(200, "Q" * 3), (201, None), (202, "Zed" + " " * 5000 + "ring +44 20 7946 0958"), (203, "Zed" + "." * 900 + "+44 20 7946 0958 ring")]
    for reach, least in ((2, 0.5), (5, 0.6)):
        got = {(r.id, s["start"], s["end"]) for r in pii.scan(spark.createDataFrame(docs, "doc_id long, text string"), reach=reach, generalise=least).collect() for s in r.spans if s["kind"] == 4}
        want = {(docs[i][0], a, b) for i, a, b in disclosures(docs, reach, least)}
        assert got == want and want
    assert {x for x in got if x[0] in (202, 203)} >= {(202, 0, 3), (203, 0, 3)}  # two documents and a long way off are enough


def test_terms_without_spaces():
    assert [m[0] for m in pii.TERMS.finditer("張偉 Jo हिन्दी a")] == ["張偉", "Jo", "हिन्दी"]
    places = lambda text, span, reach: [(a, b) for _, _, a, b in pii.around(text, [span], reach)]
    assert places("張偉先生 +1", (5, 3, 7), 3) == [(2, 4), (0, 2)] and places("x" * 3000 + " ab +1", (3004, 3, 3006), 2) == [(3001, 3003), (0, 3000)]
    assert places("éèa@b.coéè x", (2, 0, 8), 2) == [(0, 2), (8, 10)]  # terms that the span cuts


def test_very_many_spans_in_one_text():
    import time

    text = " ".join(f"+49 123 456 {i:05}" for i in range(20_000))
    began = time.time()
    spans = pii.base_spans(text)
    assert len(spans) == 20_000 and pii.around(text, spans, 5) == [] and time.time() - began < 20


# ---- 3 n-gram join


def test_ngram_join(spark):
    rng = random.Random(8)
    docs = []
    for i in range(160):
        w = text(i % 9, 70).split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(30)}"
        docs.append((i, " ".join(w)))
    docs += [(200, None), (201, ""), (202, "a b"), (203, "A  b"), (204, "a b c d e"), (205, text(50, 2000)), (206, text(50, 1990))]
    got = ngram_join.near_documents(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == jaccard_components(docs)


def test_ngram_join_goes_on_from_what_is_linked(spark, monkeypatch):
    """Components are made anew only if there are new links, and from stars instead of all links."""
    words = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame([(k, " ".join(words[: 190 + k])) for k in range(8)], "doc_id long, text string")
    asked, real = [], ngram_join.components
    monkeypatch.setattr(ngram_join, "components", lambda links: asked.append(links.count()) or real(links))
    assert {r.component_id for r in ngram_join.near_documents(docs).collect()} == {0}
    assert len(asked) == 1


def test_ngram_join_of_awkward_rows(spark):
    docs = awkward(spark)
    got = ngram_join.near_documents(docs).collect()
    by = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert len(got) == docs.count() and by[1] == by[2] == by[11] == 0 and by[8] == by[9] == 7 and by[4] == 4
    assert sum(r.component_id is None for r in got) == 2
    kept = ngram_join.stage(spark, docs, "")
    assert kept.columns == docs.columns and kept.where("doc_id in (1, 2, 8, 9, 11)").count() == 0
    assert ngram_join.near_documents(docs.limit(0)).count() == 0


# ---- 4 language


def test_language(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    got = language_id.query(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95 and got.score.between(0, 1).all()


def test_language_of_awkward_rows(spark):
    docs = awkward(spark)
    model = language_id.fit(docs)
    got = language_id.identify(docs.select("doc_id", "text"), model).collect()
    assert {r.lang_pred for r in got} == {"en", "und"} and len(got) == docs.count()
    assert all(r.lang_pred == "und" for r in got if not (r.text or "").strip())
    nothing = language_id.identify(docs.select("doc_id", "text"), language_id.fit(docs.limit(0)))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    kept = language_id.stage(spark, docs, "")
    assert kept.columns == docs.columns and kept.where("text is null").count() == 0


def test_words_are_letters(spark):
    rows = [(i, f"हिन्दी भाषा में लिखा {i}", "hi") for i in range(3)] + [(i, f"plain words in english {i}", "en") for i in range(3)] + [(9, "½ ² Ⅷ ①", "en")]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert "हिन्दी" in model.items[0] and not {"ह", "न"} & set(model.items[0])
    score = language_id.Scorer(model).score
    assert score("½ ² ①") == ("und", 0.0) and score("12 34 !")[0] == "und"
    assert score("भाषा")[0] == "hi" and score("english words")[0] == "en"
    assert score("zzz qqq")[0] == "en" and score("")[0] == "und"  # nothing known: the first language


def test_very_many_languages(spark):
    """A rare language is learned, however many others and however long their texts."""
    rows = [(f"l{k:03}", f"word{chr(97 + k % 26)}{chr(97 + k // 26)}x tail{chr(97 + k % 26)}{chr(97 + k // 26)}y " * (40 if k else 2)) for k in range(260)]
    rows = [(x, t.replace("word", "w")) for x, t in rows]
    model = language_id.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert len(model.langs) == 260
    score = language_id.Scorer(model).score
    assert all(score(t)[0] == x for x, t in rows[:5] + rows[-5:])


def test_languages_of_copies(spark):
    """Four languages of one sentence in thousands of copies, one of many texts; a sample far smaller than the rows."""
    said = {"de": "der hund läuft schnell über die straße", "es": "el perro corre rápido por la calle", "fr": "le chien court vite dans la rue", "it": "il cane corre veloce per la strada"}
    copies = spark.createDataFrame([*said.items()], "lang string, text string").crossJoin(spark.range(5_000)).select("lang", "text")
    many = spark.range(5_000).select(F.lit("en").alias("lang"), F.concat(F.lit("the cat sat on mat number "), F.col("id").cast("string"), F.lit(" and the dog ran")).alias("text"))
    mute = spark.createDataFrame([("xx", "12 34"), ("yy", "")], "lang string, text string")
    model = language_id.fit(copies.union(many).union(mute), docs_per_lang=200)
    assert model.langs == ["de", "en", "es", "fr", "it"]
    score = language_id.Scorer(model).score
    assert all(score(t)[0] == k for k, t in said.items())
    assert score("the cat sat")[0] == "en" and score("the cat sat")[1] > 0.9
    assert score("die straße")[0] == "de" and score("qqqq")[0] in model.langs


def test_language_beside_columns_of_its_own_names(spark):
    docs = awkward(spark)
    assert {"score", "lang_pred"} <= {*docs.columns}
    got = language_id.identify(docs, language_id.fit(docs))
    assert len({*got.columns}) == len(got.columns) == len(docs.columns) + 2
    assert got.where("_score = 'clash' and _lang_pred = 'clash' and score >= 0").count() == docs.count()
    same = spark.createDataFrame([("b", "aa bb"), ("a", "aa bb")], "lang string, text string")  # a tie goes to the first
    assert language_id.Scorer(language_id.fit(same)).score("aa")[0] == "a"


# ---- 5 mixing


def test_mix_never_broadcasts_its_slots(spark, sf_dir):
    """They grow with the table, however small Spark takes them for."""
    docs = common.table(spark, sf_dir, "documents")
    for made in (mixing.emitted(docs), mixing.mix(docs)[0]):
        made.collect()
        plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]  # what ran
        joins = re.findall(r"(\w+)\(?\d*\)? +\[rank#\w+, block#\w+\]", plan) + re.findall(r"(\w+Join)\b[^\n]*\[rank#\w+, block#\w+\]", plan)
        assert "SortMergeJoin" in joins and "BroadcastHashJoin" not in joins, joins


def test_mix(spark, sf_dir):
    got = mixing.query(spark, sf_dir).toPandas()
    again = mixing.query(spark, sf_dir).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    by = got.merge(common.table(spark, sf_dir, "documents").select("doc_id", "source").toPandas(), on="doc_id").groupby("source")
    for _, g in by:
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 128 and (g.taken <= 2 * g["size"]).all()
    assert abs(by.target.first().sum() / got["size"].sum() - 1.5) < 1e-9


def test_mix_of_awkward_rows(spark):
    docs = awkward(spark)
    out, dealt = mixing.mix(docs, block=16)
    got = out.toPandas()
    assert len(got) == docs.count() and (got.taken <= 2 * got["size"]).all() and got.target.notna().all()
    slots = dealt.toPandas()
    assert len(slots) and not slots.duplicated(["rank", "slot"]).any()
    assert mixing.mix(docs.limit(0))[0].count() == 0
    assert mixing.mix(docs.where("text is null"))[0].toPandas().taken.sum() == 0


def test_mix_as_rows(spark):
    docs = [(i, text(i % 40, 40 + 7 * (i % 50)).replace(" ", "\n ", 3), f"s{i % 3}") for i in range(60)] + [(7, "  again the same id", "s1"), (60, text(2, 4000), "s0"), (61, None, "s0"), (62, " ", None), (None, text(8), None), (None, text(9), None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.stage(spark, df, "").toPandas()
    words = lambda t: re.findall(common.WORD, t or "")
    assert all(len(words(t)) == n for t, n in zip(got.text, got.taken))
    for _, g in got.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 128 and g.target.nunique() == 1
    # slots hold whole blocks, and equal blocks hold equal words
    texts = {(d, t) for d, t, _ in docs if d is not None}
    dealt = got[got.slot.notna()]
    by = defaultdict(set)
    for (source, slot), g in dealt.fillna({"source": ""}).sort_values("place").groupby(["source", "slot"]):
        assert list(g.place) == [0, *g.taken.cumsum()[:-1]]
        by[source, g.block.iloc[0]].add("".join(g.text + "|"))
    assert all(len(x) == 1 for x in by.values()) and dealt.groupby("source").slot.nunique().gt(1).all()
    assert all(any(d == i and t in (u or "") for i, u in texts) for d, t in zip(dealt.doc_id, dealt.text) if d == d)
    assert set(got[got["size"] == 0].doc_id) == {61, 62}
    assert mixing.stage(spark, df.limit(0), "").count() == 0 and mixing.stage(spark, awkward(spark), "").columns.count("size") == 1


@pytest.mark.parametrize("blocks", [1, 2, 7, 64, 101])
def test_permutations(spark, blocks):
    s = spark.createDataFrame([(1, blocks, 2 * blocks)], "rank int, blocks long, quota long")
    shares = spark.createDataFrame([(1, 0, 0, 2 * blocks)], "rank int, shard long, first long, n long")
    got = mixing.slots(shares, s, 7).toPandas()
    assert sorted(got.block) == sorted([*range(blocks)] * 2)


# ---- 6 suffix arrays


def planted(rng, n, long):
    shared = "".join(rng.choice("abcdefgh ") for _ in range(90))
    out = []
    for i in range(n):
        t = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(long)))
        if i % 3 == 0:
            at = rng.randrange(len(t) + 1)
            t = t[:at] + shared[rng.randrange(20) : 90 - rng.randrange(20)] + t[at:]
        out.append(t)
    return [*out, None, "", "é" * 120, "é" * 60, out[0], out[0], "ab" * 80, "x" + "ab" * 70]


def near_copies(rng, n, edits):
    words = [rng.choice("abcdefgh") * rng.randrange(2, 6) + rng.choice("xyz") for _ in range(120)]
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(
    "texts,most,batches",
    [
        (planted(random.Random(2000), 60, 300), 2000, 4),
        (planted(random.Random(3), 60, 300), 3, 3),
        (near_copies(random.Random(1), 2000, 3), 5000, 4),
        (near_copies(random.Random(2), 600, 4), 5, 2),
        (["".join(random.Random(5).choices("abcd ", k=suffix_dedup.CHUNK + 90_000))] * 1 + ["".join(random.Random(5).choices("abcd ", k=suffix_dedup.CHUNK + 90_000))[suffix_dedup.CHUNK - 200 : suffix_dedup.CHUNK + 300]], 100, 2),
    ],
    ids=["planted", "planted, cut", "near copies", "near copies, cut", "longer than a chunk"],
)
def test_suffix_dedup(spark, texts, most, batches):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.dedup(docs, length=48, batches=batches, most=most).collect()}
    for i, (t, flags) in enumerate(zip(texts, repeated_bytes(texts, 48))):
        raw = (t or "").encode()
        runs = [(k, len([*g])) for k, g in itertools.groupby(flags)]
        assert got[i].kept == bytes(x for x, f in zip(raw, flags) if not f) and len(got[i].starts) == sum(k for k, _ in runs), i
        assert got[i].n_bytes == len(raw) and got[i].n_removed == sum(flags)


def test_suffix_dedup_of_awkward_rows(spark):
    docs = awkward(spark)
    got = suffix_dedup.dedup(docs).collect()
    assert len(got) == docs.count() and all(r.n_removed == r.n_bytes for r in got if r.doc_id in (0, 1, 11))
    assert suffix_dedup.dedup(docs.limit(0)).count() == 0


def test_family_that_is_opened_again(spark, tmp_path):
    texts = planted(random.Random(4), 40, 300)
    marked = defaultdict(set)
    for k in range(4):
        family = suffix_dedup.Family.open(spark, f"file://{tmp_path}") if k else suffix_dedup.Family(spark, f"file://{tmp_path}", 48, 3)
        docs = spark.createDataFrame([(t,) for t in texts[k::4]], "text string")
        for spans in family.insert(suffix_dedup.all_pieces(docs, 48)):
            for r in spans.collect():
                marked[r.x, r.y].update(range(r.lo, r.hi))
        assert [r for r, _ in family.levels] == [[0], [1], [1, 0], [2]][k]
    for t, flags in zip(texts, repeated_bytes(texts, 48)):
        assert marked[suffix_dedup.key_of((t or "").encode())] == {i for i, f in enumerate(flags) if f}


# ---- 7 lines


def test_line_dedup(spark):
    rng = random.Random(2)
    docs = [(i, "\n".join(rng.choice(["", "a", "b", "c", " "]) for _ in range(rng.randrange(14)))) for i in range(60)] + [(60, None), (61, ""), (62, "a\nb\nc"), (63, "one\ntwo\nthree\nfour\none\ntwo\nthree")]
    got = line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: r.text_kept for r in got.collect()} == deduped_lines(docs)


def test_line_dedup_of_awkward_rows(spark):
    docs = awkward(spark).withColumn("text", F.replace("text", F.lit(" "), F.lit("\n")))
    kept = line_dedup.stage(spark, docs, "")
    assert kept.columns == docs.columns
    once = deduped_lines([(0, text(0).replace(" ", "\n"))])
    assert kept.where("doc_id = 0").first().text == once[0]
    assert kept.where("doc_id in (1, 11)").count() == 0
    assert line_dedup.dedup(docs.limit(0)).count() == 0


# ---- 8 embeddings


def by_all_pairs(rows, least=0.93):
    unit = {}
    for i, v, label in rows:
        if v is not None and label is not None and None not in v and np.isfinite(v).all() and any(v):
            unit[i] = (label, np.array(v, float) / np.linalg.norm(v))
    near = {i: [j for j in unit if j != i and unit[j][0] == unit[i][0] and len(unit[i][1]) == len(unit[j][1]) and unit[i][1] @ unit[j][1] >= least] for i in unit}
    comp = {i: i for i, _, _ in rows}
    moved = True
    while moved:
        moved = False
        for i, js in near.items():
            for j in js:
                if comp[j] < comp[i]:
                    comp[i], moved = comp[j], True
    return {i: (len(near.get(i, [])), comp[i]) for i, _, _ in rows}


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(25, 16))
    rows = [(i, (base[i % 25] + rng.normal(size=16) * 0.3 * (i % 4) / 3).astype(np.float32).tolist(), i % 2) for i in range(200)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [1.0, None], 0), (304, rows[0][1], None), (305, rows[0][1], 0), (306, rows[0][1], 0), (307, [1.0, 2.0], 0), (308, [2.0, 4.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("c", F.lit(1)).withColumn("cell", F.lit(2))
    for recall, block in ((1.0, 1024), (0.9999, 16)):
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df, recall=recall, block=block).collect()}
        assert got == by_all_pairs(rows)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("dims", [16, 64])
def test_partners_towards_another_centroid(spark, dims):
    """Recall is measured on the table's own pairs, so partners that lie just where cells end are met."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(60, dims))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    rows = []
    for i in range(1500):
        x = centres[i % 60] + rng.normal(size=dims) * 0.02
        x /= np.linalg.norm(x)
        half = np.r_[centres[(i * 7 + 1) % 60][: dims // 2], x[dims // 2 :]] - x
        away = half - (half @ x) * x
        y = 0.935 * x + (1 - 0.935**2) ** 0.5 * away / np.linalg.norm(away)
        rows += [(2 * i, x.tolist(), i % 2), (2 * i + 1, y.tolist(), i % 2)]
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), recall=0.99).collect()}
    want = {i: n for i, (n, _) in by_all_pairs(rows).items()}
    assert sum(got.values()) >= 0.98 * sum(want.values()) and all(got[i] <= want[i] for i in want)
    assert sum(got[i] for i in want if i % 2) >= 0.9 * sum(want[i] for i in want if i % 2)


def test_multi_sequence_visits():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 8))
    books = embedding_dedup.Codebooks(x, 6)
    a, b = books.bounds(x)
    rows, cells = books.visits(x, 0.5)
    for i in range(50):
        s = (a[i][:, None] + b[i]).ravel()
        mine = cells[rows == i]
        assert sorted(mine) == list(np.flatnonzero(s <= 0.5)) and (np.diff(s[mine]) >= 0).all()
    assert len(books.visits(x[:0], 0.5)[0]) == 0


# ---- 9 chats


def test_chats(spark):
    hard = ["", "</s>[INST] ok [/INST]", "\\[INST] \\\\</s>", "[/INST] [ROLE x] [/ROLE]", "ends with \\", " ", "é\n\n日本", "[INST", None]
    rows = [(c, t, r, hard[(c + t) % len(hard)]) for c in range(30) for t, r in enumerate(["system", "user", "assistant", "user", "assistant", "we]ird %", None][: c % 7 + 1])] + [(None, 0, "user", "x"), (5, 0, "user", "tie"), (5, 0, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("n", F.lit(1))
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    none_first = lambda x: (x is not None, x or "")
    for c in {r[0] for r in rows}:
        want = [(r, t or "") for _, _, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: (x[1], none_first(x[2]), none_first(x[3])))]
        assert chat.parse(got[c].formatted) == want
        loss = [chat.unescape(got[c].formatted[a:b]) for a, b in zip(got[c].loss_start, got[c].loss_end)]
        assert loss == [t for r, t in want if r == "assistant"]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_long_chats_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(chat, "BYTES", 1000)
    import pyarrow as pa

    t = pa.table({"conv_id": [i // 3 for i in range(300)], "role": ["user"] * 300, "text": ["t" * (i % 90) for i in range(300)]})
    out = list(chat.whole_conversations(b for b in t.to_batches(max_chunksize=7)))
    assert sum(map(len, out)) == 100
    assert all(len(chat.parse(x)) == 3 for b in out for x in b.column("formatted").to_pylist())


# ---- 10 quality


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    score, follow = rng.normal(size=(5, 2)), rng.normal(size=(2, 2))
    p, pairs, log = quality.Chains(np.array([0, 3]), 5).marginals(score, follow)
    z, own, two, logs = 0.0, np.zeros((5, 2)), np.zeros((2, 2)), 0.0
    for first, n in ((0, 3), (3, 2)):
        z, one, both = 0.0, np.zeros((n, 2)), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(score[first + i, y[i]] for i in range(n)) + sum(follow[a, b] for a, b in itertools.pairwise(y)))
            z += w
            for i in range(n):
                one[i, y[i]] += w
            for a, b in itertools.pairwise(y):
                both[a, b] += w
        own[first : first + n], two, logs = one / z, two + both / z, logs + np.log(z)
    assert np.allclose(p, own) and np.allclose(pairs, two) and np.isclose(log, logs)


def test_lines_of_texts():
    sizes = quality.line_codes(*quality.buffers(["ab\n\ncd", "", "x", None, "\n", "q\n"]))
    assert sizes[1].tolist() == [2, 0, 2, 0, 1, 0, 0, 0, 1, 0] and sizes[2].tolist() == [0, 3, 4, 5, 6, 8]


def test_gradient_against_differences():
    rng = np.random.default_rng(2)
    codes, first = rng.integers(0, quality.BINS, (12, quality.N_FEATURES)).astype(np.uint8), np.array([0, 5, 9])
    s, chains, good = quality.slots(codes, first), quality.Chains(first, 12), rng.random(12) > 0.5
    model = quality.Model()
    model.w, model.follow = rng.normal(size=model.w.shape) * 0.1, rng.normal(size=(2, 2)) * 0.1

    def likelihood() -> float:
        score = model.w[s].sum(1)
        own = score[np.arange(12), good.astype(int)].sum() + sum(model.follow[int(good[i - 1]), int(good[i])] for i in range(12) if i not in first)
        return own - chains.marginals(score, model.follow)[2]

    before, start = likelihood(), (model.w.copy(), model.follow.copy())
    quality.climb(model, s, chains, good, 0.0, 1, rate=1e-4)
    for theta, old in ((model.w, start[0]), (model.follow, start[1])):
        for at in rng.permutation([*np.ndindex(*theta.shape)])[:20]:
            at, step = tuple(at), theta[tuple(at)] - old[tuple(at)]
            model.w, model.follow = start[0].copy(), start[1].copy()
            (model.w if theta.shape == model.w.shape else model.follow)[at] += 1e-5
            slope = (likelihood() - before) / 1e-5
            assert abs(slope) < 1e-6 or step * slope > 0
    assert [len(quality.spread(n)) for n in (0, 512, 513, 10**6)] == [0, 512, 512, 512] and quality.spread(10**6)[-1] == 10**6 - 1


def test_quality(spark):
    d = "/root/testdata/sf0.01"
    got = quality.query(spark, d).join(common.table(spark, d, "labels"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95


def test_quality_of_awkward_rows(spark):
    docs = awkward(spark)
    none = quality.score(docs, quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))).toPandas()
    assert len(none) == docs.count() and (none.score == 0.5).all()
    labels = spark.createDataFrame([(0, 1), (3, 1), (7, 0), (13, 0), (7, 1), (None, 1), (10, None)], "doc_id long, quality int")
    got = quality.score(docs, quality.fit(docs, labels)).toPandas()
    assert got.score.between(0, 1).all()
    assert quality.score(docs.limit(0), quality.Model()).count() == 0


# ---- texts beyond every buffer's size


@pytest.fixture(scope="module")
def long_docs(spark):
    """A text of 1.3 MB, its copy, one with an edit, and a short one; longer than a chunk of op6."""
    long = "\n".join(text(k % 30, 900) + f" end{k}" for k in range(250))
    assert len(long) > 2 * suffix_dedup.CHUNK
    rows = [(0, long), (1, long), (2, long.replace("end100", "other")), (3, "a short text of seven words only " + "x" * 20)]
    return common.materialize(spark.createDataFrame([(d, t, "en", f"s{d % 2}", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long"))


def test_long_texts(spark, long_docs):
    texts = {r.doc_id: r.text for r in long_docs.collect()}
    words = {d: len(t.split()) for d, t in texts.items()}
    near = {r.doc_id: r.component_id for r in ngram_join.near_documents(long_docs).collect()}
    assert near == {0: 0, 1: 0, 2: 0, 3: 3}
    mixed = {r.doc_id: r for r in mixing.mix(long_docs)[0].collect()}
    assert {d: r.size for d, r in mixed.items()} == words and all(r.taken <= 2 * r.size for r in mixed.values())
    kept = {r.doc_id: r for r in suffix_dedup.dedup(long_docs).collect()}
    assert kept[0].kept == kept[1].kept == b"" and kept[3].n_removed == 0 and 0 < len(kept[2].kept) < 600
    lines = {r.doc_id: r.text_kept for r in line_dedup.dedup(long_docs).collect()}
    assert lines[0] == texts[0] and lines[1] == "" and lines[2].count("\n") == 0 and "other" in lines[2]
    item = " ".join(texts[0].split()[150_000:150_040])
    leaks = decontamination.find_leaks(long_docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert {r.doc_id for r in leaks} == {0, 1, 2} and all(r.score == 1.0 for r in leaks)
    langs = {r.doc_id: r.lang_pred for r in language_id.identify(long_docs, language_id.fit(long_docs)).collect()}
    assert set(langs.values()) == {"en"}
    spotted = {r.id: len(r.base) for r in pii.scan(long_docs.withColumn("text", F.concat("text", F.lit(" mail me@example.org now")))).collect()}
    assert spotted == dict.fromkeys(texts, 1)
    scores = quality.score(long_docs, quality.fit(long_docs, spark.createDataFrame([(0, 1), (2, 1), (3, 0)], "doc_id long, quality int"))).collect()
    assert len(scores) == 4 and all(0 <= r.score <= 1 for r in scores)
    talk = chat.format_chats(long_docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), "text")).collect()
    assert {r.conv_id: chat.parse(r.formatted) for r in talk} == {d: [("user", t)] for d, t in texts.items()}


def test_sanitised_awkward_rows(spark):
    docs = awkward(spark)
    clean = pii.sanitise(docs)
    assert clean.columns == [*docs.columns, "text_clean"] and clean.count() == docs.count() and clean.where("not text_clean <=> text").count() == 0


# ---- the pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = common.table(spark, sf_dir, "documents")
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        before, out = out, common.materialize(stage(spark, out, sf_dir))
        if name != "mixing":
            assert out.columns == docs.columns
        rows = {r.doc_id: r.text for r in before.collect()}
        ids = {r.doc_id for r in out.collect()}
        assert ids <= set(rows)
        if name == "ngram_join":
            assert ids == {c for d, (n, c) in jaccard_components(rows.items()).items() if c == d}
        if name == "line_dedup":
            assert {r.doc_id: r.text for r in out.collect()} == {d: t for d, t in deduped_lines(sorted(rows.items())).items() if t != "" or rows[d] == ""}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == ids


def test_pipeline_meets_the_targets(spark, sf_dir):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    words = got.text.map(lambda t: len(re.findall(common.WORD, t or "")))
    for source, target in got.groupby("source").target.first().items():
        assert abs(words[got.source == source].sum() - target) <= 128
    assert (got.n_chars == got.text.str.len()).all()


def test_digests(spark, sf_dir):
    got = suffix_dedup.query(spark, sf_dir).join(common.table(spark, sf_dir, "documents"), "doc_id").where("n_removed = 0").limit(5).collect()
    assert all(r.kept_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() for r in got)
