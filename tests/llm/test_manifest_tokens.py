"""The Merkle manifest, the alignment of two tokenizers, and BPE by an automaton."""

from __future__ import annotations

import hashlib
import itertools
import json
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import awkward, text
from pyspark.sql import functions as F

pytest.importorskip("quillgraph.llm")
vocabularies = pytest.importorskip("public_tokenizers")

from quillgraph.llm import alignment, bpe_automaton, merkle  # noqa: E402
from quillgraph.sources.scratch import materialize  # noqa: E402

# ---- 11 Merkle manifest


def h(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def tree_of(nodes):
    """The last node, and each node's siblings level by level as (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            first = k // 16 * 16
            paths[i].append(("".join(nodes[first:k]), "".join(nodes[k + 1 : first + 16])))
            at[i] = k // 16
        nodes = [h("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


@pytest.mark.parametrize("top", [1, 2, 4096])
def test_tree_against_the_plain_one(spark, top):
    """One group of more than 16 ** 3 nodes, one of 257, one of 256, small ones; with the driver's tree as small as can be."""
    sizes = {"=a": 4_700, "=b": 257, "=c": 256, "=d": 17, "=e": 16, "=f": 2, "": 1}
    rows = [(g, k, h(f"{g}{k}")) for g, n in sizes.items() for k in range(n)]
    random.Random(1).shuffle(rows)
    got = merkle.tree(spark.createDataFrame(rows, "g string, k long, node string").repartition(5), top=top)
    found = {(r.g, r.node): (r.root, [(s.l, s.r) for s in r.path]) for r in got.collect()}
    want = {}
    for g, n in sizes.items():
        nodes = [h(f"{g}{k}") for k in range(n)]
        root, paths = tree_of(nodes)
        want |= {(g, x): (root, p) for x, p in zip(nodes, paths)}
    assert found == want


def plain_manifest(rows):
    """The query's rows by plain Python, of (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h("".join(map(field, r)))
    low = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subroots, below = [], {}
    for s in sources:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, paths = tree_of([leaf(r) for r in own])
        subroots.append(root)
        below[s] = list(zip(own, paths))
    root, above = tree_of(subroots)
    out = []
    for s, sub, up in zip(sources, subroots, above):
        for r, path in below[s]:
            x = leaf((*r[:4], low(r[4]))) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf(r)
            for a, b in [*path, *up]:
                x = h(a + x + b)
            out.append((r[0], leaf(r), sub, root, h("".join(a + b for a, b in [*path, *up])), x, x == root))
    return sorted(out, key=str)


def test_manifest_of_awkward_rows(spark, tmp_path):
    docs = awkward(spark).withColumn("n_chars", F.when(F.col("doc_id") != 3, F.col("n_chars"))).withColumn("lang", F.when(F.col("doc_id") != 2, F.col("lang")))
    more = spark.range(400).select((F.col("id") + 100).alias("doc_id"), F.concat(F.lit("Some TEXT "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") > 300, F.concat(F.lit("ü"), F.col("id").cast("string"))).otherwise("zz").alias("source"), F.lit(3).cast("long").alias("n_chars"))
    docs.unionByName(more, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted([tuple(r) for r in merkle.query(spark, str(tmp_path)).collect()], key=str)
    rows = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert got == plain_manifest(rows)
    assert {True, False} == {r[-1] for r in got}


def test_manifest_of_nothing(spark):
    docs = awkward(spark)
    assert merkle.manifest(docs.limit(0)).count() == 0
    lone = merkle.manifest(docs.where("doc_id = 3")).first()
    assert lone.leaf == lone.subroot == lone.root and lone.path == []


# ---- 12 alignment


@pytest.fixture(scope="module")
def files():
    return [open(vocabularies.path(n), "rb").read() for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


def plain_alignment(files, docs):
    """The query's rows, pair by pair."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(files[0].decode())
    library.encode_special_tokens = True
    e = alignment.Encoders(*files)
    rows, counts = [], Counter()
    for d, t in docs:
        a, b = ([], []) if not t else (library.encode(f" {t}", add_special_tokens=False).ids, e.b.encode(t))
        raw = f" {t}".encode()
        if b"".join(e.bytes_a[i] for i in a) != raw or b"".join(e.bytes_b[i] for i in b) != raw:
            a, b = [], []
        spans = []
        for ids, names in ((a, e.bytes_a), (b, e.bytes_b)):
            ends = list(itertools.accumulate(len(names[i]) for i in ids))
            spans.append([(i, x, y) for i, x, y in zip(ids, [0, *ends], ends)])
        links = [(i, j) for i, x, y in spans[0] for j, u, v in spans[1] if x < v and u < y]
        counts.update(links)
        cuts = sorted({y for _, _, y in spans[0]} & {y for _, _, y in spans[1]})
        groups = ["|".join(",".join(str(i) for i, _, y in s if lo < y <= hi) for s in spans) for lo, hi in zip([0, *cuts], cuts)]
        rows.append((d, len(a), len(b), len(groups), links, ";".join(groups)))
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return sorted([(d, n, m, g, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), h(s) if s else "") for d, n, m, g, links, s in rows], key=str)


ODD = ["naïve café 中文かな 🙂 é", "a\x00b\x7f\r\n\t  x", "<|endoftext|> and <s> </s> <unk> <0x41> [INST]", "▁ not a space", "  two", " ", "  ", "x" * 700, "don't they're 1234567 3.14", "Ǆ ﬁ İ ß Σς"]


@pytest.mark.parametrize("common", [0, 40, 1 << 20])
def test_alignment_against_all_pairs(spark, files, common):
    """Whether all pairs, some or none are sent to all tasks."""
    docs = [*enumerate(ODD), (20, text(1)), (21, text(1)), (22, text(2, 200)), (23, None), (24, ""), (None, text(3)), (None, None), (21, text(1))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = alignment.totals(materialize(alignment.digested(alignment.align(df, *files))), common)
    found = sorted([tuple(r) for r in got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()], key=str)
    assert found == plain_alignment(files, docs)
    assert next(r for r in found if r[0] == 3)[1:] == (0, 0, 0, 0, 0, 0, "")


def test_alignment_in_slices(spark, files, monkeypatch):
    docs = awkward(spark).select("doc_id", "text")
    whole = sorted([tuple(r)[1:] for r in alignment.align(docs, *files).collect()], key=str)
    monkeypatch.setattr(alignment, "BYTES", 100)
    e = alignment.Encoders(*files)
    texts = [r.text for r in docs.collect()]
    for t in texts:
        one = alignment.aligned_batch(e, [t])
        assert any(x[1:4] == (one["n_a"][0], one["n_b"][0], one["n_groups"][0]) and x[5] == one["groups"][0] for x in whole)


def test_alignment_of_nothing(spark, files, tmp_path):
    awkward(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert alignment.query(spark, str(tmp_path)).count() == 0


def test_rank_and_select():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        flags = rng.random(n) < 0.3
        bits = alignment.Bits.at(np.flatnonzero(flags), n)
        at = np.arange(n + 1)
        assert bits.select().tolist() == np.flatnonzero(flags).tolist()
        assert bits.rank(at).tolist() == [int(flags[:i].sum()) for i in at]


# ---- 13 BPE


def plain_bpe(symbols, merges):
    rank = {m: k for k, m in enumerate(merges)}
    while True:
        pairs = [(rank[p], i) for i, p in enumerate(itertools.pairwise(symbols)) if p in rank]
        if not pairs:
            return symbols
        k, _ = min(pairs)
        out, i = [], 0
        while i < len(symbols):
            if tuple(symbols[i : i + 2]) == merges[k]:
                out.append(symbols[i] + symbols[i + 1])
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out


@pytest.mark.parametrize("suffix", ["", "</w>"])
@pytest.mark.parametrize("seed", range(12))
def test_automaton_against_merging(seed, suffix):
    """Random merges over three letters, some of which can never happen; all words of up to seven letters."""
    rng = random.Random(seed)
    letters = bpe_automaton.byte_letters()
    vocab = {c + end: i for i, (end, c) in enumerate(itertools.product(sorted({"", suffix}), letters))}
    pool, merges = [c + end for end in {"", suffix} for c in "abc"], []
    while len(merges) < 14:
        u = rng.choice([x for x in pool if not suffix or not x.endswith(suffix)])
        v = rng.choice(pool)
        if u + v not in vocab:
            vocab[u + v] = len(vocab)
            merges.append((u, v))
            pool.append(u + v)
    a = bpe_automaton.Automaton(vocab, merges, suffix)
    reader = a.reader()
    for n in range(1, 8):
        for w in itertools.product("abc", repeat=n):
            want = plain_bpe([*w[:-1], w[-1] + suffix], merges)
            assert [a.labels[i] for i in reader.word("".join(w).encode())] == want
    assert a.n_states <= len(merges) + 1


def test_merges_out_of_order():
    letters = bpe_automaton.byte_letters()
    vocab = {c: i for i, c in enumerate(letters)} | {"ab": 256, "abc": 257}
    with pytest.raises(ValueError, match="out of order"):
        bpe_automaton.Automaton(vocab, [("ab", "c"), ("a", "b")])
    with pytest.raises(ValueError, match="vocabulary has no"):
        bpe_automaton.Automaton({"a": 0}, [])


TEXTS = [*ODD, "", "THEY'RE <|startoftext|>don't<|endoftext|>", "a" * 3000, "ab" * 2000, "ΌΣΟΣ Σ", "ᲉꟋ x՘y", "a\x1cb\x85c᠎d", "\U00011935\U00011930", "١٢٣ ¹²½ Ⅷ", "tttttt tt ttt", "line one\nline two\r\n\r\nthree"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_against_the_library(spark, sf_dir, name):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabularies.path(name))
    ours = bpe_automaton.Tokenizer.load(vocabularies.path(name))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rng = random.Random(2)
    alphabet = "abcdeABCéÉßİΣσς 12٣'’stre\t\n 　中文かな🙂́ !?.,"
    odd = {20_000 + i: "".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for i in range(300)}
    docs = docs.union(spark.createDataFrame([*odd.items()], "doc_id long, text string"))
    encoded = bpe_automaton.encode(docs, ours)
    ids = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in encoded.collect()}
    want = {d: library.encode(t, add_special_tokens=False).ids for d, t in (texts | odd).items()}
    assert ids == want
    back = {r.doc_id: r.decoded for r in bpe_automaton.decode(encoded, ours).collect()}
    assert back == {d: library.decode(x, skip_special_tokens=False) for d, x in want.items()}


def test_bpe_of_awkward_rows(spark, tmp_path):
    from tokenizers import Tokenizer

    awkward(spark).write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(vocabularies.path("word_bpe_49k.json"))
    got = sorted([tuple(r) for r in bpe_automaton.query(spark, str(tmp_path)).collect()], key=str)
    want = []
    for r in spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), h(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=str)


def test_words_are_forgotten():
    ours = bpe_automaton.Tokenizer.load(vocabularies.path("word_bpe_49k.json"))
    few, many = bpe_automaton.Encoder(ours, room=3), bpe_automaton.Encoder(ours)
    assert few.encode(text(1)) == many.encode(text(1)) and len(few.labels.__self__) <= 3


def test_unknown_parts_of_a_file():
    with open(vocabularies.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFKC"}}, {"decoder": {"type": "WordPiece"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"dropout": 0.1}}):
        with pytest.raises(ValueError):
            bpe_automaton.Tokenizer(spec | change)
