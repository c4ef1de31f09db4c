from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import dense, graph, lexical, notes, tags, upkeep
from quillgraph.streaming import changes


def test_pages_follow_each_other(spark):
    rows = spark.createDataFrame([(f"{i:03d}", f"t{i}", f"t{i}", "needle", "zettel", None, 0, i % 7) for i in range(50)], "id string, title string, title_folded string, body string, note_type string, custom_key string, created_at long, updated_at long")
    found = notes.search(rows, "needle")
    seen, cursor = [], None
    while True:
        part = [r.asDict() for r in notes.page(found, limit=11, cursor=cursor).collect()]
        if not part:
            break
        seen += [p["id"] for p in part]
        cursor = notes.next_cursor(part[-1])
    assert seen == [r.id for r in rows.orderBy(F.desc("updated_at"), F.desc("id")).collect()]
    with pytest.raises(ValueError):
        notes.page(found, sort="title-asc", cursor=cursor)
    with pytest.raises(ValueError):
        notes.page(found, limit=501)


def test_search_takes_marks_literally(spark):
    rows = spark.createDataFrame([("1", "a", "a", "literal_100% x", "zettel", "K1", 0, 0), ("2", "b", "b", "literalA100B x", "zettel", None, 0, 0)], "id string, title string, title_folded string, body string, note_type string, custom_key string, created_at long, updated_at long")
    assert [r.id for r in notes.search(rows, "literal_100%").collect()] == ["1"]
    assert notes.search(rows, "k1").collect()[0].search_rank == notes.RANK_ID
    assert notes.search(rows, "").count() == 2


def test_closures_end_on_cycles(spark):
    p = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", None)], "card_id string, parent_id string")
    assert {r.id for r in graph.cycles(p).collect()} == {"a", "b", "c"}
    up = {(r.id, r.ancestor) for r in graph.ancestors(p).collect()}
    assert up == {(x, y) for x in "abcd" for y in "abc"}
    assert graph.descendants(p, spark.createDataFrame([("a",)], "id string")).count() == 4
    assert graph.ancestors(p.limit(0)).count() == 0


def test_near_duplicates_leave_weak_ones(spark):
    text = " ".join(f"word{i} thing{i}" for i in range(80))
    rows = [("l/A", False, text, "", ""), ("l/B", False, text, "", ""), ("l/C", True, text, "", ""), ("l/D", False, "other words entirely here", "", "")]
    corpus = spark.createDataFrame(rows, "doc_key string, weak boolean, title string, abstract string, body string")
    got = lexical.similar(corpus, corpus.where("doc_key = 'l/A'"), 5).collect()
    assert [r.doc_key for r in got] == ["l/C"]


def test_fusion(spark):
    r = spark.createDataFrame([("q", 0, "A", 0.9), ("q", 0, "B", 0.8), ("q", 1, "C", 0.9), ("q", 1, "B", 0.7)], "query string, channel int, doc_key string, score double")
    got = dense.fused(r, 2).orderBy("place").collect()
    assert got[0].doc_key == "B" and abs(got[0].fused - 61 / 62) < 1e-12 and [x.doc_key for x in got[1:]] == ["A", "C"]


def test_floors(spark):
    rows = [("q", f"k{i}", 0.8 - i * 0.004) for i in range(40)] + [("q", f"t{i}", 0.07) for i in range(5)]
    df = spark.createDataFrame(rows, "query string, doc_key string, score double")
    assert dense.relevant(df, "text").count() == 40
    assert dense.relevant(df, "semantic").count() == 40


def test_nearest_skips_bad_vectors(spark):
    v = spark.createDataFrame([(0, 1, [1.0, 0.0]), (1, 1, [0.8, 0.6]), (2, 1, [0.1, 0.99]), (3, 2, [1.0, 0.0]), (4, 1, [0.0, 0.0]), (5, 1, [float("nan"), 1.0])], "key int, library int, vector array<double>")
    got = dense.nearest(v, v.where("key = 0"), 1).collect()
    assert [r.key for r in got] == [1]


def test_votes(spark):
    t = spark.createDataFrame([("a", "Deep Learning"), ("a", "deep-learning"), ("b", "Deep Learning"), ("b", "Vision"), ("c", "Vision"), ("q", "Old"), ("a", "old")], "card_id string, tag string")
    n = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 1.0), ("q", "c", 1.0), ("q", "q", 9.0)], "query string, card_id string, score double")
    assert {(r.name, r.score) for r in tags.votes(t, n).collect()} == {("Deep Learning", 2.0), ("Vision", 2.0)}


def test_duplicate_groups(spark):
    names = spark.createDataFrame([(x,) for x in ("Deep Learning", "deep-learning", "deep_learning", "C++", "C#", "C", "AI", "ＡＩ")], "name string")
    got: dict = {}
    for r in tags.duplicate_groups(names, tags.duplicate_pairs(names)).collect():
        got.setdefault(r.group, set()).add(r.name)
    assert sorted(map(sorted, got.values())) == [["AI", "ＡＩ"], ["Deep Learning", "deep-learning", "deep_learning"]]


def test_selection(spark):
    c = spark.createDataFrame([("q", "Graph matching", 0.9), ("q", "graph-matching", 0.89), ("q", "Channel estimation", 0.8), ("q", "weak", 0.3)], "query string, name string, score double")
    assert [r.name for r in tags.selected(c).orderBy("place").collect()] == ["Graph matching", "Channel estimation"]


def test_reverse_top_k(spark):
    lists = spark.createDataFrame([("q", "a", 0.9), ("q", "b", 0.8), ("r", "a", 0.5)], "query string, key string, score double")
    new = spark.createDataFrame([("q", "b", None), ("q", "c", 0.95), ("r", "a", 0.5)], "query string, key string, score double")
    got = {(r.query, r.key, r.place, r.touched) for r in upkeep.reverse_top_k(lists, new, 2).collect()}
    assert got == {("q", "c", 1, True), ("q", "a", 2, True), ("r", "a", 1, False)}


def test_streamed_changes(spark, tmp_path):
    rows = spark.createDataFrame([(1, "title", False), (1, "body", False), (2, "body", True), (1, "title", False)], "card_id long, field string, all boolean")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    changes.coalesce_changes(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(60)
    got = {(r.card_id, tuple(r.fields), r["all"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(1, ("body", "title"), False), (2, ("body",), True)}


def test_streamed_queue(spark, tmp_path):
    spark.createDataFrame([("a", "1"), ("b", "1")], "key string, hash string").write.parquet(f"{tmp_path}/known")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], "key string, hash string")
    new.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(new.schema).parquet(f"{tmp_path}/in")
    changes.queue_changes(stream, f"{tmp_path}/known", f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(60)
    assert {(r.key, r.status) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("b", "changed"), ("c", "new")}


def test_windows(spark, tmp_path):
    events = spark.createDataFrame([("a", 0), ("a", 60), ("b", 400)], "event_type string, s long").select("event_type", F.timestamp_seconds("s").alias("ts"))
    got = {(r.event_type, r.n) for r in changes.windowed_counts(events).collect()}
    assert got == {("a", 2), ("b", 1)}


def test_files(spark, tmp_path):
    import json

    from quillgraph.sources import files

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("long enough " * 10)
    (tmp_path / "a" / "y.txt").write_text("short")
    assert [r.path.rsplit("/", 1)[1] for r in files.full_texts(spark, f"{tmp_path}/a").collect()] == ["x.txt"]
    unused = files.unused_assets(spark, f"{tmp_path}/a", spark.createDataFrame([("x.txt",)], "name string"))
    assert [r.name for r in unused.collect()] == ["y.txt"]
    (tmp_path / "terms.json").write_text(json.dumps({"spellings": ["LaTeX"], "aliases": [{"name": "Convolutional Network", "forms": ["convnet"]}]}))
    assert files.terms_from_json(spark, f"{tmp_path}/terms.json").alias_key("a convnet") == "a convolutional network"
    items = spark.createDataFrame([("k", "T", "A", ["X Y"]), ("l", "T", None, [])], "key string, title string, abstract string, creators array<string>")
    texts = spark.createDataFrame([("k", 2, "second " * 10), ("k", 1, "short")], "key string, rank int, text string")
    got = {r.key: (r.text, r.weak) for r in files.with_fallback(items, texts).collect()}
    assert got == {"k": ("second " * 10, False), "l": ("T\n", True)}
    files.export_outline(items.select("key"), f"{tmp_path}/out")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == ['- {"key":"k"}', '- {"key":"l"}']
    files.write_index(items.select("key"), f"{tmp_path}/index", "key")
    assert spark.read.parquet(f"{tmp_path}/index").count() == 2


def test_graph_groups(spark):
    from quillgraph.operators import discovery

    n = spark.createDataFrame([("1", "Remote sensing of fields", "images")], "id string, title string, body string")
    t = spark.createDataFrame([("1", "Machine learning"), ("1", "Remote sensing")], "card_id string, tag string")
    assert discovery.graph_groups(n, t, []).first().group == "Remote sensing"
    assert discovery.graph_groups(n, t, ["Machine learning"]).first().group == "Machine learning"


def test_graph_groups_read_a_text_once_and_only_for_a_choice(spark, monkeypatch, tmp_path):
    from quillgraph.operators import discovery

    def read(text, f=discovery.tokens, log=str(tmp_path / "read")):
        with open(log, "a") as out:
            out.write(f"{text}\n")
        return f(text)

    monkeypatch.setattr(discovery, "tokens", read)
    n = spark.createDataFrame([("1", "one", "body of plants and fields"), ("2", "two", "body of one tag")], "id string, title string, body string")
    t = spark.createDataFrame([("1", "fields"), ("1", "plants"), ("1", "water"), ("1", None), ("2", "alone"), ("3", "no note")], "card_id string, tag string")
    assert {r.id: r.group for r in discovery.graph_groups(n, t, ["none"]).collect()} == {"1": "fields", "2": "alone"}
    told = (tmp_path / "read").read_text().splitlines()
    assert told.count("body of plants and fields") == 1 and "body of one tag" not in told


def test_evidence(spark):
    from quillgraph.operators import discovery

    t = spark.createDataFrame([("a", "Nothing here. Graph networks learn fast."), ("b", "We study graph networks.\nOther."), ("c", None)], "doc_key string, text string")
    p = spark.createDataFrame([("a", "b"), ("a", "c")], "query string, doc_key string")
    got = {r.doc_key: r for r in discovery.evidence(p, t).collect()}
    assert got["b"].terms == "Graph, networks" and got["b"].current == "Graph networks learn fast." and got["b"].match == "We study graph networks."
    assert got["c"].terms == ""


def test_evidence_reads_a_text_once(spark):
    from quillgraph.operators import discovery

    t = spark.createDataFrame([("a", "Graphs learn. Graph of graphs; fast-running graph!\nFast"), ("b", None), ("c", "")], "doc_key string, text string")
    rows = {r.doc_key: r for r in discovery.stems_of_sentences(t, 3).collect()}  # a row for each text, none for a word
    assert len(rows) == 3 and rows["a"].stems == ["graph", "learn", "fast"] and rows["a"].surfaces == ["Graphs", "learn", "fast-running"]
    assert rows["a"].said == ["Graphs learn.", "Graph of graphs; fast-running graph!", "Fast"] and rows["a"].has == [[1, 2], [1, 3], [3]] and rows["b"].stems == rows["c"].stems == []
    same = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "a"), ("a", "z")], "query string, doc_key string")
    got = {r.doc_key: r for r in discovery.evidence(same, t).collect()}
    assert set(got) == {"a", "b", "z"} and got["a"].current == got["a"].match == "Graph of graphs; fast-running graph!" and got["b"].current == got["z"].terms == ""


def test_long_chains_and_cycles(spark):
    from quillgraph.operators import graph

    chain = spark.range(1500).selectExpr("lpad(id, 5, '0') AS card_id", "CASE WHEN id > 0 THEN lpad(id - 1, 5, '0') END AS parent_id")
    up = graph.ancestors(chain, spark.createDataFrame([("01499",)], "id string"))
    assert up.count() == 1499 and up.where("ancestor = '00000'").first().depth == 1499
    assert graph.descendants(chain, spark.createDataFrame([("00000",)], "id string")).count() == 1500
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "card_id string, parent_id string")
    got = {(r.id, r.ancestor): r.depth for r in graph.ancestors(ring).collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 2, ("a", "a"): 3, ("b", "c"): 1, ("b", "a"): 2, ("b", "b"): 3, ("c", "a"): 1, ("c", "b"): 2, ("c", "c"): 3, ("d", "a"): 1, ("d", "b"): 2, ("d", "c"): 3}


def test_cycles_below_a_very_long_chain(spark, monkeypatch):
    from quillgraph.operators import graph

    rounds = []
    monkeypatch.setattr(graph, "materialize", lambda df, f=graph.materialize: rounds.append(1) or f(df))
    chain = spark.range(10_000).selectExpr("concat('n', id) AS card_id", "CASE WHEN id > 0 THEN concat('n', id - 1) END AS parent_id")
    assert graph.cycles(chain).count() == 0 and len(rounds) <= 16
    tail = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "c"), ("x", "y")], "card_id string, parent_id string").union(spark.range(700).selectExpr("concat('t', id) AS card_id", "CASE WHEN id > 0 THEN concat('t', id - 1) ELSE 'a' END AS parent_id"))
    assert {r.id for r in graph.cycles(chain.union(tail)).collect()} == {"a", "b", "c"}
    assert graph.cycles(chain.limit(0)).count() == 0


def test_cycles_of_a_tree_take_rounds_by_its_depth(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(graph, "materialize", lambda df, f=graph.materialize: rounds.append(1) or f(df))
    tree = spark.range(9_000).selectExpr("concat('n', id) AS card_id", "CASE WHEN id > 0 THEN concat('n', id div 3) ELSE 'n2' END AS parent_id")
    assert {r.id for r in graph.cycles(tree).collect()} == {"n0", "n2"} and len(rounds) <= 6
    for n in (1, 2, 4):  # a chain up to a top is no cycle, however short
        assert graph.cycles(spark.range(n).selectExpr("concat('c', id) AS card_id", "concat('c', id + 1) AS parent_id")).count() == 0


def test_deleted_in_a_row(spark):
    n = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    parents = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "d")], "card_id string, parent_id string")
    links = spark.createDataFrame([], "source_id string, target_id string, ref string")
    tree = notes.deleted(n, links, parents, spark.createDataFrame([("b",), ("c",)], "id string"))[2]
    assert {(r.card_id, r.parent_id) for r in tree.collect()} == {("a", None), ("d", "a"), ("e", "d")}


def test_free_seconds(spark):
    from quillgraph.operators import library

    wanted = [(1, 10), (2, 10), (3, 11), (4, 20), (5, 9), (6, 10)]
    taken = {10, 12, 13, 20}
    given, want = set(taken), {}
    for i, t in sorted(wanted, key=lambda x: (x[1], x[0])):
        while t in given:
            t += 1
        given.add(t)
        want[i] = t
    got = library.free_seconds(spark.createDataFrame(wanted, "id int, second long"), spark.createDataFrame([(t,) for t in taken], "second long"))
    assert {r.id: r.second for r in got.collect()} == want


@pytest.mark.parametrize("seed", range(2))
def test_free_seconds_over_ranges(spark, seed):
    from quillgraph.operators import library

    rng = random.Random(seed)
    taken = {rng.randrange(400) for _ in range(250)}
    wanted = [(i, rng.choice([7, 50, 51, rng.randrange(500)])) for i in range(300)]
    given, want = set(taken), {}
    for i, t in sorted(wanted, key=lambda x: (x[1], x[0])):
        while t in given:
            t += 1
        given.add(t)
        want[i] = t
    got = library.free_seconds(spark.createDataFrame(wanted, "id int, second long"), spark.createDataFrame([(t,) for t in taken], "second long"))
    assert {r.id: r.second for r in got.collect()} == want
    assert library.free_seconds(spark.createDataFrame(wanted, "id int, second long").limit(0), spark.createDataFrame([(1,)], "second long")).count() == 0
    nothing = library.free_seconds(spark.createDataFrame([(1, 5), (2, 5)], "id int, second long"), spark.createDataFrame([], "second long"))
    assert {r.id: r.second for r in nothing.collect()} == {1: 5, 2: 6}


def test_running_values(spark):
    from quillgraph.operators.order import running

    rng = random.Random(1)
    rows = [(i, rng.randrange(-5, 9)) for i in range(500)]
    got = {r.i: (r.s, r.m) for r in running(spark.createDataFrame(rows, "i int, x long").repartition(7), ["i"], s=("sum", "x"), m=("max", "x")).collect()}
    assert got == {i: (sum(x for _, x in rows[: i + 1]), max(x for _, x in rows[: i + 1])) for i in range(500)}


@pytest.mark.parametrize("k", [1, 7, 100])
def test_nearest_through_cells(spark, k):
    """The same as comparing all, over clusters, copies, ties and vectors without length; and fewer are compared."""
    import numpy as np

    from quillgraph.operators import cells, dense

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [(i, "ab"[i % 7 == 0], (centres[i % 12] + rng.normal(size=16) * 0.15).astype("float32").tolist()) for i in range(1_500)]
    rows += [(2_000 + i, "a", rows[0][2]) for i in range(40)] + [(3_000, "a", [0.0] * 16), (3_001, "a", None), (3_002, None, rows[1][2]), (3_003, "c", rows[2][2])]
    v = spark.createDataFrame(rows, "key long, library string, vector array<float>")
    q = v.where("key % 50 = 0 or key >= 3000")
    want = {(r.query, r.key): (round(r.score, 9), r.place) for r in dense.nearest(v, q, k).collect()}
    found, told = cells.nearest(cells.build(v), q, k)
    assert {(r.query, r.key): (round(r.score, 9), r.place) for r in found.collect()} == want
    x = told.groupBy("read").agg({"n": "sum"}).collect()
    share = {r["read"]: r["sum(n)"] for r in x}
    assert k == 100 or share[True] < 0.5 * sum(share.values())


def test_vector_pairs(spark):
    import numpy as np

    from quillgraph.operators import dense

    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 16))
    rows = [(f"k{i:03}", i % 2, (base[i % 12] + rng.normal(size=16) * 0.3).tolist()) for i in range(150)] + [("none", 0, [0.0] * 16)]
    unit = {k: (lib, np.array(v) / np.linalg.norm(v)) for k, lib, v in rows if any(v)}
    want = {(a, b) for a in unit for b in unit if a < b and unit[a][0] == unit[b][0] and unit[a][1] @ unit[b][1] >= 0.84}
    df = spark.createDataFrame(rows, "key string, library int, vector array<double>")
    for block in (2048, 17):
        got = dense.vector_pairs(df, block=block).collect()
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want) > 50


def test_near_duplicates(spark):
    from quillgraph.operators import lexical

    words = [f"word{i}" for i in range(300)]
    texts = {}
    for k in range(6):
        own = [words[(i * (k + 2) + k) % 300] for i in range(200)]
        for j in range(4):
            edited = list(own)
            if j == 3:
                edited[5] = "other"
            texts[f"{k}{j}"] = " ".join(edited)
    corpus = spark.createDataFrame([(k, "en", k == "00", "", "", t) for k, t in texts.items()], "doc_key string, library string, weak boolean, title string, abstract string, body string")
    counted = lexical.counts(corpus)
    signature = lexical.signatures(lexical.weights(corpus, counted))
    pairs, members = lexical.near_duplicates(lexical.simhashes(counted), signature, corpus.select("doc_key", "weak"))
    vectors = {}
    for r in signature.collect():
        vectors.setdefault(r.doc_key, {})[r.feature] = r.weight
    bits = {r.doc_key: r.simhash for r in lexical.simhashes(counted).collect()}
    sound = sorted(set(texts) - {"00"})
    like = {(a, b) for a in sound for b in sound if a < b and bin((bits[a] ^ bits[b]) & (2**64 - 1)).count("1") <= 3 and sum(w * vectors[b].get(f, 0) for f, w in vectors[a].items()) >= 0.95}
    of = {r.doc_key: r.copy_of for r in members.collect()}
    found = {(r.doc_key, r.other) for r in pairs.collect()}
    near = lambda a, b: of[a] == of[b] or (min(of[a], of[b]), max(of[a], of[b])) in found
    assert set(of) == set(sound) and {(a, b) for a in sound for b in sound if a < b and near(a, b)} == like and len(like) >= 15
    assert of["13"] != of["10"] == of["11"] == "10"


def test_tag_selection(spark):
    from quillgraph.operators import tags

    def chosen(rows, edges=None):
        df = spark.createDataFrame([("q", n, s, new) for n, s, new in rows], "query string, name string, score double, is_new boolean")
        return {r.name for r in tags.selected(df, edges).collect()}

    assert chosen([("Combinatorial optimization", 0.94, False), ("Combinatorial adjoint matching", 0.94, True), ("Adjoint matching", 0.94, False), ("Optimization", 0.94, False)]) == {"Combinatorial adjoint matching", "Combinatorial optimization"}
    assert chosen([("MIMO", 0.9, False), ("Channel estimation", 0.9, False), ("MIMO channel estimation", 0.91, True), ("Unrelated field", 0.2, False)]) == {"Channel estimation", "MIMO"}
    names = ["Image classification", "Image categorization", "Visual categorization"]
    edges = spark.createDataFrame([(a, b, 0.9) for a in names for b in names if a < b], "a string, b string, score double")
    assert len(chosen([(n, 0.9, False) for n in names], edges)) == 1


def test_merged_tag_groups(spark):
    from quillgraph.operators import tags

    names = ["Deep Learning", "deep-learning", "Representation nets", "Robot control", "GPT-2", "GPT-3"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    pairs = tags.duplicate_pairs(df)
    edges = [("Deep Learning", "Representation nets", 0.95), ("deep-learning", "Representation nets", 0.9), ("Deep Learning", "Robot control", 0.86), ("GPT-2", "GPT-3", 0.99)]
    got = tags.merged_groups(tags.duplicate_groups(df, pairs), pairs, spark.createDataFrame(edges, "a string, b string, score double"))
    groups = {}
    for r in got.collect():
        groups.setdefault(r.group, set()).add(r.name)
    # each pair of names has to be linked, and numbers keep names apart
    assert {frozenset(x) for x in groups.values() if len(x) > 1} == {frozenset(names[:3])}


def test_changed_links(spark):
    from pyspark.sql import functions as F

    from quillgraph.functions import markup

    rows = spark.createDataFrame([("see [[Old]] and [[Old|mine]] or [[Old|Before]], [[else]].",), ("none",), (None,)], "text string")
    labels = F.create_map(F.lit("Old"), F.struct(F.lit("2026").alias("reference"), F.lit("New").alias("label"), F.lit("Before").alias("old")))
    got = [r.x for r in rows.select(markup.refreshed("text", labels).alias("x")).collect()]
    assert got == ["see [[2026|New]] and [[2026|mine]] or [[2026|New]], [[else]].", "none", None]


def test_scopes(spark):
    import glob

    from quillgraph.sources import scratch

    root = scratch.shared_dir(spark).removeprefix("file://")
    before = set(glob.glob(f"{root}/*"))
    with scratch.scope(spark) as paths:
        kept = scratch.materialize(spark.range(3))
        paths.remove(own := paths[0])
        scratch.materialize(spark.range(4))
    assert {f"file://{p}" for p in set(glob.glob(f"{root}/*")) - before} == {own} and kept.count() == 3


@pytest.mark.parametrize("crowd", [512, 5])
def test_near_hashes_against_all_pairs(spark, monkeypatch, crowd):
    """Hashes up to four bits apart, among them a crowd that shares its keys; keys are of some 32 bits."""
    monkeypatch.setattr(lexical, "CROWD", crowd)
    rng = random.Random(4)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    hashes = {rng.getrandbits(64) for _ in range(300)}
    for h in list(hashes)[:60]:
        for n in range(5):
            x = h
            for i in rng.sample(range(64), n):
                x ^= 1 << i
            hashes.add(x)
    hashes |= {(1 << 40) + i for i in range(40)} | {0, (1 << 64) - 1, (1 << 63)}
    df = spark.createDataFrame([(signed(x),) for x in hashes], "simhash long")
    want = {tuple(sorted((signed(x), signed(y)))) for x in hashes for y in hashes if x < y and (x ^ y).bit_count() <= 3}
    got = [(r.a, r.b) for r in lexical.near_hashes(df.union(df)).collect()]
    assert set(got) == want and len(got) == len(want) > 100
    keys = df.select(F.explode(lexical.tables_of("simhash", 3)).alias("t")).select("t.*")
    assert keys.select("table").distinct().count() == 20


def test_features_are_counted_where_the_text_is(spark):
    rows = [("a", "Deep nets", "deep nets of nets 12 the", "x1 deep nets"), ("b", "", "", ""), ("c", "No nets", "", "deep, nets"), (None, "lone word", "", "")]
    corpus = spark.createDataFrame(rows, "doc_key string, title string, abstract string, body string")
    docs = lexical.counts_by_document(corpus)
    assert "Exchange" not in docs._jdf.queryExecution().executedPlan().toString()
    got = {(r.doc_key, r.field, r.feature): r.tf for r in lexical.counts(corpus).collect()}
    want = {
        ("a", 0, "w:deep"): 1, ("a", 0, "w:nets"): 1, ("a", 0, "b:deep nets"): 1, ("a", 1, "w:deep"): 1, ("a", 1, "w:nets"): 2, ("a", 1, "b:deep nets"): 1,
        ("a", 2, "w:x1"): 1, ("a", 2, "w:deep"): 1, ("a", 2, "w:nets"): 1, ("a", 2, "b:x1 deep"): 1, ("a", 2, "b:deep nets"): 1, ("c", 0, "w:nets"): 1,
        ("c", 2, "w:deep"): 1, ("c", 2, "w:nets"): 1, ("c", 2, "b:deep nets"): 1, (None, 0, "w:lone"): 1, (None, 0, "w:word"): 1, (None, 0, "b:lone word"): 1,
    }
    assert got == want
    df = {r.feature: r.df for r in lexical.document_frequencies(docs).collect()}
    assert df["w:nets"] == 2 and df["w:lone"] == 0  # a document without a key isn't counted
    # rows of one key are one document
    both = lexical.counts_by_document(corpus.where("doc_key = 'a'").union(corpus.where("doc_key = 'a'")))
    assert [(r.doc_key, r.len0, r.len1, r.len2) for r in both.collect()] == [("a", 6, 8, 10)]
    assert {(r.field, r.feature): r.tf for r in lexical.by_field_of(both).collect()} == {k[1:]: 2 * v for k, v in want.items() if k[0] == "a"}
    assert lexical.counts_by_document(corpus.limit(0)).count() == 0


def test_grams_are_searched_by_blocks(spark, monkeypatch):
    import random

    from quillgraph.operators import discovery as d

    for name, value in (("ASKED_BLOCK", 4), ("NOTE_BLOCKS", (30, 30)), ("NOTES_AT_ONCE", 7), ("GRAMS_AT_ONCE", 5)):
        monkeypatch.setattr(d, name, value)
    r = random.Random(1)
    texts = {f"n{i:03}": "".join(r.choice("abcde") for _ in range(r.choice([0, 1, 4, 9, 9]))) for i in range(120)}
    texts |= {f"x{i}": texts["n004"] for i in range(12)}  # copies, which tie
    held = {k: {t[i : i + 2] for i in range(len(t) - 1)} for k, t in texts.items()}
    asked = {k: held[k] for k in sorted(held)[::9]}
    hidden, excluded = {"n005", "x3"}, {(q, k) for q in asked for k in held if k < "n010"}
    n = {g: sum(g in h for h in held.values()) for h in held.values() for g in h}
    want = set()
    for q, mine in asked.items():
        found = [(-round(sum(1 / n[g] for g in mine & h), 9), k) for k, h in held.items() if mine & h and k != q and k not in hidden and (q, k) not in excluded]
        want |= {(q, k, -x) for x, k in sorted(found)[:6]}
    index = spark.createDataFrame([(g, k) for k, h in held.items() for g in h], "term string, card_id string")
    notes = spark.createDataFrame(list(texts.items()), "id string, body string")
    queries = spark.createDataFrame([(q, g) for q, h in asked.items() for g in h], "query string, term string")
    without = spark.createDataFrame(list(excluded), "query string, card_id string")
    for given in (index, d.grams_by_note(notes)):
        rows = d.gram_candidates(given, queries, 6, spark.createDataFrame([(h,) for h in hidden], "card_id string"), without.unionAll(queries.selectExpr("query", "query")))
        assert {(x.query, x.card_id, round(x.weight, 9)) for x in rows.collect()} == want


def test_tag_seeds_read_the_first_of_each_tag_only(spark, monkeypatch):
    import random

    from quillgraph.operators import discovery as d

    monkeypatch.setattr(d, "TAG_SEEDS", 3)
    r = random.Random(2)
    tags = {(f"n{i:02}", t) for i in range(60) for t in "abcdefgh" if r.random() < 0.3}
    hidden, excluded = {"n03", "n04"}, {("n00", f"n{i:02}") for i in range(9)} | {("n01", "n01")}
    want = set()
    for q in ("n00", "n01"):
        own = sorted(t for c, t in tags if c == q)[:6]
        found = {c: [own.index(t) for x, t in tags if x == c and t in own] for c, _ in tags if c not in hidden and (q, c) not in excluded}
        want |= {(q, c, 0, len(found[c])) for c in sorted((c for c in found if found[c]), key=lambda c: (min(found[c]), c))[:3]}
    frame = lambda rows, schema: spark.createDataFrame(sorted(rows), schema)
    none = spark.createDataFrame([], "source_id string, target_id string"), spark.createDataFrame([], "card_id string, parent_id string")
    got = d.seeds(frame([("n00",), ("n01",)], "id string"), *none, frame(tags, "card_id string, tag string"), spark.createDataFrame([], "term string, card_id string"), spark.createDataFrame([], "query string, term string"), frame([(h,) for h in hidden], "card_id string"), frame(excluded, "query string, card_id string"))
    assert {(x.query, x.card_id, x.related, x.tag_matches) for x in got.collect()} == want


def test_features_are_counted_where_the_text_is(spark, tmp_path):
    from collections import Counter

    from quillgraph.functions import text as t
    from quillgraph.plans import QUERIES

    docs = [(1, "a\nb\nrunning dogs running dogs", "en", "s", 30), (2, "a\nb\nold dogs 图神经", "en", "s", 20), (3, None, "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    run = lambda rows, name: (spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet"), QUERIES["features"](spark, f"{tmp_path}/{name}"))[1]
    alone = run(docs, "one")
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()
    told = lambda df: sorted((x.doc_key or "", x.feature, x.tf) for x in df.collect())
    bodies = {i: (x or "").split("\n", 2)[-1] for i, x, *_ in docs}
    want = {i: Counter(t.features(b)) for i, b in bodies.items()}
    assert told(alone) == sorted((f"en/{i:014}", f, n) for i, c in want.items() for f, n in c.items())
    both = run([*docs, docs[0], (4, docs[0][1], None, "s", 30), (5, docs[1][1], None, "s", 20)], "two")  # a key twice, and rows without one
    null = want[1] + want[2]
    assert told(both) == sorted([(f"en/{i:014}", f, n * (1 + (i == 1))) for i, c in want.items() for f, n in c.items()] + [("", f, n) for f, n in null.items()])


def test_index_delta_indexes_only_changed_notes(spark, monkeypatch, tmp_path):
    log = str(tmp_path / "terms")
    from pyspark.sql import types as T

    @F.udf(T.ArrayType(T.StringType()))
    def terms(text):
        with open(log, "a") as out:
            out.write(f"{text}\n")
        return None if text is None else list(dict.fromkeys(text[i : i + 2].lower() for i in range(len(text) - 1)))

    old = spark.createDataFrame([("1", "same text"), ("2", "abc"), ("3", "gone"), ("4", None), ("6", "ab"), ("6", "bc")], "id string, body string")
    new = spark.createDataFrame([("1", "same text"), ("2", "abd"), ("4", "xy"), ("5", "z"), ("6", "bc"), ("6", "bd")], "id string, body string")
    want = {tuple(r) for r in notes.delta(notes.search_terms(old), notes.search_terms(new)).select("term", "card_id", "change").collect()}
    monkeypatch.setattr(notes, "bigrams", terms)
    got = [tuple(r) for r in notes.index_delta(old, new).select("term", "card_id", "change").collect()]
    assert set(got) == want and len(got) == len(want) and "same text" not in (tmp_path / "terms").read_text().splitlines()


def test_search_by_an_index_of_notes(spark):
    rows = spark.createDataFrame([("1", "a", "a", "a nation", "zettel", None, 0, 0), ("2", "b", "b", "an at io", "zettel", None, 0, 0), ("3", "c", "c", None, "zettel", "x nation", 0, 0)], "id string, title string, title_folded string, body string, note_type string, custom_key string, created_at long, updated_at long")
    text = rows.select("id", F.concat_ws("\n", "title", "body", "id", "custom_key").alias("body"))
    index = notes.terms_by_note(text)
    for query in ("nation", "nation a", "x", "at io", ""):
        assert {r.id for r in notes.search(rows, query, index=index).collect()} == {r.id for r in notes.search(rows, query, index=notes.search_terms(text)).collect()} == {r.id for r in notes.search(rows, query).collect()}
    plan = notes.search(rows, "nation ation", index=index)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan  # no row for each pair of characters


def logged(path):
    """A function that notes each value it is called with."""

    @F.udf("string")
    def f(x):
        with open(path, "a") as out:
            out.write(f"{x}\n")
        return x

    return f


def test_names_are_not_read_again_for_each_use(spark, tmp_path):
    names = spark.createDataFrame([("Deep Learning",), ("deep-learning",), ("networks",), ("network",), ("alone",)], "n string").select(logged(str(tmp_path / "read"))("n").alias("name"))
    groups = tags.duplicate_groups(names, tags.duplicate_pairs(names))
    assert {(r.name, r.group) for r in groups.collect()} == {("Deep Learning", "Deep Learning"), ("deep-learning", "Deep Learning"), ("networks", "network"), ("network", "network")}
    assert len((tmp_path / "read").read_text().splitlines()) <= 10


def test_references_are_read_once(spark, tmp_path):
    from quillgraph.operators import refs as r

    found = spark.createDataFrame([("1",), ("N2",), ("One",), ("two",), ("@x",)], "n string").select(logged(str(tmp_path / "refs"))("n").alias("ref"))
    n = spark.createDataFrame([("1", "One", "one"), ("2", "Two", "two")], "id string, title string, title_folded string")
    got = {x.ref: x.target for x in r.resolve(found, n, spark.createDataFrame([("N2", "2")], "note_key string, card_id string")).collect()}
    assert got == {"1": "1", "N2": "2", "One": "1", "two": "2", "@x": None} and len((tmp_path / "refs").read_text().splitlines()) == 5


def test_a_vectors_length_is_computed_once(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (7, [])], "k long, v array<double>")
    units = rows.select("k", dense.unit("v").alias("u"))
    assert {r.k: r.u for r in units.collect()} == {1: [0.6, 0.8], 2: None, 3: None, 4: None, 5: None, 6: None, 7: None}
    assert " transform(" not in units._jdf.queryExecution().optimizedPlan().toString()  # a function of each element would compute it again


def test_similarities_read_fields_and_pairs_once(spark, tmp_path):
    v = spark.createDataFrame([("a", 0, "w:x", 1.0), ("b", 0, "w:x", 1.0), ("a", 1, "w:y", 1.0), ("b", 1, "w:z", 1.0)], "k string, field int, feature string, weight double")
    fields = v.select(logged(str(tmp_path / "fields"))("k").alias("doc_key"), "field", "feature", "weight")
    pairs = spark.createDataFrame([("a",)], "q string").select(logged(str(tmp_path / "pairs"))("q").alias("query"), F.lit("b").alias("doc_key"))
    whole = spark.createDataFrame([("a", "w:x", 1.0), ("b", "w:x", 1.0)], "doc_key string, feature string, weight double")
    assert round(lexical.similarities(pairs, fields, whole).first().similarity, 9) == 0.7
    assert len((tmp_path / "fields").read_text().splitlines()) == 4 and len((tmp_path / "pairs").read_text().splitlines()) == 1


def test_equal_sums_are_ordered_by_key(spark):
    """The same numbers added in another order differ in their last bits."""
    from quillgraph.operators import bounds, lexical

    up, down = (0.1, 0.2, 0.3), (0.3, 0.2, 0.1)
    rows = [(key, f"f{k}", w) for key, ws in (("a", down), ("b", up), ("c", up), ("d", down)) for k, w in enumerate(ws)]
    vectors = spark.createDataFrame(rows, "doc_key string, feature string, weight double")
    queries = spark.createDataFrame([("q", f"f{k}", 1.0) for k in range(3)], "query string, feature string, query_weight double")
    assert {r.doc_key for r in lexical.candidates(queries, vectors, 2).collect()} == {"a", "b"}
    assert {r.doc_key for r in bounds.top_k(queries, bounds.build(vectors), 2)[0].collect()} == {"a", "b"}


def test_kept_lists_take_unknown_documents_before_new_ones_of_the_same_score(spark):
    from quillgraph.operators import reverse

    vectors = lambda rows: spark.createDataFrame([(key, "f", w) for key, w in rows], "doc_key string, feature string, weight double")
    queries = spark.createDataFrame([("q", "f", 1.0)], "query string, feature string, query_weight double")
    lists = spark.createDataFrame([("q", "a", 0.9), ("q", "b", 0.5)], "query string, key string, score double")
    gone = spark.createDataFrame([("a",)], "key string")
    got = reverse.maintained(lists, queries, vectors([("b", 0.5), ("c", 0.5), ("d", 0.5)]), vectors([("d", 0.5)]), gone, 2)
    assert {r.key for r in got.collect()} == {"b", "c"}


@pytest.mark.parametrize("name", ["merge3", "clean_text"])
def test_a_task_gets_few_texts_at_once(spark, sf_dir, name):
    """Spark's own batches are 10,000 rows."""
    from quillgraph import plans

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        sizes = plans.QUERIES[name](spark, sf_dir).sparkSession.conf.get(key)
        assert int(sizes) <= 500
    finally:
        spark.conf.set(key, before)
