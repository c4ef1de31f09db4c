"""Hierarchies and the link graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from .registry import query

ACTIVE = "NOT EXISTS (SELECT 1 FROM v_unavailable u WHERE u.card_id = z.id)"
CARDS = f"a AS (SELECT id, title, body FROM v_notes z WHERE {ACTIVE})"
DANGLING = "d AS (SELECT * FROM v_links WHERE source_id IN (SELECT id FROM a) AND NOT starts_with(ref, 'zotero://') AND (target_id IS NULL OR target_id NOT IN (SELECT id FROM a)))"
EDGES = f"""{CARDS}, {DANGLING}, e AS (SELECT parent_id AS source, card_id AS target, 'parent' AS kind, '' AS ref FROM v_parents WHERE parent_id IN (SELECT id FROM a) AND card_id IN (SELECT id FROM a)
  UNION ALL SELECT source_id, target_id, 'link', ref FROM v_links WHERE source_id IN (SELECT id FROM a) AND target_id IN (SELECT id FROM a) UNION ALL SELECT source_id, concat('unresolved:', ref), 'link', ref FROM d)"""
UNDIRECTED = "u AS (SELECT source AS node, target AS peer FROM e WHERE source <> target UNION SELECT target, source FROM e WHERE source <> target)"


def edges(s):
    return g.edges(s.v_notes, s.v_links, s.v_parents, s.v_unavailable)


@query("descendants", """WITH RECURSIVE r(root, id, depth) AS (SELECT id, id, 0 FROM v_notes WHERE doc_id IN (1, 2, 30) UNION SELECT root, card_id, depth + 1 FROM r JOIN v_parents ON parent_id = r.id) SELECT * FROM r""")
def descendants(s):
    return g.descendants(s.v_parents, s.v_notes.where("doc_id in (1, 2, 30)"))


@query("ancestors", """WITH RECURSIVE r(id, ancestor, depth) AS (SELECT card_id, parent_id, 1 FROM v_parents WHERE parent_id IS NOT NULL AND card_id LIKE '%7' AND parent_id NOT IN (SELECT card_id FROM v_unavailable)
  UNION SELECT r.id, p.parent_id, r.depth + 1 FROM r JOIN v_parents p ON p.card_id = r.ancestor WHERE p.parent_id IS NOT NULL AND p.parent_id NOT IN (SELECT card_id FROM v_unavailable)) SELECT * FROM r""")
def ancestors(s):
    free = s.v_notes.join(s.v_unavailable.withColumnRenamed("card_id", "id"), "id", "left_anti")
    return g.ancestors(s.v_parents, s.v_notes.where("id like '%7'"), free)


@query("hierarchy_cycles", """WITH RECURSIVE p AS (SELECT card_id, CASE card_id WHEN '00000000000000' THEN '00000000000002' WHEN '00000000000004' THEN '00000000000123' ELSE parent_id END AS parent_id FROM v_parents),
  r(id, spot) AS (SELECT card_id, parent_id FROM p WHERE parent_id IS NOT NULL UNION SELECT r.id, p.parent_id FROM r JOIN p ON p.card_id = r.spot WHERE p.parent_id IS NOT NULL) SELECT id FROM r WHERE id = spot""")
def hierarchy_cycles(s):
    turned = s.v_parents.withColumn("parent_id", F.expr("case card_id when '00000000000000' then '00000000000002' when '00000000000004' then '00000000000123' else parent_id end"))
    return g.cycles(turned)


@query("move_check", """WITH RECURSIVE m AS (SELECT lpad(CAST(doc_id AS VARCHAR), 14, '0') AS card_id, lpad(CAST((doc_id * 37) % (SELECT count(*) FROM v_notes) AS VARCHAR), 14, '0') AS parent_id FROM v_notes),
  r(id, spot) AS (SELECT parent_id, parent_id FROM m UNION SELECT r.id, p.parent_id FROM r JOIN v_parents p ON p.card_id = r.spot WHERE p.parent_id IS NOT NULL)
  SELECT card_id, parent_id, EXISTS (SELECT 1 FROM r WHERE r.id = m.parent_id AND r.spot = m.card_id) AS cycle FROM m""")
def move_check(s):
    pad = lambda c: F.lpad(c.cast("string"), 14, "0")
    size = s.v_notes.agg(F.count("*").alias("n"))  # one row
    return g.would_cycle(s.v_parents, s.v_notes.crossJoin(size).select(pad(F.col("doc_id")).alias("card_id"), pad(F.col("doc_id") * 37 % F.col("n")).alias("parent_id")))


@query("inherited_tags", """WITH RECURSIVE f AS (SELECT id FROM v_notes z WHERE NOT EXISTS (SELECT 1 FROM v_unavailable u WHERE u.card_id = z.id)), r(id, holder, depth) AS (SELECT id, id, 0 FROM f
  UNION SELECT r.id, p.parent_id, r.depth + 1 FROM r JOIN v_parents p ON p.card_id = r.holder WHERE p.parent_id IN (SELECT id FROM f)) SELECT id, tag, min(depth) AS depth FROM r JOIN v_tags t ON t.card_id = holder GROUP BY id, tag""")
def inherited_tags(s):
    free = s.v_notes.join(s.v_unavailable.withColumnRenamed("card_id", "id"), "id", "left_anti").select("id")
    return g.inherited_tags(s.v_parents, s.v_tags, free)


@query("tree_depth", "WITH RECURSIVE p AS (SELECT card_id, CASE WHEN CAST(card_id AS BIGINT) % 50 <> 7 THEN parent_id END AS parent_id FROM v_parents), r(id, root, depth) AS (SELECT card_id, card_id, 0 FROM p WHERE parent_id IS NULL AND card_id IN (SELECT parent_id FROM p) UNION ALL SELECT p.card_id, root, depth + 1 FROM r JOIN p ON parent_id = r.id) SELECT * FROM r")
def tree_depth(s):
    """Every fiftieth note is at the top too; those with nothing below them are left out."""
    return g.levels(s.v_parents.withColumn("parent_id", F.when(F.col("card_id").cast("long") % 50 != 7, F.col("parent_id"))))


@query("label_order", """WITH n AS (SELECT id, CASE WHEN doc_id % 6 = 0 THEN 'unresolved' ELSE 'card' END AS kind, (SELECT count(*) FROM v_links WHERE source_id = id OR target_id = id) AS radius FROM v_notes)
  SELECT id, kind, radius, CAST(row_number() OVER (ORDER BY radius DESC, kind = 'card' DESC, id) AS INT) AS place FROM n QUALIFY place <= 40""")
def label_order(s):
    ends = s.v_links.select(F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("id")).where("id is not null").groupBy("id").agg(F.count("*").alias("radius"))
    rows = s.v_notes.select("id", F.when(F.col("doc_id") % 6 == 0, "unresolved").otherwise("card").alias("kind")).join(ends, "id", "left")
    return g.label_order(rows.withColumn("radius", F.coalesce("radius", F.lit(0))), 40)


@query("mean_depth", "WITH RECURSIVE r(id, depth) AS (SELECT card_id, 0 FROM v_parents WHERE parent_id IS NULL UNION ALL SELECT card_id, depth + 1 FROM r JOIN v_parents ON parent_id = r.id) SELECT round(avg(depth), 6) AS mean_depth, max(depth) AS max_depth FROM r")
def mean_depth(s):
    return g.levels(s.v_parents).agg(F.round(F.avg("depth"), 6).alias("mean_depth"), F.max("depth").alias("max_depth"))


@query("node_removed", "SELECT card_id, CASE WHEN parent_id = '00000000000004' THEN '00000000000001' ELSE parent_id END AS parent_id FROM v_parents WHERE card_id <> '00000000000004'")
def node_removed(s):
    return g.without(s.v_parents, "00000000000004")


@query("regular_ancestor", """WITH RECURSIVE r(id, spot, hop) AS (SELECT card_id, card_id, 0 FROM v_parents UNION ALL SELECT r.id, p.parent_id, hop + 1 FROM r JOIN v_parents p ON p.card_id = r.spot WHERE hop < 5 AND p.parent_id IS NOT NULL),
  k AS (SELECT r.id, r.spot, r.hop FROM r JOIN v_notes z ON z.id = r.spot WHERE z.note_type = 'literature') SELECT p.card_id AS id, (SELECT arg_min(spot, hop) FROM k WHERE k.id = p.card_id) AS item FROM v_parents p""")
def regular_ancestor(s):
    return g.regular_ancestor(s.v_parents, s.v_notes.where("note_type = 'literature'"))


@query("graph_nodes", f"WITH {CARDS}, {DANGLING} SELECT id, title, 'card' AS kind FROM a UNION ALL SELECT DISTINCT concat('unresolved:', ref), ref, 'unresolved' FROM d")
def graph_nodes(s):
    return g.nodes(s.v_notes, s.v_links, s.v_unavailable)


@query("graph_edges", f"WITH {EDGES} SELECT source, target, kind, CASE WHEN kind = 'parent' THEN '' ELSE coalesce(substring(list_filter(string_split(body, chr(10)), lambda x: contains(x, ref))[1], 1, 400), '') END AS context FROM e JOIN a ON a.id = source")
def graph_edges(s):
    return edges(s)


@query("k_hop", f"""WITH {EDGES}, {UNDIRECTED}, h0 AS (SELECT id, 0 AS depth FROM v_notes WHERE doc_id IN (5, 77)), h1 AS (SELECT DISTINCT peer AS id, 1 AS depth FROM u JOIN h0 ON h0.id = node), h2 AS (SELECT DISTINCT peer AS id, 2 AS depth FROM u JOIN h1 ON h1.id = node)
  SELECT id, min(depth) AS depth FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY id""")
def k_hop(s):
    return g.k_hop(edges(s), s.v_notes.where("doc_id in (5, 77)").select("id"), 2)


@query("graph_query_expand", f"""WITH {EDGES}, {UNDIRECTED}, q AS (SELECT id FROM a WHERE contains(lower(concat_ws(' ', title, id, body)), 'license')) SELECT id, max(hit) AS hit FROM (SELECT id, TRUE AS hit FROM q UNION ALL SELECT peer, FALSE FROM u WHERE node IN (SELECT id FROM q) AND peer IN (SELECT id FROM a)) GROUP BY id""")
def graph_query_expand(s):
    free = s.v_notes.join(s.v_unavailable.withColumnRenamed("card_id", "id"), "id", "left_anti")
    return g.expanded(free, edges(s), "License")


DEGREES = f"{EDGES}, x AS (SELECT source AS id, target AS peer, kind FROM e UNION ALL SELECT target, source, kind FROM e), g AS (SELECT id, count(DISTINCT peer) AS neighbours, count(*) FILTER (WHERE kind = 'parent') AS structure, count(*) FILTER (WHERE kind = 'link') AS reference FROM x WHERE id <> peer GROUP BY id)"


@query("graph_degree", f"WITH {DEGREES} SELECT * FROM g")
def graph_degree(s):
    return g.degrees(edges(s))


@query("node_radius", f"WITH {DEGREES} SELECT id, round(least(13.0, 6 + 1.5 * sqrt(structure) + 0.7 * sqrt(neighbours)), 6) AS radius FROM g")
def node_radius(s):
    return g.degrees(edges(s)).select("id", F.round(g.radius(), 6).alias("radius"))


@query("node_connections", f"""WITH {EDGES} SELECT DISTINCT CASE WHEN kind = 'parent' THEN CASE WHEN source = '00000000000007' THEN 'children' ELSE 'parent' END WHEN source = '00000000000007' THEN 'outgoing' ELSE 'backlinks' END AS relation, CASE WHEN source = '00000000000007' THEN target ELSE source END AS id
  FROM e WHERE (source = '00000000000007' OR target = '00000000000007') AND source <> target""")
def node_connections(s):
    return g.connections(edges(s), "00000000000007")


@query("hide_isolated", f"WITH {EDGES}, {UNDIRECTED} SELECT id, title FROM a WHERE id IN (SELECT node FROM u)")
def hide_isolated(s):
    return g.connected_only(g.nodes(s.v_notes, s.v_links, s.v_unavailable).where("kind = 'card'"), edges(s)).select("id", "title")


@query("graph_stats", f"WITH {EDGES} SELECT (SELECT count(*) FROM a) AS cards, (SELECT count(*) FROM e WHERE kind = 'link') AS links")
def graph_stats(s):
    cards = s.v_notes.join(s.v_unavailable.withColumnRenamed("card_id", "id"), "id", "left_anti").agg(F.count("*").alias("cards"))
    return cards.crossJoin(F.broadcast(edges(s).where("kind = 'link'").agg(F.count("*").alias("links"))))


@query("group_anchors", "SELECT library AS grp, round(180 * cos(2 * pi() * (row_number() OVER (ORDER BY library) - 1) / count(*) OVER ()), 6) + 0.0 AS x, round(180 * sin(2 * pi() * (row_number() OVER (ORDER BY library) - 1) / count(*) OVER ()), 6) + 0.0 AS y FROM (SELECT DISTINCT library FROM v_notes)")
def group_anchors(s):
    return g.group_anchors(s.v_notes.select(F.col("library").alias("group"))).select(F.col("group").alias("grp"), (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"))


@query("scoped_edges", """WITH k AS (SELECT id FROM v_notes z WHERE NOT EXISTS (SELECT 1 FROM v_unavailable u WHERE u.card_id = z.id) AND note_type IN ('zettel', 'entity')) SELECT parent_id AS source, card_id AS target FROM v_parents WHERE parent_id IN (SELECT id FROM k) AND card_id IN (SELECT id FROM k)""")
def scoped_edges(s):
    kinds = s.v_notes.select("id", "note_type")
    nodes = g.nodes(s.v_notes, s.v_links, s.v_unavailable).join(kinds, "id", "left")
    return g.scoped(nodes, g.edges(s.v_notes, s.v_links, s.v_parents, s.v_unavailable), ["zettel", "entity"], "hierarchy").select("source", "target")
