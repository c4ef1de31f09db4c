"""Hierarchies of notes and the graph of their links.

parents are rows (card_id, parent_id), a null parent being the top; edges are
rows (source, target, kind). Closures go by rounds that double how far they
look; rounds are written to the shared folder, so the lineage doesn't grow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize


def closure(start: DataFrame, steps: DataFrame) -> DataFrame:
    """id, end and depth (1: the next) of all that the nodes in start (id) lead to
    by steps (at, next). Each round takes what was found twice as far, by jumps
    that double too, so a chain of n nodes takes log n rounds; a cycle ends it as
    the top does, when nothing new is found."""
    jumps = steps.select("at", "next").distinct()
    found = materialize(start.select(F.col("id").alias("at")).distinct().join(jumps, "at").select(F.col("at").alias("id"), F.col("next").alias("end"), F.lit(1).alias("depth")).distinct())
    reach, n = 1, found.count()
    while n:
        ahead = found.join(jumps, F.col("end") == F.col("at")).select("id", "next", F.col("depth") + reach)
        found = materialize(found.union(ahead).groupBy("id", "end").agg(F.min("depth").alias("depth")))
        m = found.count()
        if m == n:
            break
        twice = jumps.select("at", F.col("next").alias("via")).join(jumps.select(F.col("at").alias("via"), "next"), "via")
        jumps, reach, n = materialize(twice.select("at", "next").distinct()), 2 * reach, m
    return found


def ancestors(parents: DataFrame, start: DataFrame | None = None, passable: DataFrame | None = None) -> DataFrame:
    """id, ancestor and depth (1: the parent) of the nodes in start (id; all
    nodes if None). With passable (id) the way up ends before any other node."""
    steps = parents.where("parent_id is not null").select(F.col("card_id").alias("at"), F.col("parent_id").alias("next"))
    if passable is not None:
        steps = steps.join(passable.select(F.col("id").alias("next")), "next", "left_semi").select("at", "next")
    start = steps.select(F.col("at").alias("id")) if start is None else start
    return closure(start, steps).select("id", F.col("end").alias("ancestor"), "depth")


def descendants(parents: DataFrame, roots: DataFrame) -> DataFrame:
    """root, id and depth (0: the root itself) of everything below the roots (id)."""
    steps = parents.where("parent_id is not null").select(F.col("parent_id").alias("at"), F.col("card_id").alias("next"))
    below = closure(roots, steps).where("id != end").select(F.col("id").alias("root"), F.col("end").alias("id"), "depth")
    return roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")).distinct().union(below)


def cycles(parents: DataFrame) -> DataFrame:
    """id of the nodes that are their own ancestors; a node has one parent.

    A table of jumps, first to the parent, is squared. Who has no node so far up
    leads to the top and is gone, and where nobody lands is on no cycle and starts
    no further jump: a tree shrinks by its levels. When each of those left is landed
    on once, they are the cycles; a jump longer than there are nodes lands on them, too."""
    jumps = materialize(parents.where("parent_id is not null").select("card_id", F.col("parent_id").alias("to")).distinct())
    reach, n = 1, jumps.count()
    while reach <= n:
        rows, landed = jumps.agg(F.count("*"), F.countDistinct("to")).first()
        onto = jumps.join(jumps.select(F.col("to").alias("card_id")).distinct(), "card_id", "left_semi")
        if not rows or (rows == landed and rows == onto.count()):
            break
        further = onto.select(F.col("card_id").alias("to"), F.col("to").alias("next"))
        jumps, reach = materialize(onto.join(further, "to").select("card_id", F.col("next").alias("to")).distinct()), 2 * reach
    return jumps.select(F.col("to").alias("id")).distinct()


def would_cycle(parents: DataFrame, moves: DataFrame) -> DataFrame:
    """moves (card_id, parent_id: the new parent) with cycle: whether the move puts a node below itself."""
    above = ancestors(parents, moves.select(F.col("parent_id").alias("id")))
    hit = above.select(F.col("id").alias("parent_id"), F.col("ancestor").alias("card_id"), F.lit(True).alias("below"))
    return moves.join(hit, ["card_id", "parent_id"], "left").select("card_id", "parent_id", (F.coalesce("below", F.lit(False)) | (F.col("card_id") == F.col("parent_id"))).alias("cycle"))


def inherited_tags(parents: DataFrame, tags: DataFrame, available: DataFrame) -> DataFrame:
    """id, tag and depth (0: its own) of the available notes (id); a tag counts
    from its nearest holder, and a parent that isn't available ends the way up."""
    up = ancestors(parents, available, available)
    own = tags.select(F.col("card_id").alias("holder"), "tag")
    held = available.select("id", F.col("id").alias("holder"), F.lit(0).alias("depth")).union(up.select("id", "ancestor", "depth"))
    return held.join(own, "holder").groupBy("id", "tag").agg(F.min("depth").alias("depth"))


def levels(parents: DataFrame) -> DataFrame:
    """id, root and depth below the top; a node at the top without anything below it is no tree."""
    have = parents.where("parent_id is not null").select(F.col("parent_id").alias("card_id")).distinct()
    top = parents.where("parent_id is null").join(have, "card_id", "left_semi").select(F.col("card_id").alias("id"))
    return descendants(parents, top).select("id", "root", "depth")


def context(body: str, ref: str, length: int = 400):
    """The first line of the body that holds the reference."""
    line = F.filter(F.split(body, "\n"), lambda x: F.contains(x, F.col(ref)))
    return F.coalesce(F.substring(F.get(line, F.lit(0)), 1, length), F.lit(""))


def nodes(notes: DataFrame, links: DataFrame, unavailable: DataFrame) -> DataFrame:
    """id, title and kind: active notes, and 'unresolved:ref' for references from them that lead nowhere."""
    cards = notes.join(unavailable.select(F.col("card_id").alias("id")), "id", "left_anti")
    missing = dangling(links, cards).select(F.concat(F.lit("unresolved:"), "ref").alias("id"), F.col("ref").alias("title")).distinct()
    return cards.select("id", "title", F.lit("card").alias("kind")).union(missing.withColumn("kind", F.lit("unresolved")))


def dangling(links: DataFrame, cards: DataFrame) -> DataFrame:
    ids = cards.select("id")
    from_active = links.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").where("not startswith(ref, 'zotero://')")
    return from_active.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_anti")


def edges(notes: DataFrame, links: DataFrame, parents: DataFrame, unavailable: DataFrame) -> DataFrame:
    """source, target, kind (parent or link) and context between nodes()."""
    cards = notes.join(unavailable.select(F.col("card_id").alias("id")), "id", "left_anti")
    ids = cards.select("id")
    both = lambda rows, a, b: rows.join(ids.withColumnRenamed("id", a), a, "left_semi").join(ids.withColumnRenamed("id", b), b, "left_semi")
    up = both(parents.where("parent_id is not null"), "card_id", "parent_id").select(F.col("parent_id").alias("source"), F.col("card_id").alias("target"), F.lit("parent").alias("kind"), F.lit("").alias("context"))
    bodies = cards.select(F.col("id").alias("source_id"), "body")
    found = both(links.where("target_id is not null"), "source_id", "target_id").join(bodies, "source_id").select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.lit("link").alias("kind"), context("body", "ref").alias("context"))
    missing = dangling(links, cards).join(bodies, "source_id").select(F.col("source_id").alias("source"), F.concat(F.lit("unresolved:"), "ref").alias("target"), F.lit("link").alias("kind"), context("body", "ref").alias("context"))
    return up.union(found).union(missing)


def undirected(edges: DataFrame) -> DataFrame:
    """node and peer, both ways, without loops, each once."""
    pairs = edges.select(F.col("source").alias("node"), F.col("target").alias("peer"))
    return pairs.union(pairs.select("peer", "node")).where("node != peer").distinct()


def k_hop(edges: DataFrame, centres: DataFrame, depth: int = 1) -> DataFrame:
    """id and depth of the nodes within depth (0 to 6) steps of the centres (id), either way."""
    depth = max(0, min(6, depth))
    near = undirected(edges)
    found = centres.select("id", F.lit(0).alias("depth")).distinct()
    new = found
    for d in range(1, depth + 1):
        ahead = new.join(near, F.col("id") == F.col("node")).select(F.col("peer").alias("id")).distinct()
        new = materialize(ahead.join(found.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)))
        found = found.union(new)
    return found


def expanded(notes: DataFrame, edges: DataFrame, query: str) -> DataFrame:
    """id and hit of the notes that hold the query in title, id or body, and of their neighbours."""
    whole = query.strip().lower()
    hits = notes.where(F.contains(F.lower(F.concat_ws(" ", "title", "id", "body")), F.lit(whole))).select("id")
    near = undirected(edges).join(hits.withColumnRenamed("id", "node"), "node", "left_semi").select(F.col("peer").alias("id"))
    near = near.join(notes.select("id"), "id", "left_semi")
    return hits.withColumn("hit", F.lit(True)).union(near.withColumn("hit", F.lit(False))).groupBy("id").agg(F.max("hit").alias("hit"))


def degrees(edges: DataFrame) -> DataFrame:
    """id, neighbours (distinct), structure and reference: edges of either kind."""
    ends = edges.select(F.col("source").alias("id"), F.col("target").alias("peer"), "kind").union(edges.select("target", "source", "kind")).where("id != peer")
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    return ends.groupBy("id").agg(F.countDistinct("peer").alias("neighbours"), count("parent").alias("structure"), count("link").alias("reference"))


def radius(structure: str = "structure", neighbours: str = "neighbours"):
    return F.least(F.lit(13.0), F.lit(6.0) + 1.5 * F.sqrt(structure) + 0.7 * F.sqrt(neighbours))


def connections(edges: DataFrame, node: str) -> DataFrame:
    """relation (parent, children, outgoing, backlinks) and id of what a node is connected with."""
    own = edges.where((F.col("source") == node) | (F.col("target") == node)).where("source != target")
    out = F.col("source") == node
    relation = F.when(F.col("kind") == "parent", F.when(out, "children").otherwise("parent")).otherwise(F.when(out, "outgoing").otherwise("backlinks"))
    return own.select(relation.alias("relation"), F.when(out, F.col("target")).otherwise(F.col("source")).alias("id")).distinct()


def connected_only(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with an edge to another node."""
    return nodes.join(undirected(edges).select(F.col("node").alias("id")).distinct(), "id", "left_semi")


def scoped(nodes: DataFrame, edges: DataFrame, kinds: list[str], relation: str = "both", unresolved: bool = True) -> DataFrame:
    """Edges of a relation (hierarchy, references, both) between nodes of the kinds."""
    keep = nodes.where(F.col("note_type").isin(kinds) | (F.lit(unresolved) & (F.col("kind") == "unresolved"))).select("id")
    rows = edges if relation == "both" else edges.where(F.col("kind") == ("parent" if relation == "hierarchy" else "link"))
    return rows.join(keep.withColumnRenamed("id", "source"), "source", "left_semi").join(keep.withColumnRenamed("id", "target"), "target", "left_semi")


def without(parents: DataFrame, gone: str) -> DataFrame:
    """The hierarchy without one node; its children go to its parent."""
    above = parents.where(F.col("card_id") == gone).select(F.col("parent_id").alias("above"), F.lit(True).alias("hit"))
    rows = parents.where(F.col("card_id") != gone).join(F.broadcast(above), F.col("parent_id") == gone, "left")
    return rows.select("card_id", F.when(F.col("hit"), F.col("above")).otherwise(F.when(F.col("parent_id") != gone, F.col("parent_id"))).alias("parent_id"))


def regular_ancestor(parents: DataFrame, regular: DataFrame, hops: int = 5) -> DataFrame:
    """id and item: the first regular node (id) on the way up, itself included, in at most so many hops."""
    up = parents.select("card_id", "parent_id")
    known = regular.select(F.col("id").alias("at"), F.lit(True).alias("ok"))
    rows = up.select(F.col("card_id").alias("id"), F.col("card_id").alias("at"), F.lit(None).cast("string").alias("item"))
    for hop in range(hops + 1):
        rows = rows.join(known, "at", "left").withColumn("item", F.coalesce("item", F.when(F.col("ok"), F.col("at")))).drop("ok")
        if hop < hops:
            rows = rows.join(up.withColumnRenamed("card_id", "at"), "at", "left").select("id", F.when(F.col("item").isNull(), F.col("parent_id")).alias("at"), "item")
    return rows.select("id", "item")


def group_anchors(groups: DataFrame) -> DataFrame:
    """group, x, y: groups (group) in order, spread over a circle of radius max(180, 18 * sqrt(n)) for n groups."""
    from pyspark.sql import Window

    whole = Window.partitionBy(F.lit(0))  # a row for each group, of which there are few
    rows = groups.select("group").distinct().withColumn("k", F.row_number().over(whole.orderBy("group")) - 1).withColumn("n", F.count("*").over(whole))
    angle, size = 2 * F.pi() * F.col("k") / F.col("n"), F.greatest(F.lit(180.0), 18 * F.sqrt("n"))
    return rows.select("group", (size * F.cos(angle)).alias("x"), (size * F.sin(angle)).alias("y"))


def label_order(nodes: DataFrame, size: int) -> DataFrame:
    """The ``size`` nodes (id, kind, radius) whose labels are placed first, with place: by radius, cards first, then by id."""
    order = [F.desc("radius"), F.desc(F.col("kind") == "card"), F.asc("id")]
    first = nodes.orderBy(*order).limit(size)  # a bounded heap in each task
    return first.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
