"""Items of a library and the notes that stand for them; freshness and states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dense as d
from ..operators import library as lib
from ..operators import lexical as x
from ..operators import notes as n
from ..operators import refs as r
from ..operators import upkeep as u
from .registry import query
from .retrieval_queries import MODEL, VECTORS

ITEMS = "SELECT doc_id AS id, lang AS library, split_part(text, chr(10), 1) AS title, source AS creator, concat('2', lpad(cast(doc_id % 30 AS varchar(20)), 3, '0'), '-05') AS date, CASE WHEN doc_id % 3 = 0 THEN concat('C', cast(doc_id AS varchar(20))) END AS citation_key, CASE WHEN doc_id % 3 = 1 THEN concat('B', cast(doc_id AS varchar(20))) END AS other_key, concat('note', chr(10), 'Citation Key: E', cast(doc_id AS varchar(20))) AS extra FROM documents"


def items(s):
    key = F.col("doc_id").cast("string")
    return s.documents.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("library"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("source").alias("creator"), F.concat(F.lit("2"), F.lpad((F.col("doc_id") % 30).cast("string"), 3, "0"), F.lit("-05")).alias("date"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("C"), key)).alias("citation_key"), F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("B"), key)).alias("other_key"), F.concat(F.lit("note\nCitation Key: E"), key).alias("extra"),
    )


@query("creator_year", f"SELECT id, regexp_extract(date, '([0-9]{{4}})', 1) AS year, trim(concat_ws(' ', creator, regexp_extract(date, '([0-9]{{4}})', 1))) AS creator_year FROM ({ITEMS})")
def creator_year(s):
    return items(s).select("id", lib.year("date").alias("year"), lib.creator_year("creator", "date").alias("creator_year"))


@query("catalogue_search", f"SELECT id, library FROM (SELECT *, row_number() OVER (PARTITION BY library ORDER BY id) AS place FROM ({ITEMS}) WHERE lower(title) LIKE '%er%' OR lower(creator) LIKE '%er%' OR lower(date) LIKE '%er%' OR lower(citation_key) LIKE '%er%' OR lower(extra) LIKE '%er%') WHERE place <= 30")
def catalogue_search(s):
    return lib.catalogue(items(s), "er").select("id", "library")


@query("citation_lookup", f"SELECT DISTINCT key, id FROM (SELECT id, coalesce(citation_key, other_key, regexp_extract(extra, 'Citation Key: (\\S+)', 1)) AS key FROM ({ITEMS})) WHERE key IN (SELECT concat(substring('CBE', CAST(1 + doc_id % 3 AS INT), 1), CAST(doc_id AS VARCHAR)) FROM documents UNION SELECT concat('C', CAST(doc_id AS VARCHAR)) FROM documents)")
def citation_lookup(s):
    key = F.col("doc_id").cast("string")
    mine = F.concat(F.when(F.col("doc_id") % 3 == 0, "C").when(F.col("doc_id") % 3 == 1, "B").otherwise("E"), key)
    return lib.by_citation_key(items(s), s.documents.select(mine.alias("key")).union(s.documents.select(F.concat(F.lit("C"), key))))


@query("annotation_scan", "SELECT o_custkey AS id, l_orderkey * 10 + l_linenumber AS annotation, l_returnflag AS text FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber % 3 < 2 AND l_returnflag <> 'N' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def annotation_scan(s):
    own = s.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"))
    parts = s.orders.select(F.col("o_orderkey").alias("attachment"), F.col("o_custkey").alias("id"))
    kind = F.when(F.col("l_linenumber") % 3 == 0, "highlight").when(F.col("l_linenumber") % 3 == 1, "underline").otherwise("image")
    marks = s.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("annotation"), F.col("l_orderkey").alias("parent"), kind.alias("kind"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).otherwise(" ").alias("text"))
    return lib.annotations(own, parts, marks)


@query("item_creators", "SELECT l_orderkey AS id, string_agg(trim(concat_ws(' ', r_name, s_name)), '; ' ORDER BY l_linenumber, trim(concat_ws(' ', r_name, s_name))) AS creators FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY l_orderkey")
def item_creators(s):
    people = s.supplier.join(s.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(s.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("creator"), F.col("r_name").alias("first"), F.col("s_name").alias("last"))
    return lib.creators(s.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("creator"), F.col("l_linenumber").alias("place")), people)


@query("item_sources", "SELECT c_custkey AS id, n_nationkey AS library, CASE WHEN n_regionkey % 2 = 0 THEN 'user' ELSE 'group' END AS kind, count(o_orderkey) AS attachments FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey WHERE n_regionkey <> 3 GROUP BY ALL")
def item_sources(s):
    libraries = s.nation.select(F.col("n_nationkey").alias("library"), F.when(F.col("n_regionkey") == 3, "feed").when(F.col("n_regionkey") % 2 == 0, "user").otherwise("group").alias("kind"))
    return lib.with_sources(s.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("library")), libraries, s.orders.select(F.col("o_orderkey").alias("attachment"), F.col("o_custkey").alias("id")))


def library_notes(s):
    day = lambda k: F.concat(F.lit("2025-0"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("-1"), (F.col("doc_id") % 10).cast("string"), F.lit(" 0"), (F.col("doc_id") % 7 + k).cast("string"), F.lit(":15:0"), (F.col("doc_id") % 6).cast("string"))
    return s.documents.select(F.col("doc_id").alias("item"), F.concat(F.lit("N"), F.col("doc_id").cast("string")).alias("note_key"), (F.col("doc_id") % 3).alias("library_id"), day(0).alias("added"), day(2).alias("modified"))


LIBRARY_NOTES = "SELECT doc_id AS item, concat('N', CAST(doc_id AS VARCHAR)) AS note_key, doc_id % 3 AS library_id, concat('2025-0', doc_id % 9 + 1, '-1', doc_id % 10, ' 0', doc_id % 7, ':15:0', doc_id % 6) AS added, concat('2025-0', doc_id % 9 + 1, '-1', doc_id % 10, ' 0', doc_id % 7 + 2, ':15:0', doc_id % 6) AS modified FROM documents"


@query("unmapped_notes", f"SELECT item, note_key FROM ({LIBRARY_NOTES}) WHERE note_key NOT IN (SELECT note_key FROM v_card_notes)")
def unmapped_notes(s):
    return lib.unmapped(library_notes(s), s.v_card_notes).select("item", "note_key")


@query("note_discovery_page", f"SELECT item, note_key FROM ({LIBRARY_NOTES}) WHERE item > 10 AND note_key NOT IN (SELECT note_key FROM v_card_notes) ORDER BY item LIMIT 100")
def note_discovery_page(s):
    return lib.unmapped(library_notes(s), s.v_card_notes, 10, 100).select("item", "note_key")


@query("cards_from_notes", f"SELECT id, epoch_ms(strptime(added, '%Y-%m-%d %H:%M:%S')) AS created_at, epoch_ms(strptime(modified, '%Y-%m-%d %H:%M:%S')) AS updated_at, note_key FROM (SELECT *, regexp_replace(added, '[^0-9]', '', 'g') AS id, row_number() OVER (PARTITION BY added ORDER BY library_id, note_key) AS nth FROM ({LIBRARY_NOTES})) WHERE nth = 1 AND id NOT IN (SELECT id FROM v_notes)")
def cards_from_notes(s):
    cards, mapped = lib.cards_of(library_notes(s), s.v_notes.select("id"))
    return cards.join(mapped.select(F.col("card_id").alias("id"), "note_key"), "id")


@query("docs_state", "SELECT d.doc_key, CASE WHEN doc_id % 4 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'stale' WHEN doc_id % 5 = 0 THEN 'waiting' ELSE 'ready' END AS status FROM v_corpus d")
def docs_state(s):
    c = s.v_corpus
    known = c.where("doc_id % 4 != 0").select("doc_key", F.when(F.col("doc_id") % 7 == 0, "other").otherwise(F.col("hash")).alias("hash"))
    return lib.with_state(c, known, c.where("doc_id % 5 = 0"))


@query("note_transitions", "WITH a AS (SELECT id, CASE doc_id % 3 WHEN 0 THEN 'trash' WHEN 1 THEN 'restore' ELSE 'delete' END AS action, coalesce(state, 'active') AS was FROM v_notes LEFT JOIN v_unavailable ON card_id = id), k AS (SELECT *, (action = 'trash' AND was = 'active') OR (action <> 'trash' AND was = 'trashed') AS ok FROM a) SELECT id, action, CASE WHEN NOT ok THEN was WHEN action = 'trash' THEN 'trashed' WHEN action = 'restore' THEN 'active' ELSE 'deleted' END AS state, CASE WHEN ok THEN 'done' ELSE 'refused' END AS outcome FROM k")
def note_transitions(s):
    action = F.when(F.col("doc_id") % 3 == 0, "trash").when(F.col("doc_id") % 3 == 1, "restore").otherwise("delete")
    return lib.transitions(s.v_unavailable.select(F.col("card_id").alias("id"), "state"), s.v_notes.select("id", action.alias("action")))


@query("free_ids", """WITH RECURSIVE w AS (SELECT doc_id AS id, doc_id // 3 * 5 AS second, row_number() OVER (ORDER BY doc_id // 3 * 5, doc_id) AS n FROM documents), t AS (SELECT DISTINCT user_id AS second FROM events),
  f AS (SELECT s, row_number() OVER (ORDER BY s) AS k FROM (SELECT unnest(range((SELECT max(second) + count(*) + 1 FROM w) + (SELECT count(*) FROM t))) AS s) WHERE s NOT IN (SELECT second FROM t)),
  q AS (SELECT id, n, (SELECT min(k) FROM f WHERE s >= second) AS k FROM w), g AS (SELECT id, max(k - n) OVER (ORDER BY n) + n AS k FROM q) SELECT id, s AS second FROM g JOIN f USING (k)""")
def free_ids(s):
    wanted = s.documents.select(F.col("doc_id").alias("id"), F.expr("doc_id div 3 * 5").alias("second"))
    return lib.free_seconds(wanted, s.events.select(F.col("user_id").alias("second")))


@query("fresh_embeddings", f"WITH {VECTORS} SELECT vec_id AS key, round(sqrt(list_dot_product(v, v)), 5) AS norm FROM embeddings JOIN v ON key = vec_id JOIN documents ON doc_id = vec_id WHERE vec_id % 7 <> 0")
def fresh_embeddings(s):
    rows = s.embeddings.join(s.documents, F.col("vec_id") == F.col("doc_id")).select(F.col("vec_id").alias("key"), F.when(F.col("vec_id") % 7 == 0, "old").otherwise(F.md5(F.col("text").cast("binary"))).alias("hash"), F.col("embedding").alias("vector"))
    now = s.documents.select(F.col("doc_id").alias("key"), F.md5(F.col("text").cast("binary")).alias("hash"))
    return d.fresh(rows, now).select("key", F.round(d.norm("vector"), 5).alias("norm"))


@query("weak_flags", f"WITH {MODEL}, b AS (SELECT doc_key, count(DISTINCT feature) AS n FROM c GROUP BY doc_key) SELECT doc_key, trim(body) = '' OR coalesce(n, 0) < 25 AS weak FROM v_corpus LEFT JOIN b USING (doc_key)")
def weak_flags(s):
    return x.weak_flags(s.v_corpus, x.counts_by_document(s.v_corpus))


@query("resolved_rows", "WITH f AS (SELECT s.doc_key AS query, t.doc_key, l.doc_id % 10 / 10.0::DOUBLE AS score, t.title, t.doc_id FROM v_link_rows l JOIN v_corpus s ON s.doc_id = l.doc_id JOIN v_corpus t ON t.doc_id = l.target) SELECT query, doc_key, title, score FROM f WHERE doc_id % 9 <> 1 AND doc_id % 8 <> 3 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def resolved_rows(s):
    c = s.v_corpus.select("doc_id", "doc_key", "title")
    found = s.v_link_rows.join(c.select("doc_id", F.col("doc_key").alias("query")), "doc_id").join(c.select(F.col("doc_id").alias("target"), "doc_key"), "target").select("query", "doc_key", (F.col("doc_id") % 10 / 10.0).alias("score"))
    of = c.select("doc_key", "title", F.when(F.col("doc_id") % 9 == 1, "feed").otherwise("item").alias("kind"), F.when(F.col("doc_id") % 8 == 3, F.lit("x")).alias("parent"))
    return lib.resolved(found, of, s.labels.where("toxic = 1").join(c, "doc_id").select("doc_key").distinct())


@query("link_targets", """WITH k AS (SELECT id AS ref, id AS target, 1 AS p FROM v_notes UNION ALL SELECT concat('note/', id), id, 2 FROM v_notes UNION ALL SELECT lower(note_key), card_id, 3 FROM v_card_notes UNION ALL SELECT title_folded, min(id), 4 FROM v_notes WHERE title_folded <> '' GROUP BY title_folded HAVING count(DISTINCT id) = 1
  UNION ALL SELECT lower(custom_key), id, 5 FROM v_notes WHERE custom_key IS NOT NULL) SELECT ref, arg_min(target, p) AS target, min(p) AS priority FROM k GROUP BY ref""")
def link_targets(s):
    return r.link_targets(s.v_notes, s.v_card_notes, s.v_notes.where("custom_key is not null").select(F.col("custom_key").alias("ref"), "id"))


@query("forward_links", "WITH t AS (SELECT concat('missing ', CAST(doc_id % 20 AS VARCHAR)) AS ref, id FROM v_notes WHERE doc_id = doc_id % 20), u AS (SELECT ref, min(id) AS id FROM t GROUP BY ref HAVING count(*) = 1) SELECT source_id, l.ref, u.id AS target_id FROM v_links l JOIN u ON u.ref = l.ref WHERE target_id IS NULL")
def forward_links(s):
    """One new note for each name that was missing."""
    new = s.v_notes.where("doc_id = doc_id % 20").withColumn("title", F.concat(F.lit("Missing "), (F.col("doc_id") % 20).cast("string"))).withColumn("title_folded", F.lower("title"))
    return r.forward_links(s.v_links, new, s.v_card_notes.limit(0))


@query("search_by_reference", "SELECT id FROM v_notes WHERE (title_folded LIKE '%src1x%' OR lower(body) LIKE '%src1x%' OR lower(id) LIKE '%src1x%' OR lower(coalesce(custom_key, '')) LIKE '%src1x%' OR lower(concat(item_key, 'x2024')) LIKE '%src1x%')")
def search_by_reference(s):
    known = s.v_notes.where("item_key is not null").select("item_key", F.concat("item_key", F.lit("X2024")).alias("reference")).distinct()
    return n.search(s.v_notes, "src1x", references=known).select("id")


@query("notes_by_id", "SELECT id, title FROM v_notes WHERE id IN (SELECT target_id FROM v_links)")
def notes_by_id(s):
    return n.lookup(s.v_notes, "id", s.v_links.select(F.col("target_id").alias("id"))).select("id", "title")


@query("parents_of_targets", "SELECT DISTINCT source_id, parent_id FROM v_links JOIN v_parents ON card_id = target_id WHERE parent_id IS NOT NULL AND parent_id <> source_id")
def parents_of_targets(s):
    return n.parents_of_targets(s.v_links, s.v_parents)


@query("parent_rows", """WITH a AS (SELECT id, title FROM v_notes WHERE id NOT IN (SELECT card_id FROM v_unavailable)), k AS (SELECT parent_id, count(*) AS children FROM v_parents JOIN a ON id = card_id WHERE parent_id IS NOT NULL GROUP BY parent_id)
  SELECT a.id, p.id AS parent_id, p.title AS parent_title, coalesce(children, 0) AS children FROM a LEFT JOIN v_parents ON card_id = a.id LEFT JOIN a p ON p.id = v_parents.parent_id LEFT JOIN k ON k.parent_id = a.id""")
def parent_rows(s):
    return n.parent_rows(s.v_notes, s.v_parents, s.v_unavailable)


@query("dirty_queue", """WITH e AS (SELECT user_id AS card_id, CASE event_type WHEN 'purchase' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op, CASE WHEN event_type = 'click' THEN 'title' WHEN event_type = 'view' THEN 'color' END AS field, event_id FROM events), l AS (SELECT card_id, arg_max(op, event_id) AS op FROM e GROUP BY card_id)
  SELECT DISTINCT e.card_id FROM e JOIN l USING (card_id) WHERE l.op <> 'delete' AND (e.op = 'insert' OR field IN ('title', 'body', 'custom_key'))""")
def dirty_queue(s):
    return u.dirty(card_changes(s))[0]


def card_changes(s):
    op = F.when(F.col("event_type") == "purchase", "insert").when(F.col("event_type") == "error", "delete").otherwise("update")
    return s.events.select(F.col("user_id").alias("card_id"), op.alias("op"), F.when(F.col("event_type") == "click", "title").when(F.col("event_type") == "view", "color").alias("field"), F.col("event_id").alias("at"))


@query("purged_cards", "SELECT card_id FROM (SELECT user_id AS card_id, arg_max(event_type, event_id) AS last FROM events GROUP BY user_id) WHERE last = 'error'")
def purged_cards(s):
    return u.dirty(card_changes(s))[1]


@query("dirty_batch", "SELECT id, title FROM v_notes WHERE id IN (SELECT source_id FROM v_links) ORDER BY id LIMIT 50")
def dirty_batch(s):
    return u.next_batch(s.v_links.select(F.col("source_id").alias("id")), s.v_notes).select("id", "title")


@query("similarity_upsert", "WITH o AS (SELECT doc_key, hash FROM v_corpus WHERE doc_id % 11 <> 0), n AS (SELECT doc_key, concat(hash, '+') AS hash FROM v_corpus WHERE doc_id % 5 = 0) SELECT doc_key, hash FROM o WHERE doc_key NOT IN (SELECT doc_key FROM n) AND doc_key NOT IN (SELECT doc_key FROM v_corpus WHERE doc_id % 13 = 1) UNION ALL SELECT * FROM n WHERE doc_key NOT IN (SELECT doc_key FROM v_corpus WHERE doc_id % 13 = 1)")
def similarity_upsert(s):
    c = s.v_corpus.select("doc_id", "doc_key", "hash")
    return u.upserted(c.where("doc_id % 11 != 0").drop("doc_id"), c.where("doc_id % 5 = 0").select("doc_key", F.concat("hash", F.lit("+")).alias("hash")), c.where("doc_id % 13 = 1").select("doc_key"), "doc_key")


@query("quarantined", "SELECT event_id AS key, CASE WHEN event_id % 7 = 0 THEN 'payload' ELSE 'value' END AS reason FROM events WHERE event_id % 7 = 0 OR value < 0 OR event_id % 11 = 0")
def quarantined(s):
    rows = s.events.select(F.col("event_id").alias("key"), F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 3)).otherwise(F.col("props")).alias("payload"), F.when(F.col("event_id") % 11 == 0, "x").otherwise(F.col("value").cast("string")).alias("value"))
    return u.quarantined(rows)[1].select("key", "reason")


@query("title_page", "SELECT id, place FROM (SELECT id, row_number() OVER (ORDER BY title, id) AS place FROM v_notes WHERE (title_folded LIKE '%er%' OR lower(body) LIKE '%er%' OR lower(id) LIKE '%er%' OR lower(coalesce(custom_key, '')) LIKE '%er%') AND title_folded LIKE '%er%') WHERE place <= 30")
def title_page(s):
    """Search's own order of a page by title, which scores don't change."""
    from ..operators import discovery as disc

    found = n.page(n.search(s.v_notes, "er"), "title-asc", 30)
    return disc.in_search_order(found, s.v_notes.select(F.col("id").alias("card_id"), F.lit(1.0).alias("score")), "title-asc").select("id", F.col("place").cast("long").alias("place"))


@query("inherited_item_tags", "SELECT c_custkey AS id, tag, min(depth) AS depth FROM (SELECT c_custkey, c_mktsegment AS tag, 0 AS depth FROM customer UNION ALL SELECT c_custkey, n_name, 1 FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT c_custkey, r_name, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey) GROUP BY ALL")
def inherited_item_tags(s):
    from ..operators import graph as g

    item = lambda kind, key: F.concat(F.lit(kind), F.lpad(F.col(key).cast("string"), 12, "0"))
    up = s.customer.select(item("c", "c_custkey").alias("card_id"), item("n", "c_nationkey").alias("parent_id")).union(s.nation.select(item("n", "n_nationkey"), item("r", "n_regionkey")))
    tags = s.customer.select(item("c", "c_custkey").alias("card_id"), F.col("c_mktsegment").alias("tag")).union(s.nation.select(item("n", "n_nationkey"), "n_name")).union(s.region.select(item("r", "r_regionkey"), "r_name"))
    ids = up.select(F.col("card_id").alias("id")).union(s.region.select(item("r", "r_regionkey")))
    found = g.inherited_tags(up, tags, ids).where("startswith(id, 'c')")
    return found.select(F.substring("id", 2, 12).cast("long").alias("id"), "tag", "depth")
