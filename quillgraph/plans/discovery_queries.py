"""Candidates to link with, groups, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import DISCOVERY_STOP_WORDS
from ..operators import discovery as d
from ..operators import notes as n
from ..sources.scratch import materialize
from .registry import query

#: A note's searched text, and its pairs of characters.
TEXTS = "tx AS (SELECT id, doc_id, title, body, lower(concat_ws(chr(10), title, body, id, custom_key)) AS text FROM v_notes)"
GRAMS = f"{TEXTS}, g AS (SELECT DISTINCT id AS card_id, unnest(list_transform(range(1, length(text)), lambda i: substring(text, i, 2))) AS term FROM tx)"
WORDS = """SELECT DISTINCT id, w, unnest(CASE WHEN regexp_matches(x, '^\\p{Han}') THEN list_transform(range(1, length(x)), lambda i: substring(x, i, 2)) ELSE [x] END) AS term
    FROM (SELECT id, w, unnest(regexp_extract_all(regexp_replace(lower(t), '(?s)```.*?```|https?://\\S+|<[^>]*>|\\[\\[[^\\]]*\\]\\]', ' ', 'g'), '\\p{Han}+|(?:\\p{N}|\\p{Latin}|\\p{M}){3,}')) AS x FROM parts)"""
KEYS = f"""parts AS (SELECT id, 3 AS w, title AS t FROM tx WHERE doc_id % 100 = 0 UNION ALL SELECT id, 1, substring(body, 1, 12000) FROM tx WHERE doc_id % 100 = 0),
  kt AS (SELECT id AS query, term FROM (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY sum(w) DESC, term) AS place FROM ({WORDS}) WHERE length(term) <= 64 AND term NOT IN ({', '.join(f"'{w}'" for w in DISCOVERY_STOP_WORDS)}) GROUP BY id, term) WHERE place <= 16),
  q AS (SELECT DISTINCT query, unnest(list_transform(range(1, length(term)), lambda i: substring(term, i, 2))) AS term FROM kt)"""


def index(s):
    """Pairs of characters of everything that is searched: title, body, id and key."""
    return d.grams_by_note(s.v_notes.select("id", F.concat_ws("\n", "title", "body", "id", "custom_key").alias("body")))


def asked(s):
    return s.v_notes.where("doc_id % 100 = 0")


def asked_grams(s):
    """Pairs of characters of the asked notes' heaviest words."""
    return d.key_terms(asked(s)).select("query", F.explode(n.bigrams("term")).alias("term")).distinct()


@query("gram_idf_candidates", f"""WITH {GRAMS}, {KEYS}, f AS (SELECT term, count(*) AS n FROM g GROUP BY term)
  SELECT query, card_id, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(weight, 9) DESC, card_id) AS place FROM (SELECT query, g.card_id, sum(1.0::DOUBLE / n) AS weight FROM q JOIN f USING (term) JOIN g USING (term) WHERE g.card_id <> query GROUP BY ALL)) WHERE place <= 100""")
def gram_idf_candidates(s):
    return d.gram_candidates(index(s), asked_grams(s)).select("query", "card_id", F.round("weight", 6).alias("weight"))


def candidates_sql(excluded: str, bonus: str) -> str:
    return f"""WITH RECURSIVE {GRAMS}, {KEYS.replace("SELECT id AS query, term FROM (SELECT id, term, row_number()", "SELECT id AS query, term, weight FROM (SELECT id, term, sum(w) AS weight, row_number()")}, ex AS ({excluded}), ask AS (SELECT id AS query FROM tx WHERE doc_id % 100 = 0),
  ok AS (SELECT query, v_notes.id AS card_id FROM ask, v_notes WHERE v_notes.id NOT IN (SELECT card_id FROM v_unavailable) AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.query = ask.query AND ex.card_id = v_notes.id)),
  nb AS (SELECT source_id AS query, target_id AS card_id FROM v_links WHERE target_id IS NOT NULL UNION SELECT target_id, source_id FROM v_links WHERE target_id IS NOT NULL UNION SELECT card_id, parent_id FROM v_parents WHERE parent_id IS NOT NULL UNION SELECT l.source_id, p.parent_id FROM v_links l JOIN v_parents p ON p.card_id = l.target_id WHERE p.parent_id IS NOT NULL),
  nr AS (SELECT * FROM (SELECT query, card_id, 0 AS kind, row_number() OVER (PARTITION BY query ORDER BY card_id) AS k FROM nb JOIN ok USING (query, card_id)) WHERE k <= 30),
  f AS (SELECT term, count(*) AS n FROM g GROUP BY term), gs AS (SELECT q.query, g.card_id, sum(1.0::DOUBLE / n) AS weight FROM q JOIN f USING (term) JOIN g USING (term) GROUP BY ALL),
  gr AS (SELECT * FROM (SELECT query, card_id, 1 AS kind, row_number() OVER (PARTITION BY query ORDER BY round(weight, 9) DESC, card_id) AS k FROM gs JOIN ok USING (query, card_id)) WHERE k <= 100),
  ot AS (SELECT * FROM nr UNION ALL SELECT * FROM gr), tg AS (SELECT DISTINCT card_id, tag FROM v_tags), ow AS (SELECT * FROM (SELECT card_id AS query, tag, row_number() OVER (PARTITION BY card_id ORDER BY tag) AS nth FROM tg WHERE card_id IN (SELECT query FROM ask)) WHERE nth <= 6),
  t0 AS (SELECT ow.query, tg.card_id, count(*) AS n, min(nth) AS nth FROM ow JOIN tg USING (tag) JOIN ok ON ok.query = ow.query AND ok.card_id = tg.card_id GROUP BY ow.query, tg.card_id),
  t1 AS (SELECT query, card_id, n, row_number() OVER (PARTITION BY query ORDER BY nth, card_id) AS k FROM t0), t2 AS (SELECT * FROM t1 WHERE k <= 80 OR EXISTS (SELECT 1 FROM ot WHERE ot.query = t1.query AND ot.card_id = t1.card_id)),
  al AS (SELECT query, card_id, min(kind * 1000000 + k) AS o FROM (SELECT * FROM ot UNION ALL SELECT query, card_id, 2, k FROM t2) GROUP BY ALL), sd AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY o) AS place FROM al),
  fd AS (SELECT sd.query, sd.card_id, CASE WHEN o < 1000000 THEN 1 ELSE 0 END AS related, coalesce(n, 0) AS tag_matches, title, title_folded, lower(body) AS text FROM sd JOIN v_notes ON v_notes.id = sd.card_id LEFT JOIN t2 ON t2.query = sd.query AND t2.card_id = sd.card_id WHERE place <= 180),
  hi AS (SELECT * FROM (SELECT fd.query, card_id, term, weight, CAST(contains(title_folded, term) AS INT) AS t, CAST(contains(text, term) AS INT) AS b FROM fd JOIN kt USING (query)) WHERE t + b > 0), fq AS (SELECT query, term, count(*) AS n FROM hi GROUP BY ALL),
  co AS (SELECT query, card_id, sum((3 * t + b) * weight / sqrt(n)) AS content FROM hi JOIN fq USING (query, term) GROUP BY ALL),
  sc AS (SELECT fd.query, fd.card_id, title, coalesce(content, 0) + 2 * least(tag_matches, 3) + 2 * related + {bonus} AS score FROM fd LEFT JOIN co USING (query, card_id))
  SELECT query, card_id, round(score, 6) AS score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, title, card_id) AS INT) AS place FROM sc WHERE score > 0 OR query NOT IN (SELECT query FROM kt)) WHERE place <= 12"""


def paragraphs(s):
    """What is being written in every second asked note."""
    return s.v_notes.where("doc_id % 200 = 0").select("id", F.concat(F.lit("growing "), "title").alias("paragraph"))


def proposed(s, excluded, parents=None):
    terms = materialize(d.key_terms(asked(s), paragraphs=paragraphs(s)))
    grams = terms.select("query", F.explode(n.bigrams("term")).alias("term")).distinct()
    found = d.seeds(asked(s), s.v_links, s.v_parents, s.v_tags, index(s), grams, s.v_unavailable.select("card_id"), excluded)
    return d.ranked(found, s.v_notes, terms, parents=parents).select("query", "card_id", F.round("score", 6).alias("score"), "place")


@query("note_candidates", candidates_sql("SELECT id AS query, id AS card_id FROM tx", "0").replace("FROM tx WHERE doc_id % 100 = 0),", "FROM tx WHERE doc_id % 100 = 0 UNION ALL SELECT id, 5, 'growing ' || title FROM tx WHERE doc_id % 200 = 0),", 1))
def note_candidates(s):
    return proposed(s, d.exclusions(asked(s)))


@query("parent_candidates", candidates_sql("SELECT id AS query, id AS card_id FROM tx WHERE doc_id % 100 = 0 UNION SELECT ex.query, p.card_id FROM ex JOIN v_parents p ON p.parent_id = ex.card_id", "CASE WHEN content > 0 AND fd.card_id IN (SELECT parent_id FROM v_parents WHERE parent_id IS NOT NULL) THEN 2 ELSE 0 END").replace("FROM tx WHERE doc_id % 100 = 0),", "FROM tx WHERE doc_id % 100 = 0 UNION ALL SELECT id, 5, 'growing ' || title FROM tx WHERE doc_id % 200 = 0),", 1))
def parent_candidates(s):
    """Without the asked notes themselves and what is below them."""
    return proposed(s, d.exclusions(asked(s), s.v_parents), s.v_parents)


@query("graph_group")
def graph_group(s):
    return d.graph_groups(s.v_notes, s.v_tags, ["q0", "q1"])


@query("palette", "SELECT DISTINCT tag, CAST(list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(lower(tag), ''), lambda c: unicode(c)::HUGEINT)), lambda h, c: (xor(h::BIGINT, c::BIGINT)::HUGEINT * 16777619) % 4294967296) % 10 AS INT) AS place FROM v_tags")
def palette(s):
    return s.v_tags.select("tag").distinct().select("tag", d.palette_place("tag").alias("place"))


@query("match_evidence")
def match_evidence(s):
    texts = s.v_notes.select(F.col("id").alias("doc_key"), F.col("body").alias("text"))
    pairs = s.v_links.where("target_id is not null").select(F.col("source_id").alias("query"), F.col("target_id").alias("doc_key")).distinct()
    return d.evidence(pairs, texts)


@query("highlight_counts", "SELECT DISTINCT concat('A', doc_id % 60) AS annotation_key, (SELECT count(*) FROM v_notes z WHERE z.annotation_key = concat('A', d.doc_id % 60)) AS notes FROM documents d")
def highlight_counts(s):
    marks = s.documents.select(F.concat(F.lit("A"), (F.col("doc_id") % 60).cast("string")).alias("annotation_key")).distinct()
    return d.highlight_counts(marks, s.v_notes)


@query("cards_from_annotations", "SELECT DISTINCT concat('A', doc_id % 60) AS annotation_key FROM documents WHERE concat('A', doc_id % 60) NOT IN (SELECT annotation_key FROM v_notes WHERE annotation_key IS NOT NULL)")
def cards_from_annotations(s):
    marks = s.documents.select(F.concat(F.lit("A"), (F.col("doc_id") % 60).cast("string")).alias("annotation_key"))
    return d.cards_from(marks, s.v_notes)


@query("label_changes", "SELECT DISTINCT source_id FROM v_links JOIN v_notes ON id = target_id WHERE doc_id % 17 = 2 AND title <> ''")
def label_changes(s):
    now = s.v_notes.select("id", F.coalesce("custom_key", "id").alias("reference"), F.col("title").alias("label"))
    before = s.v_notes.select("id", F.coalesce("custom_key", "id").alias("reference"), F.when(F.col("doc_id") % 17 == 2, F.lit("")).otherwise(F.col("title")).alias("label"))
    return d.label_changes(now, before, s.v_links)


@query("draft_links", "WITH l AS (SELECT DISTINCT id, trim(split_part(x, '|', 1)) AS ref FROM (SELECT id, unnest(regexp_extract_all(text, '\\[\\[([^\\[\\]]+)\\]\\]', 1)) AS x FROM v_linktext)), t AS (SELECT title, min(id) AS tid FROM v_notes GROUP BY title HAVING count(*) = 1) SELECT l.id, l.ref, coalesce(z.id, t.tid) AS target FROM l LEFT JOIN v_notes z ON z.id = l.ref LEFT JOIN t ON t.title = l.ref")
def draft_links(s):
    from ..functions.markup import links
    from ..operators.refs import resolve

    found = materialize(s.v_linktext.select("id", F.explode(links("text")).alias("l")).select("id", F.col("l.ref").alias("ref")))  # a text is searched once
    known = resolve(found.select("ref").distinct(), s.v_notes, s.v_card_notes).select("ref", "target")
    return found.join(known, "ref", "left").select("id", "ref", "target")


@query("pending_tags", "SELECT card_id, tag FROM v_tags UNION SELECT id, 'new' FROM v_notes WHERE doc_id % 10 = 1 AND doc_id % 8 <> 7")
def pending_tags(s):
    pending = s.v_notes.where("doc_id % 10 = 1").select(F.col("id").alias("card_id"), F.lit("new").alias("tag"))
    return d.pending_applied(s.v_tags, pending, s.v_card_notes)[0]
