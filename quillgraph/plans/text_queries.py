"""Words, links, snippets, HTML and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup as m
from ..functions import text as t
from ..sources.scratch import materialize
from .registry import query

joined = lambda c: F.array_join(c, "|")


@query("char_bigrams", "SELECT library, count(DISTINCT g) AS bigrams FROM (SELECT library, unnest(list_transform(range(1, length(body)), lambda i: substring(lower(body), i, 2))) AS g FROM v_notes) GROUP BY library")
def char_bigrams(s):
    from ..operators.notes import bigrams

    return s.v_notes.select("library", F.explode(bigrams("body")).alias("g")).groupBy("library").agg(F.countDistinct("g").alias("bigrams"))


@query("tokens")
def tokens(s):
    return s.v_notes.select("id", F.explode(t.tokens_of("body")).alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))


@query("features")
def features(s):
    counted = t.clean(s.v_corpus.select("doc_key", "body"), "body", "body").select("doc_key", "body").mapInArrow(t.count_features, "doc_key string, feature string, tf long")
    # a document's features are counted where its text is; only rows that share a key are added up
    shared = materialize(s.v_corpus.groupBy("doc_key").agg(F.count("*").alias("n")).where("n > 1").select("doc_key"))
    if shared.isEmpty():
        return counted
    same = F.col("doc_key").eqNullSafe(F.col("shared"))
    shared = shared.withColumnRenamed("doc_key", "shared")
    added = counted.join(shared, same, "left_semi").groupBy("doc_key", "feature").agg(F.sum("tf").alias("tf"))
    return counted.join(shared, same, "left_anti").union(added)


@query("stem")
def stem(s):
    words = s.documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", t.stem_of("word").alias("stem"))


@query("clean_text")
def clean_text(s):
    return t.clean(s.v_linktext.select("id", "text"), "text", "text")


@query("discovery_terms", """WITH c AS (SELECT id, regexp_replace(lower(text), '(?s)```.*?```|https?://\\S+|<[^>]*>|\\[\\[[^\\]]*\\]\\]', ' ', 'g') AS t FROM v_linktext), w AS (SELECT id, unnest(regexp_extract_all(t, '\\p{Han}+|(?:\\p{N}|\\p{Latin}|\\p{M}){3,}')) AS w FROM c),
  p AS (SELECT id, CASE WHEN regexp_matches(w, '^\\p{Han}') THEN list_transform(range(1, length(w)), lambda i: substring(w, i, 2)) ELSE [w] END AS l FROM w), x AS (SELECT DISTINCT id, unnest(l) AS term FROM p)
  SELECT id, term FROM x WHERE length(term) <= 64 AND term NOT IN (""" + ", ".join(f"'{w}'" for w in t.DISCOVERY_STOP_WORDS) + ")")
def discovery_terms(s):
    return s.v_linktext.select("id", F.explode(t.discovery_terms("text")).alias("term"))


@query("links", "SELECT id, trim(split_part(x, '|', 1)) AS ref, trim(split_part(x, '|', 2)) AS alias FROM (SELECT id, unnest(regexp_extract_all(text, '\\[\\[([^\\[\\]]+)\\]\\]', 1)) AS x FROM v_linktext)")
def links(s):
    return s.v_linktext.select("id", F.explode(m.links("text")).alias("l")).select("id", "l.ref", "l.alias")


@query("citation_keys", "SELECT id, array_to_string(list_distinct(regexp_extract_all(text, '\\[@([^\\[\\]\\s]+)\\]', 1)), '|') AS keys FROM v_linktext")
def citation_keys(s):
    return s.v_linktext.select("id", joined(m.citation_keys("text")).alias("keys"))


@query("asset_refs", "SELECT page_id, count(*) AS refs FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?:href|src)=\"([^\"]+)\"', 1)) AS ref FROM pages) GROUP BY page_id")
def asset_refs(s):
    refs = F.array_distinct(F.regexp_extract_all("html", F.lit('(?:href|src)="([^"]+)"'), F.lit(1)))
    return s.pages.select("page_id", F.explode(refs).alias("ref")).groupBy("page_id").agg(F.count("*").alias("refs"))


@query("snippet", """WITH p AS (SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\[\\[([^\\[\\]|]+\\|)?([^\\[\\]]+)\\]\\]', '\\2', 'g'), '!?\\[([^\\[\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '(?m)^\\s{0,3}(?:#{1,6}|>|[-*+])\\s+', '', 'g'), '[*`~]+', '', 'g'), '\\s+', ' ', 'g')) AS x FROM v_linktext),
  a AS (SELECT id, x, greatest(1, CASE WHEN strpos(lower(x), 'also') > 0 THEN strpos(lower(x), 'also') ELSE 1 END - 30) AS start FROM p)
  SELECT id, concat(CASE WHEN start > 1 THEN '…' ELSE '' END, substring(x, start, 110), CASE WHEN length(x) >= start + 110 THEN '…' ELSE '' END) AS snippet FROM a""")
def snippet(s):
    return s.v_linktext.select("id", m.snippet("text", ["also"]).alias("snippet"))


@query("highlight_cards", """SELECT item_id, concat(regexp_replace(regexp_replace(text, '([\\\\`*_\\[\\]<>])', '\\\\\\1', 'g'), '(?m)^', '> ', 'g'), chr(10), chr(10), CASE WHEN length(split_part(text, '.', 1)) > 60 THEN concat(substring(split_part(text, '.', 1), 1, 60), '…') ELSE split_part(text, '.', 1) END, ', p. ', item_id) AS card FROM benchmark""")
def highlight_cards(s):
    return s.benchmark.select("item_id", m.citation_block("text", F.split_part("text", F.lit("."), F.lit(1)), F.col("item_id").cast("string")).alias("card"))


@query("source_lines", "SELECT doc_id, concat(CASE WHEN source IS NULL THEN '' ELSE concat(source, ' ', 2000 + doc_id % 26, '. ') END, '<i>', replace(replace(replace(split_part(text, chr(10), 1), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '</i>. ', lang, '.') AS line FROM documents WHERE text IS NOT NULL")
def source_lines(s):
    return s.documents.where("text is not null").select("doc_id", m.source_line("source", (2000 + F.col("doc_id") % 26).cast("string"), F.split_part("text", F.lit("\n"), F.lit(1)), "lang").alias("line"))


@query("math_spans")
def math_spans(s):
    text = F.concat(F.coalesce("body", F.lit("")), F.lit(r" has $x_{"), F.col("doc_id"), F.lit(r"}$ and \[y^2\]"))
    return s.v_notes.select("id", text.alias("text")).lateralJoin(m.MathSpans(F.col("text").outer())).select("id", "start", "end", "latex", "display")


@query("markdown_links")
def markdown_links(s):
    """Links, images and references beside [[..]], over whole texts."""
    from ..functions.links import markdown_links as found

    more = F.concat(F.lit("\n\nsee [the [long] paper](https://example.org/"), F.col("doc_id").cast("string"), F.lit(' "Its title"), ![plot](assets/p.png), [more][r] and `[code](x)`\n\n[r]: https://example.org/r'))
    rows = s.v_linktext.select("id", F.explode(found(F.concat("text", more))).alias("l"))
    return rows.select("id", "l.*")


@query("html_to_md")
def html_to_md(s):
    return s.pages.select("page_id", m.markdown_of("html").alias("markdown"))


@query("merge3")
def merge3(s):
    lines = F.split("text", "\n")
    edit = lambda at, mark: F.array_join(F.transform(lines, lambda x, i: F.when(i == at, F.concat(x, F.lit(mark))).otherwise(x)), "\n")
    return s.documents.select("doc_id", m.merge3_of("text", edit(F.col("doc_id") % 3, " ours"), edit(F.lit(4), " theirs")).alias("merged"))


@query("outline_export", "SELECT concat('- {\"id\":\"', id, '\",\"type\":\"', note_type, '\",\"updated\":', updated_at, '}') AS line FROM v_notes")
def outline_export(s):
    return s.v_notes.select(F.concat(F.lit("- "), F.to_json(F.struct("id", F.col("note_type").alias("type"), F.col("updated_at").alias("updated")))).alias("line"))


@query("timestamp_ids", "SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS id FROM events")
def timestamp_ids(s):
    return s.events.select("event_id", F.date_format("ts", "yyyyMMddHHmmss").alias("id"))


@query("label_refresh", """SELECT l.id, replace(l.text, concat('[[note ', l.doc_id % 13, ']]'), concat('[[', n.id, '|', n.title, ']]')) AS text FROM v_linktext l JOIN v_notes n ON n.doc_id = l.doc_id % 13""")
def label_refresh(s):
    """Links [[note k]] written with the id and the title of the note they mean."""
    names = s.v_notes.where("doc_id = doc_id % 13").select(F.concat(F.lit("note "), F.col("doc_id").cast("string")).alias("ref"), F.struct(F.col("id").alias("reference"), F.col("title").alias("label"), F.lit("").alias("old")).alias("now"))
    found = s.v_linktext.select("id", F.explode(m.links("text")).alias("l")).select("id", "l.ref").join(names, "ref").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("ref", "now"))).alias("labels"))
    return s.v_linktext.join(found, "id").select("id", m.refreshed("text", "labels").alias("text"))


@query("asset_names", "SELECT id, concat('img', doc_id % 7, '.png') AS name FROM v_linktext UNION ALL SELECT id, concat('b', doc_id % 3, '.pdf') FROM v_linktext")
def asset_names(s):
    """In an image, a link and an attribute, one of them twice."""
    k = lambda m: (F.col("doc_id") % m).cast("string")
    text = F.concat("text", F.lit(" ![x](assets/img"), k(7), F.lit(".png) [f](assets/b"), k(3), F.lit(".pdf) <img src=\"assets/img"), k(7), F.lit(".png\"> [no](other/c.png)"))
    return s.v_linktext.select("id", F.explode(m.asset_names(text)).alias("name"))


@query("link_contexts", """SELECT DISTINCT id, p AS context FROM (SELECT id, unnest(regexp_split_to_array(text, '\\n\\s*\\n')) AS p, concat('[[note ', doc_id % 13, ']]') AS ref FROM v_linktext) WHERE contains(p, ref)""")
def link_contexts(s):
    rows = s.v_linktext.select("id", "text", F.concat(F.lit("[[note "), (F.col("doc_id") % 13).cast("string"), F.lit("]]")).alias("ref"))
    return rows.select("id", F.explode(m.contexts("text", "ref")).alias("context"))
