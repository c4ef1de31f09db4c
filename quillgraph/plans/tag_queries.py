"""Tags of notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tagging as t
from ..operators import cells, suggest
from ..operators import dense as d
from ..operators import lexical as x
from ..operators import tags as g
from ..sources.scratch import materialize
from .registry import query
from .retrieval_queries import COUNTS

RULES = t.Exclusions.of("src1*, q0")
#: A tag's key, for ASCII names.
KEY = "lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({0}), '^#+\\s*', ''), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([0-9])([A-Z][a-z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[\\s_-]+', ' ', 'g')))"
VISIBLE = "NOT regexp_matches(tag, '^src1') AND tag <> 'q0'"


def neighbours(s):
    """Notes linked from a note, with a score made from their place."""
    return s.v_links.where("target_id is not null").select(F.col("source_id").alias("query"), F.col("target_id").alias("card_id"), (F.pmod(F.col("target_id").cast("long") * 31, F.lit(100)) / 100).alias("score"))


@query("tag_key", f"SELECT DISTINCT name, {KEY.format('name')} AS key FROM v_tag_names")
def tag_key(s):
    return s.v_tag_names.select("name", t.key_of("name").alias("key"))


@query("tag_catalog", "SELECT DISTINCT tag FROM v_tags")
def tag_catalog(s):
    return g.catalogue(s.v_tags)


@query("visible_tags", f"SELECT DISTINCT tag FROM v_tags WHERE {VISIBLE}")
def visible_tags(s):
    return g.catalogue(s.v_tags, RULES)


@query("tag_index", "SELECT tag, string_agg(DISTINCT card_id, ',' ORDER BY card_id) AS ids FROM v_tags GROUP BY tag")
def tag_index(s):
    return g.inverted(s.v_tags).select("tag", F.array_join("ids", ",").alias("ids"))


@query("tag_usage", "SELECT tag, count(DISTINCT item) AS items FROM v_usage GROUP BY tag")
def tag_usage(s):
    return g.usage(s.v_usage, "item")


@query("tag_preview", "SELECT count(DISTINCT card_id) AS items FROM v_tags WHERE tag IN ('en', 'src2', 'q1')")
def tag_preview(s):
    return g.preview(s.v_tags, ["en", "src2", "q1"])


@query("tag_votes", """WITH n AS (SELECT source_id AS query, target_id AS card_id, max((CAST(target_id AS BIGINT) * 31 % 100) / 100.0::DOUBLE) AS score FROM v_links WHERE target_id IS NOT NULL GROUP BY ALL HAVING score > 0),
  k AS (SELECT card_id, trim(regexp_replace(lower(tag), '[\\s_-]+', ' ', 'g')) AS key, min(tag) AS tag FROM v_tags GROUP BY ALL HAVING key <> ''), v AS (SELECT query, key, arg_max(tag, row(score, card_id)) AS name, sum(score) AS score, count(*) AS count FROM n JOIN k USING (card_id) WHERE NOT EXISTS (SELECT 1 FROM k o WHERE o.card_id = query AND o.key = k.key) GROUP BY ALL)
  SELECT query, name, round(score, 6) AS score, count FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, count DESC, name) AS place FROM v) WHERE place <= 6""")
def tag_votes(s):
    return g.votes(s.v_tags, neighbours(s)).select("query", "name", F.round("score", 6).alias("score"), "count")


@query("tag_duplicate_pairs", f"""WITH k AS (SELECT name, {KEY.format('name')} AS key FROM v_tag_names), p AS (SELECT a.name AS a, b.name AS b, a.key AS ka, b.key AS kb FROM k a JOIN k b ON a.name < b.name),
  s AS (SELECT *, list_transform(string_split(ka, ' '), lambda w: CASE WHEN length(w) > 4 AND ends_with(w, 's') AND NOT regexp_matches(w, '(ss|us|is)$') THEN left(w, -1) ELSE w END) AS sa, list_transform(string_split(kb, ' '), lambda w: CASE WHEN length(w) > 4 AND ends_with(w, 's') AND NOT regexp_matches(w, '(ss|us|is)$') THEN left(w, -1) ELSE w END) AS sb FROM p)
  SELECT a, b, CASE WHEN ka = kb THEN 'name' ELSE 'plural' END AS reason FROM s WHERE ka = kb OR sa = sb""")
def tag_duplicate_pairs(s):
    return g.duplicate_pairs(s.v_tag_names)


@query("tag_duplicate_groups")
def tag_duplicate_groups(s):
    names = materialize(s.v_tag_names)
    return g.duplicate_groups(names, g.duplicate_pairs(names))


@query("merge_tags", "SELECT DISTINCT card_id, CASE WHEN tag IN ('en', 'de') THEN 'germanic' ELSE tag END AS tag FROM v_tags")
def merge_tags(s):
    return g.merged(s.v_tags, ["en", "de"], "germanic")


@query("remove_tags", "SELECT DISTINCT card_id, tag FROM v_tags WHERE tag NOT IN ('en', 'de')")
def remove_tags(s):
    return g.merged(s.v_tags, ["en", "de"], None)


FIRST = "regexp_extract(tag, '[\\p{L}\\p{M}\\p{N}]+(?:[''’][\\p{L}\\p{M}]+)?[+#]*')"
#: Sentence case of a tag that has no capitals but in words of mixed case: only its first word can change.
SENTENCE = f"CASE WHEN {FIRST} <> '' AND regexp_matches({FIRST}, '^[a-z]+(?:[''’][a-z]+)?$') AND (length({FIRST}) > 1 OR {FIRST} = 'a') THEN concat(left(tag, strpos(tag, {FIRST}) - 1), upper(left({FIRST}, 1)), substring(tag, strpos(tag, {FIRST}) + 1)) ELSE tag END"
PLAN = f"""t AS (SELECT tag, count(DISTINCT card_id) AS items FROM v_tags GROUP BY tag), f AS (SELECT tag, items, CASE WHEN regexp_matches(tag, '[:/\\\\_]|^\\s*##') THEN tag ELSE {SENTENCE} END AS "to" FROM t),
  plan AS (SELECT tag, "to", CASE WHEN regexp_matches(tag, '[:/\\\\_]|^\\s*##') THEN 'structured' WHEN tag = "to" THEN 'unchanged' WHEN regexp_matches({KEY.format('"to"')}, '^u') THEN 'protected' WHEN "to" IN (SELECT tag FROM t) OR count(*) OVER (PARTITION BY "to") > 1 THEN 'collision' ELSE 'change' END AS status, items FROM f)"""


@query("format_plan", f'WITH {PLAN} SELECT tag, "to", status, items FROM plan')
def format_plan(s):
    return g.format_plan(s.v_tags, t.Exclusions.of("u*"))


@query("applied_plan", f"""WITH {PLAN} SELECT DISTINCT card_id, CASE WHEN status = 'change' AND items % 3 <> 0 THEN "to" ELSE v.tag END AS tag FROM v_tags v JOIN plan p ON p.tag = v.tag""")
def applied_plan(s):
    """A plan of before, by which some tags had another number of items."""
    now = g.format_plan(s.v_tags, t.Exclusions.of("u*"))
    before = now.withColumn("items", F.when(F.col("items") % 3 == 0, F.col("items") + 1).otherwise(F.col("items")))
    return g.applied(s.v_tags, before, now)


@query("added_tags", "SELECT DISTINCT card_id, tag FROM v_tags UNION SELECT id, name FROM v_notes, (SELECT 'to read' AS name UNION SELECT 'src2') WHERE doc_id % 10 = 0")
def added_tags(s):
    names = s.spark.createDataFrame([("to read",), ("src2",), (" ",), ("x" * 256,), ("a\nb",)], "name string")
    return g.added(s.v_tags, s.v_notes.where("doc_id % 10 = 0").select(F.col("id").alias("card_id")), names)[0]


@query("tag_vocabulary", f"SELECT DISTINCT library, tag FROM v_tags JOIN v_notes ON id = card_id WHERE {VISIBLE}")
def tag_vocabulary(s):
    return g.vocabulary(s.v_tags, s.v_notes, RULES)


@query("tag_search", "SELECT DISTINCT tag FROM v_tags WHERE contains(lower(tag), 'src1')")
def tag_search(s):
    return g.searched(s.v_tags.select("tag").distinct(), "Src1")


@query("tag_list", "SELECT tag, count(DISTINCT card_id) AS items, left(tag, 1) AS \"group\" FROM v_tags GROUP BY tag ORDER BY items DESC, tag")
def tag_list(s):
    return g.ordered(g.usage(s.v_tags).withColumn("group", F.substring("tag", 1, 1)))


@query("preferred_names", f"""WITH n AS (SELECT name, {KEY.format('name')} AS k FROM v_tag_names), u AS (SELECT p_brand AS name, count(*) AS items FROM part GROUP BY ALL UNION ALL SELECT p_type, count(*) FROM part GROUP BY ALL),
  r AS (SELECT k, name, coalesce(items, 0) AS items, row_number() OVER (PARTITION BY k ORDER BY coalesce(items, 0) DESC, name) AS place FROM n LEFT JOIN u USING (name)) SELECT k AS "group", name FROM r WHERE place = 1""")
def preferred_names(s):
    groups = s.v_tag_names.select("name", t.key_of("name").alias("group"))
    uses = s.part.select(F.explode(F.array("p_brand", "p_type")).alias("tag")).groupBy("tag").agg(F.count("*").alias("items"))
    return g.preferred(groups, uses).select("group", "name")


@query("format_tag")
def format_tag(s):
    return s.v_tag_names.select("name", t.formatted_of("name").alias("formatted"))


@query("phrases")
def phrases(s):
    return g.phrases(s.v_corpus)


EVIDENCE = "SELECT id AS query, tag AS name, CASE WHEN strpos(title_folded, tag) > 0 THEN 1 ELSE 0 END AS in_title, doc_id % 3 AS in_abstract, CASE WHEN strpos(lower(body), tag) > 0 THEN 2 ELSE 0 END AS body_hits, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 10) / 4.0e0 END AS vote, doc_id % 5 = 0 AS is_new FROM v_notes JOIN v_tags ON card_id = id"
SCORED = f"""e AS ({EVIDENCE}), d AS (SELECT *, coalesce(vote, 0) / greatest(1.0, max(coalesce(vote, 0)) OVER (PARTITION BY query)) AS support,
    CASE WHEN in_title > 0 THEN 0.84 + CASE WHEN in_abstract > 0 THEN 0.04 ELSE 0 END + CASE WHEN body_hits > 0 THEN 0.02 ELSE 0 END WHEN in_abstract > 0 THEN 0.65 + least(0.08, (in_abstract - 1) * 0.04) WHEN body_hits >= 2 THEN 0.59 + least(0.09, log2(body_hits) * 0.025) ELSE 0 END AS direct FROM e),
  sc AS (SELECT *, direct + 0.08 * support - CASE WHEN is_new THEN 0.025 ELSE 0 END AS score FROM d WHERE in_title > 0 OR in_abstract > 0 OR body_hits >= 2 OR vote IS NOT NULL)"""


def scored(s):
    own = s.v_notes.join(s.v_tags, F.col("card_id") == F.col("id"))
    evidence = own.select(
        F.col("id").alias("query"), F.col("tag").alias("name"), F.when(F.contains("title_folded", "tag"), 1).otherwise(0).alias("in_title"), (F.col("doc_id") % 3).alias("in_abstract"),
        F.when(F.contains(F.lower("body"), F.col("tag")), 2).otherwise(0).alias("body_hits"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 10 / 4.0).alias("vote"), (F.col("doc_id") % 5 == 0).alias("is_new"),
    )
    return g.scored(evidence)


@query("tag_scores", f"WITH {SCORED} SELECT query, name, round(score, 6) AS score FROM sc")
def tag_scores(s):
    return scored(s).select("query", "name", F.round("score", 6).alias("score"))


@query("indexed_hits", f"""WITH {COUNTS}, b AS (SELECT doc_key, feature, sum(tf) AS tf FROM c WHERE field = 2 GROUP BY ALL), n AS (SELECT DISTINCT doc_key, feature AS name FROM c WHERE field = 0 AND feature LIKE 'b:%'),
  p AS (SELECT doc_key, name, unnest([name, concat('w:', split_part(substring(name, 3), ' ', 1)), concat('w:', split_part(substring(name, 3), ' ', 2))]) AS feature FROM n) SELECT doc_key, substring(name, 3) AS name, min(coalesce(tf, 0))::BIGINT AS hits FROM p LEFT JOIN b USING (doc_key, feature) GROUP BY ALL""")
def indexed_hits(s):
    """Pairs of a title's words, by their own feature and those of both words."""
    docs = materialize(x.counts_by_document(s.v_corpus))
    titled = F.filter("features", lambda f: (f["tf0"] > 0) & F.startswith(f["feature"], F.lit("b:")))
    pair = docs.select("doc_key", F.explode(F.transform(titled, lambda f: F.substring(f["feature"], 3, 1000))).alias("name"))
    w = lambda k: F.concat(F.lit("w:"), F.split_part("name", F.lit(" "), F.lit(k)))
    names = pair.select("doc_key", "name", F.explode(F.array(F.concat(F.lit("b:"), "name"), w(1), w(2))).alias("feature"))
    # a title's words are few: of its body only their counts go on
    wanted = F.flatten(F.transform(titled, lambda f: F.concat(F.array(f["feature"]), F.transform(F.split(F.substring(f["feature"], 3, 1000), " "), lambda u: F.concat(F.lit("w:"), u)))))
    held = docs.select("doc_key", "features", wanted.alias("wanted")).select("doc_key", F.explode(F.filter("features", lambda f: (f["tf2"] > 0) & F.array_contains("wanted", f["feature"]))).alias("f"))
    counted = held.select("doc_key", "f.feature", F.col("f.tf2").alias("tf"))
    return g.indexed_hits(names, counted).select("doc_key", "name", F.col("hits").cast("long").alias("hits"))


GROUNDED = f"""{SCORED}, m AS (SELECT *, CASE WHEN length(name) % 4 > 0 THEN length(name) % 10 / 10.0::DOUBLE END AS similarity, max(in_title > 0) OVER (PARTITION BY query) AS titled FROM sc),
  k AS (SELECT *, greatest(similarity, 0) AS sim FROM m WHERE NOT (titled AND in_title = 0 AND in_abstract = 1 AND body_hits < 2 AND support = 0) AND NOT (direct = 0 AND NOT (support > 0 AND coalesce(similarity >= 0.38, FALSE)))
    AND NOT (is_new AND in_title = 0 AND in_abstract = 0 AND NOT (body_hits >= 3 AND coalesce(similarity >= 0.3, TRUE))) AND NOT (in_title = 0 AND coalesce(similarity < 0.25, FALSE)))"""


@query("grounded_tags", f"WITH {GROUNDED} SELECT query, name, round(least(1.0, score + 0.14 * coalesce(sim, 0) + CASE WHEN direct = 0 THEN 0.45 + 0.22 * support ELSE 0 END), 6) AS score FROM k")
def grounded_tags(s):
    rows = scored(s).withColumn("similarity", F.when(F.length("name") % 4 > 0, F.length("name") % 10 / 10.0))
    return g.grounded(rows.withColumn("incidental", F.lit(False))).select("query", "name", F.round("score", 6).alias("score"))


def mined(s):
    """Phrases of each document as candidates: known ones are those that two documents or more have."""
    found = materialize(g.phrases(s.v_corpus))  # read twice
    known = found.groupBy("phrase").agg(F.count("*").alias("docs"))
    rows = found.select(F.col("doc_key").alias("query"), F.col("phrase").alias("name"), F.col("t").alias("in_title"), F.col("a").alias("in_abstract"), F.col("b").alias("body_hits"), F.lit(None).cast("double").alias("vote"), "phrase")
    return g.scored(rows.join(known, "phrase").withColumn("is_new", F.col("docs") < 2).drop("docs", "phrase"))


@query("tag_selection")
def tag_selection(s):
    rows = mined(s).withColumn("similarity", F.lit(None).cast("double")).withColumn("incidental", F.lit(False))
    return g.selected(g.grounded(rows).select("query", "name", "score", "is_new"))


def tag_vectors(s):
    """key and vector: the mean of the vectors of the notes that have a tag; written
    once, as a vector that is used again in a plan is made again there."""
    own = s.v_tags.join(s.v_notes.select(F.col("id").alias("card_id"), "doc_id"), "card_id").join(s.embeddings, F.col("doc_id") == F.col("vec_id"))
    return materialize(d.pooled(own.select(F.col("tag").alias("key"), F.lit(1).alias("chunk"), F.col("embedding").alias("vector"))))


TAG_VECTORS = """tp AS (SELECT tag, unnest(list_transform(embedding, lambda e: e::DOUBLE)) AS x, unnest(range(len(embedding))) AS dim FROM v_tags JOIN v_notes ON id = card_id JOIN embeddings ON vec_id = doc_id), tm AS (SELECT tag, dim, sum(x) AS x FROM tp GROUP BY ALL),
  tv AS (SELECT tag, list(x ORDER BY dim) AS v FROM tm GROUP BY tag)"""


@query("tag_similarity", f"WITH {TAG_VECTORS} SELECT id AS query, v_tags.tag AS name, round(list_cosine_similarity(list_transform(embedding, lambda e: e::DOUBLE), tv.v), 5) AS similarity FROM v_tags JOIN v_notes ON id = card_id JOIN embeddings ON vec_id = doc_id JOIN tv ON tv.tag = v_tags.tag")
def tag_similarity(s):
    docs = s.v_notes.join(s.embeddings, F.col("doc_id") == F.col("vec_id")).select(F.col("id").alias("key"), F.col("embedding").alias("vector"))
    found = d.tag_similarities(s.v_tags.select(F.col("card_id").alias("query"), F.col("tag").alias("name")), docs, tag_vectors(s))
    return found.select("query", "name", F.round("similarity", 5).alias("similarity"))


@query("merged_tag_groups")
def merged_tag_groups(s):
    names = materialize(s.v_tags.select(F.col("tag").alias("name")).distinct())
    pairs = materialize(g.duplicate_pairs(names))
    return g.merged_groups(g.duplicate_groups(names, pairs), pairs, d.vector_pairs(tag_vectors(s).withColumn("library", F.lit(0))))


#: The catalogue: all tags, and the first two words of every tenth title.
NAMES = "SELECT tag AS name FROM v_tags UNION SELECT concat(split_part(title_folded, ' ', 1), ' ', split_part(title_folded, ' ', 2)) FROM v_notes WHERE doc_id % 10 = 0"
NORMAL = "trim(regexp_replace(" + KEY.format("regexp_replace({0}, '<[^>]*>', ' ', 'g')") + ", '[^\\p{{L}}\\p{{N}}+#]+', ' ', 'g'))"
TIMES = "((length('  ' || replace({0}, ' ', '  ') || '  ') - length(replace('  ' || replace({0}, ' ', '  ') || '  ', ' ' || replace(key, ' ', '  ') || ' ', ''))) // (length(replace(key, ' ', '  ')) + 2))"


@query("tag_matches", f"""WITH n AS (SELECT DISTINCT {NORMAL.format('name')} AS key FROM ({NAMES})), x AS (SELECT doc_key, {', '.join(f'{NORMAL.format(c)} AS {c}' for c in ('title', 'abstract', 'body'))} FROM v_corpus),
  m AS (SELECT doc_key, key, {', '.join(f'CAST({TIMES.format(c)} AS INT) AS in_{c}' for c in ('title', 'abstract', 'body'))} FROM x, n WHERE key <> '') SELECT * FROM m WHERE in_title + in_abstract + in_body > 0""")
def tag_matches(s):
    pairs = s.v_notes.where("doc_id % 10 = 0").select(F.concat(F.split_part("title_folded", F.lit(" "), F.lit(1)), F.lit(" "), F.split_part("title_folded", F.lit(" "), F.lit(2))).alias("name"))
    return suggest.matches(s.v_corpus, s.v_tags.select(F.col("tag").alias("name")).union(pairs).distinct()).drop("in_focus")


@query("suggested_tags")
def suggested_tags(s):
    """For every hundredth document, by its text, its nearest neighbours by vector and the vectors of tags."""
    vectors = s.v_notes.join(s.embeddings, F.col("doc_id") == F.col("vec_id")).select(F.col("id").alias("key"), "library", F.col("embedding").alias("vector"), "doc_id")
    found = cells.nearest(cells.build(vectors), vectors.where("doc_id % 100 = 0"), 20)[0].select("query", F.col("key").alias("card_id"), "score")
    texts = s.v_corpus.where("doc_id % 100 = 0").select(F.lpad(F.col("doc_id").cast("string"), 14, "0").alias("doc_key"), "title", "abstract", "body")
    of_tags = tag_vectors(s)
    near = d.vector_pairs(of_tags.withColumn("library", F.lit(0)), suggest.CLOSE)
    return suggest.suggest(texts, s.v_tags, materialize(found), vectors.select("key", "vector"), of_tags, near)
