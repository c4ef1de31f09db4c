"""Lexical and dense retrieval, and fusion of their rankings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS
from ..operators import bounds, cells, pairs, weighing
from ..operators import dense as d
from ..operators import lexical as x
from ..sources.scratch import materialize
from .registry import query

STOP = "[" + ", ".join(f"'{w}'" for w in sorted(STOP_WORDS)) + "]"
KEPT = "length({0}) >= 2 AND NOT regexp_matches({0}, '^[0-9]+$') AND NOT list_contains(" + STOP + ", {0})"
COUNTS = f"""w AS (SELECT doc_key, f.field, regexp_extract_all(lower(CASE f.field WHEN 0 THEN title WHEN 1 THEN abstract ELSE body END), '[\\p{{L}}\\p{{N}}]+') AS w FROM v_corpus, (SELECT unnest([0, 1, 2]) AS field) f),
  c AS (SELECT doc_key, field, feature, count(*) AS tf FROM (SELECT doc_key, field, unnest(list_concat(list_transform(list_filter(w, lambda a: {KEPT.format('a')}), lambda a: concat('w:', a)),
    list_transform(list_filter(range(1, len(w)), lambda i: {KEPT.format('w[i]')} AND {KEPT.format('w[i + 1]')}), lambda i: concat('b:', w[i], ' ', w[i + 1])))) AS feature FROM w) GROUP BY ALL)"""
MODEL = f"""{COUNTS}, df AS (SELECT feature, count(DISTINCT doc_key) AS df FROM c GROUP BY feature), n AS (SELECT count(*) AS n_docs FROM v_corpus),
  av AS (SELECT field, CASE WHEN coalesce(sum(tf), 0) > 0 THEN sum(tf) / (SELECT n_docs FROM n)::DOUBLE ELSE 1 END AS avg FROM c GROUP BY field)"""
WEIGHTS = f"""{MODEL}, ln AS (SELECT doc_key, field, sum(tf) AS len FROM c GROUP BY ALL),
  g AS (SELECT doc_key, feature, sum([4.0::DOUBLE, 2.0, 1.0][field + 1] * tf / (1 - [0.3::DOUBLE, 0.6, 0.75][field + 1] + [0.3::DOUBLE, 0.6, 0.75][field + 1] * len / avg)) AS x, min(field) = 0 AS in_title FROM c JOIN ln USING (doc_key, field) JOIN av USING (field) GROUP BY ALL),
  wt AS (SELECT doc_key, feature, ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * x * 2.2 / (x + 1.2) AS weight, in_title FROM g JOIN df USING (feature), n)"""


def picked(rows: str, title: int, total: int) -> str:
    return f"""(SELECT doc_key, feature, weight, in_title FROM (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY in_title AND k <= {title} DESC, weight DESC, feature) AS j
      FROM (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY in_title DESC, weight DESC, feature) AS k FROM {rows})) WHERE j <= {total})"""


def normalised(rows: str) -> str:
    return f"""(SELECT doc_key, feature, in_title, q / sqrt(sum(q * q) OVER (PARTITION BY doc_key)) AS weight FROM (SELECT doc_key, feature, in_title, greatest(1.0, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_key)) * 65535)) / 65535 AS q FROM {rows}))"""


SIGNATURE = f"{WEIGHTS}, s AS (SELECT * FROM {normalised(picked('wt', 64, 256))})"
ASKED = f"{SIGNATURE}, q AS (SELECT doc_key AS query, feature, weight AS qw FROM {picked('(SELECT s.* FROM s JOIN v_corpus USING (doc_key) WHERE doc_id % 100 = 0)', 16, 48)})"
ALL_ASKED = f"{SIGNATURE}, q AS (SELECT doc_key AS query, feature, weight AS qw FROM {picked('s', 16, 48)})"
BEST = """f AS (SELECT query, doc_key, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_key) AS k FROM (SELECT query, doc_key, sum(qw * weight) AS score FROM q JOIN s USING (feature) WHERE query <> doc_key GROUP BY ALL)) WHERE k <= 300)"""
FOUND = f"{ASKED}, {BEST}"


def asked(s):
    return s.v_corpus.where("doc_id % 100 = 0")


def signature(s):
    """Written once, as searches read it for their queries and for all documents."""
    return x.flat(materialize(x.signature_rows(s.v_corpus)))


@query("df_table", f"WITH {MODEL} SELECT feature, df FROM df")
def df_table(s):
    return x.document_frequencies(x.counts_by_document(s.v_corpus))


@query("field_averages", f"WITH {MODEL} SELECT n_docs, round((SELECT avg FROM av WHERE field = 0), 6) AS avg0, round((SELECT avg FROM av WHERE field = 1), 6) AS avg1, round((SELECT avg FROM av WHERE field = 2), 6) AS avg2 FROM n")
def field_averages(s):
    return x.field_averages(s.v_corpus, x.counts_by_document(s.v_corpus)).select("n_docs", *[F.round(f"avg{k}", 6).alias(f"avg{k}") for k in range(3)])


@query("bm25f_weights", f"WITH {WEIGHTS} SELECT doc_key, count(*) AS features, round(sum(weight), 4) AS total, round(max(weight), 5) AS top FROM wt GROUP BY doc_key")
def bm25f_weights(s):
    return weighing.totals(s.v_corpus).select("doc_key", "features", F.round("total", 4).alias("total"), F.round("top", 5).alias("top"))


@query("signature", f"WITH {SIGNATURE} SELECT doc_key, feature, round(weight, 5) AS weight FROM s")
def signature_(s):
    return x.flat(x.signature_rows(s.v_corpus)).select("doc_key", "feature", F.round("weight", 5).alias("weight"))


@query("lexical_candidates", f"WITH {FOUND} SELECT query, doc_key, round(score, 5) AS score FROM f")
def lexical_candidates(s):
    sig = signature(s)
    return x.candidates(x.query_terms(sig.join(asked(s).select("doc_key"), "doc_key", "left_semi")), sig).select("query", "doc_key", F.round("score", 5).alias("score"))


@query("pruned_candidates", f"WITH {FOUND} SELECT query, doc_key, round(score, 5) AS score FROM f")
def pruned_candidates(s):
    """The same by score bounds, without reading every posting."""
    sig = signature(s)
    queries = x.query_terms(sig.join(asked(s).select("doc_key"), "doc_key", "left_semi"))
    return bounds.top_k(queries, bounds.build(sig), x.CANDIDATES)[0].select("query", "doc_key", F.round("score", 5).alias("score"))


@query("similarity", f"""WITH {ALL_ASKED}, {BEST}, fv AS (SELECT split_part(doc_key, chr(9), 1) AS doc_key, split_part(doc_key, chr(9), 2)::INT AS field, feature, weight FROM {normalised('''(SELECT concat(doc_key, chr(9), field) AS doc_key, feature, FALSE AS in_title, weight FROM (SELECT doc_key, field, feature, ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (1 + ln(tf)) AS weight,
    row_number() OVER (PARTITION BY doc_key, field ORDER BY ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (1 + ln(tf)) DESC, feature) AS k FROM c JOIN df USING (feature), n WHERE field < 2) WHERE k <= CASE field WHEN 0 THEN 64 ELSE 128 END)''')}),
  v AS (SELECT doc_key, field, feature, weight FROM fv UNION ALL SELECT doc_key, 2, feature, weight FROM s), h AS (SELECT DISTINCT doc_key, field FROM v),
  ch AS (SELECT f.query, f.doc_key, a.field FROM f JOIN h a ON a.doc_key = f.query JOIN h b ON b.doc_key = f.doc_key AND b.field = a.field),
  dt AS (SELECT f.query, f.doc_key, a.field, sum(a.weight * b.weight) AS dot FROM f JOIN v a ON a.doc_key = f.query JOIN v b ON b.doc_key = f.doc_key AND b.field = a.field AND b.feature = a.feature GROUP BY ALL)
  SELECT query, doc_key, round(sum(coalesce(dot, 0) * [0.3::DOUBLE, 0.3, 0.4][field + 1]) / sum([0.3::DOUBLE, 0.3, 0.4][field + 1]), 5) AS similarity FROM ch LEFT JOIN dt USING (query, doc_key, field) GROUP BY query, doc_key""")
def similarity(s):
    """Of all documents."""
    return pairs.best(materialize(pairs.in_blocks(pairs.vectors(s.v_corpus), pairs.DOCUMENTS)), None, x.CANDIDATES).select("query", "doc_key", F.round("similarity", 5).alias("similarity"))


@query("simhash")
def simhash(s):
    return x.simhashes(x.counts_by_document(s.v_corpus))


@query("near_duplicates")
def near_duplicates(s):
    """Pairs of class representatives, and the members of each class under its representative."""
    rows = materialize(x.signature_rows(s.v_corpus))
    near, members = x.near_duplicates(x.simhashes(x.counts_by_document(s.v_corpus)), rows, s.v_corpus.select("doc_key", "weak"))
    return near.withColumn("member", F.lit(False)).union(members.where("doc_key != copy_of").select("copy_of", "doc_key", F.lit(1.0), F.lit(True)))


@query("similar_items")
def similar_items(s):
    return x.similar(s.v_corpus, asked(s), 20)


VECTORS = "v AS (SELECT vec_id AS key, label AS library, list_transform(embedding, lambda e: e::DOUBLE) AS v FROM embeddings)"


def vectors(s):
    return s.embeddings.select(F.col("vec_id").alias("key"), F.col("label").alias("library"), F.col("embedding").alias("vector"))


DENSE = f"""WITH {VECTORS} SELECT query, key, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS place FROM (SELECT q.key AS query, v.key, least(1.0, list_cosine_similarity(q.v, v.v)) AS score FROM v q JOIN v USING (library) WHERE q.key % 100 = 0 AND v.key <> q.key) WHERE score > 0) WHERE place <= 10"""


@query("dense_topk", DENSE)
def dense_topk(s):
    v = vectors(s)
    return d.nearest(v, v.where("key % 100 = 0"), 10).select("query", "key", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@query("dense_indexed", DENSE)
def dense_indexed(s):
    """The same through cells, without comparing all."""
    v = vectors(s)
    return cells.nearest(cells.build(v), v.where("key % 100 = 0"), 10)[0].select("query", "key", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


#: Beside the vectors a near copy of each twentieth, so that there are close pairs.
PLANTED = "v AS (SELECT vec_id AS key, label AS library, list_transform(embedding, lambda e: e::DOUBLE) AS v FROM embeddings UNION ALL SELECT 1000000 + vec_id, label, list_transform(embedding, lambda e, i: e::DOUBLE * (1 + i % 3 * 0.25::DOUBLE)) FROM embeddings WHERE vec_id % 20 = 0)"


def planted(s):
    near = F.transform(F.col("embedding"), lambda e, i: e.cast("double") * (1 + (i + 1) % 3 * 0.25))
    copies = s.embeddings.where("vec_id % 20 = 0").select((F.col("vec_id") + 1_000_000).alias("key"), F.col("label").alias("library"), near.alias("vector"))
    return vectors(s).withColumn("vector", F.transform("vector", lambda e: e.cast("double"))).union(copies)


@query("semantic_preview", f"""WITH {PLANTED}, t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) - 1 AS r, max(score) OVER (PARTITION BY query) AS best FROM (SELECT q.key AS query, v.key, list_cosine_similarity(q.v, v.v) AS score FROM v q JOIN v USING (library) WHERE q.key % 100 = 0 AND v.key <> q.key) WHERE score > 0)
  SELECT query, key, round((1.0 / (61 + r)) / (2 / 61.0::DOUBLE), 6) AS fused FROM t WHERE r < 100 AND score >= greatest(0.4, 0.7 * best)""")
def semantic_preview(s):
    v = planted(s)
    found = d.nearest(v, v.where("key % 100 = 0"), 100).select("query", F.col("key").alias("doc_key"), "score")
    ranked = d.relevant(found, "semantic").select("query", F.lit(1).alias("channel"), "doc_key", "score")
    return d.fused(ranked, 2, 100).select("query", F.col("doc_key").alias("key"), F.round("fused", 6).alias("fused"))


@query("vector_pairs", f"WITH {PLANTED} SELECT a.key AS a, b.key AS b, round(list_cosine_similarity(a.v, b.v), 5) AS score FROM v a JOIN v b ON a.library = b.library AND a.key < b.key AND list_cosine_similarity(a.v, b.v) >= 0.5")
def vector_pairs(s):
    return d.vector_pairs(planted(s), 0.5).select("a", "b", F.round("score", 5).alias("score"))


@query("vector_norms", f"WITH {VECTORS} SELECT key, round(sqrt(list_dot_product(v, v)), 5) AS norm FROM v")
def vector_norms(s):
    return vectors(s).select("key", F.round(d.norm("vector"), 5).alias("norm"))


@query("chunks", """WITH h AS (SELECT doc_key, list_filter(regexp_split_to_array(trim(concat(lower(title), '. ', lower(abstract))), '\\s+'), lambda w: w <> '') AS h, list_filter(regexp_split_to_array(trim(substring(lower(body), 1, 12000)), '\\s+'), lambda w: w <> '') AS b, trim(abstract) = '' AS bare FROM v_corpus),
  k AS (SELECT doc_key, bare, list_transform(range(0, greatest(ceil(len(h) / 120), 1)::BIGINT), lambda i: substring(array_to_string(h[i * 120 + 1 : i * 120 + 120], ' '), 1, 1800))[1:3] AS a, list_transform(range(0, greatest(ceil(len(b) / 120), 1)::BIGINT), lambda i: substring(array_to_string(b[i * 120 + 1 : i * 120 + 120], ' '), 1, 1800)) AS b FROM h),
  r AS (SELECT doc_key, CASE WHEN bare THEN list_concat(a, b)[1:4] ELSE a END AS t FROM k)
  SELECT doc_key, chunk, text FROM (SELECT doc_key, unnest(range(0, len(t))) AS chunk, unnest(t) AS text FROM r) WHERE regexp_matches(text, '\\p{L}')""")
def chunks(s):
    return d.chunks(s.v_corpus).select("doc_key", F.col("chunk").cast("long").alias("chunk"), "text")


@query("pooled_embedding", f"""WITH {VECTORS}, p AS (SELECT key // 4 AS key, key % 4 AS chunk, v FROM v), u AS (SELECT key, CASE WHEN chunk = 0 THEN 3.0 ELSE 1.0 END AS w, unnest(v) AS x, unnest(range(64)) AS dim FROM p), m AS (SELECT key, dim, sum(w * x) AS x FROM u GROUP BY ALL)
  SELECT key, round(max(x) / sqrt(sum(x * x)), 5) AS top, round(min(x) / sqrt(sum(x * x)), 5) AS low FROM m GROUP BY key""")
def pooled_embedding(s):
    parts = s.embeddings.select(F.floor(F.col("vec_id") / 4).alias("key"), (F.col("vec_id") % 4).alias("chunk"), F.col("embedding").alias("vector"))
    return d.pooled(parts).select("key", F.round(F.array_max("vector"), 5).alias("top"), F.round(F.array_min("vector"), 5).alias("low"))


def rankings(s):
    """Each asked document's first hundred by shared features (channel 0) and by vectors (1)."""
    sig = signature(s)
    one = x.candidates(x.query_terms(sig.join(asked(s).select("doc_key"), "doc_key", "left_semi")), sig, 100).select(F.lit(0).alias("channel"), "query", "doc_key", F.round("score", 6).alias("score"))
    v = s.v_corpus.join(s.embeddings, F.col("doc_id") == F.col("vec_id")).select(F.col("doc_key").alias("key"), "library", F.col("embedding").alias("vector"), "doc_id")
    two = d.nearest(v, v.where("doc_id % 100 = 0"), 100).select(F.lit(1), "query", F.col("key").alias("doc_key"), F.round("score", 6).alias("score"))
    return one.union(two)


RANKINGS = f"""{FOUND}, dv AS (SELECT doc_key, doc_id, library, list_transform(embedding, lambda e: e::DOUBLE) AS v FROM v_corpus JOIN embeddings ON vec_id = doc_id),
  rk AS (SELECT 0 AS channel, query, doc_key, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_key) AS k FROM f) WHERE k <= 100
    UNION ALL SELECT 1, query, doc_key, round(score, 6) FROM (SELECT q.doc_key AS query, v.doc_key, least(1.0, list_cosine_similarity(q.v, v.v)) AS score, row_number() OVER (PARTITION BY q.doc_key ORDER BY list_cosine_similarity(q.v, v.v) DESC, v.doc_key) AS k FROM dv q JOIN dv v ON v.library = q.library WHERE q.doc_id % 100 = 0 AND v.doc_key <> q.doc_key AND list_cosine_similarity(q.v, v.v) > 0) WHERE k <= 100)"""
RANKS = "r AS (SELECT *, row_number() OVER (PARTITION BY query, channel ORDER BY score DESC, doc_key) - 1 AS r FROM rk)"
FUSED = "SELECT query, doc_key, sum(1.0 / (61 + r)) / (2 / 61.0::DOUBLE) AS fused, max(score) FILTER (WHERE channel = 0) AS lexical_score, max(score) FILTER (WHERE channel = 1) AS semantic_score FROM {0} WHERE r < 100 GROUP BY ALL"
PLACED = "SELECT query, doc_key, round(fused, 6) AS fused, round(lexical_score, 6) AS lexical_score, round(semantic_score, 6) AS semantic_score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY fused DESC, doc_key) AS place FROM ({0})) WHERE place <= 50"


def shown(rows):
    return rows.select("query", "doc_key", *[F.round(c, 6).alias(c) for c in ("fused", "lexical_score", "semantic_score")], F.col("place").cast("long").alias("place"))


@query("rrf_fusion", f"WITH {RANKINGS}, {RANKS} {PLACED.format(FUSED.format('r'))}")
def rrf_fusion(s):
    return shown(d.fused(rankings(s), 2))


@query("relevance_floor", f"""WITH {RANKINGS} SELECT query, channel, doc_key, round(score, 6) AS score FROM (SELECT *, max(score) OVER (PARTITION BY query, channel) AS best FROM rk WHERE score > 0) WHERE score >= CASE channel WHEN 0 THEN greatest(0.05, 0.2 * best) ELSE greatest(0.4, 0.7 * best) END""")
def relevance_floor(s):
    rows = materialize(rankings(s))
    one, two = rows.where("channel = 0"), rows.where("channel = 1")
    return d.relevant(one, "text").union(d.relevant(two, "semantic")).select("query", "channel", "doc_key", F.round("score", 6).alias("score"))


@query("hybrid_recommend", f"""WITH {RANKINGS}, k AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY query, channel) AS best FROM rk WHERE score > 0) WHERE score >= CASE channel WHEN 0 THEN greatest(0.05, 0.2 * best) ELSE greatest(0.4, 0.7 * best) END),
  r AS (SELECT *, row_number() OVER (PARTITION BY query, channel ORDER BY score DESC, doc_key) - 1 AS r FROM k) {PLACED.format(FUSED.format('r'))}""")
def hybrid_recommend(s):
    rows = materialize(rankings(s))
    of = lambda c: rows.where(F.col("channel") == c).select("query", "doc_key", "score")
    return shown(d.hybrid(of(0), of(1)))


def weighed_after(s, changed: str):
    """Weights of all documents when those that ``changed`` names have come since the epoch began."""
    from ..operators.epochs import Epochs, totals
    from ..sources.scratch import scope, shared_dir

    epochs = Epochs(s.spark, f"{shared_dir(s.spark)}/epochs-{uuid.uuid4().hex}")

    def begun(corpus, what: str | None, revision: int):
        c = weighing.Corpus(s.v_corpus, what)
        blocks = materialize(c.blocks())
        epochs.rebuild(corpus, weighing.Statistics(c, blocks), lambda: revision)
        return c, blocks

    with scope(s.spark) as written:
        c, blocks = begun(s.v_corpus.where(f"not ({changed})"), f"not ({changed})", 0)
        n = s.v_corpus.where(changed).count()
        if not (due := epochs.due(n)):
            written.clear()
    if due:
        c, blocks = begun(s.v_corpus, None, n)
    return totals(c, blocks, epochs.current()).select("doc_key", "features", F.round("total", 4).alias("total"), F.round("top", 5).alias("top"))


def frozen_sql(changed: str) -> str:
    """Statistics of the old documents, or of all if as many changed as make an epoch due."""
    return f"""WITH {COUNTS}, new AS (SELECT count(*) FILTER (WHERE {changed}) AS n, count(*) FILTER (WHERE NOT ({changed})) AS old FROM v_corpus), due AS (SELECT n >= least(500, greatest(50, ceil(old / 20.0))) AS due FROM new),
      base AS (SELECT doc_key FROM v_corpus, due WHERE due OR NOT ({changed})), cb AS (SELECT c.* FROM c JOIN base USING (doc_key)), df AS (SELECT feature, count(DISTINCT doc_key) AS df FROM cb GROUP BY feature), nd AS (SELECT count(*) AS n_docs FROM base),
      av AS (SELECT f.field, CASE WHEN coalesce(sum(tf), 0) > 0 THEN sum(tf) / (SELECT n_docs FROM nd)::DOUBLE ELSE 1 END AS avg FROM (SELECT unnest([0, 1, 2]) AS field) f LEFT JOIN cb ON cb.field = f.field GROUP BY f.field), ln AS (SELECT doc_key, field, sum(tf) AS len FROM c GROUP BY ALL),
      g AS (SELECT doc_key, feature, sum([4.0::DOUBLE, 2.0, 1.0][field + 1] * tf / (1 - [0.3::DOUBLE, 0.6, 0.75][field + 1] + [0.3::DOUBLE, 0.6, 0.75][field + 1] * len / avg)) AS x FROM c JOIN ln USING (doc_key, field) JOIN av USING (field) GROUP BY ALL),
      wt AS (SELECT doc_key, ln(1 + (n_docs - coalesce(df, 0) + 0.5::DOUBLE) / (coalesce(df, 0) + 0.5::DOUBLE)) * x * 2.2 / (x + 1.2) AS weight FROM g LEFT JOIN df USING (feature), nd)
      SELECT doc_key, count(*) AS features, round(sum(weight), 4) AS total, round(max(weight), 5) AS top FROM wt GROUP BY doc_key"""


@query("frozen_weights", frozen_sql("doc_id % 40 = 3"))
def frozen_weights(s):
    """2.5 % of the documents are new: the epoch stands."""
    return weighed_after(s, "doc_id % 40 = 3")


@query("rebuilt_weights", frozen_sql("doc_id % 10 = 3"))
def rebuilt_weights(s):
    """A tenth is new: all statistics change at once."""
    return weighed_after(s, "doc_id % 10 = 3")
