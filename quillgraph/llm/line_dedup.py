"""Line dedup by overlapping windows of three lines.

Lines are what stands between newlines; blank ones (white space only) are
passed over and always stay. Three lines in a row make a window, hashed to 128
bits (two hashes of 64). All of it is DataFrame functions, without a Python worker. A window that occurs more than once, anywhere, keeps its first
occurrence, by doc_id and place; the lines of every later one are marked.
Marks of overlapping windows merge, and marked lines go.

Cases: a text that is null or has fewer than three lines that aren't blank
stays as it is; one that loses every line that isn't blank becomes empty. Rows
that agree in doc_id and text count as one document and fare alike; a null
doc_id sorts first. Other columns of the documents pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

LINES = 3
NO_ID = -(2**63)


def once(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spoken(line: Column) -> Column:
    """Whether a line isn't blank."""
    return line.rlike(r"(?U)[^\s\x1C-\x1F]")


def windows(docs: DataFrame) -> DataFrame:
    """d, th (the row's own key), k (the window's first line, counting those that
    aren't blank), h1, h2."""

    def of(lines: Column) -> Column:
        said = lambda i: [F.get(lines, i + j) for j in range(LINES)]
        window = lambda i: F.struct(i.cast("int").alias("k"), *[F.xxhash64(F.lit(h), *said(i)).alias(f"h{h}") for h in (1, 2)])
        return F.when(F.size(lines) >= LINES, F.transform(F.sequence(F.lit(0), F.size(lines) - LINES), window))

    found = once(F.filter(F.split("text", "\n"), spoken), of)
    rows = docs.where("text is not null").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("th"), F.explode(found).alias("w"))
    return rows.select("d", "th", "w.*")


def without(text: Column, marked: Column) -> Column:
    """The text without the lines of the marked windows; its places are looked up in hash sets, so the time is linear."""

    def of(lines: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(lines) - 1)
        return once(F.filter(every, lambda i: spoken(F.get(lines, i))), lambda at: once(F.flatten(F.transform(marked, lambda k: F.slice(at, k + 1, LINES))), lambda gone: rest(lines, every, at, gone)))

    def rest(lines: Column, every: Column, at: Column, gone: Column) -> Column:
        kept = F.array_join(F.transform(F.array_except(every, gone), lambda i: F.get(lines, i)), "\n")
        return F.when(F.size(F.array_except(at, gone)) > 0, kept).otherwise("")

    return once(F.split(text, "\n"), of)


def deduped(docs: DataFrame) -> DataFrame:
    """docs with __kept, the text that stays, and __marked, the windows that went (null: none)."""
    found = windows(docs.select("doc_id", "text"))
    # partial aggregation leaves one row of a hot window in each task
    first = found.groupBy("h1", "h2").agg(F.min(F.struct("d", "th", "k")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = found.join(first, ["h1", "h2"]).where(F.struct("d", "th", "k") > F.col("first"))
    marks = later.groupBy(F.col("d").alias("__d"), F.col("th").alias("__th")).agg(F.collect_set("k").alias("__marked"))
    key = (F.coalesce(docs["doc_id"], F.lit(NO_ID)) == F.col("__d")) & (F.xxhash64(docs["text"]) == F.col("__th"))
    return docs.join(marks, key, "left").drop("__d", "__th").withColumn("__kept", F.when(F.col("__marked").isNull(), F.col("text")).otherwise(without(F.col("text"), F.col("__marked"))))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, text, text_kept and marked, the windows that went (null: none)."""
    return deduped(docs).select("doc_id", "text", F.col("__kept").alias("text_kept"), F.col("__marked").alias("marked"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines and n_kept (newlines count lines), the number of windows that went, and the text that stays."""
    lines = lambda c: F.coalesce(F.length(c) - F.length(F.replace(F.col(c), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", lines("text").alias("n_lines"), lines("text_kept").alias("n_kept"), F.coalesce(F.size("marked"), F.lit(0)).cast("long").alias("n_windows"), F.col("text_kept").alias("text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with what line dedup leaves of their texts, without those
    of which it leaves nothing. Returns the columns of docs; n_chars, if there, is made anew."""
    small_batches(spark)
    out = deduped(docs).where("__marked is null or __kept != ''").withColumn("text", F.col("__kept"))
    if "n_chars" not in docs.columns:
        return out.select(*docs.columns)
    return out.withColumn("n_chars", F.when(F.col("__marked").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM l WHERE regexp_matches(line, '[^\s]')),
w AS (SELECT doc_id, k, line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o AS win FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
f AS (SELECT doc_id, k, row_number() OVER (PARTITION BY win ORDER BY doc_id, k) AS nth FROM w WHERE win IS NOT NULL),
m AS (SELECT doc_id, k FROM f WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, k + j AS k FROM m, (SELECT unnest([0, 1, 2]) AS j)),
kept AS (SELECT l.doc_id, l.i, l.line, b.k FROM l LEFT JOIN b ON l.doc_id = b.doc_id AND l.i = b.i LEFT JOIN gone ON gone.doc_id = b.doc_id AND gone.k = b.k WHERE gone.k IS NULL),
t AS (SELECT doc_id, CASE WHEN count(k) = 0 THEN '' ELSE string_agg(line, chr(10) ORDER BY i) END AS text FROM kept GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines,
  CAST(CASE WHEN d.text IS NULL THEN 0 WHEN n.n IS NULL THEN len(string_split(d.text, chr(10))) ELSE len(string_split(coalesce(t.text, ''), chr(10))) END AS BIGINT) AS n_kept,
  CAST(coalesce(n.n, 0) AS BIGINT) AS n_windows, CASE WHEN n.n IS NULL THEN d.text ELSE coalesce(t.text, '') END AS text
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
