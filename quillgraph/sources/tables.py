"""Tables by name, and the note views derived from them.

The views are plain SQL that Spark and ANSI engines read alike, so that what is
checked against other engines starts from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    # notes: one for each document
    "v_notes": """SELECT lpad(cast(doc_id AS varchar(20)), 14, '0') AS id, doc_id, substring(split_part(text, chr(10), 1), 1, 60) AS title, lower(substring(split_part(text, chr(10), 1), 1, 60)) AS title_folded, text AS body,
      CASE doc_id % 4 WHEN 0 THEN 'literature' WHEN 1 THEN 'zettel' WHEN 2 THEN 'thinking' ELSE 'entity' END AS note_type, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS source_note,
      CASE WHEN doc_id % 7 = 3 THEN NULL ELSE source END AS item_key, lang AS library, CASE WHEN doc_id % 9 = 0 THEN concat('A', cast(doc_id % 40 AS varchar(20))) END AS annotation_key,
      CASE WHEN doc_id % 10 = 0 THEN concat('K', cast(doc_id AS varchar(20))) END AS custom_key, 1700000000000 + doc_id * 1000 AS created_at, 1700000000000 + doc_id * 1000 + doc_id * 7919 % 100000 AS updated_at FROM documents""",
    "v_unavailable": """SELECT lpad(cast(doc_id AS varchar(20)), 14, '0') AS card_id, CASE WHEN max(toxic) = 1 THEN 'trashed' ELSE 'missing' END AS state FROM labels
      WHERE toxic = 1 OR (quality = 0 AND doc_id % 5 = 0) GROUP BY doc_id""",
    "v_parents": """SELECT lpad(cast(doc_id AS varchar(20)), 14, '0') AS card_id, CASE WHEN doc_id > 0 THEN lpad(cast(cast(floor(doc_id / 3) AS bigint) AS varchar(20)), 14, '0') END AS parent_id FROM documents""",
    "v_link_rows": """SELECT doc_id, (doc_id * 31 + 7) % n AS target FROM documents CROSS JOIN (SELECT count(*) AS n FROM documents) c UNION SELECT doc_id, (doc_id * 17 + 3) % n AS target FROM documents CROSS JOIN (SELECT count(*) AS n FROM documents) c""",
    "v_links": """SELECT s.id AS source_id, CASE WHEN l.doc_id % 3 = 2 THEN NULL ELSE t.id END AS target_id, CASE l.doc_id % 3 WHEN 0 THEN t.title WHEN 1 THEN t.id ELSE concat('missing ', cast(l.target % 20 AS varchar(20))) END AS ref
      FROM v_link_rows l JOIN v_notes s ON s.doc_id = l.doc_id JOIN v_notes t ON t.doc_id = l.target WHERE l.doc_id <> l.target""",
    "v_tags": """SELECT id AS card_id, library AS tag FROM v_notes UNION SELECT id, item_key FROM v_notes WHERE item_key IS NOT NULL UNION SELECT id, split_part(title_folded, ' ', 1) FROM v_notes WHERE title_folded <> ''
      UNION SELECT lpad(cast(doc_id AS varchar(20)), 14, '0'), concat('q', cast(quality AS varchar(5))) FROM labels""",
    "v_card_notes": """SELECT id AS card_id, concat('N', cast(doc_id AS varchar(20))) AS note_key, doc_id % 3 AS library_id, CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END AS external FROM v_notes WHERE doc_id % 8 <> 7""",
    "v_note_states": """SELECT note_key, library_id, CASE WHEN library_id = 1 THEN '2026-01-02' ELSE '2026-01-01' END AS modified FROM v_card_notes WHERE external = 0""",
    # corpus: documents as title, abstract and body
    "v_corpus": """SELECT concat(lang, '/', lpad(cast(doc_id AS varchar(20)), 14, '0')) AS doc_key, doc_id, lang AS library, coalesce(split_part(text, chr(10), 1), '') AS title, coalesce(split_part(text, chr(10), 2), '') AS abstract,
      CASE WHEN strpos(text, chr(10)) > 0 AND strpos(substring(text, strpos(text, chr(10)) + 1), chr(10)) > 0 THEN substring(text, strpos(text, chr(10)) + 1 + strpos(substring(text, strpos(text, chr(10)) + 1), chr(10))) ELSE '' END AS body, n_chars < 200 AS weak, md5(text) AS hash FROM documents""",
    "v_linktext": """SELECT lpad(cast(doc_id AS varchar(20)), 14, '0') AS id, doc_id, concat(text, ' [[', cast((doc_id * 31 + 7) % 1000 AS varchar(20)), '|see also]] and [[note ', cast(doc_id % 13 AS varchar(20)), ']] [@key', cast(doc_id % 50 AS varchar(20)), '] https://example.org/', cast(doc_id AS varchar(20)),
      CASE WHEN doc_id % 4 = 0 THEN ' 机器学习方法与深度学习方法' ELSE '' END) AS text FROM documents""",
    "v_changes": """SELECT cast(cast(ts AS date) AS varchar(10)) AS batch, user_id, event_type, event_id FROM events""",
    "v_tag_names": """SELECT DISTINCT p_type AS name FROM part UNION SELECT DISTINCT p_brand FROM part UNION SELECT DISTINCT lower(replace(p_type, ' ', '-')) FROM part UNION SELECT DISTINCT concat(p_brand, 's') FROM part""",
    "v_usage": """SELECT l_partkey AS tag, l_orderkey AS item FROM lineitem""",
}


#: Rows and bytes that a task's Python gets at once; the defaults are too much for long texts.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 500, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH, unless they are smaller."""
    for key, most in BATCH.items():
        now = int(spark.conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a view, by name, with small_batches(). A view reads the columns it needs of the tables it names."""
    small_batches(spark)
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = re.sub(r"varchar\(\d+\)", "string", VIEWS[name]).replace("strpos(", "charindex_(")
    sql = re.sub(r"charindex_\(", "instr(", sql)
    needs = {n: load(spark, sf_dir, n) for n in (*BASE, *VIEWS) if re.search(rf"\b(?:FROM|JOIN) {n}\b", sql)}
    return spark.sql(re.sub(r"\b(FROM|JOIN) (\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in needs else m[0], sql), **needs)


def with_views(sql: str) -> str:
    """The query with the views it needs in front."""
    wanted: list[str] = []

    def need(text: str) -> None:
        for n in VIEWS:
            if re.search(rf"\b{n}\b", text) and n not in wanted:
                need(VIEWS[n])
                wanted.append(n)

    need(sql)
    if not wanted:
        return sql
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
    body = sql.strip()
    recursive = "RECURSIVE " if re.match(r"WITH RECURSIVE", body, re.I) else ""
    rest = re.sub(r"^WITH (RECURSIVE )?", ", ", body, flags=re.I) if re.match(r"WITH\b", body, re.I) else f" {body}"
    return f"WITH {recursive}{head}{rest}"
