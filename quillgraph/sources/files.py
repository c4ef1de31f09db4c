"""Files as sources and sinks: full texts, term catalogues, exports, indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tagging import Terms

FULL_TEXT, LEAST_TEXT = 1_200_000, 40


def full_texts(spark: SparkSession, path: str, most: int = FULL_TEXT) -> DataFrame:
    """path and text of the text files under a folder, the beginning of very
    long ones; files of fewer than LEAST_TEXT characters are left out."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.substring("value", 1, most).alias("text"))
    return rows.where(F.length(F.trim("text")) >= LEAST_TEXT)


def with_fallback(items: DataFrame, texts: DataFrame) -> DataFrame:
    """key, text, hash and weak of items (key, title, abstract, creators): the
    first full text by rank (key, rank, text), else title, abstract and creators."""
    best = texts.where(F.length(F.trim("text")) >= LEAST_TEXT).groupBy("key").agg(F.min_by("text", "rank").alias("full"))
    about = F.concat_ws("\n", "title", "abstract", F.array_join("creators", "\n"))
    rows = items.join(best, "key", "left").withColumn("text", F.coalesce("full", about))
    return rows.select("key", "text", F.md5(F.col("text").cast("binary")).alias("hash"), F.col("full").isNull().alias("weak"))


def terms_from_json(spark: SparkSession, path: str) -> Terms:
    """A catalogue of spellings and aliases, a few hundred at most; conflicts are errors."""
    row = spark.read.json(path, multiLine=True).first()
    return Terms.of(list(row["spellings"]), [a.asDict() for a in row["aliases"]])


def export_outline(notes: DataFrame, path: str) -> None:
    """A line of JSON after '- ' for each note."""
    notes.select(F.concat(F.lit("- "), F.to_json(F.struct(*notes.columns)))).write.mode("overwrite").text(path)


def write_index(rows: DataFrame, path: str, by: str) -> None:
    """An index table, clustered by a column so that readers of a few of its values skip most files."""
    rows.repartitionByRange(by).sortWithinPartitions(by).write.mode("overwrite").parquet(path)


def unused_assets(spark: SparkSession, folder: str, refs: DataFrame) -> DataFrame:
    """path and name of the files under a folder that no ref (name) names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
    return files.join(refs.select("name"), "name", "left_anti").select("path", "name")
