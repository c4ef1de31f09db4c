"""From documents to a training mix: five stages, each an operator of quillgraph.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import common, decontamination, language_id, line_dedup, mixing, ngram_join

#: Each takes (spark, docs, sf_dir); all but the last return the columns of documents; the last cuts their texts into the rows of the mix.
STAGES = [
    ("language_id", language_id.stage),
    ("line_dedup", line_dedup.stage),
    ("ngram_join", ngram_join.stage),
    ("decontamination", decontamination.stage),
    ("mixing", mixing.stage),
]

#: Language models, shingle links and alignments are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what each returns is written as Parquet and read by the next."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        with common.scope(spark) as written:  # what a stage wrote on its way goes when its result is there
            docs = common.materialize(stage(spark, docs, sf_dir))
            own = written.pop()
            written += [before] if before else []
        before = own
    return docs
