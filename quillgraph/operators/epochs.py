"""Frozen statistics of a corpus.

Weights depend on how many documents there are, how long their fields are and how
many hold each feature. An epoch keeps these as they were when it began, so that
a changed document moves its own weights only; when enough has changed, a new
epoch is made and published at once. If the data's revision moved meanwhile, it
is given up and the old one stands.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import without_shuffles
from ..sources.versions import Conflict, Versions
from . import weighing
from .lexical import by_document, document_frequencies, field_averages, saturated
from .upkeep import epoch_due


class Epoch:
    """averages (one row) and frequencies (feature, df) of a moment, and its number."""

    def __init__(self, number: int, averages: DataFrame, frequencies: DataFrame, n_docs: int, revision: int):
        self.number, self.averages, self.frequencies, self.n_docs, self.revision = number, averages, frequencies, n_docs, revision


class Epochs:
    """The epochs kept in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.versions = spark, Versions(spark, folder)

    def current(self) -> Epoch | None:
        number, x = self.versions.latest()
        if not number:
            return None
        read = self.spark.read.parquet
        return Epoch(number, read(f"{x['path']}/averages"), read(f"{x['path']}/frequencies"), x["n_docs"], x["revision"])

    def due(self, changes: int) -> bool:
        """Whether so many changed documents since the present epoch call for another."""
        now = self.current()
        return epoch_due(now.n_docs if now else 0, changes, now is not None)

    def rebuild(self, corpus: DataFrame, counted: DataFrame | weighing.Statistics, revision: Callable[[], int]) -> Epoch | None:
        """Makes an epoch of the corpus as it is and publishes it; None if the data's
        revision moved meanwhile or another epoch came first. counted: its counts, or
        their Statistics."""
        began, (number, _) = revision(), self.versions.latest()
        to = self.versions.aside()
        known = isinstance(counted, weighing.Statistics)
        with without_shuffles(self.spark):
            (counted.averages if known else field_averages(corpus, counted)).write.parquet(f"{to}/averages")
            (counted.frequencies if known else document_frequencies(counted)).write.option("compression", "zstd").parquet(f"{to}/frequencies")
        if revision() != began:
            self.versions.drop(to)
            return None
        n_docs = self.spark.read.parquet(f"{to}/averages").first()["n_docs"]
        try:
            self.versions.publish(number + 1, {"path": to, "n_docs": n_docs, "revision": began})
        except Conflict:
            self.versions.drop(to)
            return None
        return self.current()


def weights(counted: DataFrame, epoch: Epoch) -> DataFrame:
    """doc_key, feature, weight and in_title of documents (counted, by document
    or by field) by the epoch's statistics; a feature that it hasn't seen counts
    as one in no document. Nothing of other documents is read."""
    df = F.coalesce("df", F.lit(0))
    idf = F.ln(1 + (F.greatest(F.col("n_docs") - df, F.lit(0)) + 0.5) / (df + 0.5))
    rows = saturated(by_document(counted), epoch.averages).join(epoch.frequencies, "feature", "left")
    return rows.select("doc_key", "feature", (idf * F.col("x") * 2.2 / (F.col("x") + 1.2)).alias("weight"), "in_title")


def totals(corpus: weighing.Corpus, blocks: DataFrame, epoch: Epoch) -> DataFrame:
    """weighing.TOTALS of the documents' weights by the epoch's statistics; blocks: those of the corpus."""
    row = epoch.averages.first()
    return corpus.weighed(corpus.answers(blocks, epoch.frequencies), [row.avg0, row.avg1, row.avg2], row.n_docs, weighing.totals_of, weighing.TOTALS)
