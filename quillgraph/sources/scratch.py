"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders that materialize() has written in the scopes that are open.
_open_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only on a single machine, where none is named."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillgraph-"))
        named = sc.getCheckpointDir()
    return named


#: Whether the shuffle files of a query go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def without_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for the queries in it goes when each has ended. Only for those that nobody reads again, as writing is."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again: a cut in the lineage
    that outlives any executor. What was shuffled for it goes at once."""
    path = f"{shared_dir(df.sparkSession)}/quillgraph-{uuid.uuid4().hex}"
    with without_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    for scope in _open_scopes:
        scope.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Removes, at its end, the folders that materialize() wrote in it. Take those
    that are still needed out of the list."""
    paths: list[str] = []
    _open_scopes.append(paths)
    try:
        yield paths
    finally:
        _open_scopes.remove(paths)
        for p in paths:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
