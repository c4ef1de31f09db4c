"""Tables in versions: written aside, then published by one file.

A folder has ``data`` and ``commits``. A version's files go to data under a name of
their own; then the file ``commits/<number>`` is made, which fails if it is there
already. That one step publishes: readers take the highest number, so what a
writer left that died before it is never seen, and of two writers that began
from the same version one gets an error.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has published the version that was about to be."""


class Versions:
    """The versions of a folder that all executors and the driver see."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda x: jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{x}")
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._read = lambda stream: jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")

    def latest(self) -> tuple[int, dict]:
        """The number and content of the last version; 0 and nothing before the first."""
        top = self._path("commits")
        numbers = [int(x.getPath().getName()) for x in self._fs.listStatus(top) if x.getPath().getName().isdigit()] if self._fs.exists(top) else []
        return (n := max(numbers), self.content(n)) if numbers else (0, {})

    def content(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"commits/{number:012}"))
        try:
            return json.loads(self._read(stream))
        finally:
            stream.close()

    def publish(self, number: int, content: dict) -> None:
        """Makes ``content`` version ``number``. Content comes whole or not at all: a file of another name is moved, which fails where one is."""
        made, to = self._path(f"commits/.{uuid.uuid4().hex}"), self._path(f"commits/{number:012}")
        stream = self._fs.create(made, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        jvm = self.spark.sparkContext._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(made, to, none)
        except Py4JJavaError as e:
            self._fs.delete(made, False)
            raise Conflict(f"version {number} is there already") from e

    def aside(self) -> str:
        """A new place for data."""
        return f"{self.folder}/data/{uuid.uuid4().hex}"

    def drop(self, path: str) -> None:
        self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)


class BucketedTable:
    """A table by hash buckets of its key, of which an upsert writes those again that it touches."""

    def __init__(self, spark: SparkSession, folder: str, key: str, buckets: int = 256):
        self.versions, self.spark, self.key, self.buckets = Versions(spark, folder), spark, key, buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def rows(self, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The table, as of a version; of some buckets if ``only`` names them."""
        number, content = self.versions.latest() if version is None else (version, self.versions.content(version))
        if not number:
            raise FileNotFoundError(f"{self.versions.folder} has no version yet")
        schema = self.spark.createDataFrame([], content["schema"]).schema
        paths = [p for b, p in content["buckets"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def upsert(self, new: DataFrame, removed: DataFrame | None = None, before_publishing=None) -> int:
        """Puts the rows of ``new`` in place of those of the same key and takes the
        keys ``removed`` away; returns the number of buckets written. Of several
        new rows of one key one stays. Until the version is published the old one
        stands, whatever fails; rows in untouched buckets aren't read."""
        number, content = self.versions.latest()
        new = new.dropDuplicates([self.key])
        gone = new.select(self.key) if removed is None else new.select(self.key).union(removed.select(self.key)).distinct()
        touched = {r[0] for r in gone.select(self._bucket()).distinct().collect()}  # at most the number of buckets
        if not touched:
            return 0
        if removed is not None:
            new = new.join(removed.select(self.key).distinct(), self.key, "left_anti")
        out = new
        if number:
            old = self.rows(number, touched)
            out = old.join(gone, self.key, "left_anti").unionByName(new.select(*old.columns))
        to = self.versions.aside()
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
        parts = max(1, len(touched))
        out.withColumn("__bucket", self._bucket()).repartition(parts, "__bucket").write.partitionBy("__bucket").parquet(to)
        if before_publishing:
            before_publishing()
        kept = {b: p for b, p in content.get("buckets", {}).items() if int(b) not in touched}
        written = {str(b) for b in touched if self.versions._fs.exists(self.versions._path(f"{to.removeprefix(self.versions.folder)[1:]}/__bucket={b}"))}
        self.versions.publish(number + 1, {"schema": content.get("schema", schema), "buckets": kept | {b: f"{to}/__bucket={b}" for b in written}})
        return len(touched)
