"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import materialize, scope, shared_dir  # noqa: F401
from ..sources.tables import BATCH, small_batches  # noqa: F401

#: A word is a run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, read with small_batches()."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_batch(df: DataFrame, schema: str, f: Callable[[dict[str, list]], dict[str, list]], make=None, to_py=True) -> DataFrame:
    """Applies f to each Arrow batch's columns (lists, or Arrow arrays) and
    returns the columns it makes. ``make`` builds f once a task, so that f can
    keep caches."""
    names = [x.strip().split(" ", 1) for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = make() if make else f
        for b in batches:
            if not b.num_rows:
                continue
            cols = {n: (b.column(i).to_pylist() if to_py else b.column(i)) for i, n in enumerate(b.schema.names)}
            out = g(cols)
            yield pa.RecordBatch.from_arrays([_array(out[n], t) for n, t in names], names=[n for n, _ in names])

    return df.mapInArrow(run, schema)


def filtered(df: DataFrame, names: list[str], make: Callable) -> DataFrame:
    """The rows of df, whatever their other columns, for which the function that
    make() builds for each task says true; it gets lists of the named columns."""
    at = [df.columns.index(n) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(keep(*[b.column(i).to_pylist() for i in at]), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def appended(df: DataFrame, names: list[str], schema: str, make: Callable) -> DataFrame:
    """All columns of df and then those of schema, made by make() as in filtered()."""
    at = [df.columns.index(n) for n in names]
    new = [x.strip().split(" ", 1) for x in schema.split(",")]
    whole = T.StructType([*df.schema.fields, *T._parse_datatype_string(schema).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            if b.num_rows:
                made = [_array(x, kind) for x, (_, kind) in zip(f(*[b.column(i).to_pylist() for i in at]), new)]
                yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, *[n for n, _ in new]])

    return df.mapInArrow(run, whole)


def _array(x, kind: str):
    if isinstance(x, pa.Array):
        return x
    return pa.array(x, type=ARROW[kind.strip()])


ARROW = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "float": pa.float32(),
    "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()), "array<float>": pa.list_(pa.float32()),
}


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component (its least node) of the nodes in links (a, b: longs).

    Alternates large-star and small-star steps: every node hands its larger
    neighbours, then its smaller ones, to the least of its neighbourhood. Each
    step is a minimum by node and a join, which spreads a node of very many
    links; the links go through the shared folder after each round. Links end as
    stars around the least node of each component.
    """
    links = links.where("a is not null and b is not null and a != b")
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    told = lambda rows: rows.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    state = told(edges)
    for _ in range(rounds):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > u and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u")).select(F.when(F.col("b") == F.col("m"), F.col("u")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        edges = materialize(small)
        now = told(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
