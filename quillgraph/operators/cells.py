"""Exact nearest vectors through cells, by the triangle inequality of angles.

Vectors lie in cells around members drawn by a hash, about the square root of
their number; a cell knows the greatest angle between its centre and a member.
No member of a cell is nearer to a query than the angle to the centre less that
radius. A query first reads the cells that may be nearest, SEEDS vectors or a
little more; the k-th best of them is a floor. Then it reads, of the cells that
can still reach the floor, the rings that can: members whose own angle differs
from the query's by no more than the floor's angle. So the result is that of
comparing all.

Only centres go to all tasks: CENTRES at most of each library, and LIBRARIES of
them; what lies in other libraries is one cell there, its angle unknown, and read
whole. Cells are cut into chunks, so none is one task's.

Cases: vectors that are null, without length or not finite, and those of a null
library, are nowhere and find nothing; a query is not its own neighbour; ties by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .dense import checked, dot, unit

CENTRES, LIBRARIES = 512, 64
#: Vectors that a query compares for its floor, in multiples of k.
SEEDS = 4
CHUNK = 4_096
#: Angles of double precision are right to about this.
SLACK = 1e-6


class Cells:
    """members (key, library, cell, chunk, angle, v), sizes (library, cell, chunks, n, radius), and the centres (library, cell, vector)."""

    def __init__(self, members: DataFrame, sizes: DataFrame, centres: list[tuple[str, int, list[float]]]):
        self.members, self.sizes, self.centres = members, sizes, centres


def angles_to(spark, centres: list[tuple[str, int, list[float]]]):
    """Broadcast of each library's centres: cells and a matrix."""
    by: dict[str, tuple[list[int], list[list[float]]]] = {}
    for library, cell, v in centres:
        ids, rows = by.setdefault(library, ([], []))
        ids.append(cell)
        rows.append(v)
    return spark.sparkContext.broadcast({k: (np.array(i), np.array(m)) for k, (i, m) in by.items()})


def build(vectors: DataFrame) -> Cells:
    """The cells of vectors (key, library, vector)."""
    spark = vectors.sparkSession
    rows = vectors.select("key", F.col("library").cast("string").alias("library"), unit("vector").alias("v")).where("v is not null and library is not null")
    large = rows.groupBy("library").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "library").limit(LIBRARIES)
    share = F.least(F.lit(float(CENTRES)), F.ceil(F.sqrt("n"))) / F.col("n")
    drawn = rows.join(F.broadcast(large), "library").where(F.xxhash64(F.col("key"), F.lit(7)).bitwiseAND((1 << 52) - 1) / float(1 << 52) < share)
    place = F.row_number().over(Window.partitionBy("library").orderBy(F.xxhash64("key"), "key"))
    drawn = drawn.select("library", "v", place.alias("cell")).where(F.col("cell") <= 2 * CENTRES)
    centres = [(r.library, r.cell, r.v) for r in drawn.collect()]
    sent = angles_to(spark, centres)
    kind = dict(rows.dtypes)["key"]

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            cell, angle = np.zeros(len(x), np.int32), np.full(len(x), np.nan)
            for library, at in x.groupby("library").indices.items():
                if library in sent.value:
                    ids, m = sent.value[library]
                    cos = np.stack(x["v"].to_numpy()[at]) @ m.T
                    best = cos.argmax(1)
                    cell[at], angle[at] = ids[best], np.arccos(np.clip(cos[np.arange(len(at)), best], -1, 1))
            yield pd.DataFrame({"key": x["key"], "library": x["library"], "cell": cell, "angle": angle, "v": x["v"]})

    members = materialize(rows.mapInPandas(assign, f"key {kind}, library string, cell int, angle double, v array<double>"))
    sizes = members.groupBy("library", "cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    sizes = materialize(sizes.withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int")))
    members = members.join(sizes.where("chunks > 1").select("library", "cell", "chunks"), ["library", "cell"], "left")
    members = materialize(members.withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("key"), F.col("chunks")), F.lit(0)).cast("int")).drop("chunks"))
    return Cells(members, sizes, centres)


def asked(cells: Cells, queries: DataFrame) -> DataFrame:
    """query, library, cell, centre_angle of each query and each cell of its library that has a centre."""
    sent = angles_to(queries.sparkSession, cells.centres)
    kind = dict(queries.dtypes)["query"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            for query, library, q in zip(x["query"], x["library"], x["q"]):
                if library in sent.value:
                    ids, m = sent.value[library]
                    yield pd.DataFrame({"query": query, "library": library, "cell": ids.astype(np.int32), "centre_angle": np.arccos(np.clip(m @ np.asarray(q), -1, 1))})

    return queries.mapInPandas(run, f"query {kind}, library string, cell int, centre_angle double")


def compared(planned: DataFrame, queries: DataFrame, cells: Cells) -> DataFrame:
    """query, key and score of the members of the planned cells (query, library, cell, chunks, low, high: the ring)."""
    rows = planned.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).join(queries, ["query", "library"])
    rows = rows.join(cells.members, ["library", "cell", "chunk"]).where("key != query").where("low is null or angle is null or (angle >= low and angle <= high)")
    return rows.select("query", "key", F.least(F.lit(1.0), dot("v", "q")).alias("score")).where("score > 0")


def nearest(cells: Cells, queries: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """query, key, score and place: the k nearest to each query (key, library,
    vector) in its library, of positive cosine, 1 at most; and the plan, cells with ``read``."""
    checked(k)
    q = materialize(queries.select(F.col("key").alias("query"), F.col("library").cast("string").alias("library"), unit("vector").alias("q")).where("q is not null and library is not null"))
    near = asked(cells, q)
    rows = q.select("query", "library").join(cells.sizes, "library").join(near, ["query", "library", "cell"], "left")
    # an unknown angle may be none at all
    rows = materialize(rows.withColumn("gap", F.coalesce(F.greatest(F.col("centre_angle") - F.col("radius"), F.lit(0.0)), F.lit(0.0))))
    before = Window.partitionBy("query").orderBy("gap", "centre_angle", "cell").rowsBetween(Window.unboundedPreceding, -1)
    free = [F.lit(None).cast("double").alias(c) for c in ("low", "high")]
    seeds = rows.withColumn("upto", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("upto") < SEEDS * k)
    first = compared(seeds.select("query", "library", "cell", "chunks", *free), q, cells)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    floor = first.withColumn("place", F.row_number().over(best)).where(F.col("place") == k).select("query", (F.acos("score") + SLACK).alias("reach"))
    # without k neighbours yet, whoever is nearer than a right angle counts
    told = rows.join(floor, "query", "left").withColumn("reach", F.coalesce("reach", F.lit(np.pi / 2)))
    told = materialize(told.withColumn("read", F.col("gap") <= F.col("reach")))
    ring = [(F.col("centre_angle") - F.col("reach")).alias("low"), (F.col("centre_angle") + F.col("reach")).alias("high")]
    found = compared(told.where("read").select("query", "library", "cell", "chunks", *ring), q, cells)
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k), told
