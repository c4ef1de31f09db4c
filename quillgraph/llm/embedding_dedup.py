"""Embedding near-duplicates by an inverted multi-index.

Vectors are scaled to length 1 and cut into halves; each half has a codebook of
its own, fitted by k-means on a bounded sample, and the codebooks' product is a
grid of cells, so many that ``per_cell`` vectors fall in one on average (as far
as the sample can tell centroids apart). Every vector is filed in one cell. As a
query it visits cells by the multi-sequence traversal, in the order of a lower
bound of the distance: for each half, how far the query's half is from the region
of the cell's centroid (from the plane between that centroid and its own), the
two squared and added. The traversal ends at the target recall: at the bound
within which that share of the true partners of ``probes`` vectors lies, of all
their partners and of a probe's partners on average. These partners are found by
comparing the probes, a stated query set of fixed size, with all vectors. Beyond
the squared distance 2 - 2 * least no cell can hold a partner; recall 1 goes so
far, and so does a table in which the probes have too few partners to tell.
Cells are then verified in double precision.

Crowded cells are cut in blocks of members and of queries, so a task
compares two bounded blocks; a block gives each vector its number of partners
there and one edge to its component's least member, never all pairs.

Cases: a vector that is null, of length zero or has a null or non-finite
component, and one whose label is null, links with nothing; vectors of other
dimensions than the most common one are compared among themselves; rows with
equal vec_id are vectors of their own with the same component; an empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, materialize, table

SLACK = 1e-9


def sound(rows: DataFrame) -> DataFrame:
    """With able: whether the row can link."""
    x = F.col("embedding")
    finite = lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v)
    able = F.col("label").isNotNull() & F.forall(x, finite) & F.exists(x, lambda v: v != 0)
    return rows.withColumn("able", F.coalesce(able, F.lit(False)))


def units(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


class Codebooks:
    """A codebook for each half, and for each query the lower bounds of its distance to the centroids' regions."""

    def __init__(self, sample: np.ndarray, k: int, rounds: int = 12, seed: int = 5):
        self.cut = sample.shape[1] // 2
        rng = np.random.default_rng(seed)
        self.books = [self.fit(part, k, rounds, rng) for part in self.halves(sample)]

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, : self.cut], x[:, self.cut :]]

    @staticmethod
    def fit(x, k, rounds, rng):
        x = np.unique(x, axis=0)
        c = x[rng.permutation(len(x))[:k]]
        for _ in range(rounds):
            own = squared(x, c).argmin(1)
            n = np.bincount(own, minlength=len(c))
            sums = np.zeros_like(c)
            np.add.at(sums, own, x)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        return np.unique(c, axis=0)

    def nearest(self, x: np.ndarray) -> list[np.ndarray]:
        return [squared(part, c).argmin(1) for part, c in zip(self.halves(x), self.books)]

    def bounds(self, x: np.ndarray) -> list[np.ndarray]:
        """Squares of lower bounds: the farthest plane between a centroid and the query's nearest."""
        out = []
        for part, c in zip(self.halves(x), self.books):
            d = squared(part, c)
            near = d.argmin(1)
            apart = np.sqrt(squared(c, c))[near]
            plane = (d - d[np.arange(len(d)), near][:, None]) / np.maximum(2 * apart, 1e-12)
            plane[np.arange(len(d)), near] = 0
            out.append(np.maximum(plane, 0) ** 2)
        return out

    def visits(self, x: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
        """Multi-sequence traversal: rows of x and the cells they visit, for each
        row in the order of the bounds' sum, up to most. Of each place in the
        first sequence it keeps the next place in the second, and takes the
        least of these sums in each step."""
        a, b = self.bounds(x)
        ia, ib = a.argsort(1, kind="stable"), b.argsort(1, kind="stable")
        a, b = np.take_along_axis(a, ia, 1), np.take_along_axis(b, ib, 1)
        going = np.arange(len(x))
        upto = (a <= most).sum(1).max() if len(x) else 0  # beyond, a sum can't be small enough
        a, ia = a[:, :upto], ia[:, :upto]
        b = np.concatenate((b, np.full((len(b), 1), np.inf)), 1)
        place = np.zeros(a.shape, np.int64)
        front = a + b[:, :1]
        rows, cells = [], []
        while len(going):
            k = front.argmin(1)
            at = np.arange(len(going))
            still = front[at, k] <= most
            if not still.all():
                going, k, front, place = going[still], k[still], front[still], place[still]
                at = at[: len(going)]
                if not len(going):
                    break
            j = place[at, k]
            rows.append(going)
            cells.append(ia[going, k] * len(self.books[1]) + ib[going, j])
            place[at, k] = j + 1
            front[at, k] = a[going, k] + b[going, j + 1]
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows, cells = np.concatenate(rows), np.concatenate(cells)
        order = np.argsort(rows, kind="stable")
        return rows[order], cells[order]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def classes(rows: DataFrame) -> DataFrame:
    """One row for the equal vectors of a label: c (least vec_id), n, dims, embedding."""
    return rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("c"), F.count("*").alias("n")).withColumn("dims", F.size("embedding"))


def measured_reach(own: DataFrame, books: Codebooks, probes: tuple, least: float, recall: float, bins: int = 256, fewest: int = 200) -> float:
    """The bound within which the share recall of the probes' partners in own
    lies. probes: labels, classes and unit vectors."""
    top = 2 - 2 * least + SLACK
    if recall >= 1 or not len(probes[0]):
        return top
    shared = own.sparkSession.sparkContext.broadcast((books, probes))

    def run(batches):
        books, (labels, ids, vectors) = shared.value
        bounds = books.bounds(vectors)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = units(matrix(part.column("embedding")))
                label, c = np.array(part.column("label").to_pylist(), object), part.column("c").to_numpy()
                q, m = np.nonzero((vectors @ x.T >= least) & (labels[:, None] == label) & (ids[:, None] != c))
                one, two = books.nearest(x)
                far = bounds[0][q, one[m]] + bounds[1][q, two[m]]
                kinds, n = np.unique(np.stack((q, np.minimum(np.ceil(far / top * bins), bins).astype(np.int64)), 1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds[:, 0]), pa.array(kinds[:, 1]), pa.array(n)], names=["probe", "bin", "n"])

    # at most a row for each probe and bin
    found = own.select("label", "c", "embedding").mapInArrow(run, "probe long, bin long, n long").groupBy("probe", "bin").agg(F.sum("n").alias("n")).toPandas()
    if found.n.sum() < fewest:
        return top
    table = found.pivot_table(index="probe", columns="bin", values="n", fill_value=0).reindex(columns=range(bins + 1), fill_value=0).to_numpy(float)
    within = table.cumsum(1)
    share = np.minimum((within / within[:, -1:]).mean(0), within.sum(0) / table.sum())
    return float(np.flatnonzero(share >= recall)[0] * top / bins) + SLACK


def linked(cells: DataFrame, least: float, block: int) -> DataFrame:
    """c, n_links and edge: for each block a class has partners in, how many
    vectors they are and the least class of the block's component."""
    size = cells.groupBy("label", "cell", "role").agg(F.count("*").alias("m")).groupBy("label", "cell").pivot("role", [0, 1]).agg(F.max("m"))
    size = size.where("`0` > 0 and `1` > 0").select("label", "cell", F.ceil(F.col("0") / block).cast("int").alias("queries"), F.ceil(F.col("1") / block).cast("int").alias("members"))
    x = cells.join(size, ["label", "cell"])
    own = F.when(F.col("role") == 0, F.pmod(F.xxhash64("c"), F.col("queries"))).otherwise(F.pmod(F.xxhash64("c"), F.col("members"))).cast("int")
    other = F.when(F.col("role") == 0, F.col("members")).otherwise(F.col("queries"))
    x = x.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), other - 1)))
    x = x.withColumn("qb", F.when(F.col("role") == 0, F.col("own")).otherwise(F.col("other"))).withColumn("mb", F.when(F.col("role") == 0, F.col("other")).otherwise(F.col("own")))

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        q, m = pdf[pdf.role == 0], pdf[pdf.role == 1]
        if not len(q) or not len(m):
            return pd.DataFrame({"c": [], "n_links": [], "edge": []})
        a, b = units(np.stack(q.embedding.values)), units(np.stack(m.embedding.values))
        qi, mi = q.c.to_numpy(), m.c.to_numpy()
        near = a @ b.T
        for i, j in zip(*np.nonzero(np.abs(near - least) < 1e-12)):  # where rounding could decide
            near[i, j] = math.fsum(a[i] * b[j])
        hit = (near >= least) & (qi[:, None] != mi)
        n = (hit * m.n.to_numpy()).sum(1)
        some = np.flatnonzero(hit.any(1))
        if not len(some):
            return pd.DataFrame({"c": [], "n_links": [], "edge": []})
        hit, mine, n = hit[some], qi[some].copy(), n[some]
        theirs = mi.copy()
        top = np.iinfo(np.int64).max
        while True:  # least label over the links, until it stays
            down = np.minimum(theirs, np.where(hit, mine[:, None], top).min(0))
            up = np.minimum(mine, np.where(hit, down, top).min(1))
            if (down == theirs).all() and (up == mine).all():
                break
            mine, theirs = up, down
        touched = hit.any(0)
        return pd.DataFrame({"c": np.r_[qi[some], mi[touched]], "n_links": np.r_[n, np.zeros(touched.sum(), np.int64)], "edge": np.r_[mine, theirs[touched]]})

    return x.select("label", "cell", "qb", "mb", "role", "c", "n", "embedding").groupBy("label", "cell", "qb", "mb").applyInPandas(verify, "c long, n_links long, edge long")


def near_duplicates(rows: DataFrame, least: float = 0.93, recall: float = 0.999, sample: int = 20_000, probes: int = 256, per_cell: int = 256, block: int = 1024) -> DataFrame:
    """vec_id, n_links and component_id of every row (vec_id, embedding, label).
    The codebooks are fitted on about sample vectors, chosen by a hash, and the
    reach of the traversal is measured for some of them as probes."""
    spark = rows.sparkSession
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    rows = sound(rows)
    able = rows.where("able")
    found = materialize(classes(able))
    parts = []
    for r in found.groupBy("dims").count().orderBy("dims").collect():  # usually one
        own = found.where(F.col("dims") == r["dims"]).select("label", "c", "n", "embedding")
        share = min(1.0, sample / r["count"])
        picked = own.select("label", "c", "embedding")
        some = picked.where(F.pmod(F.xxhash64("embedding"), F.lit(1_000_003)) <= share * 1_000_003).limit(2 * sample).toPandas()
        some = (some if len(some) else picked.limit(1).toPandas()).sort_values("c")
        x = units(np.stack(some.embedding.values))
        # 20 vectors of the sample for each centroid at least
        k = int(min(max(16, (r["count"] / per_cell) ** 0.5), max(16, len(x) // 20)))
        books = Codebooks(x, k)
        few = np.random.default_rng(3).permutation(len(x))[:probes]
        most = measured_reach(own, books, (some.label.to_numpy(object)[few], some.c.to_numpy()[few], x[few]), least, recall)
        shared = spark.sparkContext.broadcast((books, most))

        def filed(batches, shared=shared):
            books, most = shared.value
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    part = b.slice(at, 1024)
                    x = units(matrix(part.column("embedding")))
                    one, two = books.nearest(x)
                    for role, (take, cell) in ((1, (np.arange(len(x)), one * len(books.books[1]) + two)), (0, books.visits(x, most))):
                        p = part.take(pa.array(take))
                        yield pa.RecordBatch.from_arrays([p.column("label"), pa.array(cell.astype(np.int32)), pa.array(np.full(len(take), role, np.int32)), p.column("c"), p.column("n"), p.column("embedding")], names=["label", "cell", "role", "c", "n", "embedding"])

        kinds = dict(found.dtypes)
        cells = own.mapInArrow(filed, f"label {kinds['label']}, cell int, role int, c long, n long, embedding {kinds['embedding']}")
        parts.append(linked(cells, least, block))
    if not parts:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    links = materialize(reduce(DataFrame.union, parts))
    partners = links.groupBy("c").agg(F.sum("n_links").alias("partners"))
    comps = components(links.where("c != edge").select(F.col("c").alias("a"), F.col("edge").alias("b"))).withColumnRenamed("node", "c")
    of = found.select("label", "embedding", "c", "n").join(partners, "c", "left").join(comps, "c", "left")
    of = of.select("label", "embedding", (F.col("n") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links"), F.coalesce("component", "c").alias("component_id"))
    mine = able.select("vec_id", "label", "embedding").join(of, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("able")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return mine.union(alone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


#: Brute force over the pairs of a label; right, and quick on small tables only.
ORACLE_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE label IS NOT NULL),
n AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS len FROM e),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_dot_product(a.v, b.v) >= 0.93 * a.len * b.len),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a),
d AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(d.n, 0) AS n_links, least(vec_id, coalesce(c.b, vec_id)) AS component_id, least(vec_id, coalesce(c.b, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN d ON d.a = vec_id
"""
