"""Merkle manifest of a dataset: leaves, subroots by source, a root, and a proof of each row.

A row's leaf is the digest of its fields. Within a source leaves ascend by
doc_id; runs of 16 consecutive nodes become one, again and again, until one is
left, the source's subroot (a lone leaf is its own). The subroots, by source,
become the root in the same way.

Broadcast upper-tree variant. Rows are thinned to (source, doc_id, leaf), sorted
by range and numbered without any task that sees a whole source: a number is the
row's place in its partition less the source's first place there, plus what
partitions before hold of the source. Executors reduce blocks of 256 consecutive
nodes to one, in rounds (256, 65,536, ... leaves), until at most TOP nodes are
left of all sources that have more than one. The driver builds that top tree and
broadcasts, for each of its nodes, the siblings on the way up: at most 12 MB,
whatever the data. On the way back each round appends the suffix to the siblings
inside its blocks, and executors digest each row's proof and fold it.

The tree of the subroots is the same operator applied to one row for each source,
so that many sources are no burden for the driver either.

Cases: nulls are fields of their own (``-``); a null source is one more source, the
first; a null doc_id sorts first; rows that agree in doc_id are ordered by leaf,
equal rows stand next to each other and have a proof each; an empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

FAN = 16
#: Levels that one round of blocks reduces.
LEVELS = 2
BLOCK = FAN**LEVELS
#: Nodes that the driver may build the top tree of.
TOP = 4_096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SIDES = "array<struct<l:string,r:string>>"


def field(c: Column) -> Column:
    """``-`` if null, else the UTF-8 byte count, ``:`` and the value."""
    c = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def numbered(nodes: DataFrame) -> DataFrame:
    """nodes (g, k: the order within g; node; more) with pos, the place within g from 0, and n, how many g has."""
    # equal keys are told apart by where they are read, so that they too spread over partitions
    nodes = materialize(nodes).withColumn("__m", F.monotonically_increasing_id())
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("g", "k", "node", "__m")
    dealt = materialize(nodes.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))
    part, place = F.shiftright("__m", 33), F.col("__m").bitwiseAND((1 << 33) - 1)
    dealt = dealt.withColumn("__part", part).withColumn("__place", place)
    # a row for each partition, and one more for each source
    runs = dealt.groupBy("g", "__part").agg(F.min("__place").alias("__first"), F.count("*").alias("__n"))
    so_far = F.sum("__n").over(Window.partitionBy("g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("g", "__part", (F.coalesce(so_far, F.lit(0)) - F.col("__first")).alias("__before"), F.sum("__n").over(Window.partitionBy("g")).alias("n"))
    return dealt.join(runs, ["g", "__part"]).withColumn("pos", F.col("__place") + F.col("__before")).drop("__m", "__part", "__place", "__first", "__before")


def blocks(nodes: DataFrame) -> DataFrame:
    """g, block, n, the nodes of each block as rows (array of structs), and levels: the digests of its own and of each level above, as far as this round goes."""
    rest = [c for c in nodes.columns if c not in ("g", "n", "pos")]
    found = nodes.groupBy("g", F.floor(F.col("pos") / BLOCK).alias("block"), "n").agg(F.array_sort(F.collect_list(F.struct("pos", *rest))).alias("rows"))
    found = found.withColumn("__0", F.col("rows.node"))
    for k in range(LEVELS):
        below = F.col(f"__{k}")
        runs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / FAN).cast("int"))
        above = F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(below, i * FAN + 1, FAN), ""), 256))
        # a group within one block ends as soon as one node is left
        found = found.withColumn(f"__{k + 1}", F.when((F.col("n") <= BLOCK) & (F.size(below) <= 1), F.array().cast("array<string>")).otherwise(above))
    tops = F.filter(F.array(*[F.col(f"__{k}") for k in range(LEVELS + 1)]), lambda x: F.size(x) > 0)
    return found.select("g", "block", "n", "rows", tops.alias("levels"), F.get(F.element_at(tops, -1), F.lit(0)).alias("top"))


def sides_within(levels: Column, at: Column) -> Column:
    """The siblings of the node at place ``at`` of the block's first level, level by level below the top."""

    def side(x: Column, k: Column) -> Column:
        place = F.floor(at / F.pow(F.lit(float(FAN)), k)).cast("int")
        first = (F.floor(place / FAN) * FAN).cast("int")
        return F.struct(F.array_join(F.slice(x, first + 1, place - first), "").alias("l"), F.array_join(F.slice(x, place + 2, first + FAN - 1 - place), "").alias("r"))

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), side)


def top_tree(roots: list[tuple[str, int, str]]) -> list[tuple[str, int, list[tuple[str, str]], str]]:
    """For each (g, pos, digest), sorted: g, pos, the siblings on the way up, and g's last node. At most TOP of them."""
    by: dict[str, list[str]] = {}
    for g, _, x in roots:
        by.setdefault(g, []).append(x)
    out = []
    for g, nodes in by.items():
        paths: list[list[tuple[str, str]]] = [[] for _ in nodes]
        at = list(range(len(nodes)))
        while len(nodes) > 1:
            for i, k in enumerate(at):
                first = k - k % FAN
                paths[i].append(("".join(nodes[first:k]), "".join(nodes[k + 1 : first + FAN])))
                at[i] = k // FAN
            nodes = [hashlib.sha256("".join(nodes[i : i + FAN]).encode()).hexdigest() for i in range(0, len(nodes), FAN)]
        out += [(g, i, p, nodes[0]) for i, p in enumerate(paths)]
    return out


def climbed(nodes: DataFrame, top: int = TOP) -> DataFrame:
    """The nodes (g: group, a string; k: its order in the group; node: its digest;
    more) in blocks: g, rows, levels, suffix (the siblings from the block's top on,
    an array of left and right sides) and root, the group's last node."""
    spark = nodes.sparkSession
    rounds, level = [], numbered(nodes).drop("k")
    while True:
        rounds.append(level := materialize(blocks(level)))
        level = level.where(f"n > {BLOCK}").select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("node"))
        if (left := level.count()) <= top:
            break
    found = top_tree(sorted((r.g, r.pos, r.node) for r in level.select("g", "pos", "node").collect())) if left else []
    suffix = F.broadcast(spark.createDataFrame(found, f"g string, block long, suffix {SIDES}, last string"))
    for k in reversed(range(len(rounds))):
        x = rounds[k].join(suffix, ["g", "block"], "left").select("g", "levels", "rows", F.coalesce("suffix", F.array().cast(SIDES)).alias("suffix"), F.coalesce("last", "top").alias("root"))
        if k:
            suffix = single(x).select("g", F.col("row.pos").alias("block"), F.col("path").alias("suffix"), F.col("root").alias("last"))
    return x


def single(x: DataFrame) -> DataFrame:
    """climbed()'s blocks as rows: g, row, path (all siblings on the way to the root) and root."""
    x = x.select("g", "levels", "suffix", "root", F.posexplode("rows").alias("at", "row"))
    return x.select("g", "row", F.concat(sides_within(F.col("levels"), F.col("at")), F.col("suffix")).alias("path"), "root")


def tree(nodes: DataFrame, top: int = TOP) -> DataFrame:
    """nodes without k, and with path and root, as in single()."""
    return single(climbed(nodes, top)).select("g", "row.*", "path", "root").drop("pos")


def manifest(docs: DataFrame, tampered: Column | None = None, top: int = TOP) -> DataFrame:
    """doc_id, source, leaf, subroot, root and path of each row of docs (FIELDS),
    and own, the leaf of the row with its text replaced by ``tampered`` where that
    isn't null (by default nowhere)."""
    fields = [F.col(c) for c in FIELDS]
    change = F.lit(None).cast("string") if tampered is None else tampered
    thin = docs.select(
        F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source")).alias("g"),
        F.col("doc_id").alias("k"), leaf(fields).alias("node"), "doc_id", F.when(change.isNotNull(), leaf([*fields[:-1], change])).alias("own"),
    )
    found = climbed(thin, top)
    subroots = found.select("g", "root").distinct().select(F.lit("").alias("g"), F.col("g").alias("k"), F.col("root").alias("node"), F.col("g").alias("source"))
    above = tree(subroots, top).select(F.col("source").alias("g"), F.col("path").alias("above"), F.col("root").alias("last"))
    # blocks, not rows, meet what is above their source
    found = found.join(above, "g").select("g", "levels", "rows", F.concat("suffix", "above").alias("suffix"), F.struct("root", "last").alias("root"))
    source = F.when(F.col("g") != "", F.substring("g", 2, 1 << 30)).alias("source")
    return single(found).select("row.doc_id", source, F.col("row.node").alias("leaf"), F.coalesce("row.own", "row.node").alias("own"), F.col("root.root").alias("subroot"), F.col("root.last").alias("root"), "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda x, side: F.sha2(F.concat(side["l"], x, side["r"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda side: F.concat(side["l"], side["r"])), ""), 256)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth row by checksum is verified with its text in lower case."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = manifest(docs, F.when(touched, lowered))
    out = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.col("own"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle(levels: int = 5, above: int = 3) -> str:
    """Level by level; for sources of at most 16 ** levels rows and 16 ** above sources."""
    value = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    digest = lambda text: "sha256(" + " || ".join(map(value, (*FIELDS[:-1], text))) + ")"
    ctes = ["t0 AS (SELECT CAST(range AS BIGINT) AS b, CAST(range AS BIGINT) AS c FROM range(256))"]
    for k in range(8):  # the table of the checksum
        ctes.append(f"t{k + 1} AS (SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM t{k})")
    ctes += [
        "crc AS (SELECT list(c ORDER BY b) AS c FROM t8)",
        "ids AS (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s FROM documents)",
        "sums AS (SELECT doc_id AS own_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(x) AS BIGINT) FOR x IN string_split(s, '')]), lambda x, y: xor(x >> 8, c[xor(x, y) % 256 + 1])), 4294967295) AS crc FROM ids, crc)",
        f"d AS (SELECT d.doc_id, d.source, {digest('text')} AS leaf, CASE WHEN crc % 5 = 0 AND text IS NOT NULL THEN {digest(lowered)} ELSE {digest('text')} END AS own FROM documents d JOIN sums s ON d.doc_id IS NOT DISTINCT FROM s.own_id)",
        "x0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS nth, own AS f, '' AS proof FROM d)",
        "n0 AS (SELECT source, nth AS p, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM x0)",
    ]

    def climb(x: str, n: str, count: int) -> None:
        for k in range(count):
            ctes.append(f"s{n}{k} AS (SELECT a.source, a.p, a.n, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p < a.p), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p > a.p), '') AS r FROM {n}{k} a JOIN {n}{k} b ON a.source IS NOT DISTINCT FROM b.source AND a.p // 16 = b.p // 16 GROUP BY ALL)")
            ctes.append(f"{x}{k + 1} AS (SELECT x.* REPLACE (CASE WHEN n > 1 THEN sha256(l || f || r) ELSE f END AS f, CASE WHEN n > 1 THEN proof || l || r ELSE proof END AS proof, nth // 16 AS nth) FROM {x}{k} x JOIN s{n}{k} s ON x.source IS NOT DISTINCT FROM s.source AND x.nth = s.p)")
            ctes.append(f"{n}{k + 1} AS (SELECT source, p // 16 AS p, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY p)) ELSE min(h) END AS h, (n + 15) // 16 AS n FROM {n}{k} GROUP BY source, p // 16, n)")

    climb("x", "n", levels)
    ctes += [
        f"y AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM n{levels})",
        f"z0 AS (SELECT 0 AS source, x.doc_id, x.leaf, y.h AS subroot, y.p AS nth, x.f, x.proof FROM x{levels} x JOIN y ON x.source IS NOT DISTINCT FROM y.source)",
        "m0 AS (SELECT 0 AS source, p, h, n FROM y)",
    ]
    climb("z", "m", above)
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM z{above}, m{above}"


ORACLE_SQL = _oracle()
