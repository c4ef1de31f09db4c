"""Mixing sources to target weights, with DataFrame operations only.

Each source's documents are laid end to end, in an order made from hashes of
their ids, and cut into blocks of ``block`` words. Slots of the mix are dealt
to output shards; each shard draws how many slots a source gets from a
multinomial distribution. Draws beyond a source's quota are given back, and
what is then missing is dealt in shards of its own at the end, so a source
comes within half a block of its target. Slot j of a source stands for block
pi(j mod blocks) of pass j div blocks, pi being a pseudorandom permutation of
the source's blocks, another for each pass. It swaps pairs that mirror each
other in a hashed point, as a hashed bit says, round after round; that is a
permutation of any number of blocks.

Cases: a null text has size 0; a null source is a source, the last one; rows
with the same id are documents of their own; with no words at all every target
is 0; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, table

#: A word with the white space that follows, and with what stands before the first.
TOKEN = rf"(?:\A[\x20\x09-\x0D]+)?{WORD}[\x20\x09-\x0D]*"
WEIGHTS = (5, 2, 1)
ROUNDS = 12
CELLS = 4096
PASSES = 2
SLOTS_PER_TASK = 32_768


def hashed(*parts) -> Column:
    """60 bits of a hash of the parts, as a whole number."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]).cast("binary")), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame, seed: int, rows_per_bucket: int = 2_000, text: str = "text", keep=()) -> DataFrame:
    """doc_id, source, size, the columns to keep, and a place (bucket, rn) that is the row's own within its source."""
    tie = F.when(F.col("doc_id").isNull(), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))  # rows without an id are spread by their texts
    rows = docs.select("doc_id", "source", *keep, tie.alias("tie"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = materialize(rows)
    buckets = rows.count() // rows_per_bucket + 1
    h = hashed(seed, "place", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.col("tie"))))
    rows = rows.withColumn("h", h).withColumn("bucket", F.col("h") % buckets)
    own = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", *keep)
    rows = rows.withColumn("rn", F.row_number().over(own)).withColumn("before", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    return rows.drop("h", "tie")


def quotas(rows: DataFrame, share: float, block: int, weights=WEIGHTS, most: int = PASSES) -> DataFrame:
    """For each source: rank, size, target, blocks and its quota of slots."""
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = Window.partitionBy(F.lit(0))
    s = s.withColumn("rank", F.row_number().over(whole.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", (F.col("source_size") * most).cast("double"))
    # level at which all sources from this one on (in the order of cap / w) take level * w
    order = whole.orderBy(F.col("cap") / F.col("w"), "rank")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("level", (share * F.sum("source_size").over(whole) - (F.sum("cap").over(upto) - F.col("cap"))) / (F.sum("w").over(whole) - (F.sum("w").over(upto) - F.col("w"))))
    s = s.withColumn("place", F.row_number().over(order))
    fits = F.col("level") <= F.col("cap") / F.col("w")
    s = s.withColumn("level", F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("place"))).over(whole))
    s = s.withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("w")), F.col("cap")))
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    quota = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5).cast("long"), F.col("blocks") * most)).otherwise(F.lit(0).cast("long"))
    s = s.withColumn("quota", quota).withColumn("upto", F.sum("quota").over(whole.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    return s.select("source", "rank", "source_size", "target", "blocks", "quota", "upto")


def drawn(spark: SparkSession, s: DataFrame, seed: int, per_shard: int) -> DataFrame:
    """rank, shard, first, n: the slots first to first + n - 1 of a source are in the shard."""
    total = s.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    width = max(1, -(-total // CELLS))
    own = s.where("quota > 0").select("rank", (F.col("upto") - F.col("quota")).alias("lo"), F.col("upto").alias("hi"))
    cells = own.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    draws = spark.range(total).select(F.floor(F.col("id") / per_shard).alias("shard"), (hashed(seed, "draw", F.col("id")) % max(1, total)).alias("at"))
    draws = draws.withColumn("cell", F.floor(F.col("at") / width))
    counts = draws.join(cells, (draws["cell"] == cells["cell"]) & (draws["at"] >= cells["lo"]) & (draws["at"] < cells["hi"])).groupBy("rank", "shard").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.join(s.select("rank", "quota"), "rank").withColumn("sum", F.sum("n").over(upto))
    kept = counts.select("rank", "shard", F.least(F.col("sum") - F.col("n"), F.col("quota")).alias("first"), F.least("sum", "quota").alias("end"))
    # what the draws left open goes to shards after the last
    got = counts.groupBy("rank").agg(F.max("sum").alias("got"))
    short = s.where("quota > 0").join(got, "rank", "left").select("rank", F.lit(-(-total // per_shard)).cast("long").alias("shard"), F.least(F.coalesce("got", F.lit(0)), F.col("quota")).alias("first"), F.col("quota").alias("end"))
    both = kept.union(short).where("end > first")
    pieces = both.withColumn("from", F.explode(F.expr(f"sequence(first, end - 1, {per_shard}L)")))
    return pieces.select("rank", (F.col("shard") + F.floor((F.col("from") - F.col("first")) / per_shard)).alias("shard"), F.col("from").alias("first"), (F.least(F.col("end"), F.col("from") + per_shard) - F.col("from")).alias("n"))


def slots(shares: DataFrame, s: DataFrame, seed: int) -> DataFrame:
    """rank, shard, slot, block: the block that each slot of the mix takes."""
    keys = F.array(*[F.array(*[hashed(seed, "key", F.col("rank"), p, r) % F.col("blocks") for r in range(ROUNDS)]) for p in range(PASSES)])
    own = s.where("quota > 0").select("rank", "blocks", keys.alias("keys"))
    # a row of shares stands for very many slots: cut it, and deal the cuts by the number of slots
    total, most = s.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0], SLOTS_PER_TASK // 8
    x = shares.join(own, "rank").withColumn("end", F.col("first") + F.col("n")).withColumn("first", F.explode(F.expr(f"sequence(first, end - 1, {most}L)")))
    x = x.repartition(total // SLOTS_PER_TASK + 1, "rank", "shard", "first")
    x = x.withColumn("slot", F.explode(F.expr(f"sequence(first, least(end, first + {most}L) - 1)")))
    x = x.withColumn("pass", F.floor(F.col("slot") / F.col("blocks")).cast("int")).withColumn("block", F.col("slot") % F.col("blocks"))

    def swapped(block: Column, r: Column) -> Column:
        mirror = F.pmod(F.get(F.get("keys", F.col("pass")), r) - block, F.col("blocks"))
        bit = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "rank", "pass", r, F.greatest(block, mirror)).cast("binary")), 1, 1) >= "8"
        return F.when(bit, mirror).otherwise(block)

    # one loop over the rounds: nested columns would double the expression each time
    x = x.withColumn("block", F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.col("block"), swapped))
    return x.select("rank", "shard", "slot", "block")


def packed(docs: DataFrame, share: float, block: int, per_shard: int, seed: int, keep=()) -> tuple[DataFrame, DataFrame]:
    """Returns the documents laid end to end and cut (a row for each block that a
    document has words in, of documents without words one with a null block) and
    the mix (rank, shard, slot, block)."""
    spark = docs.sparkSession
    rows = sized(docs, seed, keep=keep)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    start = F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_bucket")
    sums = sums.select(F.col("source").alias("s2"), F.col("bucket").alias("b2"), start.alias("start"))
    s = materialize(quotas(rows, share, block))
    dealt = slots(drawn(spark, s, seed, per_shard), s, seed)
    of = s.select(F.col("source").alias("s3"), "rank", "source_size", "target")
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2"))).join(of, F.col("source").eqNullSafe(F.col("s3")))
    rows = rows.withColumn("lo", F.col("start") + F.col("before"))
    rows = rows.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("lo") + F.col("size") - 1) / block)))))
    words = F.least(F.col("lo") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("lo"), F.col("block") * block)
    return rows.withColumn("words", words), dealt


def mix(docs: DataFrame, share: float = 1.5, block: int = 128, per_shard: int = 65_536, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Returns the documents (doc_id, source, size, source_size, target, taken)
    and the mix itself (rank, shard, slot, block)."""
    rows, dealt = packed(docs, share, block, per_shard, seed)
    times = dealt.groupBy("rank", "block").agg(F.count("*").alias("times"))
    found = rows.join(times.hint("merge"), ["rank", "block"], "left")  # as many as blocks: see emitted()
    out = found.groupBy("rank", "bucket", "rn", "doc_id", "source", "size", "source_size", "target").agg(F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).cast("long").alias("taken"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken"), dealt


def emitted(docs: DataFrame, share: float = 1.5, block: int = 128, per_shard: int = 65_536, seed: int = 7) -> DataFrame:
    """The mix as text: for each slot a row for each document with words in its
    block, text being that piece of the document with the white space that
    follows each word (and what stands before the first). New columns, in place
    of any of the same name: size and target (of the document, of its source),
    taken (the row's words), shard, slot, block, and place, the first word's
    within the block. Documents without words come once, with nulls in the last
    four; n_chars is made anew, other columns are the document's."""
    docs = docs.drop("size", "target", "taken", "shard", "slot", "block", "place")
    docs = materialize(docs.withColumn("__row", F.monotonically_increasing_id()).withColumn("__tie", F.xxhash64("text")))
    rows, dealt = packed(docs, share, block, per_shard, seed, keep=("__tie", "__row"))
    first = F.greatest(F.col("lo"), F.col("block") * block)
    rows = rows.select("__row", "size", "target", "rank", "block", "words", (first - F.col("lo")).alias("from"), (first - F.col("block") * block).alias("place"))
    piece = F.struct(F.col("words").alias("taken"), "shard", "slot", "block", "place", "from")
    # the slots grow with the table, but Spark takes them for as small as the sources they are made from: never broadcast.
    # The pieces go to the texts, so that each text moves once
    parts = rows.join(dealt.hint("merge"), ["rank", "block"], "left").groupBy(F.col("__row").alias("__r")).agg(F.max("size").alias("size"), F.max("target").alias("target"), F.collect_list(F.when(F.col("slot").isNotNull(), piece)).alias("__pieces"))
    parts = parts.where((F.size("__pieces") > 0) | (F.col("size") == 0))
    names = ("taken", "shard", "slot", "block", "place")
    tokens = F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))
    # a list of one list: a text is cut into words once, not once for each piece
    cut = F.transform(F.array(tokens), lambda t: F.transform("__pieces", lambda p: F.struct(F.array_join(F.slice(t, (p["from"] + 1).cast("int"), p["taken"].cast("int")), "").alias("text"), *[p[n].alias(n) for n in names])))
    whole = F.array(F.struct(F.col("text"), F.lit(0).cast("long").alias("taken"), *[F.lit(None).cast("long").alias(n) for n in names[1:]]))
    found = docs.join(parts.hint("merge"), F.col("__row") == F.col("__r")).withColumn("__piece", F.explode(F.when(F.col("size") == 0, whole).otherwise(F.get(cut, F.lit(0)))))
    made = {"text": F.col("__piece.text").alias("text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("size") == 0, F.col("n_chars")).otherwise(F.length("__piece.text")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return found.select(*[made.get(n, n) for n in docs.columns if n not in ("__row", "__tie")], "size", "target", *[f"__piece.{n}" for n in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))[0].drop("source")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the documents, as emitted() gives it: pieces of texts, those of
    blocks dealt twice as rows of their own."""
    return emitted(docs)


def _oracle(share=1.5, block=128, per_shard=65_536, seed=7, rows_per_bucket=2_000) -> str:
    h = lambda *parts: "('0x' || substr(md5(concat_ws(':', " + ", ".join(parts) + ")), 1, 15))::BIGINT"
    ctes = [
        f"d0 AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, {h(f"'{seed}'", "'place'", 'CAST(doc_id AS VARCHAR)')} AS h FROM documents)",
        f"d1 AS (SELECT *, h % ((SELECT count(*) FROM d0) // {rows_per_bucket} + 1) AS bucket FROM d0)",
        "d2 AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY bucket, h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS lo FROM d1)",
        "s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d0 GROUP BY source)",
        "s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s0)",
        f"s2 AS (SELECT *, [{', '.join(f'{w}.0::DOUBLE' for w in WEIGHTS)}][(rank - 1) % {len(WEIGHTS)} + 1] AS w, ({PASSES} * source_size)::DOUBLE AS cap FROM s1)",
        f"s3 AS (SELECT *, row_number() OVER o AS place, ({share}::DOUBLE * sum(source_size) OVER () - (sum(cap) OVER o - cap)) / (sum(w) OVER () - (sum(w) OVER o - w)) AS level FROM s2 WINDOW o AS (ORDER BY cap / w, rank ROWS UNBOUNDED PRECEDING))",
        "s4 AS (SELECT *, least(cap, w * (SELECT arg_min(level, place) FROM s3 WHERE level <= cap / w)) AS target FROM s3)",
        f"s5 AS (SELECT *, ceil(source_size / {block})::BIGINT AS blocks FROM s4)",
        f"s6 AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target * blocks / source_size + 0.5)::BIGINT, {PASSES} * blocks) ELSE 0 END AS quota FROM s5)",
        "s AS (SELECT *, sum(quota) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) AS upto FROM s6)",
        "x0 AS (SELECT rank, blocks, slot, (slot // blocks) AS pass, slot % blocks AS block FROM (SELECT rank, blocks, unnest(range(quota)) AS slot FROM s WHERE quota > 0))",
    ]
    for r in range(ROUNDS):
        ctes += [
            f"m{r} AS (SELECT *, ((({h(f"'{seed}'", "'key'", 'CAST(rank AS VARCHAR)', 'CAST(pass AS VARCHAR)', f"'{r}'")} % blocks) - block) % blocks + blocks) % blocks AS mirror FROM x{r})",
            f"x{r + 1} AS (SELECT rank, blocks, slot, pass, CASE WHEN substr(md5(concat_ws(':', '{seed}', CAST(rank AS VARCHAR), CAST(pass AS VARCHAR), '{r}', CAST(greatest(block, mirror) AS VARCHAR))), 1, 1) >= '8' THEN mirror ELSE block END AS block FROM m{r})",
        ]
    ctes += [
        f"times AS (SELECT rank, block, count(*) AS times FROM x{ROUNDS} GROUP BY ALL)",
        f"p AS (SELECT doc_id, size, lo, source, unnest(range(lo::BIGINT // {block}, (lo::BIGINT + size - 1) // {block} + 1)) AS block FROM d2 WHERE size > 0)",
        f"t AS (SELECT p.doc_id, sum((least(lo + size, (p.block + 1) * {block}) - greatest(lo, p.block * {block})) * times) AS taken FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source JOIN times ON times.rank = s.rank AND times.block = p.block GROUP BY p.doc_id)",
    ]
    return "WITH " + ",\n".join(ctes) + "\nSELECT d0.doc_id, d0.size, s.source_size, s.target, coalesce(t.taken, 0)::BIGINT AS taken FROM d0 JOIN s ON d0.source IS NOT DISTINCT FROM s.source LEFT JOIN t ON t.doc_id = d0.doc_id"


ORACLE_SQL = _oracle()
