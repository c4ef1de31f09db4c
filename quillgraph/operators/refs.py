"""What references in notes stand for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .library import creator_year, year

#: Order in which a reference is looked up; the first that finds one note wins.
ADDRESS, ID, ALIAS, CITATION, HISTORIC, TITLE, FOLDED = range(7)


def unique(rows: DataFrame, key: str, target: str = "id") -> DataFrame:
    """key and target where a key has one target."""
    return rows.groupBy(key).agg(F.min(target).alias(target), F.countDistinct(target).alias("n")).where("n = 1").drop("n")


def resolve(refs: DataFrame, notes: DataFrame, alias: DataFrame, citations: DataFrame | None = None, historic: DataFrame | None = None, addresses: DataFrame | None = None) -> DataFrame:
    """ref, target and priority of each ref: by address (ref, id), id, alias (note_key, card_id),
    citation alias (alias, id), historic reference (ref, id), exact and folded title."""
    refs = materialize(refs)  # read once for each way to find them
    plain = refs.where("not startswith(ref, '@')")
    found = [refs.join(notes.select(F.col("id").alias("ref"), F.col("id").alias("target")), "ref").withColumn("priority", F.lit(ID)), refs.join(alias.select(F.col("note_key").alias("ref"), F.col("card_id").alias("target")), "ref").withColumn("priority", F.lit(ALIAS))]
    if addresses is not None:
        found.append(refs.join(addresses.select("ref", F.col("id").alias("target")), "ref").withColumn("priority", F.lit(ADDRESS)))
    if citations is not None:
        found.append(refs.join(citations.where("id is not null").select(F.col("alias").alias("ref"), F.col("id").alias("target")), "ref").withColumn("priority", F.lit(CITATION)))
    if historic is not None:
        found.append(refs.join(unique(historic, "ref").withColumnRenamed("id", "target"), "ref").withColumn("priority", F.lit(HISTORIC)))
    titles = unique(notes.select(F.col("title").alias("ref"), "id"), "ref").withColumnRenamed("id", "target")
    folded = unique(notes.select(F.col("title_folded").alias("folded"), "id"), "folded").withColumnRenamed("id", "target")
    found.append(plain.join(titles, "ref").withColumn("priority", F.lit(TITLE)))
    found.append(plain.withColumn("folded", F.lower("ref")).join(folded, "folded").select("ref", "target", F.lit(FOLDED).alias("priority")))
    best = reduce(DataFrame.unionByName, found).groupBy("ref").agg(F.min_by("target", "priority").alias("target"), F.min("priority").alias("priority"))
    return refs.join(best, "ref", "left")


def aliases(keys: DataFrame, citations: DataFrame) -> DataFrame:
    """alias and id (null if ambiguous) of own keys (key, id) as they are and
    after @, and of citation keys after @; keys with spaces or brackets have none."""
    sound = lambda rows: rows.where(~F.col("key").rlike(r"[\s\[\]|]"))
    keys, citations = sound(keys), sound(citations)
    rows = keys.select(F.col("key").alias("alias"), "id").union(keys.union(citations).select(F.concat(F.lit("@"), "key"), "id"))
    return rows.groupBy("alias").agg(F.when(F.countDistinct("id") == 1, F.min("id")).alias("id"))


def link_targets(notes: DataFrame, alias: DataFrame, historic: DataFrame) -> DataFrame:
    """ref (lower-case), target and priority of all that a link may say: an id, an
    address (note/ and the id), another key (alias: note_key, card_id), a title
    that one note has, a reference of before (historic: ref, id) that means one."""
    titles = unique(notes.where("title_folded != ''").select(F.col("title_folded").alias("ref"), "id"), "ref")
    told = [notes.select(F.col("id").alias("ref"), "id"), notes.select(F.concat(F.lit("note/"), "id"), "id"), alias.select(F.lower("note_key"), "card_id"), titles.select("ref", "id"), unique(historic.select(F.lower("ref").alias("ref"), "id"), "ref").select("ref", "id")]
    rows = reduce(DataFrame.union, [x.withColumn("priority", F.lit(k)) for k, x in enumerate(told, 1)])
    return rows.groupBy("ref").agg(F.min_by("id", "priority").alias("target"), F.min("priority").alias("priority"))


def forward_links(links: DataFrame, new: DataFrame, alias: DataFrame) -> DataFrame:
    """source_id, ref and target_id of links that led nowhere and now find one of the new notes."""
    targets = link_targets(new, alias, new.select(F.col("custom_key").alias("ref"), "id").where("ref is not null")).select(F.col("ref").alias("folded"), F.col("target").alias("target_id"))
    return links.where("target_id is null").select("source_id", "ref", F.lower("ref").alias("folded")).join(targets, "folded").select("source_id", "ref", "target_id")


def with_references(rows: DataFrame, public: DataFrame) -> DataFrame:
    """rows with the public reference (id, reference) of each, else its id."""
    return rows.join(public.select("id", "reference"), "id", "left").withColumn("reference", F.coalesce("reference", "id"))


def labels(notes: DataFrame, items: DataFrame) -> DataFrame:
    """id and label of notes (id, title, custom_key, item_key, source: whether it
    stands for its item): its own key, else its item's (item_key, creator, date,
    citation_key) creator and year if there are both, or citation key, else its
    id or, where it stands for no item, its title."""
    rows = notes.join(items.select("item_key", "creator", "date", "citation_key"), "item_key", "left")
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    both = F.when(full("creator").isNotNull() & year("date").isNotNull(), creator_year(F.col("creator"), F.col("date")))
    named = F.when(F.col("source"), F.col("id")).otherwise(F.coalesce(full("title"), F.col("id")))
    return rows.select("id", F.coalesce(full("custom_key"), both, full("citation_key"), named).alias("label"))


def validated_keys(wanted: DataFrame, reserved: DataFrame) -> DataFrame:
    """wanted (key) with verdict: empty, invalid, exists or free."""
    taken = reserved.select("key").where("key is not null").distinct().withColumn("taken", F.lit(True))
    rows = wanted.join(taken, "key", "left")
    verdict = F.when(F.coalesce("key", F.lit("")) == "", "empty").when(F.col("key").rlike(r"[\s\[\]|]") | F.startswith("key", F.lit("@")), "invalid").when(F.col("taken"), "exists").otherwise("free")
    return rows.withColumn("verdict", verdict).drop("taken")
