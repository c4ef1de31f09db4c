"""Search, filters, counts, links and upkeep of notes.

Notes are rows (id, title, title_folded, body, item_key, library, ..., note_type,
custom_key, created_at, updated_at); links (source_id, target_id, ref);
``unavailable`` (card_id, state) names notes that reads pass over.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import materialize
from .graph import ancestors

SORTS = {f"{k}-{d}": (c, d) for k, c in (("updated", "updated_at"), ("created", "created_at"), ("title", "title"), ("id", "id")) for d in ("asc", "desc")}
TYPES = ("literature", "zettel", "thinking", "entity")
RANK_ID, RANK_TITLE, RANK_BODY = 0, 1, 2
MAX_TERMS, MAX_QUERY, MAX_PAGE, MAX_IDS = 16, 2048, 500, 500


def query_terms(query: str) -> list[str]:
    """Phrases in double quotes and runs without spaces, lower-case, each once."""
    if len(query) > MAX_QUERY:
        raise ValueError(f"a query has at most {MAX_QUERY} characters")
    found = [(phrase or run).strip().lower() for phrase, run in re.findall(r'"([^"]+)"|(\S+)', query)]
    terms = list(dict.fromkeys(t for t in found if t))
    if len(terms) > MAX_TERMS:
        raise ValueError(f"a query has at most {MAX_TERMS} terms")
    return terms


def active(notes: DataFrame, unavailable: DataFrame, key: str = "id") -> DataFrame:
    """Notes that aren't unavailable."""
    return notes.join(unavailable.select(F.col("card_id").alias(key)), key, "left_anti")


def trashed(notes: DataFrame, unavailable: DataFrame) -> DataFrame:
    return notes.join(unavailable.where("state = 'trashed'").select(F.col("card_id").alias("id")), "id", "left_semi")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _pairs_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: list(dict.fromkeys(map(add, t, t[1:]))), na_action="ignore")


def bigrams(text: str | Column) -> Column:
    """Distinct pairs of adjacent code points of the lower-case text."""
    return _pairs_of(F.lower(text))


def search_terms(notes: DataFrame, text: str = "body") -> DataFrame:
    """The inverted index: term and card_id, once each."""
    return notes.select(F.explode(bigrams(text)).alias("term"), F.col("id").alias("card_id"))


def terms_by_note(notes: DataFrame, text: str = "body") -> DataFrame:
    """The same index with a row for each note: card_id and terms."""
    return notes.select(F.col("id").alias("card_id"), bigrams(text).alias("terms"))


def grams_of(keyword: str, most: int = 64) -> list[str]:
    k = keyword.lower()
    return list(dict.fromkeys(k[i : i + 2] for i in range(len(k) - 1)))[:most]


def gram_division(terms: DataFrame, keyword: str, most: int = 64) -> DataFrame:
    """card_id of the notes whose index holds all of the keyword's (first) pairs."""
    grams = grams_of(keyword, most)
    return terms.where(F.col("term").isin(grams)).groupBy("card_id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("card_id")


def matches(keyword: str, *more: str) -> Column:
    fields = ["title_folded", F.lower("body"), F.lower("id"), F.lower(F.coalesce("custom_key", F.lit(""))), *map(F.lower, more)]
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.col(f) if isinstance(f, str) else f, F.lit(keyword)), F.lit(False)) for f in fields])


def search(notes: DataFrame, query: str = "", unavailable: DataFrame | None = None, types: list[str] | None = None, tagged: DataFrame | None = None, include: list[str] | DataFrame | None = None, exclude: list[str] | DataFrame | None = None, index: DataFrame | None = None, references: DataFrame | None = None) -> DataFrame:
    """Matching notes with search_rank: 0 for an exact id or key, 1 for a title
    that holds the whole query, else 2 (0 without a query). include and exclude
    are ids, in a list of at most MAX_IDS or a table (id). With an index (term and
    card_id, or as terms_by_note()) its grams narrow the notes before the texts are looked at. With references (item_key,
    reference) the reference of a note's item is looked at, too."""
    keywords = query_terms(query)
    if isinstance(include, list) and len(include) > MAX_IDS:
        raise ValueError(f"at most {MAX_IDS} ids")
    rows = active(notes, unavailable) if unavailable is not None else notes
    if types:
        rows = rows.where(F.col("note_type").isin(types))
    if include is not None:
        rows = rows.where(F.col("id").isin(include)) if isinstance(include, list) else rows.join(include.select("id"), "id", "left_semi")
    if exclude is not None:
        rows = rows.where(~F.col("id").isin(exclude)) if isinstance(exclude, list) else rows.join(exclude.select("id"), "id", "left_anti")
    if references is not None:
        rows = rows.join(references.select("item_key", F.col("reference").alias("__reference")), "item_key", "left")
    if tagged is not None:
        rows = rows.join(tagged.select(F.col("card_id").alias("id")), "id", "left_semi")
    if by_note := index is not None and "terms" in index.columns:  # all keywords are looked up where a note's terms are
        wanted = list(dict.fromkeys(g for k in keywords for g in grams_of(k, 24 if len(keywords) > 1 else 64)))
        if wanted:
            hits = index.where(F.size(F.array_intersect("terms", F.lit(wanted))) == len(wanted))
            rows = rows.join(hits.select(F.col("card_id").alias("id")), "id", "left_semi")
    for k in keywords:
        if index is not None and not by_note and len(k) >= 2:
            rows = rows.join(gram_division(index, k, 24 if len(keywords) > 1 else 64).withColumnRenamed("card_id", "id"), "id", "left_semi")
        rows = rows.where(matches(k, *(["__reference"] if references is not None else [])))
    whole = query.strip().lower()
    exact = (F.lower("id") == whole) | (F.lower(F.coalesce("custom_key", F.lit(""))) == whole)
    if references is not None:
        exact = exact | F.coalesce(F.lower("__reference") == whole, F.lit(False))
    rank = F.when(exact, RANK_ID).when(F.contains("title_folded", F.lit(whole)), RANK_TITLE).otherwise(RANK_BODY) if keywords else F.lit(RANK_ID)
    return rows.withColumn("search_rank", rank).drop("__reference")


def lookup(notes: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """The notes whose key is one of the values (a table with that column)."""
    return notes.join(values.select(key), key, "left_semi")


def parents_of_targets(links: DataFrame, parents: DataFrame) -> DataFrame:
    """source_id and parent_id: the parents of the notes that a note links to, but itself."""
    up = parents.where("parent_id is not null").select(F.col("card_id").alias("target_id"), "parent_id")
    return links.select("source_id", "target_id").join(up, "target_id").where("parent_id != source_id").select("source_id", "parent_id").distinct()


def parent_rows(notes: DataFrame, parents: DataFrame, unavailable: DataFrame) -> DataFrame:
    """Active notes with their parent, if that is active, and the number of their active children."""
    rows = active(notes, unavailable)
    up = parents.where("parent_id is not null").join(rows.select(F.col("id").alias("parent_id"), F.col("title").alias("parent_title")), "parent_id").select(F.col("card_id").alias("id"), "parent_id", "parent_title")
    n = children_counts(parents, unavailable).withColumnRenamed("parent_id", "id")
    return rows.select("id").join(up, "id", "left").join(n, "id", "left").select("id", "parent_id", "parent_title", F.coalesce("children", F.lit(0)).alias("children"))


def page(found: DataFrame, sort: str = "updated-desc", limit: int = 100, cursor: str | None = None, scope: str = "") -> DataFrame:
    """One keyset page of search(), in order. The cursor is next_cursor() of the last row of the page before."""
    if sort not in SORTS:
        raise ValueError(f"unknown order {sort}")
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"1 to {MAX_PAGE} rows")
    column, direction = SORTS[sort]
    value, down = F.col(column), direction == "desc"
    if cursor:
        c = json.loads(cursor)
        if c["scope"] != f"{scope}|{sort}":
            raise ValueError("the cursor is of another search")
        beyond = (lambda a, b: a < b) if down else (lambda a, b: a > b)
        after = beyond(value, F.lit(c["value"])) | ((value == F.lit(c["value"])) & beyond(F.col("id"), F.lit(c["id"])))
        found = found.where((F.col("search_rank") > c["rank"]) | ((F.col("search_rank") == c["rank"]) & after))
    order = [F.desc(column), F.desc("id")] if down else [F.asc(column), F.asc("id")]
    return found.orderBy("search_rank", *order).limit(limit)


def next_cursor(last: dict, sort: str = "updated-desc", scope: str = "") -> str:
    return json.dumps({"scope": f"{scope}|{sort}", "rank": last["search_rank"], "value": last[SORTS[sort][0]], "id": last["id"]})


def excerpt(query: str, length: int = 2048, before: int = 180) -> Column:
    """Part of the body around the first keyword in it."""
    keywords = query_terms(query)
    if not keywords:
        return F.substring("body", 1, length)
    places = F.array(*[F.instr(F.lower("body"), k) for k in keywords])
    first = F.coalesce(F.array_min(F.filter(places, lambda p: p > 0)), F.lit(1))
    return F.substring(F.col("body"), F.greatest(F.lit(1), first - before), F.lit(length))


def with_link_counts(notes: DataFrame, links: DataFrame) -> DataFrame:
    """With outgoing (resolved only) and incoming."""
    out = links.where("target_id is not null").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("outgoing"))
    into = links.where("target_id is not null").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("incoming"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return notes.join(out, "id", "left").join(into, "id", "left").select(*[c for c in notes.columns], zero("outgoing"), zero("incoming"))


def type_counts(notes: DataFrame) -> DataFrame:
    """note_type and n, zero for types without notes, and a row 'total'."""
    domain = notes.sparkSession.createDataFrame([(t,) for t in TYPES], "note_type string")
    counts = notes.groupBy("note_type").agg(F.count("*").alias("n"))
    named = domain.join(counts, "note_type", "left").select("note_type", F.coalesce("n", F.lit(0)).alias("n"))
    return named.union(notes.agg(F.lit("total"), F.count("*")))


def counts_by(notes: DataFrame, key: str) -> DataFrame:
    return notes.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))


def previews(notes: DataFrame, links: DataFrame, length: int = 110) -> DataFrame:
    """id, title, a beginning of the body and how many notes refer to it."""
    referring = links.where("target_id is not null").groupBy(F.col("target_id").alias("id")).agg(F.countDistinct("source_id").alias("referring"))
    return notes.join(referring, "id", "left").select("id", "title", F.substring("body", 1, length).alias("preview"), F.coalesce("referring", F.lit(0)).alias("referring"))


def newest_by(notes: DataFrame, key: str) -> DataFrame:
    """The newest note of each key."""
    best = F.max_by(F.struct(*notes.columns), F.struct("created_at", "id"))
    return notes.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(best.alias("x")).select("x.*")


def outgoing(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Links with their target's title; unresolved ones to native addresses are left out."""
    rows = links.where("target_id is not null or not startswith(ref, 'zotero://')")
    return rows.join(notes.select(F.col("id").alias("target_id"), F.col("title").alias("target_title")), "target_id", "left").select("source_id", "target_id", "ref", "target_title")


def backlinks(links: DataFrame, notes: DataFrame) -> DataFrame:
    """target_id, source_id, source_title and refs, the sorted references joined by '|'."""
    rows = links.where("target_id is not null").join(notes.select(F.col("id").alias("source_id"), F.col("title").alias("source_title")), "source_id")
    return rows.groupBy("target_id", "source_id", "source_title").agg(F.array_join(F.array_sort(F.collect_set("ref")), "|").alias("refs"))


def unresolved(links: DataFrame, notes: DataFrame, unavailable: DataFrame, limit: int = 100) -> DataFrame:
    """References that lead nowhere, from active notes: ref and how many notes hold it, most first."""
    rows = active(links.where("not startswith(ref, 'zotero://')"), unavailable, "source_id")
    gone = unavailable.select(F.col("card_id").alias("target_id"), F.lit(True).alias("gone"))
    rows = rows.join(gone, "target_id", "left").where("target_id is null or gone")
    return rows.groupBy("ref").agg(F.countDistinct("source_id").alias("sources")).orderBy(F.desc("sources"), "ref").limit(limit)


def unresolved_sources(links: DataFrame, notes: DataFrame, unavailable: DataFrame, ref: str) -> DataFrame:
    rows = links.where((F.col("ref") == ref) & F.col("target_id").isNull()).select(F.col("source_id").alias("id")).distinct()
    return active(notes, unavailable).join(rows, "id").select("id", "title")


def family(notes: DataFrame, parents: DataFrame, unavailable: DataFrame) -> DataFrame:
    """Active notes with their parent: id, title, parent_id, parent_title and parent_unavailable."""
    up = notes.select(F.col("id").alias("parent_id"), F.col("title").alias("parent_title"))
    gone = unavailable.select(F.col("card_id").alias("parent_id"), F.lit(True).alias("gone"))
    rows = active(notes, unavailable).join(parents.withColumnRenamed("card_id", "id"), "id", "left").join(up, "parent_id", "left").join(gone, "parent_id", "left")
    return rows.select("id", F.coalesce("custom_key", "id").alias("reference"), "title", "parent_id", "parent_title", F.col("gone").isNotNull().alias("parent_unavailable"))


def children_counts(parents: DataFrame, unavailable: DataFrame) -> DataFrame:
    return active(parents, unavailable, "card_id").where("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("children"))


def audit(card_notes: DataFrame, states: DataFrame, unavailable: DataFrame) -> DataFrame:
    """Mapped notes with what is known of their source: state (available, trashed, missing) and modified."""
    rows = card_notes.join(unavailable, "card_id", "left").join(states, ["note_key", "library_id"], "left")
    return rows.select("card_id", "note_key", "library_id", F.coalesce("state", F.lit("available")).alias("state"), "modified")


def health(notes: DataFrame, card_notes: DataFrame, unavailable: DataFrame) -> DataFrame:
    """id, health (trashed, missing, unmapped, available) and whether the note can be edited here."""
    rows = notes.join(unavailable.withColumnRenamed("card_id", "id"), "id", "left").join(card_notes.select(F.col("card_id").alias("id"), "note_key", "external"), "id", "left")
    state = F.when(F.col("state").isNotNull(), F.col("state")).when(F.col("note_key").isNull(), "unmapped").otherwise("available")
    return rows.select("id", state.alias("health"), (F.col("state").isNull() & F.coalesce(F.col("external") == 0, F.lit(False))).alias("editable"))


def reserved_ids(notes: DataFrame, aliases: DataFrame) -> DataFrame:
    return notes.select("id").union(notes.where("custom_key is not null").select("custom_key")).union(aliases.select("note_key")).distinct()


def affected(links: DataFrame, parents: DataFrame, changed: DataFrame) -> DataFrame:
    """Notes next to the changed ones (id): linked from or to, parents and children."""
    pairs = links.where("target_id is not null").select(F.col("source_id").alias("id"), F.col("target_id").alias("near"))
    up = parents.where("parent_id is not null").select(F.col("card_id").alias("id"), F.col("parent_id").alias("near"))
    both = pairs.union(up)
    both = both.union(both.select("near", "id"))
    return both.join(changed.select("id"), "id", "left_semi").select(F.col("near").alias("id")).distinct()


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (of the same columns) that were removed or added, with change."""
    keys = old.columns
    gone = old.join(new, keys, "left_anti").withColumn("change", F.lit("removed"))
    return gone.union(new.join(old, keys, "left_anti").withColumn("change", F.lit("added")))


def index_delta(old: DataFrame, new: DataFrame, text: str = "body") -> DataFrame:
    """term, card_id and change: delta() of the search_terms() of notes (id, text)
    before and after. Texts of the same digest have the same terms; only notes of
    another text are indexed, each by itself."""
    told = lambda notes, name: notes.groupBy("id").agg(F.array_sort(F.collect_list(F.sha2(F.col(text).cast("binary"), 256))).alias(name))
    changed = materialize(told(old, "was").join(told(new, "now"), "id", "full").where("not was <=> now").select("id"))
    terms = lambda notes, name: notes.join(changed, "id", "left_semi").select("id", bigrams(text).alias("terms")).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias(name))
    none = F.array().cast("array<string>")
    rows = terms(old, "was").join(terms(new, "now"), "id", "full").select("id", F.coalesce("was", none).alias("was"), F.coalesce("now", none).alias("now"))
    part = lambda a, b, change: F.transform(F.array_except(a, b), lambda t: F.struct(t.alias("term"), F.lit(change).alias("change")))
    return rows.select("id", F.explode(F.concat(part("was", "now", "removed"), part("now", "was", "added"))).alias("x")).select("x.term", F.col("id").alias("card_id"), "x.change")


def upserted(current: DataFrame, incoming: DataFrame, now: int) -> DataFrame:
    """Notes after incoming ones (id, title, body, expected: the updated_at that
    the writer saw, null for a new note). A writer that saw another version
    changes nothing (outcome conflict); updated_at grows with every change."""
    old = current.select("id", F.col("title").alias("old_title"), F.col("body").alias("old_body"), "created_at", "updated_at")
    rows = old.join(incoming.withColumn("new", F.lit(True)), "id", "full")
    exists, new = F.col("updated_at").isNotNull(), F.col("new").isNotNull()
    conflict = new & ~F.col("updated_at").eqNullSafe(F.col("expected"))
    same = new & exists & F.col("old_title").eqNullSafe(F.col("title")) & F.col("old_body").eqNullSafe(F.col("body"))
    outcome = F.when(~new, "kept").when(conflict, "conflict").when(same, "unchanged").when(exists, "updated").otherwise("inserted")
    rows = rows.withColumn("outcome", outcome)
    take = F.col("outcome").isin("updated", "inserted")
    return rows.where(exists | take).select(
        "id", F.when(take, F.col("title")).otherwise(F.col("old_title")).alias("title"), F.when(take, F.col("body")).otherwise(F.col("old_body")).alias("body"),
        F.coalesce("created_at", F.lit(now)).alias("created_at"), F.when(take, F.greatest(F.lit(now), F.coalesce(F.col("updated_at") + 1, F.lit(now)))).otherwise(F.col("updated_at")).alias("updated_at"), "outcome",
    )


def deleted(notes: DataFrame, links: DataFrame, parents: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Notes, links and parents after the notes gone (id): links from them go,
    links to them lose their target, children move to the next note above that stays."""
    ids = gone.select("id").distinct()
    hit = ids.select(F.col("id").alias("target_id"), F.lit(True).alias("hit"))
    kept = links.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(hit, "target_id", "left")
    kept = kept.select("source_id", F.when(F.col("hit").isNull(), F.col("target_id")).alias("target_id"), "ref")
    above = ancestors(parents, ids).join(ids.withColumnRenamed("id", "ancestor"), "ancestor", "left_anti").groupBy("id").agg(F.min_by("ancestor", "depth").alias("above"))
    lifted = ids.join(above, "id", "left").select(F.col("id").alias("parent_id"), "above", F.lit(True).alias("lift"))
    tree = parents.join(ids.withColumnRenamed("id", "card_id"), "card_id", "left_anti").join(lifted, "parent_id", "left")
    tree = tree.select("card_id", F.when(F.col("lift"), F.col("above")).otherwise(F.col("parent_id")).alias("parent_id"))
    return notes.join(ids, "id", "left_anti"), kept, tree


def inserted(current: DataFrame, incoming: DataFrame, key: str = "id", replace: bool = False) -> DataFrame:
    """current with the incoming rows of the same columns: those of a known key
    are ignored, or replace the known ones. Incoming keys are unique."""
    old, new = (current.join(incoming.select(key), key, "left_anti"), incoming) if replace else (current, incoming.join(current.select(key), key, "left_anti"))
    return old.unionByName(new)


def tag_input(notes: DataFrame, card_notes: DataFrame, parents: DataFrame, unavailable: DataFrame) -> DataFrame:
    """What the tag index reads of each active note: id, note_key and parent_id."""
    rows = active(notes, unavailable).select("id").join(card_notes.select(F.col("card_id").alias("id"), "note_key"), "id", "left")
    return rows.join(parents.select(F.col("card_id").alias("id"), "parent_id"), "id", "left")


def violations(notes: DataFrame, links: DataFrame, parents: DataFrame) -> DataFrame:
    """rule and key of each row that breaks a constraint."""
    rule = lambda name, rows, key: rows.select(F.lit(name).alias("rule"), F.col(key).cast("string").alias("key"))
    twice = lambda rows, *keys: rows.groupBy(*keys).count().where("count > 1")
    return reduce(DataFrame.union, [
        rule("note type", notes.where(~F.col("note_type").isin(*TYPES)), "id"), rule("unique id", twice(notes, "id"), "id"),
        rule("unique key", twice(notes.where("custom_key is not null"), "custom_key"), "custom_key"), rule("one source note", twice(notes.where("source_note = 1 and item_key is not null"), "item_key"), "item_key"),
        rule("unique link", twice(links, "source_id", "ref"), "source_id"), rule("own parent", parents.where("card_id = parent_id"), "card_id"),
    ])


def patched(shown: DataFrame, changed: DataFrame, now: DataFrame, sort: str = "updated-desc") -> DataFrame:
    """A list after changes: rows of the changed ids (id) are taken from now (the
    same filters asked again), the others stay; in the list's order."""
    rows = shown.join(changed.select("id"), "id", "left_anti").unionByName(now.join(changed.select("id"), "id", "left_semi"))
    column, direction = SORTS[sort]
    return rows.orderBy("search_rank", *([F.desc(column), F.desc("id")] if direction == "desc" else [column, "id"]))

