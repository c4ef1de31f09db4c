"""Items of a library: catalogue, keys, creators, annotations, and notes that stand for them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .order import running

CITATION_KEY = r"(?m)^Citation Key:\s*(\S+)"
MARKS = ("highlight", "underline")


def year(date: str | Column) -> Column:
    """The first four digits in a row; null if there are none."""
    return F.nullif(F.regexp_extract(date, r"(\d{4})", 1), F.lit(""))


def creator_year(creator: str | Column, date: str | Column) -> Column:
    return F.trim(F.concat_ws(" ", creator, year(date)))


def catalogue(items: DataFrame, text: str, fields: tuple[str, ...] = ("title", "creator", "date", "citation_key", "extra"), library: str = "library", most: int = 30) -> DataFrame:
    """Items (id, ...) that hold the text in one of the fields, the first ``most`` of each library by id."""
    low = text.strip().lower()
    hit = reduce(Column.__or__, [F.coalesce(F.contains(F.lower(f), F.lit(low)), F.lit(False)) for f in fields])
    place = F.row_number().over(Window.partitionBy(library).orderBy("id"))
    return items.where(hit).withColumn("place", place).where(F.col("place") <= most)


def by_citation_key(items: DataFrame, keys: DataFrame) -> DataFrame:
    """key and id of the items (id, citation_key, other_key, extra) that have one
    of the keys (key): their own, else that of another tool, else the one that extra names."""
    named = F.coalesce(F.nullif("citation_key", F.lit("")), F.nullif("other_key", F.lit("")), F.nullif(F.regexp_extract("extra", CITATION_KEY, 1), F.lit("")))
    return items.select(named.alias("key"), "id").join(keys.select("key"), "key", "left_semi").distinct()


def annotations(items: DataFrame, attachments: DataFrame, marks: DataFrame) -> DataFrame:
    """id, annotation and text of the highlights and underlines with text
    (annotation, parent, kind, text) in the attachments (attachment, id) of items (id)."""
    told = marks.where(F.col("kind").isin(*MARKS) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    return items.select("id").join(attachments, "id").join(told, F.col("attachment") == F.col("parent")).select("id", "annotation", "text")


def creators(links: DataFrame, people: DataFrame) -> DataFrame:
    """id and creators, the names of an item's people in their order. links (id,
    creator, place), people (creator, first, last)."""
    name = F.trim(F.concat_ws(" ", "first", "last"))
    rows = links.join(people.select("creator", name.alias("name")), "creator")
    return rows.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), "; ").alias("creators"))


def with_sources(items: DataFrame, libraries: DataFrame, attachments: DataFrame) -> DataFrame:
    """Items (id, library) of user and group libraries (library, kind), each with
    the number of its attachments (attachment, id)."""
    n = attachments.groupBy("id").agg(F.count("*").alias("attachments"))
    own = libraries.where("kind in ('user', 'group')")
    return items.join(own, "library").join(n, "id", "left").select("id", "library", "kind", F.coalesce("attachments", F.lit(0)).alias("attachments"))


def unmapped(notes: DataFrame, card_notes: DataFrame, after: int | None = None, most: int | None = None) -> DataFrame:
    """Notes of the library (item, note_key, library_id) without a card yet, by
    item: those after one, at most so many."""
    rows = notes if after is None else notes.where(F.col("item") > after)
    rows = rows.join(card_notes.select("note_key", "library_id"), ["note_key", "library_id"], "left_anti")
    return rows if most is None else rows.orderBy("item").limit(most)


def milliseconds(date: str | Column) -> Column:
    """Milliseconds since 1970 of a library's date (2026-01-31 10:00:00, in UTC)."""
    return F.unix_millis(F.try_to_timestamp(F.concat(date if isinstance(date, Column) else F.col(date), F.lit("Z"))))


def cards_of(notes: DataFrame, taken: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New cards (id, created_at, updated_at) of notes (note_key, library_id,
    added, modified) and the rows that map them; notes whose id is taken (id)
    get none. An id is the 14 digits of the date and time of the note's making."""
    rows = notes.withColumn("id", F.regexp_replace(F.substring("added", 1, 19), r"\D", "")).where("length(id) = 14")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("library_id", "note_key"))).where("nth = 1")
    new = rows.join(taken.select("id"), "id", "left_anti")
    return new.select("id", milliseconds("added").alias("created_at"), milliseconds("modified").alias("updated_at")), new.select(F.col("id").alias("card_id"), "note_key", "library_id")


def resolved(found: DataFrame, items: DataFrame, hidden: DataFrame) -> DataFrame:
    """Results (query, doc_key, score) with their items' titles, without items
    (doc_key, title, kind, parent) that are gone, hidden (doc_key), of feeds or
    parts of other items."""
    rows = found.join(items.where("kind != 'feed' and parent is null").select("doc_key", "title"), "doc_key")
    return rows.join(hidden.select("doc_key"), "doc_key", "left_anti").select("query", "doc_key", "title", "score")


def with_state(docs: DataFrame, fingerprints: DataFrame, updates: DataFrame) -> DataFrame:
    """Documents (doc_key, hash) with status: new without a fingerprint
    (doc_key, hash), stale if that is of another text, waiting with an update
    (doc_key), else ready."""
    rows = docs.select("doc_key", "hash").join(fingerprints.select("doc_key", F.col("hash").alias("known")), "doc_key", "left").join(updates.select("doc_key", F.lit(True).alias("update")).distinct(), "doc_key", "left")
    status = F.when(F.col("known").isNull(), "new").when(F.col("known") != F.col("hash"), "stale").when(F.col("update"), "waiting").otherwise("ready")
    return rows.select("doc_key", status.alias("status"))


def transitions(states: DataFrame, actions: DataFrame) -> DataFrame:
    """id, state and outcome after actions (id, action): trash an active note,
    restore or delete one that is still trashed, as its state (id, state; none:
    active) says when it is looked at again."""
    rows = actions.join(states, "id", "left").withColumn("state", F.coalesce("state", F.lit("active")))
    allowed = ((F.col("action") == "trash") & (F.col("state") == "active")) | (F.col("action").isin("restore", "delete") & (F.col("state") == "trashed"))
    after = F.when(~allowed, F.col("state")).when(F.col("action") == "trash", "trashed").when(F.col("action") == "restore", "active").otherwise("deleted")
    return rows.select("id", "action", after.alias("state"), F.when(allowed, "done").otherwise("refused").alias("outcome"))


def free_seconds(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """id and second: of rows (id, second) in the order of second and id, each the
    first second from its own on that is neither taken (second) nor given before.
    Among free seconds only, that is a running maximum. All that runs over whole
    tables does so by ranges: see order."""
    no_id = F.lit(None).cast(wanted.schema["id"].dataType).alias("id")
    given = materialize(running(taken.select("second").distinct(), ["second"], n=("sum", "1L")).select("second", (F.col("n") - 1).alias("before")))
    # how many taken seconds lie before each wanted one
    marks = wanted.select("id", "second", F.lit(0).alias("kind")).union(given.select(no_id, "second", F.lit(1)))
    rows = running(marks, ["second", "kind", "id"], upto=("sum", "kind"), n=("sum", "1L - kind")).where("kind = 0")
    rows = running(rows.select("id", "second", "upto", "n"), ["n"], free=("max", "second - upto - n")).select("id", (F.col("free") + F.col("n")).alias("free"))
    # back: a taken second with b taken before it has second - b free ones before it
    back = rows.select("id", "free", F.lit(0).alias("kind")).union(given.select(no_id, (F.col("second") - F.col("before")).alias("free"), F.lit(1)))
    passed = running(back, ["free", F.desc("kind")], passed=("sum", "kind"))
    return passed.where("kind = 0").select("id", (F.col("free") + F.col("passed")).alias("second"))
