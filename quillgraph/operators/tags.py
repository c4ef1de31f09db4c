"""Tags of notes: catalogue, votes, duplicates, merging, formats, suggestions.

tags are rows (card_id, tag), neighbours (query, card_id, score).
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tagging as g
from ..functions.text import nfkc_of
from ..sources.scratch import materialize


def excluded(name: str | Column, rules: g.Exclusions) -> Column:
    k = g.key_of(name)
    hit = k.isin(sorted(rules.keys)) if rules.keys else F.lit(False)
    return reduce(lambda a, p: a | k.rlike(p), rules.patterns, hit)


def catalogue(tags: DataFrame, rules: g.Exclusions = g.Exclusions()) -> DataFrame:
    """Distinct visible tags."""
    return tags.select("tag").distinct().where(~excluded("tag", rules)).orderBy("tag")


def usage(tags: DataFrame, item: str = "card_id") -> DataFrame:
    """tag and how many items hold it."""
    return tags.groupBy("tag").agg(F.countDistinct(item).alias("items"))


def preview(tags: DataFrame, names: list[str], item: str = "card_id") -> DataFrame:
    """One row: items that hold any of the names."""
    return tags.where(F.col("tag").isin(names)).agg(F.countDistinct(item).alias("items"))


def inverted(tags: DataFrame) -> DataFrame:
    """tag and its sorted ids."""
    return tags.groupBy("tag").agg(F.array_sort(F.collect_set("card_id")).alias("ids"))


def votes(tags: DataFrame, neighbours: DataFrame, rules: g.Exclusions = g.Exclusions(), limit: int = 6) -> DataFrame:
    """query, name, score, count: tags of a query's neighbours that it hasn't
    itself, by the sum of scores; each neighbour counts once, each tag key once a
    neighbour, under the spelling of the nearest neighbour."""
    once = neighbours.where((F.col("score") > 0) & (F.col("query") != F.col("card_id"))).groupBy("query", "card_id").agg(F.max("score").alias("score"))
    keyed = tags.where(~excluded("tag", rules)).withColumn("key", g.key_of("tag"))
    keyed = keyed.where("key != ''").groupBy("card_id", "key").agg(F.min("tag").alias("tag"))
    own = keyed.select(F.col("card_id").alias("query"), "key")
    given = once.join(keyed, "card_id").join(own, ["query", "key"], "left_anti")
    first = F.max_by("tag", F.struct("score", F.col("card_id")))
    sums = given.groupBy("query", "key").agg(first.alias("name"), F.sum("score").alias("score"), F.count("*").alias("count"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.desc("count"), "name"))
    return sums.withColumn("place", place).where(F.col("place") <= limit).select("query", "name", "score", "count")


def duplicate_pairs(names: DataFrame) -> DataFrame:
    """a < b and reason, of the duplicate names (name), met by shared signatures."""
    keyed = names.select("name").distinct().withColumn("key", g.key_of("name")).where("key != ''")
    rows = materialize(keyed.select("name", "key", F.explode(g.signatures_of("key")).alias("s")))  # read by both sides
    other = rows.select(F.col("name").alias("b"), F.col("key").alias("kb"), "s")
    pairs = rows.join(other, "s").where("name < b").select(F.col("name").alias("a"), "b", F.col("key").alias("ka"), "kb").distinct()
    return pairs.select("a", "b", g.reason_of("ka", "kb").alias("reason")).where("reason is not null")


def blocks(pairs: DataFrame) -> DataFrame:
    """name and block (its least name) of the names connected by pairs (a, b)."""
    both = materialize(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    label = materialize(both.select(F.col("a").alias("name"), F.least("a", "b").alias("block")).groupBy("name").agg(F.min("block").alias("block")))
    while True:
        near = both.join(label.withColumnRenamed("name", "b"), "b").groupBy(F.col("a").alias("name")).agg(F.min("block").alias("near"))
        new = label.join(near, "name").select("name", F.least("block", "near").alias("block"), (F.col("near") < F.col("block")).alias("moved"))
        # a block that has moved itself takes its names along
        jump = new.select(F.col("name").alias("block"), F.col("block").alias("over"))
        new = materialize(new.join(jump, "block", "left").select("name", F.least("block", F.coalesce("over", "block")).alias("block"), "moved"))
        label = new.drop("moved")
        if new.where("moved").isEmpty():
            return label


def duplicate_groups(names: DataFrame, pairs: DataFrame) -> DataFrame:
    """name and group (its first name): complete-link groups of two or more, in
    the order of names. Names of a block alone are looked at together."""
    pairs = materialize(pairs)
    found = blocks(pairs)
    links = pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a"))).groupBy("a").agg(F.collect_set("b").alias("like"))
    rows = found.join(links, F.col("name") == F.col("a")).select("block", "name", "like")

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        groups: list[list[str]] = []
        for name, like in sorted(zip(pdf.name, map(set, pdf.like))):
            home = next((x for x in groups if all(y in like for y in x)), None)
            home.append(name) if home else groups.append([name])
        return pd.DataFrame([(n, x[0]) for x in groups if len(x) > 1 for n in x], columns=["name", "group"])

    return rows.groupBy("block").applyInPandas(group, "name string, group string")


def merged(tags: DataFrame, sources: list[str], target: str | None) -> DataFrame:
    """tags with the sources renamed to target (None: removed), each once an item."""
    hit = F.col("tag").isin(sources)
    rows = tags.where(~hit) if target is None else tags.withColumn("tag", F.when(hit, target).otherwise(F.col("tag")))
    return rows.distinct()


def format_plan(tags: DataFrame, rules: g.Exclusions = g.Exclusions()) -> DataFrame:
    """tag, to, status (unchanged, structured, invalid, protected, collision, change) and items."""
    rows = usage(tags).withColumn("to", g.formatted_of("tag"))
    existing = rows.select(F.col("tag").alias("to"), F.lit(True).alias("taken"))
    same = F.count("*").over(Window.partitionBy("to"))
    rows = rows.withColumn("same", same).join(existing, "to", "left")
    status = F.when(F.col("tag").rlike(r"[:/\\_]|^\s*##"), "structured").when(F.col("tag") == F.col("to"), "unchanged")
    status = status.when((F.col("to") == "") | (F.length("to") > 255) | F.col("to").rlike(r"[\x00-\x1f\x7f]"), "invalid").when(excluded("to", rules), "protected")
    status = status.when(F.col("taken") | (F.col("same") > 1), "collision").otherwise("change")
    return rows.select("tag", "to", status.alias("status"), "items")


def phrases(corpus: DataFrame, most: int = 128) -> DataFrame:
    """doc_key, phrase and its counts in title, abstract and body: specific
    phrases in the title and elsewhere, twice in the abstract or three times in
    the body, the best."""
    # names are looked at only where their counts can suffice; rows that share a key are one document, of which none has all counts
    one = corpus.groupBy("doc_key").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    whole = F.concat_ws("\n", "title", "abstract", "body")
    rows = corpus.select("doc_key", F.array(*[g.runs_of_words(c) for c in ("title", "abstract", "body")]).alias("runs"), F.lit(True).alias("every") if not one else (nfkc_of(whole) != whole).alias("every"), F.coalesce((F.trim("abstract") == "") & (F.trim("body") == ""), F.lit(False)).alias("bare"))
    spelt = rows.mapInArrow(g.grams_of_runs, "doc_key string, phrase string, t long, a long, b long")
    if not one:
        spelt = spelt.groupBy("doc_key", "phrase").agg(*[F.sum(k).alias(k) for k in "tab"])
    spelt = spelt.withColumn("field", F.when(F.col("t") > 0, 0).when(F.col("a") > 0, 1).otherwise(2))
    keyed = spelt.withColumn("key", g.normal_text("phrase")).where(g.specific("phrase", "key", F.lit(False)))
    rows = keyed.groupBy("doc_key", "key").agg(F.min_by("phrase", F.struct("field", "phrase")).alias("phrase"), *[F.sum(k).alias(k) for k in "tab"])
    bare = corpus.select("doc_key", ((F.trim("abstract") == "") & (F.trim("body") == "")).alias("bare"))
    rows = rows.join(bare, "doc_key").where(((F.col("t") > 0) & ((F.col("a") > 0) | (F.col("b") > 0) | F.col("bare"))) | (F.col("a") >= 2) | (F.col("b") >= 3))
    order = 4 * F.col("t") + 2 * F.least(F.lit(3), "a") + F.least(F.lit(4), "b")
    place = F.row_number().over(Window.partitionBy("doc_key").orderBy(order.desc(), F.length("phrase").desc(), "phrase"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("doc_key", "phrase", "t", "a", "b")


def scored(evidence: DataFrame, most: int = 192) -> DataFrame:
    """Candidates (query, name, in_title, in_abstract, body_hits, vote, is_new)
    with score, direct and support: direct evidence of the fields, a share of the votes,
    a little less for new names."""
    best = F.greatest(F.lit(1.0), F.max(F.coalesce("vote", F.lit(0.0))).over(Window.partitionBy("query")))
    vote = F.coalesce("vote", F.lit(0.0)) / best
    direct = F.when(F.col("in_title") > 0, 0.84 + F.when(F.col("in_abstract") > 0, 0.04).otherwise(0) + F.when(F.col("body_hits") > 0, 0.02).otherwise(0))
    direct = direct.when(F.col("in_abstract") > 0, 0.65 + F.least(F.lit(0.08), (F.col("in_abstract") - 1) * 0.04))
    direct = direct.when(F.col("body_hits") >= 2, 0.59 + F.least(F.lit(0.09), F.log2("body_hits") * 0.025)).otherwise(0.0)
    rows = evidence.withColumn("support", F.least(F.lit(1.0), vote)).where((F.col("in_title") > 0) | (F.col("in_abstract") > 0) | (F.col("body_hits") >= 2) | F.col("vote").isNotNull())
    rows = rows.withColumn("direct", direct).withColumn("score", F.col("direct") + 0.08 * F.col("support") - F.when(F.col("is_new"), 0.025).otherwise(0.0))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.desc("support"), F.length("name").desc(), "name"))
    return rows.withColumn("place", place).where(F.col("place") <= most).drop("place")


def indexed_hits(names: DataFrame, counted: DataFrame) -> DataFrame:
    """doc_key, name and hits: the fewest places that one of the name's features
    (doc_key, name, feature) has in the body (counted: doc_key, feature, tf), 0
    if one is missing."""
    rows = names.distinct().join(counted.groupBy("doc_key", "feature").agg(F.sum("tf").alias("tf")), ["doc_key", "feature"], "left")
    return rows.groupBy("doc_key", "name").agg(F.min(F.coalesce("tf", F.lit(0))).alias("hits"))


def grounded(candidates: DataFrame) -> DataFrame:
    """Candidates (query, name, score, support, direct, in_title, in_abstract,
    body_hits, is_new, incidental, similarity) that their evidence bears, with
    the score that similarity lifts; similarity is null where no vectors are."""
    c = F.col
    similar = F.when(c("similarity").isNotNull(), F.greatest(c("similarity"), F.lit(0.0)))
    titled = F.max(c("in_title") > 0).over(Window.partitionBy("query"))
    passing = titled & (c("in_title") == 0) & (c("in_abstract") == 1) & (c("body_hits") < 2) & (c("support") == 0)
    unseen = (c("direct") == 0) & ~((c("support") > 0) & F.coalesce(similar >= 0.38, F.lit(False)))
    thin = c("is_new") & (c("in_title") == 0) & (c("in_abstract") == 0) & ~((c("body_hits") >= 3) & F.coalesce(similar >= 0.3, F.lit(True)))
    apart = (c("in_title") == 0) & F.coalesce(similar < 0.25, F.lit(False))
    lifted = c("score") + 0.14 * F.coalesce(similar, F.lit(0.0)) + F.when(c("direct") == 0, 0.45 + 0.22 * c("support")).otherwise(0.0)
    rows = candidates.withColumn("__out", c("incidental") | passing | unseen | thin | apart).where("not __out").drop("__out")
    return rows.withColumn("score", F.least(F.lit(1.0), lifted))


def preferred(groups: DataFrame, uses: DataFrame) -> DataFrame:
    """group and name: of its names (name, group) the one that most items hold
    (uses: tag, items), of several the first."""
    rows = groups.join(uses.select(F.col("tag").alias("name"), "items"), "name", "left").withColumn("items", F.coalesce("items", F.lit(0)))
    top = rows.groupBy("group").agg(F.max("items").alias("items"))
    return rows.join(top, ["group", "items"]).groupBy("group").agg(F.min("name").alias("name"))


def merged_groups(groups: DataFrame, pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """name and group after groups (name, group) and single names grew together
    along edges (a, b, score) of like vectors, best first: two merge if each name
    of one is a duplicate (pairs: a, b) of each of the other or linked to it by an
    edge of compatible names. Names that edges connect are looked at together."""
    ab = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score"))
    own = materialize(groups.select(F.col("group").alias("a"), F.col("name").alias("b")).where("a != b"))
    found = blocks(ab.select("a", "b").union(own))
    rows = [
        ab.select("a", "b", "score", F.lit("edge").alias("kind")),
        pairs.select("a", "b", F.lit(1.0), F.lit("pair")),
        own.select("a", "b", F.lit(1.0), F.lit("group")),
    ]
    told = reduce(DataFrame.union, rows).join(found.withColumnRenamed("name", "a"), "a")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        linked = {frozenset((a, b)) for a, b, kind in zip(pdf.a, pdf.b, pdf.kind) if kind == "pair" or (kind == "edge" and g.compatible(a, b))}
        home: dict[str, list[str]] = {}
        for first, name in pdf[pdf.kind == "group"][["a", "b"]].itertuples(index=False):
            home.setdefault(first, [first]).append(name)
        for members in list(home.values()):
            home.update(dict.fromkeys(members, members))
        for a, b in pdf[pdf.kind == "edge"].sort_values(["score", "a", "b"], ascending=[False, True, True])[["a", "b"]].itertuples(index=False):
            x, y = home.get(a, [a]), home.get(b, [b])
            if x is not y and all(frozenset((p, q)) in linked for p in x for q in y):
                home.update(dict.fromkeys([*x, *y], [*x, *y]))
        return pd.DataFrame([(n, min(members)) for n, members in home.items()], columns=["name", "group"])

    return told.groupBy("block").applyInPandas(merge, "name string, group string")


def added(tags: DataFrame, card_ids: DataFrame, names: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """tags with each name given to each card, and the names (name) refused:
    empty, over 255 characters, with control characters, or not known (tag)."""
    bad = (F.trim("name") == "") | (F.length("name") > 255) | F.col("name").rlike(r"[\x00-\x1f\x7f]")
    rows = names.select("name").distinct()
    rows = rows.withColumn("known", F.lit(True)) if known is None else rows.join(known.select(F.col("tag").alias("name"), F.lit(True).alias("known")).distinct(), "name", "left")
    rows = rows.withColumn("bad", F.coalesce(bad, F.lit(True)) | F.col("known").isNull())
    # a list that somebody has chosen, for cards that somebody has chosen
    given = card_ids.select("card_id").distinct().join(rows.where("not bad").select(F.col("name").alias("tag")), F.lit(True))
    return tags.select("card_id", "tag").union(given).distinct(), rows.where("bad").select("name")


def applied(tags: DataFrame, plan: DataFrame, now: DataFrame) -> DataFrame:
    """tags after a plan (tag, to, status, items) was carried out where making it
    now gives the same row; what has changed in between stays as it is."""
    same = plan.where("status = 'change'").join(now.select(*[F.col(k).alias(f"{k}2") for k in ("tag", "to", "status", "items")]), F.col("tag") == F.col("tag2"))
    good = same.where("to = to2 and status = status2 and items = items2").select("tag", "to")
    return tags.join(good, "tag", "left").select("card_id", F.coalesce("to", "tag").alias("tag")).distinct()


def vocabulary(tags: DataFrame, notes: DataFrame, rules: g.Exclusions = g.Exclusions()) -> DataFrame:
    """library and its visible tags."""
    return tags.join(notes.select(F.col("id").alias("card_id"), "library"), "card_id").where(~excluded("tag", rules)).select("library", "tag").distinct()


def searched(names: DataFrame, text: str, groups: DataFrame | None = None) -> DataFrame:
    """Names (tag) that hold the text as written or by their parted words; with
    groups (name, group) all names of a group of which one does."""
    low = g.words(text)
    want, key = unicodedata.normalize("NFKC", text).strip().lower(), " ".join(low).lower()
    hit = F.contains(F.lower(nfkc_of("tag")), F.lit(want)) | F.contains(g.key_of("tag"), F.lit(key))
    found = names.where(hit).select("tag")
    if groups is None:
        return found
    whole = groups.join(groups.join(found.withColumnRenamed("tag", "name"), "name", "left_semi").select("group").distinct(), "group", "left_semi")
    return found.union(whole.select(F.col("name").alias("tag"))).distinct()


def ordered(uses: DataFrame, by: str = "count", down: bool | None = None) -> DataFrame:
    """Tags (tag, items, group) by name, count or group; counts go down unless said otherwise."""
    column = {"name": "tag", "count": "items", "group": "group"}[by]
    down = by == "count" if down is None else down
    return uses.orderBy(F.desc(column) if down else F.asc(column), "tag")


class Relations:
    """How the names of one list relate, as tables over all pairs: within (one
    stands in the other, as whole words), alike (they may mean the same), same
    (duplicates), near (by vectors) and affinity, from 0 to 1."""

    def __init__(self, names: list[str], near: dict[frozenset, float]):
        n, at = len(names), {name: i for i, name in enumerate(names)}
        self.keys = [g.key(name) for name in names]
        padded = [f" {k} " for k in self.keys]
        self.within = np.array([[a != b and a in b for b in padded] for a in padded], bool).reshape(n, n)
        kinds: dict = {}
        profile = np.array([kinds.setdefault(tuple(frozenset(c.items()) for c in g.profile(k)), len(kinds)) for k in self.keys], int)
        free = ~np.array([g.structured(name) for name in names], bool)
        symbols = np.array([bool({"+", "#"} & set(k)) for k in self.keys], bool)
        apart = (symbols[:, None] | symbols) & np.array([[a != b for b in padded] for a in padded], bool).reshape(n, n)
        self.alike = (profile[:, None] == profile) & free[:, None] & free & ~apart
        self.same = np.zeros((n, n), bool)
        by_mark: dict[str, list[int]] = {}
        for i, k in enumerate(self.keys):
            for mark in g.signatures(k):
                for j in by_mark.setdefault(mark, []):
                    self.same[i, j] = self.same[j, i] = self.same[i, j] or g.duplicate_reason(k, self.keys[j]) is not None
                by_mark[mark].append(i)
        self.near = np.zeros((n, n))
        for pair, score in near.items():
            i, j = (at.get(x, -1) for x in sorted(pair))
            if min(i, j) >= 0:
                self.near[i, j] = self.near[j, i] = score
        stems = [set(g.tokens(k)) for k in self.keys]
        place = {w: j for j, w in enumerate(sorted(set().union(*stems)))}
        held = np.zeros((n, len(place)))
        for i, own in enumerate(stems):
            held[i, [place[w] for w in own]] = 1
        size = held.sum(1)
        overlap = held @ held.T / np.sqrt(np.maximum(size[:, None] * size, 1))
        inside = self.within | self.within.T
        self.affinity = np.maximum(np.where(self.same | (self.alike & inside), 1.0, np.where(self.alike, overlap, 0.0)), self.near)
        np.fill_diagonal(self.same, False)
        np.fill_diagonal(self.affinity, 0.0)

    def needed(self, score: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Which names others don't make needless. New ones go if an existing one
        means the same, or two or more existing ones that stand in them leave no
        word over; of what is left, names that stand in another of about their
        score or more; of the rest, new ones close to an existing one."""
        same = self.same | (self.alike & (self.near >= 0.86))
        spoken = [{w for i in np.flatnonzero(self.within[:, j] & ~new) for w in self.keys[i].split(" ")} for j in range(len(new))]
        whole = np.array([set(k.split(" ")) <= w for k, w in zip(self.keys, spoken)], bool).reshape(len(new))
        made = whole & ((self.within & ~new[:, None]).sum(0) >= 2)
        stays = ~(new & ((same & ~new).any(1) | made))
        stays &= ~(self.within & self.alike & (score >= score[:, None] - 0.08) & stays).any(1)
        return stays & ~(new & ((self.affinity >= 0.86) & (stays & ~new)).any(1))


def selected(candidates: DataFrame, edges: DataFrame | None = None, least: float = 0.58) -> DataFrame:
    """query, name, place: of the candidates (query, name, score, is_new: no if
    left out) that are needed, names chosen one by one by score less redundancy
    with those chosen; at most 192 a query. edges (a, b, score) tell like names by
    vectors."""
    if "is_new" not in candidates.columns:
        candidates = candidates.withColumn("is_new", F.lit(False))
    if has_edges := edges is not None:
        near = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")
        names = candidates.select("query", "name")
        near = near.join(names.withColumnRenamed("name", "a"), "a").join(names.withColumnRenamed("name", "b"), ["query", "b"])
        near = near.groupBy("query").agg(F.collect_list(F.struct("a", "b", "score")).alias("near"))
        candidates = candidates.join(near, "query", "left")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        told = pdf["near"].iloc[0] if has_edges else None
        rows = pdf.assign(long=-pdf.name.str.len()).sort_values(["score", "long", "name"], ascending=[False, True, True]).drop_duplicates("name")
        names, score = rows.name.tolist(), rows.score.to_numpy(float)
        of = Relations(names, {frozenset((x["a"], x["b"])): x["score"] for x in (told if told is not None else ())})
        open_ = of.needed(score, rows.is_new.to_numpy(bool)) & (score >= least)
        redundancy, taken = np.zeros(len(names)), []
        while True:
            gain = np.where(open_ & (redundancy < 0.86), score - 0.48 * redundancy - (0.14 + 0.12 * len(taken)), 0.0)
            if not len(gain) or gain.max() <= 0:
                break
            taken.append(int(gain.argmax()))
            open_[taken[-1]] = False
            redundancy = np.maximum(redundancy, of.affinity[:, taken[-1]])
        return pd.DataFrame([(pdf["query"].iloc[0], names[i], place) for place, i in enumerate(taken, 1)], columns=["query", "name", "place"])

    return candidates.groupBy("query").applyInPandas(choose, "query string, name string, place int")
