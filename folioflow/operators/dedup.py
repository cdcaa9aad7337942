"""Duplicate groups, contamination, screening totals, ledgers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import Tables
from .graph import connected_components

#: sentinels of the screening ledger (fixed values)
SENTINELS = {"license_status": "unknown_pending_review", "pii_status": "not_assessed", "render_status": "not_run", "admission": "not_admitted", "split": "unassigned"}


def duplicate_groups(items: DataFrame, key: Column, member: str, *, least: int = 2) -> DataFrame:
    """(key, n, first_member) for keys with several members.  Counts combine map-side; members are not gathered,
    so a group of any size costs one row: join back on the key for its members."""
    return items.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min(member).alias("first_member")).where(F.col("n") >= least)


def content_duplicates(items: DataFrame, content: Column, raw: Column) -> DataFrame:
    """Groups of equal content among different bytes."""
    grouped = items.groupBy(content.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(raw).alias("n_raw"))
    return grouped.where((F.col("n") > 1) & (F.col("n_raw") > 1))


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: how many distinct keys both sides hold, and whether they are free of each other."""
    shared = left.select(key).distinct().join(right.select(key).distinct(), key, "left_semi")
    return shared.agg(F.count(F.lit(1)).alias("shared"), (F.count(F.lit(1)) == 0).alias("contamination_free"))


def near_classes(tables: Tables, items: DataFrame, item: str, feature: str, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, near): the class `c` of every item `i` (the smallest item of its feature set) with the class's size
    `n_members`; and all pairs a < b of classes whose sets reach a Jaccard similarity of `least` (above 0), with it.

    Items of equal sets are one class and are compared once, by its first member.  Classes are blocked by prefixes: of
    two sets that reach `least`, each holds one of the other's rarest n - ceil(least * n) + 1 features among its own,
    in one order of all features, so no pair is missed.  Items without features are in no class.
    """
    own = items.select(F.col(item).alias("i"), F.col(feature).alias("f")).where(F.col("i").isNotNull() & F.col("f").isNotNull()).distinct()
    own = tables.save(own, "own")  # read twice; made of whole texts once
    keys = own.groupBy("i").agg(F.sha2(F.to_json(F.array_sort(F.collect_list("f"))), 256).alias("k"), F.count(F.lit(1)).alias("n"))
    keys = tables.save(keys, "keys")
    classes = tables.save(keys.groupBy("k").agg(F.min("i").alias("c"), F.first("n").alias("n"), F.count(F.lit(1)).alias("n_members")), "classes")
    alone = classes.where(F.col("n_members") == 1).select("c", F.col("c").alias("i"), "n_members")
    copied = keys.select("i", "k").join(classes.where(F.col("n_members") > 1).select("k", "c", "n_members"), "k").select("c", "i", "n_members")
    sets = tables.save(own.withColumnRenamed("i", "c").join(classes.select("c", "n"), "c"), "sets")
    ranked = sets.join(sets.groupBy("f").agg(F.count(F.lit(1)).alias("often")), "f")
    place = F.row_number().over(Window.partitionBy("c").orderBy("often", "f"))
    prefix = ranked.withColumn("place", place).where((F.col("place") <= F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1) & (F.col("often") > 1)).select("c", "f", "n")
    prefix = tables.save(prefix, "prefix")
    reach = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= least * F.greatest("na", "nb"))
    sized = prefix.toDF("a", "f", "na").join(prefix.toDF("b", "f", "nb"), "f").where(reach).select("a", "b", "na", "nb").distinct()
    left, right = sets.select(F.col("c").alias("a"), "f"), sets.select(F.col("c").alias("b"), "f")
    both = sized.join(left, "a").join(right, ["b", "f"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    score = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    near = both.where(score >= least).select("a", "b", F.round(score, 6).alias("jaccard"))
    return alone.unionByName(copied), near


def near_duplicate_pairs(tables: Tables, items: DataFrame, item: str, feature: str, least: float = 0.8, *, copies: bool = False) -> DataFrame:
    """(a, b, n_a, n_b, jaccard): near pairs of classes by their smallest items, and how many items share each set.
    A class of several items also stands beside itself, with similarity 1, so that no link is lost; its pairs are not
    listed one by one.  With `copies` each further item of a class has a row beside its first, so that the rows tell
    every item that is linked; they grow with the items."""
    members, near = near_classes(tables, items, item, feature, least)
    members = tables.save(members, "members")
    sizes = members.groupBy("c").agg(F.max("n_members").alias("n"))
    across = near.join(sizes.toDF("a", "n_a"), "a").join(sizes.toDF("b", "n_b"), "b")
    within = sizes.where(F.col("n") > 1).select(F.col("c").alias("a"), F.col("c").alias("b"), F.col("n").alias("n_a"), F.col("n").alias("n_b"), F.lit(1.0).alias("jaccard"))
    rows = across.select("a", "b", "n_a", "n_b", "jaccard").unionByName(within)
    if copies:
        n = F.col("n_members")
        rows = rows.unionByName(members.where(F.col("i") != F.col("c")).select(F.col("c").alias("a"), F.col("i").alias("b"), n.alias("n_a"), n.alias("n_b"), F.lit(1.0).alias("jaccard")))
    return rows


def collisions(members: DataFrame, near: DataFrame, places: DataFrame, item: str, side: list[str]) -> DataFrame:
    """(side_a, side_b, pairs): near pairs of items between two different sides, each unordered, by counts of items by
    class and side; no pair of items is made.  `places` has the item and the columns of a side; null sides meet none."""
    known = places.where(~reduce(lambda x, y: x | y, [F.col(c).isNull() for c in side])).select(F.col(item).alias("i"), F.struct(*side).alias("side"))
    held = members.join(known, "i").groupBy("c", "side").agg(F.count(F.lit(1)).alias("n"))
    one, other = held.toDF("a", "side_a", "n_a"), held.toDF("b", "side_b", "n_b")
    linked = near.select("a", "b").unionByName(near.select(F.col("a").alias("b"), F.col("b").alias("a")))
    apart = linked.join(one, "a").join(other, "b").where(F.col("side_a") < F.col("side_b"))
    same = one.withColumn("b", F.col("a")).join(other, "b").where(F.col("side_a") < F.col("side_b"))
    rows = apart.select("side_a", "side_b", "n_a", "n_b").unionByName(same.select("side_a", "side_b", "n_a", "n_b"))
    return rows.groupBy("side_a", "side_b").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("pairs"))


def lineage(tables: Tables, documents: DataFrame, lines: DataFrame, doc: str = "doc_id", text_key: str = "text_key", feature: str = "f", least: float = 0.8) -> DataFrame:
    """(doc, class_id, lineage_id, n_links, n_family) of every document: its family is all that it reaches over equal
    texts and near line sets, and takes the name of its smallest document.

    `documents` has the doc and a `text_key` that is equal where texts are the same (exactly, or normalised; null for
    texts without content), `lines` the features of each document.  n_links counts the other documents that are linked
    directly by their line sets, equal sets included; class_id is the smallest document of the same set.  A document
    without lines and text key is a family of its own; repeated rows of a document are one.
    """
    docs = documents.where(F.col(doc).isNotNull()).groupBy(F.col(doc).alias("i")).agg(F.min(text_key).alias("t"))
    docs = tables.save(docs, "docs")  # read three times; made of whole texts once
    members, near = near_classes(tables, lines, doc, feature, least)
    members, near = tables.save(members, "members"), tables.save(near, "near")
    named = docs.where(F.col("t").isNotNull())
    first = named.groupBy("t").agg(F.min("i").alias("b"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("t", "b")
    stars = named.join(first, "t").select(F.col("i").alias("a"), "b")
    edges = stars.unionByName(near.select("a", "b")).unionByName(members.select(F.col("i").alias("a"), F.col("c").alias("b")))
    found = tables.save(connected_components(tables, edges), "families")
    sizes = members.groupBy("c").agg(F.max("n_members").alias("n"))
    sides = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beyond = sides.join(sizes.toDF("b", "n"), "b").groupBy("a").agg(F.sum("n").alias("beyond")).withColumnRenamed("a", "c")
    linked = members.join(beyond, "c", "left").select("i", F.col("c").alias("class_id"), (F.col("n_members") - 1 + F.coalesce("beyond", F.lit(0))).alias("n_links"))
    rows = docs.select("i").join(found.select(F.col("v").alias("i"), "comp"), "i", "left").join(linked, "i", "left")
    rows = rows.select(F.col("i").alias(doc), F.coalesce("class_id", "i").alias("class_id"), F.coalesce("comp", "i").alias("lineage_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    rows = tables.save(rows, "lineage")
    families = rows.groupBy("lineage_id").agg(F.count(F.lit(1)).alias("n_family"))
    return rows.join(families, "lineage_id").select(doc, "class_id", "lineage_id", "n_links", "n_family")


def ledger(items: DataFrame, meta: DataFrame, key: str, digest: str = "sha256") -> DataFrame:
    """A row for each item with sentinels where no metadata is known; the id is the head of the hash."""
    known = meta.select(key, *[c for c in SENTINELS if c in meta.columns])
    joined = items.join(known, key, "left")
    filled = [F.coalesce(F.col(c), F.lit(v)).alias(c) if c in known.columns else F.lit(v).alias(c) for c, v in SENTINELS.items()]
    return joined.select(key, F.coalesce(F.substring(digest, 1, 16), F.lit("unhashable")).alias("ledger_id"), *filled)


def multiset_difference(before: Column, after: Column) -> Column:
    """Elements of one list that the other does not hold at all, with their repetitions."""
    return F.filter(before, lambda x: ~F.array_contains(after, x))
