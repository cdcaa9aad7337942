"""Relational operators on document structure: nodes, containment, anchors, as-of resolution, plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import paragraphs


def paragraph_nodes(docs: DataFrame, doc: str = "doc_id", text: str = "text", native_id: Column | None = None) -> DataFrame:
    """(doc, ord, node_id, text): a synthetic id where a paragraph has no id of its own."""
    rows = docs.select(doc, F.posexplode_outer(paragraphs(F.col(text))).alias("ord", "text")).where(F.col("ord").isNotNull())
    synthetic = F.concat(F.lit("para-synthetic-"), F.col("ord").cast("string"))
    return rows.select(doc, F.col("ord").cast("long").alias("ord"), (F.coalesce(native_id, synthetic) if native_id is not None else synthetic).alias("node_id"), "text")


def ambiguous_ids(nodes: DataFrame, doc: str, node: str) -> DataFrame:
    """Ids that a document uses more than once."""
    return nodes.where(F.col(node).isNotNull()).groupBy(doc, node).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).withColumn("status", F.lit("ambiguous"))


def preceding(rows: DataFrame, group: str, order: list[str], wanted: Column, value: str) -> Column:
    """As-of: the value of the latest earlier row of the group that is wanted."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(wanted, F.col(value)), ignorenulls=True).over(w)


def top_level(nodes: DataFrame, edges: DataFrame, cells: DataFrame, node: str = "node_id") -> DataFrame:
    """Nodes that no cell contains."""
    inside = edges.join(cells.select(F.col(node).alias("src")), "src", "left_semi").select(F.col("dst").alias(node))
    return nodes.join(inside, node, "left_anti")


def children_count(parents: DataFrame, edges: DataFrame, parent: str) -> DataFrame:
    """Number of children of each parent, 0 without any."""
    n = edges.groupBy(F.col("src").alias(parent)).agg(F.count(F.lit(1)).alias("n_children"))
    return parents.join(n, parent, "left").select(*parents.columns, F.coalesce("n_children", F.lit(0)).alias("n_children"))


def text_facts(nodes: DataFrame, doc: str) -> DataFrame:
    """Per document the paragraph count and the hash of its joined text."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    return nodes.groupBy(doc).agg(F.count(F.lit(1)).alias("n_paragraphs"), F.md5(F.array_join(ordered, "\n")).alias("text_md5"))


#: styles that no body paragraph has (fixed values)
NOT_BODY = ("heading", "title", "subtitle")


def body_anchor(paras: Column, at: float = 0.8, shortest: int = 8, snippet: int = 80) -> Column:
    """Head of the eligible paragraph at a share of the way through the document.  `paras` is an array of (text, style);
    paragraphs of a heading's or title's style are not eligible, whatever their text says, nor are short ones."""
    style = lambda p: F.lower(F.coalesce(p["style"], F.lit("")))
    heads = lambda p: reduce(lambda x, y: x | y, [F.startswith(style(p), F.lit(n)) for n in NOT_BODY])
    ok = F.filter(paras, lambda p: (F.length(F.trim(p["text"])) >= shortest) & ~heads(p))
    n = F.size(ok)
    return F.when(n > 0, F.substring(F.get(ok, F.least(F.floor(n * at), n - 1).cast("int"))["text"], 1, snippet))


def resolve_marker(paras: Column, marker: Column) -> Column:
    """Struct (status, position): found only where exactly one paragraph holds the marker."""
    at = F.filter(F.transform(paras, lambda p, i: F.when(F.contains(p, marker), i)), lambda i: i.isNotNull())
    n = F.size(at)
    return F.struct(
        F.when(n == 1, "found").when(n == 0, "not_found").otherwise("ambiguous").alias("status"),
        F.when(n == 1, F.get(at, F.lit(0))).cast("long").alias("position"),
    )


def resolve_marker_rows(items: DataFrame, groups: list[str], text: str, at: str, marker: Column) -> DataFrame:
    """The same for items that are rows, such as equations and tables: (group, status, at).  Groups without an item have
    no row; a null text holds no marker."""
    hit = F.coalesce(F.contains(F.col(text), marker), F.lit(False))
    found = items.groupBy(*groups).agg(F.count_if(hit).alias("n"), F.max(F.when(hit, F.col(at))).alias(at))
    status = F.when(F.col("n") == 1, "found").when(F.col("n") == 0, "not_found").otherwise("ambiguous")
    return found.select(*groups, status.alias("status"), F.when(F.col("n") == 1, F.col(at)).alias(at))


def reorder_plan(headings: DataFrame, doc: str) -> DataFrame:
    """Per document with three headings or more: the non-blank heading nearest the middle (the earlier one of two as
    near), the heading before it, and the next one whose level is no deeper.

    `headings` has doc, i (0-based), text, level.  One array for each document, folded in place.
    """
    one = F.struct(F.col("i").cast("int").alias("i"), "text", "level")
    listed = headings.groupBy(doc).agg(F.array_sort(F.collect_list(one)).alias("hs")).where(F.size("hs") >= 3)
    mid = F.floor(F.size("hs") / 2).cast("int")
    near = F.array_sort(F.transform(F.filter("hs", lambda h: F.trim(F.coalesce(h["text"], F.lit(""))) != ""), lambda h: F.struct(F.abs(h["i"] - mid).alias("off"), h["i"].alias("i"), h["level"].alias("level"))))
    picked = listed.select(doc, "hs", F.get(near, F.lit(0)).alias("p")).where(F.col("p").isNotNull())
    after = F.filter("hs", lambda h: (h["i"] > F.col("p.i")) & (F.col("p.level").isNull() | h["level"].isNull() | (h["level"] <= F.col("p.level"))))
    return picked.select(
        doc,
        F.col("p.i").cast("long").alias("chosen"),
        F.when(F.col("p.i") > 0, F.col("p.i") - 1).cast("long").alias("preceding"),
        F.get(after, F.lit(0))["i"].cast("long").alias("following"),
    )


def chain_depth(parents: DataFrame, child: str, parent: str, most: int = 50) -> DataFrame:
    """Number of steps from each node along its parents until one has no parent or was met before, at most `most` + 1.
    So a cycle of two has depth 2, and a parent that is not defined counts as a step.

    Pointer doubling: each round joins the table with itself and doubles the path that a node knows, so a depth of
    `most` takes log2(most) joins instead of one for each level, and paths hold 2 * `most` ids at the longest.
    """
    up = F.col(parent)
    jump = parents.select(F.col(child).alias("n"), up.alias("up"), F.when(up.isNull(), F.slice(F.array(child), 1, 0)).otherwise(F.array(child)).alias("path"))
    reach = 1
    while reach <= most:
        on = jump.select(F.col("n").alias("m"), F.col("up").alias("far"), F.col("path").alias("more"))
        path = F.when(F.col("more").isNull(), F.col("path")).otherwise(F.concat("path", "more"))
        jump = jump.join(on, jump["up"] == on["m"], "left").select("n", F.col("far").alias("up"), path.alias("path"))
        reach *= 2
    return jump.select(F.col("n").alias(child), F.least(F.size(F.array_distinct("path")), F.lit(most + 1)).cast("long").alias("depth"))
