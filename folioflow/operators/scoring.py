"""Scores of candidate systems against gold, set-wise; and dataset degradations that make candidate systems.

Gold and candidates are long tables (doc, pos, text, ...).  Sequence alignment is in `alignment`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise, prf1, shuffle_key
from . import alignment


def rounded(columns: dict[str, Column], places: int = 6) -> list[Column]:
    return [F.round(c, places).alias(n) for n, c in columns.items()]


def multiset_counts(gold: DataFrame, cand: DataFrame, doc: str, name: str) -> DataFrame:
    """(doc, matched, n_gold, n_cand) of two bags of names.  One aggregation over both sides, no join."""
    sided = gold.select(doc, name, F.lit(1).alias("g"), F.lit(0).alias("c")).unionByName(cand.select(doc, name, F.lit(0).alias("g"), F.lit(1).alias("c")))
    return bag_counts(sided, doc, name)


def bag_counts(sided: DataFrame, doc: str, name: str) -> DataFrame:
    """The same from rows (doc, name, g, c) that tell how often a name stands on either side."""
    per_name = sided.groupBy(doc, name).agg(F.sum("g").alias("g"), F.sum("c").alias("c"))
    return per_name.groupBy(doc).agg(F.sum(F.least("g", "c")).alias("matched"), F.sum("g").alias("n_gold"), F.sum("c").alias("n_cand"))


def multiset_prf1(gold: DataFrame, cand: DataFrame, doc: str, name: str) -> DataFrame:
    counts = multiset_counts(gold, cand, doc, name)
    return counts.select(doc, "matched", "n_gold", "n_cand", *rounded(prf1(F.col("matched"), F.col("n_gold"), F.col("n_cand"))))


def kth_matches(gold: DataFrame, cand: DataFrame, doc: str, key: str, pos: str) -> DataFrame:
    """Exact matches in which the k-th of equal texts meets the k-th: (doc, g, c)."""
    rank = F.row_number().over(Window.partitionBy(doc, key).orderBy(pos))
    side = lambda df, as_: df.withColumn("k", rank).select(doc, key, "k", F.col(pos).alias(as_))
    return side(gold, "g").join(side(cand, "c"), [doc, key, "k"]).select(doc, "g", "c")


def reading_order(matches: DataFrame, doc: str) -> DataFrame:
    """(doc, matched, discordant, accuracy): pairs of matches in the same order on both sides; null below two.

    Inversions are counted inside one list for each document, so no pair becomes a row.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("g", "c"))), lambda x: x["c"].cast("long"))
    counted = alignment.inversion_counts(matches.groupBy(doc).agg(ordered.alias("cs")), doc)
    n = F.col("matched")
    pairs = n * (n - 1) / 2
    return counted.select(doc, "matched", "discordant", F.when(n >= 2, F.round((pairs - F.col("discordant")) / pairs, 6)).alias("accuracy"))


def positional_match(gold: DataFrame, cand: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(doc, n, equal, rate) over positions that both sides have; keys are doc and position."""
    joined = gold.select(*keys, F.col(value).alias("g")).join(cand.select(*keys, F.col(value).alias("c")), keys)
    same = F.count_if(F.col("g").eqNullSafe(F.col("c")))
    return joined.groupBy(keys[0]).agg(F.count(F.lit(1)).alias("n"), same.alias("equal"), F.round(same / F.count(F.lit(1)), 6).alias("rate"))


def id_preservation(gold: DataFrame, cand: DataFrame, keys: list[str], native_id: str) -> DataFrame:
    """Share of gold ids that stand at the same place in the candidate; null where gold has no id."""
    joined = gold.select(*keys, F.col(native_id).alias("g")).join(cand.select(*keys, F.col(native_id).alias("c")), keys, "left")
    known, same = F.count("g"), F.count_if(F.coalesce(F.col("g") == F.col("c"), F.lit(False)))
    return joined.groupBy(keys[0]).agg(known.alias("n_ids"), same.alias("kept_ids"), F.when(known > 0, F.round(same / known, 6)).alias("preservation"))


def label_accuracy(gold: DataFrame, cand: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Accuracy of labels by position, over the shorter side, with a status for what cannot be scored."""
    sized = lambda df, n: df.groupBy(keys[0]).agg(F.count(F.lit(1)).alias(n))
    counts = sized(gold, "n_gold").join(sized(cand, "n_cand"), keys[0], "full").select(keys[0], *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_gold", "n_cand")])
    same = positional_match(gold, cand, keys, label).select(keys[0], "n", "equal")
    joined = counts.join(same, keys[0], "left")
    status = F.when(F.col("n_gold") == 0, "not_applicable: no_gold_ground_truth").when(F.col("n_cand") == 0, "undefined: no_candidate").otherwise("scored")
    return joined.select(keys[0], "n_gold", "n_cand", F.when(status == "scored", F.round(F.coalesce(F.col("equal") / F.least("n_gold", "n_cand"), F.lit(0.0)), 6)).alias("accuracy"), status.alias("status"))


def label_mismatches(gold: DataFrame, cand: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(doc, position, gold_label, cand_label) of compared positions whose labels differ; a gold label that is null says
    nothing."""
    joined = gold.select(*keys, F.col(label).alias("gold_label")).join(cand.select(*keys, F.col(label).alias("cand_label")), keys)
    return joined.where(F.col("gold_label").isNotNull() & ~F.col("gold_label").eqNullSafe(F.col("cand_label")))


def exact_match(gold: DataFrame, cand: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(doc, n, equal, rate) of gold's texts that stand at the same place in the candidate, normalised."""
    same = F.coalesce(normalise(F.col("g")) == normalise(F.col("c")), F.lit(False))
    joined = gold.select(*keys, F.col(text).alias("g")).join(cand.select(*keys, F.col(text).alias("c")), keys, "left")
    return joined.groupBy(keys[0]).agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("equal"), F.round(F.count_if(same) / F.count(F.lit(1)), 6).alias("rate"))


def edge_prf1(gold: DataFrame, cand: DataFrame, doc: str, columns: list[str]) -> DataFrame:
    """Precision, recall and F1 on distinct edges."""
    sided = gold.select(doc, *columns, F.lit(1).alias("g"), F.lit(0).alias("c")).unionByName(cand.select(doc, *columns, F.lit(0).alias("g"), F.lit(1).alias("c")))
    edges = sided.groupBy(doc, *columns).agg(F.max("g").alias("g"), F.max("c").alias("c"))  # by the columns as they are, once
    counts = edges.groupBy(doc).agg(F.sum(F.least("g", "c")).alias("matched"), F.sum("g").alias("n_gold"), F.sum("c").alias("n_cand"))
    return counts.select(doc, "matched", "n_gold", "n_cand", *rounded(prf1(F.col("matched"), F.col("n_gold"), F.col("n_cand"))))


def capability_gate(scores: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Scores of a system that lacks the capability become null with a status; rows never vanish.

    `capabilities` has a row for each (system, metric), with `capable`."""
    joined = scores.join(capabilities, ["system", "metric"], "left")
    ok = F.coalesce("capable", F.lit(False))
    return joined.select(*[c for c in scores.columns if c != "value"], F.when(ok, F.col("value")).alias("value"), F.when(~ok, "not_applicable: unsupported").when(F.col("value").isNull(), "undefined").otherwise("scored").alias("status"))


def caption_scores(sides: DataFrame, doc: str, capable: dict[str, bool]) -> DataFrame:
    """F1 of caption texts in order (doc, metric, system, value, status); null for systems that tell no captions.
    `sides` has doc, gold and cand lists."""
    scored = alignment.align(sides, doc).select(doc, F.lit("caption_f1").alias("metric"), F.explode(F.array(*[F.lit(s) for s in capable])).alias("system"), F.col("f1").alias("value"))
    flags = sides.sparkSession.createDataFrame([(s, "caption_f1", c) for s, c in capable.items()], "system string, metric string, capable boolean")
    return capability_gate(scored, flags).select(doc, "metric", "system", "value", "status")


def micro_macro(counts: DataFrame, group: str) -> DataFrame:
    """Micro (sums first) and macro (mean of documents) F1 of (matched, n_gold, n_cand) rows."""
    f1 = prf1(F.col("matched"), F.col("n_gold"), F.col("n_cand"))["f1"]
    sums = counts.withColumn("f1", f1).groupBy(group).agg(*[F.sum(c).alias(c) for c in ("matched", "n_gold", "n_cand")], F.round(F.avg("f1"), 6).alias("macro_f1"))
    return sums.select(group, F.round(prf1(F.col("matched"), F.col("n_gold"), F.col("n_cand"))["f1"], 6).alias("micro_f1"), "macro_f1")


def composite(*parts: DataFrame, key: str) -> DataFrame:
    """Scores of one document side by side; a document that a part does not have gets nulls."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, key, "full")
    return out


def render_equivalence(gold: DataFrame, cand: DataFrame, key: str) -> DataFrame:
    """Whether both renderings have as many pages; null unless both were rendered.  Columns: key, status, page_count."""
    side = lambda df, s: df.select(key, F.col("status").alias(f"status_{s}"), F.col("page_count").alias(f"pages_{s}"))
    joined = side(gold, "g").join(side(cand, "c"), key, "left")
    both = F.coalesce((F.col("status_g") == "rendered") & (F.col("status_c") == "rendered"), F.lit(False))
    return joined.select(key, F.when(both, F.col("pages_g") == F.col("pages_c")).alias("equivalent"), F.when(both, "scored").otherwise("not_applicable: not_rendered").alias("status"))


def baseline_row(counts: DataFrame, doc: str, kinds: list[str]) -> DataFrame:
    """Capped count recalls of several kinds side by side; `counts` has gold_<kind> and cand_<kind>."""
    recall = lambda k: F.when(F.col(f"gold_{k}") > 0, F.round(F.least(f"gold_{k}", f"cand_{k}") / F.col(f"gold_{k}"), 6))
    return counts.select(doc, *[recall(k).alias(f"{k}_recall") for k in kinds])


def graph_error_rates(nodes: DataFrame, edges: DataFrame, doc: str, node: str = "node_id") -> DataFrame:
    """Per document the shares of nodes whose id is repeated, of nodes without an incoming edge, and of edges whose
    target is no node."""
    per_id = nodes.groupBy(doc, node).agg(F.count(F.lit(1)).alias("n"))
    targets = edges.select(doc, F.col("dst").alias(node)).distinct().withColumn("hit", F.lit(True))
    known = per_id.join(targets, [doc, node], "left")
    by_doc = known.groupBy(doc).agg(F.sum("n").alias("nodes"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("repeated"), F.sum(F.when(F.col("hit").isNull(), F.col("n")).otherwise(0)).alias("orphans"))
    lost = edges.select(doc, F.col("dst").alias(node)).join(per_id.select(doc, node, F.lit(True).alias("known")), [doc, node], "left")
    lost = lost.groupBy(doc).agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("known").isNull()).alias("unresolved"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6))
    return by_doc.join(lost, doc, "left").select(doc, rate("repeated", "nodes").alias("duplicate_rate"), rate("orphans", "nodes").alias("orphan_rate"), rate("unresolved", "edges").alias("unresolved_rate"))


# --- degradations -------------------------------------------------------------------------------------------------


def null_ids(items: DataFrame) -> DataFrame:
    return items.withColumn("para_id", F.lit(None).cast("string"))


def flatten_markup(items: DataFrame, column: str = "text") -> DataFrame:
    """Tags go; the flat text stays."""
    return items.withColumn(column, F.regexp_replace(column, "<[^>]+>", ""))


def shuffle_order(items: DataFrame, doc: str = "doc_id", pos: str = "ord", seed: str = "20260828") -> DataFrame:
    """The same paragraphs in a seeded order within each document."""
    rank = F.row_number().over(Window.partitionBy(doc).orderBy(shuffle_key(F.lit(seed), F.col(doc).cast("string"), F.col(pos).cast("string")), pos))
    return items.withColumn(pos, (rank - 1).cast("long"))


def drop_tables(items: DataFrame, is_table: Column) -> DataFrame:
    return items.where(~F.coalesce(is_table, F.lit(False)))


ABLATIONS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "none": lambda df: df,
    "null_ids": null_ids,
    "flatten_markup": flatten_markup,
    "shuffle_order": shuffle_order,
    "drop_tables": lambda df: drop_tables(df, F.contains("text", F.lit(" | "))),
}


def ablated(items: DataFrame, names: list[str] | None = None) -> DataFrame:
    """All degraded copies in one table, with an `ablation` column."""
    out = None
    for name in names or list(ABLATIONS):
        one = ABLATIONS[name](items).withColumn("ablation", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
