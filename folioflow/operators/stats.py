"""Reproducible statistics: bootstrap intervals, exact boundary intervals, sign-flip tests, chains, A/B reports.

Draws come from hashed keys, not from a stateful generator, so a result does not depend on partitioning and any
engine can repeat it.  No row holds a group's values: places in a group are told range by range, and replicates are
counts of distinct values, drawn by binomial splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.draws import binomial
from ..functions.tables import Tables, beside
from ..functions.text import draw

REPLICATES = 2000
ALPHA = 0.05
PARTS = 256
#: replicates drawn by one row before rows are dealt to the tasks
BATCH = 40


def placed(values: DataFrame, groups: list[str], value: str, order: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(group, x, k, n): non-null values with their places 0..n-1 in the group by (order, value), and columns to keep.

    A numeric order is cut into 256 equal ranges between a group's least and most, which are sorted apart and begin
    where those before them end; an order of another type is sorted in one task a group."""
    kept = values.where(F.col(value).isNotNull()).select(*groups, F.col(order).alias("_order"), F.col(value).cast("double").alias("x"), *keep)
    part = F.lit(0).cast("long")
    if isinstance(kept.schema["_order"].dataType, T.NumericType):
        at = F.col("_order").cast("double")
        ends = kept.groupBy(*groups).agg(F.min(at).alias("_least"), F.max(at).alias("_most"))
        kept = beside(kept, ends, groups)
        part = F.coalesce(F.width_bucket(at, "_least", "_most", F.lit(PARTS)), F.lit(0).cast("long"))
    kept = kept.select(*groups, "_order", "x", *keep, part.alias("_part"))
    sizes = kept.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_in"))
    whole = Window.partitionBy(*groups)
    before = F.coalesce(F.sum("_in").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = sizes.select(*groups, "_part", before.alias("_before"), F.sum("_in").over(whole).alias("n"))
    ranked = kept.withColumn("_rank", F.row_number().over(Window.partitionBy(*groups, "_part").orderBy("_order", "x")))
    return beside(ranked, begins, [*groups, "_part"]).select(*groups, "x", *keep, (F.col("_before") + F.col("_rank") - 1).alias("k"), "n")


def valued(values: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(group, x, c, k, n): the distinct non-null values of each group with how often they occur, their places 0..n-1
    by value, and how many there are.  Equal values combine on the mappers."""
    counts = values.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("c"))
    return placed(counts, groups, "_x", "_x", ("c",))


def replicated(rows: DataFrame, replicates: int) -> DataFrame:
    """Each row once for each replicate `rep`.  Batches of replicates are dealt to the tasks first, so that few rows
    keep all of them busy as well."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    batch = F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // BATCH)))
    dealt = rows.withColumn("_batch", batch).repartition(tasks, "_batch")
    last = F.least((F.col("_batch") + 1) * BATCH, F.lit(replicates)) - 1
    return dealt.withColumn("rep", F.explode(F.sequence(F.col("_batch") * BATCH, last))).drop("_batch")


def _uniform(seed: str, *parts: Column) -> Column:
    return draw(F.lit(seed), *[p.cast("string") for p in parts])


def resampled(tables: Tables, values: DataFrame, groups: list[str], value: str, seed: str, replicates: int) -> DataFrame:
    """(group, rep, x, m): how often each distinct value comes up in a resample of the group's non-null values.

    Draws are counts.  All n of a replicate start at the root of a binary tree over the group's distinct values in
    their order, and at every node a binomial draw splits them between the halves in proportion to the values counted
    below; so the counts at the leaves are multinomial, as n draws with replacement are.  A replicate costs as many
    rows as values that come up, whatever n is, and levels follow the logarithm of the distinct values."""
    leaves = tables.save(valued(values, groups, value), "values")
    most = leaves.agg(F.max("n")).first()[0] or 1
    levels = (most - 1).bit_length()
    start = leaves.groupBy(*groups).agg(F.sum("c").alias("m")).withColumn("node", F.lit(0).cast("long"))
    rows = replicated(start, replicates)
    for level in range(levels):
        child = F.shiftright("k", levels - level - 1)
        halves = leaves.groupBy(*groups, F.shiftright(child, 1).alias("node")).agg(F.sum(F.when(child % 2 == 0, F.col("c"))).alias("left"), F.sum("c").alias("whole"))
        met = beside(rows, halves, [*groups, "node"])
        taken = met.withColumn("_left", binomial(F.col("m"), F.col("left"), F.col("whole"), _uniform(seed, F.col("rep"), F.lit(level), F.col("node"))))
        sides = F.array(F.struct((2 * F.col("node")).alias("node"), F.col("_left").alias("m")), F.struct((2 * F.col("node") + 1).alias("node"), (F.col("m") - F.col("_left")).alias("m")))
        rows = taken.select(*groups, "rep", F.explode(F.filter(sides, lambda s: s["m"] > 0)).alias("side")).select(*groups, "rep", "side.node", "side.m")
    return beside(rows, leaves.select(*groups, F.col("k").alias("node"), "x"), [*groups, "node"]).select(*groups, "rep", "x", "m")


def bootstrap_ci(tables: Tables, values: DataFrame, groups: list[str], value: str, seed: str = "20260828", replicates: int = REPLICATES, alpha: float = ALPHA) -> DataFrame:
    """(group, n, mean, low, high, method): percentile interval of the mean; null below two values.

    Where all values are 0 or all are 1 the interval is the exact one of a boundary proportion, and nothing is drawn.
    """
    x, n = F.col(value).cast("double"), F.col("n")
    base = values.groupBy(*groups).agg(F.count(value).alias("n"), F.avg(x).alias("mean"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    boundary = (F.col("lo") == F.col("hi")) & F.col("lo").isin(0.0, 1.0)
    base = tables.save(base.withColumn("method", F.when(n < 2, "undefined").when(boundary, "exact_boundary").otherwise("percentile")), "base")
    open_ = beside(values.select(*groups, value), base.where(F.col("method") == "percentile").select(*groups), groups)
    means = resampled(tables, open_, groups, value, seed, replicates).groupBy(*groups, "rep").agg((F.sum(F.col("x") * F.col("m")) / F.sum("m")).alias("mean"))
    # a group's replicates, whose number is a parameter
    sorted_means = means.groupBy(*groups).agg(F.array_sort(F.collect_list("mean")).alias("ms"))
    at = lambda q: F.get("ms", F.lit(q))
    joined = beside(base, sorted_means, groups, "left")
    edge = F.pow(F.lit(alpha / 2), 1.0 / n)
    exact = F.col("method") == "exact_boundary"
    low = F.when(exact, F.when(F.col("lo") == 1.0, edge).otherwise(0.0)).otherwise(at(int(alpha / 2 * replicates)))
    high = F.when(exact, F.when(F.col("lo") == 1.0, F.lit(1.0)).otherwise(1 - edge)).otherwise(at(int((1 - alpha / 2) * replicates) - 1))
    return joined.select(*groups, "n", F.round("mean", 6).alias("mean"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), "method")


def permutation_test(tables: Tables, pairs: DataFrame, groups: list[str], a: str, b: str, seed: str = "20260828", replicates: int = REPLICATES) -> DataFrame:
    """(group, n, difference, p): share of random sign flips whose mean difference is as large as the observed one.
    Pairs with a null side are dropped; p is null below two pairs.

    Of c differences of one size a binomial number of c trials at one half is positive, so a replicate costs a row for
    each distinct size; differences of 0 change nothing and are not drawn."""
    d = F.col(a) - F.col(b)
    rows = pairs.select(*groups, d.cast("double").alias("d")).where(F.col("d").isNotNull())
    whole = tables.save(rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("total")), "totals")
    sizes = valued(rows.where(F.col("d") != 0).select(*groups, F.abs("d").alias("d")), groups, "d").select(*groups, "x", "c", "k")
    up = binomial(F.col("c"), F.lit(1), F.lit(2), _uniform(seed, F.col("rep"), F.col("k")))
    flipped = replicated(sizes, replicates).withColumn("up", up).groupBy(*groups, "rep").agg(F.sum(F.col("x") * (2 * F.col("up") - F.col("c"))).alias("flipped"))
    met = beside(flipped, whole.select(*groups, "total"), groups)
    hits = met.groupBy(*groups).agg(F.avg((F.abs("flipped") >= F.abs("total") - 1e-12).cast("double")).alias("p"))
    joined = beside(whole, hits, groups, "left")
    p = F.when(F.col("n") >= 2, F.round(F.coalesce("p", F.lit(1.0)), 6))  # without a difference every flip is as large
    return joined.select(*groups, "n", F.round(F.col("total") / F.col("n"), 6).alias("difference"), p.alias("p"))


def system_pairs(scores: DataFrame, keys: list[str], system: str, value: str) -> DataFrame:
    """Values of two systems side by side, each unordered pair once."""
    side = lambda s: scores.select(*keys, F.col(system).alias(f"system_{s}"), F.col(value).alias(f"value_{s}"))
    return side("a").join(side("b"), keys).where(F.col("system_a") < F.col("system_b"))


def pair_passed(pair: Column) -> Column:
    return F.coalesce((pair["fwd"] == "pass") & (pair["inv"] == "pass"), F.lit(False))


#: statuses that say nothing about a chain (fixed values)
EXCLUDED = ["not_applicable", "harness_exception", "blocked"]


def chain_outcome(status: Column, pairs: Column) -> Column:
    """Null if excluded or without pairs, else whether every pair passed both ways, as 0 or 1."""
    return F.when(status.isin(EXCLUDED) | pairs.isNull() | (F.size(pairs) == 0), F.lit(None).cast("double")).when(F.forall(pairs, pair_passed), 1.0).otherwise(0.0)


def steady_state(status: Column, pairs: Column) -> Column:
    """Share of the pairs after the first that passed; null if excluded or below two pairs."""
    later = F.slice(pairs, 2, F.greatest(F.size(pairs), F.lit(1)))
    return F.when(status.isin(EXCLUDED) | pairs.isNull() | (F.size(pairs) < 2), F.lit(None).cast("double")).otherwise(F.size(F.filter(later, pair_passed)) / F.size(later))


def by_arm(chains: DataFrame, group: list[str], doc: str, arm: str, outcome: str, seq: str, arms: tuple[str, str] = ("control", "treatment")) -> DataFrame:
    """One row for each group and document with an outcome for each arm; of repeated chains the last one counts."""
    last = chains.where(F.col(outcome).isNotNull()).groupBy(*group, doc, arm).agg(F.max_by(outcome, seq).alias(outcome))
    return last.groupBy(*group, doc).agg(*[F.max(F.when(F.col(arm) == a, F.col(outcome))).alias(a) for a in arms])


def ab_report(tables: Tables, chains: DataFrame, group: list[str], doc: str, arm: str, outcome: str, seq: str, replicates: int = REPLICATES) -> DataFrame:
    """Per group: documents and means of both arms, chains without an outcome, and the paired test.
    Groups in which no chain has an outcome are left out."""
    wide = by_arm(chains, group, doc, arm, outcome, seq)
    means = wide.groupBy(*group).agg(F.count("control").alias("n_control"), F.count("treatment").alias("n_treatment"), F.round(F.avg("control"), 6).alias("mean_control"), F.round(F.avg("treatment"), 6).alias("mean_treatment"))
    missing = chains.groupBy(*group).agg(F.count_if(F.col(outcome).isNull()).alias("not_applicable"))
    test = permutation_test(tables, wide, group, "treatment", "control", replicates=replicates).select(*group, F.col("n").alias("n_pairs"), "difference", "p")
    return means.join(missing, group).join(test, group, "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0).cast("long")))


def macro_average(scores: DataFrame, groups: list[str], metrics: list[str]) -> DataFrame:
    """(group, metric, n, mean) of nullable metric columns; nulls are skipped, not counted as 0."""
    long = scores.unpivot(groups, metrics, "metric", "value")
    return long.groupBy(*groups, "metric").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def timing(rows: DataFrame, groups: list[str], seconds: str) -> DataFrame:
    """n, mean, median, least and most."""
    s = F.col(seconds)
    return rows.groupBy(*groups).agg(F.count(s).alias("n"), F.round(F.avg(s), 6).alias("mean"), F.round(F.median(s), 6).alias("median"), F.min(s).alias("least"), F.max(s).alias("most"))
