"""Quota samples, group-preserving splits, staged slices."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import Tables, places
from ..functions.text import shuffle_key

SPLITS = ("development", "validation", "primary_holdout")


def exclude_prior(candidates: DataFrame, *priors: DataFrame, key: str = "id") -> DataFrame:
    """Candidates that no earlier manifest holds."""
    seen = priors[0].select(key)
    for p in priors[1:]:
        seen = seen.unionByName(p.select(key))
    return candidates.join(seen.distinct(), key, "left_anti")


def quota_sample(items: DataFrame, stratum: Column, quotas: dict[str, int] | int, seed: str, key: str = "id") -> DataFrame:
    """Up to the quota of each stratum, in seeded order.  With a table of quotas other strata are left out; a single
    number holds for all, and null strata are `unknown`.

    Only candidates whose seeded order can matter are ranked: Spark's window-group limit keeps the best `quota` of
    each task before the shuffle, so a large stratum moves no more rows than its quota times the tasks.
    """
    named = items.withColumn("stratum", F.coalesce(stratum, F.lit("unknown")))
    if isinstance(quotas, dict):
        named = named.where(F.col("stratum").isin(list(quotas)))
        limit = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])[F.col("stratum")]
        most = max(quotas.values())
    else:
        limit, most = F.lit(quotas), quotas
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy(shuffle_key(F.lit(seed), F.col(key).cast("string")), key))
    return named.withColumn("rn", rank).where(F.col("rn") <= most).where(F.col("rn") <= limit)


def check_fractions(fractions: dict[str, float]) -> None:
    if not fractions or any(f < 0 for f in fractions.values()) or abs(sum(fractions.values()) - 1) > 1e-9:
        raise ValueError("fractions must be non-negative and sum to 1")


def turns(lacks: list[Fraction], size: int, count: int) -> list[tuple[int, list[int]]]:
    """Who gets `count` families of one size, each going to the split that lacks most, ties to the first: stretches
    (length, splits in turn), and `lacks` is lessened by what they got.

    The splits that lack most take turns until they lack as little as the next one, which then joins them: there are
    at most as many stretches as splits, whatever the count."""
    out: list[tuple[int, list[int]]] = []
    waiting = sorted(range(len(lacks)), key=lambda j: (-lacks[j], j))
    if not size:  # nothing changes what is lacking
        return [(count, waiting[:1])]
    active: list[int] = []
    while count:
        active.append(waiting.pop(0))
        order = sorted(active, key=lambda j: (-lacks[j], j))
        n = count
        if waiting:
            x, w = lacks[waiting[0]], waiting[0]
            # turns of j before w's first: as long as it lacks more, or as much and comes first
            before = {j: max(0, math.floor((lacks[j] - x) / size) + 1 if j < w else math.ceil((lacks[j] - x) / size)) for j in active}
            n = min(count, sum(before.values()))
        if n:
            out.append((n, order))
        for k, j in enumerate(order):
            lacks[j] -= size * len(range(k, n, len(order)))
        count -= n
    return out


def group_split(tables: Tables, families: DataFrame, fractions: dict[str, float], seed: str, family: str = "family", size: str = "size") -> DataFrame:
    """(family, size, split): whole families go, by falling size, to the split that lacks most; ties go by the order
    of the splits, families of one size in seeded order.

    Families of one size are dealt at once: the driver goes over the histogram of sizes (there are at most about
    sqrt(2 * items) different ones), and tells for each size in which turns its families fall to the splits.  Every
    family then finds its split by its place among those of its size, which comes from a range sort.
    """
    check_fractions(fractions)
    names = list(fractions)
    rows = families.select(F.col(family).cast("string").alias("family"), F.col(size).cast("long").alias("size"), shuffle_key(F.lit(seed), F.col(family)).alias("key"))
    counts = rows.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("size")).collect()
    total = sum(r["size"] * r["n"] for r in counts)
    lacks, dealt, start = [Fraction(total * fractions[n]) for n in names], [], 0
    for r in counts:
        for n, order in turns(lacks, r["size"], r["n"]):
            dealt.append((r["size"], start, start + n, [names[j] for j in order]))
            start += n
    stretches = rows.sparkSession.createDataFrame(dealt, "size long, begin long, end long, turns array<string>")
    placed = places(tables, rows, F.desc("size"), "key", "family")
    met = placed.join(stretches, "size").where((F.col("place") >= F.col("begin")) & (F.col("place") < F.col("end")))
    return met.select("family", "size", F.get("turns", F.pmod(F.col("place") - F.col("begin"), F.size("turns")).cast("int")).alias("split"))


def resolve_slices(slices: DataFrame, asked: str, order: list[str]) -> DataFrame:
    """Rows of one slice, or for `all` those of every slice in order, with the slice's rank; `slices` has a column slice."""
    if asked != "all" and asked not in order:
        raise ValueError(f"unknown slice {asked}")
    rank = F.array_position(F.array(*[F.lit(n) for n in order]), F.col("slice"))
    return slices.withColumn("slice_rank", rank.cast("long")).where((F.col("slice_rank") > 0) & F.lit(asked == "all") | (F.col("slice") == asked))


def first_checked(items: DataFrame, order: list[str], n: int) -> DataFrame:
    """All items; the first n in order are to be checked, all others are `not_run` and say why."""
    head = items.select(*order).orderBy(*order).limit(max(n, 0)).withColumn("_head", F.lit(True))
    joined = items.join(head, order, "left")
    run = F.coalesce("_head", F.lit(False))
    return joined.select(*items.columns, F.when(run, "run").otherwise("not_run").alias("status"), F.when(~run, "outside the sample").alias("reason"))


def split_fractions(assigned: DataFrame, fractions: dict[str, float]) -> DataFrame:
    """Requested and achieved share of each split that got a family."""
    want = F.create_map(*[F.lit(x) for kv in fractions.items() for x in kv])
    sums = assigned.groupBy("split").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("families"))
    total = F.sum("size").over(Window.partitionBy())
    return sums.select("split", "size", "families", want[F.col("split")].alias("requested"), F.round(F.col("size") / total, 6).alias("achieved"))


def staged_slices(items: DataFrame, key: str, seed: str, stages: dict[str, int]) -> DataFrame:
    """Consecutive slices of one seeded order over the items; what is beyond the last stage is `unused`.

    The order is total, but only its head is numbered: the limit runs as a distributed top-k.
    """
    order = shuffle_key(F.lit(seed), F.col(key).cast("string"))
    head = items.select(key, order.alias("order")).orderBy("order", key).limit(sum(stages.values()))
    rank = F.row_number().over(Window.orderBy("order", key))
    name, upto = F.lit(None).cast("string"), 0
    bounds = []
    for s, n in stages.items():
        upto += n
        bounds.append((upto, s))
    for b, s in reversed(bounds):
        name = F.when(F.col("position") <= b, F.lit(s)).otherwise(name)
    return head.withColumn("position", rank.cast("long")).select(key, "position", name.alias("stage"))


def fetch_summary(log: DataFrame, *keys: str) -> DataFrame:
    """Requested, fetched and failed records of a fetch log with a `status` column; a null status has failed."""
    ok = F.count_if(F.coalesce(F.col("status") == "ok", F.lit(False)))
    return log.groupBy(*keys).agg(F.count(F.lit(1)).alias("requested"), ok.alias("ok"), (F.count(F.lit(1)) - ok).alias("failed"))


def gaps(planned: DataFrame, present: DataFrame, key: str, fault: Column) -> DataFrame:
    """(split, key, reason, missing, planned): planned items that are not there, or have a `fault` (null: none), with
    the number of such items and of all planned ones of their split.  `planned` has key and split."""
    known = present.withColumn("_there", F.lit(True))
    reason = F.when(F.col("_there").isNull(), "no_document").otherwise(fault)
    lost = planned.join(known, key, "left").select("split", key, reason.alias("reason")).where(F.col("reason").isNotNull())
    totals = planned.groupBy("split").agg(F.count(F.lit(1)).alias("planned")).join(lost.groupBy("split").agg(F.count(F.lit(1)).alias("missing")), "split")
    return lost.join(totals, "split").select("split", key, "reason", "missing", "planned")
