"""Mixing sources to target weights by subset-sum budget fitting.

Every source has a target in words.  Whole rounds of the source come first; the rest of the target is a subset-sum
problem over document lengths: the documents are counted by exact length, and bounded-knapsack dynamic programming
finds how many to take of each length so that the sum is met exactly, or as nearly as lengths allow.  Then that many
documents of each length are selected by a seeded hash, which reruns repeat.

The table of reachable sums is a bitset, over lengths divided by their greatest common divisor.  So that it need not
span the whole budget, most of the budget is first dealt to the lengths in proportion and the table decides the rest.
If it reaches that exactly, no better fit exists.  If not, ever less is dealt beforehand, until the sum is exact or the
table decides the whole budget; so the fit is the nearest one for documents of any length.  The one bound is MOST_BITS
for the table, 1,073 million words times the divisor: budgets beyond it that have no exact sum in it get the nearest in it.

Targets come from a table of one row a source, which may be many: ranks by a range partition, caps by a threshold that
rises until no source is above.  Only sums reach the driver.  The histogram of one source's lengths goes to one planner
task.  Selection is a distributed rank: documents are counted by (source, length, hash slot), running sums over at most
`SLOTS` slots find the slot in which the quota ends, that slot is cut once more in the same way, and only the documents
of the last slot are ordered.  So a length that a third of all documents share is no burden.

Null text has size 0 and is never taken; null sources are one source, which comes last.  Documents that repeat an
id are separate documents; ties are broken by the text's hash, and identical rows are interchangeable.  An empty
table gives none.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

WEIGHTS = (5, 2, 1)
SLOTS = 256
#: parts of the documents of one source and length while they meet their plan
SALTS = 16
MOST_BITS = 1 << 30
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def _above(most: int, open_: int, left: int) -> Column:
    """Whether a source's share of `left` by weight is above `most` times its size, in products of up to 38 digits."""
    whole = lambda c: c.cast("decimal(19,0)")
    return whole(F.col("source_size")) * whole(F.lit(most * open_)) < whole(F.col("weight")) * whole(F.lit(left))


def targets(spread: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """`spread` (source, source_size; one row a source) with its target: its weight's share of all sizes, no more than
    `most` times its own size, the excess reshared by weight among the others until none is above."""
    place = spread.select("source", "source_size").repartitionByRange(F.col("source").isNull(), "source").sortWithinPartitions(F.col("source").isNull(), "source")
    place = scratch.save(place.withColumn("at", F.monotonically_increasing_id()), "ranked")
    part, start = F.shiftright("at", 33), {}
    for r in place.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # a row for each partition
        start[r["part"]] = sum(r_n for _, r_n in start.values()), r["n"]
    offset = F.lit(0).cast("long")
    if start:
        offset = F.element_at(F.create_map(*[F.lit(x) for p, (before, _) in start.items() for x in (p, before)]), part)
    rank = offset + F.col("at").bitwiseAND((1 << 33) - 1)
    weighted = place.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")))
    weighted = scratch.save(weighted.select("source", "source_size", "weight"), "weighted")
    whole, weight = (x or 0 for x in weighted.agg(F.sum("source_size"), F.sum("weight")).first())
    left, open_, capped = whole, weight, 0
    while open_:  # the share of a unit of weight only grows, and so do those above their cap
        over = _above(most, open_, left)
        n, size, w = weighted.where(over).agg(F.count(F.lit(1)), F.sum("source_size"), F.sum("weight")).first()
        if n == capped:
            break
        left, open_, capped = whole - most * size, weight - w, n
    over = _above(most, open_, left)
    share = F.lit(float(left)) * F.col("weight") / F.lit(float(open_ or 1))
    return weighted.select("source", "source_size", F.when(over | F.lit(not open_), (most * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def _reach(items: list[tuple[int, int]], size: int, stop: int | None = None) -> tuple[int, int]:
    """Bitset of the sums below `size` that so many of each length reach, and how many items it took to reach `stop`."""
    bits, mask = 1, (1 << size) - 1
    for used, (length, count) in enumerate(items):
        count, step = min(count, (size - 1) // length), 1
        while count > 0:
            step = min(step, count)
            bits |= (bits << (step * length)) & mask
            count, step = count - step, 2 * step
        if stop is not None and (bits >> stop) & 1:
            return bits, used + 1
    return bits, len(items)


def _choose(items: list[tuple[int, int]], target: int, take: list[int], at: int = 0) -> None:
    """Adds to `take` how many of each item make up a sum that they reach: halves agree on where to split it."""
    if not target:
        return
    if len(items) == 1:
        take[at] += target // items[0][0]
        return
    half, size = len(items) // 2, target + 1
    first, second = _reach(items[:half], size)[0], _reach(items[half:], size)[0]
    n = -(-size // 8)
    turned = int.from_bytes(second.to_bytes(n, "little").translate(_REVERSED)[::-1], "little") >> (8 * n - size)
    both = first & turned
    split = (both & -both).bit_length() - 1
    _choose(items[:half], split, take, at)
    _choose(items[half:], target - split, take, at + half)


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their sizes sum to the budget, or come nearest; of two
    sums as near the smaller.

    `lengths` ascending and positive, 0 <= budget <= lengths @ counts.
    """
    total = int(lengths @ counts)
    if not len(lengths) or budget <= 0 or budget >= total:
        return counts.copy() if len(lengths) and budget >= total else np.zeros_like(counts)
    unit = int(np.gcd.reduce(lengths))
    lengths, total = lengths // unit, total // unit
    want = (2 * budget + unit - 1) // (2 * unit)  # the nearest multiple
    longest = int(lengths[-1])
    spread = max(4 * longest, 1 << 14)
    while True:
        take = np.zeros_like(counts)
        if want > spread:
            take = np.minimum(np.floor(counts * ((want - spread) / total)).astype(np.int64), counts)
            rest = want - int(lengths @ take)
            for i in range(len(lengths) - 1, -1, -1):
                more = max(0, min(int(counts[i] - take[i]), (rest - spread) // int(lengths[i])))
                take[i] += more
                rest -= more * int(lengths[i])
        rest = want - int(lengths @ take)
        order = np.flatnonzero(counts > take)[::-1]
        items = [(int(lengths[i]), int(counts[i] - take[i])) for i in order]
        bits, used = _reach(items, rest + longest + 1, rest)
        if (bits >> rest) & 1 or not take.any() or spread >= MOST_BITS:
            break
        spread = min(8 * spread, MOST_BITS)
    low, high = (bits & ((1 << (rest + 1)) - 1)).bit_length() - 1, bits >> (rest + 1)
    sums = [low] + ([(high & -high).bit_length() + rest] if high else [])
    over = lambda s: (want - rest + s) * unit - budget
    best = min(sums, key=lambda s: (abs(over(s)), over(s) > 0))
    more = [0] * used
    _choose(items[:used], best, more)
    take[order[:used]] += np.array(more, dtype=np.int64)
    return take


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """For one source (source, source_size, target, size, n): whole rounds, and how many of each size come once more."""
    pdf = pdf.sort_values("size").reset_index(drop=True)
    lengths, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    total, some = int(lengths @ counts), lengths > 0
    want = int(round(pdf["target"].iloc[0]))
    rounds = want // total if total else 0
    quota = np.zeros(len(pdf), np.int64)
    if total:
        quota[some] = fit(lengths[some], counts[some], want - rounds * total)
    return pdf.assign(rounds=rounds, quota=quota)[["source", "size", "source_size", "target", "rounds", "quota"]]


def _cut(dealt: DataFrame, slot: Column) -> tuple[DataFrame, DataFrame]:
    """Documents that a running count over the slots settles (`more` says whether they are taken), and those of
    the slots in which a quota ends, with what is left of it."""
    dealt = dealt.withColumn("slot", slot)
    group = ["source", "size", "slot"]
    counts = dealt.where(F.col("quota") > 0).groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.first("quota").alias("quota"))
    upto = F.sum("n").over(Window.partitionBy("source", "size").orderBy("slot"))
    states = counts.withColumn("upto", upto).select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("slot").alias("t"), "upto", (F.col("quota") - F.col("upto") + F.col("n")).alias("left"))
    met = dealt.join(states.hint("merge"), dealt["source"].eqNullSafe(states["s"]) & (dealt["size"] == states["z"]) & (dealt["slot"] == states["t"]), "left")
    # left: what the slots before leave of the quota
    ends = (F.col("left") > 0) & (F.col("upto") > F.col("quota"))
    sure = met.where(~F.coalesce(ends, F.lit(False))).withColumn("more", F.coalesce((F.col("left") > 0).cast("long"), F.lit(0)))
    edge = met.where(ends).withColumn("quota", F.col("left"))
    extra = ["s", "z", "t", "upto", "left", "slot"]
    return sure.drop(*extra), edge.drop(*extra)


def mix(docs: DataFrame, seed: int = 9, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of `docs` (doc_id, text, source)."""
    scratch = Scratch(docs.sparkSession)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    draw = F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text"))
    own = scratch.save(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), draw.alias("draw")), "sizes")
    histogram = scratch.save(own.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    target = targets(histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), scratch, weights, most)
    spread = histogram.join(target.withColumnRenamed("source", "s").hint("merge"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = spread.groupBy("source").applyInPandas(_plan, "source string, size long, source_size long, target double, rounds long, quota long")
    plan = scratch.save(plan, "plan").withColumnRenamed("source", "s").withColumnRenamed("size", "z").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.pmod("draw", F.lit(SALTS)) == F.col("_salt"))
    dealt = own.join(plan.hint("merge"), same).drop("s", "z", "_salt")
    settled = []
    for level in range(2):
        sure, dealt = _cut(dealt, F.pmod(F.shiftright("draw", 8 * level + 4), F.lit(SLOTS)).cast("int"))
        settled.append(sure)
        dealt = scratch.save(dealt, "edge")
    rank = F.row_number().over(Window.partitionBy("source", "size").orderBy("draw", "doc_id"))
    chosen = dealt.withColumn("more", (rank <= F.col("quota")).cast("long"))
    for sure in settled:
        chosen = chosen.unionByName(sure)
    return chosen.select("doc_id", "source", "size", "source_size", "target", ((F.col("rounds") + F.col("more")) * F.col("size")).alias("taken"))
