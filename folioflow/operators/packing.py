"""Chunks of about a target size from ordered elements, as a plan: running sums, a range lookup, pointer doubling.

The rule is greedy: pieces are added to a chunk in order, and the chunk ends with the first piece that brings it to the
target; elements longer than the target are cut into pieces first.  Where the next chunk ends depends on nothing but
where this one ended, so every running sum gets a pointer to the sum at which a chunk that begins behind it would end.
The chunks of a document are the sums on the path from 0, and the path is found by doubling: in round k the pointers
lead 2^k chunks on, and what is known to be on the path leads to as much again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import Tables, running_sum

#: targets that one range of sums spans: as many rows at most are sorted together
SPAN = 64


def next_ends(sums: DataFrame, target: int) -> DataFrame:
    """(g, s, t) of distinct running sums (g, s), 0 included: t is the least sum of the group that is s + target or more.

    Sums and what is asked for are laid on one line and read backwards.  The line is cut into ranges of SPAN targets;
    no piece is longer than a target, so what is not found in its own range is the first sum of the next one."""
    width = SPAN * target
    line = sums.select("g", F.col("s").alias("v"), F.col("s").alias("found"), F.lit(None).cast("long").alias("s"))
    asked = sums.select("g", (F.col("s") + target).alias("v"), F.lit(None).cast("long").alias("found"), "s")
    both = line.unionByName(asked).withColumn("r", F.floor(F.col("v") / width))
    # behind equal values the sums come after the questions, so that a question meets a sum of its own value
    ahead = Window.partitionBy("g", "r").orderBy("v", F.col("found").isNotNull()).rowsBetween(0, Window.unboundedFollowing)
    met = both.withColumn("t", F.first("found", ignorenulls=True).over(ahead)).where(F.col("s").isNotNull())
    first = sums.groupBy("g", (F.floor(F.col("s") / width) - 1).alias("r")).agg(F.min("s").alias("after"))
    return met.join(first, ["g", "r"], "left").select("g", "s", F.coalesce("t", "after").alias("t")).where(F.col("t").isNotNull())


def path(tables: Tables, pointers: DataFrame) -> DataFrame:
    """(g, s): all sums on the path from 0 over the pointers (g, s, t), without 0; log2 of the longest path in rounds."""
    pointers = tables.save(pointers, "pointers")
    on = tables.save(pointers.where(F.col("s") == 0).select("g", F.col("t").alias("s")), "path")
    # a pointer 2^k chunks long, from every sum on the path so far, reaches as many new ones; 0 is a sum on it too
    while not on.isEmpty():
        fresh = tables.save(on.join(pointers, ["g", "s"]).select("g", F.col("t").alias("s")), "fresh")
        if fresh.isEmpty():
            break
        further = pointers.select("g", "s", F.col("t").alias("m")).join(pointers.select("g", F.col("s").alias("m"), "t"), ["g", "m"]).select("g", "s", "t")
        longer, grown = tables.save(further, "pointers"), tables.save(on.unionByName(fresh), "path")
        tables.drop(on, fresh, pointers)
        on, pointers = grown, longer
    return on


def pack_chunks(tables: Tables, elements: DataFrame, group: str, order: str, text: str, target: int, joint: str = "\n") -> DataFrame:
    """(group, chunk, n_pieces, n_chars, text): chunks 0, 1, ... of every group, pieces joined by `joint`, which does
    not count.  Orders are whole numbers, unique within a group.  The last chunk may be short; an empty element is one
    empty piece, null elements are left out, and a group without elements has no chunk.

    No task holds a document: lengths are summed in blocks, and a chunk is the largest thing that comes together.
    Texts move twice, to meet the number of their first chunk and to be joined; all before works on lengths.
    """
    if target < 1:
        raise ValueError("a target has one character at least")
    known = elements.where(F.col(group).isNotNull() & F.col(text).isNotNull()).select(F.col(group).alias("g"), F.col(order).cast("long").alias("o"), F.col(text).alias("x"))
    sized = tables.save(running_sum(known.select("g", "o", F.length("x").cast("long").alias("n")), "g", "o", "n", "s"), "sized")
    # sums at the ends of all pieces: whole ones of the target's length, then what is left
    whole = F.floor(F.col("n") / target)
    at = F.when(whole > 0, F.transform(F.sequence(F.lit(1), F.greatest(whole, F.lit(1))), lambda k: F.col("s") - F.col("n") + k * target)).otherwise(F.array().cast("array<bigint>"))
    sums = sized.select("g", F.explode(F.concat(at, F.array("s", F.lit(0).cast("long")))).alias("s")).distinct()
    ends = path(tables, next_ends(sums, target))
    # a whole piece always ends a chunk, what is left of an element does if its sum is on the path, an empty piece never
    marked = sized.join(ends.withColumn("end", F.lit(1)), ["g", "s"], "left")
    last = F.when((F.col("n") % target > 0) & F.col("end").isNotNull(), 1).otherwise(0)
    counted = running_sum(marked.select("g", "o", (whole + last).alias("ends")), "g", "o", "ends", "upto").select("g", "o", (F.col("upto") - F.col("ends")).alias("first"))
    pieces = F.when(F.length("x") <= target, F.array("x")).otherwise(F.regexp_extract_all("x", F.lit(f"(?s).{{1,{target}}}"), F.lit(0)))
    cut = known.join(counted, ["g", "o"]).select("g", "o", "first", F.posexplode(pieces).alias("k", "piece"))
    # every whole piece ended a chunk, so the k-th piece is in the k-th chunk from the first one's
    held = F.array_sort(F.collect_list(F.struct("o", "k", "piece")))
    chunks = cut.groupBy("g", (F.col("first") + F.col("k")).cast("long").alias("chunk")).agg(F.count(F.lit(1)).alias("n_pieces"), F.sum(F.length("piece")).cast("long").alias("n_chars"), held.alias("held"))
    return chunks.select(F.col("g").alias(group), "chunk", "n_pieces", "n_chars", F.array_join("held.piece", joint).alias("text"))
