"""Chat formatting with cumulative-snapshot collapse.  DataFrame functions only.

Logs often hold every state of a growing conversation.  A rolling hash runs over the turns of each conversation, so
that its n-th value stands for the first n turns; conversations whose last value is an inner value of a longer one are
snapshots, and an anti-join drops them.  Equal conversations collapse to the one with the smallest id.  What stays is
rendered as one text.

The hashes come from a running window over the sorted turns, two 60-bit halves of MD5 sums of (place, role, text)
folded by XOR, so that a conversation's length costs in proportion.  Only ids and hashes take part in the collapse;
turns are gathered again for those that stay.

Turns are ordered by (turn, role, text), null turns first.  A null role is written as `unknown`, a null text as empty.
Turns with a null conv_id belong to no conversation and are left out.  A rendered conversation is one row, however
long.  Columns of `turns` other than these four are ignored, whatever their names.  An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


def escaped(text: Column) -> Column:
    r"""Text in which no role marker can be read: `<|` gets a backslash, `<\|` one more, so that it can be undone."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def render(turns: Column) -> Column:
    """`<|role|>` and the text of each turn on lines of their own."""
    return F.array_join(F.transform(turns, lambda x: F.concat(F.lit("<|"), escaped(x["role"]), F.lit("|>\n"), escaped(x["text"]))), "\n")


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) of the conversations that are no prefix of a longer one."""
    scratch = Scratch(turns.sparkSession)
    turns = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = turns.withColumn("n", F.row_number().over(order)).withColumn("last", F.lead(F.lit(1)).over(order).isNull())
    placed = placed.withColumn("md5", F.md5(F.concat_ws(",", "n", F.md5("role"), F.md5("text"))))
    half = lambda a: F.bit_xor(F.conv(F.substring("md5", a, 15), 16, 10).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    prefixes = scratch.save(placed.select("conv_id", "n", "last", half(1).alias("h1"), half(16).alias("h2")), "prefixes")
    key = ["n", "h1", "h2"]
    whole = prefixes.where("last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    kept = whole.join(prefixes.where("not last").select(*key).distinct(), key, "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"), "n_copies")
    told = turns.join(kept, "conv_id").groupBy("conv_id", "n_turns", "n_copies").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return told.select("conv_id", "n_turns", "n_copies", render(F.col("turns")).alias("rendered"))
