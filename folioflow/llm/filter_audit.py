"""Filter interaction audit: what each of five filters removes, in every order of applying them.

Every document gets a mask of the filters that it fails.  A table of 32 masks by 120 orders says at which step an order
meets the first of a mask's filters, so the audit of all orders is a lookup: tasks count their rows by part, mask and
label, look the masks up, and add the counts to part, order and step with np.bincount.  The tasks' partial arrays are
then summed.  Only masks and digests move; texts are read once.

Filters (a document fails if): A under 50 words; B 100 * distinct words < 65 * words; C 100 * capitals A-Z > 5 * code
points; D one of #$%&*| occurs; E the text equals that of a document with a smaller id, removed or not, told by SHA-256
of the whole text.  Words are runs of anything but ASCII blanks, case kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches, meet

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
#: FIRST[mask, order]: place in the order of the first filter that the mask fails; STEPS if it fails none
FIRST = np.array([[next((i for i, f in enumerate(o) if mask >> FILTERS.index(f) & 1), STEPS) for o in ORDERS] for mask in range(1 << STEPS)])
#: AT[order, step]: number of the filter
AT = np.array([[FILTERS.index(f) for f in o] for o in ORDERS])
#: limits of filters A, B and C (fixed values), and the signs of D
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
CAPITALS, SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: parts that a task holds before it hands on their arrays
MOST_PARTS = 10_000
_SUMS = ["removed", "good_lost", "toxic_lost", "fails", "unique_fails", "total"]


def own_failures(text: bytes, points: int) -> int:
    """Mask of the filters A to D that a text of so many code points fails."""
    words = text.split()  # bytes.split() knows the six ASCII blanks alone
    few = len(words) < LEAST_WORDS
    dull = 100 * len(set(words)) < LEAST_DISTINCT * len(words)
    loud = 100 * (len(text) - len(text.translate(None, CAPITALS))) > MOST_CAPITALS * points
    marked = len(text.translate(None, SIGNS)) < len(text)
    return few | dull << 1 | loud << 2 | marked << 3


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        points = pc.utf8_length(batch.column(2)).to_pylist()
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        masks = pa.array([own_failures(t, n) for t, n in zip(texts, points)], pa.int32())
        digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), masks, digests], names=["doc_id", "part", "own", "digest"])


def failures(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, part, mask) of every document."""
    arrow_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    plain = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    judged = scratch.save(plain.mapInArrow(_judge, f"doc_id {kind}, part string, own int, digest binary"), "judged")
    groups = judged.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    copied = scratch.save(groups.where(F.col("n") > 1).select("digest", "first"), "copied")
    found = meet(judged, copied, "digest", "doc_id", F.length("digest"), how="left")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return found.select("doc_id", "part", (F.col("own") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"))


def _added(counts: np.ndarray) -> list[np.ndarray]:
    """The sums of a part for each order and step, of its counts by mask and label (good, and 2 for toxic)."""
    cells = (np.arange(len(ORDERS)) * (STEPS + 1) + FIRST).ravel()
    size = len(ORDERS) * (STEPS + 1)
    by_label = [np.bincount(cells, np.repeat(c, len(ORDERS)), size).astype(np.int64).reshape(-1, STEPS + 1)[:, :STEPS] for c in counts.T]
    masks = counts.sum(axis=1)
    failing = np.array([masks[(np.arange(len(masks)) >> f & 1) == 1].sum() for f in range(STEPS)])
    only = masks[1 << np.arange(STEPS)]
    rows = [sum(by_label), by_label[1] + by_label[3], by_label[2] + by_label[3], failing[AT], only[AT], np.full(AT.shape, masks.sum())]
    return [r.ravel() for r in rows]


def _removals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def handed_on() -> Iterator[pa.RecordBatch]:
        for part, counts in held.items():
            n = AT.size
            orders, steps = np.divmod(np.arange(n), STEPS)
            columns = [pa.array([part] * n, pa.string()), pa.array(orders.astype(np.int32)), pa.array((steps + 1).astype(np.int32)), *map(pa.array, _added(counts))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "place", "step", *_SUMS])
        held.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        parts = batch.column(0).dictionary_encode()
        code, mask, label = (np.asarray(c) for c in (parts.indices, batch.column(1), batch.column(2)))
        seen = np.bincount((code * (1 << STEPS) + mask) * 4 + label, minlength=len(parts.dictionary) << STEPS << 2)
        for part, counts in zip(parts.dictionary.to_pylist(), seen.reshape(-1, 1 << STEPS, 4)):
            held[part] = held.get(part, 0) + counts
        if len(held) > MOST_PARTS:
            yield from handed_on()
    yield from handed_on()


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part (source; null is the empty string), order and step, zeros included: kept, removed,
    redundant, unique_fails, good_lost, toxic_lost and shapley, with the step's `filter`.

    `labels` has doc_id, quality and toxic; of several rows of an id any counts, null ids count for none.  A null text
    is empty: it fails A alone, and E if it is not the first empty one.  Rows of one id are no copies of each other and
    count each; a null id is smaller than none.  Long texts are judged whole.  Other columns are ignored, whatever
    their names.  An empty table has no parts and no rows.
    """
    scratch = Scratch(docs.sparkSession)
    good, toxic = (F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))) for c in ("quality", "toxic"))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg((good + 2 * toxic).alias("label"))
    rows = failures(docs, scratch).join(known, "doc_id", "left").select("part", "mask", F.coalesce("label", F.lit(0)).alias("label"))
    schema = "part string, place int, step int, " + ", ".join(f"{c} long" for c in _SUMS)
    sums = rows.mapInArrow(_removals, schema).groupBy("part", "place", "step").agg(*[F.sum(c).alias(c) for c in _SUMS])
    order = F.element_at(F.array(*map(F.lit, ORDERS)), F.col("place") + 1)
    named = sums.withColumn("filter_order", order).withColumn("filter", F.substring(order, F.col("step"), F.lit(1)))
    gone = F.sum("removed").over(Window.partitionBy("part", "filter_order").orderBy("step"))
    return named.select(
        "part",
        "filter_order",
        "step",
        "filter",
        (F.col("total") - gone).alias("kept"),
        "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails",
        "good_lost",
        "toxic_lost",
        F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )
