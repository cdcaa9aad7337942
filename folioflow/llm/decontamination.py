"""Benchmark decontamination: size-partitioned MinHash containment search.  DataFrame functions only.

A document is contaminated by an item when it holds at least `percent` per cent of the item's distinct 5-word
shingles (A-Z lower-cased).

Items are partitioned by the size of their shingle set, in powers of two.  An item's sketch is its bottom-k
MinHash sample, k = n - ceil(percent * n / 100) + 1: of any k of its shingles a contaminated document holds one
at least, so a hit on the sketch misses nothing however long the document is, unlike a resemblance of the two
whole sets.  Each partition has a threshold, its largest sketch value; a document's sketch for a partition is
all of its shingle hashes up to that.  Documents too small for an item's size are passed over.  Candidates are
then verified by counting the item's own shingles, as strings, in the document.

Items with fewer than five words have one shingle, their whole sequence, and so do such documents.  Items or
documents without words or text contaminate and match nothing.  Repeated ids are judged together, as one set.
Texts of any length are searched whole.  Where either table is empty nothing is found.  Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch

#: items whose shingles are broadcast; larger benchmarks are joined by shuffles
BROADCAST_SHINGLES = 200_000


def words(text: str = "text") -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_extract_all(F.translate(F.col(text), upper, upper.lower()), F.lit(WORD), F.lit(0))


def _starts(w: Column) -> Column:
    return F.when(F.size(w) > 0, F.sequence(F.lit(0), F.greatest(F.size(w) - 5, F.lit(0))))


def shingle_hashes(w: Column) -> Column:
    """Hash of each 5-word run; get() gives null beyond the end, so shorter sequences hash as a whole."""
    return F.transform(_starts(w), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2), F.get(w, i + 3), F.get(w, i + 4)))


def shingles(w: Column) -> Column:
    return F.array_distinct(F.transform(_starts(w), lambda i: F.array_join(F.slice(w, i + 1, 5), " ")))


def _each(df: DataFrame, key: str, array: Column, name: str) -> DataFrame:
    """A row for each element.  Outer, as for the inner form the optimizer pushes a copy of the array's whole
    computation into a filter below."""
    return df.select(key, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) for each document that holds enough of an item.

    `docs` has doc_id and text, `benchmark` item_id and text.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    own = benchmark.where(F.col("item_id").isNotNull()).select("item_id", words().alias("w"))
    grams = _each(own, "item_id", shingles(F.col("w")), "shingle").distinct()
    hashed = _each(own, "item_id", shingle_hashes(F.col("w")), "h").distinct()
    size = grams.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item"))
    need = lambda n: F.ceil(F.col(n) * percent / 100.0 - 1e-9).cast("long")
    size = size.withColumn("need", F.greatest(need("n_item"), F.lit(1))).withColumn("part", F.floor(F.log2("n_item")).cast("int"))
    k = (F.col("n_item") - F.col("need") + 1).cast("int")
    sketch = hashed.groupBy("item_id").agg(F.sort_array(F.collect_list("h")).alias("hs")).join(size, "item_id")
    sketch = scratch.save(sketch.select("item_id", "part", "n_item", "need", F.explode(F.slice("hs", F.lit(1), F.least(k, F.size("hs")))).alias("h")), "sketch")
    grams = scratch.save(grams.join(size.select("item_id", "n_item", "need"), "item_id"), "grams")
    limits = sketch.groupBy("part").agg(F.max("h").alias("top"), F.min("need").alias("least")).collect()  # one row for each power of two
    if not limits:
        return docs.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("n_item"), F.lit(0).cast("long").alias("n_shared"), F.lit(0.0).alias("containment")).where(F.lit(False))
    small = grams.count() <= BROADCAST_SHINGLES
    near = F.broadcast if small else (lambda df: df)

    def within(h: Column, n: Column) -> Column:
        test = F.lit(False)
        for r in limits:
            test = test | ((h <= F.lit(r["top"])) & (n >= F.lit(r["least"])))
        return test

    # the set's size travels inside the exploded rows, so that no filter on it is pushed below the explode
    sized = lambda w: F.transform(shingle_hashes(w), lambda h: F.struct(h.alias("h"), F.greatest(F.size(w) - 4, F.lit(1)).alias("n")))
    probes = docs.select("doc_id", words().alias("w")).select("doc_id", F.inline_outer(sized(F.col("w")))).where(within(F.col("h"), F.col("n")))
    candidates = scratch.save(probes.join(near(sketch), "h").where(F.col("n") >= F.col("need")).select("doc_id", "item_id").distinct(), "candidates")
    texts = docs.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    held = _each(texts.select("doc_id", words().alias("w")), "doc_id", shingles(F.col("w")), "shingle").join(near(grams), "shingle")
    counted = held.groupBy("doc_id", "item_id").agg(F.count_distinct("shingle").alias("n_shared"), F.first("n_item").alias("n_item"), F.first("need").alias("need"))
    return (
        counted.where(F.col("n_shared") >= F.col("need"))
        .join(candidates, ["doc_id", "item_id"], "left_semi")
        .select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))
    )
