"""Importance resampling towards a target: documents whose hashed features look like the target's are drawn.

Features are runs of words, hashed to buckets.  The gain of a bucket is the log ratio of its smoothed share in the
target and in the corpus, and a document's weight the sum of gains over its features.  Identical texts are collapsed
first, by grouping on the full text: features are found and weights computed once a distinct text, and counts are
multiplied by how often it occurs.  Weights go back to the documents before noise that depends on the document is
added (Gumbel, from a hash of the id), so copies are drawn apart.  The highest scores are the draw.

Texts move through one shuffle.  Behind it a text is a row of bucket numbers; the counts by bucket are the only thing
that comes to the driver, and their number is a parameter.  Places in the draw come from a range sort and the counts
of its partitions, not from one task.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches, meet

#: bytes to word characters in lower case, all others to blanks: words are runs of digits, letters and non-ASCII
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: features and bytes that a worker remembers the buckets of
KEPT, KEPT_BYTES = 400_000, 32 << 20
#: parts of the counts by bucket that are summed apart
SLICES = 16


class _Buckets(dict):
    def __init__(self, buckets: int):
        self.buckets, self.size = buckets, 0

    def __missing__(self, feature: bytes) -> int:
        if len(self) > KEPT or self.size > KEPT_BYTES:
            self.clear()
            self.size = 0
        self[feature] = b = zlib.crc32(feature) % self.buckets
        self.size += len(feature)
        return b


def features(text: bytes, longest: int) -> tuple[int, list[bytes]]:
    """Number of words, and all runs of 1 to `longest` of them."""
    words = text.translate(_FOLD).split(b" ")
    words = [w for w in words if w]
    runs = list(words)
    for k in range(2, longest + 1):
        runs += [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    return len(words), runs


def bucketed(texts: DataFrame, buckets: int, longest: int) -> DataFrame:
    """(key, n, first, n_words, n_features, buckets) of distinct texts (text, n, first): the key is their SHA-256, and
    `buckets` packs a number of 32 bits for each feature."""
    arrow_batches(texts.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(buckets)
        for batch in batches:
            found = batch.column(0).cast(pa.binary()).to_pylist()
            words, counts, packed = [], [], []
            for text in found:
                n, runs = features(text, longest)
                words.append(n)
                counts.append(len(runs))
                packed.append(np.fromiter(map(known.__getitem__, runs), np.uint32, len(runs)).tobytes())
            keys = pa.array([hashlib.sha256(t).digest() for t in found], pa.binary())
            columns = [keys, batch.column(1), batch.column(2), pa.array(words, pa.int64()), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "first", "n_words", "n_features", "buckets"])

    kind = texts.schema["first"].dataType.simpleString()
    return texts.select("text", "n", "first").mapInArrow(find, f"key binary, n long, first {kind}, n_words long, n_features long, buckets binary")


def collapsed(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(text, n, first): distinct texts with their number of documents and smallest id; a null text is empty."""
    return docs.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.count(F.lit(1)).alias("n"), F.min(doc_id).alias("first"))


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """Features by bucket, copies counted.  Tasks hand on one packed array, cut into slices that are summed apart; one
    row a slice comes to the driver, `buckets` numbers in all."""
    width = -(-buckets // SLICES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * SLICES, np.int64)
        for batch in batches:
            for times, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                np.add.at(total, np.frombuffer(packed, np.uint32), times)
        if total.any():
            parts = total.reshape(SLICES, width)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[part] = sums.get(part, 0) + np.frombuffer(packed, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["part", "counts"])

    schema = "part int, counts binary"
    summed = found.select("n", "buckets").mapInArrow(count, schema).repartition(SLICES, "part").mapInArrow(add, schema)
    counts = np.zeros((SLICES, width), np.int64)
    for r in summed.collect():
        counts[r["part"]] += np.frombuffer(r["counts"], np.int64)
    return counts.ravel()[:buckets]


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the ratio of smoothed shares, by bucket."""
    size = len(corpus)
    of_corpus, of_target = float(corpus.sum() + size), float(target.sum() + size)
    return np.array([math.floor(1000 * math.log((t + 1.0) * of_corpus / ((s + 1.0) * of_target))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weighted(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """(key, n, first, n_words, n_features, weight)."""
    shared = found.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [int(shared.value[np.frombuffer(b, np.uint32)].sum()) for b in batch.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(weights, pa.int64())], names=["key", "n", "first", "n_words", "n_features", "weight"])

    kind = found.schema["first"].dataType.simpleString()
    return found.select("key", "n", "first", "n_words", "n_features", "buckets").mapInArrow(weigh, f"key binary, n long, first {kind}, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """`rows` with `rank` 1, 2, ... in the order of falling score, then id; null beyond `most`.

    A range sort deals rows to tasks; a row's rank is its place in its partition and the sizes of those before."""
    place = F.monotonically_increasing_id()  # the partition's number above its 33 lower bits, the row's place in them
    sorted_rows = scratch.save(rows.orderBy(F.desc("score"), "doc_id").withColumn("_at", place), "sorted")
    part = F.shiftright("_at", 33)
    sizes = sorted(sorted_rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row a partition
    before, starts = 0, []
    for number, n in sizes:
        starts.append((number, before))
        before += n
    begins = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part long, _before long"))
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return sorted_rows.withColumn("_part", part).join(begins, "_part").withColumn("rank", F.when(rank <= most, rank)).drop("_at", "_part", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, buckets: int = 10_000, longest: int = 1, least_words: int = 20, seed: str = "2024") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document: the rank is null for those not drawn.

    Of the N documents with `least_words` words or more, floor(N * percent / 100) with the highest scores are drawn,
    ties to the smaller id.  Null and empty texts have no features, weight 0 and no place in the draw.  A null id has
    no noise: its score is null and it does not count in N.  Rows that repeat an id share their noise and are ranked
    each.  Long texts are read whole.  Empty tables: no documents give no rows, an empty target gives T = 0.  Other
    columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.save(bucketed(collapsed(docs), buckets, longest), "features", free=True)
    aims = bucketed(target.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.count(F.lit(1)).alias("n")).withColumn("first", F.lit(0)), buckets, longest)
    texts = scratch.save(weighted(found, gains(bucket_counts(found, buckets), bucket_counts(aims, buckets))), "weights")
    scratch.drop(found)
    facts = ["n_words", "n_features", "weight"]
    single = texts.where(F.col("n") == 1).select(F.col("first").alias("doc_id"), *facts)
    several = scratch.save(texts.where(F.col("n") > 1).select("key", *facts), "several")
    keyed = docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("key"))
    whole = single.unionByName(meet(keyed, several, "key", "doc_id", F.lit(56)).select("doc_id", *facts))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    scored = scratch.save(whole.withColumn("score", score), "scored")
    open_ = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    drawn = ranked(scored.where(open_), scratch, scored.where(open_).count() * percent // 100)
    rest = scored.where(~open_).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
