"""Token counts as delta-maintained rollups.

A batch of signed changes, (source, lang, tokenizer, sign, tokens, chars), is summed by key and written as one delta
under the batch's own name; the totals are the sums over all committed deltas.  Inserts count +1, deletes -1, and a
revised count is a delete of the old and an insert of the new.  Sums of signed changes are independent of order and
grouping, so totals never need the documents again.

A commit is idempotent: a delta is written to a hidden name of its own and renamed, and a batch whose name exists is
not written again.  A failed or repeated attempt therefore changes nothing, and of concurrent ones the first counts.
`compact` adds up what is committed, so that totals read one level and the deltas after it, not all there ever were.

Counting is partial on the mappers, so a source that holds a third of all documents sends one row a task.
Null texts have 0 tokens; null source or lang is a key of its own.  Rows that repeat an id count each.  An empty batch
is committed like others and adds nothing.  Texts of any length are counted whole.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, arrow_batches

KEY = ["source", "lang", "tokenizer"]
SUMS = ["docs", "tokens", "chars"]
DELTA = T.StructType([*(T.StructField(k, T.StringType()) for k in KEY), *(T.StructField(s, T.LongType()) for s in SUMS)])


def count_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def bpe_counter(spark: SparkSession, vocabulary: str, pattern: str):
    """A column function that counts byte-BPE tokens.  `vocabulary` is a file of ranks ("base64 rank" lines) that
    the driver reads; its bytes, about 1 MB whatever the corpus, are broadcast to the executors."""
    with open(vocabulary, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())
    coders: dict[str, object] = {}

    def coder():
        if "it" not in coders:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.value.splitlines())}
            coders["it"] = tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return coders["it"]

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = coder().encode_ordinary
        for batch in texts:
            yield pd.Series([len(encode(t)) if t else 0 for t in batch], dtype="int64")

    return count


class Rollup:
    """Totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        arrow_batches(spark)

    def _put(self, write, name: str) -> bool:
        """Writes below a name of its own and renames; False if `name` was there first, an error if neither holds."""
        final, pending = self._at(f"{self.folder}/{name}"), self._at(f"{self.folder}/_pending-{uuid.uuid4().hex}")
        write(pending.toString())
        done = not self._fs.exists(final) and self._fs.rename(pending, final)
        inside = self._at(final, pending.getName())  # where a rename ends up if another was faster
        if done and not self._fs.exists(inside):
            return True
        for left in (inside, pending):
            self._fs.delete(left, True)
        if not self._fs.exists(final):
            raise OSError(f"could not commit {final.toString()}")
        return False

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch once: True if this call added it, False if it was there.  Raises if it could not be added."""
        if self._fs.exists(self._at(f"{self.folder}/batch={batch}")):
            return False
        summed = changes.groupBy(*KEY).agg(F.sum("sign").cast("long").alias("docs"), *[F.sum(F.col("sign") * F.col(s)).cast("long").alias(s) for s in SUMS[1:]])
        return self._put(lambda path: summed.write.parquet(path), f"batch={batch}")

    def compact(self) -> None:
        """Writes the sums of all batches committed so far, with their names, as a new level."""
        names = self.batches()
        if not names:
            return
        summed, named = self._sums(names), self.spark.createDataFrame([(n,) for n in names], "name string")

        def write(path: str) -> None:
            summed.write.parquet(f"{path}/sums")
            named.coalesce(1).write.parquet(f"{path}/names")

        self._put(write, f"level={uuid.uuid4().hex}")

    def _names(self, kind: str) -> list[str]:
        if not self._fs.exists(self._at(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.folder))]
        return sorted(n.removeprefix(f"{kind}=") for n in names if n.startswith(f"{kind}="))

    def batches(self) -> list[str]:
        return self._names("batch")

    def _sums(self, batches: list[str]) -> DataFrame:
        """Sums of exactly the batches named, whatever is committed meanwhile.  A level that
        holds others is not read."""
        covered, level = set(), None
        for name in self._names("level"):  # the level of most batches; names of batches, not rows of data
            held = {r["name"] for r in self.spark.read.parquet(f"{self.folder}/level={name}/names").collect()}
            if len(held) > len(covered) and held <= set(batches):
                covered, level = held, name
        read = self.spark.read.schema(DELTA).parquet
        deltas = read(f"{self.folder}/level={level}/sums") if level else self.spark.createDataFrame([], DELTA)
        if paths := [f"{self.folder}/batch={b}" for b in batches if b not in covered]:
            deltas = deltas.unionByName(read(*paths))
        return deltas.groupBy(*KEY).agg(*[F.sum(s).alias(s) for s in SUMS])

    def totals(self) -> DataFrame:
        """Per key docs, tokens and chars over all committed batches; keys of which nothing is left are left out."""
        return self._sums(self.batches()).where((F.col("docs") != 0) | (F.col("tokens") != 0) | (F.col("chars") != 0))


def changes(counted: DataFrame, tokenizer: str, sign: int = 1) -> DataFrame:
    """Signed changes of documents with a `tokens` column; columns named chars or sign are not read."""
    chars = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return counted.select(F.col("source").cast("string"), F.col("lang").cast("string"), F.lit(tokenizer).alias("tokenizer"), F.lit(sign).alias("sign"), "tokens", chars.alias("chars"))
