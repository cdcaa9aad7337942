"""Shared plumbing: scratch tables in the cluster's shared folder, Arrow batching, connected components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: words of the contracts: runs of anything but blank, tab, line feed, vertical tab, form feed, carriage return
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share.  Only a local session, which is one process, may name none: it gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="folioflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Written intermediate tables.  They cut lineage, survive the loss of executors, and go when dropped
    or at the latest when the driver's JVM ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_root(spark)}/folioflow-{uuid.uuid4().hex}"
        self._path(self.base, lambda fs, p: fs.deleteOnExit(p))

    def _path(self, path: str, act) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        act(hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop)

    def save(self, df: DataFrame, name: str, free: bool = False) -> DataFrame:
        """Writes a table and reads it again; `free` also lets go of the shuffle files behind it, for large ones."""
        path = f"{self.base}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        if free:
            self.collect_garbage()
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := getattr(t, "_scratch", None):
                self._path(path, lambda fs, p: fs.delete(p, True))

    def collect_garbage(self) -> None:
        """Lets Spark's cleaner delete the shuffle files of jobs whose results are written."""
        for _ in range(2):  # the cleaner acts on what the first pass has found unreachable
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.2)


def arrow_batches(spark: SparkSession, rows: int = 2000, size: str = "8m") -> None:
    """Bounds the memory of a Python worker whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch | None]:
    """Batches of rows sorted by `keys`, cut so that none goes over a change of group; None stands after each group.

    For mapInArrow behind a repartition and sort: groups need not fit into memory, and small ones cost no call each.
    """
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            now = tuple(c[a] for c in columns)
            if last is not None and now != last:
                yield None
            last = now
            yield batch.slice(a, b - a)
    if last is not None:
        yield None


#: rows of a table that is broadcast, and their characters or bytes; a larger one is joined by a shuffle
BROADCAST_ROWS, BROADCAST_CHARS = 200_000, 16 << 20
#: parts of a frequent value in such a shuffle
MEET_SALTS = 32


def meet(rows: DataFrame, table: DataFrame, on: str | list[str], by: str, chars: Column | None = None, how: str = "inner") -> DataFrame:
    """Joins many rows, of which a third may share one value of `on`, with a written table of distinct values, whose
    size is counted first: `chars` are the characters of a row of it.  `by` deals rows of one value to salts."""
    size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.lit(8) if chars is None else chars), F.lit(0))).first()
    if size[0] <= BROADCAST_ROWS and size[1] <= BROADCAST_CHARS:
        return rows.join(F.broadcast(table), on, how)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(MEET_SALTS - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(MEET_SALTS)).cast("int"))
    return dealt.join(salted.hint("merge"), [*([on] if isinstance(on, str) else on), "_salt"], how).drop("_salt")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(scratch: Scratch, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, comp): comp is the smallest vertex that v reaches over the edges; isolated vertices have no row.

    Alternating large-star and small-star steps, one written table a round, until every edge leads from a vertex to
    the smallest of its component: about log(n) rounds on a path of n vertices in any order.  No step adds edges.
    Hubs cost no more than their edges: minima are combined map-side and the joins are plain sort-merge joins that
    AQE may split.
    """
    # every edge leads from its larger vertex s to its smaller one d
    edges = scratch.save(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("s"), F.least(a, b).alias("d")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("d").alias("s"), F.col("s").alias("d")))
        least = both.groupBy("s").agg(F.min("d").alias("m")).select("s", F.least("s", "m").alias("m"))
        # large star: the larger neighbours of a vertex move to its smallest one
        large = edges.select(F.col("d").alias("s"), F.col("s").alias("v")).join(least, "s").select(F.col("v").alias("s"), F.col("m").alias("d")).distinct()
        large = scratch.save(large, "large")
        # small star: a vertex and its smaller neighbours move to the smallest of them
        lower = large.groupBy("s").agg(F.min("d").alias("m"))
        moved = large.join(lower, "s").where(F.col("d") != F.col("m")).select(F.col("d").alias("s"), F.col("m").alias("d"))
        new = scratch.save(moved.unionByName(lower.select("s", F.col("m").alias("d"))).distinct(), "edges")
        scratch.drop(edges, large)
        edges = new
        ends = edges.select("s", F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col("d").alias("s"), F.lit(0).alias("out"), F.lit(1).alias("in")))
        if ends.groupBy("s").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("in") > 0))).isEmpty():
            return edges.toDF("v", "comp").unionByName(edges.select(F.col("d").alias("v"), F.col("d").alias("comp")).distinct())
