"""Intermediate tables in the folder that a cluster's executors share, and running sums and places without one task."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share.  Only a local session, which is one process, may name none: it gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="folioflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


class Tables:
    """Written intermediate tables.  They cut lineage, survive the loss of executors, and go when dropped or at the
    latest when the driver's JVM ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_root(spark)}/folioflow-{uuid.uuid4().hex}"
        self.act(self.base, lambda fs, p: fs.deleteOnExit(p))

    def act(self, path: str, what) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        what(hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop)

    def folder(self, name: str) -> str:
        """A path of its own below the base, for writers that need a place rather than a table."""
        return f"{self.base}/{name}-{uuid.uuid4().hex[:8]}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.folder(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._written = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := getattr(t, "_written", None):
                self.act(path, lambda fs, p: fs.delete(p, True))


def beside(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """A join in which nulls meet nulls; the names come from the left."""
    other = right.withColumnsRenamed({c: f"_r_{c}" for c in names})
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in names], F.lit(True))
    return left.join(other, same, how).drop(*[f"_r_{c}" for c in names])


def running_sum(rows: DataFrame, group: str, order: str, value: str, name: str, block: int = 1 << 16) -> DataFrame:
    """`rows` with `name`, the sum of `value` up to and including each row of its group in a whole-numbered order.

    Blocks of `block` places are summed first, and a block begins where those before it end: no task sorts more than
    a block of rows, and one row a block is all that meets for a group of any length."""
    dealt = rows.withColumn("_block", F.floor(F.col(order) / block))
    sums = dealt.groupBy(group, "_block").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    begins = sums.select(group, "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.sum(value).over(Window.partitionBy(group, "_block").orderBy(order))
    return beside(dealt.withColumn(name, within), begins, [group, "_block"]).withColumn(name, F.col(name) + F.col("_before")).drop("_block", "_before")


def places(tables: Tables, rows: DataFrame, *order) -> DataFrame:
    """A written copy of `rows` with `place` 0, 1, ... in the order of all rows.

    A range sort deals rows to tasks; a row's place is that in its partition and the sizes of those before.  One number
    a partition comes to the driver."""
    at = F.monotonically_increasing_id()  # the partition's number above its 33 lower bits, the row's place in them
    found = tables.save(rows.orderBy(*order).withColumn("_at", at), "sorted")
    part = F.shiftright("_at", 33)
    before, starts = 0, []
    for number, n in sorted(found.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((number, before))
        before += n
    begins = rows.sparkSession.createDataFrame(starts, "_part long, _before long")
    met = found.withColumn("_part", part).join(F.broadcast(begins), "_part")
    return met.withColumn("place", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")
