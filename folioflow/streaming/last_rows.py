"""An append log as a stream: the state is the last row of each key, whatever arrives late, out of order or twice.

A batch adds its own last rows as one folder under its number, and replaces what an interrupted attempt left there, so
a replayed batch changes nothing.  Rows are compared by their sequence and not by their arrival, so rows of any age
count; for that reason there is no watermark, which would drop them.  Every few batches the folders are merged to a
level, and readers take the newest level and the batches behind it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.profile import last_rows


class LastRows:
    """The state in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, seq: str, every: int = 20):
        self.spark, self.folder, self.schema, self.key, self.seq, self.every = spark, folder.rstrip("/"), schema, key, seq, every
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the finished folders of a kind."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        found = [s.getPath() for s in self._fs.listStatus(self._path(self.folder))]
        done = [p.getName() for p in found if p.getName().startswith(f"{kind}=") and self._fs.exists(self._path(p, "_SUCCESS"))]
        return sorted(int(n.removeprefix(f"{kind}=")) for n in done)

    def _read(self, upto: int | None = None) -> DataFrame:
        levels, batches = ([n for n in self._numbers(k) if upto is None or n <= upto] for k in ("level", "batch"))
        level = max(levels, default=-1)
        paths = [f"{self.folder}/level={level}"] * bool(levels) + [f"{self.folder}/batch={n}" for n in batches if n > level]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def add(self, rows: DataFrame, number: int) -> None:
        """The batch of that number: its last rows, and every so often a level of all up to it."""
        last_rows(rows, self.key, self.seq).select(*rows.columns).write.mode("overwrite").parquet(f"{self.folder}/batch={number}")
        if number % self.every == self.every - 1:
            last_rows(self._read(number), self.key, self.seq).select(*rows.columns).write.mode("overwrite").parquet(f"{self.folder}/level={number}")

    def rows(self) -> DataFrame:
        return last_rows(self._read(), self.key, self.seq)

    def follow(self, log: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
        """Takes in what is new in a folder of JSON lines, and ends."""
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", files_per_batch).json(log)
        kept = stream.where(F.col(self.key).isNotNull() & F.col(self.seq).isNotNull())
        return kept.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
