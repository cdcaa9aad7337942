"""JSON manifests and logs, newest reports, BibTeX keys; versioned and partial outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tables import Tables


def manifests(spark: SparkSession, paths: list[str], schema: T.StructType, items: str) -> DataFrame:
    """Rows of a nested array over several manifests, in one scan with a declared schema."""
    return spark.read.schema(schema).json(paths, multiLine=True).select(F.inline(items))


def checkpoint_log(spark: SparkSession, path: str, schema: str | T.StructType, key: str, seq: str) -> DataFrame:
    """An append log in which the last row of a key counts."""
    log = spark.read.schema(schema).json(path)
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_last")).select(key, "_last.*")


def newest(reports: DataFrame, accepted: Column | None = None, path: str = "path") -> DataFrame:
    """The report whose name sorts last, of those that are accepted."""
    return (reports if accepted is None else reports.where(accepted)).orderBy(F.desc(path)).limit(1)


def citation_keys(texts: DataFrame, text: str = "text", command: str = r"\\cite[a-z]*\{([^}]*)\}") -> DataFrame:
    """Keys cited in LaTeX source."""
    found = texts.select(F.explode_outer(F.regexp_extract_all(text, F.lit(command), F.lit(1))).alias("keys")).where(F.col("keys").isNotNull())
    return found.select(F.explode(F.split("keys", ",")).alias("key")).select(F.trim("key").alias("key")).where(F.col("key") != "")


def bibliography_keys(texts: DataFrame, text: str = "text") -> DataFrame:
    """Keys that a BibTeX file defines."""
    entry = r"@[A-Za-z]+\s*\{\s*([^,\s]+)\s*,"
    found = texts.select(F.explode_outer(F.regexp_extract_all(text, F.lit(entry), F.lit(1))).alias("key"))
    return found.where(F.col("key").isNotNull())


def write_report(df: DataFrame, folder: str, schema_tag: str, run_id: str) -> str:
    """A versioned report that never overwrites: rows as JSON with a schema tag, under its own run."""
    path = f"{folder}/{schema_tag}-{run_id}"
    df.select(F.lit(schema_tag).alias("schema"), *df.columns).write.mode("errorifexists").json(path)
    return path


def write_tiers(df: DataFrame, folder: str, tier: str = "tier") -> None:
    """One folder for each tier; readers that ask for one tier read no other."""
    df.write.partitionBy(tier).mode("errorifexists").parquet(folder)


def read_tier(spark: SparkSession, folder: str, schema: str, tier: str, column: str = "tier") -> DataFrame:
    """Manifests of one tier; the scan is pruned to its folder."""
    return spark.read.schema(schema).parquet(folder).where(F.col(column) == tier)


def newest_reports(spark: SparkSession, folder: str, schema: str, accept: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(rows of the schema, report): rows of the report of last name below a folder, of those that are accepted.

    A report is a folder of JSON files, told from the files' own paths.  `accept` gets all rows with their `report`
    and returns the names that may be chosen."""
    path = F.col("_metadata.file_path")
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).json(folder).select("*", F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("report"))
    last = newest(rows.select("report").distinct() if accept is None else accept(rows).select("report").distinct(), path="report")
    return rows.join(last, "report", "left_semi")  # one name


def append_log(df: DataFrame, folder: str) -> None:
    df.write.mode("append").json(folder)


def update_partitions(tables: Tables, folder: str, old: DataFrame, new: DataFrame, key: str, column: str, field: str, part: str) -> DataFrame:
    """`replace_field` in place over a table partitioned by `part`: (key, part, state) of every record.

    Changed records are told first, and written before anything is replaced; then only the partitions that hold one are
    rewritten, all others keep their files.  Records without a new value stay as they are and are `missing`.
    """
    counts = Observation()
    state = F.when(F.col("state") == "error", "missing").otherwise(F.col("state")).alias("state")
    done = replace_field(old, new, key, column, field).observe(counts, F.count_if(F.col("state") == "changed").alias("changed"))
    states = tables.save(done.select(key, part, state), "states")
    if counts.get["changed"]:
        touched = states.where(F.col("state") == "changed").select(part).distinct()  # one row a partition at most
        kept = tables.save(replace_field(old.join(touched, part, "left_semi"), new, key, column, field).select(*old.columns), "kept")
        kept.repartition(part).write.option("partitionOverwriteMode", "dynamic").partitionBy(part).mode("overwrite").parquet(folder)
    return states


def replace_field(old: DataFrame, new: DataFrame, key: str, column: str, field: str) -> DataFrame:
    """Old records with one field of a struct column replaced where a new value exists, and a state of each row.
    `new` has the key and `value`."""
    joined = old.join(new.select(key, F.col("value").alias("_new")), key, "left")
    state = F.when(F.col("_new").isNull(), "error").when(F.col(f"{column}.{field}").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    kept = F.when(F.col("_new").isNull(), F.col(column)).otherwise(F.col(column).withField(field, F.col("_new")))
    return joined.select(*[kept.alias(c) if c == column else F.col(c) for c in old.columns], state.alias("state"))
