"""Logs, manifests and reports as files: written from the tables to the shared folder, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import Tables
from ..operators import nested
from ..sources import files
from ..streaming.last_rows import LastRows
from .base import query, table

_LOG = "user_id long, event_id long, event_type string, value double"


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def streamed_last_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of every user from a log that arrives in files: out of order, and a third of it twice."""
    tables = Tables(spark)
    log, state, marks = (tables.folder(n) for n in ("log", "state", "marks"))
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    late = events.repartition(4, F.col("event_id") % 4)
    files.append_log(late, log)
    rows = LastRows(spark, state, _LOG, "user_id", "event_id", every=3)
    rows.follow(log, marks, files_per_batch=1).awaitTermination()
    files.append_log(events.where(F.col("event_id") % 3 == 0).coalesce(1), log)
    rows.follow(log, marks, files_per_batch=1).awaitTermination()
    return rows.rows()


_TIER = "CASE WHEN quality IS NULL THEN 'unrated' WHEN toxic = 1 THEN 'quarantine' WHEN quality = 1 THEN 'gold' ELSE 'silver' END"


@query(f"""SELECT source, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM (SELECT source, n_chars, {_TIER} AS tier FROM documents LEFT JOIN labels USING (doc_id)) WHERE tier = 'gold' GROUP BY source""")
def tier_manifest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests written by tier; the totals of one tier read no other tier's files."""
    folder = Tables(spark).folder("tiers")
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    files.write_tiers(joined.select("doc_id", "source", "n_chars", F.expr(_TIER).alias("tier")), folder)
    gold = files.read_tier(spark, folder, "doc_id long, source string, n_chars long, tier string", "gold")
    return gold.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))


@query("SELECT 'run-2' AS run, lang, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def newest_accepted_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three versions of a report, found by their file names, the newest that counted every document: the last one
    was written from a part of them."""
    folder = Tables(spark).folder("reports")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    for run, rows in (("run-1", docs), ("run-2", docs), ("run-3", docs.where(F.col("doc_id") % 2 == 0))):
        counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))
        files.write_report(counts, folder, "language-report-v1", run)
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    schema = "schema string, lang string, documents long, chars long"
    found = files.newest_reports(spark, folder, schema, lambda rows: rows.groupBy("report").agg(F.sum("documents").alias("n")).join(total, F.col("n") == F.col("total")).select("report"))
    return found.select(F.regexp_extract("report", r"(run-\d+)$", 1).alias("run"), "lang", "documents", "chars")


@query("""SELECT part, state, count(*) AS n, max(count(*) FILTER (state = 'changed')) OVER (PARTITION BY part) > 0 AS rewritten
 FROM (SELECT doc_id % 8 AS part, CASE WHEN q.doc_id IS NULL OR doc_id % 8 > 2 THEN 'missing' WHEN (n_chars > 1000) IS DISTINCT FROM (quality = 1) THEN 'changed' ELSE 'unchanged' END AS state FROM documents LEFT JOIN labels q USING (doc_id)) GROUP BY part, state""")
def partial_update_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One field of records in eight partitions, with new values for three of them: states of the records, and which
    partitions have other files than before."""
    tables = Tables(spark)
    folder = tables.folder("records")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.struct((F.col("n_chars") > 1000).alias("flag"), "lang").alias("record"), (F.col("doc_id") % 8).alias("part"))
    docs.repartition("part").write.partitionBy("part").parquet(folder)
    new = table(spark, sf_dir, "labels").where(F.col("doc_id") % 8 <= 2).select("doc_id", (F.col("quality") == 1).alias("value"))
    held = lambda: spark.read.schema(docs.schema).parquet(folder)
    names = lambda: held().select("part", F.col("_metadata.file_path").alias("f")).distinct()
    before = tables.save(names(), "before")
    states = files.update_partitions(tables, folder, held(), new, "doc_id", "record", "flag", "part")
    same = names().join(before, ["part", "f"], "left_semi").select("part").distinct().withColumn("kept", F.lit(True))
    return states.groupBy("part", "state").agg(F.count(F.lit(1)).alias("n")).join(same, "part", "left").select("part", "state", "n", F.col("kept").isNull().alias("rewritten"))


@query("""WITH e AS (SELECT event_type, value, user_id, json_extract_string(props, '$.k')::DOUBLE AS k FROM events), l AS (SELECT event_type, 'scores.value' AS path, value AS v FROM e
 UNION ALL SELECT event_type, 'scores.by_user[1]', user_id FROM e UNION ALL SELECT event_type, 'props.k', k FROM e UNION ALL SELECT event_type, 'runs[0].deep.er.k', k + 0.5 FROM e)
 SELECT event_type, path, count(v) AS n, round(avg(v), 6) AS mean FROM l WHERE v IS NOT NULL GROUP BY event_type, path""")
def nested_report_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro averages of every number in nested reports, whatever stands beside them."""
    k = F.get_json_object("props", "$.k").cast("double")
    text = lambda c: F.col(c).cast("string")
    parts = ['{"scores": {"value": ', text("value"), ', "by_user": ["', F.col("event_type"), '", ', text("user_id"), ', true, null]}, "props": ', F.col("props")]
    parts += [', "notes": ["12", "', F.col("event_type"), '"], "ok": false, "runs": [{"deep": {"er": {"k": ', (k + 0.5).cast("string"), "}}}]}"]
    report = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    events = table(spark, sf_dir, "events").select("event_id", "event_type", report.alias("report"))
    long = nested.numeric_leaves(Tables(spark), events, ["event_id", "event_type"], "report")
    return long.groupBy("event_type", "path").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
