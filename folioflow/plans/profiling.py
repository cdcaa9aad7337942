"""Profile queries over the documents by language, and the resume and update queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, profile
from .base import query, table

_FACTS = {
    ("text", "length_class", "body"): ("CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 3000 THEN 'medium' ELSE 'long' END", lambda: F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 3000, "medium").otherwise("long")),
    ("text", "has_pipe", "body"): ("CASE WHEN contains(text, '|') THEN 'true' ELSE 'false' END", lambda: F.when(F.contains("text", F.lit("|")), "true").otherwise("false")),
    ("legal", "license", "body"): ("CASE WHEN contains(text, 'Licensed under') THEN 'licensed' WHEN contains(text, 'All rights reserved') THEN 'reserved' END", lambda: F.when(F.contains("text", F.lit("Licensed under")), "licensed").when(F.contains("text", F.lit("All rights reserved")), "reserved")),
    ("metadata", "source", "head"): ("source", lambda: F.col("source")),
}
_LONG = "SELECT doc_id, lang, category, node, part, value_json, CASE WHEN value_json IS NULL THEN 'unknown' ELSE 'resolved' END AS status FROM (" + " UNION ALL ".join(f"SELECT doc_id, lang, '{c}' AS category, '{n}' AS node, '{p}' AS part, {sql} AS value_json FROM documents" for (c, n, p), (sql, _) in _FACTS.items()) + ")"


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    long = profile.evidence(docs.withColumn("id", F.struct("doc_id", "lang")), "id", {k: col() for k, (_, col) in _FACTS.items()})
    return long.select("id.*", *profile.KEY, "value_json", "status")


@query(f"SELECT * FROM ({_LONG})")
def evidence_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(spark, sf_dir)


_MODAL = f"""WITH l AS ({_LONG}), c AS (SELECT lang, category, node, part, value_json, count(*) AS n FROM l WHERE value_json IS NOT NULL GROUP BY ALL),
 m AS (SELECT lang, category, node, part, arg_min(value_json, (-n, value_json)) AS mode, max(n) AS top, sum(n)::BIGINT AS sample_size, count(*) AS k FROM c GROUP BY ALL),
 p AS (SELECT lang, category, node, part, mode, round(top / sample_size, 6) AS agreement, sample_size, k - 1 AS n_conflicts,
  CASE WHEN sample_size >= 3 AND top / sample_size >= 0.6 THEN CASE WHEN k = 1 THEN 'resolved' ELSE 'mixed' END ELSE 'unknown' END AS status, CASE WHEN sample_size >= 3 AND top / sample_size >= 0.6 THEN 'domain_family' ELSE 'abstain' END AS authority FROM m)"""


@query(f"{_MODAL} SELECT * FROM p")
def domain_modal_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.modal(_long(spark, sf_dir), ["lang"])


@query(f"{_MODAL} SELECT lang, count(*) FILTER (authority = 'domain_family') AS resolved_nodes, count(*) AS nodes, CASE WHEN count(*) FILTER (authority = 'domain_family') > 0 THEN 'domain_family' ELSE 'abstain' END AS level FROM p GROUP BY lang")
def domain_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.resolution(profile.modal(_long(spark, sf_dir), ["lang"]), ["lang"])


@query(f"""WITH l AS ({_LONG}), t(template, rank, category, node, value_json) AS (VALUES ('licensed_long', 1, 'text', 'length_class', 'long'), ('licensed_long', 1, 'legal', 'license', 'licensed'), ('tabular', 2, 'text', 'has_pipe', 'true'), ('plain', 3, 'text', 'has_pipe', 'false')),
 f AS (SELECT doc_id, template, rank, count(*) AS n FROM l JOIN t USING (category, node, value_json) GROUP BY ALL),
 b AS (SELECT doc_id, arg_min(template, rank) AS template FROM f JOIN (SELECT template, count(*) AS size FROM t GROUP BY 1) USING (template) WHERE n = size GROUP BY doc_id)
 SELECT doc_id, template FROM (SELECT DISTINCT doc_id FROM l) LEFT JOIN b USING (doc_id)""")
def template_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("licensed_long", 1, "text", "length_class", "long"), ("licensed_long", 1, "legal", "license", "licensed"), ("tabular", 2, "text", "has_pipe", "true"), ("plain", 3, "text", "has_pipe", "false")]
    templates = spark.createDataFrame(rows, "template string, rank int, category string, node string, value_json string")
    return profile.match_templates(_long(spark, sf_dir), templates, "doc_id")


@query(f"SELECT doc_id, bool_or(category = 'legal' AND value_json IS NOT NULL) AS legal, bool_or(category = 'text' AND value_json NOT IN ('false')) AS \"text\", bool_or(category = 'metadata' AND value_json IS NOT NULL) AS metadata FROM ({_LONG}) GROUP BY doc_id")
def category_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.presence(_long(spark, sf_dir), "doc_id", ["legal", "text", "metadata"])


_ROW = "concat_ws('|', category, node, part, coalesce(value_json, 'null'))"
_SUMS = f"sum(('0x' || substr(md5({_ROW}), 1, 15))::HUGEINT)::VARCHAR AS sum_1, sum(('0x' || substr(md5({_ROW}), 16, 15))::HUGEINT)::VARCHAR AS sum_2"
_COLUMNS = ["category", "node", "part", "value_json"]


def _again(long: DataFrame) -> DataFrame:
    """Another run of the profile: shuffled, with one value changed in one document of 50 and a row twice in another."""
    changed = F.when((F.col("doc_id") % 50 == 7) & (F.col("node") == "length_class"), "other").otherwise(F.col("value_json"))
    twice = F.when((F.col("doc_id") % 50 == 9) & (F.col("node") == "length_class"), 2).otherwise(1)
    rows = long.withColumn("value_json", changed).withColumn("_n", F.explode(F.sequence(F.lit(1), twice))).drop("_n")
    return rows.repartition(7, "value_json").sortWithinPartitions(F.desc("node"))


@query(f"""WITH a AS ({_LONG}), b AS (SELECT * REPLACE (CASE WHEN doc_id % 50 = 7 AND node = 'length_class' THEN 'other' ELSE value_json END AS value_json) FROM a UNION ALL SELECT * FROM a WHERE doc_id % 50 = 9 AND node = 'length_class'),
 f AS (SELECT doc_id, sha256(string_agg({_ROW}, chr(10) ORDER BY {_ROW})) AS h, count(*) AS n, {_SUMS} FROM a GROUP BY doc_id), g AS (SELECT doc_id, sha256(string_agg({_ROW}, chr(10) ORDER BY {_ROW})) AS h, count(*) AS n, {_SUMS} FROM b GROUP BY doc_id)
 SELECT doc_id, f.h = g.h AS by_list, f.n = g.n AND f.sum_1 = g.sum_1 AND f.sum_2 = g.sum_2 AS by_sums FROM f JOIN g USING (doc_id)""")
def determinism_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a second run of the profile, shuffled and with planted differences, agrees: a verdict for each document,
    by its sorted rows and by sums of their hashes."""
    long = _long(spark, sf_dir)
    return profile.determinism(long, _again(long), "doc_id", _COLUMNS)


@query(f"SELECT doc_id, count(*) AS n, {_SUMS} FROM ({_LONG}) GROUP BY doc_id")
def profile_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile_digest(_long(spark, sf_dir), "doc_id", _COLUMNS)


@query(f"SELECT doc_id, sha256(string_agg(concat_ws('|', category, node, part, coalesce(value_json, 'null')), chr(10) ORDER BY concat_ws('|', category, node, part, coalesce(value_json, 'null')))) AS profile_hash FROM ({_LONG}) GROUP BY doc_id")
def profile_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile_hash(_long(spark, sf_dir), "doc_id")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def checkpoint_last_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return profile.last_rows(log, "user_id", "event_id")


@query("SELECT o_orderkey AS id, o_orderpriority AS slice FROM orders ANTI JOIN (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem) USING (o_orderkey)")
def resume_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is still to do: ids without a row in the log."""
    todo = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("slice"))
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"))
    return todo.join(done, "id", "left_anti")


@query("""SELECT state, count(*) AS n FROM (SELECT CASE WHEN q.doc_id IS NULL THEN 'error' WHEN (n_chars > 1000) IS DISTINCT FROM (quality = 1) THEN 'changed' ELSE 'unchanged' END AS state FROM documents LEFT JOIN labels q USING (doc_id)) GROUP BY state""")
def partial_update_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old records against new ones: changed, unchanged, missing."""
    old = table(spark, sf_dir, "documents").select("doc_id", F.struct((F.col("n_chars") > 1000).alias("flag")).alias("old"))
    new = table(spark, sf_dir, "labels").select("doc_id", F.struct((F.col("quality") == 1).alias("flag")).alias("new"))
    joined = old.join(new, "doc_id", "left")
    state = audit.cascade((F.col("new").isNull(), "error"), (F.size(audit.changed_fields(F.col("old"), F.col("new"), ["flag"])) > 0, "changed"), default="unchanged")
    return joined.select(state.alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))
