"""Statistics: labels as outcomes, events as trial logs, orders as chains of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import Tables
from ..operators import stats
from .base import query, table

REPS = stats.REPLICATES
_U = "(('0x' || substr(md5(concat_ws('|', '20260828', rep::VARCHAR, {})), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296"
#: distributions of n trials at p, for each (n, p) of a table tr: (n, p, k, cdf)
_CDF = """pmf AS (SELECT n, p, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(p) + (n - k) * ln(1 - p)) AS f FROM (SELECT n, p, unnest(range(n + 1)) AS k FROM tr)),
 cdf AS (SELECT n, p, list(k ORDER BY k) AS ks, list(f ORDER BY k) AS fs FROM (SELECT n, p, k, sum(f) OVER (PARTITION BY n, p ORDER BY k) / sum(f) OVER (PARTITION BY n, p) AS f FROM pmf) GROUP BY n, p)"""
#: least k whose probability from 0 on reaches u
_K = "(len(list_filter(fs, lambda f: f < {u})))"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("quality", F.col("quality").cast("double")).withColumn("toxic", F.col("toxic").cast("double"))


_LAB = "lab AS (SELECT q.doc_id, lang, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic FROM labels q JOIN documents USING (doc_id))"
_BOOT = f"""WITH {_LAB}, b AS (SELECT lang, count(quality) AS n, avg(quality) AS mean, min(quality) AS lo, max(quality) AS hi, count(*) FILTER (quality = 0) AS zeros FROM lab GROUP BY lang),
 tr AS (SELECT DISTINCT n, zeros::DOUBLE / n AS p FROM b WHERE lo < hi), {_CDF},
 m AS (SELECT lang, rep, (n - {_K.format(u=_U.format("'0', '0'"))})::DOUBLE / n AS mean FROM (SELECT lang, b.n, fs, unnest(range({REPS})) AS rep FROM b JOIN cdf ON cdf.n = b.n AND cdf.p = zeros::DOUBLE / b.n)),
 s AS (SELECT lang, list(mean ORDER BY mean) AS ms FROM m GROUP BY lang)"""


@query(f"""{_BOOT} SELECT lang, n, round(mean, 6) AS mean, round(CASE WHEN n < 2 THEN NULL WHEN lo = hi THEN CASE WHEN lo = 1 THEN pow(0.025::DOUBLE, 1.0 / n) ELSE 0 END ELSE ms[{int(0.025 * REPS)} + 1] END, 6) AS low,
 round(CASE WHEN n < 2 THEN NULL WHEN lo = hi THEN CASE WHEN lo = 1 THEN 1 ELSE 1 - pow(0.025::DOUBLE, 1.0 / n) END ELSE ms[{int(0.975 * REPS)}] END, 6) AS high,
 CASE WHEN n < 2 THEN 'undefined' WHEN lo = hi THEN 'exact_boundary' ELSE 'percentile' END AS method FROM b LEFT JOIN s USING (lang)""")
def bootstrap_ci_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.bootstrap_ci(Tables(spark), _labelled(spark, sf_dir), ["lang"], "quality")


@query("""SELECT event_type, n, 1.0::DOUBLE AS mean, round(pow(0.025::DOUBLE, 1.0 / n), 6) AS low, 1.0::DOUBLE AS high, 'exact_boundary' AS method FROM (SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY event_type) WHERE n >= 2""")
def boundary_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user of an event type counts as a success: the exact interval for n of n."""
    users = table(spark, sf_dir, "events").select("event_type", "user_id").distinct().withColumn("passed", F.lit(1.0))
    return stats.bootstrap_ci(Tables(spark), users, ["event_type"], "passed")


_TEST = f"""v AS (SELECT grp, abs(d) AS x, count(*) AS n, row_number() OVER (PARTITION BY grp ORDER BY abs(d)) - 1 AS k FROM d WHERE d <> 0 GROUP BY grp, abs(d)),
 tr AS (SELECT DISTINCT n, 0.5::DOUBLE AS p FROM v), {_CDF},
 f AS (SELECT grp, rep, sum(x * (2 * {_K.format(u=_U.format("k::VARCHAR"))} - n)) AS flipped FROM (SELECT grp, x, v.n, v.k, fs, unnest(range({REPS})) AS rep FROM v JOIN cdf ON cdf.n = v.n) GROUP BY grp, rep),
 tot AS (SELECT grp, count(*) AS n, sum(d) AS total FROM d WHERE d IS NOT NULL GROUP BY grp),
 h AS (SELECT grp, avg((abs(flipped) >= abs(total) - 1e-12)::INT) AS p FROM f JOIN tot USING (grp) GROUP BY grp),
 t AS (SELECT grp, n, round(total / n, 6) AS difference, CASE WHEN n >= 2 THEN round(coalesce(p, 1), 6) END AS p FROM tot LEFT JOIN h USING (grp))"""


@query(f"WITH {_LAB}, d AS (SELECT lang AS grp, doc_id, quality - toxic AS d FROM lab), {_TEST} SELECT grp AS lang, n, difference, p FROM t")
def paired_permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.permutation_test(Tables(spark), _labelled(spark, sf_dir), ["lang"], "quality", "toxic")


@query(f"""WITH {_LAB}, s AS (SELECT doc_id, 'quality' AS system, quality AS v FROM lab UNION ALL SELECT doc_id, 'safe', 1 - toxic FROM lab UNION ALL SELECT doc_id, 'toxic', toxic FROM lab),
 d AS (SELECT a.system || '/' || b.system AS grp, doc_id, a.v - b.v AS d FROM s a JOIN s b USING (doc_id) WHERE a.system < b.system), {_TEST}
 SELECT string_split(grp, '/')[1] AS system_a, string_split(grp, '/')[2] AS system_b, n, difference, p FROM t""")
def pairwise_system_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _labelled(spark, sf_dir).withColumn("safe", 1 - F.col("toxic"))
    long = wide.unpivot(["doc_id"], ["quality", "safe", "toxic"], "system", "value")
    return stats.permutation_test(Tables(spark), stats.system_pairs(long, ["doc_id"], "system", "value"), ["system_a", "system_b"], "value_a", "value_b")


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chains: lineitems in order are its pairs; the arm alternates with the order key, the customer is
    the document, the priority the family."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    pair = F.struct(*order, F.when(F.col("l_returnflag") != "R", "pass").otherwise("fail").alias("fwd"), F.when(F.col("l_quantity") > 5, "pass").otherwise("fail").alias("inv"))
    pairs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("chain_id")).agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("chain_id"),
        F.col("o_custkey").alias("doc"),
        F.col("o_orderpriority").alias("family"),
        F.when(F.col("o_orderkey") % 2 == 0, "control").otherwise("treatment").alias("arm"),
        F.when(F.col("o_orderstatus") == "P", "not_applicable").otherwise("completed").alias("status"),
    )
    joined = orders.join(pairs, "chain_id", "left")
    return joined.select("chain_id", "doc", "family", "arm", stats.chain_outcome(F.col("status"), F.col("pairs")).alias("outcome"), stats.steady_state(F.col("status"), F.col("pairs")).alias("steady"))


_CHAINS = """o AS (SELECT o_orderkey AS chain_id, o_custkey AS doc, o_orderpriority AS family, CASE WHEN o_orderkey % 2 = 0 THEN 'control' ELSE 'treatment' END AS arm, o_orderstatus = 'P' AS excluded FROM orders),
 l AS (SELECT l_orderkey AS chain_id, l_returnflag <> 'R' AND l_quantity > 5 AS ok, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem),
 p AS (SELECT chain_id, count(*) AS n, bool_and(ok) AS every, count(*) FILTER (ok AND k > 1) AS later FROM l GROUP BY chain_id),
 c AS (SELECT chain_id, doc, family, arm, CASE WHEN excluded OR n IS NULL THEN NULL WHEN every THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS outcome, CASE WHEN excluded OR n IS NULL OR n < 2 THEN NULL ELSE later::DOUBLE / (n - 1) END AS steady FROM o LEFT JOIN p USING (chain_id))"""


@query(f"WITH {_CHAINS} SELECT chain_id, family, arm, outcome FROM c")
def chain_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chains(spark, sf_dir).select("chain_id", "family", "arm", "outcome")


@query(f"WITH {_CHAINS} SELECT chain_id, family, arm, round(steady, 6) AS steady FROM c")
def steady_state_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chains(spark, sf_dir).select("chain_id", "family", "arm", F.round("steady", 6).alias("steady"))


@query(f"""WITH {_CHAINS}, last_one AS (SELECT family, doc, arm, arg_max(outcome, chain_id) AS outcome FROM c WHERE outcome IS NOT NULL GROUP BY ALL),
 w AS (SELECT family, doc, max(outcome) FILTER (arm = 'control') AS control, max(outcome) FILTER (arm = 'treatment') AS treatment FROM last_one GROUP BY ALL),
 m AS (SELECT family, count(control) AS n_control, count(treatment) AS n_treatment, round(avg(control), 6) AS mean_control, round(avg(treatment), 6) AS mean_treatment FROM w GROUP BY family),
 x AS (SELECT family, count(*) FILTER (outcome IS NULL) AS not_applicable FROM c GROUP BY family),
 d AS (SELECT family AS grp, doc AS doc_id, treatment - control AS d FROM w), {_TEST}
 SELECT m.*, not_applicable, coalesce(n, 0) AS n_pairs, difference, p FROM m JOIN x USING (family) LEFT JOIN t ON grp = family""")
def ab_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ab_report(Tables(spark), _chains(spark, sf_dir), ["family"], "doc", "arm", "outcome", "chain_id")


@query("""SELECT event_type, metric, count(value) AS n, round(avg(value), 6) AS mean FROM (SELECT event_type, 'cost' AS metric, CASE WHEN value > 5 THEN value END AS value FROM events UNION ALL SELECT event_type, 'k', json_extract_string(props, '$.k')::DOUBLE FROM events) GROUP BY ALL""")
def macro_average_by_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics out of a struct and a JSON path, nulls skipped."""
    events = table(spark, sf_dir, "events").select("event_type", F.when(F.col("value") > 5, F.col("value")).alias("cost"), F.get_json_object("props", "$.k").cast("double").alias("k"))
    return stats.macro_average(events, ["event_type"], ["cost", "k"])


@query("SELECT user_id % 10 AS backend, CASE event_type WHEN 'error' THEN 'crashed' WHEN 'signup' THEN 'unknown' ELSE 'scored' END AS status, count(*) AS n FROM events GROUP BY ALL")
def backend_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("backend"), F.when(kind == "error", "crashed").when(kind == "signup", "unknown").otherwise("scored").alias("status"))
    return rows.groupBy("backend", "status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, user_id % 2 = 0 AS arm, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS least, max(value) AS most FROM events GROUP BY ALL")
def timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 2 == 0).alias("arm"), "value")
    return stats.timing(rows, ["event_type", "arm"], "value")


@query("SELECT source, lang, count(*) AS documents, count(*) FILTER (n_chars > 0) AS evaluable, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (source, lang)")
def split_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by source and language with their totals."""
    return table(spark, sf_dir, "documents").rollup("source", "lang").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("n_chars") > 0).alias("evaluable"), F.sum("n_chars").alias("chars"))
