"""PII, duplicates, contamination, ledgers and issue audits over the document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tables import Tables
from ..operators import audit, dedup, pii, sampling
from .base import LINES, NORM, query, table
from .sampling import FRACTIONS, SEED

_PII = rf"""SELECT doc_id, source, text,
 regexp_extract_all(text, '{pii.EMAIL}') AS e,
 list_filter(regexp_extract_all(text, '{pii.EMAIL}'), lambda x: lower(string_split(x, '@')[-1]) NOT IN ('example.com', 'example.org', 'example.net', 'example.test')) AS r,
 len(regexp_extract_all(text, '{pii.PHONE}')) AS p, len(regexp_extract_all(text, '{pii.SSN}')) AS s, regexp_extract_all(text, '{pii.LONG_DIGITS}') AS g FROM documents"""


@query(f"""SELECT doc_id, source, len(e) AS email_count, len(r) AS real_email_count, len(e) - len(r) AS placeholder_email_count, p AS phone_count, s AS ssn_count, len(g) AS long_digit_count,
 array_to_string(r[1:5], ',') AS email_samples, array_to_string(g[1:5], ',') AS digit_samples, len(r) = 0 AND p = 0 AND s = 0 AND len(g) = 0 AS clean FROM ({_PII})""")
def pii_scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


@query(f"""SELECT source, count(*) AS file_count, count(*) FILTER (len(r) = 0 AND p = 0 AND s = 0 AND len(g) = 0) AS clean_count, count(*) FILTER (text IS NULL) AS error_count,
 sum(len(e))::BIGINT AS email_count, sum(len(r))::BIGINT AS real_email_count, sum(p)::BIGINT AS phone_count, sum(s)::BIGINT AS ssn_count, sum(len(g))::BIGINT AS long_digit_count FROM ({_PII}) GROUP BY source""")
def pii_corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summarise(pii.scan(table(spark, sf_dir, "documents").select("source", "text")), "source")


@query(f"SELECT doc_id, array_to_string(r[1:5], ',') AS email_samples, len(r) AS real_email_count FROM ({_PII}) WHERE len(r) > 0")
def pii_email_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = pii.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scanned.where(F.col("real_email_count") > 0).select("doc_id", "email_samples", "real_email_count")


@query(f"""SELECT CASE WHEN q.toxic = 1 THEN 'excluded' WHEN q.doc_id IS NULL THEN 'pending' ELSE 'cleared' END AS verdict, count(*) AS hits
 FROM ({_PII}) d LEFT JOIN labels q USING (doc_id) WHERE len(r) > 0 OR p > 0 OR s > 0 OR len(g) > 0 GROUP BY 1""")
def pii_adjudication(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = pii.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).where(~F.col("clean")).select("doc_id")
    joined = hits.join(table(spark, sf_dir, "labels").withColumn("seen", F.lit(True)), "doc_id", "left")
    verdict = F.when(F.col("toxic") == 1, "excluded").when(F.col("seen").isNull(), "pending").otherwise("cleared")
    return joined.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("hits"))


@query("SELECT sha256(text) AS key, count(*) AS n, min(doc_id) AS first_member FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_groups(table(spark, sf_dir, "documents"), F.sha2("text", 256), "doc_id")


@query(f"SELECT sha256({NORM.format('text')}) AS key, count(*) AS n, count(DISTINCT sha256(text)) AS n_raw FROM documents GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT sha256(text)) > 1")
def content_duplicate_groups_diff_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.content_duplicates(table(spark, sf_dir, "documents"), F.sha2(T.normalise(F.col("text")), 256), F.sha2("text", 256))


@query("SELECT count(*) AS scanned, count(DISTINCT sha256(text)) AS unique_documents FROM documents")
def unique_document_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("scanned"), F.count_distinct(F.sha2("text", 256)).alias("unique_documents"))


@query(f"""WITH d AS (SELECT DISTINCT doc_id, {NORM.format('l')} AS line FROM (SELECT doc_id, unnest({LINES}) AS l FROM documents)),
 b AS (SELECT item_id, {NORM.format('l')} AS line FROM (SELECT item_id, unnest({LINES}) AS l FROM benchmark))
 SELECT doc_id, count(DISTINCT item_id) AS items FROM d JOIN b USING (line) GROUP BY doc_id""")
def benchmark_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lambda df, key: df.select(key, F.explode_outer(T.paragraphs(F.col("text"))).alias("l")).where(F.col("l").isNotNull()).select(key, T.normalise(F.col("l")).alias("line"))
    held = lines(table(spark, sf_dir, "documents"), "doc_id").join(lines(table(spark, sf_dir, "benchmark"), "item_id"), "line")
    return held.groupBy("doc_id").agg(F.count_distinct("item_id").alias("items"))


@query("SELECT count(*) AS shared, count(*) = 0 AS contamination_free FROM (SELECT sha256(text) FROM documents INTERSECT SELECT sha256(text) FROM benchmark)")
def holdout_hash_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda name: table(spark, sf_dir, name).select(F.sha2("text", 256).alias("h"))
    return dedup.overlap(digest("documents"), digest("benchmark"), "h")


_NEAR = f"""l AS (SELECT DISTINCT doc_id AS i, md5({NORM.format('x')}) AS f FROM (SELECT doc_id, unnest({LINES}) AS x FROM documents)),
 n AS (SELECT i, count(*) AS n FROM l GROUP BY i), r AS (SELECT f FROM l GROUP BY f HAVING count(*) > 1),
 p AS (SELECT DISTINCT x.i AS a, y.i AS b FROM l x JOIN r USING (f) JOIN l y ON y.f = x.f AND x.i < y.i),
 s AS (SELECT a, b, count(*) AS c FROM p JOIN l x ON x.i = a JOIN l y ON y.i = b AND y.f = x.f GROUP BY a, b),
 near AS (SELECT a, b, c / (u.n + v.n - c) AS jaccard FROM s JOIN n u ON u.i = a JOIN n v ON v.i = b WHERE c / (u.n + v.n - c) >= 0.8),
 class AS (SELECT i, min(i) OVER (PARTITION BY fs) AS c, count(*) OVER (PARTITION BY fs) AS n FROM (SELECT i, list(f ORDER BY f) AS fs FROM l GROUP BY i))"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, f): digests of the distinct normalised lines of every document."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode_outer(T.paragraphs(F.col("text"))).alias("l")).where(F.col("l").isNotNull())
    return lines.select("doc_id", F.md5(T.normalise(F.col("l"))).alias("f"))


@query(f"""WITH {_NEAR} SELECT a, b, u.n AS n_a, v.n AS n_b, round(jaccard, 6) AS jaccard FROM near JOIN class u ON u.i = a AND u.c = a JOIN class v ON v.i = b AND v.c = b
 UNION ALL SELECT DISTINCT c, c, n, n, 1.0::DOUBLE FROM class WHERE n > 1 UNION ALL SELECT c, i, n, n, 1.0::DOUBLE FROM class WHERE i <> c""")
def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near pairs of classes of equal line sets, and every document of a class beside its first."""
    return dedup.near_duplicate_pairs(Tables(spark), _lines(spark, sf_dir), "doc_id", "f", copies=True)


@query(f"""WITH {_NEAR}, side AS (SELECT doc_id, lang IS NULL AS missing, coalesce(lang, '') AS lang, source FROM documents),
 q AS (SELECT (x.missing, x.lang, x.source) AS p, (y.missing, y.lang, y.source) AS q FROM near JOIN side x ON x.doc_id = a JOIN side y ON y.doc_id = b WHERE x.source <> y.source),
 g AS (SELECT least(p, q) AS p, greatest(p, q) AS q, count(*) AS pairs FROM q GROUP BY ALL)
 SELECT CASE WHEN NOT p[1] THEN p[2] END AS lang_a, p[3] AS source_a, CASE WHEN NOT q[1] THEN q[2] END AS lang_b, q[3] AS source_b, pairs FROM g""")
def cross_split_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near pairs of documents of different sources, by both sides, the smaller (lang, source) first; documents without
    a language count, as a side of their own after all others."""
    tables = Tables(spark)
    members, near = dedup.near_classes(tables, _lines(spark, sf_dir), "doc_id", "f")
    lang = F.struct(F.col("lang").isNull().alias("missing"), F.coalesce("lang", F.lit("")).alias("lang"))
    found = dedup.collisions(tables.save(members, "members"), near, table(spark, sf_dir, "documents").select("doc_id", lang.alias("lang"), "source"), "doc_id", ["lang", "source"])
    named = lambda s: F.when(~F.col(f"{s}.lang.missing"), F.col(f"{s}.lang.lang"))
    split = found.select(named("side_a").alias("lang_a"), F.col("side_a.source").alias("source_a"), named("side_b").alias("lang_b"), F.col("side_b.source").alias("source_b"), "pairs")
    return split.where(F.col("source_a") != F.col("source_b"))


_LINEAGE = f"""{_NEAR}, t AS (SELECT doc_id AS i, nullif({NORM.format('text')}, '') AS t FROM documents),
 edge AS (SELECT a, b FROM near UNION SELECT b, a FROM near UNION SELECT u.i, v.i FROM t u JOIN t v ON u.t = v.t AND u.i <> v.i),
 reach(a, b) AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
 link AS (SELECT a, count(*) AS n_links FROM (SELECT a, b FROM near UNION SELECT b, a FROM near) GROUP BY a),
 fam AS (SELECT doc_id, least(doc_id, min(b)) AS lineage_id FROM documents LEFT JOIN reach ON a = doc_id GROUP BY doc_id),
 lin AS (SELECT doc_id, coalesce(c, doc_id) AS class_id, lineage_id, coalesce(n_links, 0)::BIGINT AS n_links, count(*) OVER (PARTITION BY lineage_id) AS n_family FROM fam LEFT JOIN class ON class.i = doc_id LEFT JOIN link ON a = doc_id)"""


def _lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.normalise(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(text != "", F.sha2(text, 256)).alias("text_key"))
    return dedup.lineage(Tables(spark), docs, _lines(spark, sf_dir))


@query(f"WITH RECURSIVE {_LINEAGE} SELECT * FROM lin")
def lineage_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lineage(spark, sf_dir)


@query(f"""WITH RECURSIVE {_LINEAGE}, f AS (SELECT lineage_id, count(*) AS size FROM lin GROUP BY lineage_id),
 o AS (SELECT lineage_id, size, row_number() OVER (ORDER BY size DESC, md5(concat_ws('|', '{SEED}', lineage_id::VARCHAR)), lineage_id::VARCHAR) AS k FROM f),
 g(k, lineage_id, split, a, b, c) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, t * 0.6::DOUBLE, t * 0.2::DOUBLE, t * 0.2::DOUBLE FROM (SELECT sum(size)::DOUBLE AS t FROM f)
  UNION ALL SELECT o.k, o.lineage_id, CASE greatest(a, b, c) WHEN a THEN 'development' WHEN b THEN 'validation' ELSE 'primary_holdout' END,
   a - CASE WHEN greatest(a, b, c) = a THEN o.size ELSE 0 END, b - CASE WHEN greatest(a, b, c) = b AND a <> b THEN o.size ELSE 0 END, c - CASE WHEN greatest(a, b, c) = c AND a <> c AND b <> c THEN o.size ELSE 0 END
  FROM g JOIN o ON o.k = g.k + 1)
 SELECT doc_id, lineage_id, split FROM lin JOIN g USING (lineage_id)""")
def lineage_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's split; copies, near copies and what hangs together through them stay in one."""
    rows = _lineage(spark, sf_dir)
    families = rows.groupBy("lineage_id").agg(F.count(F.lit(1)).alias("size"))
    split = sampling.group_split(Tables(spark), families, FRACTIONS, SEED, "lineage_id", "size")
    return rows.join(split.select(F.col("family").cast("long").alias("lineage_id"), "split"), "lineage_id").select("doc_id", "lineage_id", "split")


@query("""SELECT doc_id, coalesce(substr(sha256(text), 1, 16), 'unhashable') AS ledger_id, 'unknown_pending_review' AS license_status,
 CASE toxic WHEN 1 THEN 'flagged' WHEN 0 THEN 'clean' ELSE 'not_assessed' END AS pii_status, 'not_run' AS render_status, CASE quality WHEN 1 THEN 'admitted' WHEN 0 THEN 'rejected' ELSE 'not_admitted' END AS admission, 'unassigned' AS split
 FROM documents LEFT JOIN labels USING (doc_id)""")
def inventory_ledger_sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "flagged").when(F.col("toxic") == 0, "clean").alias("pii_status"), F.when(F.col("quality") == 1, "admitted").when(F.col("quality") == 0, "rejected").alias("admission"))
    return dedup.ledger(table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256")), meta, "doc_id")


@query("""SELECT count(*) AS files, count(*) FILTER (text IS NULL OR text = '') AS integrity_failures, count(*) FILTER (toxic IS NOT NULL) AS organic, count(*) FILTER (toxic IS NULL) AS hand_authored,
 sum(len(string_split(text, '|')) - 1)::BIGINT AS pipes, sum(len(string_split(text, '@')) - 1)::BIGINT AS ats FROM documents LEFT JOIN labels USING (doc_id)""")
def screening_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    marks = lambda c: F.sum(F.size(F.split("text", c)) - 1)
    return joined.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("integrity_failures"),
        F.count("toxic").alias("organic"),
        F.count_if(F.col("toxic").isNull()).alias("hand_authored"),
        marks(r"\|").alias("pipes"),
        marks("@").alias("ats"),
    )


_ISSUES = f"""WITH d AS (SELECT d.doc_id, text, n_chars, toxic, q.doc_id AS known, count(*) OVER (PARTITION BY sha256(text)) AS copies, len({LINES}) AS n FROM documents d LEFT JOIN labels q USING (doc_id)),
 issue AS (SELECT doc_id, 'duplicate_bytes' AS kind, copies::VARCHAR AS detail FROM d WHERE copies > 1
  UNION ALL SELECT doc_id, 'no_verdict', '' FROM d WHERE known IS NULL UNION ALL SELECT doc_id, 'toxic', '' FROM d WHERE toxic = 1
  UNION ALL SELECT doc_id, 'single_paragraph', '' FROM d WHERE n <= 1 UNION ALL SELECT doc_id, 'short', n_chars::VARCHAR FROM d WHERE n_chars < 200
  UNION ALL SELECT doc_id, 'empty', '' FROM d WHERE n_chars = 0)"""


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("h"), F.size(T.paragraphs(F.col("text"))).alias("n"))
    # a null text has no hash; such documents are copies of each other and keep their other issues
    copies = docs.groupBy("h").agg(F.count(F.lit(1)).alias("copies")).withColumnRenamed("h", "h_")
    facts = docs.join(copies, F.col("h").eqNullSafe(F.col("h_"))).join(table(spark, sf_dir, "labels").select("doc_id", "toxic", F.lit(True).alias("known")), "doc_id", "left")
    return audit.issues(facts, "doc_id", _rules())


def _rules() -> dict:
    return {
        "duplicate_bytes": (F.col("copies") > 1, F.col("copies").cast("string")),
        "no_verdict": (F.col("known").isNull(), F.lit("")),
        "toxic": (F.col("toxic") == 1, F.lit("")),
        "single_paragraph": (F.col("n") <= 1, F.lit("")),
        "short": (F.col("n_chars") < 200, F.col("n_chars").cast("string")),
        "empty": (F.col("n_chars") == 0, F.lit("")),
    }


@query(f"{_ISSUES} SELECT * FROM issue")
def issue_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir)


@query(f"{_ISSUES} SELECT kind, count(*) AS issues, count(DISTINCT doc_id) AS documents FROM issue GROUP BY kind")
def issue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("issues"), F.count_distinct("doc_id").alias("documents"))


@query(f"""{_ISSUES}, k AS (SELECT unnest(['duplicate_bytes', 'no_verdict', 'toxic', 'single_paragraph', 'short', 'empty']) AS name),
 c AS (SELECT name, name IN ('duplicate_bytes', 'empty') AS blocking, NOT EXISTS (SELECT 1 FROM issue WHERE kind = name) AS passed FROM k)
 SELECT count(*) AS checks, count(*) FILTER (NOT passed) AS failed, count(*) FILTER (blocking AND NOT passed) AS blocking_failures, count(*) FILTER (blocking AND NOT passed) = 0 AS gate_passed FROM c""")
def gate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A check for each rule, passed if it found nothing."""
    rules = spark.createDataFrame([(name,) for name in _rules()], "name string")  # one row for each rule
    found = _issues(spark, sf_dir).groupBy(F.col("kind").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    checks = rules.join(found, "name", "left").select("name", F.col("n").isNull().alias("passed"))
    return audit.gate(checks.withColumn("blocking", F.col("name").isin("duplicate_bytes", "empty")))


@query(f"""WITH d AS (SELECT doc_id, source, sha256(text) AS h, n_chars, len({LINES}) AS n, toxic, quality FROM documents LEFT JOIN labels USING (doc_id)),
 c AS (SELECT doc_id, unnest([1, 2, 3, 4, 5]) AS position, unnest(['readable', 'not_empty', 'paragraphs', 'not_toxic', 'approved']) AS name, unnest([true, true, false, true, false]) AS blocking,
  unnest([h IS NOT NULL, n_chars > 200, n > 1, coalesce(toxic, 0) = 0, coalesce(quality = 1 AND doc_id % 4 <> 1, false)]) AS passed FROM d)
 SELECT doc_id, position, name, CASE WHEN coalesce(max((blocking AND NOT passed)::INT) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'skipped' WHEN passed THEN 'passed' ELSE 'failed' END AS state FROM c""")
def document_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five checks of every document in order; none is run behind a blocking failure.  Labels serve as approvals; one
    document of four has an approval of other bytes, which does not count."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"), "n_chars", F.size(T.paragraphs(F.col("text"))).alias("n"))
    facts = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    artifact = F.struct((F.col("quality") == 1).alias("approved"), F.when(F.col("doc_id") % 4 == 1, F.lit("stale")).otherwise(F.col("h")).alias("sha256"))
    checks = [
        ("readable", True, F.col("h").isNotNull()),
        ("not_empty", True, F.col("n_chars") > 200),
        ("paragraphs", False, F.col("n") > 1),
        ("not_toxic", True, F.coalesce("toxic", F.lit(0)) == 0),
        ("approved", False, audit.approved(artifact, F.col("h"))),
    ]
    rows = F.array(*[F.struct(F.lit(k).alias("position"), F.lit(name).alias("name"), F.lit(blocking).alias("blocking"), passed.alias("passed")) for k, (name, blocking, passed) in enumerate(checks, 1)])
    return audit.preflight(facts.select("doc_id", F.inline(rows)), ["doc_id"]).select("doc_id", "position", "name", "state")


@query("""WITH p AS (SELECT page_id, url, html FROM pages), e AS (SELECT page_id,
 list_filter(['no_doctype' , 'no_title', 'unbalanced_article', 'empty'], lambda k: CASE k WHEN 'no_doctype' THEN NOT starts_with(lower(html), '<!doctype html>') WHEN 'no_title' THEN NOT contains(html, '<title>')
  WHEN 'unbalanced_article' THEN len(string_split(html, '<article')) <> len(string_split(html, '</article>')) ELSE html = '' END) AS errors FROM p)
 SELECT page_id, array_to_string(errors, ',') AS errors, len(errors) = 0 AS ok FROM e""")
def page_markup_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    count = lambda tag: F.size(F.split(html, tag))
    rules = {
        "no_doctype": ~F.startswith(F.lower(html), F.lit("<!doctype html>")),
        "no_title": ~F.contains(html, F.lit("<title>")),
        "unbalanced_article": count("<article") != count("</article>"),
        "empty": html == "",
    }
    pages = table(spark, sf_dir, "pages").select("page_id", audit.errors(rules).alias("e"))
    return pages.select("page_id", F.array_join("e", ",").alias("errors"), (F.size("e") == 0).alias("ok"))


@query("""SELECT 'dangling' AS kind, o_custkey AS ref FROM (SELECT DISTINCT o_custkey FROM orders) ANTI JOIN customer ON o_custkey = c_custkey
 UNION ALL SELECT 'unused', c_custkey FROM (SELECT DISTINCT c_custkey FROM customer) ANTI JOIN orders ON o_custkey = c_custkey""")
def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ref"))
    return audit.dangling(cited, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ref")), "ref")


@query("""WITH f AS (SELECT user_id, max(event_id) AS failed FROM events WHERE event_type = 'error' GROUP BY user_id),
 r AS (SELECT f.user_id, failed, count(event_id) AS retries, count(*) FILTER (event_type = 'purchase') AS succeeded FROM f LEFT JOIN events e ON e.user_id = f.user_id AND event_id > failed GROUP BY 1, 2)
 SELECT user_id, failed, retries, succeeded > 0 AS recovered FROM r""")
def retry_addendum(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    failed = events.where(F.col("event_type") == "error").groupBy("user_id").agg(F.max("event_id").alias("failed"))
    return audit.retries(failed, events, "user_id", "event_id", F.col("event_type") == "purchase")
