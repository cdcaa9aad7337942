"""Samples, splits, slices and the metadata funnel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import Tables
from ..operators import sampling
from .base import query, table

FRACTIONS = {"development": 0.6, "validation": 0.2, "primary_holdout": 0.2}
SEED = "20260831"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("type"), F.col("lang").alias("topic"), "n_chars")


_TYPES = {"src0": 200, "src1": 125, "src2": 100, "src3": 75}
_RANK = "row_number() OVER (PARTITION BY {} ORDER BY md5(concat_ws('|', '" + SEED + "', id::VARCHAR)), id)"


@query(f"""SELECT id, stratum, rn FROM (SELECT doc_id AS id, source AS stratum, {_RANK.format('source')} AS rn FROM (SELECT *, doc_id AS id FROM documents))
 WHERE rn <= CASE stratum WHEN 'src0' THEN 200 WHEN 'src1' THEN 125 WHEN 'src2' THEN 100 WHEN 'src3' THEN 75 ELSE 0 END""")
def quota_sample_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.quota_sample(_docs(spark, sf_dir), F.col("type"), _TYPES, SEED).select("id", "stratum", F.col("rn").cast("long").alias("rn"))


@query(f"SELECT id, stratum, rn FROM (SELECT doc_id AS id, coalesce(lang, 'unknown') AS stratum, {_RANK.format('lang')} AS rn FROM (SELECT *, doc_id AS id FROM documents)) WHERE rn <= 50")
def quota_sample_by_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.quota_sample(_docs(spark, sf_dir), F.col("topic"), 50, SEED).select("id", "stratum", F.col("rn").cast("long").alias("rn"))


@query(f"""WITH d AS (SELECT doc_id AS id, lang FROM documents ANTI JOIN labels USING (doc_id))
 SELECT stratum, count(*) AS sampled, any_value(pool) AS pool FROM (SELECT coalesce(lang, 'unknown') AS stratum, {_RANK.format('lang')} AS rn, count(*) OVER (PARTITION BY lang) AS pool FROM d) WHERE rn <= 50 GROUP BY stratum""")
def sample_excluding_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotas applied after documents of an earlier manifest (here: all labelled ones) are left out."""
    pool = sampling.exclude_prior(_docs(spark, sf_dir), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))
    taken = sampling.quota_sample(pool, F.col("topic"), 50, SEED).groupBy("stratum").agg(F.count(F.lit(1)).alias("sampled"))
    sizes = pool.groupBy(F.coalesce("topic", F.lit("unknown")).alias("stratum")).agg(F.count(F.lit(1)).alias("pool"))
    return taken.join(sizes, "stratum")


@query("""SELECT count(*) AS scanned, count(*) FILTER (lang = 'en') AS language_ok, count(*) FILTER (lang = 'en' AND source IN ('src0', 'src1', 'src2', 'src3')) AS type_ok,
 count(*) FILTER (lang = 'en' AND source IN ('src0', 'src1', 'src2', 'src3') AND n_chars BETWEEN 200 AND 5000) AS kept FROM documents""")
def metadata_prefilter_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each filter of the metadata screen leaves."""
    language, kind, size = F.col("topic") == "en", F.col("type").isin(list(_TYPES)), F.col("n_chars").between(200, 5000)
    return _docs(spark, sf_dir).agg(F.count(F.lit(1)).alias("scanned"), F.count_if(language).alias("language_ok"), F.count_if(language & kind).alias("type_ok"), F.count_if(language & kind & size).alias("kept"))


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND n_chars BETWEEN 200 AND 5000 AND source NOT IN ('src0')")
def metadata_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "lang")
    return docs.where((F.col("lang") == "en") & F.col("n_chars").between(200, 5000) & ~F.col("source").isin("src0")).drop("lang")


_LETTERS = "length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(text)"


@query(rf"""SELECT doc_id, source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM documents WHERE lang = 'en' AND source IN ('src0', 'src1', 'src2', 'src3') AND NOT contains(source, '+') AND length(text) > 0
 AND {_LETTERS} > 0.75 AND len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) BETWEEN 200 AND 5000""")
def metadata_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata screen with all of its predicates: language, type (no compound ones), words, and a confidence, for
    which the share of letters stands in.  Those on columns are pushed to the scan, before any text is looked at."""
    docs = table(spark, sf_dir, "documents").where((F.col("lang") == "en") & F.col("source").isin(list(_TYPES)) & ~F.contains("source", F.lit("+")))
    confidence = F.length(F.regexp_replace("text", "[^A-Za-z]", "")) / F.length("text")
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.where((F.length("text") > 0) & (confidence > 0.75)).select("doc_id", "source", words.alias("words")).where(F.col("words").between(200, 5000))


@query("""WITH p AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'validation' WHEN 1 THEN 'primary_holdout' ELSE 'development' END AS split FROM labels UNION ALL SELECT doc_id + 1000000, 'validation' FROM labels WHERE doc_id % 10 = 3),
 d AS (SELECT doc_id, n_chars FROM documents), m AS (SELECT split, p.doc_id, CASE WHEN d.doc_id IS NULL THEN 'no_document' WHEN n_chars < 200 THEN 'too_short' END AS reason FROM p LEFT JOIN d USING (doc_id))
 SELECT split, doc_id, reason, count(*) OVER (PARTITION BY split) AS missing, planned FROM m JOIN (SELECT split, count(*) AS planned FROM p GROUP BY split) USING (split) WHERE reason IS NOT NULL""")
def split_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a split manifest plans and the corpus cannot give, with the reason, beside the totals of the split."""
    split = F.when(F.col("doc_id") % 5 == 0, "validation").when(F.col("doc_id") % 5 == 1, "primary_holdout").otherwise("development")
    labels = table(spark, sf_dir, "labels").select("doc_id")
    planned = labels.select("doc_id", split.alias("split")).unionByName(labels.where(F.col("doc_id") % 10 == 3).select(F.col("doc_id") + 1000000, F.lit("validation")).toDF("doc_id", "split"))
    return sampling.gaps(planned, table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", F.when(F.col("n_chars") < 200, "too_short"))


def _families(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.concat_ws("/", "source", "lang").alias("family")).agg(F.count(F.lit(1)).alias("size"))


_SPLIT = f"""WITH RECURSIVE f AS (SELECT concat_ws('/', source, lang) AS family, count(*) AS size FROM documents GROUP BY 1),
 o AS (SELECT family, size, row_number() OVER (ORDER BY size DESC, md5(concat_ws('|', '{SEED}', family)), family) AS k FROM f),
 t AS (SELECT sum(size)::DOUBLE AS t FROM f),
 g(k, family, size, split, a, b, c) AS (SELECT 0::BIGINT, NULL::VARCHAR, 0::BIGINT, NULL::VARCHAR, t * 0.6::DOUBLE, t * 0.2::DOUBLE, t * 0.2::DOUBLE FROM t
  UNION ALL SELECT o.k, o.family, o.size, CASE greatest(a, b, c) WHEN a THEN 'development' WHEN b THEN 'validation' ELSE 'primary_holdout' END,
   a - CASE WHEN greatest(a, b, c) = a THEN o.size ELSE 0 END, b - CASE WHEN greatest(a, b, c) = b AND a <> b THEN o.size ELSE 0 END, c - CASE WHEN greatest(a, b, c) = c AND a <> c AND b <> c THEN o.size ELSE 0 END
  FROM g JOIN o ON o.k = g.k + 1),
 assigned AS (SELECT family, size, split FROM g WHERE k > 0)"""


@query(f"{_SPLIT} SELECT * FROM assigned")
def group_split_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.group_split(Tables(spark), _families(spark, sf_dir), FRACTIONS, SEED)


@query(f"""{_SPLIT} SELECT split, sum(size)::BIGINT AS size, count(*) AS families, CASE split WHEN 'development' THEN 0.6::DOUBLE ELSE 0.2::DOUBLE END AS requested,
 round(sum(size) / (SELECT sum(size) FROM assigned), 6) AS achieved FROM assigned GROUP BY split""")
def group_split_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split_fractions(sampling.group_split(Tables(spark), _families(spark, sf_dir), FRACTIONS, SEED), FRACTIONS)


@query(f"""SELECT id, position, CASE WHEN position <= 10 THEN 'smoke' WHEN position <= 40 THEN 'scale_up' ELSE 'final' END AS stage
 FROM (SELECT doc_id AS id, row_number() OVER (ORDER BY md5(concat_ws('|', '{SEED}', doc_id::VARCHAR)), doc_id) AS position FROM documents) WHERE position <= 127""")
def staged_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.staged_slices(_docs(spark, sf_dir), "id", SEED, {"smoke": 10, "scale_up": 30, "final": 87})


@query("""SELECT CASE WHEN quality IS NULL THEN 'context' WHEN toxic = 1 THEN 'quarantine' WHEN quality = 0 THEN 'rejected' WHEN source = 'src0' THEN 'exposed' WHEN n_chars < 1000 THEN 'clean_holdout' ELSE 'development' END AS lane, count(*) AS documents
 FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def lane_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.audit import cascade

    joined = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    lane = cascade((F.col("quality").isNull(), "context"), (F.col("toxic") == 1, "quarantine"), (F.col("quality") == 0, "rejected"), (F.col("source") == "src0", "exposed"), (F.col("n_chars") < 1000, "clean_holdout"), default="development")
    return joined.groupBy(lane.alias("lane")).agg(F.count(F.lit(1)).alias("documents"))


@query("SELECT coalesce(quality = 1, false) AS promoted, count(*) AS documents FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def promote_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promoted documents and their complement, which keeps documents without a verdict."""
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy(F.col("quality").eqNullSafe(F.lit(1)).alias("promoted")).agg(F.count(F.lit(1)).alias("documents"))


@query("SELECT event_type, count(*) AS requested, count(*) FILTER (value > 3) AS ok, count(*) - count(*) FILTER (value > 3) AS failed FROM events GROUP BY event_type")
def fetch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("event_type", F.when(F.col("value") > 3, "ok").alias("status"))
    return sampling.fetch_summary(log, "event_type")


_SLICE = "CASE WHEN source IN ('src0', 'src1') THEN 'final' WHEN source = 'src2' THEN 'smoke' WHEN source = 'src3' THEN 'scale_up' ELSE 'unused' END"


def _sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.col("source")
    name = F.when(source.isin("src0", "src1"), "final").when(source == "src2", "smoke").when(source == "src3", "scale_up").otherwise("unused")
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("slice"))


@query(f"SELECT doc_id, slice, CASE slice WHEN 'smoke' THEN 1 WHEN 'scale_up' THEN 2 ELSE 3 END::BIGINT AS slice_rank FROM (SELECT doc_id, {_SLICE} AS slice FROM documents) WHERE slice <> 'unused'")
def slice_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`all` stands for every slice in its order; what is in none is left out."""
    return sampling.resolve_slices(_sliced(spark, sf_dir), "all", ["smoke", "scale_up", "final"])


@query(f"""SELECT doc_id, slice, CASE WHEN k <= 25 THEN 'run' ELSE 'not_run' END AS status, CASE WHEN k > 25 THEN 'outside the sample' END AS reason FROM (SELECT doc_id, slice, row_number() OVER (ORDER BY doc_id) AS k FROM (SELECT doc_id, {_SLICE} AS slice FROM documents))""")
def first_n_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expensive check for the first 25 documents; all others are reported as not run."""
    return sampling.first_checked(_sliced(spark, sf_dir), ["doc_id"], 25)
