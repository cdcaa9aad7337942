"""Grading queries: documents edited by a marker paragraph and back; events as chains of trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import grading
from .base import LINES, query, table

_EDIT = f"""e AS (SELECT doc_id, p AS before, 'MARK-' || substr(md5('m' || doc_id), 1, 8) AS marker, doc_id % 5 AS mode FROM (SELECT doc_id, {LINES} AS p FROM documents)),
 t AS (SELECT *, CASE mode WHEN 0 THEN before || [marker] WHEN 1 THEN before || [marker, marker] WHEN 2 THEN before[2:] || [marker] WHEN 3 THEN before ELSE [marker || ' new'] || before END AS added,
  CASE mode WHEN 0 THEN before WHEN 1 THEN before || ['References'] WHEN 2 THEN before[2:] ELSE before END AS undone,
  CASE WHEN mode < 3 THEN before[2:] || before[1:1] ELSE before END AS moved,
  CASE WHEN len(before) = 0 THEN before WHEN mode < 3 THEN [before[1] || ' ' || marker] || before[2:] ELSE [before[1] || marker] || list_transform(before[2:], lambda x: x || ' ' || marker) END AS inlined FROM e)"""


def _lost(a: str, b: str) -> str:
    return f"len(list_filter({a}, lambda x: NOT list_contains({b}, x))) = 0"


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's paragraphs before an edit, and after edits that are right or wrong in ways its id decides."""
    docs = table(spark, sf_dir, "documents").select("doc_id", T.paragraphs(F.col("text")).alias("before"), F.concat(F.lit("MARK-"), F.substring(F.md5(F.concat(F.lit("m"), F.col("doc_id").cast("string"))), 1, 8)).alias("marker"), (F.col("doc_id") % 5).alias("mode"))
    before, marker, mode = F.col("before"), F.col("marker"), F.col("mode")
    tail = F.slice(before, 2, F.greatest(F.size(before), F.lit(1)))
    first = F.slice(before, 1, 1)
    one = F.array(marker)
    added = F.when(mode == 0, F.concat(before, one)).when(mode == 1, F.concat(before, one, one)).when(mode == 2, F.concat(tail, one)).when(mode == 3, before).otherwise(F.concat(F.array(F.concat(marker, F.lit(" new"))), before))
    undone = F.when(mode == 0, before).when(mode == 1, F.concat(before, F.array(F.lit("References")))).when(mode == 2, tail).otherwise(before)
    moved = F.when(mode < 3, F.concat(tail, first)).otherwise(before)
    head = F.get(before, F.lit(0))
    inlined = F.when(F.size(before) == 0, before).when(mode < 3, F.concat(F.array(F.concat(head, F.lit(" "), marker)), tail)).otherwise(F.concat(F.array(F.concat(head, marker)), F.transform(tail, lambda x: F.concat(x, F.lit(" "), marker))))
    return docs.select("doc_id", "before", "marker", "mode", added.alias("added"), undone.alias("undone"), moved.alias("moved"), inlined.alias("inlined"), head.alias("anchor"))


@query(f"""WITH {_EDIT}, c AS (SELECT doc_id, len(list_filter(added, lambda x: contains(x, marker))) = 1 AS once, {_lost('before', 'added')} AS none_lost, len(added) > len(before) AS grew FROM t)
 SELECT *, CASE WHEN once AND none_lost AND grew THEN 'pass' ELSE 'fail' END AS verdict FROM c""")
def grade_forward_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = grading.forward_add(F.col("before"), F.col("added"), F.col("marker"))
    return _trials(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in checks.items()], grading.verdict(checks).alias("verdict"))


@query(f"""WITH {_EDIT}, c AS (SELECT doc_id, len(list_filter(undone, lambda x: contains(x, marker))) = 0 AS gone, {_lost('before', 'undone')} AS none_lost, undone = before AS restored, len(list_filter(undone, lambda x: NOT list_contains(before, x))) AS n_unexpected FROM t)
 SELECT *, CASE WHEN gone AND none_lost AND restored THEN 'pass' ELSE 'fail' END AS verdict FROM c""")
def grade_inverse_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = F.col("before"), F.col("undone")
    checks = grading.inverse_add(before, after, F.col("marker"))
    return _trials(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in checks.items()], F.size(grading.unexpected(before, after)).cast("long").alias("n_unexpected"), grading.verdict(checks).alias("verdict"))


@query(f"""WITH {_EDIT}, c AS (SELECT doc_id, len(list_filter(inlined, lambda x: contains(x, marker) AND starts_with(x, substr(before[1], 1, 40)))) = 1 AS once, {_lost("list_filter(before, lambda y: y <> before[1])", 'inlined')} AS none_lost,
 len(list_filter(inlined, lambda x: contains(x, marker))) = len(list_filter(inlined, lambda x: contains(x, marker) AND starts_with(x, substr(before[1], 1, 40)))) AS not_leaked, len(inlined) = len(before) AS same_count FROM t)
 SELECT *, CASE WHEN once AND none_lost AND not_leaked AND same_count THEN 'pass' ELSE 'fail' END AS verdict FROM c""")
def grade_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = grading.forward_inline(F.col("before"), F.col("inlined"), F.col("marker"), F.col("anchor"))
    return _trials(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in checks.items()], grading.verdict(checks).alias("verdict"))


@query(f"""WITH {_EDIT}, c AS (SELECT doc_id, list_sort(moved) = list_sort(before) AS same_paragraphs, moved <> before AS moved, list_contains(moved, trim(before[1])) AS heading_kept FROM t)
 SELECT *, CASE WHEN same_paragraphs AND moved AND heading_kept THEN 'pass' ELSE 'fail' END AS verdict FROM c""")
def grade_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = grading.forward_reorder(F.col("before"), F.col("moved"), F.col("anchor"))
    return _trials(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in checks.items()], grading.verdict(checks).alias("verdict"))


@query(f"""WITH {_EDIT}, c AS (SELECT doc_id, len(list_filter(added, lambda x: contains(x, marker))) = 1 AND {_lost('before', 'added')} AS fwd, len(list_filter(undone, lambda x: contains(x, marker))) = 0 AND undone = before AND {_lost('before', 'undone')} AS inv FROM t)
 SELECT doc_id, CASE WHEN fwd THEN 'pass' ELSE 'fail' END AS forward, CASE WHEN inv THEN 'pass' ELSE 'fail' END AS inverse FROM c""")
def grade_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, marker = F.col("before"), F.col("marker")
    return _trials(spark, sf_dir).select("doc_id", grading.verdict(grading.forward_table(before, F.col("added"), marker)).alias("forward"), grading.verdict(grading.inverse_table(before, F.col("undone"), marker)).alias("inverse"))


@query(f"""WITH {_EDIT}, q AS (SELECT *, list_filter(added, lambda x: contains(x, 'MARK')) AS eq FROM t),
 c AS (SELECT doc_id, len(list_filter(eq, lambda x: contains(x, marker))) = 1 AND {_lost('before', 'added')} AS fwd, len(list_filter(eq, lambda x: contains(x, marker))) = 0 AND undone = before AND {_lost('before', 'undone')} AS inv FROM q)
 SELECT doc_id, CASE WHEN fwd THEN 'pass' ELSE 'fail' END AS forward, CASE WHEN inv THEN 'pass' ELSE 'fail' END AS inverse FROM c""")
def grade_equation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs with a marker stand in for the flat texts of equations."""
    before, marker = F.col("before"), F.col("marker")
    equations = grading.holding(F.col("added"), F.lit("MARK"))
    return _trials(spark, sf_dir).select("doc_id", grading.verdict(grading.forward_equation(before, F.col("added"), marker, equations)).alias("forward"), grading.verdict(grading.inverse_equation(before, F.col("undone"), marker, equations)).alias("inverse"))


@query(f"""WITH {_EDIT}, c AS (SELECT doc_id, len(list_filter(restored, lambda x: contains(x, marker))) = 0 AS gone, {_lost('before', 'restored')} AS none_lost, len(restored) = len(before) AS same_count
  FROM (SELECT *, CASE WHEN mode IN (0, 3) THEN before WHEN mode = 1 THEN inlined ELSE before || ['more'] END AS restored FROM t))
 SELECT *, CASE WHEN gone AND none_lost AND same_count THEN 'pass' ELSE 'fail' END AS verdict FROM c""")
def grade_inline_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inline edit taken back, left in place, or taken back with a paragraph too many."""
    mode, before = F.col("mode"), F.col("before")
    restored = F.when(mode.isin(0, 3), before).when(mode == 1, F.col("inlined")).otherwise(F.concat(before, F.array(F.lit("more"))))
    checks = grading.inverse_inline(before, restored, F.col("marker"))
    return _trials(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in checks.items()], grading.verdict(checks).alias("verdict"))


@query(f"""WITH {_EDIT} SELECT doc_id, (CASE WHEN mode % 2 = 0 THEN before ELSE moved END) = before AS restored, CASE WHEN (CASE WHEN mode % 2 = 0 THEN before ELSE moved END) = before THEN 'pass' ELSE 'fail' END AS verdict FROM t""")
def grade_reorder_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = F.when(F.col("mode") % 2 == 0, F.col("before")).otherwise(F.col("moved"))
    checks = grading.inverse_reorder(F.col("before"), back)
    return _trials(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in checks.items()], grading.verdict(checks).alias("verdict"))


_FAMILIES = ("bibliography", "caption", "citation", "section_reorder", "equation", "table_structural")


@query(f"""WITH {_EDIT}, f AS (SELECT *, ['{"', '".join(_FAMILIES)}'][doc_id % 6 + 1] AS family, list_filter(added, lambda x: contains(x, 'MARK')) AS eq FROM t),
 c AS (SELECT doc_id, family, coalesce(CASE family WHEN 'citation' THEN len(list_filter(inlined, lambda x: contains(x, marker) AND starts_with(x, substr(before[1], 1, 40)))) = 1 AND {_lost("list_filter(before, lambda y: y <> before[1])", 'inlined')}
   AND len(list_filter(inlined, lambda x: contains(x, marker))) = len(list_filter(inlined, lambda x: contains(x, marker) AND starts_with(x, substr(before[1], 1, 40)))) AND len(inlined) = len(before)
  WHEN 'section_reorder' THEN list_sort(moved) = list_sort(before) AND moved <> before AND list_contains(moved, trim(before[1]))
  ELSE len(list_filter(added, lambda x: contains(x, marker))) = 1 AND {_lost('before', 'added')} AND (family IN ('equation', 'table_structural') OR len(added) > len(before)) END, false) AS fwd,
  coalesce(CASE family WHEN 'citation' THEN len(list_filter(undone, lambda x: contains(x, marker))) = 0 AND {_lost('before', 'undone')} AND len(undone) = len(before) WHEN 'section_reorder' THEN undone = before
  WHEN 'equation' THEN len(list_filter(eq, lambda x: contains(x, marker))) = 0 AND undone = before ELSE len(list_filter(undone, lambda x: contains(x, marker))) = 0 AND undone = before END, false) AS inv FROM f)
 SELECT family, CASE WHEN fwd THEN 'pass' ELSE 'fail' END AS forward, CASE WHEN inv THEN 'pass' ELSE 'fail' END AS inverse, count(*) AS trials FROM c GROUP BY ALL""")
def grade_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six families by the document's id, forward and back."""
    at, before, marker = F.col("doc_id") % 6, F.col("before"), F.col("marker")
    family = F.element_at(F.array(*[F.lit(f) for f in _FAMILIES]), (at + 1).cast("int"))
    trials = _trials(spark, sf_dir).withColumn("family", family)
    after = F.when(F.col("family") == "citation", F.col("inlined")).when(F.col("family") == "section_reorder", F.col("moved")).otherwise(F.col("added"))
    equations = grading.holding(F.col("added"), F.lit("MARK"))
    side = lambda to, forward: grading.dispatch(F.col("family"), grading.graders(before, to, marker, F.col("anchor"), equations, forward))
    return trials.select("family", side(after, True).alias("forward"), side(F.col("undone"), False).alias("inverse")).groupBy("family", "forward", "inverse").agg(F.count(F.lit(1)).alias("trials"))


@query("""WITH e AS (SELECT user_id, event_type <> 'signup' AS readable, event_type <> 'error' AND value >= 2 AS good, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 s AS (SELECT user_id, min(k) FILTER (NOT readable) AS stop, max(k) AS n FROM e GROUP BY user_id),
 g AS (SELECT e.user_id, stop, n, count(*) FILTER (k < coalesce(stop, n + 1)) AS n_graded, bool_or(NOT good AND k < coalesce(stop, n + 1)) AS failed, coalesce(bool_or(good AND k = n), false) AS last_good FROM e JOIN s ON s.user_id = e.user_id GROUP BY 1, 2, 3)
 SELECT user_id, CASE WHEN stop IS NOT NULL THEN 'blocked' WHEN failed THEN 'completed_with_failure' ELSE 'completed' END AS status, n_graded, stop IS NULL AND last_good AS restored FROM g""")
def chain_status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events in order as the pairs of a chain: a signup is unreadable, an error or a low value fails."""
    kind = F.col("event_type")
    pair = F.struct("ts", "event_id", (kind != "signup").alias("readable"), F.when(kind != "error", "pass").otherwise("fail").alias("fwd"), F.when(F.col("value") >= 2, "pass").otherwise("fail").alias("inv"))
    chains = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
    return chains.select("user_id", grading.chain_status(F.col("pairs")).alias("s")).select("user_id", "s.*")


@query("""SELECT event_type, (event_type <> 'error') OR (value > 10 AND value > 20) AS completed, count(*) AS trials FROM events GROUP BY ALL""")
def recovery_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    done = grading.task_completed(F.when(F.col("event_type") == "error", 1).otherwise(0), F.lit(False), F.col("value") > 10, F.when(F.col("value") > 20, "pass").otherwise("fail"))
    return events.select("event_type", done.alias("completed")).groupBy("event_type", "completed").agg(F.count(F.lit(1)).alias("trials"))
