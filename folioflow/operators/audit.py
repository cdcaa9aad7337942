"""Issue ledgers, gates, reference checks, snapshots, retries, cascades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def issues(facts: DataFrame, key: str, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(key, kind, detail) for each rule that a row breaks; one scan, no join, whatever the number of rules."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))) for kind, (broken, detail) in rules.items()]))
    return facts.select(key, F.inline_outer(found)).where(F.col("kind").isNotNull())


def errors(rules: dict[str, Column]) -> Column:
    """Names of all rules that a row breaks, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules.items()]))


def gate(checks: DataFrame) -> DataFrame:
    """One row: a gate passes when no blocking check failed."""
    failed = F.count_if(~F.col("passed"))
    blocked = F.count_if(F.col("blocking") & ~F.col("passed"))
    return checks.agg(F.count(F.lit(1)).alias("checks"), failed.alias("failed"), blocked.alias("blocking_failures"), (blocked == 0).alias("gate_passed"))


def preflight(checks: DataFrame, by: list[str], order: str = "position") -> DataFrame:
    """`checks` with a `state` for each: `passed`, `failed`, or `skipped` behind the first blocking failure of its
    document (or whatever `by` names).  A check without a verdict has failed."""
    passed = F.coalesce(F.col("passed"), F.lit(False))
    stops = F.max((F.coalesce(F.col("blocking"), F.lit(False)) & ~passed).cast("int"))
    before = stops.over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return checks.withColumn("state", F.when(before == 1, "skipped").when(passed, "passed").otherwise("failed"))


def approved(artifact: Column, digest: Column) -> Column:
    """Fails closed: only an approval that names this very digest counts."""
    return F.coalesce((artifact["approved"] == True) & (artifact["sha256"] == digest), F.lit(False))  # noqa: E712


def dangling(cited: DataFrame, defined: DataFrame, key: str) -> DataFrame:
    """Cited but not defined, and defined but not cited."""
    c, d = cited.select(key).distinct(), defined.select(key).distinct()
    return c.join(d, key, "left_anti").select(F.lit("dangling").alias("kind"), key).unionByName(d.join(c, key, "left_anti").select(F.lit("unused").alias("kind"), key))


def retries(failed: DataFrame, attempts: DataFrame, key: str, order: str, success: Column) -> DataFrame:
    """What followed each failure, apart from the figures of the first run.  `failed` has key and `failed`."""
    later = attempts.withColumn("ok", success).select(key, order, "ok")
    joined = failed.join(later, key, "left")
    after = F.coalesce(F.col(order) > F.col("failed"), F.lit(False))
    return joined.groupBy(key, "failed").agg(F.count_if(after).alias("retries"), (F.count_if(after & F.col("ok")) > 0).alias("recovered"))


def changed_fields(before: Column, after: Column, fields: list[str]) -> Column:
    """Names of the fields whose values differ, null-safely."""
    return F.array_compact(F.array(*[F.when(~before[f].eqNullSafe(after[f]), F.lit(f)) for f in fields]))


def cascade(*cases: tuple[Column, str], default: str) -> Column:
    """The first case that holds; null conditions do not."""
    out = F.lit(default)
    for condition, name in reversed(cases):
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def foreign_names(text: Column, pattern: str, allowed: list[str]) -> Column:
    """Distinct names that a pattern's first group finds, without the allowed ones, sorted."""
    return F.array_sort(F.array_except(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))), F.array(*[F.lit(a) for a in allowed])))


def remap(key: Column, hint: Column, pattern: str) -> tuple[Column, Column]:
    """A key replaced by the one its hint names, and the hint without that name."""
    found = F.regexp_extract(hint, pattern, 1)
    return F.when(found != "", found).otherwise(key), F.trim(F.regexp_replace(hint, pattern, ""))


def provenance(dirty: Column, pinned: Column) -> Column:
    return F.when(F.coalesce(~dirty & pinned, F.lit(False)), "clean").otherwise("degraded")


def structure_regressions(counts: DataFrame, item: str, variant: str, baseline: str, columns: list[str]) -> DataFrame:
    """Variants of an item whose structural counts differ from the baseline's."""
    base = counts.where(F.col(variant) == baseline).select(item, F.struct(*columns).alias("base"))
    other = counts.where(F.col(variant) != baseline).select(item, variant, F.struct(*columns).alias("own"))
    return other.join(base, item).select(item, variant, changed_fields(F.col("base"), F.col("own"), columns).alias("changed")).where(F.size("changed") > 0)


#: name heads of items that were written by hand (fixed values)
HAND_AUTHORED = ("fixture-", "composite-")
#: what a result says when its tools were missing (fixed values)
FLAKES = ("doesn't exist in my toolset", "isn't loaded in this session", "no way to modify or save")


def hand_authored(name: Column) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [F.startswith(name, F.lit(h)) for h in HAND_AUTHORED]), F.lit(False))


def flake(arm: Column, changed: Column, result: Column) -> Column:
    """A treatment that changed nothing and says that its tools were missing."""
    said = reduce(lambda a, b: a | b, [F.contains(result, F.lit(p)) for p in FLAKES])
    return F.coalesce((arm == "treatment") & ~F.coalesce(changed, F.lit(False)) & said, F.lit(False))


def orphans(before: Column, after: Column, owned: Column) -> dict[str, Column]:
    """Set differences of process ids around a run, and what became of the process that it owned (states: fixed values)."""
    new = F.array_sort(F.array_except(after, before))
    running = F.coalesce(F.array_contains(after, owned), F.lit(False))
    return {
        "new_pids": new,
        "untouched_pids": F.array_sort(F.array_intersect(before, after)),
        "status": F.when(running, "orphan_still_running").when(F.size(new) > 0, "unattributed_new_process").otherwise("clean_no_new_word_process"),
        "orphan_pids": F.when(running, F.array(owned)).when(F.size(new) > 0, new).otherwise(F.array().cast("array<long>")),
    }
