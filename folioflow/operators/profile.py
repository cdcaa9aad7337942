"""Evidence tables and modal domain profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["category", "node", "part"]
#: allowed values (fixed values)
AUTHORITIES = ("observed", "inferred", "template", "domain_family", "abstain")
STATUSES = ("resolved", "mixed", "unknown")


def evidence(docs: DataFrame, doc: str, facts: dict[tuple[str, str, str], Column]) -> DataFrame:
    """Long form: a row for each document and fact; a null fact is `unknown`."""
    rows = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(n).alias("node"), F.lit(p).alias("part"), v.cast("string").alias("value_json")) for (c, n, p), v in facts.items()])
    long = docs.select(doc, F.inline_outer(rows))
    return long.withColumn("status", F.when(F.col("value_json").isNull(), "unknown").otherwise("resolved"))


def presence(long: DataFrame, doc: str, categories: list[str]) -> DataFrame:
    """Per document whether a category has any telling value."""
    telling = F.col("value_json").isNotNull() & ~F.col("value_json").isin("{}", "[]", "0", "false", "null", "") & (F.col("status") != "unknown")
    return long.groupBy(doc).agg(*[F.coalesce(F.bool_or(telling & (F.col("category") == c)), F.lit(False)).alias(c) for c in categories])


def profile_hash(long: DataFrame, doc: str) -> DataFrame:
    """A hash of all evidence of a document that does not depend on the order of rows."""
    entries = F.array_sort(F.collect_list(F.concat_ws("|", *KEY, F.coalesce("value_json", F.lit("null")))))
    return long.groupBy(doc).agg(F.sha2(F.array_join(entries, "\n"), 256).alias("profile_hash"))


def modal(long: DataFrame, groups: list[str], least: int = 3, threshold: float = 0.6) -> DataFrame:
    """Per key the most frequent value, its agreement, and whether it resolves; ties go to the smaller value."""
    known = long.where((F.col("status") != "unknown") & F.col("value_json").isNotNull())
    counts = known.groupBy(*groups, *KEY, "value_json").agg(F.count(F.lit(1)).alias("n"))
    # two partial aggregates instead of a window over all values of a key
    top = counts.groupBy(*groups, *KEY).agg(F.min_by("value_json", F.struct((-F.col("n")).alias("m"), "value_json")).alias("mode"), F.max("n").alias("top"), F.sum("n").alias("sample_size"), F.count(F.lit(1)).alias("n_values"))
    agreement = F.col("top") / F.col("sample_size")
    resolved = (F.col("sample_size") >= least) & (agreement >= threshold)
    return top.select(
        *groups,
        *KEY,
        "mode",
        F.round(agreement, 6).alias("agreement"),
        "sample_size",
        (F.col("n_values") - 1).alias("n_conflicts"),
        F.when(resolved & (F.col("n_values") == 1), "resolved").when(resolved, "mixed").otherwise("unknown").alias("status"),
        F.when(resolved, "domain_family").otherwise("abstain").alias("authority"),
    )


def resolution(profile: DataFrame, groups: list[str]) -> DataFrame:
    """How many nodes of a domain resolve."""
    done = F.count_if(F.col("authority") == "domain_family")
    return profile.groupBy(*groups).agg(done.alias("resolved_nodes"), F.count(F.lit(1)).alias("nodes"), F.when(done > 0, "domain_family").otherwise("abstain").alias("level"))


def match_templates(long: DataFrame, templates: DataFrame, doc: str) -> DataFrame:
    """(doc, template): the first template, by rank, all of whose values a document has.  Division as counts: matched
    values of a template against its size.  `templates` has template, rank, category, node, value_json."""
    size = templates.groupBy("template").agg(F.count(F.lit(1)).alias("size"))
    own = long.select(doc, "category", "node", F.col("value_json").alias("own"))
    hits = own.join((templates), ["category", "node"]).where(F.col("own").eqNullSafe(F.col("value_json")))
    full = hits.groupBy(doc, "template", "rank").agg(F.count(F.lit(1)).alias("n")).join((size), "template").where(F.col("n") == F.col("size"))
    best = full.groupBy(doc).agg(F.min_by("template", F.struct("rank", "template")).alias("template"))
    return long.select(doc).distinct().join(best, doc, "left")


def profile_digest(long: DataFrame, doc: str, columns: list[str]) -> DataFrame:
    """(doc, n, sum_1, sum_2): a digest of a document's rows that needs no order, as sums of two hashes of 60 bits.
    Sums combine on the mappers and repeated rows count, where the sorted list of `profile_hash` gathers a document."""
    row = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]))
    half = lambda at: F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return long.groupBy(doc).agg(F.count(F.lit(1)).alias("n"), half(1).alias("sum_1"), half(16).alias("sum_2"))


def determinism(first: DataFrame, second: DataFrame, doc: str, columns: list[str]) -> DataFrame:
    """(doc, by_list, by_sums) of every document of two runs, given as long rows: do they agree, told by two routes
    that share nothing, the hash of the sorted rows and the sums of their hashes.  A document of one run alone agrees
    by neither."""
    facts = lambda rows, k: profile_hash(rows, doc).join(profile_digest(rows, doc, columns), doc).toDF(doc, f"h{k}", f"n{k}", f"a{k}", f"b{k}")
    both = facts(first, 1).join(facts(second, 2), doc, "full")
    same = lambda c: F.col(f"{c}1").eqNullSafe(F.col(f"{c}2"))
    return both.select(doc, same("h").alias("by_list"), (same("n") & same("a") & same("b")).alias("by_sums"))


def last_rows(log: DataFrame, key: str, seq: str) -> DataFrame:
    """Of an append log, the last row of each key."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(key, "r.*")


def row_rank(order: list[str], by: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))
