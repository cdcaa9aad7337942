"""URL filters as a temporal list join.

List entries are dated: (domain, listed_at, action), action 'block' or 'allow'; an entry holds for a domain and its
subdomains from its date until the domain's next entry.  Each capture is judged by the entry that was active at its
fetch time, of the most specific domain that has one.

The as-of join is one pass: questions (host and time, once each, for the host and each parent domain) and entries are
sorted together by domain and time, and the last entry is carried along.  So a domain with many entries and captures
costs their sum.  Only hosts and times move, never pages; a popular domain's questions are dealt to salts, to each of
which its entries go.

Rows with null or unparsable URLs, or null fetch times, have a null host or time and are `allow` with no
entry.  Entries with null domain or date are void; of entries of one domain and date `block` wins.  IP addresses
have no parent domains.  Rows that repeat a page_id are judged each; URLs of any length are read whole.  Without
captures there are no rows, without entries all are `allow`.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, meet

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]]+)"
#: parts of a popular domain's questions
SALTS = 16


def host(url: str) -> Column:
    """Lower-cased host of an absolute URL, without credentials and port; null if there is none."""
    found = F.lower(F.regexp_extract(F.col(url), HOST, 1))
    return F.when(found != "", found)


def suffixes(name: str) -> Column:
    """The host and its parent domains that have at least two labels, most specific first, with their label count."""
    labels = F.split(F.col(name), r"\.")
    n = F.size(labels)
    starts = F.when((n >= 2) & ~F.col(name).rlike(r"^[0-9.]+$|^\["), F.sequence(F.lit(0), n - 2)).otherwise(F.array(F.lit(0)))
    return F.transform(starts, lambda i: F.struct(F.array_join(F.slice(labels, i + 1, n), ".").alias("domain"), (n - i).alias("depth")))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, host, fetched_at, domain, valid_from, action) for each capture (page_id, url, fetched_at)."""
    scratch = Scratch(captures.sparkSession)
    own = captures.select("page_id", "fetched_at", host("url").alias("host"))
    listed = entries.where(F.col("domain").isNotNull() & F.col("listed_at").isNotNull()).groupBy(F.lower("domain").alias("domain"), F.col("listed_at").alias("at")).agg(F.max("action").alias("action"))
    listed = listed.select("domain", "at", F.lit(0).alias("asks"), F.struct(F.col("at").alias("valid_from"), "action").alias("entry"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    asked = own.where(F.col("host").isNotNull() & F.col("fetched_at").isNotNull()).select("host", F.col("fetched_at").alias("at")).distinct()
    asked = asked.select("host", "at", F.inline_outer(suffixes("host")), F.pmod(F.xxhash64("host", "at"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(1).alias("asks"))
    # an entry of the day itself is in force, so entries come before questions of a time
    past = Window.partitionBy("domain", "salt").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = listed.unionByName(asked, allowMissingColumns=True).withColumn("entry", F.last("entry", ignorenulls=True).over(past))
    hits = both.where((F.col("asks") == 1) & F.col("entry").isNotNull())
    best = hits.groupBy("host", F.col("at").alias("fetched_at")).agg(F.max_by(F.struct("domain", "entry.valid_from", "entry.action"), "depth").alias("hit"))
    best = scratch.save(best, "best")
    out = meet(own, best, ["host", "fetched_at"], "page_id", 2 * F.length("host") + 16, "left")
    return out.select("page_id", "host", "fetched_at", F.col("hit.domain").alias("domain"), F.col("hit.valid_from").alias("valid_from"), F.coalesce("hit.action", F.lit("allow")).alias("action"))
