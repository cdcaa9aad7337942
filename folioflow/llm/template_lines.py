"""Line dedup with a log-template tree.  DataFrame functions only.

Lines are trimmed and parsed into a tree of fixed depth: token count (pieces between single blanks), then the `depth`
leading tokens, tokens with a digit standing as `<*>`.  A leaf is frequent when its lines stand in documents at least
`min_docs` times (a line counts once for a document).  Within a frequent leaf a token is fixed at its position when
lines of at least `min_docs` documents have it there; all others are variable fields and become `<*>`.  The line with
its variable fields generalised is its template.  A line is common when it has a frequent leaf and at least `fixed` of
its tokens are fixed; short lines are judged like all others.

A template is dropped when it recurs across documents, of which those with the same lines count as one: when at least
`min_docs` of them speak, and they are half or more of all that have it.  A document speaks when lines that are not
common make up at least `own` of the tokens of its distinct lines.  Copies, exact or edited, consist for the most part
of lines that recur with them; few of them speak, and whole copies stay for the near-dedup that judges documents.  A
notice of any number of lines speaks against itself in every text that it was pasted into.

All lines of dropped templates go, from documents that do not speak too.  Blank lines are never dropped.  Null texts
stay null with 0 lines; an empty text is one empty line.  Rows with a null id pass through and count for nothing.  Rows
that repeat an id and text are one document, but count for each row where frequent leaves and tokens are told.  Lines
and texts of any length are taken whole.  An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, meet

#: from a digit to the end of its token
DIGIT = r"[0-9][^\x09-\x0D ]*"
BLANKS = " \t\r\x0b\x0c"


def masked(text: Column) -> Column:
    """Trimmed lines of a text with tokens that hold a digit as `<*>`."""
    # what follows a token's first digit goes first, then, read backwards, what stands before it: a pattern that begins
    # with the digit passes over all other text at once, one that begins with the token tries every character
    marked = F.reverse(F.regexp_replace(F.reverse(F.regexp_replace(text, DIGIT, "0")), DIGIT, ">*<"))
    generalised = F.when(text.rlike("[0-9]"), marked).otherwise(text)
    return F.transform(F.split(generalised, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))


def _tokens(line: str) -> Column:
    """How many tokens a line has, or the lines of a text that blanks separate."""
    return F.octet_length(line) - F.octet_length(F.replace(F.col(line), F.lit(" "))) + 1


def _leaf(line: str, depth: int) -> Column:
    return F.xxhash64(_tokens(line), F.substring_index(line, " ", depth))


def common_lines(docs: DataFrame, scratch: Scratch, depth: int, min_docs: int, fixed: float) -> tuple[DataFrame, DataFrame]:
    """(places, templates): of every document (doc_id, _t a hash of its text) the lines of frequent leaves with the
    tokens and a hash of all its distinct lines, and (line, t, template) of the common lines."""
    found = docs.select("doc_id", F.xxhash64("text").alias("_t"), F.array_distinct(masked(F.col("text"))).alias("ls"))
    found = found.withColumn("ls", F.array_remove("ls", "")).withColumn("joined", F.array_join("ls", " "))
    lines = found.select("doc_id", "_t", _tokens("joined").alias("total"), F.xxhash64("joined").alias("same"), F.explode("ls").alias("line")).withColumn("leaf", _leaf("line", depth))
    leaves = scratch.save(lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("leaf"), "leaves")
    places = scratch.save(meet(lines, leaves, "leaf", "doc_id"), "places")
    kinds = scratch.save(places.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("n")), "kinds")
    tokens = kinds.select("leaf", "line", "n", F.posexplode(F.split("line", " ")).alias("p", "token"))
    firm = tokens.where(F.col("token") != "<*>").groupBy("leaf", "p", "token").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("leaf", "p", "token", F.lit(True).alias("firm"))
    shaped = tokens.join(firm, ["leaf", "p", "token"], "left").withColumn("token", F.when(F.col("firm"), F.col("token")).otherwise("<*>"))
    parts = shaped.groupBy("leaf", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "token"))), lambda x: x["token"]), " ").alias("template"),
        F.count("firm").alias("firm"),
        F.count(F.lit(1)).alias("size"),
    )
    common = parts.where(F.col("firm") >= fixed * F.col("size")).select("line", F.xxhash64("leaf", "template").alias("t"), "template")
    return places, scratch.save(common, "common")


def unused(name: str, columns: list[str]) -> str:
    """The name, with underscores behind it until no column has it."""
    while name.lower() in [c.lower() for c in columns]:
        name += "_"
    return name


def drop_lines(docs: DataFrame, depth: int = 3, min_docs: int = 10, fixed: float = 0.6, own: float = 0.3) -> DataFrame:
    """`docs` with its text lessened by lines of dropped templates, and n_lines and n_dropped added.

    Columns named n_lines and n_dropped are replaced; all others pass through.
    """
    scratch = Scratch(docs.sparkSession)
    known = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text")
    places, common = common_lines(known, scratch, depth, min_docs, fixed)
    width = F.length("line")
    hits = meet(places.select("doc_id", "_t", "total", "same", "line"), common.select("line", "t"), "line", "doc_id", F.length("line"))
    found = scratch.save(hits.groupBy("doc_id", "_t").agg(F.collect_set(F.struct("line", "t")).alias("ls"), F.first("total").alias("total"), F.first("same").alias("same")), "found")
    held = found.withColumn("held", F.array_join("ls.line", " "))
    speaks = F.col("total") - _tokens("held") >= own * F.col("total")
    once = held.groupBy("same").agg(F.first("ls.t").alias("ts"), F.first(speaks).alias("speaks"))
    often = once.select("speaks", F.explode(F.array_distinct("ts")).alias("t")).groupBy("t").agg(F.count_if("speaks").alias("n"), F.count(F.lit(1)).alias("docs"))
    bad = scratch.save(often.where((F.col("n") >= min_docs) & (2 * F.col("n") >= F.col("docs"))).select("t"), "bad")
    gone = meet(found.select("doc_id", "_t", F.inline("ls")), bad, "t", "doc_id").groupBy("doc_id", "_t").agg(F.collect_set("line").alias("_gone"))
    # inner columns of names that the table does not have
    of_text, lines, left = (unused(n, docs.columns) for n in ("_t", "_gone", "_kept"))
    gone = gone.toDF("doc_id", of_text, lines)
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    joined = docs.select(*columns, F.xxhash64("text").alias(of_text)).join(gone, ["doc_id", of_text], "left")
    pairs = F.zip_with(F.split("text", "\n"), masked(F.col("text")), lambda raw, line: F.struct(raw.alias("raw"), line.alias("line")))
    kept = F.when(F.col(lines).isNotNull(), F.filter(pairs, lambda x: ~F.array_contains(lines, x["line"])))
    cut = joined.select("*", F.when(F.col("text").isNotNull(), F.size(F.split("text", "\n"))).otherwise(0).cast("long").alias("n_lines"), kept.alias(left))
    return cut.select(
        *[F.when(F.col(left).isNull(), F.col("text")).otherwise(F.array_join(F.col(left)["raw"], "\n")).alias(c) if c == "text" else F.col(c) for c in columns],
        "n_lines",
        F.when(F.col(left).isNull(), 0).otherwise(F.col("n_lines") - F.size(left)).cast("long").alias("n_dropped"),
    )
