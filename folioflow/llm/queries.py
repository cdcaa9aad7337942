"""One query for each operator, over its whole table.  Contracts fix the columns of ops 1, 3, 4, 5, 9 and 11 to 13."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_automaton, filter_audit, importance_resampling, language_id, minhash_dedup, mixing, template_lines, token_rollup, url_filters
from .common import Scratch, meet
from .conversations import maximal_conversations
from .decontamination import contaminated
from .embedding_dedup import embedding_components
from .sql import SQL
from .substring_dedup import substring_dedup

#: a vocabulary file of ranks, and the split pattern that belongs to it (fixed value)
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=80)
    return found.select("doc_id", "item_id", "n_item", "n_shared")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    profiles = language_id.train(docs.where(~language_id.held_out()))
    scored = language_id.predict(docs.select("doc_id", "text"), profiles)
    return scored.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.minhash_components(_table(spark, sf_dir, "documents"), percent=85)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages judged at a fetch date against a dated list.  The tables have neither: a page's date follows from its
    id, and the list from the md5 of each host and registered domain in the table, with an entry that blocks and a
    later one that allows again."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    captures = pages.select("page_id", "url", day(F.col("page_id") % 366).alias("fetched_at"))
    hosts = pages.select(url_filters.host("url").alias("host")).where(F.col("host").isNotNull()).distinct()
    number = lambda c, a: F.conv(F.substring(F.md5(c), a, 4), 16, 10).cast("long")
    exact = hosts.where(number(F.col("host"), 1) % 3 == 0).select(F.col("host").alias("domain"), (number(F.col("host"), 5) % 300).alias("d"))
    registered = r"([^.]+\.(?:(?:ac|co|com|edu|gov|net|org)\.[a-z][a-z]|[^.]*[^.0-9\]][^.]*))$"
    parents = hosts.select(F.regexp_extract("host", registered, 1).alias("domain")).where(F.col("domain") != "").distinct()
    parents = parents.select("domain", (number(F.col("domain"), 5) % 300).alias("d"))
    both = exact.union(parents).distinct()
    entries = both.select("domain", day(F.col("d")).alias("listed_at"), F.lit("block").alias("action")).union(both.select("domain", day(F.col("d") + 45), F.lit("allow")))
    return url_filters.judge(captures, entries)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = template_lines.drop_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("kept_md5"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: all documents come in under two tokenizers; documents labelled as of low quality
    are deleted; of equal texts all but the smallest id are revised to no tokens.  A repeated commit changes nothing.
    """
    scratch = Scratch(spark)
    docs = _table(spark, sf_dir, "documents")
    bpe = token_rollup.bpe_counter(spark, VOCABULARY, PATTERN)
    chars = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    counted = docs.select("doc_id", "source", "lang", chars.alias("chars"), F.md5("text").alias("key"), token_rollup.count_words().alias("words"), bpe("text").alias("bpe"))
    counted = scratch.save(counted, "counted")
    versions = {"words-1": "words", "bpe50k-1": "bpe"}

    def signed(rows: DataFrame, sign: int, tokens: str | None = None) -> DataFrame:
        kinds = F.inline(F.array(*[F.struct(F.lit(v).alias("tokenizer"), (F.col(c) if tokens is None else F.lit(0).cast("long")).alias("tokens")) for v, c in versions.items()]))
        return rows.select("source", "lang", F.lit(sign).alias("sign"), "chars", kinds)

    rollup = token_rollup.Rollup(spark, f"{scratch.base}/rollup")
    rollup.commit("1-insert", signed(counted, 1))
    low = _table(spark, sf_dir, "labels").where(F.col("quality") == 0).select("doc_id").distinct()
    rollup.commit("2-delete", signed(counted.join(low, "doc_id", "left_semi"), -1))
    first = counted.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    first = scratch.save(first.select("key", "first"), "first")
    copies = meet(counted.join(low, "doc_id", "left_anti"), first, "key", "doc_id", F.length("key")).where(F.col("doc_id") > F.col("first"))
    rollup.commit("3-revise", signed(copies, -1).unionByName(signed(copies, 1, "0")))
    rollup.commit("1-insert", signed(counted, 1))
    return rollup.totals()


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maximal_conversations(_table(spark, sf_dir, "conversations"))


def op11_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        source = f.read()
    return bpe_automaton.tokenized(_table(spark, sf_dir, "documents"), source)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("filter")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


_ALL = (
    op1_substring_dedup,
    op2_decontamination,
    op3_language_id,
    op4_minhash_dedup,
    op5_embedding_dedup,
    op6_url_filters,
    op7_line_dedup,
    op8_token_counts,
    op9_mixing,
    op10_chat_formatting,
    op11_bpe_automaton,
    op12_filter_audit,
    op13_importance_resampling,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
