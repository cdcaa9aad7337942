"""Corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that run() writes as Parquet to the shared folder and
reads again as the next stage's documents.  All but the last return the columns of documents and drop others.  Rows
with a null id or text, and texts without a letter, are rejected by the first stage; rows that repeat an id are one
group for near-dedup, which keeps one of them.  An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm import language_id, minhash_dedup, mixing, template_lines
from folioflow.llm.common import Scratch
from folioflow.llm.decontamination import contaminated

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null text, no letter, or nothing in common with any profile."""
    profiles = language_id.train(docs.where(~language_id.held_out()))
    named = language_id.annotate(docs.select(*COLUMNS).where(F.col("doc_id").isNotNull()), profiles)
    return named.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") > 0)).select(*COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops boilerplate lines from the texts; documents of which nothing is left go."""
    kept = template_lines.drop_lines(docs.select(*COLUMNS))
    text = F.col("text")
    return kept.where((F.col("n_dropped") == 0) | (F.length(F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))) > 0)).withColumn("n_chars", F.length(text).cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near-duplicates, and one row of an id."""
    kept = minhash_dedup.minhash_components(docs, percent=85).where("kept").select("doc_id")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.xxhash64("lang", "source")))
    return docs.join(kept, "doc_id", "left_semi").withColumn("_place", place).where(F.col("_place") == 1).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), percent=80)
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document; documents of which it takes none stay with taken = 0."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate),
    ("minhash_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: rank-order language profiles and the mix's fitting have no SQL; tests hold run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, before = scratch.save(stage(spark, docs, sf_dir), name), docs
        scratch.drop(before)
    return docs
