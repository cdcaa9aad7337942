"""Pattern scan for personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import prefix_domain

# fixed values: patterns and placeholder domains
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
LONG_DIGITS = r"\b\d{13,19}\b"
PLACEHOLDERS = ["example.com", "example.org", "example.net", "example.test"]


def real_emails(text: Column) -> Column:
    """Addresses whose domain is none of the placeholders; a subdomain of one is real."""
    return F.filter(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), lambda e: ~prefix_domain(e).isin(PLACEHOLDERS))


def scan(docs: DataFrame, samples: int = 5) -> DataFrame:
    """Counts, samples and the clean verdict of each document; a null text has null figures and no verdict."""
    text = F.col("text")
    found = docs.select(
        *[c for c in docs.columns if c != "text"],
        F.regexp_count(text, F.lit(EMAIL)).cast("long").alias("email_count"),
        real_emails(text).alias("emails"),
        F.regexp_count(text, F.lit(PHONE)).cast("long").alias("phone_count"),
        F.regexp_count(text, F.lit(SSN)).cast("long").alias("ssn_count"),
        F.regexp_extract_all(text, F.lit(LONG_DIGITS), F.lit(0)).alias("digits"),
    )
    real, long = F.size("emails").cast("long"), F.size("digits").cast("long")
    return found.select(
        *[c for c in docs.columns if c != "text"],
        "email_count",
        real.alias("real_email_count"),
        (F.col("email_count") - real).alias("placeholder_email_count"),
        "phone_count",
        "ssn_count",
        long.alias("long_digit_count"),
        F.array_join(F.slice("emails", 1, samples), ",").alias("email_samples"),
        F.array_join(F.slice("digits", 1, samples), ",").alias("digit_samples"),
        ((real == 0) & (F.col("phone_count") == 0) & (F.col("ssn_count") == 0) & (long == 0)).alias("clean"),
    )


def summarise(scanned: DataFrame, *keys: str) -> DataFrame:
    """Totals; documents without a verdict count as scanned, not as clean."""
    return scanned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("file_count"),
        F.count_if(F.coalesce("clean", F.lit(False))).alias("clean_count"),
        F.count_if(F.col("clean").isNull()).alias("error_count"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("email_count", "real_email_count", "phone_count", "ssn_count", "long_digit_count")],
    )
