"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: DuckDB text of shared definitions
LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g')), lambda x: x <> '')"
NORM = r"lower(trim(regexp_replace({}, '[ \t\n\r\f\x0B]+', ' ', 'g')))"


def prf1_sql(m: str, g: str, c: str) -> str:
    p = f"CASE WHEN {c} = 0 THEN CASE WHEN {g} = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE ({m})::DOUBLE / {c} END"
    r = f"CASE WHEN {g} = 0 THEN NULL ELSE ({m})::DOUBLE / {g} END"
    return f"round({p}, 6) AS precision, round({r}, 6) AS recall, round(CASE WHEN {g} = 0 OR ({p}) + ({r}) = 0 THEN NULL ELSE 2 * ({p}) * ({r}) / (({p}) + ({r})) END, 6) AS f1"
