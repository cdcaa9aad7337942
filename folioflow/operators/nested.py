"""Numbers out of reports of unknown nesting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import Tables

#: types of values that count as numbers
NUMBERS = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL\(.*\))$"


def numeric_leaves(tables: Tables, reports: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, path, value) of every number in a column of JSON, at any depth: `scores.f1`, `runs[2].seconds`.

    Strings, booleans, nulls and texts that are no JSON give no row; a number alone has the empty path, and an empty key adds nothing to it.  One round for
    each level of nesting, in which what is still nested opens one level further.
    """
    spark, kind = reports.sparkSession, F.expr("schema_of_variant(try_parse_json(j))")
    open_ = tables.save(reports.select(*keys, F.lit("").alias("path"), F.col(column).alias("j")).withColumn("kind", kind), "reports")
    leaves = []
    while True:
        number = open_.where(F.col("kind").rlike(NUMBERS))
        leaves.append(number.select(*keys, "path", F.expr("variant_get(try_parse_json(j), '$', 'double')").alias("value")))
        nested = open_.where(F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY"))
        if nested.isEmpty():
            break
        parts = spark.sql("SELECT t.*, e.pos, e.key, to_json(e.value) AS part FROM {t} t, LATERAL variant_explode(try_parse_json(t.j)) e", t=nested)
        dot = F.when(F.col("path") == "", "").otherwise(".")
        path = F.when(F.col("key").isNull(), F.concat("path", F.lit("["), "pos", F.lit("]"))).otherwise(F.concat("path", dot, "key"))
        open_ = tables.save(parts.select(*keys, path.alias("path"), F.col("part").alias("j")).withColumn("kind", kind), "parts")
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out
