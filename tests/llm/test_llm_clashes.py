"""Columns of other meaning that bear the names of results or of inner columns change nothing."""

import pytest
from pyspark.sql import functions as F

from folioflow.llm import mixing, template_lines
from folioflow.llm.decontamination import contaminated
from folioflow.llm.minhash_dedup import minhash_components
from folioflow.llm.substring_dedup import substring_dedup

NAMES = ["n_words", "hits", "n_shingles", "component_id", "kept", "key", "bands", "size", "target", "taken", "salt", "h", "w", "item_id", "_t", "_gone", "draw", "quota"]


def clashing(df):
    return df.select("*", *[F.lit(f"clash {n}").alias(n) for n in NAMES if n not in df.columns])


@pytest.mark.parametrize("operator", [substring_dedup, minhash_components, mixing.mix, lambda docs: contaminated(docs, docs.select(F.col("doc_id").alias("item_id"), "text")), lambda docs: template_lines.drop_lines(docs).select("doc_id", "text", "n_lines", "n_dropped")])
def test_names_of_results_and_inner_columns(documents, operator):
    line = "one two three four five six seven eight"
    docs = documents(*[(i, f"{line}\nown words {i} of this text and no other {i * 7}\n{line} {line}") for i in range(14)], (20, None), (21, "")).drop("hits")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(operator(clashing(docs))) == rows(operator(docs))
    assert operator(clashing(docs).limit(0)).count() == 0
