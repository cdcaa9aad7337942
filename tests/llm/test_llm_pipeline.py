"""The pipeline's stages, each against a plain version on its own input."""

from collections import defaultdict

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_llm_edges import brute_components, plain_targets


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    outputs = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        outputs[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == corpus_pipeline.COLUMNS
    before = outputs["line_dedup"]
    want = brute_components([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in outputs["minhash_dedup"]) == sorted(i for i, (_, comp) in want.items() if i == comp)
    items = [set(shingles(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = [r.doc_id for r in outputs["minhash_dedup"] if not any(100 * len(i & set(shingles(r.text))) >= 80 * len(i) for i in items)]
    assert sorted(r.doc_id for r in outputs["decontamination"]) == sorted(clean)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in outputs["mixing"]:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
    target = plain_targets(dict(sizes))
    assert sorted(r.doc_id for r in outputs["mixing"]) == sorted(clean) and all(abs(taken[s] - target[s]) <= 1 + 0.05 * sizes[s] for s in sizes)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, outputs["mixing"]))


def shingles(text):
    w = text.encode().lower().split()
    return [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)]


def test_stages_on_hostile_rows(spark, tmp_path, documents):
    """Nulls, empties, repeats, ties and clashing columns in any stage; and an empty table."""
    spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "plain words of a text that is kept"), (1, "plain words of a text that is kept"), (1, "another text under the same id, kept once"), (2, None), (3, ""), (4, "12 34"), (None, "no id here"), (5, "say one two three four five six seven"), (6, "x " * 200_000), (7, "x " * 200_000)]
    docs = documents(*rows).withColumn("lang", F.when(F.col("doc_id") != 6, "en")).withColumn("source", F.when(F.col("doc_id") != 1, "s"))
    docs = docs.withColumn("n_dropped", F.lit("clash")).withColumn("component_id", F.lit("clash")).withColumn("lang_pred", F.lit("clash"))
    for table in (docs, docs.limit(0)):
        kept = []
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path)).cache()
            assert name == "mixing" or out.columns == corpus_pipeline.COLUMNS
            kept.append(sorted(r.doc_id for r in out.collect()))
            table = out
        assert kept in ([[1, 1, 1, 5, 6, 7], [1, 1, 1, 5, 6, 7], [1, 5, 6], [1, 6], [1, 6]], [[]] * 5)
