"""Queries against SQL, and against brute force where SQL has no form."""

import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from folioflow.llm import queries

from tests.llm.test_llm_edges import plain_targets


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(agree, name):
    agree(queries.QUERIES[name], queries.SQL[name])


def test_language_id_on_held_out_documents(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op3_language_id(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_token_totals_equal_a_plain_count(spark, sf_dir):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.VOCABULARY, "rb"))}
    coder = tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=ranks, special_tokens={})
    low = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 0").collect()}
    want, seen = defaultdict(lambda: [0, 0, 0]), set()
    for r in sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda r: r.doc_id):
        copy = r.text in seen
        seen.add(r.text)
        if r.doc_id in low:
            continue
        for version, n in (("words-1", len(r.text.encode().split())), ("bpe50k-1", len(coder.encode_ordinary(r.text)))):
            total = want[r.source, r.lang, version]
            total[0] += 1
            total[1] += 0 if copy else n
            total[2] += len(r.text)
    got = {(r.source, r.lang, r.tokenizer): [r.docs, r.tokens, r.chars] for r in queries.op8_token_counts(spark, sf_dir).collect()}
    assert got == dict(want)


def test_mix_meets_its_targets(spark, sf_dir):
    rows = queries.op9_mixing(spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op9_mixing(spark, sf_dir).collect()))
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
    assert all(r.source_size == sizes[r.source] for r in rows)
    assert target == pytest.approx(plain_targets(dict(sizes)))
    assert all(abs(taken[s] - target[s]) <= 1 + 0.05 * sizes[s] for s in sizes)


def test_registry():
    names = list(queries.QUERIES)
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.SQL) <= set(names)


def test_results_do_not_depend_on_partitioning(spark, sf_dir):
    from folioflow.llm.substring_dedup import substring_dedup

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    digest = lambda df: sorted((r.doc_id, r.kept_sha256) for r in df.select("doc_id", "kept_sha256").collect())
    assert digest(substring_dedup(docs)) == digest(substring_dedup(docs.repartition(7).orderBy(F.rand(3))))
