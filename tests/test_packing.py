"""Chunk packing against the greedy rule."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.functions.tables import Tables, places, running_sum
from folioflow.operators import packing


def greedy(elements, target):
    out, held, size = [], [], 0
    for text in elements:
        for at in range(0, max(len(text), 1), target):
            held.append(text[at : at + target])
            size += len(held[-1])
            if size >= target:
                out.append(held)
                held, size = [], 0
    return out + [held] * bool(held)


@pytest.mark.parametrize("target", [1, 7, 40])
def test_chunks_are_those_of_the_greedy_rule(spark, monkeypatch, target):
    monkeypatch.setattr(packing, "SPAN", 2)
    rng = random.Random(target)
    long = lambda: rng.choice([0, 0, 1, 2, 3, 5, target, target + 1, 3 * target + 2])
    docs = {g: ["é\U0001f600\nx"[k % 3] * long() for k in range(rng.randint(1, 120))] for g in range(12)}
    docs |= {50: [""], 51: ["", "", ""], 52: ["a" * target, "", ""], 53: ["", "b" * target], 54: ["x" * 500]}
    rows = [(g, 3 * i + 7, t) for g, ts in docs.items() for i, t in enumerate(ts)] + [(60, 0, None), (None, 0, "x")]
    got = packing.pack_chunks(Tables(spark), spark.createDataFrame(rows, "g long, o int, t string").repartition(5), "g", "o", "t", target).collect()
    want = {(g, k): (len(c), sum(map(len, c)), "\n".join(c)) for g, ts in docs.items() for k, c in enumerate(greedy(ts, target))}
    assert {(r.g, r.chunk): (r.n_pieces, r.n_chars, r.text) for r in got} == want and len(got) == len(want)


def test_one_long_document_meets_in_no_task(spark):
    """200,000 elements: 18 rounds of pointers, blocks of sums, and the same chunks as the greedy rule."""
    elements = spark.range(200_000).select(F.lit(1).alias("g"), F.col("id").alias("o"), F.repeat(F.lit("x"), (F.col("id") * 7919 % 13).cast("int")).alias("t"))
    got = packing.pack_chunks(Tables(spark), elements, "g", "o", "t", 25).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("c"), F.sum(F.col("chunk") * F.col("n_pieces")).alias("s")).first()
    want = greedy(["x" * (i * 7919 % 13) for i in range(200_000)], 25)
    assert tuple(got) == (len(want), sum(len(p) for c in want for p in c), sum(k * len(c) for k, c in enumerate(want)))


def test_no_target_and_no_elements(spark):
    none = spark.createDataFrame([], "g long, o int, t string")
    assert packing.pack_chunks(Tables(spark), none, "g", "o", "t", 5).count() == 0
    with pytest.raises(ValueError):
        packing.pack_chunks(Tables(spark), none, "g", "o", "t", 0)


def test_running_sums_over_blocks(spark):
    rows = [(g, o, o % 5) for g in ("a", None) for o in range(0, 300, 3)]
    got = running_sum(spark.createDataFrame(rows, "g string, o long, v long"), "g", "o", "v", "s", block=16).collect()
    assert {(r.g, r.o): r.s for r in got} == {(g, o): sum(x % 5 for x in range(0, o + 1, 3)) for g, o, _ in rows}


def test_places_over_partitions(spark):
    rows = spark.range(2000).select(F.col("id"), (F.col("id") % 3).alias("k"))
    got = places(Tables(spark), rows, F.desc("k"), "id").collect()
    assert [r.id for r in sorted(got, key=lambda r: r.place)] == sorted(range(2000), key=lambda i: (-(i % 3), i))
    assert sorted(r.place for r in got) == list(range(2000))
    assert places(Tables(spark), rows.limit(0), "id").count() == 0
