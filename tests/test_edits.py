"""Edit distances against the table of all heads."""

import random

from pyspark.sql import functions as F

from folioflow.functions.edits import distance, edit_distance


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_random_texts():
    rng = random.Random(1)
    for _ in range(1500):
        letters = rng.choice(["ab", "abcdef", "aé日\U0001f600 "])
        a = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 9, 40, 90])))
        b = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 9, 40, 90]))) if rng.random() < 0.6 else a[: rng.randint(0, 90)] + rng.choice(letters) + a[rng.randint(0, 90) :]
        assert distance(a, b) == plain(a, b) == distance(b, a)


def test_long_texts():
    rng = random.Random(2)
    a = "".join(rng.choice("abcdefgh") for _ in range(60_000))
    b = list(a)
    for k in range(0, 60_000, 1000):
        b[k] = "X"
    assert distance(a, "".join(b)) == 60 and distance(a, "z" * 60_001) == 60_001 and distance(a, "") == 60_000


def test_columns(spark):
    rows = spark.createDataFrame([("kitten", "sitting"), (None, "a"), ("", None), ("", "")], "a string, b string")
    assert [r[0] for r in rows.select(edit_distance(F.col("a"), F.col("b"))).collect()] == [3, None, None, 0]
