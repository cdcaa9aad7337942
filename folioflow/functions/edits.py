"""Edit distance of whole texts, a column of differences at a time."""

from __future__ import annotations

from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def distance(a: str, b: str) -> int:
    """Insertions, deletions and replacements of characters that turn one text into the other.

    What both begin and end with is cut off.  Of the table of distances between all heads, neighbouring cells differ by
    -1, 0 or 1; a column is kept as two whole numbers, the places where it rises (`up`) and where it falls (`down`), and
    the next one follows by a few operations on all of its bits.  Two texts of n characters take n steps on n bits.
    """
    head = len(commonprefix((a, b)))
    a, b = a[head:], b[head:]
    tail = len(commonprefix((a[::-1], b[::-1])))
    if tail:
        a, b = a[:-tail], b[:-tail]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    bits: dict[str, list[int]] = {}
    for i, c in enumerate(a):
        bits.setdefault(c, []).append(i)
    held = {}
    for c, places in bits.items():  # by bytes, since shifting a long number for every place would be quadratic
        row = bytearray(len(a) // 8 + 1)
        for i in places:
            row[i >> 3] |= 1 << (i & 7)
        held[c] = int.from_bytes(row, "little")
    whole, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, total = whole, 0, len(a)
    for c in b:
        same = held.get(c, 0)
        level = same | down
        carried = (((same & up) + up) ^ up) | same
        rises, falls = down | (whole & ~(carried | up)), up & carried
        if rises & last:
            total += 1
        elif falls & last:
            total -= 1
        rises, falls = (rises << 1) | 1, falls << 1
        up, down = (falls | ~(level | rises)) & whole, rises & level & whole
    return total


@F.pandas_udf(LongType())
def _distances(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else distance(x, y) for x, y in zip(a, b)], dtype="Int64")


#: characters of the shorter text up to which the table of distances costs less than columns of bits in Python
SHORT = 256


def edit_distance(a: Column, b: Column) -> Column:
    """Null if either text is.  Short texts, most of them, are compared by Spark's own function."""
    short = F.least(F.length(a), F.length(b)) <= SHORT
    long = _distances(F.when(~short, a), F.when(~short, b))
    return F.when(short, F.levenshtein(a, b).cast("long")).otherwise(long)
