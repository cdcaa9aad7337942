"""Column functions on text: normalisation, paragraphs, patterns, hash-based draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space, spelled out since engines differ on \s
SPACE = r"[ \t\n\r\f\x0B]+"


def normalise(text: Column) -> Column:
    """White space runs become one blank; trimmed; lower case."""
    return F.lower(F.trim(F.regexp_replace(text, SPACE, " ")))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", "")


def paragraphs(text: Column) -> Column:
    """Stripped non-empty lines, in order."""
    return F.filter(F.transform(F.split(text, "\n"), stripped), lambda p: p != "")


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda t: t != "")


def draw(*parts: Column | str) -> Column:
    """A reproducible 32-bit number for a key: the head of the key's md5.  The same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def shuffle_key(*parts: Column | str) -> Column:
    """An order that looks random and never changes."""
    return F.md5(F.concat_ws("|", *parts))


def canonical_json(entries: Column) -> Column:
    """A map as JSON with sorted keys; unlike maps it can be compared and grouped."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def prefix_domain(address: Column) -> Column:
    return F.lower(F.element_at(F.split(address, "@"), -1))


def field_code(text: Column) -> Column:
    """First word of a field instruction, upper case."""
    return F.upper(F.get(tokens(text), F.lit(0)))


def paper_size(width: Column, height: Column) -> Column:
    """Name of a page size in twips, in either orientation (fixed values)."""
    short, long = F.least(width, height), F.greatest(width, height)
    return F.when((short == 12240) & (long == 15840), "letter").when((short == 11906) & (long == 16838), "a4").when((short == 12240) & (long == 20160), "legal").otherwise("custom")


def any_keyword(text: Column, words: list[str]) -> Column:
    """Whether one of the words occurs, case aside."""
    low = F.lower(text)
    return F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(low, w))


def prf1(matched: Column, gold: Column, cand: Column) -> dict[str, Column]:
    """Precision, recall and F1 with the scorer's nulls: without candidates precision is 1 if there is no gold
    either, else 0; without gold recall is null; F1 is null if recall is, or if both are 0."""
    m, g, c = (x.cast("double") for x in (matched, gold, cand))
    precision = F.when(c == 0, F.when(g == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(m / c)
    recall = F.when(g == 0, F.lit(None).cast("double")).otherwise(m / g)
    f1 = F.when(recall.isNull() | (precision + recall == 0), F.lit(None).cast("double")).otherwise(2 * precision * recall / (precision + recall))
    return {"precision": precision, "recall": recall, "f1": f1}


def token_f1(matched: Column, gold: Column, cand: Column) -> Column:
    """The other convention: both empty 1, one empty or nothing shared 0."""
    m, g, c = (x.cast("double") for x in (matched, gold, cand))
    return F.when((g == 0) & (c == 0), F.lit(1.0)).when((g == 0) | (c == 0) | (m == 0), F.lit(0.0)).otherwise(2 * m / (g + c))


def count_recall(gold: Column, cand: Column) -> Column:
    return F.when(gold == 0, F.lit(None).cast("double")).otherwise(F.least(gold, cand) / gold)
