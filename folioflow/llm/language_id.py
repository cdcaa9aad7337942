"""Language identification by rank-order profiles.

A profile lists a text's most frequent letter 1- to 3-grams in order.  A document gets the language whose
profile is at the smallest out-of-place distance: the sum over the document's n-grams of how far their ranks
lie apart, an absent n-gram counting as the full profile length.

Letters, of any plane, are folded to lower case; every other character ends a word, and word ends take part as a blank.
Rows that repeat an id are predicted each, from their own text; texts are read whole, however long.  An empty table
gives none, and without a labelled text all is `und`.  Other columns pass through `annotate` unless they bear a name
of its results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches, meet
from .hashing import chunks

UNKNOWN = "und"
#: languages whose profiles are held by every task; those of more are a table, and met by a join on n-grams
MOST_LANGUAGES = 1000
_LETTER = np.zeros(0x110000, dtype=np.uint32)


def _letters() -> np.ndarray:
    """Code point -> folded letter, or a blank for what is no letter.  Built once in each worker."""
    if not _LETTER[97]:
        for c in range(0x110000):
            if (x := chr(c)).isalpha():
                low = x.lower()
                _LETTER[c] = ord(low) if len(low) == 1 else c
        _LETTER[_LETTER == 0] = 32
    return _LETTER


def grams(text: str, longest: int = 3) -> np.ndarray:
    """Codes of all n-grams: 21 bits a character, shorter ones in the high places so that lengths differ."""
    points = _letters()[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)].astype(np.uint64)
    points = np.concatenate(([32], points, [32])).astype(np.uint64)
    points = points[np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))]  # blanks run together
    out, code = [], points
    for n in range(1, longest + 1):
        if n > 1:
            code = (code[:-1] << np.uint64(21)) | points[n - 1 :]
        # no n-gram reaches over a blank: blanks stand only at its ends
        inner = np.zeros(len(code), bool)
        for k in range(1, n - 1):
            inner |= points[k : k + len(code)] == 32
        if n < 3:
            inner |= points[: len(code)] == 32 if n == 1 else np.zeros(len(code), bool)
        out.append(code[~inner])
    return np.concatenate(out)


def ranked(codes: np.ndarray, length: int) -> np.ndarray:
    """The most frequent codes, most frequent first; ties by code."""
    codes = np.sort(codes)
    begin = np.flatnonzero(np.concatenate((codes[:1] >= 0, codes[1:] != codes[:-1])))
    count = np.diff(np.concatenate((begin, [len(codes)])))
    return codes[begin][np.argsort(-count, kind="stable")[:length]]


#: a language's codes, the most frequent first; or a table (lang, code, rank)
Profiles = dict[str, list[int]] | DataFrame


def _count(longest: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, texts in chunks(batches):
            parts: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(table["lang"].to_pylist(), texts):
                if text:
                    parts.setdefault(lang, []).append(grams(text.decode(), longest))
            for lang, codes in parts.items():
                code, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])

    return count


def train(labelled: DataFrame, length: int = 400, longest: int = 3, sample_docs: int = 4000, most: int = MOST_LANGUAGES) -> Profiles:
    """Profiles, in a dictionary for up to `most` languages, else in a table (lang, code, rank), from `labelled` (doc_id, text, lang).  Of each language about `sample_docs` documents are
    read, those with the smallest hash of their id; of fewer, all.  Rows without text or language teach nothing.
    """
    arrow_batches(labelled.sparkSession)
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    scratch = Scratch(labelled.sparkSession)
    share = scratch.save(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")), "languages")
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(17)), F.lit(1_000_000)) / 1_000_000.0
    kept = meet(usable, share, "lang", "doc_id", F.length("lang")).where(draw * F.col("_n") < sample_docs).select("doc_id", "text", "lang")
    counted = kept.mapInArrow(_count(longest), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code")) - 1
    top = counted.withColumn("rank", place).where(F.col("rank") < length).select("lang", "code", "rank")
    if share.count() > most:
        return scratch.save(top, "profiles")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "code"))), lambda x: x["code"])
    return {r["lang"]: r["p"] for r in top.groupBy("lang").agg(listed.alias("p")).collect()}


def _score(profiles: dict[str, list[int]], length: int, longest: int):
    langs = sorted(profiles)
    names = np.array(langs + [UNKNOWN], dtype=object)

    def tables():
        out = []
        for lang in langs:
            codes = np.array(profiles[lang], dtype=np.int64).astype(np.uint64)
            order = np.argsort(codes)
            out.append((codes[order], order))
        return out

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tables()
        for table, texts in chunks(batches):
            pred, score = np.full(len(texts), len(langs)), np.zeros(len(texts))
            for i, text in enumerate(texts):
                codes = grams(text.decode(), longest) if text else np.zeros(0, np.uint64)
                if not len(codes) or not langs:
                    continue
                own = ranked(codes, length)
                place = np.arange(len(own))
                far = np.empty(len(langs))
                for k, (sorted_codes, rank) in enumerate(known):
                    at = np.minimum(np.searchsorted(sorted_codes, own), len(rank) - 1)
                    far[k] = np.where(sorted_codes[at] == own, np.abs(rank[at] - place), length).sum()
                pred[i] = int(np.argmin(far))
                score[i] = 1.0 - far[pred[i]] / (length * len(own))
            rest = [table[c] for c in table.column_names if c != "text"]
            yield from pa.Table.from_arrays(
                [*rest, pa.chunked_array([pa.array(names[pred], pa.string())]), pa.chunked_array([pa.array(np.clip(score, 0, 1))])],
                names=[*(c for c in table.column_names if c != "text"), "lang_pred", "score"],
            ).to_batches()

    return predict


def _met(docs: DataFrame, profiles: DataFrame, length: int, longest: int) -> DataFrame:
    """`docs` with lang_pred and score from a table of profiles of any number of languages.

    An n-gram that both know brings a language nearer by length less the ranks between them; all others count in full,
    so the nearest language has the largest sum, which the join tells for every language that shares an n-gram."""
    scratch = Scratch(docs.sparkSession)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [ranked(grams(t, longest), length).astype(np.int64).tolist() if t else [] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.list_(pa.int64()))], names=[*batch.schema.names, "_codes"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    rows = scratch.save(docs.mapInArrow(codes, f"{fields}, _codes array<long>").withColumn("_row", F.monotonically_increasing_id()), "codes")
    own = rows.select("_row", F.posexplode("_codes").alias("place", "code"))
    near = own.join(profiles, "code").groupBy("_row", "lang").agg(F.sum(length - F.abs(F.col("rank") - F.col("place"))).alias("gain"))
    best = near.groupBy("_row").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "lang")).alias("_best"))
    first = profiles.agg(F.min("lang")).first()[0]  # where nothing is shared all languages are as far
    full = length * F.size("_codes")
    pred = F.when(F.size("_codes") == 0, UNKNOWN).otherwise(F.coalesce("_best.lang", F.lit(first)))
    score = F.when(F.size("_codes") == 0, 0.0).otherwise(1.0 - (full + F.coalesce("_best.loss", F.lit(0))) / full)
    return rows.join(best, "_row", "left").select(*docs.columns, pred.alias("lang_pred"), score.alias("score"))


def predict(docs: DataFrame, profiles: Profiles, length: int = 400, longest: int = 3) -> DataFrame:
    """doc_id, lang_pred, score (1 = the profile's own order, 0 = nothing in common) for each row of `docs`.

    Null texts and texts without a letter are `und` with score 0.  Ties go to the first language by name.
    """
    arrow_batches(docs.sparkSession)
    if isinstance(profiles, DataFrame):
        return _met(docs.select("doc_id", "text"), profiles, length, longest).drop("text")
    return docs.select("doc_id", "text").mapInArrow(_score(profiles, length, longest), "doc_id long, lang_pred string, score double")


def annotate(docs: DataFrame, profiles: Profiles, length: int = 400, longest: int = 3) -> DataFrame:
    """`docs` with lang_pred and score; in one pass over the rows and without a join, where the profiles are held."""
    arrow_batches(docs.sparkSession)
    if isinstance(profiles, DataFrame):
        return _met(docs, profiles, length, longest)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    inner = _score(profiles, length, longest)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for out in inner(iter([batch.select(["doc_id", "text"])])):
                part = batch.slice(at, out.num_rows)
                at += out.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns, out["lang_pred"], out["score"]], names=[*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(both, f"{fields}, lang_pred string, score double")


def is_held_out(doc_id) -> "pd.Series | bool":
    """crc32 of the id's decimal digits modulo 5 is 0; for plain Python, the column form is `held_out`."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def held_out(doc_id=None):
    col = F.col("doc_id") if doc_id is None else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 5 == 0, F.lit(False))
