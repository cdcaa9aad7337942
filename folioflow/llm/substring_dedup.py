"""Substring dedup by fixed-block anchors.

A repeat of `window` words holds at least one whole block of `block` words of any document's grid, when
2 * block - 1 <= window.  So (1) every document's non-overlapping blocks are indexed and probed with every
rolling window of `block` words; (2) hits are extended: the `window`-word runs around them are compared by two
independent 64-bit hashes over the BLAKE2b digests of their words, and runs of confirmed starts are the maximal
exact repeats; (3) a run goes if it also starts in a document with a smaller id.

Both exchanges move packed arrays rather than rows: a map task sends each distinct hash once per chunk of
about 2 MB of text, so a passage found in a third of all documents costs its bucket one entry a chunk.  The
first exchange moves 6 bytes a word; it is only a filter, false hits are rejected by the second.  Buckets
follow the size of the corpus, so a bucket's arrays stay about as large at any scale.

What goes to a bucket names only the documents found there, and replies are dealt by a hash of the id, so ids of any
stride or sign spread evenly.

Nulls, empty and short texts have no window and stay whole.  Rows with a null id take no part and stay whole.
Rows that repeat an id are all kept; equal ids never remove each other.  An empty table gives none.  Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches, partitions
from .hashing import Chunk, chunks, groups, mix

_MANY, _BLOCK = 0x7FFF, 0x8000
_PACKED = "bucket int, kind int, ids binary, body binary"
_REPLY = "target int, ids binary, sizes binary, body binary"


def _rows(rows: list[tuple], names: tuple[str, ...], kinds: tuple[pa.DataType, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names=list(names))


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return _rows(rows, ("bucket", "kind", "ids", "body"), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))


def _target(ids: np.ndarray | int, targets: int) -> np.ndarray:
    """Where replies to documents go."""
    return (mix(np.atleast_1d(np.asarray(ids, np.int64)).view(np.uint64)) % np.uint64(targets)).astype(np.int64)


def _by_doc(docs: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(docs, kind="stable")
    docs, values = docs[order], values[order]
    at = groups(docs)
    for d, part in zip(docs[at], np.split(values, at[1:])):
        yield int(d), part


def _reply(found: list[tuple[int, bytes]], targets: int) -> pd.DataFrame:
    """Replies to documents, packed by where they go: a row for each target rather than for each document."""
    where = _target([d for d, _ in found], targets).tolist()
    rows = []
    for target, part in itertools.groupby(sorted(zip(where, found), key=lambda x: x[0]), key=lambda x: x[0]):
        ids, bodies = zip(*(x for _, x in part))
        rows.append((target, np.array(ids, np.int64).tobytes(), np.array([len(b) for b in bodies], np.int64).tobytes(), b"".join(bodies)))
    return pd.DataFrame(rows, columns=["target", "ids", "sizes", "body"])


def _unpack(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for each document with all that came for it."""
    hits: dict[int, list[bytes]] = {}
    for ids, sizes, body in zip(pdf["ids"], pdf["sizes"], pdf["body"]):
        ends = np.cumsum(np.frombuffer(sizes, np.int64))
        for i, a, b in zip(np.frombuffer(ids, np.int64).tolist(), [0, *ends.tolist()], ends.tolist()):
            hits.setdefault(i, []).append(body[a:b])
    return pd.DataFrame([(i, b"".join(x)) for i, x in hits.items()], columns=["doc_id", "hits"])


def _send_probes(block: int, buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, texts in chunks(batches):
            ids, chunk = np.asarray(table["doc_id"].to_numpy(), dtype=np.int64), Chunk(texts)
            at = chunk.windows(block)
            if not len(at):
                continue
            h, docs = chunk.ranges(at, block), chunk.doc[at]
            key = ((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))
            grid = (at - chunk.first[docs]) % block == 0
            order = np.argsort(key, kind="stable")
            key, docs, grid = key[order], docs[order], grid[order]
            begin = groups(key)
            last = np.concatenate((begin[1:], [len(key)])) - 1
            many = docs[begin] != docs[last]
            entry = np.where(many, _MANY, docs[begin]).astype(np.uint16) | np.where(np.maximum.reduceat(grid, begin), _BLOCK, 0).astype(np.uint16)
            key, low = key[begin], (key[begin] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            edges = np.searchsorted(key, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
            # a bucket is told of the documents that it has entries of, and entries name them by their place there
            single, n = ~many, len(texts)
            used, place = np.unique((key[single] >> np.uint64(32)).astype(np.int64) * n + docs[begin][single], return_inverse=True)
            first = np.searchsorted(used, np.arange(buckets + 1) * n)
            entry[single] = (entry[single] & _BLOCK) | (place - first[used[place] // n]).astype(np.uint16)
            named = ids[used % n]
            rows = [(i, 0, named[first[i] : first[i + 1]].tobytes(), low[a:b].tobytes() + entry[a:b].tobytes()) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
            shared = np.repeat(many, last - begin + 1)  # found twice within the chunk: hits already
            repeated = (np.repeat(key, last - begin + 1) & np.uint64(0xFFFFFFFF)).astype(np.uint32)[shared]
            own = [(d, np.unique(x).tobytes()) for d, x in _by_doc(docs[shared], repeated)]
            rows += [(int(t), 1, ids[d : d + 1].tobytes(), x) for t, (d, x) in zip(_target(ids[[d for d, _ in own]], buckets), own)]
            yield _packed(rows)

    return send


def _match_probes(pdf: pd.DataFrame, targets: int) -> pd.DataFrame:
    """A probe hits if another document has the hash and at least one of them has it as a block."""
    out = [(int(np.frombuffer(i, np.int64)[0]), b) for k, i, b in zip(pdf["kind"], pdf["ids"], pdf["body"]) if k == 1]
    sent = pdf[pdf["kind"] == 0]
    if len(sent):
        sizes = [len(b) // 6 for b in sent["body"]]
        low = np.concatenate([np.frombuffer(b, np.uint32, n) for b, n in zip(sent["body"], sizes)])
        entry = np.concatenate([np.frombuffer(b, np.uint16, n, 4 * n) for b, n in zip(sent["body"], sizes)])
        row = np.repeat(np.arange(len(sent)), sizes)
        order = np.argsort(low, kind="stable")
        low, entry, row = low[order], entry[order], row[order]
        begin = groups(low)
        count = np.diff(np.concatenate((begin, [len(low)])))
        hit = np.repeat((count > 1) & np.maximum.reduceat((entry & _BLOCK) > 0, begin), count) & ((entry & _MANY) != _MANY)
        ids = [np.frombuffer(x, np.int64) for x in sent["ids"]]
        place = row[hit].astype(np.int64) << 16 | (entry[hit] & _MANY)
        out += [(int(ids[p >> 16][p & 0xFFFF]), x.tobytes()) for p, x in _by_doc(place, low[hit])]
    return _reply(out, targets)


def _send_windows(window: int, block: int, buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, texts in chunks(batches):
            ids, chunk = np.asarray(table["doc_id"].to_numpy(), dtype=np.int64), Chunk(texts)
            at = chunk.windows(block)
            if not len(at):
                continue
            low = (chunk.ranges(at, block) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            mark = np.zeros(len(chunk.doc) + 1, np.int64)
            edges = np.searchsorted(chunk.doc[at], np.arange(len(ids) + 1))
            for d, hits in enumerate(table["hits"].to_pylist()):
                a, b = edges[d], edges[d + 1]
                mark[1 + at[a:b]] = np.isin(low[a:b], np.frombuffer(hits, np.uint32))
            mark = np.cumsum(mark)
            start = chunk.windows(window)
            start = start[mark[start + window - block + 1] > mark[start]]
            if not len(start):
                continue
            h, g, docs = chunk.ranges(start, window), chunk.ranges(start, window, 1), ids[chunk.doc[start]]
            order = np.lexsort((docs, g, h))
            h, g, docs = h[order], g[order], docs[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
            begin = np.flatnonzero(new)
            owner = np.repeat(docs[begin], np.diff(np.concatenate((begin, [len(h)]))))
            gone = docs > owner
            own = [(d, np.unique(x).tobytes()) for d, x in _by_doc(docs[gone], h[gone])]
            rows = [(int(t), 1, np.int64(d).tobytes(), x) for t, (d, x) in zip(_target([d for d, _ in own], buckets), own)]
            h, g, docs = h[begin], g[begin], docs[begin]
            where = (h >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(where, kind="stable")
            h, g, docs = h[order], g[order], docs[order]
            edges = np.searchsorted(where[order], np.arange(buckets + 1, dtype=np.uint64))
            for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                if b > a:
                    rows.append((i, 0, docs[a:b].tobytes(), h[a:b].tobytes() + g[a:b].tobytes()))
            yield _packed(rows)

    return send


def _match_windows(pdf: pd.DataFrame, targets: int) -> pd.DataFrame:
    """To each document the runs that also start in a document with a smaller id."""
    out = [(int(np.frombuffer(i, np.int64)[0]), b) for k, i, b in zip(pdf["kind"], pdf["ids"], pdf["body"]) if k == 1]
    sent = pdf[pdf["kind"] == 0]
    if len(sent):
        docs = np.concatenate([np.frombuffer(i, np.int64) for i in sent["ids"]])
        h = np.concatenate([np.frombuffer(b, np.uint64, len(b) // 16) for b in sent["body"]])
        g = np.concatenate([np.frombuffer(b, np.uint64, len(b) // 16, len(b) // 2) for b in sent["body"]])
        order = np.lexsort((docs, g, h))
        h, g, docs = h[order], g[order], docs[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        begin = np.flatnonzero(new)
        gone = docs > np.repeat(docs[begin], np.diff(np.concatenate((begin, [len(h)]))))
        out += [(d, x.tobytes()) for d, x in _by_doc(docs[gone], h[gone])]
    return _reply(out, targets)


def _cut(window: int, keep_text: bool):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))) + ((pa.string(),) if keep_text else ())
    names = ("doc_id", "n_words", "n_removed", "kept_sha256", "spans") + (("kept_text",) if keep_text else ())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, texts in chunks(batches):
            found = table["hits"].to_pylist()
            chunk, rows = Chunk([t if h else None for t, h in zip(texts, found)]), []  # words of the others are only counted
            start = chunk.windows(window)
            edges = np.searchsorted(chunk.doc[start], np.arange(len(texts) + 1))
            for d, (i, hits) in enumerate(zip(table["doc_id"].to_pylist(), found)):
                text = chunk.canon[d] if hits else b" ".join((texts[d] or b"").split())
                n, spans, gone = text.count(b" ") + 1 if text else 0, [], 0
                own = start[edges[d] : edges[d + 1]]
                if hits and len(own):
                    own = own[np.isin(chunk.ranges(own, window), np.frombuffer(hits, np.uint64))] - chunk.first[d]
                    change = np.zeros(n + 1, np.int64)
                    np.add.at(change, own, 1)
                    np.add.at(change, own + window, -1)
                    cover = np.cumsum(change[:n]) > 0
                    gone = int(cover.sum())
                    if gone:
                        turn = np.flatnonzero(np.diff(np.concatenate(([0], cover.astype(np.int8), [0]))))
                        spans = turn.reshape(-1, 2).tolist()
                        words = text.split(b" ")
                        text = b" ".join(w for a, b in zip([0, *turn[1::2]], [*turn[::2], n]) for w in words[a:b])
                rows.append((i, n, gone, hashlib.sha256(text).hexdigest(), spans) + ((text.decode(),) if keep_text else ()))
            yield _rows(rows, names, kinds)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<array<long>>" + (", kept_text string" if keep_text else "")
    return cut, schema


def substring_dedup(docs: DataFrame, window: int = 50, keep_text: bool = False) -> DataFrame:
    """Per row of `docs` (doc_id, text): n_words, n_removed, kept_sha256, spans [start, end) of the removed
    maximal repeats in words, and the kept text if asked for."""
    spark = docs.sparkSession
    arrow_batches(spark)
    scratch = Scratch(spark)
    block = (window + 1) // 2
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * partitions(spark), size // (32 << 20))

    def exchange(packed: DataFrame, match, name: str) -> DataFrame:
        replies = packed.groupBy("bucket").applyInPandas(lambda pdf: match(pdf, buckets), _REPLY)
        return scratch.save(replies.groupBy("target").applyInPandas(_unpack, "doc_id long, hits binary"), name, free=True)

    probes = known.mapInArrow(_send_probes(block, buckets), _PACKED)
    hits = exchange(probes, _match_probes, "hits")
    runs = known.join(hits, "doc_id").mapInArrow(_send_windows(window, block, buckets), _PACKED)
    gone = exchange(runs, _match_windows, "gone")
    scratch.drop(hits)
    cut, schema = _cut(window, keep_text)
    return docs.join(gone, "doc_id", "left").mapInArrow(cut, schema)
