"""Hashes of word runs, computed for a chunk of documents at a time.

Every distinct word is interned once, with its 128-bit BLAKE2b digest.  The hash of a run of k words is built from
the digests of its words by doubling: runs of 1, 2, 4, ... words are combined in order by a mixing step that is not
linear, and k is a sum of such runs.  The two halves of the digests give two independent 64-bit hashes of a run.
Within one chunk, runs can also be numbered exactly, without any hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
CHUNK_DOCS = 16_000
#: words and bytes that a worker keeps interned before it begins anew; between chunks only
KEPT_WORDS, KEPT_BYTES = 300_000, 32 << 20
#: odd multipliers of the mixing step, one for each half
_STEP = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class _Interned(dict):
    """Word -> number, in order of appearance; `digests` holds 16 bytes for each."""

    def __init__(self):
        self.digests, self.size = bytearray(), 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.digests += hashlib.blake2b(word, digest_size=16).digest()
        self.size += len(word)
        return n


_known = _Interned()


class Chunk:
    """Words of several documents.  first[d]:first[d+1] are the words of document d."""

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        global _known
        if len(_known) > KEPT_WORDS or _known.size > KEPT_BYTES:
            _known = _Interned()
        self.canon = [b" ".join((t.lower() if lower else t).split()) if t else b"" for t in texts]  # bytes.lower() changes A-Z alone
        self.counts = np.array([c.count(b" ") + 1 if c else 0 for c in self.canon], dtype=np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        n = int(self.first[-1])
        self.words = np.fromiter(map(_known.__getitem__, b" ".join(c for c in self.canon if c).split()), np.int64, n)
        self.digests = np.frombuffer(bytes(_known.digests), np.uint64).reshape(-1, 2)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self._runs: dict[tuple[int, int], np.ndarray] = {}

    def runs(self, k: int, which: int = 0) -> np.ndarray:
        """Hashes of the k words from each word on, whatever documents they belong to."""
        if (k, which) not in self._runs:
            if k == 1:
                found = self.digests[:, which][self.words]
            else:
                half = 1 << ((k - 1).bit_length() - 1)  # the largest power of two below k
                a, b = self.runs(half, which), self.runs(k - half, which)
                n = max(len(self.words) - k + 1, 0)
                found = mix(a[:n] * _STEP[which] + b[half : half + n])
            self._runs[k, which] = found
        return self._runs[k, which]

    def ranges(self, start: np.ndarray, words: int, which: int = 0) -> np.ndarray:
        """Hashes of the runs of so many words from each start."""
        return self.runs(words, which)[start]

    def windows(self, k: int) -> np.ndarray:
        """First words of all runs of k words that lie within one document."""
        n = len(self.doc) - k + 1
        return np.flatnonzero(self.doc[:n] == self.doc[k - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def _short(self, k: int) -> np.ndarray:
        return np.flatnonzero((self.counts > 0) & (self.counts < k))

    def shingles(self, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """(document, hash) of each document's distinct shingles, sorted; fewer than k words are one shingle."""
        at, short = self.windows(k), self._short(k)
        hashes = [self.ranges(at, k)]
        for c in range(1, k):
            hashes.append(self.ranges(self.first[short[self.counts[short] == c]], c))
        docs = np.concatenate([self.doc[at], *(short[self.counts[short] == c] for c in range(1, k))])
        return _distinct(docs, np.concatenate(hashes))

    def exact_shingles(self, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """As `shingles`, but with numbers that are equal within this chunk exactly where the words are."""
        at, short = self.windows(k), self._short(k)
        number, length = self.words, 1
        while length < k:  # numbers of runs of `length` words grow by doubling
            step = min(length, k - length)
            pair = number[: max(len(number) - step, 0)] * (int(number.max(initial=0)) + 1) + number[step:]
            number, length = np.unique(pair, return_inverse=True)[1].astype(np.int64), length + step
        own: dict[bytes, int] = {}
        rest = np.array([own.setdefault(self.canon[d], len(own)) for d in short.tolist()], dtype=np.int64) + len(self.words)
        return _distinct(np.concatenate((self.doc[at], short)), np.concatenate((number[at], rest)))


def _distinct(docs: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((values, docs))
    docs, values = docs[order], values[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (values[1:] != values[:-1])
    return docs[new], values[new]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.Table, list[bytes | None]]]:
    """Arrow batches regrouped by bytes: long texts come in small groups, short ones in large groups."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        sizes = np.asarray(pc.fill_null(pc.binary_length(table[text]), 0).to_numpy(), dtype=np.int64)
        begin, total = 0, 0
        for i, size in enumerate(sizes):
            if i > begin and (total + size > CHUNK_BYTES or i - begin >= CHUNK_DOCS):
                part = table.slice(begin, i - begin)
                yield part, part[text].cast(pa.binary()).to_pylist()
                begin, total = i, 0
            total += size
        if begin < len(sizes):
            part = table.slice(begin)
            yield part, part[text].cast(pa.binary()).to_pylist()


def groups(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
