"""BPE as a finite automaton: merges compiled gadget by gadget, words encoded through tables, arcs emitted to decode.

The automaton reads tokens.  It begins with one state that every symbol of the alphabet leads back to.  A merge (u, v)
of w = uv is then one gadget: the state q that u leads to is split off for u and loses its arc v, since v after u is
now merged; every state with an arc u gets an arc w besides, to where v led from q.  After the last merge the automaton
accepts, of all ways to write a word in tokens, the one that the merges give.  As all arcs of a token lead to one
state, the arcs are a table of bits, states by tokens, whose equal rows and columns are kept once.

A word is encoded left to right: from the state at a place, a trie lists the tokens that begin there, and the longest
with an arc leads on; from a place where no arc leads on, the walk steps back to the next shorter one.  A place can be
reached by one path alone, so none is entered twice and the walk is linear in the word.  Decoding emits the labels of
arcs; without a decoder in the file the labels are joined by blanks, end-of-word marks included.

Files are those of the `tokenizers` library with byte-level words: special tokens are cut from the raw text, then NFC,
white space to blanks and lower case, then the split into contractions, letters, single digits and other signs.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches

#: pieces and words that a worker remembers twice over, and the longest of them in characters
KEPT, KEPT_CHARS = 200_000, 48

# What the file's library knows of Unicode beyond or short of Python's own tables.  tests/llm holds every
# code point against the library.
#: white space
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: letters and numbers, first and last
LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
#: lower case of single letters, and of two ranges by their distance
LOWER = {0x3A3: 0x3C3, 0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: signs that no normal form moves or joins
INERT = [(0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF)]
#: the split of the file
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_PIECES = re.compile(f"[^{SPACES}]+")
_INERT = re.compile(f"([{''.join(f'{chr(a)}-{chr(b)}' for a, b in INERT)}])")
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^A-Za-z0-9]+")


class _Kinds(dict):
    """Code point -> a sign of its kind: a letter, a digit or neither.  ASCII stands for itself."""

    def __missing__(self, c: int) -> int:
        kind = unicodedata.category(chr(c))[0]
        letter = kind == "L" or any(a <= c <= b for a, b in LETTERS)
        self[c] = out = c if c < 128 else ord("z" if letter else "0" if kind == "N" or any(a <= c <= b for a, b in NUMBERS) else "!")
        return out


_kinds = _Kinds()


def normal(piece: str) -> str:
    """NFC and lower case of a piece without white space."""
    if piece.isascii():
        return piece.lower()
    parts = [unicodedata.normalize("NFC", p) for p in _INERT.split(piece)]
    return "".join(parts).translate(LOWER).lower()


def words(piece: str) -> list[str]:
    """The words of a normal piece."""
    if piece.isascii():
        return _WORDS.findall(piece)
    return [piece[m.start() : m.end()] for m in _WORDS.finditer(piece.translate(_kinds))]


def byte_labels() -> list[str]:
    """The character that stands for each byte in labels: itself if printable, else the next one from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(256, 512))
    return [chr(b if b in own else next(other)) for b in range(256)]


class Automaton:
    """Tables of the compiled merges.

    labels[t] and ids[t] belong to token t, leads[t] is the state its arcs lead to, and the bit column[t] of rows[q]
    says whether state q has an arc t.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        chars = byte_labels()
        alphabet = [*chars, *(c + end for c in chars)]
        number = {s: i for i, s in enumerate(alphabet)}
        rules = []
        for a, b in merges:
            if a not in number or b not in number or a + b in number:
                raise ValueError(f"{a} {b}: parts of a merge must come before it, and its result must be new")
            rules.append((number[a], number[b]))
            number[a + b] = len(number)
        missing = number.keys() - vocab.keys()
        if missing:
            raise ValueError(f"not in the vocabulary: {sorted(missing)[:5]}")
        self.labels = list(number)
        self.ids = [vocab[s] for s in self.labels]
        self._compile(rules)
        self._trie(chars, end)

    def _compile(self, rules: list[tuple[int, int]]) -> None:
        size = 512 + len(rules)
        last = np.array([i >= 256 for i in range(512)] + [False] * len(rules))
        for i, (_, v) in enumerate(rules):
            last[512 + i] = last[v]
        states = int((~last).sum()) + 3
        arcs = np.zeros((1024, (states + 7) // 8), np.uint8)  # a row of it: the states that have the arcs of a column
        arcs[0, 0] = 1
        column = np.zeros(size, np.int64)  # of each token; tokens of one column share it until one of them loses an arc
        sharing, used = [512], 1
        leads = np.where(last, 1, 0)  # state 0 begins and goes on, state 1 ends
        users = [257, 256]  # tokens that lead to each state
        for i, (u, v) in enumerate(rules):
            w, q = 512 + i, int(leads[u])
            target = q if u == v else int(leads[v])
            byte, bit = q >> 3, np.uint8(1 << (q & 7))
            if arcs[column[v], byte] & bit:
                if users[q] > 1 or u == v:  # q is split: u leads to a copy of it from now on
                    s = len(users)
                    users.append(1)
                    users[q] -= 1
                    leads[u] = s
                    new = np.uint8(1 << (s & 7))
                    has = (arcs[:used, byte] & bit) != 0
                    arcs[:used, s >> 3] = (arcs[:used, s >> 3] & ~new) | np.where(has, new, np.uint8(0))
                    byte, bit = s >> 3, new
                if sharing[column[v]] > 1:
                    if used == len(arcs):
                        arcs = np.concatenate((arcs, np.zeros_like(arcs)))
                    sharing[column[v]] -= 1
                    arcs[used] = arcs[column[v]]
                    column[v] = used
                    sharing.append(1)
                    used += 1
                arcs[column[v], byte] &= ~bit
                column[w] = column[u]
                sharing[column[u]] += 1
            else:  # u and v never meet, so w never comes about: it keeps a column without arcs
                if used == len(arcs):
                    arcs = np.concatenate((arcs, np.zeros_like(arcs)))
                column[w] = used
                sharing.append(1)
                used += 1
            leads[w] = target
            users[target] += 1
        arcs, again = np.unique(arcs[:used], axis=0, return_inverse=True)
        column = again.reshape(-1)[column]
        bits = np.unpackbits(arcs, axis=1, bitorder="little")[:, : len(users)].T
        rows, row = np.unique(np.packbits(bits, axis=1, bitorder="little"), axis=0, return_inverse=True)
        self.rows = [r.tobytes() for r in rows]
        self.column = column.tolist()
        self.leads = row.reshape(-1)[leads].tolist()
        self.start = int(row.reshape(-1)[0])

    def _trie(self, chars: list[str], end: str) -> None:
        """Nodes lead by byte to nodes, by -1 to their token, and by 256 + byte to the token that ends a word with it."""
        byte = {c: b for b, c in enumerate(chars)}
        self.trie: dict = {}
        for t, label in enumerate(self.labels):
            ends = label.endswith(end) and len(label) > len(end)
            path = [byte[c] for c in (label[: -len(end)] if ends else label)]
            key = 256 + path.pop() if ends else -1
            node = self.trie
            for b in path:
                node = node.setdefault(b, {})
            node[key] = t

    def encode(self, word: bytes) -> list[int]:
        """Tokens of one word, as numbers of labels."""
        n = len(word)
        if not n:
            return []
        trie, rows, column, leads, final = self.trie, self.rows, self.column, self.leads, 256 + word[-1]
        at, path, entered, rest = 0, [], set(), []
        row = rows[self.start]
        while True:
            options, node = [], trie  # (end, token) of all tokens that begin here, the longest last
            for i in range(at, n - 1):
                node = node.get(word[i])
                if node is None:
                    break
                t = node.get(-1)
                if t is not None:
                    options.append((i + 1, t))
            else:
                t = node.get(final)
                if t is not None:
                    options.append((n, t))
            while True:
                while not options:  # nothing leads on from here
                    options, row = rest.pop()
                    path.pop()
                at, t = options.pop()
                c = column[t]
                if at not in entered and row[c >> 3] >> (c & 7) & 1:
                    break
            path.append(t)
            if at == n:
                return path
            entered.add(at)
            rest.append((options, row))
            row = rows[leads[t]]


class Codec:
    """An automaton with the special tokens of its file."""

    def __init__(self, source: bytes):
        """`source` is a tokenizer file.  Files of another kind raise a ValueError."""
        file = json.loads(source)
        model, steps = file["model"], file["normalizer"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        known = model["type"] == "BPE" and plain and model["end_of_word_suffix"] and file["decoder"] is None
        known = known and [s["type"] for s in steps["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        split, level = file["pre_tokenizer"]["pretokenizers"]
        known = known and split["pattern"] == {"Regex": SPLIT} and level["type"] == "ByteLevel" and not level["add_prefix_space"]
        known = known and not any(t[k] for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if not known:
            raise ValueError("only byte-level BPE with word ends, NFC, lower case and no decoder is known")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.arcs = dict(zip(self.automaton.ids, self.automaton.labels)) | {i: s for s, i in self.special.items()}

    def cut(self, piece: str) -> list[str]:
        """A piece cut around special tokens, which stand at odd places."""
        if "<" not in piece and all(s[0] == "<" for s in self.special) or not any([s in piece for s in self.special]):
            return [piece]
        longest = sorted(self.special, key=len, reverse=True)
        return re.split(f"({'|'.join(map(re.escape, longest))})", piece)

    def encode(self, piece: str) -> list[int]:
        """Ids of a piece without white space."""
        found: list[int] = []
        ids, encode = self.automaton.ids, self.automaton.encode
        for k, part in enumerate(self.cut(piece)):
            if k % 2:
                found.append(self.special[part])
            else:
                for w in words(normal(part)):
                    found += [ids[t] for t in encode(w.encode())]
        return found

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.arcs[i] for i in ids])


class _Known(dict):
    """What was found of pieces or words.  Two generations of KEPT entries: what is used again moves to the younger."""

    def __init__(self, find):
        self.find, self.older = find, {}

    def __missing__(self, text: str):
        out = self.older.get(text)
        if out is None:
            out = self.find(text)
        if len(text) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.older = dict(self)
                self.clear()
            self[text] = out
        return out


class _Reader:
    """A codec with what a worker remembers from one task to the next: (number of tokens, ids and labels as text)."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.words, self.pieces = _Known(self._word), _Known(self._piece)

    def _said(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), " ".join(map(str, ids)), self.codec.decode(ids)

    def _word(self, word: str) -> tuple[int, str, str]:
        ids = self.codec.automaton.ids
        return self._said([ids[t] for t in self.codec.automaton.encode(word.encode())])

    def _piece(self, piece: str) -> tuple[int, str, str]:
        found = []
        for k, part in enumerate(self.codec.cut(piece)):
            found += [self._said([self.codec.special[part]])] if k % 2 else [self.words[w] for w in words(normal(part))]
        if len(found) == 1:
            return found[0]
        return sum([x[0] for x in found]), " ".join([x[1] for x in found]), " ".join([x[2] for x in found])


def _reader(codec: Codec) -> _Reader:
    """The reader of a codec that came with a broadcast and lives as long as the worker."""
    if not hasattr(codec, "reader"):
        codec.reader = _Reader(codec)
    return codec.reader


def pieces(text: str) -> list[str]:
    """Runs without white space.  Python's own split knows four more blanks."""
    return _PIECES.findall(text) if re.search("[\x1c-\x1f]", text) else text.split()


def tokenized(docs: DataFrame, source: bytes, keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text, with `ids` and `decoded` if asked for.

    Null and empty texts have no tokens and the digests of nothing.  Rows are encoded one by one, whole and without a
    shuffle: repeated ids and null ids stay as they are, an empty table stays empty, other columns are dropped whatever
    their names.  Long pieces are read like short ones, in time that grows with their length.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    tables = spark.sparkContext.broadcast(Codec(source))  # size of the vocabulary, not of the data
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids, *["decoded"] * keep_text]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _reader(tables.value).pieces
        for batch in batches:
            counts, ids_of, texts_of, ids_digests, text_digests = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                found = [x for x in map(known.__getitem__, pieces(text or "")) if x[0]]
                ids, labels = " ".join([x[1] for x in found]), " ".join([x[2] for x in found])
                counts.append(sum([x[0] for x in found]))
                ids_digests.append(hashlib.sha256(ids.encode()).hexdigest())
                text_digests.append(hashlib.sha256(labels.encode()).hexdigest())
                if keep_ids:
                    ids_of.append([int(i) for i in ids.split()])
                if keep_text:
                    texts_of.append(labels)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(text_digests, pa.string())]
            columns += [pa.array(ids_of, pa.list_(pa.int32()))] * keep_ids + [pa.array(texts_of, pa.string())] * keep_text
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text
    return docs.select("doc_id", "text").mapInArrow(encode, schema)


def decoded(rows: DataFrame, source: bytes, ids: str = "ids") -> DataFrame:
    """`rows` with `decoded`, the labels of a column of ids; null stays null, an unknown id is a KeyError."""
    tables = rows.sparkSession.sparkContext.broadcast(Codec(source))  # size of the vocabulary, not of the data

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if i is None else tables.value.decode(i) for i in batch.column(ids).to_pylist()]
            kept = [c for c in batch.schema.names if c != "decoded"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(texts, pa.string())], names=[*kept, "decoded"])

    return rows.mapInArrow(decode, rows.drop("decoded").withColumn("decoded", F.lit(None).cast("string")).schema)
