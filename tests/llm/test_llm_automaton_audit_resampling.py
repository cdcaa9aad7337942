"""Ops 11 to 13: the tokenizers library, brute force and hand-made cases; nulls, repeats, long texts, clashing columns."""

import hashlib
import itertools
import json
import math
import random
import unicodedata
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioflow.llm import bpe_automaton, filter_audit, importance_resampling

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def source():
    with open(FILE, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def codec(source):
    return bpe_automaton.Codec(source)


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(FILE)
    found.no_truncation()
    found.no_padding()
    return found


def ids_of(codec, text):
    return [i for p in bpe_automaton.pieces(text) for i in codec.encode(p)]


# op 11


def plain_bpe(word, rules):
    """Merges in their order, each from left to right."""
    word = list(word[:-1]) + [word[-1] + "$"]
    for a, b in rules:
        i, out = 0, []
        while i < len(word):
            if word[i : i + 2] == [a, b]:
                out.append(a + b)
                i += 2
            else:
                out.append(word[i])
                i += 1
        word = out
    return word


@pytest.mark.parametrize("seed", range(30))
def test_gadgets_give_what_the_merges_give(seed):
    """Random merges over three letters, among them merges of a token with itself and merges that never apply."""
    r = random.Random(seed)
    tokens, rules = ["a", "b", "c", "a$", "b$", "c$"], []
    while len(rules) < 14:
        a, b = r.choice(tokens), r.choice(tokens)
        if not a.endswith("$") and a + b not in tokens:
            rules.append((a, b))
            tokens.append(a + b)
    labels = bpe_automaton.byte_labels()
    vocab = {t: i for i, t in enumerate([*labels, *(x + "$" for x in labels), *(a + b for a, b in rules)])}
    made = bpe_automaton.Automaton(vocab, rules, "$")
    for n in range(1, 8):
        for word in itertools.product("abc", repeat=n):
            assert [made.labels[t] for t in made.encode("".join(word).encode())] == plain_bpe(word, rules)


def test_merges_out_of_order_are_refused():
    labels = bpe_automaton.byte_labels()
    vocab = {t: i for i, t in enumerate([*labels, *(x + "$" for x in labels), "ab", "abc"])}
    with pytest.raises(ValueError):
        bpe_automaton.Automaton(vocab, [("ab", "c"), ("a", "b")], "$")


def test_random_texts_against_the_library(codec, library):
    r = random.Random(1)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "aeinrst", "ab", "'stremldvABC12 .", "éàüßñÅİΣςẞ中文日本語カナ가각　́̈̈́🎉👍🏽ا‍", "<|endoftext|>startof \x1c\x85᠎"]
    for _ in range(20_000):
        text = "".join(r.choice(r.choice(alphabets)) for _ in range(r.choice([1, 2, 3, 5, 8, 13, 40])))
        assert ids_of(codec, text) == library.encode(text, add_special_tokens=False).ids, text


def test_every_code_point_against_the_library(codec, library):
    """White space, letters, numbers, lower case and normal forms: all that is assigned, and the rest of planes 0 and 1."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x20000 or unicodedata.category(chr(c)) not in ("Cn", "Co"))]
    marks = [c for c in points if unicodedata.combining(c)]
    texts = [f"a{c}B{c}{c}1{c}̸ q́{c}x" for c in points] + [f"e{m}́ q{m}̖{m}" for m in marks]
    for begin in range(0, len(texts), 4096):
        part = texts[begin : begin + 4096]
        for text, want in zip(part, library.encode_batch(part, add_special_tokens=False)):
            assert ids_of(codec, text) == want.ids, ascii(text)


def test_tokenized_texts(documents, codec, library, source):
    rows = [(1, "Hello,  WORLD it's 2024!"), (2, None), (3, ""), (4, " \n\t"), (5, "ab" * 30_000), (6, "word " * 20_000), (7, "x<|endoftext|>y <|startoftext|>"), (8, "ΑΣ ΣΑΣ"), (8, "ΑΣ ΣΑΣ"), (None, "a b")]
    docs = documents(*rows).withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(-1))
    got = bpe_automaton.tokenized(docs, source, keep_ids=True, keep_text=True).collect()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    for r in got:
        text = next(t for i, t in rows if i == r.doc_id) or ""
        ids = library.encode(text, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), back)
        assert (r.ids_sha256, r.decoded_sha256) == (digest(" ".join(map(str, ids))), digest(back))
    assert bpe_automaton.tokenized(docs.limit(0), source).count() == 0


def test_decoding_of_a_column(spark, codec, library, source):
    ids = library.encode("Some words, twice", add_special_tokens=False).ids
    rows = spark.createDataFrame([(1, ids), (2, []), (3, None)], "k int, ids array<int>").withColumn("decoded", F.lit("clash"))
    got = {r.k: r.decoded for r in bpe_automaton.decoded(rows, source).collect()}
    assert got == {1: library.decode(ids, skip_special_tokens=False), 2: "", 3: None}


def test_files_of_another_kind_are_refused(source):
    file = json.loads(source)
    file["decoder"] = {"type": "ByteLevel"}
    with pytest.raises(ValueError):
        bpe_automaton.Codec(json.dumps(file).encode())


def test_query_against_the_library(spark, sf_dir, library):
    from folioflow.llm import queries

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op11_bpe_automaton(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# op 12


def plain_audit(rows, labels):
    """rows (doc_id, source, text): what every order removes, document by document."""
    first, fails = {}, []
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    for i, s, t in rows:
        t = t or ""
        w = [x for x in t.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
        f = {"A"} if len(w) < 50 else set()
        f |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        f |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t) else set()
        f |= {"D"} if any(c in "#$%&*|" for c in t) else set()
        f |= {"E"} if i is not None and i > first[t] else set()
        fails.append((s or "", f, i in good, i in toxic))
    out = {}
    for part in {f[0] for f in fails}:
        own, shapley = [f for f in fails if f[0] == part], Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, x in enumerate(order):
                gone = [f for f in left if x in f[1]]
                left = [f for f in left if x not in f[1]]
                shapley[x] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(x in f[1] for f in own) - len(gone), sum(f[1] == {x} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "MOST_PARTS", 2)
    r = random.Random(3)
    prose = lambda n: " ".join(r.choice("abcdefghij") + str(r.randrange(400)) for _ in range(n))
    rows = []
    for i in range(120):
        t = prose(r.choice([20, 60, 80]))
        t = r.choice([t, t, t.upper(), t + " #", "same words " * 40, prose(60), rows[-1][2] if rows else t])
        rows.append((i, r.choice(["a", "b", None, "", "é"]), t))
    rows += [(200, "a", None), (201, None, ""), (202, "z", "only one"), (7, "a", rows[7][2]), (None, "a", rows[3][2]), (300, "long", "W" + "ä " * 100_000 + " x" * 100_000), (301, "long", "W" + "ä " * 100_000 + " x" * 100_000)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 301, 2)] + [(4, 1, 0), (4, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*x, "x", 1) for x in rows], "doc_id long, source string, text string, part string, label int").repartition(5)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = plain_audit(rows, labels)
    assert {(x.part, x.filter_order, x.step): (x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley) for x in got} == want
    assert len(got) == len(want) == 600 * 6 and all(x.filter == x.filter_order[x.step - 1] for x in got)


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_table_of_masks_and_orders():
    assert filter_audit.FIRST.shape == (32, 120) and set(filter_audit.FIRST[0]) == {5} and filter_audit.ORDERS[0] == "ABCDE"
    assert [filter_audit.FIRST[0b10100, filter_audit.ORDERS.index(o)] for o in ("ABCDE", "EDCBA", "BADCE")] == [2, 0, 3]


# op 13


def plain_resample(docs, target, percent, buckets, longest, least):
    def feats(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in low).split(" ")
        w = [x for x in w if x]
        return len(w), [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in feats(x)[1]) for texts in ([d[1] for d in docs], target))
    su, tu = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (su + buckets) / ((s[b] + 1) * (tu + buckets))))
    out, open_ = [], []
    for i, text in docs:
        n, f = feats(text)
        weight, score = sum(gain(bucket(x)) for x in f), None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if n >= least:
                open_.append((-score, i))
        out.append((i, len(f), weight, score))
    drawn = Counter()
    for place, (_, i) in enumerate(sorted(open_)[: len(open_) * percent // 100], 1):
        drawn.setdefault(i, []).append(place)
    return sorted(((*row, drawn[row[0]].pop(0) if drawn.get(row[0]) else None) for row in out), key=str)


@pytest.mark.parametrize("longest, percent", [(1, 10), (2, 35), (1, 100)])
def test_resample_by_brute_force(spark, longest, percent):
    r = random.Random(8)
    prose = lambda n: " ".join(r.choice("abcdefgh") + r.choice("xyz") * r.randrange(3) for _ in range(n))
    rows = [(i, prose(r.choice([5, 19, 20, 40]))) for i in range(150)] + [(200 + i, "The SAME text, again and again: " * 5) for i in range(60)]
    rows += [(400, None), (401, ""), (402, "É-é x" * 9000), (403, "one"), (5, rows[5][1]), (None, rows[3][1]), (404, "  ")]
    target = [prose(30), None, "", "The same text", "É"]
    docs = spark.createDataFrame([(*x, 3, "x") for x in rows], "doc_id long, text string, n int, key string").repartition(6)
    aims = spark.createDataFrame([(x,) for x in target], "text string")
    got = importance_resampling.resample(docs, aims, percent=percent, buckets=97, longest=longest)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 5
    assert sorted((tuple(x) for x in got.collect()), key=str) == plain_resample(rows, target, percent, 97, longest, 20)


def test_resample_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    aims = spark.createDataFrame([], "text string")
    assert importance_resampling.resample(docs, aims).count() == 0
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [tuple(r)[:2] for r in importance_resampling.resample(some, aims, least_words=1, percent=100).collect()] == [(1, 3)]


def test_ranks_span_partitions(spark):
    from folioflow.llm.common import Scratch

    rows = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("score"))
    got = importance_resampling.ranked(rows, Scratch(spark), 900).where("rank is not null").orderBy("rank").collect()
    assert [(r.score, r.doc_id) for r in got] == sorted(((i % 7, i) for i in range(1000)), key=lambda x: (-x[0], x[1]))[:900]
    assert [r["rank"] for r in got] == list(range(1, 901))
