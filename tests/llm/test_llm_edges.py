"""Nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import itertools
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioflow.llm import embedding_dedup, language_id, minhash_dedup, mixing, template_lines, token_rollup, url_filters
from folioflow.llm.common import Scratch, connected_components
from folioflow.llm.conversations import maximal_conversations
from folioflow.llm.decontamination import contaminated
from folioflow.llm.embedding_dedup import embedding_components
from folioflow.llm.hashing import Chunk
from folioflow.llm.substring_dedup import substring_dedup

RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(5)) for _ in range(900)]


def text(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def test_ranges_hash_word_sequences():
    a, b = Chunk([b"x  y\tz w", None, b"", b"y z"]), Chunk([b"y z"])
    assert a.counts.tolist() == [4, 0, 0, 2]
    assert a.ranges(np.array([1, 4]), 2).tolist() == b.ranges(np.array([0]), 2).tolist() * 2
    assert a.windows(2).tolist() == [0, 1, 2, 4]


def test_substring_edges(documents):
    shared = text(60, 1)
    rows = [(1, shared), (2, "head words " + shared + " tail"), (3, None), (4, ""), (5, "a b " * 5000), (6, shared), (6, shared), (None, shared), (7, "x " * 49)]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(documents(*rows)).collect()))
    kept = {r[1]: r for r in got if not r[0]}
    assert kept[2][2:4] == (63, 60) and kept[2][4] == hashlib.sha256(b"head words tail").hexdigest()
    assert kept[1][3] == kept[3][3] == kept[4][3] == kept[5][3] == kept[7][3] == 0
    assert [r[2:4] for r in got if r[1] == 6] == [(60, 60)] * 2
    assert got[-1][2:4] == (60, 0)
    assert kept[3][4] == hashlib.sha256(b"").hexdigest()


def test_substring_spans_and_empty_table(documents, spark):
    shared = text(55, 2)
    got = {r.doc_id: r for r in substring_dedup(documents((1, shared), (2, f"{text(10, 3)} {shared} {text(4, 4)} {shared}")), keep_text=True).collect()}
    assert got[2].spans == [[10, 65], [69, 124]] and got[2].kept_text == f"{text(10, 3)} {text(4, 4)}"
    assert substring_dedup(documents((1, "x")).limit(0)).count() == 0


def brute_components(texts, percent=85):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(t, n, seed):
    r, w = random.Random(seed), t.split()
    for _ in range(n):
        w[r.randrange(len(w))] = r.choice(WORDS)
    return " ".join(w)


def test_near_copies_of_one_origin_by_brute_force(documents):
    """Copies edited to both sides of the threshold, in chains and stars."""
    origin = text(200, 9)
    rows = [(100 + i, edited(origin, 1 + i % 4, i)) for i in range(120)] + [(50, origin)]
    chain = text(150, 10)
    for i in range(12):
        rows.append((300 + i, chain))
        chain = edited(chain, 2, 1000 + i)
    rows += [(1, None), (2, ""), (3, "one two"), (4, "ONE  two"), (5, "three"), (6, origin.upper())]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.minhash_components(documents(*rows)).collect()}
    assert got == brute_components(rows)


def test_minhash_repeated_and_null_ids(documents):
    got = minhash_dedup.minhash_components(documents((1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "a b c"))).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert minhash_dedup.minhash_components(documents((1, "x")).limit(0)).count() == 0


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 2**63, 900, dtype=np.uint64)
    own = [np.concatenate((common, rng.integers(0, 2**63, 50, dtype=np.uint64))) for _ in range(2)]
    sketches = minhash_dedup.odd_sketch(minhash_dedup.minhash(np.concatenate(own), np.array([0, 950])))
    assert int(np.bitwise_count(sketches[0] ^ sketches[1]).sum()) <= minhash_dedup.most_bits(85)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.v: r.comp for r in connected_components(Scratch(spark), edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


@pytest.mark.parametrize("order", ["shuffled", "descending"])
def test_components_of_paths_in_any_order(spark, order):
    ids = list(range(1000))
    if order == "shuffled":
        random.Random(3).shuffle(ids)
    else:
        ids[1:] = ids[:0:-1]
    edges = spark.createDataFrame(list(zip(ids, ids[1:])) + [(2001, 2000)], "a long, b long")
    got = connected_components(Scratch(spark), edges).collect()
    assert len(got) == 1002 and {r.v: r.comp for r in got} == {i: 0 for i in range(1000)} | {2000: 2000, 2001: 2000}


def test_decontamination_edges(documents, spark):
    item = text(30, 20)
    bench = spark.createDataFrame([(1, item), (2, "two words"), (3, None), (4, ""), (5, text(12, 21))], "item_id long, text string")
    part = " ".join(item.split()[:24])
    rows = [(1, f"{text(5000, 22)} {item.upper()} {text(300, 23)}"), (2, part), (3, "Two  WORDS"), (4, "two words more"), (5, None), (6, ""), (7, " ".join(item.split()[:29])), (8, item), (8, item)]
    got = {(r.doc_id, r.item_id) for r in contaminated(documents(*rows), bench).collect()}
    assert got == {(1, 1), (7, 1), (8, 1), (3, 2)}
    assert contaminated(documents(*rows), bench.limit(0)).count() == 0
    assert contaminated(documents(*rows).limit(0), bench).count() == 0


def test_templates(documents):
    head = [(i, f"{text(8, i)}\nPage {i} of the monthly report\n{text(8, 100 + i)}") for i in range(12)]
    copies = [(50 + i, f"{text(8, 900)}\n{text(9, 901)}\n{text(8, 902)}") for i in range(15)]
    rows = head + copies + [(90, None), (91, ""), (92, "Page 7 of the monthly report"), (92, "Page 7 of the monthly report")]
    got = template_lines.drop_lines(documents(*rows)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[0].hits == "x"
    assert all(by[i].text == f"{text(8, i)}\n{text(8, 100 + i)}" and by[i].n_dropped == 1 for i in range(12))
    assert all(by[50 + i].n_dropped == 0 for i in range(15))
    assert (by[90].text, by[90].n_lines) == (None, 0) and (by[91].text, by[91].n_lines) == ("", 1)
    assert [r.text for r in got if r.doc_id == 92] == ["", ""]
    assert template_lines.drop_lines(documents((1, "x")).limit(0)).count() == 0


def test_blocks_of_boilerplate_lines(documents):
    """A header and a footer of two lines go, although each line has a fixed neighbour, and whatever is copied."""
    head, foot = f"{text(6, 800)}\n{text(6, 801)}", f"{text(5, 802)}\n{text(5, 803)}"
    rows = [(i, f"{head}\n{text(30, i)}\n\n{text(30, 200 + i)}\n{foot}") for i in range(14)]
    rows += [(100 + i, f"{head}\n{text(30, 500)}\n{text(30, 501)}\n{text(30, 502)}\n{foot}") for i in range(40)]
    rows += [(200 + i, "\n".join(text(8, 700 + k) if k != i % 20 else text(8, 1000 + i) for k in range(20))) for i in range(60)]
    got = {r.doc_id: (r.text, r.n_dropped) for r in template_lines.drop_lines(documents(*rows)).collect()}
    assert all(got[i] == (f"{text(30, i)}\n\n{text(30, 200 + i)}", 4) for i in range(14))
    assert all(got[100 + i] == (f"{text(30, 500)}\n{text(30, 501)}\n{text(30, 502)}", 4) for i in range(40))
    assert all(got[200 + i] == (dict(rows)[200 + i], 0) for i in range(60))


def test_short_boilerplate_lines(documents):
    rows = [(i, f"{text(9, i)}\nAll rights reserved.\n\n{text(9, 300 + i)}\nEnd") for i in range(12)]
    rows += [(50 + i, f"{text(9, 600)}\ncopied words\n{text(9, 601)}") for i in range(15)]
    got = {r.doc_id: (r.text, r.n_dropped) for r in template_lines.drop_lines(documents(*rows)).collect()}
    assert all(got[i] == (f"{text(9, i)}\n\n{text(9, 300 + i)}", 2) for i in range(12))
    assert all(got[50 + i] == (dict(rows)[50 + i], 0) for i in range(15))


def test_language_edges(documents):
    docs = documents((1, "the cat and the dog " * 20), (2, "le chat et les chiens " * 20))
    docs = docs.withColumn("lang", F.when(F.col("doc_id") == 1, "en").otherwise("fr"))
    profiles = language_id.train(docs.union(documents((3, None), (4, "12 !"))))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(documents((1, "THE DOG and the cat"), (2, "les chiens"), (3, None), (4, ""), (5, "123 -- !"), (6, "漢字"), (7, "the " * 100_000)), profiles).collect()}
    assert got[1][0] == got[7][0] == "en" and got[2][0] == "fr"
    assert got[3] == got[4] == got[5] == ("und", 0.0) and got[6][1] == 0.0
    assert language_id.predict(documents((1, "x")), {}).first().lang_pred == "und"


def test_embeddings_by_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 16))
    rows = [(i, (base[i % 30] + rng.standard_normal(16) * (0.02 if i % 3 else 0.06)).astype(np.float32).tolist(), int(i % 30 > 20)) for i in range(240)]
    rows += [(1000 + i, rows[5][1], 0) for i in range(30)] + [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] * 16, 0), (2003, [1.0, None] * 8, 0), (2004, rows[5][1], None), (2005, [1.0] * 3, 0), (2006, [], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), part=16).collect()}
    ok = {i: (np.array(np.float32(v), np.float64), label) for i, v, label in rows if i < 2000}
    links = {i: 0 for i, _, _ in rows}
    root = {i: i for i in links}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ok, 2):
        (x, lx), (y, ly) = ok[a], ok[b]
        if lx == ly and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
            links[a] += 1
            links[b] += 1
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    assert got == {i: (links[i], find(i)) for i in links}


def test_url_intervals(spark):
    captures = spark.createDataFrame([(1, "http://a.b.com/x", "2024-01-05"), (2, "https://u:p@A.B.com:80/", "2024-02-05"), (3, "http://c.com", "2024-01-05"), (4, "no url", "2024-01-05"), (5, None, None), (6, "http://b.com", "2024-01-01")], "page_id long, url string, d string").withColumn("fetched_at", F.to_date("d"))
    entries = spark.createDataFrame([("B.com", "2024-01-02", "block"), ("a.b.com", "2024-02-01", "allow"), ("a.b.com", "2024-02-01", "block"), ("c.com", "2024-01-03", "block"), ("c.com", "2024-01-05", "allow"), (None, "2024-01-01", "block")], "domain string, d string, action string").withColumn("listed_at", F.to_date("d"))
    got = {r.page_id: (r.domain, r.action) for r in url_filters.judge(captures, entries).collect()}
    assert got == {1: ("b.com", "block"), 2: ("a.b.com", "block"), 3: ("c.com", "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow")}
    assert url_filters.judge(captures, entries.limit(0)).count() == 6


def test_rollup_is_idempotent_and_signed(documents, spark):
    rollup = token_rollup.Rollup(spark, f"{Scratch(spark).base}/r")
    docs = documents((1, "a b c"), (2, None), (3, "")).withColumn("tokens", token_rollup.count_words())
    assert rollup.totals().count() == 0
    assert rollup.commit("1", token_rollup.changes(docs, "w")) and not rollup.commit("1", token_rollup.changes(docs, "w"))
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "w", 3, 3, 5)]
    rollup.commit("2", token_rollup.changes(docs.where("doc_id = 1"), "w", -1))
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "w", 2, 0, 0)]
    assert rollup.batches() == ["1", "2"]


@pytest.mark.parametrize("seed", range(12))
def test_knapsack_is_exact_where_it_can_be(seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(1, 60, 6))
    counts = rng.integers(1, 4, len(lengths))
    sums = {0}
    for w, c in zip(lengths.tolist(), counts.tolist()):
        sums = {s + k * w for s in sums for k in range(c + 1)}
    for budget in rng.integers(0, int(lengths @ counts) + 1, 15).tolist():
        take = mixing.fit(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        near = min(abs(s - budget) for s in sums)
        assert abs(int(lengths @ take) - budget) == near


@pytest.mark.parametrize("lengths, counts, budget, near", [([100_000], [10], 570_000, 600_000), ([60_000, 100_000], [3, 3], 250_000, 260_000), ([5, 100_000], [1, 10], 570_000, 600_000)])
def test_knapsack_of_long_documents(lengths, counts, budget, near):
    take = mixing.fit(np.array(lengths), np.array(counts), budget)
    assert (take <= counts).all() and int(np.array(lengths) @ take) == near


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Targets in exact fractions, round by round."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: Fraction(weights[i % 3]) for i, s in enumerate(order)}
    done = {}
    while True:
        rest = [s for s in order if s not in done]
        left = sum(sizes.values()) - sum(done.values())
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s]]
        if not over:
            return {s: float(x) for s, x in (done | share).items()}
        done |= {s: Fraction(most * sizes[s]) for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 500}, {}, {None: 7}, {"a": 0, "b": 0}, {f"{i % 7}x{i}é\U0001f600"[i % 2 :]: 3**i % 1009 for i in range(90)}, {"\uffee": 1, "\U00010000": 900, "z": 40}])
def test_targets_reshare_excess(spark, sizes):
    spread = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(3)
    got = {r.source: r.target for r in mixing.targets(spread, Scratch(spark)).collect()}
    assert got == pytest.approx(plain_targets(sizes)) and len(got) == len(sizes)


def test_mix_edges(documents, spark):
    rows = documents((1, "a b"), (2, "a b"), (2, "a b"), (3, None), (4, ""), (None, "a b c")).withColumn("source", F.when(F.col("doc_id") == 2, None).otherwise(F.col("source")))
    got = mixing.mix(rows).collect()
    assert len(got) == 6 and all(r.taken <= 3 * r["size"] for r in got)
    assert mixing.mix(rows.limit(0)).count() == 0


def test_a_length_that_all_share(documents):
    rows = [(i, "one two three") for i in range(700)]
    docs = documents(*rows).withColumn("source", F.when(F.col("doc_id") < 600, "a").otherwise("b"))
    got = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w")).collect()
    assert all(abs(r.t - r.w) <= 3 for r in got)


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "bot", "yo"), (4, 0, "user", "ho"), (5, 0, None, None), (None, 0, "user", "hi"), (6, 1, "bot", "yo"), (6, 0, "user", "hi"), (6, 2, "user", "ok"), (4, 0, "user", "ho")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in maximal_conversations(turns).collect()}
    assert got == {6: (3, 1, "<|user|>\nhi\n<|bot|>\nyo\n<|user|>\nok"), 4: (2, 1, "<|user|>\nho\n<|user|>\nho"), 5: (1, 1, "<|unknown|>\n")}
    assert maximal_conversations(turns.limit(0)).count() == 0


# Round 2: hostile words, block boilerplate, long lengths, salts, and the cases each docstring names


def thue_morse(flip):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(1024))


def test_a_word_that_defeats_polynomial_hashes(documents):
    common = text(50, 60).split()
    rows = [(i, " ".join([*common[:25], thue_morse(i), *common[25:49]])) for i in (0, 1)]
    assert [r.n_removed for r in substring_dedup(documents(*rows)).collect()] == [0, 0]
    linked = [(i, " ".join([*text(46, 61).split()[:23], thue_morse(i), *text(46, 61).split()[23:]])) for i in (0, 1)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.minhash_components(documents(*linked)).collect()}
    assert got == brute_components(linked) == {0: (43, 0), 1: (43, 1)}


def test_exact_shingles_number_word_sequences():
    a = Chunk([b"a b c d e f a b c d e", b"b c d e f", b"a b", None, b"a  b", b"ab", b"x b c d e f"])
    docs, ids = a.exact_shingles()
    sets = [set(ids[docs == d].tolist()) for d in range(7)]
    assert [len(x) for x in sets] == [6, 1, 1, 0, 1, 1, 2]
    assert sets[1] < sets[0] and sets[1] < sets[6] and sets[2] == sets[4] != sets[5] and not sets[2] & sets[0]


def test_substring_of_texts_longer_than_a_chunk_and_negative_ids(documents):
    shared, long = text(70, 70), " ".join(f"w{i}" for i in range(420_000))
    rows = [(-5, shared), (3, f"{long} {shared} {long[:100]}"), (8, shared)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup(documents(*rows)).collect()}
    assert len(rows[1][1]) > 2 << 20
    assert got[-5] == (70, 0) and got[8] == (70, 70) and got[3][1] == 70


def test_minhash_of_a_hot_bucket_in_small_blocks(documents, monkeypatch):
    """A shared frame puts all in common buckets; families in it are linked below the stars."""
    monkeypatch.setattr(minhash_dedup, "SKETCH_BLOCK", 7)
    monkeypatch.setattr(minhash_dedup, "WORD_BLOCK", 3)
    monkeypatch.setattr(minhash_dedup, "PART_SHINGLES", 400)
    frame, rows = text(150, 80), []
    for family in range(12):
        own = text(45, 8000 + family)
        for i in range(6):
            rows.append((family * 10 + i, frame + " " + edited(own, i % 4, family * 100 + i)))
    rows.append((999, " ".join(f"z{i}" for i in range(300_000))))
    rows.append((998, rows[-1][1] + " tail"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.minhash_components(documents(*rows)).collect()}
    assert got == brute_components(rows)


def test_minhash_of_an_id_with_several_texts(documents):
    a, b = text(120, 90), text(120, 91)
    got = minhash_dedup.minhash_components(documents((1, a), (1, b), (2, edited(a, 1, 1)), (3, edited(b, 1, 2)))).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1)} and len(got) == 4


def test_a_licence_of_five_lines_goes_whole(documents):
    licence = "\n".join(text(9, 1200 + k) for k in range(5))
    rows = [(i, f"{text(20, 5000 + i)}\n{licence}\n{text(7, 6000 + i)}") for i in range(40)]
    rows += [(100 + i, f"{text(12, 7000)}\n{text(12, 7001)}\n{licence}") for i in range(3)]
    rows.append((200, licence + "\n" + "x " * 400_000 + "\n" + text(3, 1)))
    got = {r.doc_id: (r.text, r.n_dropped) for r in template_lines.drop_lines(documents(*rows)).collect()}
    assert all(got[i] == (f"{text(20, 5000 + i)}\n{text(7, 6000 + i)}", 5) for i in range(40))
    assert all(got[100 + i][1] == 5 for i in range(3)) and got[200][1] == 5


def test_templates_at_the_threshold_of_documents(documents):
    nine = [(i, f"{text(9, i)}\nexactly nine of these\n{text(9, 50 + i)}") for i in range(9)]
    ten = [(100 + i, f"{text(9, 400 + i)}\nexactly ten of those\n{text(9, 450 + i)}") for i in range(10)]
    got = {r.doc_id: r.n_dropped for r in template_lines.drop_lines(documents(*nine, *ten)).collect()}
    assert all(got[i] == 0 for i in range(9)) and all(got[100 + i] == 1 for i in range(10))


def test_lines_joined_by_shuffles(documents, monkeypatch):
    from folioflow.llm import common

    rows = [(i, f"{text(9, i)}\nPage {i} of many\n{text(9, 100 + i)}") for i in range(15)]
    want = sorted((r.doc_id, r.text) for r in template_lines.drop_lines(documents(*rows)).collect())
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted((r.doc_id, r.text) for r in template_lines.drop_lines(documents(*rows)).collect()) == want


def test_letters_of_all_planes(documents):
    got = {r.doc_id: r.lang_pred for r in language_id.predict(documents((1, "\U00030000\U00030001"), (2, "\U0001f600 12")), {"en": [1, 2]}).collect()}
    assert got == {1: "en", 2: "und"}
    assert language_id.predict(documents((1, "x")).limit(0), {"en": [1]}).count() == 0
    assert language_id.train(documents((1, "x")).limit(0)) == {}


def plain_language(docs, length=400):
    """Profiles and predictions with strings and dictionaries."""
    import unicodedata

    def grams(t):
        out = {}
        letters = "".join((c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] == "L" else " " for c in t)
        for w in letters.split():
            padded = f" {w} "
            for n in (1, 2, 3):
                for k in range(len(padded) - n + 1):
                    if (g := padded[k : k + n]).strip():
                        out[g] = out.get(g, 0) + 1
        return out

    def ranking(counts):
        code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
        return {g: k for k, g in enumerate(sorted(counts, key=lambda g: (-counts[g], code(g)))[:length])}

    total = {}
    for i, t, lang in docs:
        if lang is not None and t is not None and zlib.crc32(str(i).encode()) % 5:
            for g, n in grams(t).items():
                own = total.setdefault(lang, {})
                own[g] = own.get(g, 0) + n
    profiles = {lang: ranking(c) for lang, c in sorted(total.items())}
    out = {}
    for i, t, _ in docs:
        own = ranking(grams(t or ""))
        far = {lang: sum(abs(p[g] - k) if g in p else length for g, k in own.items()) for lang, p in profiles.items()}
        best = min(far, key=far.get) if own and far else None
        out[i] = (best, 1 - far[best] / (length * len(own))) if best else ("und", 0.0)
    return out


def test_language_by_plain_version(spark, sf_dir):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs = spark.createDataFrame([*rows, (10**6, None, "en"), (10**6 + 1, "", None)], "doc_id long, text string, lang string")
    profiles = language_id.train(docs.where(~language_id.held_out()))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, profiles).collect()}
    want = plain_language([*rows, (10**6, None, "en"), (10**6 + 1, "", None)])
    assert {i: p for i, (p, _) in got.items()} == {i: p for i, (p, _) in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1]) for i in want)


def test_embedding_comparisons_fall_with_the_table():
    import pyarrow as pa

    def share(n):
        x, met = np.random.default_rng(n).standard_normal((n, 64)), [0]
        for b in range(8):
            columns = {"label": ["a"] * n, "dims": np.full(n, 64, np.int32), "block": np.full(n, b, np.int32), "cell": [b""] * n, "p": np.zeros(n, np.int32), "visits": np.zeros(n, np.int32), "v": np.arange(n), "copies": np.ones(n, np.int64), "embedding": list(x)}
            batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))
            list(embedding_dedup._join(0.98, 0.04, 8, lambda k: met.__setitem__(0, met[0] + k))(iter([batch])))
        return met[0] / n**2

    few, many = share(1000), share(4000)
    assert many < 0.05 and many < few


@pytest.mark.parametrize("part", [8192, 16])
def test_embedding_edges(spark, part):
    v = [0.1 * k - 0.7 for k in range(16)]
    rows = [(1, v, "a"), (1, v, "a"), (2, [x * 1e200 for x in v], "a"), (3, [x * 1e-200 for x in v], "a"), (None, v, "a"), (4, [-x for x in v], "a"), (5, v, "b")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label string, block string")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embedding_components(table, part=part).collect())
    assert got == [(0, 0, 0, True), (1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 0, 4, True), (5, 0, 5, True)]
    assert embedding_components(table.limit(0)).count() == 0


def test_url_edges(spark):
    day = lambda df: df.withColumn("fetched_at" if "url" in df.columns else "listed_at", F.to_date("d"))
    captures = day(spark.createDataFrame([(1, "http://10.0.0.1/x", "2024-01-05"), (2, "http://[2001:db8::1]:80/", "2024-01-05"), (3, "http://a.com/" + "x" * 200_000, "2024-01-05"), (3, "http://a.com/", "2024-01-05"), (4, "http://a.com", "2023-01-01")], "page_id long, url string, d string")).withColumn("domain", F.lit("clash"))
    entries = day(spark.createDataFrame([("0.1", "2024-01-01", "block"), ("a.com", "2024-01-01", "block"), ("[2001:db8::1]", "2024-01-02", "block")], "domain string, d string, action string"))
    got = sorted((r.page_id, r.domain or "", r.action) for r in url_filters.judge(captures, entries).collect())
    assert got == [(1, "", "allow"), (2, "[2001:db8::1]", "block"), (3, "a.com", "block"), (3, "a.com", "block"), (4, "", "allow")]
    assert url_filters.judge(captures.limit(0), entries).count() == 0


def test_url_filters_by_brute_force(spark):
    import datetime as dt

    r = random.Random(2)
    date = lambda: dt.date(2024, 1, 1) + dt.timedelta(r.randrange(40))
    entries = list({(d, at): (d, at, r.choice(["allow", "block"])) for d in ("a.com", "x.a.com", "y.x.a.com", "b.org") for at in (date() for _ in range(12))}.values())
    captures = [(i, f"http://{r.choice(['a.com', 'x.a.com', 'y.x.a.com', 'z.y.x.a.com', 'b.org', 'ba.com'])}/{i}", date()) for i in range(300)]
    got = {x.page_id: (x.domain, x.action) for x in url_filters.judge(spark.createDataFrame(captures, "page_id long, url string, fetched_at date"), spark.createDataFrame(entries, "domain string, listed_at date, action string")).collect()}
    for i, url, at in captures:
        host = url.split("/")[2]
        met = [(len(d), since, d, a) for d, since, a in entries if (host == d or host.endswith("." + d)) and since <= at]
        assert got[i] == ((max(met)[2], max(met)[3]) if met else (None, "allow"))


def test_rollup_edges(documents, spark):
    rollup = token_rollup.Rollup(spark, f"{Scratch(spark).base}/r2")
    docs = documents((1, "a b"), (1, "a b"), (2, "x " * 300_000), source=None).withColumn("tokens", token_rollup.count_words()).withColumn("sign", F.lit("clash")).withColumn("chars", F.lit(-1))
    rollup.compact()
    assert rollup.commit("0", token_rollup.changes(docs.limit(0), "w")) and rollup.totals().count() == 0
    rollup.commit("1", token_rollup.changes(docs, "w"))
    want = [(None, "en", "w", 3, 300_004, 600_006)]
    assert [tuple(r) for r in rollup.totals().collect()] == want
    rollup.compact()
    assert [tuple(r) for r in rollup.totals().collect()] == want and not rollup.commit("1", token_rollup.changes(docs, "w"))
    rollup.commit("2", token_rollup.changes(docs.where("doc_id = 1"), "w", -1))
    assert [tuple(r) for r in rollup.totals().collect()] == [(None, "en", "w", 1, 300_000, 600_000)]
    # as many documents as before, but fewer tokens
    rollup.commit("3", token_rollup.changes(docs.where("doc_id = 2"), "w", -1).unionByName(token_rollup.changes(docs.where("doc_id = 2").withColumn("tokens", F.lit(7)), "w")))
    rollup.compact()
    assert [tuple(r) for r in rollup.totals().collect()] == [(None, "en", "w", 1, 7, 600_000)]


def test_a_commit_that_cannot_be_is_an_error(documents, spark):
    rollup = token_rollup.Rollup(spark, f"{Scratch(spark).base}/r3")
    rollup._fs = type("Refuses", (), {"exists": lambda self, p: False, "rename": lambda self, a, b: False, "delete": lambda self, p, r: True})()
    with pytest.raises(OSError):
        rollup.commit("1", token_rollup.changes(documents((1, "a")).withColumn("tokens", F.lit(1)), "w"))


@pytest.mark.parametrize("seed", range(4))
def test_knapsack_of_lengths_to_60000(seed):
    rng, missed = np.random.default_rng(100 + seed), 0
    for _ in range(50):
        lengths = np.unique(rng.integers(5_000, 60_000, rng.integers(1, 7)))
        counts = rng.integers(1, 4, len(lengths))
        sums = {0}
        for w, c in zip(lengths.tolist(), counts.tolist()):
            sums = {s + k * w for s in sums for k in range(c + 1)}
        budget = int(rng.choice(sorted(sums))) if rng.random() < 0.5 else int(rng.integers(0, int(lengths @ counts) + 1))
        take = mixing.fit(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        missed += int(lengths @ take) != min(sums, key=lambda s: (abs(s - budget), s > budget))
    assert missed == 0
    assert int(np.array([30_000, 70_000]) @ mixing.fit(np.array([30_000, 70_000]), np.array([5, 5]), 140_000)) == 140_000


def test_mix_by_brute_force(documents):
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 2, 7, 40, 900])), r.choice(["a", "b", "é", None])) for i in range(120)] + [(500, "v " * 250_000, "a")]
    docs = documents(*[(i, t) for i, t, _ in rows]).drop("source").join(documents().sparkSession.createDataFrame([(i, s) for i, _, s in rows], "doc_id long, source string"), "doc_id")
    got = mixing.mix(docs.withColumn("target", F.lit("clash"))).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = plain_targets(sizes)
    assert len(got) == len(rows) and all(x.target == pytest.approx(want[x.source]) and x.source_size == sizes[x.source] for x in got)
    for s in sizes:
        own = sorted(x["size"] for x in got if x.source == s)
        rounds, budget = divmod(round(want[s]), sizes[s])
        bits = 1
        for n in own:
            bits |= bits << n
        nearest = min((k for k in range(sizes[s] + 1) if bits >> k & 1), key=lambda k: (abs(k - budget), k > budget))
        assert sum(x.taken for x in got if x.source == s) == rounds * sizes[s] + nearest


def test_conversation_edges(spark):
    rows = [(1, 0, "user", "hi"), (1, None, "user", "first"), (2, 0, "user", "hi <|bot|> <\\|x"), (2, 1, "<|r", "z"), (None, 0, "user", "lost")]
    rows += [(3, k, "user", f"t{k}") for k in range(3000)] + [(4, k, "user", f"t{k}") for k in range(2999)] + [(5, 0, "a", "x"), (5, 0, "a", "w"), (6, 0, "a", "w")]
    turns = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, n string")
    got = {r.conv_id: (r.n_turns, r.rendered) for r in maximal_conversations(turns).collect()}
    assert sorted(got) == [1, 2, 3, 5] and got[3][0] == 3000
    assert got[1][1] == "<|user|>\nfirst\n<|user|>\nhi"
    assert got[2][1] == "<|user|>\nhi <\\|bot|> <\\\\|x\n<|<\\|r|>\nz"


def test_decontamination_repeats_and_null_ids(documents, spark):
    item = text(20, 30)
    bench = spark.createDataFrame([(None, item, 1), (1, item, 1), (1, item, 1), (2, item, 1)], "item_id long, text string, n long")
    got = contaminated(documents((1, item), (1, item), (None, item), (2, text(20, 31))), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.n_shared) for r in got) == [(1, 1, 16), (1, 2, 16)]


# Round 3: the last step of the table of sums, products beyond 63 bits, a commit while levels are written


@pytest.mark.parametrize("budget, misses", [(700_000_777, 343), (1_000_000_333, 1_447)])
def test_the_table_of_sums_grows_to_its_bound(budget, misses):
    lengths, counts = np.array([1_000_003, 2_000_003, 5_000_011]), np.array([300, 300, 300])
    take = mixing.fit(lengths, counts, budget)
    assert (take >= 0).all() and (take <= counts).all() and abs(int(lengths @ take) - budget) == misses


def test_targets_of_sources_beyond_63_bits(spark):
    """10^13 words in one source of many: sizes times weights pass 2^63."""
    sizes = {"a": 10**13} | {f"b{i:06}": 1 + i % 5 for i in range(300_000)}
    rows = spark.range(300_001).select(F.when(F.col("id") == 0, "a").otherwise(F.format_string("b%06d", F.col("id") - 1)).alias("source"), F.when(F.col("id") == 0, 10**13).otherwise(1 + (F.col("id") - 1) % 5).alias("source_size"))
    got = mixing.targets(rows, Scratch(spark))
    small = sum(3 * n for s, n in sizes.items() if s != "a")
    assert got.where("source = 'a'").first().target == 10**13 + sum(sizes.values()) - 10**13 - small
    assert got.where("source <> 'a'").where(F.col("target") != 3 * F.col("source_size")).isEmpty()


def test_a_commit_while_compacting_counts_once(documents, spark):
    rollup = token_rollup.Rollup(spark, f"{Scratch(spark).base}/r")
    docs = documents((1, "a b c"), (2, "d e " * 5), (3, "f")).withColumn("tokens", token_rollup.count_words())
    for i in (1, 2):
        rollup.commit(str(i), token_rollup.changes(docs.where(F.col("doc_id") == i), "w"))
    listed = rollup.batches

    def and_another_comes():
        names = listed()
        rollup.batches = listed
        rollup.commit("3", token_rollup.changes(docs.where("doc_id = 3"), "w"))
        return names

    rollup.batches = and_another_comes
    rollup.compact()
    assert [(r.docs, r.tokens) for r in rollup.totals().collect()] == [(3, 14)] and rollup.batches() == ["1", "2", "3"]
    rollup.compact()
    rollup.commit("4", token_rollup.changes(docs.where("doc_id = 3"), "w", -1))
    assert [(r.docs, r.tokens) for r in rollup.totals().collect()] == [(2, 13)]


def test_equal_sets_of_different_texts_are_linked_by_their_words(documents, monkeypatch):
    """Even if all shingle hashes collide, texts of one shingle each are told apart."""
    loop = text(12, 70)
    rows = [(1, f"{loop} {loop}"), (2, f"{loop} {loop} {loop}"), (3, f"{loop}  {loop}".upper()), (4, "a b c d e"), (5, "b a c d e"), (6, "a b c d e"), (7, "x"), (8, "y"), (9, "x y " * 60_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.minhash_components(documents(*rows)).collect()}
    assert got == brute_components(rows) and got[2][1] == got[3][1] == 1
    words = [b"a b c d e", b"b a c d e", b"A B  c d e", b"", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(words, pa.string())], names=["doc_id", "text"])
    monkeypatch.setattr(Chunk, "ranges", lambda self, start, n, which=0: np.zeros(len(start), np.uint64))
    keys = [(r["k1"], r["k2"]) for out in minhash_dedup._sketch(iter([batch])) for r in out.to_pylist()]
    assert keys[0] == keys[2] != keys[1]


def test_profiles_of_many_languages_are_a_table(documents, spark):
    """Held or joined, profiles give the same: ties, texts without letters or anything known, repeated rows."""
    r = random.Random(11)
    tongues = {f"l{k:02}": ["".join(r.choice("abcdefghijklmno"[k % 7 : k % 7 + 8]) for _ in range(r.randint(2, 6))) for _ in range(40)] for k in range(12)}
    say = lambda k, n: " ".join(r.choice(tongues[k]) for _ in range(n))
    rows = [(i, say(f"l{i % 12:02}", r.choice([3, 40, 200]))) for i in range(96)]
    docs = documents(*rows).withColumn("lang", F.format_string("l%02d", F.col("doc_id") % 12))
    held, table = language_id.train(docs, length=60), language_id.train(docs, length=60, most=5)
    assert isinstance(held, dict) and {(x.lang, x.code): x["rank"] for x in table.collect()} == {(k, c): i for k, cs in held.items() for i, c in enumerate(cs)}
    asked = documents(*rows, (200, None), (201, ""), (202, "12 -"), (203, "漢字"), (5, rows[5][1]), (None, rows[3][1]), (204, "the " * 30_000))
    by = lambda df: sorted((str(x.doc_id), x.lang_pred, x.score) for x in df.collect())
    want = by(language_id.predict(asked, held, length=60))
    assert by(language_id.predict(asked, table, length=60)) == want and len(want) == 103
    both = language_id.annotate(asked, table, length=60)
    assert by(both) == want and both.columns == [*asked.columns, "lang_pred", "score"]
    assert language_id.predict(asked.limit(0), table, length=60).count() == 0
