"""Operators on small vectors."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from folioflow.functions import draws
from folioflow.functions import text as T
from folioflow.functions.tables import Tables
from folioflow.functions.text import normalise, paragraphs
from folioflow.operators import alignment, audit, dedup, grading, pii, profile, sampling, scoring, stats, structure
from folioflow.operators.graph import connected_components
from folioflow.plans import registry


def one(df):
    return df.collect()[0]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("call 555-123-4567 now", (0, 1, 0, 0, False)),
        ("ssn 123-45-6789", (0, 0, 1, 0, False)),
        ("card 4111111111111111", (0, 0, 0, 1, False)),
        ("mail a@example.com", (0, 0, 0, 0, True)),
        ("mail a@mail5.example.com", (1, 0, 0, 0, False)),
        ("street 555\n123 4567", (0, 1, 0, 0, False)),
        ("plain words", (0, 0, 0, 0, True)),
    ],
)
def test_pii(spark, text, expected):
    r = one(pii.scan(spark.createDataFrame([(1, text)], "doc_id int, text string")))
    assert (r.real_email_count, r.phone_count, r.ssn_count, r.long_digit_count, r.clean) == expected


def test_pii_null_text_has_no_verdict(spark):
    scanned = pii.scan(spark.createDataFrame([(1, None), (2, "ok")], "doc_id int, text string"))
    r = one(pii.summarise(scanned))
    assert (r.file_count, r.clean_count, r.error_count) == (2, 1, 1)


@pytest.mark.parametrize("m, g, c, expected", [(0, 0, 0, (1.0, None, None)), (0, 2, 0, (0.0, 0.0, None)), (0, 0, 3, (0.0, None, None)), (0, 2, 2, (0.0, 0.0, None)), (1, 2, 4, (0.25, 0.5, 1 / 3))])
def test_prf1_nulls(spark, m, g, c, expected):
    r = one(spark.range(1).select(*[v.alias(k) for k, v in T.prf1(F.lit(m), F.lit(g), F.lit(c)).items()]))
    assert tuple(r) == pytest.approx(expected)


def test_token_f1_convention(spark):
    rows = spark.createDataFrame([(0, 0, 0), (0, 1, 0), (0, 1, 1), (1, 1, 1)], "m int, g int, c int")
    assert [r[0] for r in rows.select(T.token_f1(F.col("m"), F.col("g"), F.col("c"))).collect()] == [1.0, 0.0, 0.0, 1.0]


def test_reading_order_reversal_and_random(spark):
    rng = random.Random(3)
    cases = [[2, 1, 0], [0], [0, 1, 2, 3]] + [rng.sample(range(12), 12) for _ in range(20)]
    rows = [(d, g, c) for d, order in enumerate(cases) for g, c in enumerate(order)]
    got = {r.d: r for r in scoring.reading_order(spark.createDataFrame(rows, "d int, g int, c int"), "d").collect()}
    for d, order in enumerate(cases):
        naive = sum(order[i] > order[j] for i in range(len(order)) for j in range(i + 1, len(order)))
        assert got[d].discordant == naive == alignment.inversions(order)
    assert (got[0].matched, got[0].accuracy) == (3, 0.0)
    assert got[1].accuracy is None


def test_kth_duplicate_pairs_with_kth(spark):
    side = spark.createDataFrame([(1, "a", 0), (1, "a", 1), (1, "b", 2)], "doc int, t string, pos int")
    other = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "a", 2), (1, "a", 3)], "doc int, t string, pos int")
    assert sorted((r.g, r.c) for r in scoring.kth_matches(side, other, "doc", "t", "pos").collect()) == [(0, 1), (1, 2), (2, 0)]


def test_alignment_of_long_documents_and_fuzzy(spark):
    paragraphs = [f"paragraph number {i} with words" for i in range(400)]
    sides = spark.createDataFrame([(1, paragraphs, paragraphs[::-1]), (2, [], []), (3, ["alpha beta gamma"], ["alpha beta gamme"])], "doc int, gold array<string>, cand array<string>")
    got = {r.doc: r for r in alignment.fuzzy_order(sides, "doc").collect()}
    assert got[1].accuracy == 0.0 and got[1].matched == 400
    assert got[2].status == "undefined" and got[3].matched == 1
    assert {r.doc: r.matched for r in alignment.align(sides, "doc").collect()} == {1: 1, 2: 0, 3: 0}
    assert alignment.fuzzy_matches(["a" * 9] * 700, ["b" * 9] * 700) == ([], False)
    same = [f"same {i}" for i in range(5)]
    far = spark.createDataFrame([(1, [*same, *["a" * 9] * 700], ["b" * 9] * 700 + same), (2, ["x", *["a" * 9] * 700], ["x", *["b" * 9] * 700])], "doc int, gold array<string>, cand array<string>")
    got = {r.doc: (r.matched, r.discordant, r.accuracy, r.status) for r in alignment.fuzzy_order(far, "doc").collect()}
    assert got == {1: (5, 0, 1.0, "exact_only"), 2: (1, 0, None, "undefined")}


def test_label_accuracy_states(spark):
    gold = spark.createDataFrame([(1, 1, "x"), (1, 2, None), (2, 1, "x")], "doc int, pos int, v string")
    cand = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (3, 1, "x")], "doc int, pos int, v string")
    got = {r.doc: (r.accuracy, r.status) for r in scoring.label_accuracy(gold, cand, ["doc", "pos"], "v").collect()}
    assert got == {1: (0.5, "scored"), 2: (None, "undefined: no_candidate"), 3: (None, "not_applicable: no_gold_ground_truth")}


def test_capability_gate_keeps_rows(spark):
    scores = spark.createDataFrame([("a", "order", 0.5), ("b", "order", 0.7)], "system string, metric string, value double")
    able = spark.createDataFrame([("a", "order", True)], "system string, metric string, capable boolean")
    got = {r.system: (r.value, r.status) for r in scoring.capability_gate(scores, able).collect()}
    assert got == {"a": (0.5, "scored"), "b": (None, "not_applicable: unsupported")}


@pytest.mark.parametrize("values, method", [([1.0] * 20, "exact_boundary"), ([0.0] * 20, "exact_boundary"), ([1.0] * 18 + [0.0] * 2, "percentile"), ([0.5], "undefined"), ([0.5] * 4, "percentile")])
def test_bootstrap_methods(spark, values, method):
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)], "g string, i int, v double")
    r = one(stats.bootstrap_ci(Tables(spark), df, ["g"], "v", replicates=100))
    assert r.method == method and r.n == len(values)
    if method == "exact_boundary":
        edge = round(0.025 ** (1 / 20), 6)
        assert (r.low, r.high) == ((edge, 1.0) if values[0] else (0.0, round(1 - 0.025 ** (1 / 20), 6)))
    elif method == "undefined":
        assert r.low is None and r.high is None
    else:
        assert r.low <= r.mean <= r.high


def test_bootstrap_skips_nulls_and_ignores_partitioning(spark):
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate([1.0, None, 0.0, None, 1.0])], "g string, i int, v double")
    a, b = (one(stats.bootstrap_ci(Tables(spark), df.repartition(n), ["g"], "v", replicates=60)) for n in (1, 7))
    assert a == b and a.n == 3


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_places_follow_the_order_in_every_group(spark, kind):
    rng = random.Random(5)
    rows = [(g, rng.randint(-50, 10**6) if i % 3 else i, rng.random() if i % 7 else None) for g in ("a", "b", None) for i in range(900)] + [("c", 4, 1.0), ("d", 1, None)]
    df = spark.createDataFrame(rows, "g string, o long, x double")
    found = {}
    for r in stats.placed(df.withColumn("o", df.o.cast(kind)), ["g"], "x", "o").collect():
        found.setdefault(r.g, {})[r.k] = r.x
        assert r.n == sum(g == r.g and x is not None for g, _, x in rows)
    key = (lambda o: str(o)) if kind == "string" else (lambda o: o)
    for group in ("a", "b", None, "c"):
        wanted = [x for _, x in sorted((key(o), x) for g, o, x in rows if g == group and x is not None)]
        assert [found[group][k] for k in range(len(found[group]))] == wanted
    assert "d" not in found


def test_permutation_drops_half_pairs(spark):
    df = spark.createDataFrame([("g", i, a, b) for i, (a, b) in enumerate(zip([1.0, None, 1.0, 1.0], [0.0, 0.0, None, 0.0]))], "g string, i int, a double, b double")
    assert one(stats.permutation_test(Tables(spark), df, ["g"], "a", "b", replicates=50)).n == 2
    same = spark.createDataFrame([("g", i, 0.5, 0.5) for i in range(5)], "g string, i int, a double, b double")
    assert one(stats.permutation_test(Tables(spark), same, ["g"], "a", "b", replicates=50)).p == 1.0


def test_chains(spark):
    good, bad = Row(fwd="pass", inv="pass"), Row(fwd="pass", inv=None)
    rows = [(1, "completed", [good, good]), (2, "completed", [good, bad]), (3, "blocked", [good]), (4, "completed", []), (5, "completed", [good])]
    df = spark.createDataFrame(rows, "i int, status string, pairs array<struct<fwd:string,inv:string>>")
    got = {r.i: (r.o, r.s) for r in df.select("i", stats.chain_outcome(F.col("status"), F.col("pairs")).alias("o"), stats.steady_state(F.col("status"), F.col("pairs")).alias("s")).collect()}
    assert got == {1: (1.0, 1.0), 2: (0.0, 0.0), 3: (None, None), 4: (None, None), 5: (1.0, None)}


def test_last_repeated_chain_counts(spark):
    df = spark.createDataFrame([("g", "d", "control", 0.0, 1), ("g", "d", "control", 1.0, 2), ("g", "d", "treatment", None, 3)], "g string, doc string, arm string, o double, seq int")
    r = one(stats.by_arm(df, ["g"], "doc", "arm", "o", "seq"))
    assert (r.control, r.treatment) == (1.0, None)


@pytest.mark.parametrize("sizes", [[(f"f{i}", 1 + i % 7) for i in range(40)], [(f"f{i}", 1) for i in range(20)], [("only", 300)], [("giant", 90), ("small-a", 5), ("small-b", 5)]])
def test_group_split(spark, sizes):
    fractions = {"development": 0.6, "validation": 0.2, "primary_holdout": 0.2}
    families = spark.createDataFrame(sizes, "family string, size int")
    got = sampling.group_split(Tables(spark), families, fractions, "s").collect()
    assert sorted(r.family for r in got) == sorted(f for f, _ in sizes)
    again = sampling.group_split(Tables(spark), families.repartition(5), fractions, "s").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    lacks = {k: v * sum(n for _, n in sizes) for k, v in fractions.items()}
    key = lambda f: hashlib.md5(f"s|{f}".encode()).hexdigest()
    for r in sorted(got, key=lambda r: (-r.size, key(r.family))):  # each family went where most was lacking, ties to the first
        assert r.split == max(lacks, key=lacks.get)
        lacks[r.split] -= r.size


@pytest.mark.parametrize("seed", range(60))
def test_turns_are_those_of_one_by_one(seed):
    rng = random.Random(seed)
    lacks = [Fraction(rng.choice([rng.randint(-20, 60), 12, 12.5])) for _ in range(rng.randint(1, 5))]
    size, count = rng.choice([0, 1, 3, 7, 100]), rng.randint(0, 60)
    left, want = list(lacks), []
    for _ in range(count):
        want.append(left.index(max(left)))
        left[want[-1]] -= size
    got = [order[k % len(order)] for n, order in sampling.turns(lacks, size, count) for k in range(n)]
    assert got == want and lacks == left


def test_fractions_are_checked():
    for bad in ({}, {"a": 0.5}, {"a": 1.5, "b": -0.5}):
        with pytest.raises(ValueError):
            sampling.check_fractions(bad)


def test_quota_after_exclusion(spark):
    pool = spark.createDataFrame([(i, "technology" if i < 5 else "education") for i in range(10)], "id int, topic string")
    left = sampling.exclude_prior(pool, spark.createDataFrame([(0,), (1,)], "id int"), spark.createDataFrame([(9,)], "id int"))
    assert left.count() == 7
    taken = sampling.quota_sample(left, F.col("topic"), 4, "s").groupBy("stratum").count().collect()
    assert {r.stratum: r["count"] for r in taken} == {"technology": 3, "education": 4}


def test_grades(spark):
    rows = [(["a", "b"], ["a", "b", "M x"], "M"), (["a", "b"], ["b", "M x"], "M"), (["a"], ["a", "M", "M"], "M"), (["a"], None, "M")]
    df = spark.createDataFrame(rows, "before array<string>, after array<string>, m string")
    assert [r[0] for r in df.select(grading.verdict(grading.forward_add(F.col("before"), F.col("after"), F.col("m")))).collect()] == ["pass", "fail", "fail", "fail"]
    order = spark.createDataFrame([(["Heading A", "Body A", "Heading B", "Body B"], ["Heading B", "Body B", "Heading A", "Body A"])], "before array<string>, after array<string>")
    assert one(order.select(grading.verdict(grading.forward_reorder(F.col("before"), F.col("after"), F.lit(" Heading B ")))))[0] == "pass"


def test_unknown_family_raises(spark):
    with pytest.raises(Exception, match="unknown family"):
        spark.createDataFrame([("odd",)], "f string").select(grading.dispatch(F.col("f"), {"x": {"ok": F.lit(True)}})).collect()


def test_chain_fold(spark):
    pair = lambda r, a, b: Row(readable=r, fwd=a, inv=b)
    rows = [(1, [pair(True, "pass", "pass")] * 2), (2, [pair(True, "pass", "fail"), pair(True, "pass", "pass")]), (3, [pair(True, "pass", "pass"), pair(False, None, None), pair(True, "pass", "pass")])]
    df = spark.createDataFrame(rows, "i int, pairs array<struct<readable:boolean,fwd:string,inv:string>>")
    got = {r.i: (r.s.status, r.s.n_graded, r.s.restored) for r in df.select("i", grading.chain_status(F.col("pairs")).alias("s")).collect()}
    assert got == {1: ("completed", 2, True), 2: ("completed_with_failure", 2, True), 3: ("blocked", 1, False)}


def test_modal_profile(spark):
    rows = [(i, "styles", "font", "p", v, "resolved") for i, v in enumerate(["Calibri"] * 4 + ["Arial"])] + [(i, "styles", "size", "p", "11", "resolved") for i in range(2)]
    long = spark.createDataFrame(rows, "doc int, category string, node string, part string, value_json string, status string")
    got = {r.node: r for r in profile.modal(long, []).collect()}
    assert (got["font"].mode, got["font"].agreement, got["font"].authority, got["font"].n_conflicts) == ("Calibri", 0.8, "domain_family", 1)
    assert got["size"].authority == "abstain"


def test_chain_depth_with_cycle(spark):
    long = [(f"l{i}", f"l{i + 1}") for i in range(9)] + [("l9", None)]
    parents = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("t", "x"), ("u", "nowhere"), ("s", "s"), *long], "n string, up string")
    got = {r.n: r.depth for r in structure.chain_depth(parents, "n", "up", most=5).collect()}
    assert (got["a"], got["b"], got["c"]) == (0, 1, 2) and got["x"] == got["y"] == 2 and got["t"] == 3 and got["u"] == got["s"] == 1
    assert [got[f"l{i}"] for i in range(10)] == [6, 6, 6, 6, 5, 4, 3, 2, 1, 0]


def test_preceding_and_containment(spark):
    rows = spark.createDataFrame([("d", 0, "caption"), ("d", 1, "table"), ("d", 2, "caption")], "doc string, ord int, kind string").withColumn("id", F.col("ord"))
    got = rows.withColumn("t", structure.preceding(rows, "doc", ["ord"], F.col("kind") == "table", "id")).where("kind = 'caption'").orderBy("ord").collect()
    assert [r.t for r in got] == [None, 1]
    nodes, edges = spark.createDataFrame([("p1",), ("p2",)], "node_id string"), spark.createDataFrame([("c1", "p2")], "src string, dst string")
    assert [r.node_id for r in structure.top_level(nodes, edges, spark.createDataFrame([("c1",)], "node_id string")).collect()] == ["p1"]


def test_determinism_by_two_routes(spark):
    columns = ["category", "node", "part", "value_json"]
    rows = [(d, "c", f"n{k}", "p", None if k == 2 else f"{d}{k}") for d in range(6) for k in range(4)]
    schema = "doc int, category string, node string, part string, value_json string"
    first = spark.createDataFrame(rows, schema)
    other = [r for r in rows if r[0] != 5]
    other[0] = (*other[0][:4], "else")  # a value of document 0
    other += [other[5], (9, "c", "n", "p", "only here")]  # a row of document 1 twice, and a document more
    second = spark.createDataFrame(other, schema).repartition(5, "value_json")
    got = {r.doc: (r.by_list, r.by_sums) for r in profile.determinism(first, second, "doc", columns).collect()}
    assert got == {d: (False, False) if d in (0, 1, 5, 9) else (True, True) for d in (0, 1, 2, 3, 4, 5, 9)}


def test_audit_parts(spark):
    checks = spark.createDataFrame([(1, "a", True, True), (2, "b", True, False), (3, "c", False, False)], "position int, name string, blocking boolean, passed boolean")
    r = one(audit.gate(checks))
    assert (r.failed, r.blocking_failures, r.gate_passed) == (2, 1, False)
    assert [x.state for x in audit.preflight(checks, []).orderBy("position").collect()] == ["passed", "failed", "skipped"]
    runs = {"x": [(True, True), (False, False), (True, True), (True, None), (False, True)], "y": [(False, False), (None, False), (False, True)], None: [(True, False), (True, False)]}
    rows = [(d, k, b, p) for d, cs in runs.items() for k, (b, p) in enumerate(cs)]
    got = audit.preflight(spark.createDataFrame(rows, "doc string, position int, blocking boolean, passed boolean").repartition(3), ["doc"]).collect()
    want = {"x": ["passed", "failed", "passed", "failed", "skipped"], "y": ["failed", "failed", "passed"], None: ["failed", "skipped"]}
    assert {d: [r.state for r in sorted(got, key=lambda r: r.position) if r.doc == d] for d in runs} == want
    row = spark.createDataFrame([(Row(approved=None, sha256="x"), Row(a=1, b=None), Row(a=2, b=None))], "art struct<approved:boolean,sha256:string>, p struct<a:int,b:int>, q struct<a:int,b:int>")
    assert one(row.select(audit.approved(F.col("art"), F.lit("x"))))[0] is False
    assert one(row.select(audit.changed_fields(F.col("p"), F.col("q"), ["a", "b"])))[0] == ["a"]


def test_duplicates_and_ledger(spark):
    items = spark.createDataFrame([(1, "A b", "h1"), (2, "a  B", "h2"), (3, "c", "h3"), (4, "c", "h3")], "id int, text string, sha256 string")
    assert [r.n for r in dedup.duplicate_groups(items, F.col("sha256"), "id").collect()] == [2]
    assert [r.n_raw for r in dedup.content_duplicates(items, T.normalise(F.col("text")), F.col("sha256")).collect()] == [2]
    rows = dedup.ledger(items, spark.createDataFrame([(1, "clean")], "id int, pii_status string"), "id").orderBy("id").collect()
    assert rows[0].pii_status == "clean" and rows[1].pii_status == "not_assessed" and rows[1].split == "unassigned"


def test_timing(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None)], "g string, s double")
    r = one(stats.timing(rows, ["g"], "s"))
    assert (r.n, r.mean, r.median) == (2, 2.0, 2.0)


def test_near_duplicates_of_large_groups(spark):
    """70 exact copies, 70 near copies of them whose common lines all exceed 64 documents, and a bystander."""
    base = [f"line {k}" for k in range(10)]
    sets = {i: set(base) for i in range(70)} | {100 + i: set(base[:9]) | {f"own {i}"} for i in range(70)} | {300: {"line 0", "x"}}
    rows = [(i, f) for i, fs in sets.items() for f in fs]
    found = dedup.near_duplicate_pairs(Tables(spark), spark.createDataFrame(rows, "i long, f string"), "i", "f").collect()
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    heads = [0, *range(100, 170), 300]
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in heads for b in heads if a < b and near(a, b)}
    assert {(r.a, r.b): r.jaccard for r in found} == want | {(0, 0): 1.0} and len(found) == len(want) + 1
    assert {r.n_a for r in found if r.a == 0} == {70} and {(r.n_a, r.n_b) for r in found if r.a > 0} <= {(1, 1)}


def test_near_duplicates_name_every_copy(spark):
    """All linked pairs follow from the rows: the near ones of classes, and who is in a class."""
    sets = {i: {"a", "b", "c", "d", "e"} for i in (1, 4, 9)} | {i: {"a", "b", "c", "d", "e", "f"} for i in (2, 5)} | {7: {"z"}}
    rows = [(i, f) for i, fs in sets.items() for f in fs]
    found = dedup.near_duplicate_pairs(Tables(spark), spark.createDataFrame(rows, "i long, f string"), "i", "f", copies=True).collect()
    links = {(r.a, r.b) for r in found}
    assert links == {(1, 1), (1, 4), (1, 9), (2, 2), (2, 5), (1, 2)} and len(found) == 6
    classes = {b: a for a, b in links if sets[a] == sets[b]}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    told = {(x, y) for x in classes for y in classes if x < y and (classes[x] == classes[y] or tuple(sorted((classes[x], classes[y]))) in links)}
    assert told == {(x, y) for x in sets for y in sets if x < y and near(x, y)}


def test_lineage_by_brute_force(spark):
    """Exact, normalised and near links, in chains, with nulls, repeats and texts without content."""
    rng = random.Random(4)
    word = lambda k: f"w{k}"
    texts: dict[int, str | None] = {}
    for g in range(6):
        lines = [f"{word(g)} {k} {rng.random()}" for k in range(12)]
        for k in range(8):  # a chain of revisions: its ends are far apart
            texts[100 * g + k] = "\n".join(lines)
            lines[k] = f"new {g} {k}"
    texts |= {700: "A  b\nc", 701: "a b c", 702: "a b\nC", 703: None, 704: "", 705: " \n ", 706: "a b c", 707: None}
    sets = {i: {" ".join(x.split()).lower() for x in (t or "").split("\n")} - {""} for i, t in texts.items()}
    same = lambda a, b: bool(sets[a]) and " ".join((texts[a] or "").split()).lower() == " ".join((texts[b] or "").split()).lower()
    near = lambda a, b: bool(sets[a] & sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    root = {i: i for i in texts}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in texts:
        for b in texts:
            if a < b and (same(a, b) or near(a, b)):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    docs = spark.createDataFrame([*texts.items(), (700, texts[700])], "doc_id long, text string")
    text, lines = normalise(F.col("text")), docs.select("doc_id", F.explode(paragraphs(F.col("text"))).alias("l"))
    got = dedup.lineage(Tables(spark), docs.select("doc_id", F.when(text != "", text).alias("text_key")), lines.select("doc_id", normalise(F.col("l")).alias("f"))).collect()
    assert len(got) == len(texts)
    for r in got:
        i = r.doc_id
        assert r.lineage_id == find(i) and r.n_family == sum(find(j) == find(i) for j in texts)
        assert r.n_links == sum(near(i, j) for j in texts if j != i)
        assert r.class_id == min([j for j in texts if sets[j] == sets[i] and sets[i]], default=i)


@pytest.mark.parametrize("order", ["ascending", "descending", "shuffled"])
def test_components_of_long_paths(spark, order):
    ids = list(range(600))
    if order != "ascending":
        ids[1:] = ids[:0:-1]
    if order == "shuffled":
        random.Random(3).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:])) + [(2001, 2000), (7, 7)], "a long, b long")
    assert {r.v: r.comp for r in connected_components(Tables(spark), edges).collect()} == {i: 0 for i in range(600)} | {2000: 2000, 2001: 2000}


def test_char_edit_distance_of_whole_paragraphs(spark, tmp_path):
    head = "a" * 70
    text = f"{head} end\n{head} eNd\n{head}  ending\nüber\nuber"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.QUERIES["char_edit_distance"](spark, str(tmp_path)).collect()
    assert {r.ord: r.distance for r in found} == {0: 0, 1: 3, 2: 76, 3: 1}


def uniform(*parts):
    return (int(hashlib.md5("|".join(map(str, ("20260828", *parts))).encode()).hexdigest()[:8], 16) + 0.5) / 4294967296


def least_count(m, p, u):
    """The least k with P(Bin(m, p) <= k) >= u, in whole fractions."""
    k, below = 0, Fraction(0)
    while True:
        below += math.comb(m, k) * p**k * (1 - p) ** (m - k)
        if below >= u or k == m:
            return k
        k += 1


def test_binomial_quantiles_by_exact_sums():
    rng = random.Random(2)
    rows = [(m, a, b, rng.random()) for m in (0, 1, 2, 7, 40, 150) for a, b in ((0, 3), (1, 2), (1, 9), (8, 9), (3, 3), (1, 1000)) for _ in range(12)]
    got = draws.binomial_quantiles(*[np.array(c, np.int64) for c in list(zip(*rows))[:3]], np.array([r[3] for r in rows]))
    assert got.tolist() == [least_count(m, Fraction(a, b), Fraction(u)) for m, a, b, u in rows]
    many = draws.binomial_quantiles(np.full(4000, 10**9), np.full(4000, 3), np.full(4000, 10), (np.arange(4000) + 0.5) / 4000)
    assert abs(many.mean() - 3e8) < 60 and abs(many.std() / (10**9 * 0.21) ** 0.5 - 1) < 0.01


def test_resamples_are_split_as_drawn(spark):
    """Counts of every value in every replicate against the same tree drawn in whole fractions."""
    rng = random.Random(9)
    values = {"a": [rng.choice([0.5, 1.0, 2.0, 4.0, 8.0]) for _ in range(23)], "b": [1.0, 2.0], None: [3.0] * 4}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [("a", None)], "g string, v double")
    got = {}
    for r in stats.resampled(Tables(spark), df.repartition(3), ["g"], "v", "20260828", 40).collect():
        got[r.g, r.rep, r.x] = r.m
    levels = 3  # of five distinct values
    want = {}
    for g, vs in values.items():
        xs = sorted(set(vs))
        for rep in range(40):
            held = {0: len(vs)}
            for level in range(levels):
                below = {}
                for k, x in enumerate(xs):
                    child = k >> (levels - level - 1)
                    below[child] = below.get(child, 0) + vs.count(x)
                fresh = {}
                for node, m in held.items():
                    whole = below.get(2 * node, 0) + below.get(2 * node + 1, 0)
                    left = least_count(m, Fraction(below.get(2 * node, 0), whole), Fraction(uniform(rep, level, node)))
                    fresh |= {c: n for c, n in ((2 * node, left), (2 * node + 1, m - left)) if n}
                held = fresh
            want |= {(g, rep, xs[k]): m for k, m in held.items()}
    assert got == want


def test_bootstrap_interval_is_that_of_plain_resampling(spark):
    """The percentile interval of 400 skewed values, against 2,000 resamples of numpy."""
    rng = np.random.default_rng(3)
    values = np.round(rng.exponential(2.0, 400), 1)
    df = spark.createDataFrame([(float(v),) for v in values], "v double").withColumn("g", F.lit(1))
    r = one(stats.bootstrap_ci(Tables(spark), df, ["g"], "v"))
    means = np.sort(values[rng.integers(0, 400, (2000, 400))].mean(axis=1))
    assert abs(r.low - means[50]) < 0.05 and abs(r.high - means[1949]) < 0.05 and r.method == "percentile"


def test_registered_statistics_take_all_replicates(spark, tmp_path):
    """Against plain draws, 2,000 times."""
    rng = random.Random(8)
    rows = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(15)]
    spark.createDataFrame([(i, "en") for i, _, _ in rows], "doc_id long, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    n, zeros = len(rows), sum(q == 0 for _, q, _ in rows)
    means = sorted((n - least_count(n, Fraction(zeros, n), Fraction(uniform(rep, 0, 0)))) / n for rep in range(2000))

    def share(ds):
        sizes = sorted({abs(d) for d in ds if d})
        flips = [sum(x * (2 * least_count(c, Fraction(1, 2), Fraction(uniform(rep, k))) - c) for k, x in enumerate(sizes) for c in [sum(abs(d) == x for d in ds)]) for rep in range(2000)]
        return round(sum(abs(f) >= abs(sum(ds)) for f in flips) / 2000, 6)

    run = lambda name: registry.QUERIES[name](spark, str(tmp_path)).collect()
    ci = run("bootstrap_ci_by_group")[0]
    assert (ci.low, ci.high) == (round(means[50], 6), round(means[1949], 6))
    assert run("paired_permutation_test")[0].p == share([q - t for _, q, t in rows])
    pairs = {(r.system_a, r.system_b): r.p for r in run("pairwise_system_tests")}
    assert pairs == {("quality", "safe"): share([q + t - 1 for _, q, t in rows]), ("quality", "toxic"): share([q - t for _, q, t in rows]), ("safe", "toxic"): share([1 - 2 * t for _, _, t in rows])}



def test_equal_lists_correspond_without_a_search(monkeypatch):
    monkeypatch.setattr(alignment.difflib, "SequenceMatcher", None)
    assert alignment.matched_pairs(["a"] * 5000, ["a"] * 5000) == [(i, i) for i in range(5000)]


def test_edges_are_grouped_by_their_columns(spark):
    rows = [(1, 1, None), (1, 1, None), (1, None, 1), (1, 2, 2), (2, 3, 3)]
    gold = spark.createDataFrame(rows, "d long, a long, b long")
    scored = scoring.edge_prf1(gold, gold.where("a is not null and d = 1"), "d", ["a", "b"])
    assert {r.d: (r.matched, r.n_gold, r.n_cand) for r in scored.collect()} == {1: (2, 3, 2), 2: (0, 1, 0)}
    assert "to_json" not in scored._jdf.queryExecution().toString() and "structstojson" not in scored._jdf.queryExecution().toString().lower()
