"""Every registered query against its SQL, and the others for stable schemas and bounds."""

import itertools
import random

import duckdb
import pytest

from folioflow.plans import registry
from folioflow.plans import scoring as plans_scoring


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(agree, name):
    agree(registry.QUERIES[name], registry.SQL[name])


def longest_blocks(a, b):
    """Matched pairs: the longest common block, of equally long ones the first in a and then in b, then both sides."""
    best, at, row = 0, (0, 0), {}
    for i, x in enumerate(a):
        row = {j: row.get(j - 1, 0) + 1 for j, y in enumerate(b) if x == y}
        for j, n in row.items():
            if n > best:
                best, at = n, (i - n + 1, j - n + 1)
    if not best:
        return []
    i, j = at
    left, right = longest_blocks(a[:i], b[:j]), longest_blocks(a[i + best :], b[j + best :])
    return left + [(i + k, j + k) for k in range(best)] + [(i + best + x, j + best + y) for x, y in right]


def ratio(a, b):
    return 2 * len(longest_blocks(a, b)) / (len(a) + len(b)) if a or b else 1.0


@pytest.fixture(scope="module")
def alignment_inputs(spark, tmp_path_factory):
    """Documents of few paragraphs, of which some are like each other, and what the registered queries compare."""
    rng, out = random.Random(6), tmp_path_factory.mktemp("aligned")
    line = lambda: " ".join(rng.choice(["Alpha", "beta", "gamma", "delta", "eps"]) for _ in range(rng.randint(1, 5)))
    rows = [(i, "\n".join(line() for _ in range(rng.randint(0, 9)))) for i in range(40)] + [(90, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{out}/documents.parquet")
    return str(out), rng


def collected(spark, out, ablation):
    norm = lambda xs: [" ".join(x.split()).lower() for x in xs]
    return {r.doc_id: (norm(r.gold), norm(r.cand)) for r in plans_scoring._sides(spark, out, ablation).collect()}


def test_alignment_queries_by_plain_versions(spark, alignment_inputs):
    out, _ = alignment_inputs
    run = lambda name: {r.doc_id: r for r in registry.QUERIES[name](spark, out).collect()}
    shuffled = collected(spark, out, "shuffle_order")
    aligned, fuzzy = run("align_paragraphs"), run("fuzzy_reading_order")
    assert set(aligned) == set(fuzzy) == set(shuffled) and len(shuffled) >= 35
    for i, (gold, cand) in shuffled.items():
        n = len(longest_blocks(gold, cand))
        assert aligned[i].matched == n and aligned[i].precision == (n / len(cand) if cand else float(not gold))
        pairs, used = [], set()
        for j, text in enumerate(cand):  # exact first, k-th with k-th
            at = next((k for k, g in enumerate(gold) if g == text and k not in used), None)
            if at is not None:
                used.add(at)
                pairs.append((at, j))
        for j in [j for j in range(len(cand)) if j not in {p[1] for p in pairs}]:
            like = [(ratio(gold[k], cand[j]), -k) for k in range(len(gold)) if k not in used]
            if like and max(like)[0] > 0.6:
                used.add(-max(like)[1])
                pairs.append((-max(like)[1], j))
        wrong = sum((a < c) != (b < d) for (a, b), (c, d) in itertools.combinations(pairs, 2))
        total = len(pairs) * (len(pairs) - 1) // 2
        assert (fuzzy[i].matched, fuzzy[i].discordant, fuzzy[i].accuracy) == (len(pairs), wrong, (total - wrong) / total if total else None)


def test_token_f1_and_drift_by_plain_versions(spark, alignment_inputs):
    out, _ = alignment_inputs
    run = lambda name: {r.doc_id: r for r in registry.QUERIES[name](spark, out).collect()}
    raw = {r.doc_id: (" ".join(r.gold).split(), " ".join(r.cand).split()) for r in plans_scoring._sides(spark, out, "drop_tables").collect()}
    for i, r in run("token_f1_sequence").items():
        g, c = raw[i]
        n = len(longest_blocks(g, c))
        assert r.token_f1 == (2 * n / (len(g) + len(c)) if g and c else float(not g and not c))
    drift, plain = run("round_trip_drift"), collected(spark, out, "none")
    assert {(r.status, r.count_change, r.f1) for i, r in drift.items() if plain[i][0]} == {("identical", 0, 1.0)} and set(drift) == set(plain)


def test_edit_distance_by_brute_force(spark, tmp_path):
    texts = ["Añb  C", "acb c", "", "x" * 300, "x" * 150 + "é" + "x" * 149, "日本語テキスト", "日本テキスト!"]
    spark.createDataFrame([(1, "\n".join(texts)), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.ord: r.distance for r in registry.QUERIES["char_edit_distance"](spark, str(tmp_path)).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    kept = [" ".join(t.lower().split()) for t in texts if t]
    assert got == {i: distance(a, b) for i, (a, b) in enumerate(zip(kept, kept[1:]))}


def test_collisions_of_documents_without_a_language(spark, tmp_path):
    rows = [(1, "a\nb", None, "x"), (2, "a\nb", "en", "y"), (3, "b\na", None, "y"), (4, "a\nb", "", "x"), (5, "a\nb", "en", None), (6, "c", None, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, registry.QUERIES["cross_split_collisions"](spark, str(tmp_path)).select("lang_a", "source_a", "lang_b", "source_b", "pairs").collect()), key=str)
    want = [("", "x", "en", "y", 1), ("", "x", None, "y", 1), ("en", "y", None, "x", 1), (None, "x", None, "y", 1)]
    assert got == sorted(want, key=str)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = con.sql(registry.SQL["cross_split_collisions"])
    assert sorted(map(tuple, found.project("lang_a, source_a, lang_b, source_b, pairs").fetchall()), key=str) == got


@pytest.mark.parametrize("name, most", [("package_caption_targets", 2), ("package_visible_text", 2), ("char_edit_distance", 0), ("baseline_scores", 3)])
def test_texts_are_read_once(spark, sf_dir, name, most):
    """Packages are built and parsed by one pass, neighbours are not joined, and words are listed once for both sides."""
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    counted = {"char_edit_distance": "Join", "baseline_scores": "Generate explode(filter"}.get(name, "MapInArrow")
    assert plan.count(counted) <= (1 if name == "baseline_scores" else most) and "MapInPandas" not in plan


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
