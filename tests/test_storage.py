"""Logs as streams, manifests, reports and partial updates on disk; numbers in nested reports."""

import json
import random

from pyspark.sql import functions as F

from folioflow.functions.tables import Tables
from folioflow.operators import nested
from folioflow.sources import files
from folioflow.streaming.last_rows import LastRows

SCHEMA = "k long, seq long, v string"


def test_last_rows_of_a_stream(spark, tmp_path):
    """Files in any order, rows late, repeated and without a key; levels on the way; a second run takes only new files."""
    rng, log = random.Random(3), tmp_path / "log"
    log.mkdir()
    rows = [(rng.randrange(20), seq, f"v{seq}") for seq in range(300)]
    want = {k: (seq, v) for k, seq, v in rows}
    rng.shuffle(rows)

    def put(name, part):
        (log / f"{name}.json").write_text("".join(json.dumps({"k": k, "seq": s, "v": v}) + "\n" for k, s, v in part))

    state = LastRows(spark, str(tmp_path / "state"), SCHEMA, "k", "seq", every=3)
    assert state.rows().count() == 0
    for i in range(8):
        put(f"a{i}", rows[40 * i : 40 * i + 40] + [(None, 999, "no key"), (3, None, "no sequence")])
    state.follow(str(log), str(tmp_path / "marks"), files_per_batch=1).awaitTermination()
    assert {r.k: (r.seq, r.v) for r in state.rows().collect()} == want
    assert state._numbers("level") == [2, 5] and len(state._numbers("batch")) == 8
    put("b0", rows[:90])
    put("b1", [(7, 10**6, "newest"), (8, -1, "oldest")])
    state.follow(str(log), str(tmp_path / "marks"), files_per_batch=1).awaitTermination()
    want[7] = (10**6, "newest")
    assert {r.k: (r.seq, r.v) for r in state.rows().collect()} == want and len(state._numbers("batch")) == 10
    again = spark.createDataFrame([(k, s, v) for k, s, v in rows[:40]], SCHEMA)
    state.add(again, 9)  # what a batch that failed half way does once more
    state.add(spark.createDataFrame([(7, 10**6, "newest")], SCHEMA), 10)
    assert {r.k: (r.seq, r.v) for r in state.rows().collect()} == want


def test_a_tier_is_read_alone(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "gold"), (2, "b", "silver"), (3, None, None)], "id long, v string, tier string")
    files.write_tiers(rows, f"{tmp_path}/t")
    gold = files.read_tier(spark, f"{tmp_path}/t", "id long, v string, tier string", "gold")
    plan = gold._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tier" in plan and "(tier" in plan and [r.id for r in gold.collect()] == [1]


def test_newest_reports(spark, tmp_path):
    for run, n in (("01", 3), ("02", 5), ("10", 1)):
        files.write_report(spark.createDataFrame([(n,), (n,)], "n long"), f"{tmp_path}/r", "report-v1", run)
    read = lambda accept=None: {(r.report, r.n) for r in files.newest_reports(spark, f"{tmp_path}/r", "n long", accept).collect()}
    assert read() == {("report-v1-10", 1)}
    assert read(lambda rows: rows.where("n > 2").select("report")) == {("report-v1-02", 5)}
    assert read(lambda rows: rows.where("n > 9").select("report")) == set()


def test_only_changed_partitions_are_rewritten(spark, tmp_path):
    schema = "id long, rec struct<g:int,k:int>, p int"
    rows = [(i, {"g": i % 3, "k": i}, i % 4) for i in range(40)]
    spark.createDataFrame(rows, schema).repartition("p").write.partitionBy("p").parquet(f"{tmp_path}/t")
    held = lambda: spark.read.schema(schema).parquet(f"{tmp_path}/t")
    seen = lambda: {p: sorted(f.name for f in (tmp_path / "t" / f"p={p}").glob("*.parquet")) for p in range(4)}
    before = seen()
    new = spark.createDataFrame([(1, 7), (5, 2), (2, 2), (99, 1)], "id long, value int")  # 1 changes, 5 and 2 do not
    states = files.update_partitions(Tables(spark), f"{tmp_path}/t", held(), new, "id", "rec", "g", "p")
    assert {r.id: r.state for r in states.collect()} == {i: {1: "changed", 5: "unchanged", 2: "unchanged"}.get(i, "missing") for i in range(40)}
    after = seen()
    assert {p for p in range(4) if before[p] != after[p]} == {1}
    assert {r.id: (r.rec.g, r.rec.k, r.p) for r in held().collect()} == {i: (7 if i == 1 else i % 3, i, i % 4) for i in range(40)}
    files.update_partitions(Tables(spark), f"{tmp_path}/t", held(), new, "id", "rec", "g", "p")
    assert seen() == after


def test_numbers_at_any_depth(spark):
    reports = {
        1: '{"a": 1, "b": {"c": 2.5, "d": "3", "e": true, "f": null}, "g": [1, "x", [2, {"h": -4e2}], {}]}',
        2: "17",
        3: '"text"',
        4: "no json {",
        5: None,
        6: "[[[[[[0]]]]]]",
        7: '{"": {"a.b": 12345678901234567890}}',
    }
    rows = nested.numeric_leaves(Tables(spark), spark.createDataFrame(list(reports.items()), "i int, j string"), ["i"], "j").collect()
    got = {}
    for r in rows:
        got.setdefault(r.i, {})[r.path] = r.value
    assert got == {1: {"a": 1.0, "b.c": 2.5, "g[0]": 1.0, "g[2][0]": 2.0, "g[2][1].h": -400.0}, 2: {"": 17.0}, 6: {"[0][0][0][0][0][0]": 0.0}, 7: {"a.b": 1.2345678901234567e19}} and len(rows) == 8
