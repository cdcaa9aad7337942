"""Merged cells: hand-made nested spans, and random tables against a grid filled slot by slot."""

import random

from folioflow.operators import spans

SCHEMA = "doc int, row int, cell long, row_span int, col_span int"


def filled(cells):
    """Grid columns of cells, slot by slot."""
    taken, out = {}, {}
    for row in sorted({c[0] for c in cells}):
        at = 0
        for _, cell, rs, cs in sorted(c for c in cells if c[0] == row):
            rs, cs = max(rs or 1, 1), max(cs or 1, 1)
            while any(a <= at <= b and row < u for (a, b, u) in taken.get("open", [])):
                at += 1
            out[row, cell] = at
            if rs > 1:
                taken.setdefault("later", []).append((at, at + cs - 1, row + rs))
            at += cs
        taken.setdefault("open", []).extend(taken.pop("later", []))
    return out


def test_nested_spans_by_hand(spark):
    """
    A A B C      A covers 2 x 2, C reaches down two rows, D two columns below B ends at it
    A A D C
    E F F G
    """
    rows = [(1, 0, 0, 2, 2), (1, 0, 1, 1, 1), (1, 0, 2, 2, 1), (1, 1, 0, 1, 1), (1, 2, 0, 1, 1), (1, 2, 1, 1, 2), (1, 2, 2, 1, 1)]
    placed = spans.place_cells(spark.createDataFrame(rows, SCHEMA), ["doc"])
    assert {(r["row"], r.cell): r.col for r in placed.collect()} == {(0, 0): 0, (0, 1): 2, (0, 2): 3, (1, 0): 2, (2, 0): 0, (2, 1): 1, (2, 2): 3}
    grid = {(r["row"], r.col): (r.anchor_row, r.cell) for r in spans.occupancy(placed, ["doc"]).collect()}
    assert len(grid) == 12 and grid[1, 1] == (0, 0) and grid[1, 3] == (0, 2) and grid[2, 2] == (2, 1)


def test_random_tables(spark):
    rng = random.Random(5)
    tables = {d: [(r, c, rng.choice([1, 1, 1, 2, 3, None, 0]), rng.choice([1, 1, 2, 4])) for r in range(rng.randint(1, 9)) if rng.random() < 0.9 for c in range(rng.randint(1, 5))] for d in range(40)}
    rows = [(d, *c) for d, cs in tables.items() for c in cs]
    got = {(r.doc, r["row"], r.cell): r.col for r in spans.place_cells(spark.createDataFrame(rows, SCHEMA).repartition(4), ["doc"]).collect()}
    assert got == {(d, *k): col for d, cs in tables.items() for k, col in filled(cs).items()}


def test_scores_of_merged_cells(spark):
    gold = [(1, 0, 0, 2, 1), (1, 0, 1, 1, 2), (1, 1, 0, 1, 1), (2, 0, 0, 1, 1), (3, 0, 0, 2, 2)]
    cand = [(1, 0, 0, 2, 1), (1, 0, 1, 1, 3), (1, 1, 0, 1, 1), (2, 0, 0, 1, 1), (4, 0, 0, 1, 2)]
    side = lambda rows: spans.place_cells(spark.createDataFrame(rows, SCHEMA), ["doc"])
    got = {r.doc: tuple(r)[1:] for r in spans.merged_cell_scores(side(gold), side(cand), ["doc"], "doc").collect()}
    assert got == {1: (2, 2, 1, 0.5, 0.5, 0.5), 2: (0, 0, 0, 1.0, None, None), 3: (1, 0, 0, 0.0, 0.0, None), 4: (0, 1, 0, 0.0, None, None)}
    none = side([])
    assert spans.merged_cell_scores(none, none, ["doc"], "doc").count() == 0
