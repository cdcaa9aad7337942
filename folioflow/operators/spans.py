"""Tables with merged cells: cells with row and column spans laid out on a grid, and scores over what they cover.

Cells come in reading order.  A cell takes the first column of its row that no cell of an earlier row reaches down
into, to the right of the cell before it; so what is still open from the rows above is carried along, as intervals of
columns with the row that they end before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import prf1

_OPEN = "array<struct<first:int,last:int,until:int>>"
_PLACED = "array<struct<row:int,col:int,rows:int,cols:int,id:bigint>>"


def _laid(rows: Column) -> Column:
    """Placed cells of one table from its rows (row, cells (rows, cols, id)), in order."""

    def place(row: Column, state: Column, cell: Column) -> Column:
        # open intervals ascend: whatever holds the column pushes it behind its end
        at = F.aggregate(state["open"], state["next"], lambda c, o: F.when((o["first"] <= c) & (c <= o["last"]), o["last"] + 1).otherwise(c))
        placed = F.struct(row.alias("row"), at.alias("col"), cell["rows"].alias("rows"), cell["cols"].alias("cols"), cell["id"].alias("id"))
        return F.struct(state["open"].alias("open"), (at + cell["cols"]).alias("next"), F.concat(state["placed"], F.array(placed)).alias("placed"))

    def step(state: Column, line: Column) -> Column:
        row = line["row"]
        held = F.filter(state["open"], lambda o: o["until"] > row)
        begin = F.struct(held.alias("open"), F.lit(0).alias("next"), F.array().cast(_PLACED).alias("placed"))
        done = F.aggregate(line["cells"], begin, lambda s, cell: place(row, s, cell))
        below = F.transform(F.filter(done["placed"], lambda p: p["rows"] > 1), lambda p: F.struct(p["col"].alias("first"), (p["col"] + p["cols"] - 1).alias("last"), (row + p["rows"]).alias("until")))
        return F.struct(F.array_sort(F.concat(done["open"], below)).alias("open"), F.concat(state["out"], F.array(done["placed"])).alias("out"))

    begin = F.struct(F.array().cast(_OPEN).alias("open"), F.array().cast(f"array<{_PLACED}>").alias("out"))
    return F.flatten(F.aggregate(rows, begin, step)["out"])


def place_cells(cells: DataFrame, table: list[str], row: str = "row", order: str = "cell", rows: str = "row_span", cols: str = "col_span") -> DataFrame:
    """(table, row, cell, col, row_span, col_span) of every cell: the grid column that it begins in.

    Spans that are null or below 1 count as 1; a row span may reach beyond the last row, as in the format.  Rows may be
    missing, and cells of one row go by their order.  A table's cells come together in one row, so its size bounds the
    state: that of one table of a document.
    """
    span = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(1)), F.lit(1)).cast("int")
    known = cells.where(F.col(row).isNotNull() & F.col(order).isNotNull())
    lines = known.groupBy(*table, F.col(row).cast("int").alias("_row")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("id"), span(rows).alias("rows"), span(cols).alias("cols")))).alias("cells"))
    whole = lines.groupBy(*table).agg(F.array_sort(F.collect_list(F.struct(F.col("_row").alias("row"), "cells"))).alias("lines"))
    placed = whole.select(*table, F.explode(_laid(F.col("lines"))).alias("p"))
    return placed.select(*table, F.col("p.row").alias(row), F.col("p.id").alias(order), F.col("p.col").alias("col"), F.col("p.rows").alias(rows), F.col("p.cols").alias(cols))


def occupancy(placed: DataFrame, table: list[str], row: str = "row", order: str = "cell", rows: str = "row_span", cols: str = "col_span") -> DataFrame:
    """(table, row, col, anchor_row, cell): every grid slot that a placed cell covers."""
    down = placed.select(*table, F.col(row).alias("anchor_row"), F.col(order).alias("cell"), "col", cols, F.explode(F.sequence(F.col(row), F.col(row) + F.col(rows) - 1)).alias("row"))
    return down.select(*table, "row", F.explode(F.sequence(F.col("col"), F.col("col") + F.col(cols) - 1)).alias("col"), "anchor_row", "cell")


def merged_cell_scores(gold: DataFrame, cand: DataFrame, table: list[str], doc: str, row: str = "row", rows: str = "row_span", cols: str = "col_span") -> DataFrame:
    """(doc, n_gold, n_cand, matched, precision, recall, f1) over merged cells: those of more than one slot, equal if
    anchor (row and column) and spans are.  Both sides are placed cells; a document counts if either side has a cell."""
    facts = [*table, row, "col", rows, cols]
    side = lambda df, name: df.select(*facts, F.lit(1).alias(name)).distinct()  # noqa: E731  overlapping spans may repeat an anchor
    both = side(gold, "g").join(side(cand, "c"), facts, "full")
    merged = F.col(rows) * F.col(cols) > 1
    count = lambda c: F.count_if(c)
    sums = both.groupBy(doc).agg(count(merged & F.col("g").isNotNull()).alias("n_gold"), count(merged & F.col("c").isNotNull()).alias("n_cand"), count(merged & F.col("g").isNotNull() & F.col("c").isNotNull()).alias("matched"))
    scores = prf1(F.col("matched"), F.col("n_gold"), F.col("n_cand"))
    return sums.select(doc, "n_gold", "n_cand", "matched", *[F.round(v, 6).alias(k) for k, v in scores.items()])
