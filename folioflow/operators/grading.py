"""Grades of edits from before and after paragraph lists, and folds of trial chains.  Array functions only.

`before` and `after` are arrays of paragraphs; every grader returns named boolean checks, and the verdict is `pass` when
all of them hold.  A null list (unreadable output) fails.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HEAD = 40


def holding(paragraphs: Column, marker: Column) -> Column:
    return F.filter(paragraphs, lambda p: F.contains(p, marker))


def _none_lost(before: Column, after: Column) -> Column:
    return F.forall(before, lambda p: F.array_contains(after, p))


def forward_add(before: Column, after: Column, marker: Column) -> dict[str, Column]:
    return {"once": F.size(holding(after, marker)) == 1, "none_lost": _none_lost(before, after), "grew": F.size(after) > F.size(before)}


def inverse_add(before: Column, after: Column, marker: Column) -> dict[str, Column]:
    return {"gone": F.size(holding(after, marker)) == 0, "none_lost": _none_lost(before, after), "restored": after == before}


def unexpected(before: Column, after: Column) -> Column:
    return F.filter(after, lambda p: ~F.array_contains(before, p))


def forward_inline(before: Column, after: Column, marker: Column, anchor: Column) -> dict[str, Column]:
    marked = holding(after, marker)
    at_anchor = F.filter(marked, lambda p: F.startswith(p, F.substring(anchor, 1, HEAD)))
    others = F.filter(before, lambda p: p != anchor)
    return {"once": F.size(at_anchor) == 1, "none_lost": _none_lost(others, after), "not_leaked": F.size(marked) == F.size(at_anchor), "same_count": F.size(after) == F.size(before)}


def inverse_inline(before: Column, after: Column, marker: Column) -> dict[str, Column]:
    return {"gone": F.size(holding(after, marker)) == 0, "none_lost": _none_lost(before, after), "same_count": F.size(after) == F.size(before)}


def forward_reorder(before: Column, after: Column, heading: Column) -> dict[str, Column]:
    return {"same_paragraphs": F.array_sort(after) == F.array_sort(before), "moved": after != before, "heading_kept": F.array_contains(after, F.trim(heading))}


def inverse_reorder(before: Column, after: Column) -> dict[str, Column]:
    return {"restored": after == before}


def forward_equation(before: Column, after: Column, marker: Column, equations: Column) -> dict[str, Column]:
    """`equations` are the flat texts of the output's equations, in which the marker is looked for."""
    return {"once": F.size(holding(equations, marker)) == 1, "none_lost": _none_lost(before, after)}


def inverse_equation(before: Column, after: Column, marker: Column, equations: Column) -> dict[str, Column]:
    return {"gone": F.size(holding(equations, marker)) == 0, "restored": after == before, "none_lost": _none_lost(before, after)}


def forward_table(before: Column, after: Column, marker: Column) -> dict[str, Column]:
    """Cell text is paragraph text, so the marker is looked for there."""
    return forward_equation(before, after, marker, after)


def inverse_table(before: Column, after: Column, marker: Column) -> dict[str, Column]:
    return inverse_equation(before, after, marker, after)


def passed(checks: dict[str, Column]) -> Column:
    return F.coalesce(reduce(lambda a, b: a & b, checks.values()), F.lit(False))


def verdict(checks: dict[str, Column]) -> Column:
    return F.when(passed(checks), "pass").otherwise("fail")


def dispatch(family: Column, graders: dict[str, dict[str, Column]]) -> Column:
    """Verdict by family; an unknown family is an error, not a failed trial."""
    out = F.raise_error(F.concat(F.lit("unknown family: "), F.coalesce(family, F.lit("null")))).cast("string")
    for name, checks in graders.items():
        out = F.when(family == name, verdict(checks)).otherwise(out)
    return out


def graders(before: Column, after: Column, marker: Column, anchor: Column, equations: Column, forward: bool) -> dict[str, dict[str, Column]]:
    """The checks of each family of edits, forward or back (families: fixed values).  `anchor` is the paragraph that an
    inline edit goes to, or the heading that moves; `equations` are the output's equation texts."""
    if forward:
        add = forward_add(before, after, marker)
        return {
            "bibliography": add,
            "caption": add,
            "citation": forward_inline(before, after, marker, anchor),
            "section_reorder": forward_reorder(before, after, anchor),
            "equation": forward_equation(before, after, marker, equations),
            "table_structural": forward_table(before, after, marker),
        }
    add = inverse_add(before, after, marker)
    return {
        "bibliography": add,
        "caption": add,
        "citation": inverse_inline(before, after, marker),
        "section_reorder": inverse_reorder(before, after),
        "equation": inverse_equation(before, after, marker, equations),
        "table_structural": inverse_table(before, after, marker),
    }


def task_completed(returncode: Column, timed_out: Column, changed: Column, graded: Column) -> Column:
    """A killed process still counts if it left a changed output that passes."""
    ran = F.coalesce((returncode == 0) & ~timed_out, F.lit(False))
    return ran | F.coalesce(changed & (graded == "pass"), F.lit(False))


def chain_status(pairs: Column) -> Column:
    """Struct (status, n_graded, restored) of an ordered array of (readable, fwd, inv).

    A pair whose input is unreadable blocks the chain, and later pairs are not looked at; a pair that did not pass both
    ways leaves the chain completed with failure.
    """
    start = F.struct(F.lit("completed").alias("status"), F.lit(0).cast("long").alias("n_graded"), F.lit(True).alias("restored"))

    def step(state: Column, p: Column) -> Column:
        good = F.coalesce((p["fwd"] == "pass") & (p["inv"] == "pass"), F.lit(False))
        stop = ~F.coalesce(p["readable"], F.lit(False))
        after = F.struct(
            F.when(stop, "blocked").when(good, state["status"]).otherwise("completed_with_failure").alias("status"),
            (state["n_graded"] + F.when(stop, 0).otherwise(1)).cast("long").alias("n_graded"),
            (good & ~stop).alias("restored"),
        )
        return F.when(state["status"] == "blocked", state).otherwise(after)

    return F.aggregate(pairs, start, step)
