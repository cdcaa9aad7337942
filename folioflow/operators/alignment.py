"""Ordered sequence alignment.  Catalyst has no operator for it, so these run on Arrow batches, one document a row.

Matching blocks are those of the standard library's SequenceMatcher without junk heuristics: the longest common
block first, then both sides of it.  Fuzzy matching is limited by a budget of pairs for a document; a document beyond
it keeps its exact matches and is scored on them, with the status `exact_only`, as the metric itself is defined.
"""

from __future__ import annotations

import bisect
import difflib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.text import SPACE  # noqa: F401  the column form of _norm

#: rows that are scored at a time
HELD = 256
_ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
PAIR_BUDGET = 400_000
FUZZY_ABOVE = 0.6


def _norm(text: str) -> str:
    return " ".join(text.split()).lower()


def matched_pairs(gold: list[str], cand: list[str]) -> list[tuple[int, int]]:
    """Index pairs of an order-preserving correspondence."""
    if gold == cand:  # the longest common block is all of both; to search for it would be quadratic in repeated items
        return [(i, i) for i in range(len(gold))]
    blocks = difflib.SequenceMatcher(None, gold, cand, autojunk=False).get_matching_blocks()
    return [(b.a + k, b.b + k) for b in blocks for k in range(b.size)]


def inversions(order: list[int]) -> int:
    """Pairs out of order.  Runs of doubling length are merged; a member of the later run passes all greater ones."""
    runs, total = [[x] for x in order], 0
    while len(runs) > 1:
        merged = []
        for left, right in zip(runs[::2], runs[1::2]):
            total += sum(len(left) - bisect.bisect_right(left, x) for x in right)
            merged.append(sorted(left + right))
        runs = merged + ([runs[-1]] if len(runs) % 2 else [])
    return total


def _prf(matched: int, gold: int, cand: int) -> tuple[float, float | None, float | None]:
    precision = matched / cand if cand else float(gold == 0)
    recall = matched / gold if gold else None
    both = None if recall is None else precision + recall
    return precision, recall, 2 * precision * recall / both if both else None


def _rows(sides: DataFrame, doc: str, schema: str, score) -> DataFrame:
    """A row of scores for each document, in batches and without a shuffle.  `score` gets the row's columns."""
    names = [c for c in sides.columns if c != doc]
    key = sides.schema[doc].dataType.simpleString()
    columns = [c.split() for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, HELD):  # texts of a few rows at a time
                some = batch.slice(at, HELD)
                scored = []
                for i in range(some.num_rows):
                    (row,) = some.slice(i, 1).to_pylist()
                    scored.append(score(*(row[c] for c in names)))
                values = zip(*scored)
                yield pa.RecordBatch.from_arrays([some.column(doc), *[pa.array(v, _ARROW[kind]) for v, (_, kind) in zip(values, columns)]], names=[doc, *[c for c, _ in columns]])

    return sides.mapInArrow(run, f"{doc} {key}, {schema}")


def inversion_counts(listed: DataFrame, doc: str) -> DataFrame:
    """(doc, matched, discordant) of a list of positions for each document."""
    return _rows(listed, doc, "matched long, discordant long", lambda positions: (len(positions), inversions(list(positions))))


def align(sides: DataFrame, doc: str) -> DataFrame:
    """Precision, recall and F1 of paragraphs in order; `sides` has doc, gold and cand lists."""

    def score(gold, cand):
        g, c = [_norm(x) for x in gold], [_norm(x) for x in cand]
        n = len(matched_pairs(g, c))
        return (n, *_prf(n, len(g), len(c)))

    return _rows(sides.select(doc, "gold", "cand"), doc, "matched long, precision double, recall double, f1 double", score)


def exact_matches(gold: list[str], cand: list[str]) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Equal texts, the k-th of one side with the k-th of the other, and what is left of gold and cand."""
    places: dict[str, list[int]] = defaultdict(list)
    for i, text in enumerate(gold):
        places[text].append(i)
    turn: Counter[str] = Counter()
    pairs, rest = [], []
    for j, text in enumerate(cand):
        if turn[text] < len(places.get(text, ())):
            pairs.append((places[text][turn[text]], j))
            turn[text] += 1
        else:
            rest.append(j)
    return pairs, sorted(i for text, at in places.items() for i in at[turn[text] :]), rest


def likeness(a: str, matcher: difflib.SequenceMatcher) -> float:
    """The matcher's ratio for its second text and `a`, or 0 where its upper bounds rule a match out."""
    matcher.set_seq1(a)
    if any(bound() <= FUZZY_ABOVE for bound in (matcher.real_quick_ratio, matcher.quick_ratio)):
        return 0.0
    ratio = matcher.ratio()
    return ratio if ratio > FUZZY_ABOVE else 0.0


def fuzzy_matches(gold: list[str], cand: list[str], budget: int = PAIR_BUDGET) -> tuple[list[tuple[int, int]], bool]:
    """Exact matches first; then each candidate left, in order, takes the gold text left that is most like it, the
    first of equally like ones.  Beyond the budget of pairs there are the exact ones alone; the flag tells."""
    pairs, open_gold, rest = exact_matches(gold, cand)
    if len(open_gold) * len(rest) > budget:
        return pairs, False
    matcher = difflib.SequenceMatcher(autojunk=False)
    for j in rest:
        matcher.set_seq2(cand[j])
        like, last = max(((likeness(gold[i], matcher), -i) for i in open_gold), default=(0.0, 0))
        if like:
            pairs.append((-last, j))
            open_gold.remove(-last)
    return pairs, True


def fuzzy_order(sides: DataFrame, doc: str, budget: int = PAIR_BUDGET) -> DataFrame:
    """Reading order over exact and fuzzy matches."""

    def score(gold, cand):
        pairs, whole = fuzzy_matches([_norm(x) for x in gold], [_norm(x) for x in cand], budget)
        wrong = inversions([c for _, c in sorted(pairs)])
        total = len(pairs) * (len(pairs) - 1) // 2
        status = "undefined" if not total else "scored" if whole else "exact_only"
        return len(pairs), wrong, (total - wrong) / total if total else None, status

    return _rows(sides.select(doc, "gold", "cand"), doc, "matched long, discordant long, accuracy double, status string", score)


def token_scores(sides: DataFrame, doc: str) -> DataFrame:
    """F1 over white-space tokens in order; both empty 1, one empty 0."""

    def score(gold, cand):
        g, c = " ".join(gold).split(), " ".join(cand).split()
        if not g or not c:
            return (0, float(not g and not c))
        n = len(matched_pairs(g, c))
        return n, 2 * n / (len(g) + len(c))

    return _rows(sides.select(doc, "gold", "cand"), doc, "matched long, token_f1 double", score)


def drift(sides: DataFrame, doc: str) -> DataFrame:
    """Round trip: the last paragraph that equals the marker goes, the rest is compared with gold."""

    def score(gold, cand, marker):
        g, c, m = [_norm(x) for x in gold], [_norm(x) for x in cand], _norm(marker)
        at = max((i for i, x in enumerate(c) if x == m), default=None)
        if at is None:
            return "marker_missing", None, None
        rest = c[:at] + c[at + 1 :]
        n = len(matched_pairs(g, rest))
        f1 = _prf(n, len(g), len(rest))[2]
        return ("identical" if rest == g else "count_changed" if len(rest) != len(g) else "drifted"), f1, len(rest) - len(g)

    return _rows(sides.select(doc, "gold", "cand", "marker"), doc, "status string, f1 double, count_change long", score)


#: verdicts of a round trip, the first that holds (fixed values)
ROUND_TRIP = {
    "marker": "marker_paragraph_missing_after_round_trip",
    "paragraphs": "unintended_paragraph_drift_detected",
    "tables": "table_count_drift_detected",
    "rows": "table_row_count_drift_detected",
    "labels": "equation_semantic_drift_detected",
    "clean": "clean_round_trip",
}


def round_trip(sides: DataFrame, doc: str) -> DataFrame:
    """What a round trip changed besides the marker that it was to append.

    `sides` has doc, the lists gold and cand of paragraphs, marker, rows and rows_after (row counts of the tables), and
    labels and labels_after (of the equations, as told from their XML).  The last paragraph that equals the marker goes;
    what is left must correspond to gold in full.  Without any paragraph F1 is undefined, which counts as drift.
    """

    def score(gold, cand, marker, rows, rows_after, labels, labels_after):
        before, after, mark = [_norm(x) for x in gold], [_norm(x) for x in cand], _norm(marker)
        at = max((i for i, x in enumerate(after) if x == mark), default=None)
        left = after if at is None else after[:at] + after[at + 1 :]
        f1 = _prf(len(matched_pairs(before, left)), len(before), len(left))[2]
        tables = len(rows) == len(rows_after)
        counts = list(rows) == list(rows_after) if tables else None
        same = list(labels) == list(labels_after)
        state = next((name for name, bad in (("marker", at is None), ("paragraphs", f1 != 1.0), ("tables", not tables), ("rows", not counts), ("labels", not same)) if bad), "clean")
        return at is not None, f1, tables, counts, same, ROUND_TRIP[state]

    schema = "marker_found boolean, f1 double, table_count_stable boolean, row_counts_stable boolean, labels_stable boolean, status string"
    return _rows(sides.select(doc, "gold", "cand", "marker", "rows", "rows_after", "labels", "labels_after"), doc, schema, score)
