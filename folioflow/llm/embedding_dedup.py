"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine >= c lie within squared distance 2 - 2c.  After a fixed random rotation the vector is cut
into blocks of `width` dimensions; if all blocks of a pair were farther apart than their share of that budget
(width / dimensions of it), so would be the pair.  So each block is joined by range within its share, and the union of
the blocks' candidates is verified by the exact cosine in double precision.  A pair counts in the first block within
whose share it lies, so it counts once although no table of pairs is ever built: a task gives partial link counts and
edges of a spanning forest.

The range join of a block has two levels.  Vectors are dealt to cells of a grid over as many of the block's
coordinates as the number of vectors of the label asks for (none while they fit one task): each is at home in one cell
and visits all cells that its ball touches.  A cell's home vectors, in parts of about `part` rows, form a k-d tree over
all coordinates of the block, with tight boxes; the visitors, which need not fit into memory, are streamed through it,
and meet the few vectors of the leaves that their ball touches.

Identical vectors of one label collapse first, with their number: copies link with each other and give all their
links to the others.

Null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing:
n_links 0, own component, kept.  Null ids likewise, with a null component.  Vectors of different lengths never link.
Rows that repeat an id are vectors of their own, of one component.  An empty table gives none.  Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches, by_group, connected_components, meet, partitions

#: slack for rounding in the candidate search; the verification has none
SLACK = 1e-9
#: home vectors of a leaf
LEAF = 6


def rotation(n: int) -> np.ndarray:
    """A fixed orthogonal matrix for n dimensions."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(n)).standard_normal((n, n)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square is lost or overflows
    return x / np.linalg.norm(x, axis=1)[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    """Arrays of one length as rows, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class Tree:
    """A k-d tree; `order` lists the points so that each node holds a run of them."""

    def __init__(self, points: np.ndarray):
        self.points, self.order = points, np.arange(len(points))
        self.root = self._node(0, len(points))

    def _node(self, begin: int, end: int):
        at = self.order[begin:end]
        own = self.points[at]
        low, high = own.min(0), own.max(0)
        if len(at) <= LEAF or not (high > low).any():
            return low, high, begin, end, None
        at[:] = at[np.argsort(own[:, int(np.argmax(high - low))], kind="stable")]
        half = (begin + end) // 2
        return low, high, begin, end, (self._node(begin, half), self._node(half, end))

    def near(self, others: np.ndarray | None, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(points of a leaf, others whose ball touches its box).  Without others, the points of the tree itself, each
        pair of different leaves once."""
        own = others is None
        others = self.points[self.order] if own else others
        stack = [(self.root, np.arange(len(others)))]
        while stack:
            (low, high, begin, end, children), who = stack.pop()
            if own:
                who = who[np.searchsorted(who, begin) :]
            there = others[who]
            off = np.maximum(low - there, there - high)
            np.maximum(off, 0, out=off)
            who = who[np.einsum("ij,ij->i", off, off) <= reach]
            if len(who) and children is None:
                yield self.order[begin:end], self.order[who] if own else who
            elif len(who):
                stack += [(child, who) for child in children]


def _cells(budget: float, width: int, part: int):
    """A row for each class, block and cell that it is at home in or visits; `n` is the number of its label's vectors."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, total = batch["dims"].to_numpy(), batch["n"].to_numpy()
            for dims in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dims)
                turned = unit(_matrix(batch["embedding"].take(pa.array(at)))) @ rotation(dims)
                for b, first in enumerate(range(0, dims, width)):
                    own = turned[:, first : first + width]
                    r = np.sqrt(budget * own.shape[1] / dims + SLACK)
                    side = 4 * r  # so a ball touches two cells along a coordinate at most
                    asked = np.ceil(np.log2(np.maximum(total[at] / part, 1))).astype(int)
                    for m in np.unique(np.minimum(asked, own.shape[1])).tolist():
                        rows = np.flatnonzero(np.minimum(asked, own.shape[1]) == m)
                        lead = own[rows, :m]
                        home = np.floor(lead / side)
                        into = lead - home * side
                        step = np.where(into < side / 2, -1, 1)
                        away = np.minimum(into, side - into) ** 2  # squared distance to the nearer neighbour
                        masks = (np.arange(1 << m)[:, None] >> np.arange(m)) & 1
                        which, how = np.nonzero(away @ masks.T <= r * r)
                        cell = (home[which] + step[which] * masks[how]).astype(np.int16)
                        names = pa.array([x.tobytes() for x in cell], pa.binary())
                        take = pa.array(at[rows[which]])
                        yield pa.RecordBatch.from_arrays(
                            [*(batch[c].take(take) for c in ("label", "dims")), pa.array(np.full(len(which), b, np.int32)), names, pa.array((how != 0).astype(np.int32)), batch["v"].take(take), batch["k1"].take(take)],
                            names=["label", "dims", "block", "cell", "visits", "v", "k1"],
                        )

    return cells


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (vertex, smallest vertex that it reaches) of the graph with edges a-b."""
    names, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j, root = place[: len(a)], place[len(a) :], np.arange(len(names))
    while True:
        new = root.copy()
        np.minimum.at(new, root[i], root[j])
        np.minimum.at(new, root[j], root[i])
        new = new[new]
        if (new == root).all():
            break
        root = new
    rest = root != np.arange(len(names))
    return names[rest], names[root[rest]]


def _join(cosine: float, budget: float, width: int, seen=None):
    """Of each part of a cell, home vectors first: partial link counts (v, n) and edges (v, 0, w).  `seen` is told of
    the number of comparisons."""

    def links(home: dict, tree: Tree, visitors: dict | None = None) -> Iterator[pa.RecordBatch]:
        block, dims, other = home["block"], home["x"].shape[1], visitors or home
        shares = [budget * min(width, dims - i) / dims + SLACK for i in range(0, dims, width)]
        cut = lambda side, b: side["turned"][:, b * width : (b + 1) * width]
        pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        held = 0

        def told() -> Iterator[pa.RecordBatch]:
            i, j = (np.concatenate(x) for x in zip(*pairs))
            if not len(i):
                return
            a, b = home["v"][i], other["v"][j]
            for who, n in ((i, other["copies"][j]), (j, home["copies"][i])):
                own = (home if who is i else other)["v"]
                at, group = np.unique(who, return_inverse=True)
                yield _found(own[at], np.bincount(group, n).astype(np.int64), None)
            v, w = _forest(a, b)
            yield _found(v, np.zeros(len(v), np.int64), w)

        place = np.empty(len(home["v"]), np.int64)
        place[tree.order] = np.arange(len(place))
        for leaf, who in tree.near(cut(visitors, block) if visitors else None, shares[block]):
            if seen is not None:
                seen(len(leaf) * len(who))
            p, q = cut(home, block)[leaf], cut(other, block)[who]
            near = (p**2).sum(1)[:, None] + (q**2).sum(1)[None, :] - 2 * p @ q.T <= shares[block]
            # among home vectors of one part a pair comes once by their order; else its smaller id is at home
            rank = (home["v"], other["v"]) if visitors else (place, place)
            i, j = np.nonzero(near & (rank[0][leaf][:, None] < rank[1][who][None, :]))
            i, j = leaf[i], who[j]
            for b in range(block):
                if len(i):
                    apart = ((cut(home, b)[i] - cut(other, b)[j]) ** 2).sum(1) > shares[b]
                    i, j = i[apart], j[apart]
            if len(i):
                x, y = home["x"][i], other["x"][j]
                ok = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))) >= cosine
                pairs.append((i[ok], j[ok]))
                held += int(ok.sum())
                if held > 1_000_000:
                    yield from told()
                    pairs, held = pairs[:1], 0
        yield from told()

    def side(batch: pa.RecordBatch) -> dict:
        x = _matrix(batch["embedding"])
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return {"v": batch["v"].to_numpy(), "copies": batch["copies"].to_numpy(), "x": x, "turned": unit(x) @ rotation(x.shape[1]), "block": batch["block"][0].as_py()}

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes: list[pa.RecordBatch] = []
        home = tree = None

        def build() -> Iterator[pa.RecordBatch]:
            nonlocal home, tree
            if homes and home is None:
                home = side(pa.Table.from_batches(homes).combine_chunks().to_batches()[0])
                tree = Tree(home["turned"][:, home["block"] * width : (home["block"] + 1) * width])
                yield from links(home, tree)

        for batch in by_group(batches, ["label", "dims", "block", "cell", "p"]):
            if batch is None:
                yield from build()
                homes, home, tree = [], None, None
                continue
            n = int((batch["visits"].to_numpy() == 0).sum())
            if n:
                homes.append(batch.slice(0, n))
            if n < batch.num_rows and homes:
                yield from build()
                yield from links(home, tree, side(batch.slice(n)))

    return join


def _found(v: np.ndarray, n: np.ndarray, w: np.ndarray | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(n, pa.int64()), pa.nulls(len(v), pa.int64()) if w is None else pa.array(w, pa.int64())], names=["v", "n", "w"])


def embedding_components(vectors: DataFrame, cosine: float = 0.98, width: int = 8, part: int = 8192) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of `vectors` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    arrow_batches(spark)
    scratch, budget = Scratch(spark), 2 - 2 * cosine
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("embedding").cast("array<double>").alias("x"), "label")
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists("x", lambda x: x != 0), F.lit(False))
    rows = rows.select("vec_id", F.col("label").cast("string").alias("label"), "embedding", good.alias("good"))
    key = ["label", "k1", "k2"]
    keyed = rows.where("good").select("vec_id", "label", "embedding", F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2"))
    classes = scratch.save(keyed.groupBy(*key).agg(F.min("vec_id").alias("v"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding")), "classes")
    sized = classes.select("v", "k1", "label", F.size("embedding").alias("dims"), "embedding")
    counts = scratch.save(sized.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("n")), "counts")
    place = ["label", "dims", "block", "cell"]
    cells = meet(sized, counts, ["label", "dims"], "v", F.length("label")).select("label", "dims", "n", "v", "k1", "embedding")
    cells = scratch.save(cells.mapInArrow(_cells(budget, width, part), "label string, dims int, block int, cell binary, visits int, v long, k1 long"), "cells")
    crowded = cells.where("visits = 0").groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts")).where("parts > 1")
    crowded = scratch.save(crowded, "crowded")
    dealt = cells.withColumn("parts", F.lit(1)) if crowded.isEmpty() else meet(cells, crowded, place, "v", F.length("label") + 2 * width, "left").fillna(1, ["parts"])
    # every row visits all parts; it is at home in one of them
    dealt = dealt.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("visits", F.when(F.pmod(F.xxhash64("v"), F.col("parts")) == F.col("p"), F.col("visits")).otherwise(1)).drop("parts")
    # vectors join last, and each part of a cell is streamed through one task
    dealt = dealt.join(classes.select("v", "k1", "copies", "embedding").hint("merge"), ["v", "k1"]).repartition(partitions(spark), *place, "p").sortWithinPartitions(*place, "p", "visits")
    found = scratch.save(dealt.mapInArrow(_join(cosine, budget, width), "v long, n long, w long"), "found", free=True)
    scratch.drop(cells)
    comps = connected_components(scratch, found.where(F.col("w").isNotNull()).select(F.col("v").alias("a"), F.col("w").alias("b")))
    links = found.where(F.col("w").isNull()).groupBy("v").agg(F.sum("n").alias("n"))
    named = classes.select(*key, "v", "copies").join(links, "v", "left").join(comps, "v", "left")
    named = named.select(*key, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("comp", "v").alias("component_id"))
    linked = keyed.select("vec_id", *key).join(named, key).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
