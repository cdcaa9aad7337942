"""Near-duplicate documents by MinHash with odd sketches.

A document's set is its distinct 5-word shingles (A-Z lower-cased).  Two documents are linked when
100 * |A & B| >= percent * |A | B|; a component is what links connect.

1. Every set becomes MinHash samples in bands, and an odd sketch: the samples folded into a parity bitmap, in which
   each common sample cancels itself, so that the population count of the XOR of two bitmaps estimates how many
   samples differ.
2. Texts of the same words in the same order, told by the 128-bit BLAKE2b digest of all of them, collapse to their
   smallest id; only those representatives go on.  Equal sets of different texts are pairs like all others.
3. In each band bucket all members meet its hub, the member with most company in all its buckets: one row a
   member, never all pairs.  Pairs whose sketches allow the similarity are confirmed on the words of both; the links
   give first components.  A hub's pairs are dealt to parts of bounded size, and its text goes to each part once.
4. Where a bucket still holds several components, the members outside its largest one meet all others, in blocks of
   bounded size.  First sketches alone leave out all that have no partner within reach in a foreign component; then
   the words, as a product of two incidence matrices, give the links that join components.  So links that no star
   covers are found too, a hot bucket is split, and nothing is capped.

Joins on buckets and hubs go by (key, salt); a table of keys is repeated for the salts that its key has.  Shingles
are compared by numbers that are exact within a task (`hashing.Chunk.exact_shingles`), so no link between different
texts rests on a hash.

Null and empty texts have an empty set: n_shingles 0, linked with nothing.  Null ids form no link and are their
own component (null).  Rows that repeat an id give one row each, in one component; if their texts differ, the id has
the links of all.  Texts of any length are compared whole.  An empty table gives none.  Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches, by_group, connected_components, partitions
from .hashing import Chunk, chunks, groups, mix

BANDS, ROWS = 32, 6
BITS = 512
#: members of one side of a block, while sketches are compared, and members and shingles while words are
SKETCH_BLOCK, WORD_BLOCK, WORD_SHINGLES = 4096, 512, 200_000
#: pairs of a hub that one part holds, and shingles of their texts
PART_PAIRS, PART_SHINGLES = 256, 500_000
#: parts of a hot key in joins
SALTS = 63
_FACTORS = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhash(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each set (its elements start at `begin`) one sample for each factor."""
    out = np.empty((len(begin), len(_FACTORS)), np.uint64)
    for i, f in enumerate(_FACTORS):
        out[:, i] = np.minimum.reduceat(hashes * f, begin)
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of BITS bits: sample i of each set toggles the bit that (i, sample) hashes to."""
    bit = (mix(samples ^ mix(_FACTORS)[None, :]) % np.uint64(BITS)).astype(np.int64)
    count = np.zeros((len(samples), BITS), np.uint8)
    rows = np.repeat(np.arange(len(samples)), samples.shape[1])
    np.add.at(count, (rows, bit.ravel()), 1)
    return np.packbits(count & 1, axis=1, bitorder="little").view(np.int64)


def most_bits(percent: int, sigmas: float = 4.5) -> int:
    """Sketches that differ in more bits belong to sets below the similarity, but for chances under 1e-5."""
    k, j = BANDS * ROWS, percent / 100
    differ = k * (1 - j) + sigmas * np.sqrt(k * j * (1 - j))
    return int(np.ceil(BITS / 2 * (1 - np.exp(-4 * differ / BITS)) + 2))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, texts in chunks(batches):
        chunk = Chunk(texts, lower=True)
        docs, hashes = chunk.shingles()
        n = np.bincount(docs, minlength=len(texts)).astype(np.int64)
        full = np.flatnonzero(n)
        begin = groups(docs)
        key = np.zeros((len(texts), 2), np.uint64)
        bands = [None] * len(texts)
        sketch = [None] * len(texts)
        if len(full):
            digests = b"".join([hashlib.blake2b(chunk.canon[d], digest_size=16).digest() for d in full.tolist()])
            key[full] = np.frombuffer(digests, np.uint64).reshape(-1, 2)
            samples = minhash(hashes, begin)
            band = np.zeros((len(full), BANDS), np.uint64)
            for r in range(ROWS):
                band = mix(band ^ samples[:, r::ROWS]) + np.uint64(r + 1)
            band = mix(band + mix(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :]).view(np.int64)
            odd = odd_sketch(samples)
            for at, d in enumerate(full):
                bands[d], sketch[d] = band[at], odd[at]
        yield pa.RecordBatch.from_arrays(
            [table["doc_id"].combine_chunks(), pa.array(n), pa.array(key[:, 0].view(np.int64)), pa.array(key[:, 1].view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))],
            names=["doc_id", "n", "k1", "k2", "bands", "sketch"],
        )


def _confirm(percent: int):
    """Rows sorted by (a, part, is_pair): the text of the hub a (its texts, if it repeats), then its pairs' b and text."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hubs, key = [], None  # the hub whose pairs go on in the next batch
        for table, texts in chunks(batches):
            a, part, pair = (table[c].to_numpy() for c in ("a", "part", "is_pair"))
            if key != (a[0], part[0]):
                hubs = []
            held, texts = len(hubs), hubs + texts
            rows = np.arange(len(texts))
            change = np.concatenate((np.zeros(held + 1, bool), (a[1:] != a[:-1]) | (part[1:] != part[:-1])))
            group = np.cumsum(change)
            begin = np.flatnonzero(np.concatenate(([True], change[1:])))[group]
            is_hub = np.concatenate((np.ones(held, bool), pair == 0))
            docs, ids = Chunk(texts, lower=True).exact_shingles()
            size = np.bincount(docs, minlength=len(texts))
            keyed = group[docs] * (int(ids.max(initial=0)) + 1) + ids
            ok = np.zeros(len(texts), bool)
            for turn in range(int((rows - begin)[is_hub].max(initial=-1)) + 1):  # one turn, but where a hub's id has several texts
                hub = is_hub & (rows - begin == turn)
                both = np.bincount(docs[~is_hub[docs] & np.isin(keyed, keyed[hub[docs]])], minlength=len(texts))
                against = np.zeros(int(group[-1]) + 1, np.int64)
                against[group[hub]] = size[hub]
                ok |= (both > 0) & (100 * both >= percent * (size + against[group] - both))
            key = (a[-1], part[-1])
            hubs = [texts[i] for i in np.flatnonzero(is_hub & (group == group[-1]))]
            found = table.filter(pa.array(ok[held:]))
            yield pa.RecordBatch.from_arrays([found["a"].combine_chunks(), found["b"].combine_chunks()], names=["a", "b"])

    return confirm


def _alike(x: str, y: str, most: int) -> Column:
    """Population count of the XOR of two sketches, in words of 64 bits."""
    bits = [F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(BITS // 64)]
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return total <= most


def _sides(batches: Iterator[pa.RecordBatch], act) -> Iterator[pa.RecordBatch]:
    """Calls act(left, right) for each block (key, i, j) of rows sorted so; right are the rows of side 1."""
    held: list[pa.RecordBatch] = []
    for part in by_group(batches, ["key", "i", "j"]):
        if part is not None:
            held.append(part)
            continue
        block, held = pa.Table.from_batches(held), []
        side = block["side"].to_numpy()
        left, right = block.filter(pa.array(side == 0)), block.filter(pa.array(side == 1))
        if left.num_rows and right.num_rows:
            yield from act(left, right)


def _array(table: pa.Table, name: str) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    return table[name].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)


def _meeting(most: int):
    """Of each block, the members that have a partner in a foreign component within the sketches' reach.
    Two members meet in the first of their common buckets only."""

    def of_block(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        ls, rs = (_array(t, "sketch").view(np.uint64) for t in (left, right))
        lb, rb = _array(left, "bands"), _array(right, "bands")
        lc, rc = left["comp"].to_numpy(), right["comp"].to_numpy()
        band = int(np.flatnonzero(lb[0] == left["key"][0].as_py())[0])
        met = [np.zeros(len(lc), bool), np.zeros(len(rc), bool)]
        for at in range(0, len(lc), 64):
            part = slice(at, at + 64)
            differ = np.bitwise_count(ls[part, None, 0] ^ rs[None, :, 0]).astype(np.uint16)
            for word in range(1, ls.shape[1]):
                differ += np.bitwise_count(ls[part, None, word] ^ rs[None, :, word])
            i, j = np.nonzero((differ <= most) & (lc[part, None] != rc[None, :]))
            for a in range(0, len(i), 100_000):
                x, y = i[a : a + 100_000] + at, j[a : a + 100_000]
                here = ~(lb[x, :band] == rb[y, :band]).any(1)
                met[0][x[here]] = met[1][y[here]] = True
        columns = ["key", "v", "n", "comp"]
        for side, table in enumerate((left, right)):
            found = table.filter(pa.array(met[side])).select(columns)
            for batch in found.to_batches():
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.full(batch.num_rows, x), pa.int64()) for x in (left["i"][0].as_py(), left["j"][0].as_py(), side))], names=[*columns, "bi", "bj", "side"])

    return lambda batches: _sides(batches, of_block)


def _links(percent: int):
    """Of each block, on words, enough links to join all components that are linked there."""

    def of_block(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        n_left, n_right = left.num_rows, right.num_rows
        chunk = Chunk([t for part in (left, right) for t in part["text"].cast(pa.binary()).to_pylist()], lower=True)
        docs, ids = chunk.exact_shingles()
        size = np.bincount(docs, minlength=n_left + n_right)
        shared = np.intersect1d(ids[docs < n_left], ids[docs >= n_left])
        known = np.isin(ids, shared)
        docs, column = docs[known], np.searchsorted(shared, ids[known])
        both = np.zeros((n_left, n_right), np.float32)
        for at in range(0, len(shared), 4096):
            some = (column >= at) & (column < at + 4096)
            sets = np.zeros((n_left + n_right, 4096), np.float32)
            sets[docs[some], column[some] - at] = 1
            both += sets[:n_left] @ sets[n_left:].T
        both = both.astype(np.int64)
        comp = [t["comp"].to_numpy() for t in (left, right)]
        linked = (100 * both >= percent * (size[:n_left, None] + size[None, n_left:] - both)) & (both > 0) & (comp[0][:, None] != comp[1][None, :])
        i, j = np.nonzero(linked)
        _, first = np.unique(np.stack((comp[0][i], comp[1][j]), 1), axis=0, return_index=True) if len(i) else (None, np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(comp[k][x[first]]) for k, x in ((0, i), (1, j))], names=["a", "b"])  # one link of two components is enough

    return lambda batches: _sides(batches, of_block)


def _salt(of: str) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(SALTS)).cast("int")


def _salted(rows: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """For each value of `by`: its `more` aggregates, repeated for each salt that its rows have."""
    found = rows.groupBy(*by).agg(*more, F.bit_or(F.expr("shiftleft(1L, salt)")).alias("_salts"))
    salts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.getbit("_salts", s) == 1)
    return found.withColumn("salt", F.explode(salts)).drop("_salts")


def _blocks(left: DataFrame, right: DataFrame, group: list[str], members: int, shingles: int) -> DataFrame:
    """Rows of both sides (v, n, ...) dealt to blocks (i, j) of their group: i counts parts of the left side, j of the
    right one; every row goes to all parts of the other side.  Part numbers follow the members and their shingles."""
    rows = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1))).withColumn("salt", _salt("v"))

    def lots(side: int) -> Column:
        own = F.col("side") == side
        return F.ceil(F.greatest(F.count_if(own) / members, F.sum(F.when(own, F.col("n"))) / shingles)).cast("int")

    rows = rows.join(_salted(rows, group, lots(0).alias("lefts"), lots(1).alias("rights")), [*group, "salt"])
    is_left = F.col("side") == 0
    part = lambda c: F.pmod(F.xxhash64("v"), F.col(c)).cast("int")
    rows = rows.withColumn("own", F.when(is_left, part("lefts")).otherwise(part("rights")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(is_left, F.col("rights")).otherwise(F.col("lefts")) - 1)))
    return rows.withColumn("i", F.when(is_left, F.col("own")).otherwise(F.col("other"))).withColumn("j", F.when(is_left, F.col("other")).otherwise(F.col("own"))).drop("lefts", "rights", "own", "other", "salt")


def minhash_components(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    arrow_batches(spark)
    scratch, most, tasks = Scratch(spark), most_bits(percent), partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = scratch.save(docs.mapInArrow(_sketch, "doc_id long, n long, k1 long, k2 long, bands array<long>, sketch array<long>"), "sketches")
    usable = sketches.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = scratch.save(usable.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("v"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    keys = classes.select("v", F.explode("bands").alias("key"), _salt("v").alias("salt"))
    shared = _salted(keys, ["key"], F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    members = scratch.save(keys.join(shared, ["key", "salt"]), "members", free=True)
    # the hub of a bucket is the member that shares most with others: of edited copies that is their origin
    weight = members.groupBy("v").agg(F.sum("size").alias("weight"))
    hubs = _salted(members.join(weight, "v"), ["key"], F.max_by("v", F.struct("weight", -F.col("v"))).alias("hub"))
    first = members.join(hubs, ["key", "salt"]).where(F.col("v") != F.col("hub")).select(F.col("hub").alias("a"), F.col("v").alias("b"), _salt("v").alias("salt")).distinct()
    detail = classes.select("v", "n", "sketch")
    first = scratch.save(first.join(detail.toDF("b", "n", "sb"), "b"), "met")
    stars = _salted(first, ["a"], F.ceil(F.greatest(F.count(F.lit(1)) / PART_PAIRS, F.sum("n") / PART_SHINGLES)).cast("int").alias("parts")).join(detail.select(F.col("v").alias("a"), F.col("sketch").alias("sa")), "a")
    part = F.pmod(F.xxhash64("b", F.lit(1)), F.col("parts")).cast("int")
    pairs = scratch.save(first.join(stars, ["a", "salt"]).where(_alike("sa", "sb", most)).select("a", part.alias("part"), "b"), "pairs")
    scratch.drop(first)

    def texts_of(ids: DataFrame) -> DataFrame:
        """Texts that are needed; only these are moved more than once.  A merge join at any size, for the number of
        ids follows the corpus."""
        return scratch.save(docs.join(ids.distinct().hint("merge"), "doc_id").dropDuplicates(), "texts", free=True)

    texts = texts_of(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")))
    of_hub = pairs.select(F.col("a").alias("doc_id"), "part").distinct().join(texts, "doc_id").select(F.col("doc_id").alias("a"), "part", F.lit(0).alias("is_pair"), F.lit(None).cast("long").alias("b"), "text")
    of_pair = pairs.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "part", F.lit(1).alias("is_pair"), "b", "text")
    stars = of_hub.unionByName(of_pair).repartition(tasks, "a", "part").sortWithinPartitions("a", "part", "is_pair")
    links = scratch.save(stars.mapInArrow(_confirm(percent), "a long, b long").distinct(), "links", free=True)
    scratch.drop(texts, pairs)
    comps = connected_components(scratch, links)

    # What the stars left: in buckets that still hold several components, the members outside the largest.
    named = members.join(comps, "v", "left").select("key", "v", "salt", F.coalesce("comp", "v").alias("comp"))
    totals = named.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"))
    mixed = totals.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count(F.lit(1)).alias("comps"), F.bit_or("salts").alias("salts")).where(F.col("comps") > 1)
    mixed = mixed.select("key", "main", F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.getbit("salts", s) == 1)).alias("salt"))
    mixed = scratch.save(named.join(mixed, ["key", "salt"]).join(classes.select("v", "n"), "v"), "mixed")
    if not mixed.isEmpty():
        dealt = _blocks(mixed.where(F.col("comp") != F.col("main")).drop("salt"), mixed.drop("salt"), ["key"], SKETCH_BLOCK, 1 << 40)
        block = ["key", "i", "j"]
        # an id with several texts has several sketches, of which those belong here that have the bucket's band
        rows = dealt.join(classes.select("v", "sketch", "bands"), "v").where(F.array_contains("bands", F.col("key"))).select(*block, "side", "v", "n", "comp", "sketch", "bands").repartition(tasks, *block).sortWithinPartitions(*block)
        met = rows.mapInArrow(_meeting(most), "key long, v long, n long, comp long, bi long, bj long, side long")
        met = scratch.save(met, "met")
        texts = texts_of(met.select(F.col("v").alias("doc_id")))
        dealt = _blocks(met.where("side = 0").drop("side"), met.where("side = 1").drop("side"), ["key", "bi", "bj"], WORD_BLOCK, WORD_SHINGLES)
        # a block's name within (bi, bj) is made one number, so that blocks are told apart by (key, i, j)
        dealt = dealt.withColumn("i", F.xxhash64("bi", "i")).withColumn("j", F.xxhash64("bj", "j"))
        full = dealt.join(texts.withColumnRenamed("doc_id", "v"), "v").select(*block, "side", "v", "comp", "text").repartition(tasks, *block).sortWithinPartitions(*block)
        more = scratch.save(full.mapInArrow(_links(percent), "a long, b long").distinct(), "links", free=True)
        scratch.drop(met, texts)
        if not more.isEmpty():  # these links join components
            joined = connected_components(scratch, more).toDF("comp", "whole")
            roots = more.select(F.col("a").alias("v")).union(more.select("b")).distinct()
            comps = comps.unionByName(roots.select("v", F.col("v").alias("comp"))).distinct()
            comps = comps.join(joined, "comp", "left").select("v", F.coalesce("whole", "comp").alias("comp"))
    scratch.drop(members, mixed)

    whole = classes.select("k1", "k2", "n", "v").join(comps, "v", "left").select("k1", "k2", "n", F.coalesce("comp", "v").alias("comp"))
    empty = sketches.where((F.col("n") == 0) | F.col("doc_id").isNull()).select("doc_id", "n", F.col("doc_id").alias("component_id"))
    linked = usable.select("doc_id", "k1", "k2", "n").join(whole, ["k1", "k2", "n"]).select("doc_id", "n", F.col("comp").alias("component_id"))
    rows = linked.unionByName(empty)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
