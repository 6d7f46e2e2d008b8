"""Near copies by the sets of five-word shingles, all pairs of Jaccard similarity 0.8 or more.

Equal sets collapse first. SimHash fingerprints of the sets, compared bit-sliced, find the closest copies; links within
three bits are confirmed on the sets. Fingerprints that leave out no pair would have to be compared within about 18 of 64
bits, which bit blocks cannot index, so the rest have exact candidates: in one order of all shingles, two sets of
similarity s share a shingle among the first n - ceil(s n) + 1 of each set's n, whatever the order is. The order puts
frequent shingles last, by counts in a table of hashed cells of fixed size, so that common passages make few candidates;
wrong counts cost time only.

Candidates are tested twice. Parity sketches, about a bit a shingle, differ in no more bits than the sets differ in
elements, so too many differing bits rule a pair out and no link is lost; what is left is confirmed on the whole sets,
which only their texts give.

A group of copies is no set of all its pairs: first each set is confirmed with one other of its keys, then with one of each
key; pairs inside one component need no test any more, and what is left between components is tested pair by pair, where both
sets have enough shingles left from the shared one on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_BASE, prefix_sums, ship, slices, span_hashes, staged, text_buffers, word_bounds, word_hashes
from .components import components
from .simhash import fingerprint_links, fingerprints

#: Cells of the frequency table; a cell is frequent if it holds FREQUENT times the mean, so at most CELLS / FREQUENT are.
CELLS_LOG2, FREQUENT = 22, 4
#: Bits of the map that tells tasks which whole sets are wanted, 8 MiB whatever the input; a full map only filters less.
WANTED_LOG2, MAP_BITS = 26, 1 << 15


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each document's shingles; A-Z count as a-z, fewer words make one shingle."""
    starts, ends, bounds = word_bounds(data, offsets)
    lower = np.where((data >= 65) & (data <= 90), data + 32, data)
    sums = prefix_sums(word_hashes(lower, starts, ends) if len(starts) else np.zeros(0, np.uint64), WORD_BASE)
    for first, last in zip(bounds[:-1], bounds[1:]):
        size = min(int(last - first), shingle)
        at = np.arange(first, last - size + 1 if size else first)
        yield np.unique(span_hashes(sums, at, at + size, WORD_BASE))


def set_hash(values: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(values.tobytes()) - (1 << 63) if len(values) else 0


def cells_of(shingle: int):
    """Texts -> (cell, n): how many of a task's sets hold a shingle of the cell, if more than mostly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELLS_LOG2, np.int64)
        for batch in slices(batches):
            for values in shingle_sets(*text_buffers(batch.column("text")), shingle):
                np.add.at(counts, values >> np.uint64(64 - CELLS_LOG2), 1)
        # Cells that are rare in a task are left out: few of them are frequent in all.
        cells = np.flatnonzero(counts >= max(2, 2 * counts.mean()))
        for part in np.array_split(cells, len(cells) // 100_000 + 1):
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[part])], ["cell", "n"])

    return run


def prefix_length(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def parity_sketch(values: np.ndarray) -> np.ndarray:
    """Bits, a power of two and at least as many as values: bit i is 1 if an odd number of values falls into cell i."""
    log2 = max(6, (max(len(values), 1) - 1).bit_length())
    return (np.bincount((values >> np.uint64(64 - log2)).astype(np.int64), minlength=1 << log2) & 1).astype(np.uint8)


def differing_bits(one: np.ndarray, two: np.ndarray) -> int:
    """At most the number of elements by which two sets differ; the longer sketch is folded to the shorter one's cells."""
    while len(one) != len(two):
        one, two = (x[0::2] ^ x[1::2] if len(x) == max(len(one), len(two)) else x for x in (one, two))
    return int(np.count_nonzero(one != two))


SIGNED = "doc_id long, set long, fresh boolean, n int, fp long, sketch binary, rare array<long>, often array<long>"


def sign(shingle: int, similarity: float, cells: np.ndarray, counts: np.ndarray):
    """Texts -> doc_id, set (hash of the shingle set); and once a set and task (fresh) n (its size), fp, sketch, and its
    prefix: rare and often, its first shingles in the common order, by whether the table of cells holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            sets, fresh, sizes, prints, sketches, rare, frequent = [], [], [], [], [], [], []
            for values in shingle_sets(*text_buffers(batch.column("text")), shingle):
                sets.append(set_hash(values))
                fresh.append(sets[-1] not in seen)
                seen.add(sets[-1])
                sizes.append(len(values))
                if not fresh[-1]:
                    prints.append(0)
                    sketches.append(b"")
                    rare.append(values[:0].view(np.int64))
                    frequent.append(rare[-1])
                    continue
                cell = values >> np.uint64(64 - CELLS_LOG2)
                often = np.zeros(len(values), np.int64)
                if len(cells):
                    place = np.minimum(np.searchsorted(cells, cell), len(cells) - 1)
                    often = np.where(cells[place] == cell, counts[place], 0)
                first = np.lexsort((values, often))[: prefix_length(len(values), similarity)]
                rare.append(values[first[often[first] == 0]].view(np.int64))
                frequent.append(values[first[often[first] > 0]].view(np.int64))
                prints.append(int(fingerprints(values, np.array([0, len(values)])).view(np.int64)[0]))
                sketches.append(np.packbits(parity_sketch(values)).tobytes())
            lists = [pa.ListArray.from_arrays(np.append(0, np.cumsum([len(p) for p in part])).astype(np.int32), np.concatenate(part)) for part in (rare, frequent)]
            columns = [batch.column("doc_id"), pa.array(sets, pa.int64()), pa.array(fresh), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), pa.array(sketches, pa.binary()), *lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "set", "fresh", "n", "fp", "sketch", "rare", "often"])

    return run


def whole_sets(shingle: int, wanted: np.ndarray):
    """Texts -> set, shingles; sets whose bit of the map is 0, and those that the task has given already, are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            names, found = [], []
            for values in shingle_sets(*text_buffers(batch.column("text")), shingle):
                name = set_hash(values)
                cell = (name & 0xFFFFFFFFFFFFFFFF) >> (64 - WANTED_LOG2)
                if (wanted[cell >> 3] >> (cell & 7)) & 1 and name not in seen:
                    seen.add(name)
                    names.append(name)
                    found.append(values)
            if names:
                lengths = np.append(0, np.cumsum([len(v) for v in found])).astype(np.int32)
                lists = pa.ListArray.from_arrays(lengths, np.concatenate(found).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), lists], ["set", "shingles"])

    return run


def map_of(sets: DataFrame) -> np.ndarray:
    """The bits of all sets' hashes, in a map of fixed size; at most 2048 rows of 4 KiB come to the driver."""
    cell = F.shiftrightunsigned("set", 64 - WANTED_LOG2)
    parts = sets.groupBy((cell / MAP_BITS).cast("int").alias("part")).agg(F.bitmap_construct_agg(cell % MAP_BITS).alias("map"))
    out = np.zeros((1 << WANTED_LOG2) // 8, np.uint8)
    for row in parts.collect():
        out[row["part"] * MAP_BITS // 8 : (row["part"] + 1) * MAP_BITS // 8] = np.frombuffer(row["map"], np.uint8)
    return out


def judged(pairs: DataFrame, table: DataFrame, value: str, good) -> DataFrame:
    """The pairs (a, b) of which good(n of a, n of b, value of a, value of b) holds."""
    side = lambda name, n, x: table.select(F.col("set").alias(name), F.col("n").alias(n), F.col(value).alias(x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, x, y = (batch.column(c) for c in ("n", "m", "x", "y"))
            kept = [good(n[i].as_py(), m[i].as_py(), x[i], y[i]) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return pairs.join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of sets that are similar enough: those whose sketches allow it, judged by the whole sets."""

    def possible(n, m, x, y):
        if min(n, m) < max(n, m) * similarity - 1e-9:
            return False
        one, two = (np.unpackbits(np.frombuffer(v.as_buffer(), np.uint8)) for v in (x, y))
        return differing_bits(one, two) <= (n + m) * (1 - similarity) / (1 + similarity) + 1e-9

    def similar(n, m, x, y):
        one, two = (v.values.to_numpy(zero_copy_only=False) for v in (x, y))
        common = len(np.intersect1d(one, two, assume_unique=True))
        return common >= similarity * (n + m - common) - 1e-9

    left = staged(judged(pairs.distinct(), classes, "sketch", possible), "possible")
    wanted = left.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    bits = map_of(wanted)
    if not bits.any():
        return left  # no pair, so no set is wanted and the texts need not be read
    sets = texts.select("text").mapInArrow(whole_sets(shingle, bits), "set long, shingles array<long>")
    sets = staged(sets.join(wanted, "set", "left_semi").dropDuplicates(["set"]).withColumn("n", F.size("shingles")), "sets")
    return judged(left, sets, "shingles", similar)


def meeting(larger: DataFrame, smaller: DataFrame, similarity: float) -> DataFrame:
    """Rows key, set, n, left, root -> (a, b): sets of other components that a key leaves possible, larger ones (by n, set)
    from the first table with smaller ones from the second.

    Two similar sets share similarity / (1 + similarity) of their sizes' sum or more, all of it from their first common key
    on, so there both have as many left. The smaller one then has enough left for a set of its own size too: where a key
    comes later than that in all texts, as that of a common passage does, no two meet."""
    enough = lambda left, sizes: (1 + similarity) * left >= similarity * sizes - 1e-6
    a, b = larger.alias("a"), smaller.where(enough(F.col("left"), 2 * F.col("n"))).alias("b")
    apart = F.expr("a.key = b.key and a.root != b.root and (a.n > b.n or a.n = b.n and a.set > b.set)")
    apart &= enough(F.least("a.left", "b.left"), F.col("a.n") + F.col("b.n"))
    return a.join(b, apart).select(F.least("a.set", "b.set").alias("a"), F.greatest("a.set", "b.set").alias("b"))


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id: documents linked through pairs whose shingle sets have Jaccard `similarity` or more.

    component_id is the smallest doc_id reachable, itself included (null only if no member has an id). Empty, blank or
    null texts have the empty set and are linked with each other. Repeated rows stay rows. Very long texts are handled
    alone, whole. Other columns are ignored. An empty table gives an empty result. Sets count as equal by 64-bit hashes.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    table = staged(texts.select("text").mapInArrow(cells_of(shingle), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")), "cells")
    mean = (table.agg(F.sum("n")).first()[0] or 0) / (1 << CELLS_LOG2)
    often = table.where(F.col("n") > F.lit(max(1.0, FREQUENT * mean))).orderBy("cell").toPandas()  # at most CELLS / FREQUENT rows
    cells, counts = often["cell"].to_numpy(np.uint64), often["n"].to_numpy(np.int64)
    signed = staged(texts.mapInArrow(sign(shingle, similarity, cells, counts), SIGNED), "signed")
    fresh = signed.where("fresh")
    classes = staged(fresh.select("set", "n", "fp", "sketch").dropDuplicates(["set"]), "classes")
    one_of = lambda pairs: confirm(pairs, classes, texts, shingle, similarity)

    # SimHash: sets of one fingerprint with its first one, and the first ones of linked fingerprints.
    prints = staged(classes.where("n > 0").groupBy("fp").agg(F.min("set").alias("first")), "fingerprints")
    equal = classes.where("n > 0").join(prints, "fp").where("set != first").select(F.col("first").alias("a"), F.col("set").alias("b"))
    first = lambda name: prints.select(F.col("fp").alias(name + "_fp"), F.col("first").alias(name))
    linked = fingerprint_links(prints.select("fp")).select(F.col("a").alias("a_fp"), F.col("b").alias("b_fp"))
    linked = linked.join(first("a"), "a_fp").join(first("b"), "b_fp").select("a", "b")
    roots = components(one_of(equal.unionByName(linked)))

    # Keys of several sets. Rare ones have few rows, which one window sees; frequent ones are counted before they are joined.
    # left: a set's shingles from this key on, in the common order.
    keyed = lambda column, before: fresh.select(F.posexplode(column).alias("at", "key"), "set", "n", before.alias("before")).select("key", "set", "n", (F.col("n") - F.col("before") - F.col("at")).alias("left"))
    of_key = Window.partitionBy("key")
    rare = keyed("rare", F.lit(0)).select("*", F.min("set").over(of_key).alias("lo"), F.max("set").over(of_key).alias("hi")).where("lo < hi").drop("lo", "hi").dropDuplicates(["key", "set"])
    often = staged(keyed("often", F.size("rare")).distinct(), "frequent")
    several = staged(often.groupBy("key").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1"), "several")
    shared = staged(rare.unionByName(often.join(several, "key", "left_semi")), "shared")
    near = lambda n, m: F.least(n, m) >= F.greatest(n, m) * F.lit(similarity - 1e-9)

    def placed() -> DataFrame:
        return staged(shared.join(roots, F.col("set") == F.col("node"), "left").select("key", "set", "n", "left", F.coalesce("root", "set").alias("root")), "placed")

    def grown(pairs: DataFrame) -> DataFrame:
        """The components with new links: what is linked already is as many links as sets."""
        return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(one_of(pairs)))

    # A star a key: each set with the key's first one. Of all stars that a set is in, that of the first centre counts alone
    # at first, which joins most of a large group at a pair a set; then those that still lead to another component, with
    # an order of its own for each key, so that a set meets as many centres of a group as it has keys there; and once again
    # with other centres, for what has not met one that it is like.
    for again in range(3):
        h = F.xxhash64("set", "key", F.lit(again)) if again else F.xxhash64("set")
        first = F.min(F.struct(h.alias("h"), F.col("set").alias("b"), F.col("n").alias("m"), F.col("root").alias("r"))).alias("first")
        at = placed()
        stars = at.join(staged(at.groupBy("key").agg(first), "first"), "key").select(F.col("set").alias("a"), "n", "root", "first.*")
        stars = stars.where((F.col("root") != F.col("r")) & near(F.col("n"), F.col("m")))
        if not again:
            stars = stars.groupBy("a").agg(F.min(F.struct("h", "b")).alias("first")).select("a", "first.b")
        pairs = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        roots = grown(pairs)

    # All that is left: sets outside a key's main component with those of other components.
    at = placed()
    main = at.groupBy("key", "root").agg(F.count(F.lit(1)).alias("sets")).groupBy("key").agg(F.max_by("root", F.struct("sets", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("key", "main")
    mixed = staged(at.join(main, "key").withColumn("outside", F.col("root") != F.col("main")), "mixed")
    pairs = meeting(mixed.where("outside"), mixed, similarity).unionByName(meeting(mixed.where("not outside"), mixed.where("outside"), similarity))
    roots = grown(pairs)

    members = signed.groupBy("set").agg(F.min("doc_id").alias("first_doc")).join(roots, F.col("set") == F.col("node"), "left")
    members = staged(members.select("set", "first_doc", F.coalesce("root", "set").alias("root")), "members")
    least = members.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    return signed.select("doc_id", "set").join(members.join(least, "root").select("set", "component_id"), "set").select("doc_id", "component_id")
