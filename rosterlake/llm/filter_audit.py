"""How quality filters interact: what every order of them keeps and removes, counted in one pass by packed counters.

A document is known by the mask of filters that it fails. In each order of the filters it is removed at one step at most,
so a mask stands for a big integer with one field for every (order, step), 600 for five filters, and a last field for
the document itself. Adding these integers adds all outcomes at once; fields have 64 bits, so none runs over into
the next before 2**64 documents. Every task adds up what it reads for each part, sums meet in two steps, and the
three sums of a part (all documents, good ones, toxic ones) are unpacked at the end.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, slices

FILTERS = "ABCDE"
#: Least words, least share of distinct words and largest share of capitals, both in hundredths.
WORDS, DISTINCT, CAPITALS = 200, 50, 2
MARKS = re.compile(rb"[#$%&*|]")
FIELD_BITS = 64
#: Parts whose sums a task holds at once; beyond, it passes them on and begins anew.
HELD_PARTS = 1000
#: Tasks among which the sums of one part are dealt before they meet.
SPREAD = 64
SUMS = "part string, spread int, whole binary, good binary, toxic binary"
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(raw: bytes) -> int:
    """Mask of the filters that look at a text alone. Words are runs of bytes outside 0x20 and 0x09-0x0D."""
    words = raw.split()
    data = np.frombuffer(raw, np.uint8)
    n, distinct = len(words), len(set(words))
    capitals, points = np.count_nonzero((data >= 65) & (data <= 90)), np.count_nonzero((data & 0xC0) != 0x80)
    return (n < WORDS) | (100 * distinct < DISTINCT * n) << 1 | bool(100 * capitals > CAPITALS * points) << 2 | bool(MARKS.search(raw)) << 3


def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [x or b"" for x in batch.column("text").cast(pa.large_binary()).to_pylist()]
        mask = pa.array([failures(x) for x in texts], pa.int32())
        digest = pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), digest, mask], names=["doc_id", "part", "digest", "mask"])


@cache
def packed(filters: int) -> list[int]:
    """The integer of every mask."""
    out = []
    for mask in range(1 << filters):
        total = 1 << FIELD_BITS * filters * len(orders(filters))
        for number, order in enumerate(orders(filters)):
            step = next((i for i, f in enumerate(order) if mask >> f & 1), None)
            if step is not None:
                total |= 1 << FIELD_BITS * (number * filters + step)
        out.append(total)
    return out


@cache
def orders(filters: int) -> list[tuple[int, ...]]:
    return list(permutations(range(filters)))


def unpacked(total: int, filters: int) -> tuple[np.ndarray, int]:
    """Removed documents by order and step, and the number of all."""
    fields = filters * len(orders(filters))
    data = np.frombuffer(total.to_bytes((fields + 1) * FIELD_BITS // 8, "little"), "<u8")
    return data[:fields].reshape(-1, filters).astype(np.int64), int(data[fields])


def sums_batch(sums: dict[str, list[int]], spread: int, filters: int) -> pa.RecordBatch:
    size = (filters * len(orders(filters)) + 1) * FIELD_BITS // 8
    columns = [pa.array([v[i].to_bytes(size, "little") for v in sums.values()], pa.binary()) for i in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([spread] * len(sums), pa.int32()), *columns], names=["part", "spread", "whole", "good", "toxic"])


def add_masks(batches: Iterator[pa.RecordBatch], filters: int) -> Iterator[pa.RecordBatch]:
    """part, mask, good, toxic, n -> what a task holds of every part, as integers."""
    from pyspark import TaskContext

    spread, sums, of_mask = TaskContext.get().partitionId() % SPREAD, {}, packed(filters)
    for batch in batches:
        for part, mask, good, toxic, n in zip(*(batch.column(c).to_pylist() for c in ("part", "mask", "good", "toxic", "n"))):
            if part not in sums and len(sums) >= HELD_PARTS:
                yield sums_batch(sums, spread, filters)
                sums = {}
            held, outcomes = sums.setdefault(part, [0, 0, 0]), of_mask[mask] * n
            held[0] += outcomes
            held[1] += outcomes * good
            held[2] += outcomes * toxic
    if sums:
        yield sums_batch(sums, spread, filters)


def add_sums(batches: Iterator[pa.RecordBatch], filters: int) -> Iterator[pa.RecordBatch]:
    """Rows of SUMS in order of part -> one row a part."""
    sums: dict[str, list[int]] = {}
    spread = 0
    for batch in batches:
        for part, of_task, *numbers in zip(*(batch.column(c).to_pylist() for c in ("part", "spread", "whole", "good", "toxic"))):
            if sums and part not in sums:
                yield sums_batch(sums, spread, filters)
                sums = {}
            spread, held = of_task, sums.setdefault(part, [0, 0, 0])
            for i, number in enumerate(numbers):
                held[i] += int.from_bytes(number, "little")
    if sums:
        yield sums_batch(sums, spread, filters)


def outcomes(batches: Iterator[pa.RecordBatch], names: str) -> Iterator[pa.RecordBatch]:
    """One row a part -> its rows of RESULT."""
    filters = len(names)
    order = np.array(orders(filters))
    labels = np.repeat(["".join(names[f] for f in o) for o in order], filters)
    for batch in batches:
        for part, *numbers in zip(*(batch.column(c).to_pylist() for c in ("part", "whole", "good", "toxic"))):
            (removed, total), (good, _), (toxic, _) = (unpacked(int.from_bytes(x, "little"), filters) for x in numbers)
            first, last = (dict(zip(order[:, at], removed[:, at])) for at in (0, -1))  # a filter's step does not depend on the others' order there
            fails, only = (np.array([x[f] for f in range(filters)]) for x in (first, last))
            whole = np.array([removed[order == f].sum() for f in range(filters)])
            columns = [total - removed.cumsum(axis=1), removed, fails[order] - removed, only[order], good, toxic, whole[order]]
            steps = np.tile(np.arange(1, filters + 1, dtype=np.int32), len(order))
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(labels)), pa.array(labels), pa.array(steps), *[pa.array(np.ascontiguousarray(c).ravel()) for c in columns]], names=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n: documents by what they fail; see audit."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(judge, "doc_id long, part string, digest binary, mask int")
    # Repeated rows become one with their number, before any row goes to the task of its id or text.
    rows = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    # Rows without an id match no label: they are spread by their texts. The labels' zero must not be a constant, or it is no key.
    rows = rows.withColumn("place", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long")))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    rows = rows.join(known.withColumn("place", F.pmod("doc_id", F.lit(1).cast("long"))), ["doc_id", "place"], "left").na.fill(False, ["good", "toxic"])
    # A text's first document by id, null last: all else with that text fails E. Equal rows are combined before the shuffle.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    rows = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct(order.alias("id"), "n")).alias("first"))
    least = F.min("first.id").over(Window.partitionBy("digest"))
    firsts = F.when(F.col("first.id").eqNullSafe(F.col("least")), F.col("first.n")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("least", least).withColumn("firsts", firsts)
    split = F.explode(F.array(F.struct("mask", F.col("firsts").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(16)).alias("mask"), (F.col("n") - F.col("firsts")).alias("n"))))
    return rows.select("part", split.alias("x"), "good", "toxic").select("part", "x.mask", "good", "toxic", "x.n").where("n > 0")


def count_outcomes(rows: DataFrame, names: str = FILTERS) -> DataFrame:
    """part, mask, good, toxic, n -> RESULT, for any filters up to six: bit i of mask is set where names[i] fails."""
    ship(rows.sparkSession)
    filters = len(names)
    sums = rows.select("part", "mask", "good", "toxic", "n").mapInArrow(lambda b: add_masks(b, filters), SUMS)
    for keys in (["part", "spread"], ["part"]):
        sums = sums.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda b: add_sums(b, filters), SUMS)
    return sums.mapInArrow(lambda b: outcomes(b, names), RESULT)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """RESULT: for every part (source; null is the empty string), order of the filters A-E and step, what it keeps and removes.

    A fails under WORDS words, B under DISTINCT percent of distinct words, C over CAPITALS percent of [A-Z], D on any
    of #$%&*|, E if a smaller doc_id has the same text (by its SHA-256), in whatever part. A null text is the empty
    one: it fails A, and E if another document is empty. A null doc_id is larger than every other and no smaller
    than another null; rows that repeat a doc_id count each, and none of them is smaller than the other. Labels: a document
    is good (toxic) if any label row of its id says 1; null and missing labels say nothing. Very long texts are
    judged whole. Other columns, whatever their names, are ignored. No documents give no rows."""
    return count_outcomes(masks(docs, labels))
