"""Near-duplicates by 64-bit SimHash and bit-sliced comparison.

Equal fingerprints collapse first. Distinct ones within three bits agree on at least three of six bit blocks, so
each is keyed by all twenty choices of three blocks (about 32 bits a key) and compared inside its buckets only.
A bucket compares bit planes: one machine word holds the same bit of 64 differences, carry-save counters add up the
planes, and a block is abandoned once every count in it exceeds the radius. Buckets of more than CHUNK
fingerprints are dealt out as chunk pairs, so any size is exact. Links are reduced to a spanning forest per bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices, staged, text_buffers, word_bounds
from .components import components

#: Bit blocks of a fingerprint, as (first bit, bits); two fingerprints within RADIUS bits agree on all but RADIUS of them.
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
#: RADIUS follows from the two counter words of within(). Buckets up to SMALL are compared pair by pair, all at once.
RADIUS, CHUNK, SMALL = 3, 2048, 48


def masks() -> list[int]:
    return [sum(((1 << n) - 1) << at for at, n in three) for three in combinations(BLOCKS, len(BLOCKS) - RADIUS)]


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every lower-cased shingle, and the n+1 first-shingle numbers of the documents."""
    starts, ends, bounds = word_bounds(data, offsets)
    count = np.diff(bounds)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    keep = word.copy()
    keep[1:] |= word[:-1]
    lower = np.where((data >= 65) & (data <= 90), data + 32, data)
    lower[~word] = 32
    buffer = lower[keep].tobytes()
    place = np.append(np.cumsum(keep) - keep, keep.sum())
    starts, ends = place[starts], place[ends - 1] + 1 if len(ends) else ends
    size = np.minimum(count, shingle)
    shingles = count - size + (count > 0)
    doc = np.repeat(np.arange(len(count)), shingles)
    first = np.cumsum(shingles) - shingles
    at = np.arange(len(doc)) - first[doc] + bounds[:-1][doc]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(buffer[s:e], seed) for s, e in zip(starts[at].tolist(), ends[at + size[doc] - 1].tolist())), np.uint64, len(at))
    return hashes, np.append(first, len(doc))


def fingerprints(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bit i is 1 if it is set in over half of a document's hashes."""
    out = np.zeros((len(bounds) - 1, 64), np.uint8)
    for i in np.flatnonzero(np.diff(bounds)):
        total = np.zeros(64, np.int64)
        for at in range(bounds[i], bounds[i + 1], 1 << 16):
            part = hashes[at : min(at + (1 << 16), bounds[i + 1])]
            total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        out[i] = total * 2 > bounds[i + 1] - bounds[i]
    return np.packbits(out, axis=1, bitorder="little").view("<u8").ravel()


def sign(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = fingerprints(*shingle_hashes(*text_buffers(batch.column("text")), shingle, seed))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), values.view(np.int64)], ["doc_id", "fp"])

    return run


def planes_of(values: np.ndarray) -> np.ndarray:
    """64 bit planes of n values: row b holds bit b of all of them, 64 to a word."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within(differences: Iterator[np.ndarray]) -> np.ndarray | None:
    """Lanes whose difference planes hold at most three ones; None if the block was abandoned."""
    ones = twos = over = None
    for n, plane in enumerate(differences):
        if ones is None:
            ones, twos, over = plane.copy(), np.zeros_like(plane), np.zeros_like(plane)
            continue
        carry = ones & plane
        ones ^= plane
        over |= twos & carry
        twos ^= carry
        if n % 8 == 7 and (over == np.uint64(0xFFFFFFFFFFFFFFFF)).all():
            return None
    return ~over


def lanes(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8).reshape(*words.shape[:-1], -1), axis=-1, bitorder="little")[..., :n].astype(bool)


def linked_pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """True where left[i] and right[i] are within the radius."""
    good = within(iter(planes_of(left ^ right)))
    return np.zeros(len(left), bool) if good is None else lanes(good, len(left))


def forest(rows: np.ndarray, others: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that span the links among rows, or between rows and others."""
    values = rows if others is None else np.concatenate([rows, others])
    right = rows if others is None else others
    shift = 0 if others is None else len(rows)
    planes, root = planes_of(right), np.arange(len(values))
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for at in range(0, len(rows), 64):
        block = rows[at : at + 64]
        flip = [np.where((block >> np.uint64(b)) & np.uint64(1), full, np.uint64(0))[:, None] for b in range(64)]
        good = within(planes[b][None, :] ^ flip[b] for b in range(64))
        if good is None:
            continue
        for i, hits in enumerate(lanes(good, len(right)), at):
            near = np.flatnonzero(hits) + shift
            if len(near) > (others is None):
                trees = np.unique(root[np.append(near, i)])
                if len(trees) > 1:
                    root[np.isin(root, trees)] = trees[0]
    moved = np.flatnonzero(root != np.arange(len(values)))
    return [(values[moved], values[root[moved]])]


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket (table, key, i, j) -> links. The last bucket of a batch waits for the next batch."""
    names, held = ["tab", "key", "i", "j", "chunk", "fp"], None

    def links(cols: list[np.ndarray]) -> pa.RecordBatch:
        new = np.ones(len(cols[0]), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(new)))
        fp, found = cols[5].view(np.uint64), []
        group = np.repeat(np.arange(len(at)), size)
        small = np.flatnonzero((size[group] <= SMALL) & (cols[2] == cols[3]))
        values, own = fp[small], group[small]
        for d in range(1, int(size[own].max(initial=1))):
            same = np.flatnonzero(own[d:] == own[:-d])
            if not len(same):
                break
            near = same[linked_pairs(values[same], values[same + d])]
            found.append((values[near], values[near + d]))
        for g in np.flatnonzero((size > SMALL) | (cols[2][at] != cols[3][at])):
            part = slice(at[g], at[g] + size[g])
            if cols[2][at[g]] == cols[3][at[g]]:
                found += forest(fp[part], None)
            else:
                chunk = cols[4][part]
                found += forest(fp[part][chunk == cols[2][at[g]]], fp[part][chunk == cols[3][at[g]]])
        a, b = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.uint64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([a.view(np.int64), b.view(np.int64)], ["a", "b"])

    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        if not len(cols[0]):
            continue
        tail = np.flatnonzero(np.any([c[:-1] != c[-1] for c in cols[:4]], axis=0)) if len(cols[0]) > 1 else []
        cutoff = tail[-1] + 1 if len(tail) else 0
        held = [c[cutoff:] for c in cols]
        if cutoff:
            yield links([c[:cutoff] for c in cols])
    if held is not None and len(held[0]):
        yield links(held)


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp long) -> (a, b): edges whose components are those of all links."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks()]
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("tab", "key"))
    sizes = keyed.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    dealt = (
        keyed.join(sizes, ["tab", "key"])
        .select("tab", "key", "fp", F.pmod(F.xxhash64("fp"), chunks).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
        .select("tab", "key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "fp")
    )
    return dealt.repartition("tab", "key", "i", "j").sortWithinPartitions("tab", "key", "i", "j").mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint, component_id: documents linked through fingerprints at most three bits apart.

    A-Z count as a-z; shingles are `shingle` consecutive words, repeats included, joined by a space; fewer words make
    one shingle. Empty, blank or null texts have fingerprint zero and are linked like any other. component_id is the
    smallest doc_id reachable, itself included (null ids come last: null only if no member has an id). Repeated rows
    stay rows. Very long texts are handled alone, whole. Other columns, whatever their names, are ignored. An empty
    table gives an empty result.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    signed = staged(texts.mapInArrow(sign(shingle, seed), "doc_id long, fp long"), "fingerprints")
    classes = staged(signed.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "classes")
    roots = components(fingerprint_links(classes.select("fp")))
    members = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    least = members.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = members.join(least, "root").select("fp", "component_id")
    return signed.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
