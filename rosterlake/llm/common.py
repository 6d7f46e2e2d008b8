"""What the operators share: shipping the package, and vectorised word arithmetic.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D. In UTF-8 those bytes never occur inside another
character, so all functions here work on the raw Arrow buffers without decoding.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import SparkSession

from ..staging import new_folder, staged  # noqa: F401  the operators take them from here


SHIPPED: set[str] = set()
#: Bytes of text handled at once inside a task; one longer document is handled alone.
SLICE_BYTES = 1 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.realpath(os.path.join(folder, f"{root.name}.zip"))
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(archive)
    SHIPPED.add(context.applicationId)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and n+1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about SLICE_BYTES of text, or one longer document."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
    pa.default_memory_pool().release_unused()


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the n+1 first-word numbers of the documents."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] |= word[cuts]
    last[cuts - 1] |= word[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


#: Odd multiplier of the polynomial hash of word sequences, modulo 2**64.
WORD_BASE = 0xD6E8FEB86659FD93
#: Words of more bytes are hashed one by one.
LONG_WORD = 48
POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0 .. base**n and their inverses modulo 2**64."""
    if base not in POWERS or len(POWERS[base][0]) <= n:
        size = max(n, SLICE_BYTES) + 1

        def table(b: int) -> np.ndarray:
            out = np.full(size, b, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        POWERS[base] = table(base), table(pow(base, -1, 1 << 64))
    return POWERS[base]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values))[0][: len(values)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of each span of a sequence from its prefix sums; equal spans have equal hashes wherever they stand.

    For spans of tens of words, whose own hashes are mixed well; of more than about a thousand, some that alternate
    between two words by a fixed rule would cancel out."""
    return mixed((sums[ends] - sums[starts]) * powers(base, len(sums))[1][starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes: eight bytes at a time are mixed into it, all words at once; XXH64 for long words.

    Every step is a bijection of the hash so far, so no arrangement of bytes cancels out as it can in a polynomial."""
    size = ends - starts
    out = mixed(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    left = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    at, rest = starts[left], size[left]
    while len(left):
        lane = lanes[at]
        short = rest < 8
        lane[short] &= (np.uint64(1) << (rest[short] * 8).astype(np.uint64)) - np.uint64(1)
        out[left] = mixed(out[left] ^ lane) * np.uint64(0x9FB21C651E98DF25)
        more = rest > 8
        left, at, rest = left[more], at[more] + 8, rest[more] - 8
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), 42)
    return mixed(out)


def first_of(keys: np.ndarray) -> np.ndarray:
    """True where a key stands for the first time."""
    out = np.zeros(len(keys), bool)
    out[np.unique(keys, return_index=True)[1]] = True
    return out
