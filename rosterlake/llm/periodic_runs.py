"""Maximal periodic runs of words, found by longest common extensions on a harmonic grid.

A run with period q holds a pair (i, i + q) with i a multiple of q, so asking at those places how far the text agrees
with itself q words on, forwards and backwards, finds every run in about n ln n questions. A question first
compares words directly. A difference cover of MODULUS says after how many words, MODULUS - 1 at most, both places reach
sampled ones; from there the answer is the least of the sampled suffixes' common prefixes between their ranks, by a
sparse table. Only suffixes at sampled places are sorted, and only of documents in which some question gets that far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, slices

#: Every difference modulo 13 is one of two members of the cover.
COVER, MODULUS = np.array([0, 1, 3, 9]), 13
#: Least words of a run.
LEAST = 12
#: Grid places asked at once.
GRID = 1 << 20
RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"
WORD = r"[^\x20\x09-\x0D]+"


def shifts() -> np.ndarray:
    """[i mod MODULUS, j mod MODULUS] -> fewest words after which both are in the cover."""
    i, j, d = np.ogrid[:MODULUS, :MODULUS, :MODULUS]
    both = np.isin((i + d) % MODULUS, COVER) & np.isin((j + d) % MODULUS, COVER)
    return both.argmax(axis=2)


SHIFTS = shifts()


def ranks_of(*keys: np.ndarray) -> tuple[np.ndarray, bool]:
    """Ranks by keys, the first counting most, equal ones alike; and whether all differ."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for key in keys:
        ordered = key[order]
        new[1:] |= ordered[1:] != ordered[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out, len(order) == 0 or out[order[-1]] == len(order) - 1


class Extensions:
    """Longest common extensions of places in one sequence of word numbers; -1 is no word's number."""

    def __init__(self, ids: np.ndarray):
        self.n, self.ids = len(ids), np.concatenate([ids, np.full(MODULUS, -1, ids.dtype)])

    def sort_samples(self) -> None:
        """Ranks of the sampled suffixes by doubling their length, and a sparse table of neighbours' common prefixes."""
        width = len(COVER)
        samples = (np.arange(0, self.n, MODULUS)[:, None] + COVER).ravel()
        samples = samples[samples < self.n]
        padded = np.concatenate([self.ids, np.full(MODULUS, -1, self.ids.dtype)])
        ranks, unlike = ranks_of(*[padded[samples + k] for k in range(MODULUS)])
        levels, step = [ranks], 1
        while not unlike:
            later = np.full(len(ranks), -1)
            later[: max(0, len(ranks) - step * width)] = ranks[step * width :]
            ranks, unlike = ranks_of(ranks, later)
            levels.append(ranks)
            step *= 2
        self.ranks = ranks
        order = np.argsort(ranks)
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), np.int64)
        for level in reversed(range(len(levels) - 1)):
            whole = 1 << level
            inside = np.flatnonzero((a < len(samples)) & (b < len(samples)))
            same = inside[levels[level][a[inside]] == levels[level][b[inside]]]
            a[same] += whole * width
            b[same] += whole * width
            common[same] += whole * MODULUS
        asked = np.flatnonzero((a < len(samples)) & (b < len(samples)))
        for k in range(MODULUS):
            asked = asked[padded[samples[a[asked]] + k] == padded[samples[b[asked]] + k]]
            common[asked] += 1
        self.table = [common]
        while (half := 1 << len(self.table) - 1) * 2 <= len(common):
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def of_samples(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefixes of the suffixes at sampled places i < j."""
        place = np.zeros(MODULUS, np.int64)
        place[COVER] = np.arange(len(COVER))
        first, second = (self.ranks[x // MODULUS * len(COVER) + place[x % MODULUS]] for x in (i, j))
        low, high = np.minimum(first, second), np.maximum(first, second)
        level = np.frexp(high - low)[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << k)])
        return out

    def forward(self, i: np.ndarray, j: np.ndarray, far: bool) -> np.ndarray:
        """How many words from i on equal those from j on, i < j <= n. Without far, -1 where samples would be asked."""
        out = np.zeros(len(i), np.int64)
        asked = np.flatnonzero(self.ids[i] == self.ids[j])
        reach = SHIFTS[i[asked] % MODULUS, j[asked] % MODULUS]
        for k in range(MODULUS):
            synchronised = reach == k
            if synchronised.any():
                at = asked[synchronised]
                ended = j[at] + k >= self.n
                out[at[ended]], at = k, at[~ended]
                if far and len(at):
                    out[at] = k + self.of_samples(i[at] + k, j[at] + k)
                else:
                    out[at] = -1
                asked, reach = asked[~synchronised], reach[~synchronised]
            same = self.ids[i[asked] + k] == self.ids[j[asked] + k]
            out[asked[~same]] = k
            asked, reach = asked[same], reach[same]
        return out


def grid(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, place, period) of all grid places, GRID or one period's at a time."""
    half = sizes // 2
    doc = np.repeat(np.arange(len(sizes)), half)
    period = np.arange(len(doc)) - np.repeat(half.cumsum() - half, half) + 1
    counts = (sizes[doc] - 1) // period
    ends = counts.cumsum()
    at = 0
    while at < len(doc):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] - counts[at] + GRID, "right")))
        many = counts[at:end]
        of = np.repeat(np.arange(at, end), many)
        k = np.arange(len(of)) - np.repeat(many.cumsum() - many, many)
        yield doc[of], starts[doc[of]] + k * period[of], period[of]
        at = end


def runs_in(ids: np.ndarray, sizes: np.ndarray, least: int = LEAST, far: bool = False) -> np.ndarray:
    """Rows (document, start, length, smallest period), by document, start and period, of the maximal runs.

    ids: word numbers from 0 of all documents, one after another; sizes: their words."""
    sizes = np.asarray(sizes, np.int64)
    # A mark of its own after every document ends all extensions there.
    starts = sizes.cumsum() - sizes + np.arange(len(sizes))
    line = np.empty(len(ids) + len(sizes), np.int64)
    marks = starts + sizes
    words = np.ones(len(line), bool)
    words[marks] = False
    line[words], line[marks] = ids, -2 - np.arange(len(sizes))
    n, onward, back = len(line), Extensions(line), Extensions(line[::-1])
    if far and n:
        onward.sort_samples()
        back.sort_samples()
    found, distant = [], np.zeros(len(sizes), bool)
    for doc, i, q in grid(starts, sizes):
        agree = (line[i] == line[i + q]) | ((line[i - 1] == line[i + q - 1]) & (i > 0))
        doc, i, q = doc[agree], i[agree], q[agree]
        ahead, behind = onward.forward(i, i + q, far), back.forward(n - i - q, n - i, far)
        distant[doc[(ahead < 0) | (behind < 0)]] = True
        long = ahead + behind >= np.maximum(least - q, q)
        found.append(np.stack([doc[long], (i - behind)[long], (i + q + ahead)[long], q[long]], axis=1))
    rows = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    rows = rows[~distant[rows[:, 0]]]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    rows = rows[np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)]] if len(rows) else rows
    out = np.stack([rows[:, 0], rows[:, 1] - starts[rows[:, 0]], rows[:, 2] - rows[:, 1], rows[:, 3]], axis=1)
    if distant.any():
        of = np.repeat(distant, sizes)
        more = runs_in(ids[of], sizes[distant], least, True)
        more[:, 0] = np.flatnonzero(distant)[more[:, 0]]
        out = np.concatenate([out, more])
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def in_batches(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = batch.column("text").cast(pa.large_string()).fill_null("")
        lists = pc.ascii_split_whitespace(texts)
        words, parent = lists.flatten(), pc.list_parent_indices(lists)
        there = pc.greater(pc.binary_length(words), 0)
        words, parent = words.filter(there), parent.filter(there).to_numpy()
        ids = words.dictionary_encode().indices.to_numpy().astype(np.int64)
        first = np.searchsorted(parent, np.arange(batch.num_rows + 1))
        runs = runs_in(ids, np.diff(first), least)
        # Words that some run holds after its first period go.
        change = np.zeros(len(ids) + 1, np.int64)
        base = first[runs[:, 0]] + runs[:, 1]
        np.add.at(change, base + runs[:, 3], 1)
        np.add.at(change, base + runs[:, 2], -1)
        kept = np.flatnonzero(change[:-1].cumsum() == 0)
        rest = pa.ListArray.from_arrays(np.searchsorted(kept, first).astype(np.int32), words.take(pa.array(kept)).cast(pa.large_string()))
        collapsed = pc.binary_join(rest, pa.scalar(" ", pa.large_string()))
        of_doc = np.searchsorted(runs[:, 0], np.arange(batch.num_rows + 1))
        values = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], names=["start", "length", "period"])
        found = pa.ListArray.from_arrays(of_doc.astype(np.int32), values)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found, collapsed.cast(pa.string())], names=["doc_id", "runs", "collapsed"])


def find_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, runs (start, length, period, by start and period) and collapsed (the text without repetitions) of every row.

    A run is a stretch of `least` words or more, and of two periods or more, in which words a period apart are equal,
    with its smallest period, that can't be extended. collapsed has the words that no run holds after its first
    period, joined by one space. Null, empty and blank texts have no run and collapse to the empty string; very long texts
    are read whole, a text alone where it is longer than a slice. Runs may overlap, and ties don't arise: a stretch has
    one smallest period. Repeated rows and ids, or null ones, are rows of their own; other columns, whatever
    their names, are ignored; an empty table gives an empty result. No row leaves its task: nothing is shuffled."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda b: in_batches(b, least), f"doc_id long, runs {RUN}, collapsed string")


def rolled(docs: DataFrame) -> DataFrame:
    """doc_id, text: every tenth document by CRC-32 of its id repeats a part of itself from some word on to its end.

    With h the CRC-32 and g = floor(h / 10), the words from a = g mod n on are those of a stretch of
    1 + floor((n - a) / (3 + g mod 8)) words, over and over. Rows without an id or without words stay as they are."""
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")).alias("h"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    turn = F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil((n - a) / p).cast("int")))
    changed = F.array_join(F.concat(F.slice("words", 1, a), F.slice(turn, 1, n - a)), " ")
    return rows.select("doc_id", F.when(n > 0, changed).otherwise(F.col("text")).alias("text"))


def digest(rows: DataFrame) -> DataFrame:
    """find_runs' rows as counts, the longest run (ties: smallest start, then period) and digests."""
    best: Column = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    start, period = -F.col("best.start"), -F.col("best.period")
    return rows.select("doc_id", "n_runs", start.alias("start"), F.col("best.length").alias("length"), period.alias("period"), F.floor(1000 * F.col("best.length") / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
