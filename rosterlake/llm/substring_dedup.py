"""Substring deduplication by seed and extend.

Seeds: of the k-word grams inside every window of `length` words, the one with the smallest hash is the window's
anchor (winnowing), so equal windows have equal anchors at the same offset. Neighbouring windows that share an
anchor form one run; an anchor row extends over all words of its run, left and right.

Joining the anchors on their hash shows which stand in more than one place:

* runs of one anchor that are all equal are decided at once: those outside the smallest doc_id are repeats;
* where the extensions differ, the runs are extended window by window: (anchor, window) pairs are joined, and the
  ones outside the first document that holds them are repeats.

Overlapping repeats of a document merge into maximal ones. All groups are aggregated before and joined after the
shuffle, so a passage in any number of documents costs rows in proportion to its occurrences, never pairs. Groups are
written before they are joined, so that Spark can split the rows of a frequent anchor or window among tasks.

Windows are equal by 128 bits of hash: 64 of the anchor's words, 64 of the whole window or run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BASE, first_of, mixed, prefix_sums, ship, slices, span_hashes, staged, text_buffers, word_bounds, word_hashes

ANCHOR_SCHEMA = "anchor long, extent long, doc_id long, run_start int, run_end int, again boolean"
WINDOW_SCHEMA = "anchor long, window long, doc_id long, start int, again boolean"


def anchor_runs(words: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray] | None:
    """Runs of windows with one anchor: anchor hash, hash of the run's words, document number, first and last window."""
    sums = prefix_sums(words, WORD_BASE)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    ends = bounds[1:][doc] if len(doc) else doc
    at = np.arange(len(words))
    windows = at[at + length <= ends]
    if not len(windows):
        return None
    last_gram = len(words) - gram + 1
    grams = span_hashes(sums, at[:last_gram], at[:last_gram] + gram, WORD_BASE)
    width = length - gram + 1
    views = np.lib.stride_tricks.sliding_window_view(grams, width)
    anchors = np.concatenate([w + views[w].argmin(axis=1) for w in np.array_split(windows, max(1, len(windows) // 65536))])
    new = np.ones(len(windows), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (np.diff(windows) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(windows)) - 1
    lo, hi, a = windows[first], windows[last], anchors[first]
    shape = ((a - lo) * 4096 + (hi - lo)).astype(np.uint64)
    extent = mixed(span_hashes(sums, lo, hi + length, WORD_BASE) + mixed(shape))
    return {"sums": sums, "anchor": grams[a], "extent": extent, "doc": doc[a], "lo": lo, "hi": hi}


def seeds(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = text_buffers(batch.column("text"))
            starts, ends, bounds = word_bounds(data, offsets)
            runs = anchor_runs(word_hashes(data, starts, ends), bounds, length, gram)
            if runs is None:
                continue
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            doc = runs["doc"]
            again = ~first_of(mixed(runs["anchor"] + mixed(runs["extent"] + mixed(doc.astype(np.uint64)))))
            yield pa.RecordBatch.from_arrays(
                [runs["anchor"].view(np.int64), runs["extent"].view(np.int64), ids[doc], (runs["lo"] - bounds[doc]).astype(np.int32), (runs["hi"] - bounds[doc]).astype(np.int32), again],
                ["anchor", "extent", "doc_id", "run_start", "run_end", "again"],
            )

    return run


def windows_of_runs(length: int):
    """Texts with their undecided runs -> one row per window of those runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = text_buffers(batch.column("text"))
            starts, ends, bounds = word_bounds(data, offsets)
            sums = prefix_sums(word_hashes(data, starts, ends), WORD_BASE)
            runs = batch.column("runs")
            count = np.diff(runs.offsets.to_numpy())
            flat = runs.flatten()
            anchor, lo, hi = (flat.field(i).to_numpy() for i in range(3))
            doc = np.repeat(np.arange(batch.num_rows), count)
            size = hi - lo + 1
            which = np.repeat(np.arange(len(lo)), size)
            start = lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            order = np.lexsort((start, doc[which]))
            which, start = which[order], start[order]
            at = start + bounds[doc[which]]
            window = span_hashes(sums, at, at + length, WORD_BASE)
            own = anchor[which]
            again = ~first_of(mixed(own.view(np.uint64) + mixed(window + mixed(doc[which].astype(np.uint64)))))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([own, window.view(np.int64), ids[doc[which]], start.astype(np.int32), again], ["anchor", "window", "doc_id", "start", "again"])

    return run


def repeated_spans(docs: DataFrame, length: int = 20, gram: int = 6) -> DataFrame:
    """(doc_id, start, end) in words, end exclusive: spans all of whose windows also start earlier; they may overlap."""
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    anchors = texts.mapInArrow(seeds(length, gram), ANCHOR_SCHEMA)
    groups = staged(
        anchors.where("not again")
        .groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"), F.min("extent").alias("least"), F.max("extent").alias("most"))
        .where("n > 1")
        .select("anchor", "first_doc", (F.col("least") == F.col("most")).alias("alike")),
        "groups",
    )
    found = staged(
        anchors.join(groups.hint("merge"), "anchor", "left")  # a merge join is one that Spark splits
        .where("again or doc_id > first_doc or not alike")
        .select("anchor", "doc_id", "run_start", "run_end", (F.col("again") | (F.col("alike") & (F.col("doc_id") > F.col("first_doc")))).alias("decided"), F.coalesce(~F.col("alike") & ~F.col("again"), F.lit(False)).alias("open")),
        "runs",
    )
    undecided = found.where("open").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "run_start", "run_end")).alias("runs"))
    windows = staged(texts.join(undecided, "doc_id").mapInArrow(windows_of_runs(length), WINDOW_SCHEMA), "windows")
    firsts = staged(windows.where("not again").groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1").drop("n"), "firsts")
    later = windows.join(firsts.hint("merge"), ["anchor", "window"], "left").where("again or doc_id > first_doc").select("doc_id", "start", (F.col("start") + length).alias("end"))
    return found.where("decided").select("doc_id", F.col("run_start").alias("start"), (F.col("run_end") + length).alias("end")).unionByName(later)


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their repeated spans -> what is left of them."""
    for batch in slices(batches):
        data, offsets = text_buffers(batch.column("text"))
        starts, ends, bounds = word_bounds(data, offsets)
        spans = batch.column("spans")
        left, removed = [], []
        raw = data.tobytes()
        for i, own in enumerate(spans):
            a, b = bounds[i], bounds[i + 1]
            edge = np.zeros(b - a + 1, np.int32)
            own = own.values
            if own is not None and len(own):
                np.add.at(edge, own.field(0).to_numpy(), 1)
                np.add.at(edge, own.field(1).to_numpy(), -1)
            keep = np.flatnonzero(np.cumsum(edge)[:-1] == 0) + a
            removed.append(int(b - a - len(keep)))
            left.append(b" ".join([raw[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist())]).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), np.diff(bounds), pa.array(removed, pa.int64()), pa.array(left, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_text"],
        )


def dedup_substrings(docs: DataFrame, length: int = 20, gram: int = 6) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: every text without the words of windows that also start earlier.

    A window is `length` consecutive words of one document; earlier means in a smaller doc_id, or before in the same
    document; windows are judged on the input. Kept words are joined by one space.

    Null text: no words, kept_text ''. Empty text, or one shorter than `length`: kept whole. Null doc_id: kept whole
    and no source of repeats. Rows that share a doc_id are one document: their windows don't count as each other's
    repeats. Whole copies: the smallest doc_id keeps its text, the others lose all. Very long texts are handled
    alone, whole. Other columns, whatever their names, are ignored. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    spans = repeated_spans(docs, length, gram).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(spans, "doc_id", "left").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: Imported by tests and notebooks that want the reference meaning on a few rows.
def brute_force(rows: list[tuple[int, str | None]], length: int = 20) -> dict[int, tuple[int, int, str]]:
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        words = [w for w in (text or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if w]
        gone = set()
        for i in range(len(words) - length + 1):
            window = tuple(words[i : i + length])
            if window in seen:
                gone.update(range(i, i + length))
            seen.add(window)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[doc_id] = len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()
    return out
