"""The near-copy stage of the pipeline against brute force."""

import re

import numpy as np

import corpus_pipeline
from rosterlake.llm import near_copies

SF = "/root/testdata/sf0.001"


def shingles(text):
    own = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    return frozenset(tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))) if own else frozenset()


def brute(rows, similarity=0.8):
    sets, root = [(d, shingles(t)) for d, t in rows], {d: d for d, _ in rows}
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x == y or len(x & y) >= similarity * len(x | y):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return root


def edited_rows():
    """Copies with scattered edits, from similarity 1 down to about 0.4, a common passage in all, and odd texts."""
    source = np.random.default_rng(5)
    passage = " ".join(f"common{i}" for i in range(30))
    rows = [(0, None), (1, ""), (2, "one two"), (3, "One two"), (4, " \n"), (5, passage)]
    for group in range(12):
        text = [f"g{group}w{i}" for i in range(int(source.integers(20, 200)))]
        for edits in range(8):
            copy = list(text)
            for at in source.integers(0, len(copy), edits):
                copy[at] = f"edit{source.integers(1 << 30)}"
            rows.append((len(rows) + 10, f"{' '.join(copy)} {passage}"))
    return rows


def test_near_copies(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for rows in (edited_rows(), docs):
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert {r.doc_id: r.component_id for r in near_copies.near_copies(frame).collect()} == brute(rows)
    assert near_copies.near_copies(frame.limit(0)).count() == 0


def test_unlike_texts_with_a_common_passage_do_not_meet(spark, monkeypatch):
    """The passage is 0.84 of each text's shingles, so the prefixes hold some of it, but two texts are just 0.72 alike."""
    passage = " ".join(f"common{i}" for i in range(200))
    rows = [(i, f"{passage} {' '.join(f'own{i}x{j}' for j in range(38))}") for i in range(60)] + [(60, f"{passage} {' '.join(f'own7x{j}' for j in range(30))}")]
    asked, confirm = [], near_copies.confirm

    def counting(pairs, *rest):
        asked.append(pairs.distinct().count())
        return confirm(pairs, *rest)

    monkeypatch.setattr(near_copies, "confirm", counting)
    found = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute(rows) and found[60] == 7
    assert asked[-1] <= len(rows), asked  # not a pair of texts each


def test_pipeline_drops_near_copies(spark):
    """Edited copies of similarity 0.8 or more differ in more than three bits of a fingerprint."""
    rows = edited_rows()
    kept = corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame([*rows, (None, "no id"), (None, "no id")], "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(brute(rows).values()))
    assert kept.where("doc_id is null").count() == 1  # equal texts are copies, with or without ids


def test_sketches_differ_in_no_more_bits_than_their_sets():
    source = np.random.default_rng(3)
    for size, changed in ((0, 0), (1, 1), (64, 3), (65, 20), (120, 40), (130, 30), (5000, 600)):
        one = np.unique(source.integers(0, 1 << 63, size, np.uint64) * np.uint64(2))
        two = np.unique(np.append(one[changed // 2 :], source.integers(0, 1 << 63, changed - changed // 2, np.uint64)))
        bits = near_copies.differing_bits(near_copies.parity_sketch(one), near_copies.parity_sketch(two))
        assert bits <= len(np.setxor1d(one, two))


def test_map_of_wanted_sets(spark):
    values = [0, 1, -1, -(1 << 63), (1 << 63) - 1, 123456789 << 30]
    cells = {(v & 0xFFFFFFFFFFFFFFFF) >> (64 - near_copies.WANTED_LOG2) for v in values}
    found = near_copies.map_of(spark.createDataFrame([(v,) for v in values], "set long"))
    assert set(np.flatnonzero(np.unpackbits(found, bitorder="little")).tolist()) == cells


def test_no_pair_reads_no_text(spark, monkeypatch):
    """Where no pair is possible, the texts are not read for whole sets."""
    monkeypatch.setattr(near_copies, "whole_sets", None)
    classes = spark.createDataFrame([(1, 1, bytearray(b"a")), (2, 9, bytearray(b"b"))], "set long, n int, sketch binary")
    texts = spark.createDataFrame([("x",)], "text string")
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    assert near_copies.confirm(pairs, classes, texts, 5, 0.8).collect() == []
