"""K-d sharding, the filter audit and periodic runs against brute force."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlake.llm import filter_audit, kd_shards, periodic_runs, queries

SF = "/root/testdata/sf0.001"
CLASH = "doc_id long, text string, source string, lang string, node int, part string, runs int, size string, n int"


def frame(spark, rows):
    """(doc_id, text, source, lang) with clashing extra columns."""
    return spark.createDataFrame([(*r, 1, "x", 2, "y", 3) for r in rows], CLASH).repartition(3)


# --- sharding ---------------------------------------------------------------------------------------------------------


def tree(rows, shards, first=0):
    """The same tree by sorting: rows of (keys by dimension, coordinates, second, size, row)."""
    if shards == 1 or not rows:
        return {r[-1]: first for r in rows}
    weight = sum(r[3] for r in rows)
    names = sorted(kd_shards.dimensions())
    widths = []
    for d in names:
        mean = sum(r[3] * r[1][d] for r in rows) / weight
        widths.append(round(sum(r[3] * r[1][d] ** 2 for r in rows) / weight - mean**2, 9))
    dim = names[widths.index(max(widths))]
    sizes = Counter()
    for r in rows:
        sizes[r[0][dim], r[2]] += r[3]
    want, below, best = weight * (shards // 2) / shards, 0, None
    keys = sorted(sizes)
    for i, k in enumerate(keys):
        if i and (best is None or abs(want - below) < best[0]):
            best = abs(want - below), k
        below += sizes[k]
    cut = best[1] if best else (float("inf"),)
    left = [r for r in rows if (r[0][dim], r[2]) < cut]
    right = [r for r in rows if (r[0][dim], r[2]) >= cut]
    return tree(left, shards // 2, first) | tree(right, shards - shards // 2, first + shards // 2)


@pytest.mark.parametrize("shards", [8, 5])
def test_tree_equals_sorting(spark, shards):
    rng = random.Random(shards)
    rows = [(i, "w" * rng.randrange(300, 900), f"s{rng.choice([0, 0, 0, 1, 2, 3])}", rng.choice(["en", "de", None])) for i in range(150)]
    rows += [(1000 + i, rows[i % 7][1], "copy", "en") for i in range(30)] + [(None, "heavy " * 300, "s0", "en")] * 9
    placed = kd_shards.placed(kd_shards.numbered(frame(spark, rows)), shards)
    names = sorted(kd_shards.dimensions())
    points = [({d: r[f"key_{d}"] for d in names}, {d: (r[f"key_{d}"] >> 40) / 2**20 for d in names}, r.second, r["size"], r.row) for r in placed.collect()]
    got = {r.row: r.shard for r in kd_shards.leaves_of(placed, shards).collect()}
    assert got == tree(points, shards)
    assert len({p[2] for p in points}) > 5  # the heavy group's rows have places of their own


def test_law_of_bytes(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    out = queries.op11_kd_sharding(spark, SF).collect()
    text = {r.doc_id: (r.text or "").encode() for r in rows}
    assert sorted(r.doc_id for r in out) == sorted(text)
    bytes_of, slots, groups = Counter(), defaultdict(list), defaultdict(set)
    for r in out:
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id]), "bytes", None)
        bytes_of[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        groups[text[r.doc_id]].add(r.shard)
    assert sorted(bytes_of) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, largest = sum(bytes_of.values()) / 8, max(map(len, text.values()))
    assert max(bytes_of.values()) - min(bytes_of.values()) <= max(0.1 * mean, 2 * largest)
    light = [t for t, n in Counter(text.values()).items() if n * (len(t) + 1) <= mean / 40]
    assert light and all(len(groups[t]) == 1 for t in light)


def test_shards_of_odd_rows(spark):
    """Nulls in every column, repeated rows, one hot text, a very long one, fewer rows than shards, and no rows."""
    hot = [(None, "hot copy", None, None)] * 400
    rows = [*hot, (1, None, None, "en"), (1, None, None, "en"), (2, "", "a", None), (3, "ü" * 5, "a", "x"), (4, "x" * 300, "a", "x"), (None, None, None, None)]
    out = kd_shards.shard(frame(spark, rows)).collect()
    assert len(out) == len(rows) and sorted(r["size"] for r in out) == sorted(len((t or "").encode()) + 1 for _, t, _, _ in rows)
    sizes, slots = Counter(), defaultdict(list)
    for r in out:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 0.2 * sum(sizes.values()) / 8 + 301
    long = kd_shards.shard(frame(spark, [(i, "y" * (200_000 if i == 3 else 10), "a", "b") for i in range(5)])).collect()
    assert sorted(r.doc_id for r in long) == list(range(5)) and len({r.shard for r in long if r.doc_id == 3}) == 1
    assert kd_shards.shard(frame(spark, [(i, "z", "a", "b") for i in range(3)])).count() == 3
    assert kd_shards.shard(frame(spark, rows).where("false")).collect() == []
    assert kd_shards.shards_for(frame(spark, rows), 1000) == round(sum(len((t or "").encode()) + 1 for _, t, _, _ in rows) / 1000)


# --- filter audit -----------------------------------------------------------------------------------------------------


def audit_by_hand(rows, labels):
    split = lambda t: [w for w in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in t or "").split(" ") if w]
    masks = []
    for doc_id, text, source, _ in rows:
        text, w = text or "", split(text)
        caps = sum("A" <= c <= "Z" for c in text)
        twin = any((t or "") == text and i is not None and (doc_id is None or i < doc_id) for i, t, _, _ in rows)
        fails = {f for f, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * caps > 2 * len(text), any(c in "#$%&*|" for c in text), twin)) if x}
        own = [(q, t) for i, q, t in labels if i == doc_id and i is not None]
        masks.append((source or "", fails, any(q == 1 for q, _ in own), any(t == 1 for _, t in own)))
    out = {}
    for part in {m[0] for m in masks}:
        here = [m[1:] for m in masks if m[0] == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = list(here)
            for step, f in enumerate(order):
                gone = [m for m in left if f in m[0]]
                redundant = sum(f in m[0] for m in here) - len(gone)
                left = [m for m in left if f not in m[0]]
                shapley[f] += len(gone)
                out[part, "".join(order), step + 1] = [len(left), len(gone), redundant, sum(m[0] == {f} for m in here), sum(m[1] for m in gone), sum(m[2] for m in gone)]
        for (p, order, step), x in out.items():
            if p == part:
                x.append(shapley[order[step - 1]])
    return out


def test_audit_equals_counting(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        text = " ".join(rng.sample(words, 250) if rng.random() < 0.5 else rng.choices(words[:60], k=230))
        rows.append((rng.choice([i, i, None]), rng.choice([text, text.upper(), text + "\t|", text[:300], rows[-1][1] if rows else text]), rng.choice(["a", "b", None, ""]), "en"))
    rows += [(7, None, "a", None), (7, None, "a", None), (8, "", None, None), (9, " \n\x0b ", "b", None), (100, " ".join(words * 300), "b", "x"), rows[0], rows[0]]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 60, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    tags = spark.createDataFrame([(*x, "y", 2) for x in labels], "doc_id long, quality int, toxic int, part string, n int")
    got = {(r.part, r.filter_order, r.step): list(r[3:]) for r in filter_audit.audit(frame(spark, rows), tags).collect()}
    assert got == audit_by_hand(rows, labels)
    assert filter_audit.audit(frame(spark, rows).where("false"), tags).collect() == []
    unlabelled = filter_audit.audit(frame(spark, rows), tags.where("false"))
    assert {(r.good_lost, r.toxic_lost) for r in unlabelled.select("good_lost", "toxic_lost").distinct().collect()} == {(0, 0)}


def test_counters_do_not_run_over(spark):
    """Counts near 2**61 in every field, many parts and tasks; and two filters only."""
    big = 1 << 60
    rows = spark.range(0, 2_400, 1, 6).select(F.concat(F.lit("p"), F.col("id") % 1200).alias("part"), F.lit(0b11101).alias("mask"), F.lit(True).alias("good"), F.lit(False).alias("toxic"), F.lit(1).cast("long").alias("n"))
    huge = spark.createDataFrame([("p7", m, True, True, big // 32) for m in range(32)], "part string, mask int, good boolean, toxic boolean, n long")
    out = filter_audit.count_outcomes(rows.unionByName(huge))
    assert out.count() == 1200 * 600
    last = out.where("part = 'p7' and step = 5 and filter_order = 'ABCDE'").first()
    assert last.kept == big // 32 and last.redundant == 15 * (big // 32) + 2
    first = {r.filter_order: r.removed for r in out.where("part = 'p7' and step = 1").collect()}
    assert first["BACDE"] == big // 2 and first["ABCDE"] == big // 2 + 2
    two = filter_audit.count_outcomes(spark.createDataFrame([("p", m, False, False, 1) for m in range(4)], "part string, mask int, good boolean, toxic boolean, n long"), "XY")
    assert [tuple(r[1:7]) for r in two.orderBy("filter_order", "step").collect()] == [("XY", 1, 2, 2, 0, 1), ("XY", 2, 1, 1, 1, 1), ("YX", 1, 2, 2, 0, 1), ("YX", 2, 1, 1, 1, 1)]


# --- periodic runs ----------------------------------------------------------------------------------------------------


def runs_by_hand(words, least=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        at = 0
        while at + q < n:
            if words[at] != words[at + q]:
                at += 1
                continue
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end + q - at >= max(least, 2 * q):
                found.setdefault((at, end + q), q)
            at = end + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def sequences():
    rng = random.Random(3)
    out = [[], [0], [1] * 11, [1] * 12, [1] * 300, [1, 2] * 5, [1, 2] * 6, [1, 2] * 90 + [3] + [1, 2] * 40, [*range(40)] * 2, [*range(40), *range(39)], [*range(13)] * 7 + [*range(5)]]
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    out.append(fib[-1])
    out.append([bin(i).count("1") % 2 for i in range(700)])
    for alphabet in (1, 2, 3, 9):
        for _ in range(25):
            words = [rng.randrange(alphabet) for _ in range(rng.randrange(0, 120))]
            block = [rng.randrange(alphabet) for _ in range(rng.randrange(1, 40))]
            out.append(words + block * rng.randrange(0, 6) + words[:17] + block[: rng.randrange(0, 40)])
    return out


def test_runs_equal_brute_force():
    """Each sequence alone, and all of them together in one slice."""
    every = sequences()
    want = [runs_by_hand(s) for s in every]
    for s, w in zip(every, want):
        assert [tuple(r[1:]) for r in periodic_runs.runs_in(np.array(s, np.int64), [len(s)]).tolist()] == w
    together = periodic_runs.runs_in(np.array([w for s in every for w in s]), np.array([len(s) for s in every]))
    assert [tuple(r) for r in together.tolist()] == [(i, *r) for i, w in enumerate(want) for r in w]
    assert sum(map(len, want)) > 200


def test_extensions_and_their_cover(monkeypatch):
    assert (periodic_runs.SHIFTS < periodic_runs.MODULUS).all()
    rng = np.random.default_rng(1)
    for size, alphabet in ((400, 2), (500, 1), (37, 3), (1300, 2)):
        ids = rng.integers(0, alphabet, size)
        ids[size // 2 :] = ids[: size - size // 2]
        ext = periodic_runs.Extensions(ids)
        ext.sort_samples()
        i = rng.integers(0, size, 3000)
        j = rng.integers(0, size + 1, 3000)
        i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]

        def plain(a, b):
            k = 0
            while b + k < size and ids[a + k] == ids[b + k]:
                k += 1
            return k

        assert ext.forward(i, j, True).tolist() == [plain(a, b) for a, b in zip(i, j)]
    # Grid places in many pieces give the same.
    monkeypatch.setattr(periodic_runs, "GRID", 50)
    words = np.array([1, 2, 3] * 30 + [4] * 40)
    assert [tuple(r[1:]) for r in periodic_runs.runs_in(words, [len(words)]).tolist()] == runs_by_hand(words.tolist())


def split_words(text):
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in text or "").split(" ") if w]


def rolled_by_hand(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n or doc_id is None:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = rolled_by_hand(doc_id, split_words(text))
    runs = runs_by_hand(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    head = [best[0], best[1], best[2], 1000 * best[1] // best[2]] if best else [None] * 4
    return [doc_id, len(runs), *head, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))]


def test_runs_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    short = {r.doc_id: r.text for r in docs.collect() if len(split_words(r.text)) < 600}
    got = {r.doc_id: list(r) for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert len(got) == docs.count()
    assert all(got[d] == expected(d, t) for d, t in short.items())
    assert sum(got[d][1] > 0 for d in short) > 10


def test_runs_of_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "a " * 12), (4, "a " * 12), (None, "é ü x " * 9), (6, "\x0ba\x0cb\rc\n" * 7), (7, " ".join(map(str, range(50)))),
        (8, " ".join(f"v{i % 7919}" for i in range(30_000)) + " tail"), (19, "x y z " * 30),
    ]
    out = periodic_runs.digest(periodic_runs.find_runs(periodic_runs.rolled(frame(spark, [(d, t, "s", "l") for d, t in rows])))).collect()
    got = sorted(map(list, out), key=str)
    want = sorted((expected(d, t) for d, t in rows if d != 8), key=str)
    assert [r for r in got if r[0] != 8] == want
    long = next(r for r in got if r[0] == 8)
    assert long[1:5] == [1, 0, 30_000, 7919] or zlib.crc32(b"8") % 10 == 0
    assert periodic_runs.find_runs(frame(spark, []), 12).collect() == []
    plain = periodic_runs.find_runs(frame(spark, [(1, "a b " * 8 + "c", "s", "l")])).first()
    assert plain.collapsed == "a b c" and [tuple(r) for r in plain.runs] == [(0, 16, 2)]
