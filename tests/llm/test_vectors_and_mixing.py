"""Nearest neighbours, mixing, URL rules, toxicity, licences and decontamination on small fixtures."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rosterlake.llm import ann, decontamination, licences, mixing, queries, toxicity, url_filters

SF = "/root/testdata/sf0.001"


def test_ann_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    vectors = np.array([r.embedding for r in rows], float)
    ids = np.array([r.vec_id for r in rows])
    got = queries.op10_ann(spark, "/root/testdata/sf0.01").collect()
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        score = (vectors * vectors[ids == q][0]).sum(axis=1)
        others = ids != q
        best = ids[others][np.lexsort((ids[others], -score[others]))][:20]
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [x[0] for x in own] == list(range(1, 21))
        assert all(x[2] == pytest.approx(score[ids == x[1]][0], abs=1e-12) for x in own)
        assert [x[1] for x in own] == [v for _, v in sorted((-x[2], x[1]) for x in own)]
        hits += len({x[1] for x in own} & set(best))
        total += 20
    assert hits / total >= 0.9


def test_ann_blocks_and_stripes(spark, tmp_path):
    """100,000 vectors in two parts of several blocks: recall against brute force, whatever the number of stripes."""
    vectors = np.random.default_rng(3).normal(size=(100_000, 48))
    column = pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), 48).cast(pa.list_(pa.float64()))
    pq.write_table(pa.table({"vec_id": np.arange(len(vectors)), "embedding": column}), tmp_path / "v.parquet")
    frame = spark.read.parquet(str(tmp_path / "v.parquet"))
    found = {}
    for r in ann.nearest(frame, frame.where("vec_id % 1000 = 0")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    asked = range(0, 100_000, 1000)
    score = vectors[list(asked)] @ vectors.T
    score[np.arange(len(asked)), list(asked)] = -np.inf
    truth = {q: set(np.argsort(-s)[:20]) for q, s in zip(asked, score)}
    assert set(found) == set(truth) and all(len(x) == 20 for x in found.values())
    assert sum(len(found[q] & truth[q]) for q in truth) / (20 * len(truth)) >= 0.95


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distributions():
    rng = np.random.default_rng(7)
    gauss = rng.normal(size=(8192, 64))
    outlier = unit(gauss)
    outlier[5] *= 20
    yield "unit", unit(gauss)
    yield "gaussian", gauss
    for spread in (0.2, 0.3, 0.5, 1.0):
        yield f"lognormal({spread})", unit(gauss) * np.exp(spread * rng.normal(size=(8192, 1)))
    yield "outlier", outlier
    yield "clusters", unit(rng.normal(size=(50, 64)))[rng.integers(0, 50, 8192)] + 0.1 * rng.normal(size=(8192, 64))
    yield "rank 6", rng.normal(size=(8192, 6)) @ rng.normal(size=(6, 64))
    yield "8 dimensions", rng.normal(size=(8192, 8))
    yield "copies", np.repeat(unit(rng.normal(size=(16, 64))), 512, axis=0)
    yield "negative", -np.abs(gauss) * np.where(rng.random((8192, 1)) < 0.1, -1, 1)
    yield "all lengths", gauss * 10.0 ** rng.integers(-140, 140, (8192, 1))


@pytest.mark.parametrize("name, vectors", list(distributions()), ids=lambda x: x if isinstance(x, str) else "")
def test_ann_recall_by_distribution(name, vectors):
    """Recall against the exact order, for norms that are equal, spread or extreme; and most vectors are not verified."""
    exponent = int(np.frexp(np.abs(vectors).max())[1])
    part, scaled, hits, asked = ann.Part(vectors, np.arange(len(vectors)), exponent, 42), np.ldexp(vectors, -exponent), 0, range(0, len(vectors), 211)
    found = part.nearest(np.array(asked), vectors[list(asked)], 20)
    for q, (rows, scores) in zip(asked, found):
        exact = scaled @ (scaled[q] / ann.norms_of(scaled[q][None])[0])
        exact[q] = -np.inf
        least = np.sort(exact)[-20]
        assert len(set(rows)) == 20 and q not in rows and (np.diff(scores) <= 0).all()
        hits += (exact[rows] >= least - 1e-12 * abs(least)).sum()
    assert hits / (20 * len(asked)) >= 0.95
    assert part.verified <= 0.4 * len(asked) * len(vectors)


def test_ann_lengths_end_to_end(spark):
    """Norms that differ, in several parts and stripes; and components whose squares overflow, which end all the same."""
    rng = np.random.default_rng(5)
    vectors = unit(rng.normal(size=(4000, 32))) * np.exp(0.5 * rng.normal(size=(4000, 1)))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest(frame, frame.where("vec_id % 20 = 0")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    score = vectors @ vectors.T
    np.fill_diagonal(score, -np.inf)
    assert sum(len(found[q] & set(np.argsort(-score[q])[:20])) for q in range(0, 4000, 20)) / (20 * 200) >= 0.95
    huge = spark.createDataFrame([(i, (vectors[i] * 1e200).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    got = ann.nearest(huge, huge.where("vec_id = 20")).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 21)) and all(r.score == math.inf for r in got)
    half = spark.createDataFrame([(i, (vectors[i] * 1e150).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    got = ann.nearest(half, half.where("vec_id = 20")).orderBy("rank").collect()
    exact = (vectors[:300] * 1e150) @ (vectors[20] * 1e150)
    exact[20] = -np.inf
    assert [r.vec_id for r in got] == np.argsort(-exact)[:20].tolist()


def test_ann_edges(spark):
    nan = float("nan")
    rows = [(i, [1.0, 0.0], 1) for i in range(40, 10, -1)] + [(1, None, 1), (2, [0.0, 0.0], 1), (3, [nan, 1.0], 1), (4, [1.0, None], 1), (5, [float("inf"), 0.0], 1), (6, [], 1), (7, [1.0, 2.0, 3.0], 1), (None, [1.0, 0.0], 1), (20, [1.0, 0.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = ann.nearest(frame, frame.where("vec_id in (20, 2, 7)"), k=5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(20, i + 1, v, 1.0) for i, v in enumerate([11, 12, 13, 14, 15])]
    two = frame.where("vec_id in (20, 21)")
    assert [r.vec_id for r in ann.nearest(two, two.where("vec_id = 20"), k=5).collect()] == [21]
    assert ann.nearest(frame.limit(0), frame.limit(0)).count() == 0


def brute_targets(sizes, share=1.5, epochs=2, weights=(3, 1, 2)):
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    cap = {s: epochs * sizes[s] for s in names}
    free, budget, out = set(names), min(share * sum(sizes.values()), sum(cap.values())), {}
    while free:
        level = budget / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= cap[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = cap[s]
            budget -= cap[s]
        free -= over
    return out


def check_mix(rows):
    sizes, taken, aim = {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        aim[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    expected = brute_targets(sizes)
    for s in sizes:
        assert aim[s] == pytest.approx(expected[s], rel=1e-9, abs=1e-9)
        assert abs(taken[s] - aim[s]) <= 2 * mixing.BLOCK
    assert all(r.source_size == sizes[r.source] for r in rows)


def test_mixing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = mixing.mix(docs).collect()
    check_mix(first)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, first), key=str) == sorted(map(tuple, again), key=str)
    assert {r.doc_id: r.size for r in first} == {r.doc_id: len((r.text or "").split()) for r in docs.collect()}


def test_mixing_edges(spark):
    rows = [(i, "w " * (i % 900), ["a", "Z", None, "ü", "hot", "hot", "hot"][i % 7], 1, 2) for i in range(300)] + [(1, None, "a", 1, 2), (2, "", "empty", 1, 2), (None, "x y z", "a", 1, 2), (7, "p q", "a", 1, 2), (7, "p q", "a", 1, 2), (9, "long " * 100_000, "hot", 1, 2)]
    check_mix(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target int").repartition(3)).collect())
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def seats(votes, n):
    """Sainte-Laguë by its definition: seat after seat; ties to the earlier."""
    won = [0] * len(votes)
    for _ in range(n):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        if not votes[best]:
            break
        won[best] += 1
    return won


def test_mixing_takes_what_the_definition_says(spark, monkeypatch):
    """taken of every row, by the same hashes, over several shards, with equal rows and a group of them beyond ALIKE."""
    for name, value in (("SHARD_WORDS", 3000), ("SHARD_ROWS", 120), ("ALIKE", 30)):
        monkeypatch.setattr(mixing, name, value)
    rng = random.Random(11)
    rows = [(rng.choice([i, i, None]), "w " * rng.choice([0, 1, 5, 40, 130, 300]), rng.choice(["a", "a", "b", None])) for i in range(260)] + [(None, "hot row", "b")] * 200 + [(5, "x " * 30, "a")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = sorted((tuple(r) for r in mixing.mix(docs).select("doc_id", "source", "size", "target", "taken").collect()), key=str)
    line = [tuple(r) for r in mixing.hashed(docs, 42, None).select("doc_id", "source", "size", "h", F.xxhash64(F.lit(44), "h").alias("o")).collect()]
    assert max(sum(x[3] == h for x in line) for h in {x[3] for x in line}) <= 30
    names = sorted({x[1] for x in line}, key=lambda s: (s is None, s))
    size = {s: sum(x[2] for x in line if x[1] == s) for s in names}
    target = {s: next(r[3] for r in got if r[1] == s) for s in names}
    blocks = round(sum(target.values()) / 64)
    quota = dict(zip(names, seats([target[s] for s in names], blocks)))
    want = []
    for s in names:
        own = [x for x in line if x[1] == s]
        n = max(1, math.ceil(max(size[s] / 3000, len(own) / 120)))
        shards = [[x for x in own if x[3] % n == k] for k in range(n)]
        used = [k for k in range(n) if shards[k]]
        share = dict(zip(used, seats([sum(x[2] for x in shards[k]) for k in used], quota[s])))
        for k in used:
            shard = sorted(shards[k], key=lambda x: (x[4], x[0] is not None, x[0] or 0, x[3], x[2]))
            words = sum(x[2] for x in shard)
            need = min(share[k] * 64, words * 2)
            passes, rest = divmod(need, words) if words else (0, 0)
            order = spark.range(-(-words // 64)).select("id", F.xxhash64(F.lit(43), F.lit("\0" if s is None else s), F.lit(k).cast("long"), "id").alias("o")).orderBy("o", "id").collect() if rest else []
            gives = {}
            for b in order:
                gives[b.id] = min(64, words - b.id * 64, rest - sum(gives.values()))
            at = 0
            for d, _, z, _, _ in shard:
                extra = sum(max(0, min(at + z, b * 64 + g) - max(at, b * 64)) for b, g in gives.items())
                want.append((d, s, z, target[s], passes * z + extra))
                at += z
    assert got == sorted(want, key=str)


def test_pipeline_mix_takes_rows_without_or_with_equal_ids(spark):
    rows = [(None, f"a{i} " * 50, "a") for i in range(400)] + [(7, f"b{i} " * (30 + i % 40), "b") for i in range(400)] + [(1000 + i, "c " * 50, "c") for i in range(400)]
    rows += [(None, "same words here", "a")] * 300 + [(None, "", "a"), (3, None, "b"), (4, " ", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    aims = {r.source: r.target for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    got = {}
    for r in corpus_pipeline.mix_sources(spark, docs, "").collect():
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
    assert set(got) == {"a", "b", "c"} and all(got[s] == pytest.approx(aims[s], rel=0.1) for s in aims)


def test_sainte_lague(spark):
    votes = {"a": 53_000, "b": 24_000, "c": 23_000, "d": 1, "e": 0}
    frame = spark.createDataFrame([(k, v, 100) for k, v in votes.items()], "name string, v long, seats int")
    got = {r.name: r.quota for r in mixing.apportion(frame, [], "v", "seats", [F.asc("name")]).collect()}
    seats = dict.fromkeys(votes, 0)
    for _ in range(100):
        winner = max(votes, key=lambda k: (votes[k] / (2 * seats[k] + 1), -ord(k)))
        seats[winner] += 1
    assert got == seats


def test_url_rules(spark):
    rules = [*url_filters.RULES, ("Example.NET/", "block"), ("deep.example.net/a/b", "allow")]
    urls = [(1, None), (2, ""), (3, "no scheme.org/"), (4, "http://A.Example.ORG/es/x?q#f"), (5, "http://org"), (6, "https://org/"), (7, "http://notexample.org/es/"), (8, "http://x.com/fr/a"), (9, "http://x.com/frx"), (10, "http://www.com/de/"), (11, "ftp://deep.example.net/a/bc"), (12, "http://example.net?x"), (13, "http://example.net/"), (14, "http:///org/"), (15, "http://example.org/en/123"), (16, "http://a.b://org/x"), (16, "http://a.b://org/x"), (None, "http://x.de/" + "y" * 100_000)]
    frame = spark.createDataFrame([(i, u, "h", "p") for i, u in urls], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path[:12], r.rule, r.verdict) for r in url_filters.filter_urls(frame, rules).collect()}
    assert got == {
        1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("a.example.org", "/es/x", "example.org/es/", "block"), 5: ("org", "", None, "allow"), 6: ("org", "/", "org/", "allow"),
        7: ("notexample.org", "/es/", "org/", "allow"), 8: ("x.com", "/fr/a", "com/fr/", "allow"), 9: ("x.com", "/frx", None, "allow"), 10: ("www.com", "/de/", "com/de/", "block"), 11: ("deep.example.net", "/a/bc", "deep.example.net/a/b", "allow"),
        12: ("example.net", "", None, "allow"), 13: ("example.net", "/", "example.net/", "block"), 14: ("", "/org/", None, "allow"), 15: ("example.org", "/en/123", "example.org/en/1", "block"), 16: ("a.b:", "//org/x", None, "allow"), None: ("x.de", "/yyyyyyyyyyy", None, "allow"),
    }
    assert url_filters.filter_urls(frame.limit(0), []).count() == 0


def test_digest_collisions_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filters, "digest", lambda strings: np.array([len(s) % 3 for s in strings], np.uint64))
    rules = [(f"h{i}.net/{'p' * (i % 5)}", "block" if i % 2 else "allow") for i in range(50)]
    url_filters.write_index(str(tmp_path / "x"), url_filters.unique_rules(rules))
    index = url_filters.Index(str(tmp_path / "x"))
    asked = [r.encode() for r, _ in rules] + [b"h99.net/", b"h1.net/ppp"]
    found = index.find(url_filters.digest(asked), lambda j, rule: rule == asked[j])
    assert [index.string(i) if i >= 0 else None for i in found] == [*asked[:50], None, None]
    assert [int(index.block[i]) for i in found[:50]] == [i % 2 for i in range(50)] and index.lengths == [0, 1, 2, 3, 4]


def test_many_rules_in_several_files(spark, monkeypatch):
    """Equal to trying every rule on every url."""
    monkeypatch.setattr(url_filters, "FILE_BYTES", 400)
    source = random.Random(2)
    host = lambda n: ".".join(source.choice(["a", "bb", "c", "net"]) for _ in range(source.randint(1, n)))
    rules = list({f"{host(3)}/{'xyz/'[: source.randint(0, 4)]}{source.choice(['', 'ü', 'q'])}": source.choice(["allow", "block"]) for _ in range(150)}.items())
    urls = [f"http://{host(5)}/{''.join(source.choice('xyz/üq') for _ in range(source.randint(0, 6)))}" for _ in range(400)]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    expected = {}
    for i, url in enumerate(urls):
        name, _, path = url.removeprefix("http://").partition("/")
        fits = [r for r, _ in rules if f".{name}".endswith("." + r.partition("/")[0]) and path.startswith(r.partition("/")[2])]
        best = max(fits, key=len, default=None)
        expected[i] = (best, dict(rules).get(best, "allow"))
    assert {i: (r and len(r.encode()), v) for i, (r, v) in got.items()} == {i: (r and len(r.encode()), got[i][1]) for i, (r, v) in expected.items()}
    assert all(r is None or (r in dict(rules) and dict(rules)[r] == v) for r, v in got.values()) and sum(r is not None for r, _ in got.values()) > 50


def test_toxicity_fold_and_exceptions(spark):
    model = toxicity.default_model()
    automaton = model.automaton()
    assert toxicity.fold("ІDІ0T! 1di0t").split() == ["idiot", "idiot"]
    x = {t: toxicity.strength(t, automaton) for t in ("", "you 1d10t", "such an idiot, really", "plain words only", "idiotic", "idiot " * 100 + "word " * 900)}
    assert x[""] == x["plain words only"] == x["idiotic"] == 0 < x["such an idiot, really"] and x["you 1d10t"] > 0
    assert x["idiot " * 100 + "word " * 900] < toxicity.strength("idiot " * 100, automaton)
    trash = toxicity.Model({" trash ": 5.0}, (" trash can ",)).automaton()
    assert toxicity.strength("the trash can is full", trash) == 0 < toxicity.strength("you are trash", trash)
    rows = spark.createDataFrame([(1, None, 1.0), (1, "", 1.0), (None, "idiot moron", 1.0), (3, "fine " * 50_000, 1.0)], "doc_id long, text string, score double")
    scores = {(r.doc_id, round(r.score, 3)) for r in toxicity.score(rows, model).collect()}
    assert len(scores) == 3 and max(s for _, s in scores) > 0.5
    assert toxicity.keep_clean(rows, model).columns == rows.columns and toxicity.keep_clean(rows, model).count() == 3
    assert toxicity.score(rows.limit(0), model).count() == 0


@pytest.mark.parametrize("spelling", ["ｉｄｉｏｔ", "ídiot", "𝐢𝐝𝐢𝐨𝐭", "𝓲𝓭𝓲𝓸𝓽", "id!ot", "iidiot", "i d i o t", "i.d.i.o.t", "IDIOT", "ıdiot", "ⓘⓓⓘⓞⓣ", "🅸🅳🅸🅾🆃", "i\u200bd\u00adiot", "ɪᴅɪᴏᴛ", "1d10t", "iđiot", "idiot!!", "i̇d̶i̇o̶t̶"])
def test_toxicity_spellings(spelling):
    automaton = toxicity.default_model().automaton()
    plain = toxicity.strength("well you are an idiot so there it is", automaton)
    assert plain > 0 and toxicity.strength(f"well you are an {spelling} so there it is", automaton) == plain
    assert toxicity.fold("It is a fine day! A big tree, 7 oaks") == toxicity.fold("it is a fine day a big tre t oaks").replace("day", "day ").replace("tre", "tre ")


def strength_by_hand(text, model):
    """Every entry looked for at every place."""
    folded = toxicity.fold(text)
    places = lambda e: [i for i in range(len(folded)) if folded.startswith(e, i)]
    hits = {}
    for entry, weight in model.weights.items():
        if entry not in model.exceptions:
            for i in places(entry):
                hits[i] = max(hits.get(i, 0.0), weight)
    for phrase in model.exceptions:
        for i in places(phrase):
            hits = {h: w for h, w in hits.items() if not i <= h < i + len(phrase) - 1}
    return math.log1p(1000 * sum(hits.values()) / (len(folded.split()) + 20))


def test_toxicity_strength_equals_every_place():
    rng = random.Random(2)
    words = ["scum", "pond", "scums", "idiot", "a", "trash", "can", "cans", "idiotic", "fine", "ídiot"]
    model = toxicity.Model({" scum ": 2.0, " scum": 1.0, " idiot": 3.5, " trash ": 1.25, " can ": 0.5}, (" pond scum ", " trash can ", " can "))
    automaton = model.automaton()
    for _ in range(300):
        text = rng.choice(["", " ", ", "]).join(rng.choices(words, k=rng.randrange(0, 12))) if rng.random() < 0.2 else " ".join(rng.choices(words, k=rng.randrange(0, 14)))
        assert toxicity.strength(text, automaton) == pytest.approx(strength_by_hand(text, model), abs=1e-12)


def test_toxicity_learns_what_counting_finds(spark):
    """Weights and exceptions by their definition over plain lists: copies share a sketch and count once."""
    import xxhash

    rng = random.Random(8)
    clean, bad = [f"w{chr(97 + i)}x" for i in range(20)], ["grimble", "snarkword", "zzad"]
    rows = []
    for i in range(240):
        toxic = int(i % 3 == 0)
        text = rng.choices(clean, k=15) + (rng.choices(bad, k=2) if toxic else []) + (["pond", "zzad"] if not toxic and i % 5 == 1 else [])
        rows.append((i, " ".join(rng.sample(text, len(text)) if toxic else text), toxic))
    rows += [(1000 + i, rows[0][1], 1) for i in range(30)]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(d, x) for d, _, x in rows], "doc_id long, toxic int"))
    seen = set()
    for _, text, toxic in rows:
        words = toxicity.fold(text).split()
        sketch = min(xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 7) >> 1 for i in range(max(1, len(words) - 2)))
        for e in {f" {w} " for w in words} | {f" {w[:5]}" for w in words if len(w) > 5} | {f" {a} {b} " for a, b in zip(words, words[1:])}:
            seen.add((sketch, toxic, e))
    size = [len({s for s, t, _ in seen if t == label}) for label in (0, 1)]
    count = {}
    for _, t, e in seen:
        count.setdefault(e, [0, 0])[t] += 1
    odds = lambda e: math.log((count[e][1] + 0.5) / (size[1] + 1)) - math.log((count[e][0] + 0.5) / (size[0] + 1))
    weights = {e: odds(e) for e in count if count[e][1] >= 10 and len(e.split()) == 1 and odds(e) >= math.log(8)}
    whole = {e.strip() for e in weights if e.endswith(" ")}
    pairs = sorted(e for e in count if count[e][1] == 0 and count[e][0] >= 3 and len(e.split()) == 2 and whole & set(e.split()))
    assert model.weights == {e: pytest.approx(w, abs=1e-6) for e, w in weights.items()} and list(model.exceptions) == pairs
    assert {" zad "} <= set(weights) and " pond zad " in pairs


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int")) == toxicity.default_model()
    assert toxicity.fit(docs, spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, toxic int")) == toxicity.default_model()


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op6_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    # Order and calibration on rows never learned from.
    ranked = sorted(held, key=lambda r: r.score)
    positive, below, area = sum(r.toxic for r in held), 0.0, 0.0
    for score in sorted({r.score for r in ranked}):
        same = [r.toxic for r in ranked if r.score == score]
        area += sum(same) * (below + (len(same) - sum(same)) / 2)
        below += len(same) - sum(same)
    assert area / (positive * (len(held) - positive)) >= 0.95
    assert abs(sum(r.score for r in held) - positive) / len(held) <= 0.02
    for low, high in ((0.0, 0.2), (0.8, 1.01)):
        part = [r for r in held if low <= r.score < high]
        assert abs(sum(r.score for r in part) - sum(r.toxic for r in part)) / len(part) <= 0.1
    good = sum(r.predicted == r.toxic for r in held) / len(held)
    caught = sum(r.predicted for r in held if r.toxic) / sum(r.toxic for r in held)
    # Some labels call texts toxic that hold no toxic word at all; those that hold a plain insult are all caught.
    texts = {r.doc_id: toxicity.fold(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    insults = [toxicity.fold(w) for w in "loser idiot pathetic scum worthless moron trash clown disgusting stupid".split()]
    told = [r for r in held if r.toxic and any(w in texts[r.doc_id] for w in insults)]
    assert good >= 0.98 and caught >= 0.9 and len(told) > 30 and all(r.predicted for r in told)


def test_licences(spark):
    rows = [(1, "Some words.\nReleased under the MIT License.\nmore words"), (2, "licensed under the apache license version 2.0"), (3, "Her driving licence expired in the spring of last year."), (4, None), (5, ""), (6, "no cue at all"), (7, "This program is free software: you can redistribute it under the terms of the GNU General Public License"), (8, "word " * 50_000 + "\nLicensed under CC BY-NC 4.0."), (8, "Licensed under CC BY-NC 4.0."), (None, "Copyright notice of nothing in particular, kept by the clerk")]
    frame = spark.createDataFrame([(*r, 1, "f") for r in rows], "doc_id long, text string, line int, family string")
    got = sorted((r.doc_id or 0, r.line, r.family) for r in licences.scan_licences(frame).collect())
    assert got == [(0, 0, "unknown"), (1, 1, "mit"), (2, 0, "apache"), (3, 0, "unknown"), (7, 0, "gpl"), (8, 0, "cc-by-nc"), (8, 1, "cc-by-nc")]
    assert licences.scan_licences(frame.limit(0)).count() == 0


def test_licences_read_every_line_that_could_be_named(spark):
    """Named rows are those that the classifier and the templates name over all lines, gate or no gate."""
    rows = [(-1, "Distributed under the BSD 3-Clause terms."), (-2, "of the\nterms of the\n\n..."), (-3, "You may not use this file except in compliance with it"), (-4, "This Source Code Form is subject to the terms of the Mozilla Public"), (-5, "a path like this one is subject to the terms of the park"), (-6, "some words\nReleased under the MIT License.\nmore"), (-7, "Licensed under the Apache License, Version 2.0.")]
    short = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 400").select("doc_id", "text")
    docs = short.unionAll(spark.createDataFrame(rows, "doc_id long, text string"))
    model = licences.classifier(spark)
    every = model.classify(model.compared(licences.lines_of(docs).withColumn("cue", F.lit(True)), 0.6), 0.5, 0.6)
    named = lambda found: sorted((r.doc_id, r.line, r.family, round(r.probability, 9), r.similarity) for r in found.where("family != 'unknown'").collect())
    got = named(licences.scan_licences(docs))
    assert got == named(every) and len(got) > 3
    assert {(-1, "bsd"), (-4, "mpl")} <= {(d, f) for d, _, f, _, _ in got} and not {-2, -5} & {d for d, *_ in got}


PROBES = {
    "This code is MIT licensed.": ["mit"], "Licensed under Apache-2.0": ["apache"], "GPLv3 licensed": ["gpl"], "dual licensed under MIT and Apache 2.0": ["apache", "mit"], "SPDX-License-Identifier: (MIT OR Apache-2.0)": ["apache", "mit"],
    "SPDX-License-Identifier: LGPL-2.1-or-later": ["lgpl"], "The company is licensed under the law of the state": [], "This is published under the EUPL licence": [], "Released under the wings of the old mill, the birds flew off": [], "MIT and Apache helicopters met at the museum": None,
}
WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM"


def test_licences_in_other_words(spark):
    """Short mentions, SPDX expressions and dual licences, and a notice wrapped over lines between others."""
    docs = spark.createDataFrame([*enumerate(PROBES), (100, f"first words\n\n{WARRANTY}\n\nlast words"), (101, "plain prose\nover two lines\n\nmore of it")], "doc_id long, text string")
    rows = licences.scan_licences(docs).collect()
    assert {text: next((r.families for r in rows if r.doc_id == i), None) for i, text in enumerate(PROBES)} == PROBES
    assert [(r.line, r.n_lines, r.family) for r in rows if r.doc_id == 100 and r.n_lines > 1] == [(2, 4, "mit")] and not any(r.doc_id == 101 for r in rows)


def test_licences_of_unseen_templates(spark):
    """Without every third template, most of those are named, what is named is right, and probabilities mean what they say."""
    model = licences.Classifier(spark, licences.others)
    texts = [(t, f) for f in licences.TEMPLATES for t in licences.held_out(licences.TEMPLATES[f])]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan_licences(docs, model=model).collect()}
    licence = [i for i, (_, f) in enumerate(texts) if f != licences.UNKNOWN]
    named = [i for i in licence if i in got and got[i].family != licences.UNKNOWN]
    right = sum(got[i].family == texts[i][1] for i in named)
    assert right / len(licence) >= 0.75 and right / len(named) >= 0.95
    assert not any(got[i].family != licences.UNKNOWN for i, (_, f) in enumerate(texts) if f == licences.UNKNOWN and i in got)
    sure = [(got[i].probability, got[i].family == texts[i][1]) for i in named]
    assert abs(sum(p for p, _ in sure) - sum(x for _, x in sure)) / len(sure) <= 0.15


def test_licences_equal_plain_arithmetic(spark):
    """Probability, family and likeness of lines by softmax and sets, from the fitted numbers."""
    model = licences.classifier(spark)
    tf, regression = model.model.stages
    lines = [*PROBES, "Redistribution in binary form must reproduce the copyright notice", "copyright", "the software is free", "...", "Permission granted"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id: r for r in model.classify(model.compared(licences.lines_of(docs).withColumn("cue", F.lit(True)), 0.6), 0.5, 0.6).collect()}
    features = {r.paragraph: r.features for r in tf.transform(licences.with_grams(docs.withColumnRenamed("text", "paragraph"))).collect()}
    weights, intercept = regression.coefficientMatrix.toArray(), np.array(list(regression.interceptVector))

    def pairs(text):
        words = [w for w in re.split(r"[^\w.+-]+", text.lower()) if w]
        return {f"{a.rstrip('.')} {b.rstrip('.')}" for a, b in zip(words, words[1:])}

    for i, line in enumerate(lines):
        z = (weights @ features[line].toArray() + intercept) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        family = model.families[int(z.argmax())]
        own = pairs(line)
        alike = max((len(own & pairs(t)) / max(1, min(len(pairs(t)), len(own))) for t in licences.TEMPLATES[family]), default=0.0) if family != licences.UNKNOWN else 0.0
        want = family if p.max() >= 0.5 and alike >= 0.6 else licences.UNKNOWN
        assert (got[i].family, got[i].probability, got[i].similarity) == (want, pytest.approx(p.max(), abs=1e-9), pytest.approx(alike, abs=1e-9))


QUESTION = "a farmer called Anna has 12 apples and gives 5 apples to her friend Ben before lunch. How many apples does Anna keep after she sold 12 pears to the shop for 3 dollars?"


def test_decontamination(spark):
    other = QUESTION.replace("12", "40").replace("Anna", "Maria").replace("dollars", "euros")
    torn = QUESTION.replace("12", "40", 1)
    unlike = "a farmer called Anna went to the market on a bright day and nothing else happened there at all until the evening bell"
    numbers = "1 2 3 4 5 6 7"
    rows = [(1, f"Intro words. {QUESTION} Outro."), (2, f"Text before: {other} after."), (3, torn), (4, unlike), (5, None), (6, ""), (7, QUESTION + " " + "filler words here " * 30_000), (8, " ".join(QUESTION.split()[:20])), (None, QUESTION), (1, f"Intro words. {QUESTION} Outro."), (9, numbers), (10, "8 9 8 9 8 9 8")]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, item_id int, key string")
    items = spark.createDataFrame([(100, QUESTION), (100, QUESTION), (101, None), (102, "too short"), (None, QUESTION), (103, numbers)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.kind, r.containment) for r in decontamination.contaminated(docs, items).collect()}
    assert got[(1, 100)] == ("exact", 1.0) and got[(2, 100)] == ("reparameterised", 1.0) and got[(7, 100)] == ("exact", 1.0) and got[(9, 103)] == ("exact", 1.0)
    assert {d for d, i in got if i == 100} == {1, 2, 7}
    assert decontamination.contaminated(docs.limit(0), items).count() == 0 and decontamination.contaminated(docs, items.limit(0)).count() == 0


def edited_item():
    plain = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(57)]
    for at in (10, 25, 40):
        plain[at] = "Alice"
    return plain


def test_decontamination_keeps_the_windows_of_an_edited_passage(spark):
    """One of two or three equal names is edited; the rest stands there, word for word or re-parameterised."""
    own = edited_item()
    two = [w if i != 40 else "closing" for i, w in enumerate(own)]
    texts = {1: (own, 10), 2: (own, 40), 3: ([w.replace("Alice", "Maria") for w in own], 25)}
    docs = [(d, "lead in " + " ".join("Alicia" if i == at else w for i, w in enumerate(words))) for d, (words, at) in texts.items()]
    docs += [(4, "lead in " + " ".join("Alicia" if i == 10 else w for i, w in enumerate(two)))]
    items = spark.createDataFrame([(1, " ".join(own)), (2, " ".join(two))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_matched, r.n_windows, r.kind) for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert {k: got.get(k) for k in ((1, 1), (2, 1), (3, 1), (4, 2))} == {(1, 1): (48, 53, "exact"), (2, 1): (48, 53, "exact"), (3, 1): (48, 53, "reparameterised"), (4, 2): (43, 53, "exact")}


def test_decontamination_of_plain_words_and_short_items(spark):
    """Words in another case or after another line break type differently; short items are one window."""
    names = "near Paris Anna met Ben Carl Dora and Emil while Franz told Greta of Hans in Rome before Ida left Jena with Karl"
    docs = [(1, f"so {QUESTION.lower()} end"), (2, f"so {names.lower()} end"), (3, names.replace(" ", "\n")), (4, "and Big  red, fox ran"), (5, "big red dog"), (6, "is 42 here"), (7, "is 43 here")]
    items = [(100, QUESTION), (101, names), (102, "big Red fox."), (103, "42"), (104, "")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.containment, r.kind) for r in decontamination.contaminated(*frames).collect()}
    assert got == dict.fromkeys([(1, 100), (2, 101), (3, 101), (4, 102), (6, 103)], (1.0, "exact"))


def brute_align(item, text, similarity=0.8):
    """The definition on strings: all windows of both, chains by comparing every pair of places."""
    def tokens(t):
        words = [(w, i) for i, w in enumerate(x for x in re.split(r"[\x20\x09-\x0D]+", t) if x)]
        gaps = re.split(r"[^\x20\x09-\x0D]+", t.strip(" \t\n\x0b\x0c\r"))
        trim = lambda w: w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") or w
        plain, kinds = [], []
        for w, i in words:
            opens = i == 0 or words[i - 1][0][-1] in ".!?:" or "\n" in gaps[i]
            low = trim(w).lower()
            plain.append(low)
            kinds.append("number" if any(c.isdigit() for c in trim(w)) or low in decontamination.NUMBER_WORDS else "unit" if low in decontamination.UNITS else "name" if trim(w)[:1].isupper() and not opens else "")
        out = []
        for i, (low, kind) in enumerate(zip(plain, kinds)):
            value = str(decontamination.NUMBER_WORDS.get(low, low))
            if out and kind in ("number", "name") and kinds[i - 1] == kind:
                out[-1][1].append(value)
            else:
                out.append((i, [value], kind))
        return plain, [(i, " ".join(v), k, k or v[0]) for i, v, k in out]

    own, slots = tokens(item)
    words, there = tokens(text)
    width = min(5, len(own))
    if not own:
        return None
    telling = [t for t in range(len(slots) - width + 1) if sum(not x[2] for x in slots[t : t + width]) >= 3]
    begins = [slots[t][0] for t in telling] or list(range(len(own) - width + 1))
    at = {x[0]: j for j, x in enumerate(there)}

    def match(k, place):
        if words[place : place + width] == own[begins[k] : begins[k] + width]:
            return "plain"
        j = at.get(place)
        if telling and j is not None and [x[3] for x in there[j : j + width]] == [x[3] for x in slots[telling[k] : telling[k] + width]]:
            return "typed"

    need, after = max(1, math.ceil(0.8 * len(begins) - 1e-9)), -1
    hits = [(k, p) for k in range(len(begins)) for p in range(len(words)) if match(k, p)]
    while True:
        left = [h for h in hits if h[1] > after]
        ending = {h: 1 for h in left}
        for h in sorted(left):
            ending[h] = 1 + max((ending[g] for g in left if g[0] < h[0] and g[1] < h[1]), default=0)
        longest = max(ending.values(), default=0)
        if longest < need:
            return None
        end = min(p for (k, p), n in ending.items() if n == longest)
        left = [h for h in left if h[1] <= end]
        begin = {}
        for h in sorted(left, reverse=True):
            begin[h] = 1 + max((begin[g] for g in left if g[0] > h[0] and g[1] > h[1]), default=0)
        chain, rest = [], longest
        while rest:
            options = [h for h in left if begin[h] == rest and (not chain or (h[0] > chain[-1][0] and h[1] > chain[-1][1]))]
            chain.append(max(options, key=lambda h: (h[1], h[0])))
            rest -= 1
        votes, said = {}, []
        for k, place in chain:
            same, mine = match(k, place) == "plain", []
            for s in range(telling[k], telling[k] + width) if telling else ():
                if slots[s][2] and not (same and slots[s][0] >= begins[k] + width):
                    other = slots[s][1] if same else there[at[place] + s - telling[k]][1]
                    votes.setdefault(slots[s][1], {}).setdefault(other, set()).add(s)
                    mine.append((slots[s][1], other))
            said.append((same, mine))
        best = {w: [o for o, x in v.items() if len(x) == max(map(len, v.values()))] for w, v in votes.items()}
        good = [same for same, mine in said if all(best[w] == [o] for w, o in mine)]
        if len(good) >= need:
            return len(good), sum(good), len(begins)
        after = end


def probe_texts():
    words, filler = QUESTION.split(), " then some noise stood here for long and nothing else did "
    cut = words.index("lunch.") + 1
    torn = QUESTION.replace("12", "40", 1)
    halves = lambda t: filler.join([" ".join(t.split()[:cut]), " ".join(t.split()[cut:])])
    backwards = filler.join(" ".join(words[i : i + 5]) for i in reversed(range(len(words) - 4)))
    return {
        "longer name": (QUESTION.replace("Anna", "Maria Clara"), "reparameterised"), "number word": (QUESTION.replace("12", "twelve"), "reparameterised"), "torn": (torn, None), "torn apart": (halves(torn), None),
        "apart": (halves(QUESTION), "exact"), "backwards": (backwards, None), "second of two": (torn + filler + QUESTION.replace("12", "77"), "reparameterised"), "lower": (QUESTION.lower(), "exact"),
        "apart, other numbers": (halves(QUESTION.replace("12", "31").replace("Anna", "Eva Lou")), "reparameterised"),
    }


def test_decontamination_probes(spark):
    probes = probe_texts()
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(probes.values())], "doc_id long, text string")
    items = spark.createDataFrame([(1, QUESTION), (2, QUESTION)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in decontamination.contaminated(docs, items).collect()}
    assert got == {(i, k): kind for i, (_, kind) in enumerate(probes.values()) for k in (1, 2) if kind}


def test_decontamination_is_all_pairs_by_brute_force(spark):
    source = random.Random(6)
    items = {100: QUESTION, 101: "near Paris Anna met Ben Carl Dora and Emil while Franz told Greta of Hans in Rome before Ida left", 102: "only four plain words", 103: "7 8 9 10 11 12", 104: "Two hundred miles of road, and Bob drove 30 miles a day", 105: "the same old words the same old words the same old words again"}
    docs = {i: t for i, (t, _) in enumerate(probe_texts().values())}
    for i in range(120):
        words = items[source.choice(list(items))].split()
        for _ in range(source.randint(0, 4)):
            at = source.randrange(len(words))
            words[at : at + source.randint(0, 2)] = source.choice([["Mia"], ["twelve"], ["5", "6"], ["some"], [], ["Ben"], ["the", "same", "old", "words"], ["so.\n"]])
        docs[1000 + i] = " ".join(["Lead", "in"] * source.randint(0, 3) + words + words[: source.randint(0, 9)])
    frames = spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_matched, r.kind == "exact", r.n_windows) for r in decontamination.contaminated(*frames).collect()}
    expected = {(d, i): found for d, t in docs.items() for i, x in items.items() if (found := brute_align(x, t))}
    assert got == {k: (n, n == same, total) for k, (n, same, total) in expected.items()} and len(got) > 40


@pytest.mark.parametrize(
    "parts, value",
    [([2, 100, 50], 250), ([20, 1], 21), ([3, 1000000], 3000000), ([2, 1000, 5, 100, 6], 2506), ([1, 1000000, 2, 1000], 1002000), ([5, 6], None), ([20, 30], None), ([100, 5], None), ([1000, 1000000], None), ([12, 5], None), ([40, 2, 3], None), ([999, 1000], 999000), ([7], 7)],
)
def test_numerals(parts, value):
    assert decontamination.spoken_number(parts) == value


def test_decontamination_numbers_and_names(spark):
    """Numbers by value, however they are written, and names of any script."""
    own = "when Anna from the old town had 12 apples and sold some of them to the farmer who kept 1,200 pears and 1200 plums in his barn she then asked him for 12 more apples and he said that 250 of the 1200 plums were gone by noon"
    spelled = own.replace("250", "two hundred fifty").replace("12 ", "twenty-one ").replace("Anna", "Łucja")
    other = own.replace("12 apples", "21 apples").replace("12 more", "twenty one more").replace("Anna", "Ωmega").replace("1,200", "1300").replace("1200", "1,300")
    torn = own.replace("1,200", "1,300")
    docs = [(1, own.replace("1200", "1,200")), (2, spelled), (3, other), (4, torn), (5, own.replace("Anna", "Жанна").replace("1,200", "five thousand").replace("1200", "5,000"))]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, own)], "item_id long, text string")
    got = {r.doc_id: (r.kind, r.containment) for r in decontamination.contaminated(*frames).collect()}
    assert set(got) == {1, 2, 3, 5} and all(kind == "reparameterised" and share > 0.95 for kind, share in got.values())


def test_decontamination_of_one_template(spark):
    """Four hundred items of one template, a hundred documents with other values, and some with an item's own: a row a document."""
    ask = "what is {} plus {} when you add them up and write down the sum"
    items = [(i, ask.format(i + 1000, i + 2000)) for i in range(400)] + [(900, ask.format(5000, 5000)), (901, ask.format(1000, 2000))]
    docs = [(d, f"lead in {ask.format(d + 7000, d + 8001)} out") for d in range(100)] + [(500 + d, f"so {items[d][1]} end") for d in range(0, 400, 50)] + [(600, ask.format(8, 8))]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.kind, r.n_items) for r in decontamination.contaminated(*frames).collect()}
    want = {(d, 0): ("reparameterised", 401) for d in range(100)} | {(500 + d, 0): ("reparameterised" if d else "exact", 401) for d in range(0, 400, 50)} | {(500 + d, d): ("exact", 1) for d in range(50, 400, 50)}
    # Item 901 is item 0 word for word; 900 has two equal slots and is a class of its own.
    want |= {(500, 901): ("exact", 401), **{(500 + d, 901): ("reparameterised", 401) for d in range(50, 400, 50)}, **{(d, 901): ("reparameterised", 401) for d in range(100)}, (600, 900): ("reparameterised", 1)}
    assert {k: v for k, v in got.items() if k != (600, 0) and k != (600, 901)} == want
    heads = {r.item_id: r.head_id for r in decontamination.class_of(frames[1]).collect()}
    assert heads == {i: 0 for i in [*range(400), 901]} | {900: 900}


def test_decontamination_of_hot_windows(spark):
    """One passage in every document and every item: no row for each pair of them."""
    passage = "what is the best answer to this question out of the four that follow here"
    items = [(i, f"{passage} " + " ".join(f"i{chr(97 + i // 26)}{chr(97 + i % 26)}{chr(97 + j)}" for j in range(20))) for i in range(60)]
    docs = [(d, f"{passage} {passage}" + (f" so {items[d][1]}" if d < 5 else "")) for d in range(300)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.containment) for r in decontamination.contaminated(*frames).collect()) == [(d, d, 1.0) for d in range(5)]


def test_decontamination_without_prefilter(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    some = sorted(map(tuple, decontamination.contaminated(docs, items).collect()))
    monkeypatch.setattr(decontamination, "PREFILTER_LIMIT", 10)
    assert some and some == sorted(map(tuple, decontamination.contaminated(docs, items).collect()))
    texts = {r.doc_id: " ".join(r.text.split()) for r in docs.collect()}
    whole = {(d, r.item_id) for r in items.collect() for d, t in texts.items() if " ".join(r.text.split()) in t}
    assert whole <= {(r[0], r[1]) for r in some}
    assert not math.isnan(sum(r[5] for r in some))
