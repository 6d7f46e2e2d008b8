"""Substring deduplication, SimHash, personal data and token files against brute force."""

import hashlib
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rosterlake.llm import common, components, pii, queries, simhash, substring_dedup, token_frames

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def documents(spark, n=200):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(n).collect()]


def odd_rows():
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    passage = " ".join(f"p{i}" for i in range(60))
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two"), (6, passage), (7, f"lead in {passage} lead out"), (8, passage), (9, long), (10, long[:50_000]),
        (11, "again " * 50), (12, f"{passage} {passage}"), (13, "ÄÖÜ ß x y z Σ"), (14, f"x {' '.join(f'p{i}' for i in range(25))} y"), (15, "one two"),
    ]


def frame(spark, rows):
    """With clashing extra columns."""
    return spark.createDataFrame([(d, t, 1, 2, "x", 3) for d, t in rows], "doc_id long, text string, start int, anchor int, spans string, fp int").repartition(3)


@pytest.mark.parametrize("length, gram", [(20, 6), (7, 3)])
def test_substring_dedup(spark, length, gram):
    for rows in (odd_rows(), documents(spark)):
        got = {r[0]: (r[1], r[2], r[3]) for r in substring_dedup.digest(substring_dedup.dedup_substrings(frame(spark, rows), length, gram)).collect()}
        assert got == substring_dedup.brute_force(rows, length)


def test_substring_dedup_edges(spark):
    assert substring_dedup.dedup_substrings(frame(spark, [])).count() == 0
    text = " ".join(f"a{i}" for i in range(30))
    rows = substring_dedup.dedup_substrings(frame(spark, [(None, text), (1, text), (1, text), (2, text)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 0), (1, 0), (1, 0), (2, 30)]


def thue_morse(n, a, b):
    out = [a]
    while len(out) < n:
        out += [b if x == a else a for x in out]
    return out[:n]


def test_word_hashes_tell_words_apart():
    """Words that polynomial hashes modulo 2**64 can't tell apart, and all short words over few bytes."""
    import itertools

    words = ["".join(thue_morse(n, a, b)) for n in (8, 32, 47, 48, 49, 1024, 4096) for a, b in ("ab", "ba")]
    words += ["".join(x) for n in range(1, 8) for x in itertools.product("ab\x01", repeat=n)] + [f"w{i}" for i in range(50_000)] + ["a" * n for n in range(8, 60)]
    data = " ".join(words).encode()
    starts, ends, _ = common.word_bounds(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    hashes = common.word_hashes(np.frombuffer(data, np.uint8), starts, ends)
    assert len(starts) == len(words) and len(np.unique(hashes)) == len(set(words))
    alone = [common.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0] for w in words[:14]]
    assert alone == hashes[:14].tolist()


def test_substring_dedup_of_words_that_hash_alike_elsewhere(spark):
    one, two = ("".join(thue_morse(2048, a, b)) for a, b in ("ab", "ba"))
    lead = [f"v{i}" for i in range(19)]
    rows = [(1, " ".join([*lead, one])), (2, " ".join([*lead, two])), (3, " ".join([*lead, two])), (4, " ".join(thue_morse(64, "x", "y"))), (5, " ".join(thue_morse(64, "y", "x")))]
    got = {r[0]: (r[1], r[2], r[3]) for r in substring_dedup.digest(substring_dedup.dedup_substrings(frame(spark, rows))).collect()}
    assert got == substring_dedup.brute_force(rows) and got[2][1] == 0 and got[3][1] == 20


def brute_fingerprint(text):
    own = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not own:
        return 0
    grams = [" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(marks):
    left = {d: d for d in marks}

    def root(x):
        while left[x] != x:
            x = left[x]
        return x

    ids = sorted(marks)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (marks[a] ^ marks[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                left[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


def test_simhash(spark):
    for rows in (odd_rows(), documents(spark)):
        marks = {d: brute_fingerprint(t) for d, t in rows}
        roots = brute_components(marks)
        got = {r[0]: (r[1], r[2]) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
        assert got == {d: (f"{marks[d]:016x}", roots[d]) for d in marks}
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    rows = simhash.near_duplicates(frame(spark, [(None, "a b c"), (5, "a b c"), (5, "a b c")])).collect()
    assert {r.component_id for r in rows} == {5} and len(rows) == 3


def test_fingerprint_links_of_hot_buckets(spark, monkeypatch):
    """Buckets beyond CHUNK and beyond SMALL, and far fingerprints, keep exactly their components."""
    source = np.random.default_rng(3)
    base = [int(x) for x in source.integers(0, 1 << 63, 6)]
    values = {b ^ sum(1 << int(i) for i in source.choice(64, source.integers(0, 5), replace=False)) for b in base for _ in range(160)} | {int(x) for x in source.integers(0, 1 << 63, 300)}
    values = sorted(values)
    monkeypatch.setattr(simhash, "CHUNK", 20)
    rows = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    roots = {r.node: r.root for r in components.components(simhash.fingerprint_links(rows)).collect()}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    expected = brute_components({i: values[i] for i in range(len(values))})
    ours = [roots.get(s, s) for s in signed]
    groups = lambda labels: sorted(sorted(i for i, x in enumerate(labels) if x == y) for y in set(labels))
    assert groups(ours) == groups([expected[i] for i in range(len(values))])


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 90)] + [(None, 3), (500, 500)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, **{i: 1 for i in range(2, 90)}}


def test_components_of_stars_take_no_step(spark, monkeypatch):
    """Edges that are stars already are written once and returned; others go on until they are."""
    written = []
    monkeypatch.setattr(components, "staged", lambda df, name: (written.append(name), common.staged(df, name))[1])
    got = {r.node: r.root for r in components.components(spark.createDataFrame([(1, 2), (3, 1), (8, 7)], "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 8: 7} and len(written) == 1
    got = {r.node: r.root for r in components.components(spark.createDataFrame([(1, 2), (3, 2)], "a long, b long")).collect()}
    assert got == {2: 1, 3: 1} and len(written) == 3
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute_spans(text):
    checks = (
        ("email", EMAIL, lambda v: True), ("ip", IP, lambda v: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in v.split("."))),
        ("card", CARD, lambda v: 12 <= len(d := re.sub("[ -]", "", v)) <= 19 and luhn(d)), ("phone", PHONE, lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15),
    )
    found = [(m.start(), i, kind, m.end()) for i, (kind, rule, good) in enumerate(checks) for m in re.finditer(rule, text or "", re.ASCII) if good(m.group())]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


PII_ROWS = [
    (1, None), (2, ""), (3, "mail a.b@c.d.e@f.gh and x_y@z..q, _@a.b.c. or @no.no a@b"), (4, "ip 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 00001.02.3.255 9999999999999999999999.1.1.1"),
    (5, "card 4041894974608795 4041-8949 7460-8795, 4041  8949 and 4041 8949 7460 8795 1 - 2"), (6, "tel +1 (988) 555-2485 +49 30 1234567. ++1 2 +12 3"),
    (7, "ünï a@b.co 😀 x@y.zz 😀+1 (456) 555-2186 4041894974608795"), (8, "a." * 20_000 + "@" + "b." * 20_000), (9, "1 " * 40_000), (10, "1" * 50_000 + ".1.1.1 " + "x" * 60_000),
    (11, "a@b.c_x@d.e 1.2.3.4\n+1 (988) 555-2485\t+1.2.3.4.5.6.7.8.9"), (12, "9" * 19 + " " + "5-" * 9 + "5"),
]


def base_of(rows):
    return {r.doc_id: [f"{x.kind}:{x.start}:{x.end}" for x in r.base] for r in rows}


def test_pii_base_spans(spark):
    for rows in (PII_ROWS, documents(spark)):
        found = pii.find_pii(frame(spark, rows)).collect()
        assert base_of(found) == {d: brute_spans(t) for d, t in rows}
        assert all(not r.extra for r in found)
    assert pii.find_pii(frame(spark, [])).count() == 0


def test_pii_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"words here please call at +1 (988) 555-{1000 + i} and go") for i in range(20)]
    rows += [(50, "just call at 555-0199 today"), (51, "other words 555-0199 elsewhere"), (52, "read page 77 of it"), (52, "read page 77 of it"), (None, "call at 555-0199 now")]
    found = [(r.doc_id, [f"{x.kind}:{x.start}:{x.end}" for x in r.extra]) for r in pii.find_pii(frame(spark, rows)).collect() if r.extra]
    assert sorted(found, key=str) == sorted([(50, ["phone:13:21"]), (51, ["phone:12:20"]), (None, ["phone:8:16"])], key=str)
    common_words = [(i, f"one of the +1 (988) 555-{1000 + i} " + "of the day " * 30) for i in range(20)] + [(50, "some of the 555-0199 rows")]
    assert not [r for r in pii.find_pii(frame(spark, common_words)).collect() if r.extra]


def test_pii_follows_every_pattern_with_support(spark):
    """Eighty common contexts with more seeds than the one that tells."""
    rows = [(p * 10 + i, f"so of{p} the{p} +1 (988) 555-{1000 + i} " + f"of{p} the{p} day " * 5) for p in range(80) for i in range(8)]
    rows += [(2000 + i, f"and call at +1 (977) 555-{1000 + i} now") for i in range(5)] + [(3000, "just call at 555-0199 today"), (3001, "so of1 the1 555-0198 day")]
    found = {r.doc_id: [f"{x.kind}:{x.value}" for x in r.extra] for r in pii.find_pii(frame(spark, rows), threshold=0.8).collect() if r.extra}
    assert found == {3000: ["phone:555-0199"]}


def test_pii_totals_count_every_occurrence(spark):
    docs = frame(spark, [(1, "Call  call\tcall call x"), (2, "a call call"), (3, None), (4, "x"), (5, "call at (now"), (6, "please call at noon")])
    got = pii.pattern_totals(docs, spark.createDataFrame([("call call",), ("call at",), ("no such",), ("please call",)], "pair string")).collect()
    assert {(r.side, r.pair): r.total for r in got} == {("left", "call call"): 3, ("right", "call call"): 3, ("left", "call at"): 2, ("right", "call at"): 1, ("left", "please call"): 1}


def test_pii_overlapping_patterns_give_no_false_spans(spark):
    rows = [(i, f"then please call +1 (988) 555-{1000 + i} or") for i in range(20)] + [(100 + i, f"you call at +1 (977) 555-{1000 + i} or") for i in range(20)] + [(1000 + i, "please call at noon7 today") for i in range(200)]
    assert not [r for r in pii.find_pii(frame(spark, rows)).collect() if r.extra]


def test_pii_discovered_values_induce_patterns(spark):
    """Left contexts find ids, those ids a right context, and that one more ids."""
    rows = [(i, f"my direct line {'+1 (988) 555-%d' % (1000 + i)} x{i} y{i}") for i in range(60)] + [(100 + i, f"my direct line ext-{i}5 so s{i}") for i in range(6)]
    rows += [(200 + i, f"a{i} b{i} ext-{i}5 rings the desk") for i in range(6)] + [(300, "c d ext-99 rings the desk"), (301, "so ext-99 it is"), (302, "page 99 of it")]
    found = {r.doc_id: [(x.kind, x.value) for x in r.extra] for r in pii.find_pii(frame(spark, rows), threshold=0.8).collect() if r.extra}
    assert found[300] == found[301] == [("phone", "ext-99")] and 302 not in found and all(found[d] == [("phone", f"ext-{d % 100}5")] for d in (*range(100, 106), *range(200, 206)))


def test_pii_follows_a_long_chain_of_contexts(spark, monkeypatch):
    """Seven contexts, each induced by the values of the one before; with patterns sent to the tasks and without."""
    rows = [(i, f"my direct line {'+1 (988) 555-%d' % (1000 + i)} x{i} y{i}") for i in range(60)] + [(100 + i, f"my direct line e{i}0 end{i}") for i in range(6)]
    letters = lambda n: "".join(chr(97 + int(x)) for x in str(n))
    for step in range(6):
        left, known = f"s{letters(step)} t{letters(step)}", [f"{left_} e{i}{step} u{letters(1000 * step + 20 * i + j)} v{letters(1000 * step + 20 * i + j)}" for left_ in [f"s{letters(step)} t{letters(step)}"] for i in range(6) for j in range(20)]
        rows += [(1000 * (step + 1) + n, text) for n, text in enumerate(known)] + [(9000 + 10 * step + i, f"{left} e{i}{step + 1} off{letters(10 * step + i)}") for i in range(6)]
    want = {f"e{i}{step}" for i in range(6) for step in range(7)}
    for sent in (pii.SENT_PATTERNS, 0):
        monkeypatch.setattr(pii, "SENT_PATTERNS", sent)
        got = pii.find_pii(frame(spark, rows), threshold=0.6).select(F.explode("extra.value").alias("v")).distinct().collect()
        assert {r.v for r in got} == want


def brute_words(text, last):
    glued, own = text and text[-1 if last else 0] not in " \t\n\x0b\x0c\r", words(text)
    own = (own[:-1] if last else own[1:]) if glued else own
    return " ".join(own[-2:] if last else own[:2]).lower() if len(own) >= 2 else None


def brute_matches(rule, text):
    """(start, end, value, left, right) of all matches."""
    at = [m.span() for m in re.finditer(rule, text, re.ASCII)]
    for i, (a, b) in enumerate(at):
        yield a, b, text[a:b], brute_words(text[at[i - 2][0] if i > 1 else 0 : a], True), brute_words(text[b : at[i + 2][1] if i + 2 < len(at) else len(text)], False)


def brute_discovery(texts, min_support, threshold):
    """Known values by the definition, over plain lists."""
    instances, totals = [], {}
    for text in texts:
        valid = {tuple(x.split(":")[1:]) + (x.split(":")[0],) for x in brute_spans(text)}
        base = [(k, m) for k, rule in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)) for m in brute_matches(rule, text) if (str(m[0]), str(m[1]), k) in valid]
        others = [(None, m) for m in brute_matches(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*[0-9@][^\x20\x09-\x0D]*", text) if not any(x[1][0] < m[1] and x[1][1] > m[0] for x in base)]
        instances += [(k, m[2], side, pair) for k, m in base + others for side, pair in (("left", m[3]), ("right", m[4])) if pair]
        own = words(text.lower())
        for i in range(len(own) - 1):
            pair = f"{own[i]} {own[i + 1]}"
            for side, there in (("left", i < len(own) - 2), ("right", i > 0)):
                totals[side, pair] = totals.get((side, pair), 0) + there
    confidence, at = {}, {}
    for k, v, *key in instances:
        if totals.get(tuple(key)):
            at.setdefault(tuple(key), []).append((k, v))
    known = (0, 0.0, 0)
    while True:
        scores = {}
        for key, there in at.items():
            options = []
            for kind in pii.KINDS:
                near = [(v, 1.0 if k else confidence.get((kind, v), 0.0)) for k, v in there if k in (kind, None)]
                support = len({v for v, c in near if c >= threshold})
                if support >= min_support:
                    options.append((support, kind, sum(c for _, c in near) / totals[key]))
            if options and max(options)[2] >= pii.TRUST:
                scores[key] = max(options)[1], min(0.999, max(options)[2])
        miss = {}
        for v, key in {(v, tuple(own)) for k, v, *own in instances if k is None and tuple(own) in scores}:
            kind, score = scores[key]
            miss[kind, v] = miss.get((kind, v), 1.0) * (1 - score)
        confidence = {key: 1 - m for key, m in miss.items()}
        state = sum(c >= threshold for c in confidence.values()), sum(confidence.values()), len(scores)
        if not state[0] or not pii.grown(state, known):
            break
        known = state
    return {v: max((c, k) for (k, w), c in confidence.items() if w == v)[1] for (_, v), c in confidence.items() if c >= threshold}


def test_pii_bootstrap_equals_brute_force(spark):
    source, texts = __import__("random").Random(9), []
    values = {"phone": lambda: f"+1 (988) 555-{source.randint(1000, 1030)}", "email": lambda: f"u{source.randint(0, 30)}@ex.org", "ip": lambda: f"10.0.0.{source.randint(0, 30)}", "id": lambda: f"id-{source.randint(0, 25)}", "number": lambda: str(source.randint(0, 40))}
    lefts = [f"l{i} m{i}" for i in range(8)] + ["of the", "so the"]
    for i in range(300):
        text = []
        for _ in range(source.randint(1, 4)):
            place = source.randrange(10)
            kind = source.choice(["phone"] * 9 + ["id"] if place < 3 else ["email"] * 4 + ["id"] if place < 5 else ["ip", "number"] if place < 6 else list(values))
            text += [lefts[place], values[kind]() + source.choice(["", "", ",", "."]), f"r{(place + source.randint(0, 1)) % 5} q{place % 5}", source.choice(["", "word", "of the day", "and so"])]
        texts.append(" ".join(text))
    for support, threshold in ((4, 0.8), (5, 0.6)):
        docs = frame(spark, list(enumerate(texts)))
        found = pii.bootstrap(docs.select("text"), common.staged(pii.scan(docs), "seen"), support, threshold)
        got = {r.value: r.kind for r in found.collect()}
        assert got == brute_discovery(texts, support, threshold) and got


def test_pii_of_one_long_text(spark):
    """Two hundred thousand identifier words in one text, with spans among them."""
    text = " ".join(f"w{i}" if i % 10 else f"u{i}@ex.org" for i in range(200_000))
    row = pii.scan(frame(spark, [(1, text)])).select(F.size("base").alias("base"), F.size("others").alias("others"), F.element_at("others", -1)["end"].alias("end")).first()
    assert (row.base, row.others, row.end) == (20_000, 180_000, len(text))


def test_pii_discovers_each_kind(spark):
    """Contexts on one-line prose, after a full stop, and of words beyond 60 characters."""
    long = "x" * 70
    cards = [n for n in range(4041894974600000, 4041894974600200) if luhn(str(n))][:20]
    kinds = {"email": ("for info. mail", [f"user{i}@ex.org" for i in range(20)], "user99@intranet"), "ip": ("on the host", [f"10.0.0.{i}" for i in range(20)], "fe80:77"), "card": ("pay my card number", cards, "4041-xx-77"), "phone": (f"please call {long} at", [f"+1 (988) 555-{1000 + i}" for i in range(20)], "555-0199")}
    rows, expected = [], {}
    for k, (context, values, unseen) in enumerate(kinds.values()):
        rows += [(100 * k + i, f"😀 {context} {v} right now") for i, v in enumerate(values)] + [(1000 + k, f"we {context} {unseen} again")]
        expected[1000 + k] = [(list(kinds)[k], unseen)]
    found = {r.doc_id: [(x.kind, x.value) for x in r.extra] for r in pii.find_pii(frame(spark, rows)).collect() if r.extra}
    assert found == expected


def test_pii_left_words_are_the_texts_own(spark):
    text = "Info. Mail a@b.co c@d.eu and-so on 4041894974608795 4041894974608795x"
    row = pii.find_pii(frame(spark, [(1, text)])).collect()[0]
    assert [(x.value, x.left) for x in row.base] == [("a@b.co", "info. mail"), ("c@d.eu", "mail a@b.co")] and "card" not in {x.kind for x in row.base}
    row = pii.find_pii(frame(spark, [(1, "and-so - on 4041894974608795 ends")])).collect()[0]
    assert [(x.kind, x.value, x.left) for x in row.base] == [("card", "4041894974608795", "- on")]


def test_pii_query_digest(spark, tmp_path):
    frame(spark, PII_ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    texts = dict(PII_ROWS)
    for r in queries.op3_pii(spark, str(tmp_path)).collect():
        joined = ",".join(brute_spans(texts[r.doc_id]))
        assert r.spans == joined and r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == (joined.count(",") + 1 if joined else 0)


def test_words_encode_as_whole_texts_do():
    from tokenizers import Tokenizer

    spec = open(queries.tokenizer_path()).read()
    own, plain = token_frames.Encoder(spec), Tokenizer.from_str(spec)
    assert own.by_word
    signs = [chr(c) for c in (*range(33, 0x3100), *range(0xFB00, 0xFFFE), *range(0x1F300, 0x1F700))]
    texts = [f"a{c}. b{c}c, {c}.,{c} {c}" for c in signs] + ["word”. x…, a—. 日本。. हिन्दी. İ. it's. <|ENDOFTEXT|>."]
    offsets = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    got = [np.frombuffer(x, own.dtype).tolist() for x in own.encode("".join(texts).encode(), offsets)]
    assert got == [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]


def test_plain_words_share_their_pieces():
    """Words that differ in case and signs alone take no ids of their own from the tokenizer, and are encoded as it does."""
    own = token_frames.Encoder(open(queries.tokenizer_path()).read())
    letters = [chr(c) for c in range(0x250) if chr(c).isalpha()]
    texts = [a + x for a in letters for x in ("", "s***", "'", "12")] + ["Zaqué*** (zaqué) it's $'s 's ''s x'll A.b-C_d KÅẞİ a\xad <|endoftext|>a <|ENDOFTEXT|>"]
    raw = [t.encode() for t in texts]
    assert own.encode(b"".join(raw), np.append(0, np.cumsum([len(t) for t in raw]))) == own.ids(texts)
    assert {"zaqué".encode(), b"***", b"'s", b"1"} <= own.known.keys()


def test_random_words_encode_as_whole_texts_do():
    """Capitals before combining marks: what NFC composes depends on the case."""
    import random
    import unicodedata

    from tokenizers import Tokenizer

    spec = open(queries.tokenizer_path()).read()
    own, plain, source = token_frames.Encoder(spec), Tokenizer.from_str(spec), random.Random(4)
    marks = [chr(c) for c in range(0x300, 0x370)]
    texts = ["J\u030c T\u0308 H\u0331 W\u030a Y\u030a", *(f"{chr(c)}{m} x{chr(c)}{m}. {chr(c + 32)}{m}y" for c in range(65, 91) for m in marks)]
    pool = [*map(chr, range(33, 127)), *marks, *"éÉßİıΣςǅﬁ\u00a0\u3000\u200d\u1e9e\u212a\u2126…—”日本हिंक्", *(unicodedata.normalize("NFD", c) for c in "ǰẗẖẘẙÅÉÑ")]
    texts += ["".join(source.choice(pool if source.random() < 0.8 else " \t\n") for _ in range(source.randint(1, 12))) for _ in range(100_000)]
    offsets = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    got = own.encode("".join(texts).encode(), offsets)
    wrong = [t for t, a, b in zip(texts, got, plain.encode_batch_fast(texts, add_special_tokens=False)) if a != np.array(b.ids, own.dtype).tobytes()]
    assert not wrong, [x.encode("unicode_escape") for x in wrong[:5]]


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    plain = Tokenizer.from_file(path)
    rows = odd_rows() + [(20, "Don't <|endoftext|> a<|EndOfText|>b ... it's,, x.,y \x1c\x85\xa0 ＡＢ１２ éÉ K İ ΣΑΣ."), (20, "twice"), (None, "no id")] + [(1000 + d, t) for d, t in documents(spark)]
    folder = f"file://{tmp_path}/tokens"
    manifest = token_frames.write_tokens(frame(spark, rows), path, folder=folder)
    got = [tuple(r) for r in token_frames.read_tokens(manifest).orderBy("start").collect()]
    expected, start = [], 0
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)))):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        expected.append((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert got == expected
    file = manifest.where("first_doc <= 1100 or first_doc is null").orderBy(F.desc("first_doc")).first().path
    assert token_frames.read_document(spark, file, 10**9) is None
    raw = open(file.removeprefix("file://"), "rb").read()
    assert raw[-4:] == struct.pack("<I", token_frames.SEEKABLE_MAGIC)
    reader = token_frames.Reader(__import__("pyarrow").memory_map(file.removeprefix("file://")))
    one = int(reader.ids[len(reader.ids) // 2])
    text = dict(rows)[one]
    assert token_frames.read_document(spark, file, one).tolist() == plain.encode(text or "", add_special_tokens=False).ids + [2]
    assert token_frames.encode_documents(frame(spark, []), path).count() == 0


def test_a_broken_frame_is_noticed(tmp_path):
    import pyarrow as pa

    with open(tmp_path / "x", "wb") as out:
        writer = token_frames.Writer(out)
        for i in range(10):
            writer.add(i, np.full(200_000, i, "<u2").tobytes(), 200_000)
        writer.close(2)
    raw = bytearray((tmp_path / "x").read_bytes())
    reader = token_frames.Reader(pa.BufferReader(bytes(raw)))
    assert len(reader.first) > 4 and (reader.document(7) == 7).all() and reader.document(99) is None
    raw[int(reader.starts[1]) + 20] ^= 255
    broken = token_frames.Reader(pa.BufferReader(bytes(raw)))
    assert (broken.document(0) == 0).all()
    with pytest.raises(Exception):
        broken.frame(1)


def test_other_tokenizers_take_whole_texts(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    own = token_frames.Encoder(open(path).read())
    assert not own.by_word
    text = "Hello  there\n twice".encode()
    assert own.encode(text, np.array([0, len(text)]))[0] == np.array(Tokenizer.from_file(path).encode(text.decode(), add_special_tokens=False).ids, own.dtype).tobytes()


def test_word_bounds():
    data = "ab c\td ".encode() + b"" + "é f".encode()
    starts, ends, bounds = common.word_bounds(np.frombuffer(data, np.uint8), np.array([0, 7, 7, len(data)]))
    assert [data[s:e].decode() for s, e in zip(starts, ends)] == ["ab", "c", "d", "é", "f"] and bounds.tolist() == [0, 3, 3, 5]
