"""Toxicity by a weighted lexicon.

Texts and lexicon are folded alike: compatibility forms, accents and case, look-alike letters of other scripts, digits or
signs in place of letters, doubled letters, and letters spelled one by one.
One Aho-Corasick automaton finds all entries, whole words and word beginnings, in one pass; hits inside an exception
phrase don't count. The sum of weights is normalised by the text's length and turned into a probability by a logistic
curve. Weights, exception phrases and curve are learned from labelled rows; a short fixed list serves without labels.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, slices, staged

# Letters of other scripts that look like Latin ones, and signs that stand for letters.
LOOK_ALIKE = dict(
    zip(
        "абвгеёзикмнорстухуѕіјԁԛԝьАВЕЗКМНОРСТУХЅІЈһѵԍӏαβεικνορτυχηωγΑΒΕΖΗΙΚΜΝΟΡΤΥΧոսօցհլվᏀᎠᎢᎪᎬᎷᏒᏚᏞᏟᏢᏴ",
        "abbreeeukmhopctyxysijdqwbabeekmhopctyxsijhvgiabeikvoptuxnwyabezhikmnoptyxnuoqhlvcdtaemrslcpb",
    )
)
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "$": "s", "@": "a", "|": "i", "!": "i", "l": "i", "L": "i", "€": "e", "£": "l"}
#: Between words, or at the end of one, where signs are no letters.
STOPS = "\"#%&'()*+,-./:;<=>?[\\]^_`{}~–—“”„«»…¿¡"
#: Letters with strokes, hooks or without dots, small capitals, and letters in circles or squares, by their names.
NAMED = re.compile(r"(?:LATIN (?:SMALL|CAPITAL) LETTER (?:DOTLESS |LONG |OPEN |TURNED |REVERSED )?([A-Z])(?: WITH .*)?|LATIN LETTER SMALL CAPITAL ([A-Z])|(?:NEGATIVE )?(?:CIRCLED|SQUARED) LATIN CAPITAL LETTER ([A-Z])|REGIONAL INDICATOR SYMBOL LETTER ([A-Z]))")


def letter(c: str) -> str | None:
    """The Latin letter that a character stands for, or None for those without a form (marks, joiners)."""
    plain = unicodedata.normalize("NFKD", c)
    out = "".join(LOOK_ALIKE.get(x, x) for x in plain if unicodedata.category(x) not in ("Mn", "Me", "Cf"))
    if len(out) == 1 and ord(out) > 127:
        named = NAMED.fullmatch(unicodedata.name(out, ""))
        out = next(x for x in named.groups() if x).lower() if named else out
    return "".join(LOOK_ALIKE.get(x, SIGNS.get(x, x)) for x in out.lower()) or None


class Folding(dict):
    """Code point -> what it counts as, found out when it is first met."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        found = " " if c in "\t\n\x0b\x0c\r " or c in STOPS or unicodedata.category(c)[0] == "Z" else letter(c)
        self[code] = found
        return found


FOLD = Folding()
#: Signs at the end of a word end it; letters spelled one by one are a word.
ENDING, SPELLED = re.compile(r"[!|$]+(?=[\s\"').,;:?!|$]|$)"), re.compile(r"(?<= )\w(?: \w){2,}(?= )")


def single(text: str) -> str:
    """Latin letters that follow themselves count once."""
    ascii = text.isascii()
    codes = np.frombuffer(text.encode("ascii" if ascii else "utf-32-le"), np.uint8 if ascii else "<u4")
    again = np.flatnonzero((codes[1:] == codes[:-1]) & (codes[1:] >= 97) & (codes[1:] <= 122))
    return np.delete(codes, again + 1).tobytes().decode("ascii" if ascii else "utf-32-le") if len(again) else text
#: Without labels: plain insults, all of one weight.
DEFAULT_LEXICON = {w: 5.0 for w in "idiot moron stupid loser scum worthless pathetic disgusting imbecile bastard".split()}
#: Without labels: harmless phrases around such words.
DEFAULT_EXCEPTIONS = ("trash can", "trash cans", "clown fish", "clown nose", "pond scum")
#: Letters of a word beginning.
PREFIX = 5


def fold(text: str) -> str:
    """Look-alikes by their letter, without accents and marks, in lower case; "i d i o t", "iidiot" and "id!ot" are one word."""
    out = f" {ENDING.sub(' ', text).translate(FOLD)} "
    return SPELLED.sub(lambda m: m[0].replace(" ", ""), single(out))


@dataclass(frozen=True)
class Model:
    """weights: ' word ' or ' beginn' to weight; exceptions: ' two words '; the curve's intercept and slope."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    intercept: float = -6.0
    slope: float = 2.0

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for phrase in self.exceptions:
            out.add_word(phrase, (len(phrase), 0.0))
        for entry, weight in self.weights.items():
            if entry not in self.exceptions:
                out.add_word(entry, (len(entry), weight))
        if len(out):
            out.make_automaton()
        return out


def default_model() -> Model:
    return Model({fold(w): x for w, x in DEFAULT_LEXICON.items()}, tuple(fold(p) for p in DEFAULT_EXCEPTIONS))


def strength(text: str, automaton: ahocorasick.Automaton) -> float:
    """log(1 + weight per thousand words), where each word counts with its heaviest entry."""
    folded = fold(text)
    words = folded.count(" ") - folded.count("  ")
    hits: dict[int, float] = {}
    exempt: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(folded) if len(automaton) else ():
        start = end + 1 - size
        if weight:
            hits[start] = max(hits.get(start, 0.0), weight)
        else:
            exempt.append((start, end))
    for start, end in exempt:
        for at in [x for x in hits if start <= x < end] if len(hits) < end - start else [x for x in range(start, end) if x in hits]:
            del hits[at]
    return math.log1p(1000 * sum(hits.values()) / (words + 20))


def probability(x: float, model: Model) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, model.intercept + model.slope * x))))


def score_task(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in slices(batches):
            scores = [probability(strength(t, automaton), model) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def keep_task(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in slices(batches):
            yield batch.filter(pa.array([probability(strength(t or "", automaton), model) < threshold for t in batch.column("text").to_pylist()]))

    return run


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose text scores below the threshold."""
    ship(docs.sparkSession)
    return docs.mapInArrow(keep_task(model, threshold), docs.schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every text, 0 to 1.

    Null and empty texts get the score of a text without hits. Repeated rows and null ids stay rows with equal scores
    for equal texts. Very long texts are scored whole. Other columns, whatever their names, are never read. An empty
    table gives an empty result.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(score_task(model), "doc_id long, score double")


def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled texts -> their distinct words, word beginnings and word pairs, with a sketch that near copies share."""
    for batch in slices(batches):
        keys, found = [], []
        for text in batch.column("text").to_pylist():
            words = fold(text).split()
            shingles = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
            keys.append(min(xxhash.xxh64_intdigest(s, 7) for s in shingles) >> 1)
            own = {f" {w} " for w in words} | {f" {w[:PREFIX]}" for w in words if len(w) > PREFIX} | {f" {a} {b} " for a, b in zip(words, words[1:])}
            found.append(sorted(own))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(keys, pa.int64()), pa.array(found, pa.list_(pa.string()))], ["doc_id", "toxic", "sketch", "entries"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, min_support: int = 10) -> Model:
    """Learn from at most `max_rows` labelled documents, chosen by a hash of doc_id; that bounds lexicon and exceptions too.

    labels: doc_id, toxic (null: no label; twice: the larger). Entries of documents that share a sketch (the
    least shingle hash) and a label count once, so a group of copies weighs like one text, and no row is left out. An entry's weight is its smoothed log odds, toxic against clean; kept are
    those in `min_support` toxic documents with odds of at least 8. Exceptions are word pairs that hold a kept word and
    were seen, three times or more, only in clean documents. Too few labels of either kind: the default model.
    """
    ship(docs.sparkSession)
    chosen = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most max_rows rows
    rows = staged(texts, "labelled")
    seen = rows.mapInArrow(entries, "doc_id long, toxic int, sketch long, entries array<string>")
    seen = seen.select("sketch", (F.col("toxic") > 0).cast("int").alias("t"), F.explode("entries").alias("entry")).distinct()
    one = staged(seen, "sample")
    size = {bool(r["t"]): r["n"] for r in one.groupBy("t").agg(F.count_distinct("sketch").alias("n")).collect()}
    bad, good = size.get(True, 0), size.get(False, 0)
    if bad < min_support or good < min_support:
        return default_model()
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    counts = (
        one.groupBy("entry")
        .agg(F.sum("t").alias("bad"), F.sum(1 - F.col("t")).alias("good"))
        .where(f"bad >= {int(min_support)} or (bad = 0 and good >= 3)")
        .select("entry", "bad", "good", odds.alias("weight"), F.size(F.split(F.trim("entry"), " ")).alias("words"))
    )
    counts = staged(counts, "counts")
    kept = counts.where((F.col("bad") >= min_support) & (F.col("words") == 1) & (F.col("weight") >= math.log(8))).select("entry", "weight")
    weights = {r["entry"]: round(r["weight"], 6) for r in kept.collect()}
    if not weights:
        return default_model()
    whole = kept.where(F.col("entry").endswith(" ")).select(F.trim("entry").alias("word"))
    pairs = counts.where((F.col("bad") == 0) & (F.col("words") == 2)).select("entry", F.explode(F.split(F.trim("entry"), " ")).alias("word"))
    held = pairs.join(whole, "word", "left_semi").select("entry").distinct()
    model = Model(weights, tuple(sorted(r["entry"] for r in held.collect())))
    return curve(rows, model)


def strengths(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([strength(t, automaton) for t in batch.column("text").to_pylist()], pa.float64())], ["toxic", "x"])

    return run


def curve(rows: DataFrame, model: Model, steps: int = 40, ridge: float = 1e-3) -> Model:
    """Intercept and slope by Newton's method on the labelled rows (two numbers each, at most max_rows of them)."""
    table = rows.mapInArrow(strengths(model), "toxic int, x double").toPandas()
    x = np.column_stack([np.ones(len(table)), table["x"].to_numpy()])
    y, w = (table["toxic"].to_numpy() > 0).astype(float), np.array([-4.0, 1.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (p - y) / len(y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(2)
        w = w - np.linalg.solve(hessian, gradient)
    if w[1] <= 0:
        return model
    return Model(model.weights, model.exceptions, float(w[0]), float(w[1]))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text divides by five."""
    return F.crc32(doc_id.cast("string")) % 5 == 0
