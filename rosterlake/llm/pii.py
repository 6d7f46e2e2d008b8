"""Personal data by fixed patterns and bootstrapped contexts, with DataFrame operations only.

Base spans come from four patterns, each applied leftmost and non-overlapping. Java's matcher runs without recursion on
every input: separators that no match may contain are masked by another character of the same length first, so that a
run is one character class, and attempts start only at the start of a run or where the last match ended. Positions are
running sums of the lengths of matches and of the gaps that split() leaves between them.

Bootstrapping: base spans are seeds. Patterns are the two whole words before a value's words or the two after them.
Every round induces, for each kind, the patterns that enough distinct known values of it have, scores them by the
confidence of their values over all places in the corpus where another word stands next to the pattern, and scores
values (words with a digit or @) by noisy-or of the trusted patterns around them. Values that reach the threshold are
known from then on and induce patterns in the next round, until nothing grows any more. Those of the last round are spans of
their kind wherever they stand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

SPACE = r"\x20\x09-\x0D"
LOCAL = r"A-Za-z0-9._%+-"
KINDS = ("email", "ip", "card", "phone")
SPAN = "array<struct<start:int,end:int,value:string,left:string,right:string>>"
EXTRA = "array<struct<start:int,order:int,kind:string,end:int,value:string,left:string,right:string>>"
#: Distinct known values that a pattern needs, the score that makes a pattern trusted, and the one that makes a value known.
MIN_SUPPORT, TRUST, THRESHOLD = 5, 0.5, 0.9
#: Rounds end where confidences grow by less than this share, and no value or pattern is new.
SETTLED = 1e-3
#: Up to so many patterns are sent to every task; two words each, so a few megabytes.
SENT_PATTERNS = 50_000
#: Elements that a running sum takes at a time; private-use characters that stand for a blank or full stop, and for a hyphen.
CHUNK, MASK, MASK_2 = 128, "\ue000", "\ue001"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, zero: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """What combine (associative, zero neutral) makes of the values before each one.

    By chunks, then over the chunks' results: appending to one array would copy it for every element."""

    def before(own: Column) -> Column:
        return F.aggregate(own, F.array(zero), lambda acc, x: F.array_append(acc, combine(F.element_at(acc, -1), x)))

    def joined(parts: Column) -> Column:
        base = before(F.transform(parts, lambda x: F.element_at(x, -1)))
        return F.flatten(F.zip_with(parts, F.slice(base, F.lit(1), F.size(parts)), lambda own, b: F.transform(F.slice(own, F.lit(1), F.size(own) - 1), lambda x: combine(b, x))))

    def whole(own: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(1), F.size(own), F.lit(CHUNK)), lambda i: before(F.slice(own, i, F.lit(CHUNK))))
        return F.when(F.size(own) > 0, let(chunks, joined)).otherwise(F.array().cast("array<int>"))

    return let(values, whole)


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def blank(text: Column) -> Column:
    return F.rlike(text, F.lit(f"^[{SPACE}]?$"))


def outer_words(text: Column, last: bool) -> Column:
    """The two whole words that end (or begin) a text that stands before (or after) a span, lower-cased, or null.

    What is glued to the span is no word of its own. Sixty characters do where they hold four words, so that two are whole."""
    edge = F.right if last else F.left

    def found(t: Column) -> Column:
        return let(let(words(edge(t, F.lit(60))), lambda w: F.when((F.size(w) > 3) | (F.length(t) <= 60), w).otherwise(words(t))), lambda w: two(w, ~blank(edge(t, F.lit(1)))))

    def two(w: Column, glued: Column) -> Column:
        rest = F.size(w) - F.when(glued, 1).otherwise(0)
        own = F.slice(w, rest - 1, F.lit(2)) if last else F.slice(w, F.size(w) - rest + 1, F.lit(2))
        return F.when(rest >= 2, F.lower(F.array_join(own, " ")))

    return let(text, found)


def spans(text: Column, pattern: str, mask: tuple[str, str] = ("", "")) -> Column:
    """All matches in a text as structs of start, end (code points, end exclusive), value, left and right (two words each).

    mask: characters of the text that stand for others, and those. Words are looked for as far as the second match to
    each side, which bounds the work a match to its neighbourhood."""
    clear = (lambda x: F.translate(x, *mask)) if mask[0] else (lambda x: x)

    def build(m: Column) -> Column:
        """m: gaps, matches, starts."""
        n = F.size(m["matches"])
        gap = lambda i: F.coalesce(F.try_element_at(m["gaps"], i + 1), F.lit(""))
        match = lambda i: F.when((i >= 0) & (i < n), F.try_element_at(m["matches"], F.greatest(i, F.lit(0)) + 1)).otherwise("")

        def one(i: Column) -> Column:
            before = F.concat(F.when(i == 1, gap(F.lit(0))).otherwise(match(i - 2)), F.when(i > 1, gap(F.greatest(i - 1, F.lit(0)))).otherwise(""), match(i - 1), gap(i))
            after = F.concat(gap(i + 1), match(i + 1), gap(i + 2), match(i + 2))
            value = match(i)
            start = F.element_at(m["starts"], i + 1) + F.length(gap(i))
            return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), clear(value).alias("value"), outer_words(clear(before), True).alias("left"), outer_words(clear(after), False).alias("right"))

        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast(SPAN))

    pieces = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"))
    lengths = lambda x: F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["matches"])), x["matches"], lambda g, m: F.length(g) + F.length(m))
    located = lambda x: F.struct(x["gaps"].alias("gaps"), x["matches"].alias("matches"), running(lengths(x), F.lit(0), lambda a, b: a + b).alias("starts"))
    return let(let(pieces, located), build)


def where_any(test: Column, found: Column) -> Column:
    return F.when(test, found).otherwise(F.array().cast(SPAN))


def luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, d * 2).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), value), F.lit(0), lambda a, b: a + b) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Valid spans of each kind."""
    start = rf"(?:(?<![{MASK}{LOCAL}])|\G)"
    stops = F.regexp_replace(F.translate(text, MASK, MASK_2), r"\.(?![A-Za-z0-9-])", MASK)
    email = spans(stops, rf"{start}[{MASK}{LOCAL}]++@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", (MASK, "."))
    ip = spans(text, r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
    part = r"^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
    single = F.regexp_replace(F.regexp_replace(text, r"\x20(?![0-9])", MASK), "-(?![0-9])", MASK_2)
    card = spans(single, r"[0-9][0-9\x20-]+", (MASK + MASK_2, " -"))
    digits = lambda x: F.translate(x["value"], " -", "")
    phone = spans(text, r"\+[0-9][\x20().0-9-]+[0-9]")
    return {
        "email": where_any(F.contains(text, F.lit("@")), email),
        "ip": F.filter(where_any(F.rlike(text, F.lit(r"[0-9]\.[0-9]")), ip), lambda x: F.forall(F.split(x["value"], r"\."), lambda p: F.rlike(p, F.lit(part)))),
        "card": F.filter(where_any(F.rlike(text, F.lit(r"(?:[0-9][\x20-]?){11}[0-9]")), card), lambda x: F.length(digits(x)).between(12, 19) & F.when(F.length(digits(x)).between(12, 19), luhn(digits(x))).otherwise(False)),
        "phone": F.filter(where_any(F.contains(text, F.lit("+")), phone), lambda x: F.length(F.regexp_replace(x["value"], "[^0-9]", "")).between(9, 15)),
    }


def outside(base: Column, found: Column) -> Column:
    """Those of `found` that overlap none of base: in order of starts, no base before ends beyond, none after starts within."""
    far = F.lit(2**31 - 1)

    def marked(events: Column) -> Column:
        ends = running(F.transform(events, lambda e: F.when(e["word"], 0).otherwise(e["span"]["end"])), F.lit(0), lambda a, b: F.greatest(a, b))
        begins = F.reverse(running(F.reverse(F.transform(events, lambda e: F.when(e["word"], far).otherwise(e["start"]))), far, lambda a, b: F.least(a, b)))
        free = F.filter(F.arrays_zip(events.alias("e"), ends.alias("before"), begins.alias("after")), lambda x: x["e"]["word"] & (x["before"] <= x["e"]["start"]) & (x["after"] >= x["e"]["span"]["end"]))
        return F.transform(free, lambda x: x["e"]["span"])

    def event(word: bool) -> Callable[[Column], Column]:
        return lambda x: F.struct(x["start"].alias("start"), F.lit(word).alias("word"), F.struct(*[x[c].alias(c) for c in ("start", "end", "value", "left", "right")]).alias("span"))

    both = F.array_sort(F.concat(F.transform(base, event(False)), F.transform(found, event(True))))
    return F.when((F.size(base) > 0) & (F.size(found) > 0), let(both, marked)).otherwise(found)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), base (all valid spans with their kind), others (words with a digit or @ outside them)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.withColumns(base_spans(F.col("text")))

    def tagged(kind: str, order: int) -> Column:
        return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), *[x[c].alias(c) for c in ("end", "value", "left", "right")]))

    own = where_any(F.rlike("text", F.lit("[0-9@]")), spans(F.col("text"), rf"(?<![^{SPACE}])[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"))
    rows = rows.select("doc_id", "h", F.array_sort(F.concat(*(tagged(k, i) for i, k in enumerate(KINDS)))).alias("base"), own.alias("words"))
    return rows.select("doc_id", "h", "base", outside(F.col("base"), F.col("words")).alias("others"))


def pattern_totals(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """side, pair, total: how often each pair of words stands before another word (left) or behind one (right).

    Every pair of neighbouring words is probed against the patterns. Where they are too many to be sent to each task, pairs
    are counted before they are shuffled, so a frequent one is a row a task, not a row a place."""
    texts = docs.select(words(F.lower("text")).alias("words")).where(F.size("words") > 2)
    n = F.size("words") - 1
    pairs = texts.select(n.alias("n"), F.posexplode(F.arrays_zip(F.slice("words", F.lit(1), n).alias("one"), F.slice("words", F.lit(2), n).alias("two"))).alias("at", "pair"))
    pairs = pairs.select(F.concat_ws(" ", "pair.one", "pair.two").alias("pair"), (F.col("at") < F.col("n") - 1).cast("long").alias("left"), (F.col("at") > 0).cast("long").alias("right"))
    wanted, counts = patterns.select("pair").distinct(), [F.sum(c).alias(c) for c in ("left", "right")]
    if wanted.count() <= SENT_PATTERNS:
        sums = pairs.join(F.broadcast(wanted), "pair").groupBy("pair").agg(*counts)
    else:
        sums = pairs.groupBy("pair").agg(*counts).join(wanted, "pair")
    return sums.unpivot("pair", ["left", "right"], "side", "total").where("total > 0")


def grown(now: tuple[int, float, int], before: tuple[int, float, int]) -> bool:
    """Whether a round has found more known values or trusted patterns, or raised the confidences by SETTLED in all."""
    return now[0] > before[0] or now[2] > before[2] or now[1] > before[1] * (1 + SETTLED)


def bootstrap(docs: DataFrame, seen: DataFrame, min_support: int = MIN_SUPPORT, threshold: float = THRESHOLD) -> DataFrame | None:
    """value, kind of the identifiers that trusted patterns discover; None if there are none.

    A pattern's places in the corpus are counted when it could be trusted for the first time: when enough known values
    have it, and they are enough of the values (of any kind) it has, which are some of its places."""
    seeds = seen.select(F.explode("base").alias("x")).select("x.kind", "x.value", "x.left", "x.right")
    others = seen.select(F.explode("others").alias("x")).select(F.lit(None).cast("string").alias("kind"), "x.value", "x.left", "x.right")
    around = seeds.unionByName(others).unpivot(["kind", "value"], ["left", "right"], "side", "pair").where("pair is not null")
    edges = around.groupBy("side", "pair", "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    key = ["side", "pair"]
    edges = staged(edges, "edges")
    places = staged(edges.groupBy(*key).agg(F.sum("n").alias("places")), "places")
    sure = edges.where("kind is not null").withColumn("confidence", F.lit(1.0))
    unsure = edges.where("kind is null").drop("kind")
    totals, values, known = None, None, (0, 0.0, 0)
    while True:
        believed = sure if values is None else sure.unionByName(unsure.join(values, "value").select(*sure.columns))
        support = F.count_distinct(F.when(F.col("confidence") >= threshold, F.col("value"))).alias("support")
        patterns = believed.groupBy(*key, "kind").agg(support, F.sum(F.col("n") * F.col("confidence")).alias("weight"))
        patterns = patterns.where(F.col("support") >= min_support).groupBy(*key).agg(F.max_by(F.struct("kind", "weight"), F.struct("support", "kind")).alias("best"))
        patterns = staged(patterns.join(places, key).where(F.col("best.weight") >= TRUST * F.col("places")).select(*key, "best.kind", "best.weight"), "patterns")
        new = patterns if totals is None else patterns.join(totals, key, "left_anti")
        if not new.isEmpty():
            counted = pattern_totals(docs, new).join(new.select(*key), key, "left_semi")
            totals = staged(counted if totals is None else totals.unionByName(counted), "totals")
        elif totals is None:
            return None
        trusted = patterns.join(totals, key).select(*key, "kind", F.least(F.lit(0.999), F.col("weight") / F.col("total")).alias("score")).where(F.col("score") >= TRUST)
        values = staged(unsure.join(trusted, key).groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log1p(-F.col("score"))))).alias("confidence")), "values")
        sums = [F.count_if(F.col("confidence") >= threshold).alias("found"), F.sum("confidence").alias("total")]
        state = (*values.agg(*sums).first(), trusted.count())
        if not state[0]:
            return None
        if not grown(state, known):
            break
        known = state
    return values.where(F.col("confidence") >= threshold).groupBy("value").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))


def find_pii(docs: DataFrame, min_support: int = MIN_SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, base, extra per row: arrays of (start, order, kind, end, value, left, right), sorted by start.

    base are the four patterns' valid spans, extra those discovered in context; they never overlap a base span. Null
    and empty texts have none. Repeated rows give equal results each, and count each in the graph; rows that share a
    doc_id but not a text are told apart by the text. Null ids stay. Very long texts are scanned whole, without
    recursion, in time that grows with their length. Patterns and values that tie keep the last kind by name. Other
    columns, whatever their names, are ignored. An empty table gives an empty result. Contexts are followed over as many
    rounds as add values, patterns or confidence.
    """
    seen = staged(scan(docs), "spans")
    found = bootstrap(docs.select("text"), seen, min_support, threshold)
    none = F.array().cast(EXTRA)
    if found is None:
        return seen.select("doc_id", "base", none.alias("extra"))
    places = seen.select("doc_id", "h", F.explode("others").alias("x")).distinct().select("doc_id", "h", "x.*")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    extra = places.join(found, "value").groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("start", order.alias("order"), "kind", "end", "value", "left", "right"))).alias("extra"))
    joined = seen.alias("s").join(extra.alias("e"), F.expr("s.doc_id <=> e.doc_id and s.h = e.h"), "left")
    return joined.select("s.doc_id", "s.base", F.coalesce("e.extra", none).alias("extra"))


def count_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")


def listed(array: Column) -> Column:
    return F.array_join(F.transform(array, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
