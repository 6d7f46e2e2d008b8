"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, a run of numbers or of names one placeholder; five-word windows of
the templates are hash-joined with the benchmark's; of every document and item that may share enough of them, one chain
of windows is sought that stands in the same order in both, and slots are checked over the whole chain: equal words in
the item's slots must stand for equal words in the document's.

Words lose leading and trailing ASCII punctuation and their case. A word with a digit and a number word are numbers, and
count by their value: 1,200 is 1200, twenty-one and "twenty one" are 21; one of UNITS is a unit; one with a capital first
letter of any script that doesn't begin a sentence or line is a name.

Items whose templates have the same tokens and the same equal slots hold each other by definition: they are one class, and
one of them, its head, is sought for all. The others are sought by their own words alone.

The join is exact and free of common windows: a document that holds `similarity` of an item's n windows holds one of any
n - ceil(similarity * n) + 1 of them, so only an item's rarest that many are joined. Rareness is counted over all documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_BASE, mixed, prefix_sums, ship, slices, span_hashes, staged, text_buffers, word_bounds, word_hashes

# Units of measure and money that templates treat alike, and number words ("one" is mostly a pronoun).
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons tonne tonnes ounce ounces pound pounds "
    "ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month "
    "months year years cent cents dollar dollars euro euros percent degree degrees kmh mph watt watts volt volts"
).split()
NUMBER_WORDS = {
    "zero": 0, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17,
    "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100, "thousand": 1000, "million": 1000000,
}
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBER_WORDS |= {f"{ten}-{word}": NUMBER_WORDS[ten] + i + 1 for ten in TENS for i, word in enumerate("one two three four five six seven eight nine".split())}
LITERAL, NUMBER, NAME, UNIT = range(4)
#: By code point: the lower-case letter, where both take two bytes in UTF-8; and whether it is a capital.
LOWER = np.array([ord(c.lower()) if c >= "\x80" and len(c.lower()) == 1 and "\x80" <= c.lower() < "\u0800" else ord(c) for c in map(chr, range(0x800))], np.uint16)
CAPITAL = np.array([chr(c).isupper() or chr(c).istitle() for c in range(0x10000)])
GROUPED = re.compile(rb"[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?")
PLACEHOLDERS = mixed(np.array([10, 11, 12, 13], np.uint64))
#: Benchmarks of at most so many windows are also sent to every task, to drop windows before the join (8 bytes each).
PREFILTER_LIMIT = 2_000_000
#: Items of one document that are checked together.
ITEMS_AT_ONCE = 100
RESULT = "doc_id long, item_id long, start int, n_windows int, n_matched int, n_exact int"


def plain_hash(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return word_hashes(data, np.append(0, ends[:-1]), ends)


COUNTED = list(NUMBER_WORDS.values())
SPOKEN = plain_hash(list(NUMBER_WORDS)), plain_hash([str(n) for n in COUNTED])


@dataclass
class Texts:
    """Words and template tokens of some texts. A token is a word, or a run of numbers or names."""

    own: np.ndarray  # hash of each word, as it counts in plain windows
    words: np.ndarray  # n+1 first-word numbers of the texts
    shape: np.ndarray  # hash of each token in the template
    value: np.ndarray  # hash of what stands in the token
    slot: np.ndarray  # whether the token is a placeholder
    first: np.ndarray  # first word of each token
    tokens: np.ndarray  # n+1 first-token numbers of the texts


def first_letters(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points that begin at some bytes; 0 beyond the basic plane."""
    b0, b1, b2 = (data[np.minimum(at + i, len(data) - 1)].astype(np.int64) for i in range(3))
    two, three = (b0 & 0x1F) << 6 | b1 & 0x3F, (b0 & 0xF) << 12 | (b1 & 0x3F) << 6 | b2 & 0x3F
    return np.where(b0 < 0x80, b0, np.where(b0 & 0xE0 == 0xC0, two, np.where(b0 & 0xF0 == 0xE0, three, 0)))


def spoken_number(parts: list[int]) -> int | None:
    """The value of numbers that follow each other as one numeral (two hundred fifty, 3 million), None where they don't."""
    total, group, least = 0, 0, 10**9  # least: what the next part has to stay below, inside a group
    scale = 10**12
    for i, n in enumerate(parts):
        if n == 100 and 0 < group < 100 and i:
            group, least = group * 100, 100
        elif n in (1000, 1000000) and i and 0 < group < 1000 and n < scale:
            total, group, least, scale = total + group * n, 0, 10**9, n
        elif n < least and (n < 1000 if not i or total else n < 100) and not (group and n == 0):
            group, least = group + n, 10 if 20 <= n < 100 and n % 10 == 0 else 0
        else:
            return None
    return total + group


def read(data: np.ndarray, offsets: np.ndarray) -> Texts:
    starts, ends, bounds = word_bounds(data, offsets)
    if not len(starts):
        none = np.zeros(0, np.uint64)
        return Texts(none, bounds, none, none, np.zeros(0, bool), np.zeros(0, np.int64), bounds)
    lower = data.copy()
    lower[(data >= 65) & (data <= 90)] += 32
    lead = np.flatnonzero(data & 0xE0 == 0xC0)
    small = LOWER[(data[lead].astype(np.int64) & 0x1F) << 6 | data[lead + 1] & 0x3F]
    lower[lead], lower[lead + 1] = 0xC0 | small >> 6, 0x80 | small & 0x3F
    kind = np.zeros(256, np.uint8)
    kind[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
    punctuation = kind[data] == 1
    a, b = starts.copy(), ends.copy()
    while len(more := np.flatnonzero((b - a > 1) & punctuation[b - 1])):
        b[more] -= 1
    while len(more := np.flatnonzero((b - a > 1) & punctuation[a])):
        a[more] += 1
    digits = np.append(0, np.cumsum((data >= 48) & (data <= 57)))
    breaks = np.append(0, np.cumsum(data == 10))
    opens = np.ones(len(a), bool)
    stop = np.isin(data[ends - 1], np.frombuffer(b".!?:", np.uint8))
    opens[1:] = stop[:-1] | (breaks[starts[1:]] > breaks[ends[:-1]])
    opens[bounds[:-1][bounds[:-1] < len(a)]] = True
    capital = CAPITAL[first_letters(data, a)]
    own = word_hashes(lower, a, b)
    spoken, figures = SPOKEN
    order = np.argsort(spoken)
    place = order[np.minimum(np.searchsorted(spoken[order], own), len(order) - 1)]
    in_words = spoken[place] == own
    kinds = np.full(len(own), LITERAL)
    kinds[capital & ~opens] = NAME
    kinds[np.isin(own, plain_hash(UNITS))] = UNIT
    kinds[(digits[b] > digits[a]) | in_words] = NUMBER
    value = np.where(in_words, figures[place], own)
    commas = np.append(0, np.cumsum(data == 44))
    grouped = [i for i in np.flatnonzero((commas[b] > commas[a]) & (digits[b] > digits[a])) if GROUPED.fullmatch(data[a[i] : b[i]].tobytes())]
    if grouped:
        value[grouped] = plain_hash([data[a[i] : b[i]].tobytes().replace(b",", b"").decode() for i in grouped])
    begins = np.ones(len(own), bool)
    begins[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == LITERAL) | (kinds[1:] == UNIT)
    begins[bounds[:-1][bounds[:-1] < len(own)]] = True
    first = np.flatnonzero(begins)
    slot = kinds[first] != LITERAL
    after = np.append(first[1:], len(own))
    runs = span_hashes(prefix_sums(value, WORD_BASE), first, after, WORD_BASE)
    # Runs that are one numeral count by its value. Punctuation between two numbers parts them.
    numerals = {}
    for j in np.flatnonzero((kinds[first] == NUMBER) & (after - first > 1) & (np.add.reduceat(in_words, first) > 0)):
        at = range(first[j], min(after[j], first[j] + 12))
        texts = [data[a[i] : b[i]].tobytes() for i in at]
        if after[j] - first[j] <= 12 and all(ends[i] == b[i] for i in at[:-1]) and all(w or t.isdigit() for w, t in zip(in_words[first[j] : after[j]], texts)):
            number = spoken_number([COUNTED[place[i]] if in_words[i] else int(t) for i, t in zip(at, texts)])
            if number is not None:
                numerals[j] = number
    if numerals:
        runs[list(numerals)] = mixed(plain_hash([str(n) for n in numerals.values()]))
    return Texts(own, bounds, np.where(slot, PLACEHOLDERS[kinds[first]], own[first]), runs, slot, first, np.searchsorted(first, bounds))


def window_keys(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` neighbours."""
    n = max(0, len(hashes) - width + 1)
    at = np.arange(n)
    return span_hashes(prefix_sums(hashes, WORD_BASE), at, at + width, WORD_BASE)


class Item:
    """A benchmark item's windows, in order: word where it begins, hash of its words, hash of its template (0: none)."""

    def __init__(self, text: str, width: int, literals: int):
        raw = np.frombuffer(text.encode(), np.uint8)
        t = read(raw, np.array([0, len(raw)]))
        self.texts, self.width = t, min(width, len(t.own))
        self.begin, self.plain, self.typed, self.token = (np.zeros(0, x) for x in (np.int64, np.uint64, np.uint64, np.int64))
        if not len(t.own):
            return
        plain, typed = window_keys(t.own, self.width), window_keys(t.shape, self.width)
        telling = np.zeros(0, np.int64)
        if len(typed):
            before = np.append(0, np.cumsum(~t.slot))
            telling = np.flatnonzero(before[self.width :] - before[: len(typed)] >= literals)
        if len(telling):
            self.token, self.begin, self.typed = telling, t.first[telling], typed[telling]
        else:
            self.begin = np.arange(len(plain))
            self.token, self.typed = np.full(len(plain), -1), np.zeros(len(plain), np.uint64)
        self.plain = plain[self.begin]

    def slots(self, i: int) -> np.ndarray:
        """Numbers of the placeholder tokens of window i."""
        at = self.token[i]
        return at + np.flatnonzero(self.texts.slot[at : at + self.width]) if at >= 0 else np.zeros(0, np.int64)


class Places:
    """Where a document's windows stand, by hash."""

    def __init__(self, keys: np.ndarray, places: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.places = keys[order], places[order]

    def of(self, keys: np.ndarray) -> list[np.ndarray]:
        """Ascending places of each key."""
        low, high = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, "right")
        return [self.places[a:b] for a, b in zip(low, high)]


class Document:
    """One text of a batch."""

    def __init__(self, t: Texts, i: int):
        a, b, c, d = t.words[i], t.words[i + 1], t.tokens[i], t.tokens[i + 1]
        self.own, self.shape, self.value, self.first = t.own[a:b], t.shape[c:d], t.value[c:d], t.first[c:d] - a
        self.known: dict[tuple[bool, int], Places] = {}

    def places(self, keys: np.ndarray, width: int, plain: bool) -> list[np.ndarray]:
        if (plain, width) not in self.known:
            found = window_keys(self.own if plain else self.shape, width)
            self.known[plain, width] = Places(found, np.arange(len(found)) if plain else self.first[: len(found)])
        return self.known[plain, width].of(keys)


NEVER = np.iinfo(np.int64).max


def first_after(places: list[np.ndarray], limits: np.ndarray) -> np.ndarray:
    """For each limit the smallest place beyond it, or NEVER."""
    out = np.full(len(limits), NEVER)
    for own in places:
        if len(own):
            at = np.searchsorted(own, limits, "right")
            out = np.minimum(out, np.where(at < len(own), own[np.minimum(at, len(own) - 1)], NEVER))
    return out


def earliest_end(places: list[list[np.ndarray]], after: int) -> tuple[int, int]:
    """Length of the longest chain of windows in order beyond `after`, and the least place where one ends.

    tails[k] is the least place where a chain of k + 1 windows ends; a window extends every chain once."""
    tails = np.zeros(0, np.int64)
    for own in places:
        tails = np.minimum(np.append(tails, NEVER), first_after(own, np.append(after, tails)))
        if tails[-1] == NEVER:
            tails = tails[:-1]
    return len(tails), int(tails[-1]) if len(tails) else after


def latest_start(places: list[list[np.ndarray]], after: int, until: int) -> list[tuple[int, int]]:
    """The longest chain between the two places that starts last: (window, place), by the same steps from the end."""
    heads, node, nodes = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    for i in range(len(places) - 1, -1, -1):
        back = [-own[(own > after) & (own <= until)][::-1] for own in places[i]]
        found = first_after(back, np.append(-until - 1, heads))
        better = np.flatnonzero(found < np.append(heads, NEVER))
        if not len(better):
            continue
        parents = np.append(-1, node)[better]
        heads, node = np.append(heads, NEVER), np.append(node, -1)
        heads[better] = found[better]
        node[better] = len(nodes) + np.arange(len(better))
        nodes += [(i, -int(x), int(p)) for x, p in zip(found[better], parents)]
        if heads[-1] == NEVER:
            heads, node = heads[:-1], node[:-1]
    chain, at = [], int(node[-1]) if len(node) else -1
    while at >= 0:
        i, place, at = nodes[at]
        chain.append((i, place))
    return chain


def consistent(item: Item, doc: Document, chain: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], int]:
    """The windows of a chain whose slots agree with the chain, and how many stand there with the item's own words."""
    plain = window_keys_at(doc.own, np.array([x for _, x in chain]), item.width) == item.plain[[i for i, _ in chain]]
    readings: dict[int, dict[int, set[int]]] = {}
    said: list[list[tuple[int, int]]] = []
    for (i, place), same in zip(chain, plain):
        own, token = [], int(np.searchsorted(doc.first, place))
        for s in item.slots(i).tolist():
            word = int(item.texts.value[s])
            if same:
                if item.texts.first[s] >= item.begin[i] + item.width:
                    continue
                other = word
            else:
                other = int(doc.value[token + s - item.token[i]])
            readings.setdefault(word, {}).setdefault(other, set()).add(s)
            own.append((word, other))
        said.append(own)
    winner = {}
    for word, others in readings.items():
        most = max(map(len, others.values()))
        best = [x for x, where in others.items() if len(where) == most]
        winner[word] = best[0] if len(best) == 1 else None
    good = [k for k, own in enumerate(said) if all(winner[w] == x for w, x in own)]
    return [chain[k] for k in good], int(plain[good].sum())


def window_keys_at(hashes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    fits = at + width <= len(hashes)
    spans = hashes[at[fits][:, None] + np.arange(width)] if fits.any() else np.zeros((0, width), np.uint64)
    sums = prefix_sums(spans.ravel(), WORD_BASE)
    begin = np.arange(len(spans)) * width
    out[fits] = span_hashes(sums, begin, begin + width, WORD_BASE)
    return out


def needed(n: int, similarity: float) -> int:
    return max(1, math.ceil(similarity * n - 1e-9))


def align(item: Item, doc: Document, similarity: float) -> tuple[int, int, int] | None:
    """(start, matched windows, those with the item's own words) of the first chain that reaches the similarity."""
    n = len(item.plain)
    typed = doc.places(item.typed, item.width, False) if (item.token >= 0).any() else [np.zeros(0, np.int64)] * n
    places = [list(x) for x in zip(doc.places(item.plain, item.width, True), typed)]
    need, after = needed(n, similarity), -1
    if sum(any(map(len, x)) for x in places) < need:
        return None
    while True:
        length, end = earliest_end(places, after)
        if length < need:
            return None
        chain = latest_start(places, after, end)
        good, exact = consistent(item, doc, chain)
        if len(good) >= need:
            return int(good[0][1] - item.begin[good[0][0]]), len(good), exact
        after = end


def held_keys(widths: tuple[int, ...], keys: np.ndarray | None):
    """Texts -> the distinct hashes of their typed and plain windows; with keys, only those among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = None
        if keys is not None:
            some = np.zeros(1 << 20, bool)
            some[keys >> np.uint64(44)] = True
        for batch in slices(batches):
            t = read(*text_buffers(batch.column("text")))
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            found = []
            for hashes, bounds in ((t.own, t.words), (t.shape, t.tokens)):
                doc = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
                for width in widths:
                    key = window_keys(hashes, width)
                    at = np.flatnonzero(np.arange(len(key)) + width <= bounds[1:][doc[: len(key)]])
                    key = key[at]
                    if keys is not None:
                        hit = np.flatnonzero(some[key >> np.uint64(44)])
                        place = np.minimum(np.searchsorted(keys, key[hit]), len(keys) - 1)
                        hit = hit[keys[place] == key[hit]]
                        at, key = at[hit], key[hit]
                    found.append(np.unique(np.stack([doc[at].astype(np.uint64), key], axis=1), axis=0))
            rows = np.unique(np.concatenate(found), axis=0)
            for part in np.array_split(rows, len(rows) // 100_000 + 1):
                yield pa.RecordBatch.from_arrays([ids[part[:, 0].astype(np.int64)], part[:, 1].copy().view(np.int64)], ["id", "key"])

    return run


def template_key(item: Item) -> bytes | None:
    """What items of one class share: their template's tokens, and which of its slots are equal; None without telling windows."""
    if not (item.token >= 0).any():
        return None
    values = item.texts.value[item.texts.slot]
    _, first, which = np.unique(values, return_index=True, return_inverse=True)
    return xxhash.xxh3_128_digest(item.texts.shape.tobytes() + first[which].astype(np.int64).tobytes())


def templates(width: int, literals: int):
    """Items -> with template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [template_key(Item(text, width, literals)) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("item_id", "rep", "text")), pa.array(keys, pa.binary())], ["item_id", "rep", "text", "template"])

    return run


def windows_of_items(width: int, literals: int):
    """Items -> (item_id, pos, n, width, key) of their windows: one row for the plain and, of heads, one for the typed hash of
    each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item_id, text, head in zip(*(batch.column(c).to_pylist() for c in ("item_id", "text", "head"))):
                item = Item(text, width, literals)
                n, typed = len(item.plain), np.flatnonzero((item.token >= 0) & head)
                pos, key = np.append(np.arange(n), typed), np.append(item.plain, item.typed[typed])
                yield pa.RecordBatch.from_arrays([np.full(len(pos), item_id, np.int64), pos.astype(np.int32), np.full(len(pos), n, np.int32), np.full(len(pos), item.width, np.int32), key.view(np.int64)], ["item_id", "pos", "n", "width", "key"])

    return run


def check(width: int, literals: int, similarity: float):
    """Documents with candidate items -> the items they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            t, out = read(*text_buffers(batch.column("text"))), []
            for i, (doc_id, items) in enumerate(zip(batch.column("id").to_pylist(), batch.column("items").to_pylist())):
                doc = Document(t, i)
                for x in items:
                    item = Item(x["text"], width, literals)
                    if not x["head"]:
                        item.token[:] = -1  # its head is sought by the template
                    found = align(item, doc, similarity)
                    if found:
                        out.append((doc_id, x["item_id"], found[0], len(item.plain), *found[1:]))
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out) if out else [[]] * 6, types)], [c.split()[0] for c in RESULT.split(", ")])

    return run


def with_heads(one: DataFrame, named: DataFrame, width: int, literals: int) -> DataFrame:
    """one (item_id, rep, text) with head, whether it stands for its class, and n_items, the item_ids of the class (1 for others)."""
    typed = staged(one.mapInArrow(templates(width, literals), "item_id long, rep long, text string, template binary"), "templates")
    sizes = typed.where("template is not null").join(named.groupBy("text").agg(F.count_distinct("item_id").alias("ids")), "text")
    classes = staged(sizes.groupBy("template").agg(F.min(F.struct("rep", "item_id")).alias("first"), F.sum("ids").alias("n")), "classes")
    rows = typed.join(classes, "template", "left").withColumn("head", F.coalesce(F.col("first.item_id") == F.col("item_id"), F.lit(True)))
    return staged(rows.select("item_id", "text", "head", F.when(F.col("head"), F.coalesce("n", F.lit(1))).otherwise(1).cast("long").alias("n_items")), "texts")


def class_of(items: DataFrame, width: int = 5, literals: int = 3) -> DataFrame:
    """item_id, head_id: of every item the smallest item_id of its class, its own where it has no telling window."""
    ship(items.sparkSession)
    named = items.select(F.col("item_id").cast("long"), F.col("item_id").cast("long").alias("rep"), "text").where("item_id is not null and text is not null").distinct()
    typed = staged(named.mapInArrow(templates(width, literals), "item_id long, rep long, text string, template binary"), "templates")
    heads = typed.where("template is not null").groupBy("template").agg(F.min("item_id").alias("head_id"))
    return typed.join(heads, "template", "left").select("item_id", F.coalesce("head_id", "item_id").alias("head_id"))


def contaminated(docs: DataFrame, items: DataFrame, width: int = 5, similarity: float = 0.8, literals: int = 3) -> DataFrame:
    """doc_id, item_id, start, n_windows, n_matched, containment, kind, n_items: the items that documents hold.

    An item's windows are those of `width` template tokens with `literals` literal words or more; an item without any is
    matched word for word by all its windows; one of fewer than `width` words is one window. A window is matched by its
    template, or by its plain words but for case and outer punctuation, whatever their line breaks and capitals.

    A chain is a longest series of an item's windows that the document holds in the same order, with anything between
    them. Of those that end first the one that starts last is checked: where one word of the item stands for different
    words of the document, windows in which it stands for another than at most of its places don't count, and if two are
    equally frequent, none of its windows does. If `similarity` of the windows count, the item is there: start is the
    document's word where it would begin, kind 'exact' if all that count stand there in the item's own words, else
    'reparameterised'. Otherwise the search goes on behind the chain.

    Items of one class have one row by their template: that of the head, the class's smallest item_id; n_items is the number
    of item_ids in the class. A member whose own words the document holds has a row of its own besides, of kind 'exact' and
    with n_items 1. class_of tells the members. So many items of one template don't multiply the rows.

    Null items and null or empty texts match nothing; rows without a doc_id or item_id take no part. Repeated rows of a
    document or item give one result row, that of most matches. Very long texts are handled alone, whole. Other columns,
    whatever their names, are ignored. Empty tables give an empty result. Benchmarks beyond PREFILTER_LIMIT windows are
    joined with all windows of the documents instead of those among the benchmark's, with the same result.
    """
    spark = docs.sparkSession
    ship(spark)
    named = items.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null").distinct()
    named = staged(named.withColumn("rep", F.min("item_id").over(Window.partitionBy("text"))), "items")
    one = named.where("item_id = rep").select("item_id", "rep", "text").distinct()
    # An item_id with several texts has them told apart by their hash.
    unlike = Window.partitionBy("item_id").orderBy("text")
    one = one.withColumn("item_id", F.when(F.count(F.lit(1)).over(Window.partitionBy("item_id")) == 1, F.xxhash64("item_id")).otherwise(F.xxhash64("item_id", F.row_number().over(unlike))))
    one = with_heads(one, named, width, literals)
    targets = staged(one.mapInArrow(windows_of_items(width, literals), "item_id long, pos int, n int, width int, key long"), "targets")
    widths = tuple(sorted(r[0] for r in targets.select("width").distinct().collect()))  # at most `width` numbers
    known = targets.select("key").distinct().limit(PREFILTER_LIMIT + 1).toPandas()["key"].to_numpy(np.int64)
    keys = np.sort(known.view(np.uint64)) if len(known) <= PREFILTER_LIMIT else None
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null and text is not null")
    if not widths:
        texts = texts.where(F.lit(False))
    hits = texts.mapInArrow(held_keys(widths, keys), "id long, key long")
    if keys is None:
        hits = hits.join(targets.select("key").distinct(), "key", "left_semi")
    hits = staged(hits.distinct(), "hits")
    counts = hits.groupBy("key").agg(F.count(F.lit(1)).alias("docs"))
    places = targets.join(counts, "key", "left").groupBy("item_id", "pos", "n").agg(F.sum(F.coalesce("docs", F.lit(0))).alias("docs"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("docs", "pos"))
    spare = F.col("n") - F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(similarity) - 1e-9)) + 1
    rarest = places.withColumn("rank", rank).where((F.col("rank") <= spare) & (F.col("docs") > 0)).select("item_id", "pos")
    rarest = staged(targets.join(rarest, ["item_id", "pos"]).select("item_id", "key").distinct(), "rarest")
    pairs = staged(hits.join(rarest, "key").select("id", "item_id").distinct(), "pairs")
    chunks = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("id")) / ITEMS_AT_ONCE)
    asked = pairs.withColumn("chunk", F.pmod(F.xxhash64("item_id"), chunks)).join(one, "item_id").groupBy("id", "chunk").agg(F.collect_list(F.struct("item_id", "text", "head")).alias("items"))
    found = staged(texts.join(staged(asked.select("id", "items"), "asked"), "id").mapInArrow(check(width, literals, similarity), RESULT), "found")
    # Back to all items of each text.
    plain = one.select(F.col("item_id").alias("own"), "text", "n_items")
    members = named.join(plain, "text").select("own", "item_id", "n_items")
    full = found.withColumnRenamed("item_id", "own").join(members, "own")
    best = F.max(F.struct("n_matched", "n_exact", (-F.col("start")).alias("back"), "n_windows", "n_items")).alias("best")
    rows = full.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("best.back")).alias("start"), "best.n_windows", "best.n_matched", "best.n_exact", "best.n_items")
    kind = F.when(F.col("n_exact") == F.col("n_matched"), "exact").otherwise("reparameterised")
    return rows.select("doc_id", "item_id", "start", "n_windows", "n_matched", (F.col("n_matched") / F.col("n_windows")).alias("containment"), kind.alias("kind"), "n_items")

