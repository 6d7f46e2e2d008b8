"""Token ids in seekable binary files.

A file is a sequence of independent zstandard frames, each of whole documents, then one frame with the directory
(doc ids, their null flags, ids per document, documents per frame), then a skippable frame with the seek table of the
public zstd seekable format: per frame its compressed size, decompressed size and XXH64 checksum (low 32 bits), then
the number of frames, a descriptor with the checksum flag, and the magic number. A reader loads the table from the
file's end, then the directory, and decompresses only the frames of the documents it was asked for.

Documents are in ascending doc_id order inside and across files. Executors write through the file system of the
folder's URI; an attempt writes its own file and only files named by a finished task are in the manifest, so a lost
executor leaves at most a file nobody reads.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, ship, slices, staged, text_buffers

# Fixed values of the zstd seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80
#: Decompressed bytes of a frame, unless one document has more; zstd level; words whose ids a worker keeps (about 150 bytes each).
FRAME_BYTES, LEVEL, CACHE_WORDS = 1 << 20, 3, 1_000_000
#: Letters that are as they are in NFC; words of them and of ASCII are parted here as the tokenizer parts them, if its pattern is SPLIT.
LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha())
PLAIN = re.compile(f"[{LETTERS}!-~]*")
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECES = re.compile(SPLIT.replace(r"\p{L}", LETTERS).replace(r"\p{N}", "0-9"))
#: Characters that stand for the bytes, given as Latin-1, in byte-level vocabularies.
BYTE_LEVEL = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}
MANIFEST = "path string, part int, first_doc long, n_docs long, n_tokens long"
ENCODERS: dict[int, Encoder] = {}


def ends_plain(core: bytes) -> bool:
    """Whether the tokenizer parts what follows: the last character, as it is normalised, is a letter or a number."""
    if core and core[-1] > 127:
        return unicodedata.normalize("NFC", core.decode()).lower()[-1:].isalnum()
    return core[-1:].isalnum()


class Encoder:
    """Texts to little-endian ids. Where the tokenizer drops white space and never joins across it, words are encoded
    once and kept, because their ids don't depend on what stands around them."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        parts = json.loads(spec)
        normal, split = parts.get("normalizer") or {}, (parts.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        replaces = [x for x in normal.get("normalizers", []) if x["type"] == "Replace"]
        self.added = [x["content"].encode() for x in parts["added_tokens"]]
        self.special = re.compile(b"|".join(map(re.escape, self.added)) or b"(?!)")
        self.by_word = bool(
            self.added and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in parts["added_tokens"])
            and any(x["pattern"] == {"Regex": "\\s+"} and x["content"] == " " for x in replaces) and any(x["type"] == "Lowercase" for x in normal["normalizers"])
            and split.get("type") == "Split" and split.get("invert") and split.get("behavior") == "Removed" and parts["model"].get("end_of_word_suffix")
        )
        model, last = parts["model"], (parts.get("pre_tokenizer") or {}).get("pretokenizers", [])[1:]
        self.plain = bool(
            self.by_word and split["pattern"] == {"Regex": SPLIT} and [(x["type"], x["add_prefix_space"], x["use_regex"]) for x in last if x["type"] == "ByteLevel"] == [("ByteLevel", False, False)] and len(last) == 1
            and [x["type"] for x in normal["normalizers"]] == ["NFC", "Replace", "Lowercase"] and model["type"] == "BPE" and not model.get("dropout") and all(x == x.lower() for x in self.added)
        )
        self.known: dict[bytes, bytes] = {b"": b""}
        self.older: dict[bytes, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def recall(self, words: set[bytes]) -> list[bytes]:
        """Bring words back from the older half of the cache; returns those it doesn't hold."""
        known, older, new = self.known, self.older, []
        for w in words:
            ids = older.get(w)
            if ids is None:
                new.append(w)
            else:
                known[w] = ids
        return new

    def learn(self, words: set[bytes]) -> None:
        """Have the ids of all words in known. New ones that are plain are parted here, and each piece goes to the tokenizer's
        model once; others are encoded many at a time, parted by an added token, without case and closing stops."""
        known, pairs, whole, plain = self.known, {}, [], {}
        for w in self.recall(words - known.keys()):
            # Case goes before the tokenizer's NFC only where it can't change what NFC composes: J and a caron compose as j, not as J.
            small = w.lower()
            if self.special.search(small):
                known[w] = self.ids([w.decode()])[0]
                continue
            if self.plain and PLAIN.fullmatch(text := w.decode().lower()):
                plain[w] = [x.encode() for x in PIECES.findall(text)]
                continue
            low = small if w.isascii() else w
            if low == w and w[-1] not in b".,":
                whole.append(w)
                continue
            core = low.rstrip(b".,")
            pairs[w] = (core, low[len(core) :]) if len(core) < len(low) and ends_plain(core) else (low, b"")
        self.learn_pieces(self.recall(set().union(*plain.values()) - known.keys()))
        for w, pieces in plain.items():
            known[w] = b"".join([known[x] for x in pieces])
        new = whole + self.recall({x for pair in pairs.values() for x in pair} - known.keys() - set(whole))
        mark = self.added[-1].decode()
        mark_id = self.tokenizer.token_to_id(mark)
        for at in range(0, len(new), 500):
            part = new[at : at + 500]
            ids = np.array(self.tokenizer.encode_batch_fast([mark.join(c.decode() for c in part)], add_special_tokens=False)[0].ids, self.dtype)
            cuts = np.flatnonzero(ids == mark_id)
            raw, size = ids.tobytes(), self.dtype.itemsize
            for c, a, b in zip(part, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]):
                known[c] = raw[a * size : b * size]
        for w, (core, stops) in pairs.items():
            known[w] = known[core] + known[stops]

    def learn_pieces(self, pieces: list[bytes]) -> None:
        """Have the ids of pieces that the tokenizer would part as they are."""
        tokenize, flat, ends, size = self.tokenizer.model.tokenize, [], [0], self.dtype.itemsize
        for p in pieces:
            flat += [x.id for x in tokenize(p.decode() if p.isascii() else p.decode("latin-1").translate(BYTE_LEVEL))]
            ends.append(len(flat))
        raw = np.array(flat, self.dtype).tobytes()
        for p, a, b in zip(pieces, ends, ends[1:]):
            self.known[p] = raw[a * size : b * size]

    def encode(self, raw: bytes, offsets: np.ndarray) -> list[bytes]:
        texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        if not self.by_word:
            return self.ids([t.decode() for t in texts])
        split = [t.split() for t in texts]
        # Once known holds half of CACHE_WORDS it becomes the older half, so words in use stay.
        if len(self.known) > CACHE_WORDS // 2:
            self.known, self.older = {b"": b""}, self.known
        self.learn(set(filterfalse(self.known.__contains__, chain.from_iterable(split))))
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


def encoder(spec: str) -> Encoder:
    """The worker's own encoder, kept from task to task."""
    key = hash(spec)
    if key not in ENCODERS:
        ENCODERS[key] = Encoder(spec)
    return ENCODERS[key]


class Writer:
    def __init__(self, out):
        self.out, self.table, self.packer = out, [], zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.docs: list[tuple[int | None, int]] = []
        self.frames: list[int] = []
        self.open, self.size = [], 0

    def frame(self, content: bytes) -> None:
        packed = self.packer.compress(content)
        self.out.write(packed)
        self.table.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def flush(self) -> None:
        if self.open:
            self.frames.append(len(self.open))
            self.frame(b"".join(self.open))
            self.open, self.size = [], 0

    def add(self, doc_id: int | None, ids: bytes, n: int) -> None:
        if self.size + len(ids) > FRAME_BYTES:
            self.flush()
        self.docs.append((doc_id, n))
        self.open.append(ids)
        self.size += len(ids)

    def close(self, itemsize: int) -> None:
        self.flush()
        ids = np.array([0 if d is None else d for d, _ in self.docs], "<i8")
        null = np.array([d is None for d, _ in self.docs], np.uint8)
        counts = np.array([n for _, n in self.docs], "<u8")
        head = struct.pack("<QQB", len(self.docs), len(self.frames), itemsize)
        self.frame(head + ids.tobytes() + counts.tobytes() + np.array(self.frames, "<u8").tobytes() + null.tobytes())
        body = b"".join(struct.pack("<III", *row) for row in self.table) + struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)


class Reader:
    """Random access to one file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("not a seekable frame file")
        source.seek(size - 9 - 12 * n)
        self.table = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.starts = np.append(0, np.cumsum(self.table[:, 0]))
        raw = self.frame(n - 1)
        docs, frames, itemsize = struct.unpack_from("<QQB", raw)
        at = struct.calcsize("<QQB")
        self.dtype = np.dtype(f"<u{itemsize}")
        self.ids = np.frombuffer(raw, "<i8", docs, at)
        self.counts = np.frombuffer(raw, "<u8", docs, at + 8 * docs).astype(np.int64)
        per_frame = np.frombuffer(raw, "<u8", frames, at + 16 * docs).astype(np.int64)
        self.null = np.frombuffer(raw, np.uint8, docs, at + 16 * docs + 8 * frames).astype(bool)
        self.first = np.append(0, np.cumsum(per_frame))

    def frame(self, k: int) -> bytes:
        self.source.seek(int(self.starts[k]))
        raw = zstandard.ZstdDecompressor().decompress(self.source.read(int(self.table[k, 0])), max_output_size=int(self.table[k, 1]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"checksum of frame {k}")
        return raw

    def documents(self, k: int) -> Iterator[tuple[int, np.ndarray]]:
        """(number, ids) of the documents in frame k."""
        ids, at = np.frombuffer(self.frame(k), self.dtype), 0
        for i in range(self.first[k], self.first[k + 1]):
            yield i, ids[at : at + self.counts[i]]
            at += self.counts[i]

    def document(self, doc_id: int) -> np.ndarray | None:
        """Ids of one document, by decompressing its frame only."""
        for i in np.flatnonzero((self.ids == doc_id) & ~self.null)[:1]:
            return dict(self.documents(int(np.searchsorted(self.first, i, "right")) - 1))[i]
        return None


def write_task(folder: str, spec: Callable[[], str], end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, base = encoder(spec()), None
        tail = np.array([end_id], own.dtype).tobytes()
        store, root = fs.FileSystem.from_uri(folder)
        path, name = "", ""
        for batch in slices(batches):
            if base is None:
                name = f"{uuid.uuid4().hex}.tokens.zst"
                path = f"{root}/{name}"
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{path}.tmp")
                base = Writer(out)
            data, offsets = text_buffers(batch.column("text"))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), own.encode(data.tobytes(), offsets)):
                base.add(doc_id, ids + tail, len(ids) // own.dtype.itemsize + 1)
        if base is not None:
            base.close(own.dtype.itemsize)
            out.close()
            store.move(f"{path}.tmp", path)
            row = {"path": f"{folder}/{name}", "part": TaskContext.get().partitionId(), "first_doc": base.docs[0][0], "n_docs": len(base.docs), "n_tokens": sum(n for _, n in base.docs)}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("path", pa.string()), ("part", pa.int32()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return run


def read_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Manifest rows with their first id's number -> one row per document, a frame at a time."""
    for batch in batches:
        for row in batch.to_pylist():
            store, path = fs.FileSystem.from_uri(row["path"])
            with store.open_input_file(path) as source:
                file = Reader(source)
                starts = row["start"] + np.append(0, np.cumsum(file.counts))
                for k in range(len(file.first) - 1):
                    docs = list(file.documents(k))
                    which = np.array([i for i, _ in docs])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(file.ids[which], mask=file.null[which]), starts[which], file.counts[which], pa.array([zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in docs], pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Encode and write all documents; returns the manifest: path, part (the file's place), first_doc, n_docs, n_tokens,
    start (ids before).

    Null and empty texts are just the end id. Rows without a doc_id come first; rows that share one, or have none, stay
    in order of XXH64 of their texts (seed 42, signed), so that files part them too. Texts that hold a special token's string yield that token, as the tokenizer does. Very long texts
    are a frame of their own. Other columns, whatever their names, are ignored. An empty table writes no file.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or new_folder(spark, "tokens")
    with open(tokenizer_path) as file:
        spec = spark.sparkContext.broadcast(file.read())  # one vocabulary: 1.7 MB for 49k entries
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    files = staged(rows.mapInArrow(write_task(folder, lambda: spec.value, end_id), MANIFEST), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of a manifest."""
    ship(manifest.sparkSession)
    rows = staged(manifest, "files")
    return rows.repartitionByRange(max(1, rows.count()), "start").mapInArrow(read_task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    return read_tokens(write_tokens(docs, tokenizer_path, end_id, folder))


def read_document(spark: SparkSession, path: str, doc_id: int) -> np.ndarray | None:
    """Ids of one document of one file."""
    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_file(inner) as source:
        return Reader(source).document(doc_id)
