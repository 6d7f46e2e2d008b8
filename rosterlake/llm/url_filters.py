"""URL rules looked up in a sorted digest array.

Rules are written `host/path-prefix`. Their 64-bit xxhash keys are one sorted array in a file, followed by the rule
strings; Spark's file distribution hands the file to every executor, tasks map it into memory (so a machine holds one
copy) and probe it by vectorised binary search: for every URL the host's suffixes times the path lengths that rules
have. A found key counts only if the stored string is equal, so hash collisions change nothing. Rules that exceed a file
go on in further ones, which are probed alike.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship

ALLOW, BLOCK = "allow", "block"
#: The rules of the query, as they are fixed by its contract.
RULES = (("org/", ALLOW), ("example.org/es/", BLOCK), ("example.org/en/1", BLOCK), ("com/fr/", ALLOW), ("com/de/", BLOCK))
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Bytes of rule strings in one file.
FILE_BYTES = 1 << 29
#: Files that an application's executors have, by the digest of their rules.
SENT: dict[tuple[str, str], list[str]] = {}


def digest(strings: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s) for s in strings), np.uint64, len(strings))


def unique_rules(rules: list[tuple[str, str]]) -> dict[bytes, int]:
    """Rule strings with lower-case hosts, 1 for block. Of rules given twice, block wins."""
    verdicts: dict[bytes, int] = {}
    for rule, verdict in rules:
        host, _, rest = rule.partition("/")
        key = f"{host.translate(LOWER)}/{rest}".encode()
        verdicts[key] = max(verdicts.get(key, 0), int(verdict == BLOCK))
    return verdicts


def write_index(path: str, verdicts: dict[bytes, int]) -> None:
    """uint64 numbers: rules, path lengths; the distinct path lengths, the sorted keys, the ends of the strings; verdict
    bytes; strings. Everything before the verdicts is aligned, so a reader maps it as it is."""
    strings = list(verdicts)
    keys = digest(strings)
    order = np.argsort(keys, kind="stable")
    ordered = [strings[i] for i in order]
    lengths = np.unique([len(s.partition(b"/")[2]) for s in ordered] if ordered else np.zeros(0, int)).astype(np.uint64)
    with open(path, "wb") as out:
        for part in (np.array([len(ordered), len(lengths)], np.uint64), lengths, keys[order], np.cumsum([len(s) for s in ordered]).astype(np.uint64), np.array([verdicts[s] for s in ordered], np.uint8)):
            out.write(part.tobytes())
        out.write(b"".join(ordered))


class Index:
    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n, m = (int(x) for x in raw[:16].view(np.uint64))
        numbers = raw[16 : 16 + 8 * (m + 2 * n)].view(np.uint64)
        self.lengths, self.keys, self.ends = numbers[:m].tolist(), numbers[m : m + n], numbers[m + n :]
        rest = raw[16 + 8 * (m + 2 * n) :]
        self.block, self.strings = rest[:n], rest[n:]

    def string(self, i: int) -> bytes:
        return self.strings[int(self.ends[i - 1]) if i else 0 : int(self.ends[i])].tobytes()

    def find(self, keys: np.ndarray, matches) -> np.ndarray:
        """Number of each key's rule in the index, or -1; matches(j, string) confirms that it is the j-th one asked for."""
        out = np.full(len(keys), -1)
        if not len(self.keys):
            return out
        first = np.searchsorted(self.keys, keys)
        for j in np.flatnonzero(self.keys[np.minimum(first, len(self.keys) - 1)] == keys):
            i = int(first[j])
            while i < len(self.keys) and self.keys[i] == keys[j]:
                if matches(j, self.string(i)):
                    out[j] = i
                    break
                i += 1
        return out


def candidates(host: str, path: str, lengths: list[int]) -> Iterator[tuple[int, int, int]]:
    """(digest, bytes of the host's suffix, bytes of the path) of every rule that would fit; a path without its `/` fits
    none. Digests are carried on from length to length, so a URL's bytes are hashed once a suffix."""
    raw, name = path.encode(), host.encode()
    if not name or not raw.startswith(b"/"):
        return
    at = 0
    while True:
        state, done = xxhash.xxh64(name[at:]), 0
        for n in lengths:
            if n >= len(raw):
                break
            state.update(raw[done : n + 1])
            done = n + 1
            yield state.intdigest(), len(name) - at, done
        dot = name.find(b".", at)
        if dot < 0:
            return
        at = dot + 1


def judge(names: list[str], otherwise: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = [Index(SparkFiles.get(name)) for name in names]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                hosts, paths = part.column("host").to_pylist(), part.column("path").to_pylist()
                best: list[tuple[int, bytes, int] | None] = [None] * part.num_rows
                for index in indexes:
                    asked = [(i, *c) for i, (host, path) in enumerate(zip(hosts, paths)) for c in candidates(host, path, index.lengths)]

                    def same(j: int, rule: bytes) -> bool:
                        i, _, suffix, n = asked[j]
                        return len(rule) == suffix + n and (hosts[i].encode()[-suffix:] + paths[i].encode()[:n]) == rule

                    found = index.find(np.fromiter((x[1] for x in asked), np.uint64, len(asked)), same)
                    for j in np.flatnonzero(found >= 0):
                        i, _, suffix, n = asked[j]
                        if best[i] is None or suffix + n > best[i][0]:
                            best[i] = suffix + n, index.string(int(found[j])), int(index.block[found[j]])
                rules = [x[1].decode() if x else None for x in best]
                verdicts = [otherwise if x is None else BLOCK if x[2] else ALLOW for x in best]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("host"), part.column("path"), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return run


def send_rules(spark: SparkSession, rules: list[tuple[str, str]]) -> list[str]:
    """Names of the index files that Spark hands to every executor: the same for the same rules."""
    verdicts = sorted(unique_rules(rules).items())
    state = xxhash.xxh3_128()
    for rule, verdict in verdicts:
        state.update(b"%b %d\n" % (rule, verdict))
    key = spark.sparkContext.applicationId, state.hexdigest()
    if key not in SENT:
        folder = tempfile.mkdtemp()
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        parts: list[dict[bytes, int]] = [{}]
        size = 0
        for rule, verdict in verdicts:
            if size + len(rule) > FILE_BYTES and parts[-1]:
                parts.append({})
                size = 0
            parts[-1][rule] = verdict
            size += len(rule)
        SENT[key] = [f"rules-{key[1]}-{i}.idx" for i in range(len(parts))]
        for name, part in zip(SENT[key], parts):
            write_index(os.path.join(folder, name), part)
            spark.sparkContext.addFile(os.path.realpath(os.path.join(folder, name)))
    return SENT[key]


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], otherwise: str = ALLOW) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to `?`, `#` or the
    end. Null or empty urls, and those without `://`, have both empty and fit no rule. A rule fits its host and all
    subdomains if the path starts with the rule's (an empty path fits none); the longest wins; without one, `otherwise`
    holds. Repeated rows and null ids stay rows. Very long urls cost their labels times their bytes up to the longest
    rule's, hashed once.
    Other columns, whatever their names, are ignored. Empty tables give an empty result.
    """
    spark = pages.sparkSession
    ship(spark)
    has = F.coalesce(F.contains("url", F.lit("://")), F.lit(False))
    rest = F.expr("substring(url, locate('://', url) + 3)")
    lower = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = pages.select(F.col("page_id").cast("long"), F.when(has, lower).otherwise("").alias("host"), F.when(has, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("").alias("path"))
    return parts.mapInArrow(judge(send_rules(spark, rules), otherwise), "page_id long, host string, path string, rule string, verdict string")
