"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame operations only.

Sizes are words. Every source is dealt into shards by a seeded hash of doc_id and text; its words, in the order of another
seeded hash, form blocks of BLOCK words. The blocks that the whole mix needs are apportioned to sources, and a
source's blocks to its shards, by highest quotients v / (2k + 1), which gives integer quotas. A shard takes as many
whole passes over its blocks as its quota holds and fills the rest with blocks in seeded order. A document takes the
words that it has in taken blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .common import staged

WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2
#: Words of a block; words, or rows if they are very short, of a shard; rows of one id and text that share a hash.
BLOCK, SHARD_WORDS, SHARD_ROWS, ALIKE = 64, 2_000_000, 100_000, 1000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, n_rows -> with target: weighted shares of share * all words, none above epochs * its source.

    What exceeds a cap is shared again by weight until none is above: sources in order of cap / weight are capped as
    long as what is left, spread over the weights left, reaches their cap. One row a source."""
    order = Window.orderBy(F.asc_nulls_last("source"))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cycle = F.array(*map(F.lit, weights))
    rows = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double"))
    rows = rows.withColumn("cap", F.col("source_size") * float(epochs)).withColumn("budget", F.least(F.sum("source_size").over(everything) * float(share), F.sum("cap").over(everything)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    rows = rows.withColumn("cap_before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("weight_from", F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    rows = rows.withColumn("level", (F.col("budget") - F.col("cap_before")) / F.col("weight_from"))
    rows = rows.withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)
    rows = rows.withColumn("final", level["level"])
    return rows.select("source", "source_size", "n_rows", F.when(F.col("capped") | F.col("final").isNull(), F.col("cap")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def apportion(votes: DataFrame, group: list[str], vote: str, seats: str, order: list[Column], most: str | None = None) -> DataFrame:
    """Sainte-Laguë: adds `quota`, whole seats of each group dealt to its rows by highest vote / (2k + 1), k = 0, 1, ...

    With s rows, a row's seats lie within half a seat and its share times s / 2 of its exact portion, so only quotients
    in that range (about three a row, more for a large share) are ranked; lower ones win anyway. `most` caps seats."""
    own = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    portion = F.col("_share") * F.col(seats)
    reach = F.col("_share") * F.col("_rows") / 2 + 2
    rows = votes.withColumn("_rows", F.count(F.lit(1)).over(own)).withColumn("_share", F.coalesce(F.try_divide(F.col(vote).cast("double"), F.sum(F.col(vote).cast("double")).over(own)), F.lit(0.0)))
    rows = rows.withColumn("_low", F.greatest(F.lit(0), F.floor(portion - reach)).cast("long")).withColumn("_high", F.ceil(portion + reach).cast("long"))
    rows = rows.withColumn("_left", (F.col(seats) - F.sum("_low").over(own)).cast("long"))
    ranked = rows.select("*", F.explode(F.sequence("_low", "_high")).alias("_k")).withColumn("_rank", F.row_number().over(own.orderBy(F.desc(F.col(vote) / (2 * F.col("_k") + 1)), *order, "_k")))
    keys = votes.columns
    out = ranked.groupBy(*keys, "_low").agg(F.count_if((F.col("_rank") <= F.col("_left")) & (F.col(vote) > 0)).alias("_won")).withColumn("quota", F.col("_low") + F.col("_won"))
    return (out.withColumn("quota", F.least("quota", most)) if most else out).select(*keys, "quota")


def hashed(docs: DataFrame, seed: int, key: str | None) -> DataFrame:
    """doc_id, source, size, h and the key of every row: h is a hash of id and text, of which no more than about ALIKE rows
    have the same. Rows that are equal are counted, and each ALIKE of them have another hash; with a key they are dealt by it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"), *([F.col(key).alias("_key")] if key else []))
    again = F.when(F.col("part") > 0, F.xxhash64("h", "part")).otherwise(F.col("h"))
    counted = rows.groupBy("doc_id", "source", "size", "h").agg(F.count(F.lit(1)).alias("n"))
    if not key:
        parts = counted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / ALIKE))))
        own = F.least(F.lit(ALIKE).cast("long"), F.col("n") - F.col("part") * ALIKE)
        return parts.select("doc_id", "source", "size", again.alias("h"), F.explode(F.array_repeat(F.lit(0), own.cast("int"))).alias("_")).drop("_")
    many = staged(counted.where(F.col("n") > ALIKE).select(F.col("h").alias("_h"), "n"), "alike").groupBy("_h").agg(F.sum("n").alias("n"))
    rows = rows.join(many, F.col("h") == F.col("_h"), "left")
    part = F.coalesce(F.pmod(F.xxhash64("_key"), F.ceil(F.col("n") / ALIKE)), F.lit(0).cast("long"))
    return rows.withColumn("part", part).select("doc_id", "source", "size", again.alias("h"), "_key")


def quotas_of(docs: DataFrame, seed: int, share: float, epochs: int, weights: tuple[int, ...], key: str | None) -> tuple[DataFrame, DataFrame]:
    """(documents with shard, cells): a cell is a source's shard with its words, quota, passes over all of it, and rest.

    Shards are of about SHARD_WORDS words, by hash of id and text, so that rows of one id are spread too, as are rows of one
    id and text; a longer document makes its shard longer. Sources are dealt with in one task: one row a source."""
    sized = staged(hashed(docs, seed, key), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    aims = staged(targets(totals, share, epochs, weights), "targets")
    quotas = apportion(aims.withColumn("blocks", F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / BLOCK).cast("long")), [], "target", "blocks", [F.asc_nulls_last("source")])
    n_shards = F.ceil(F.greatest(F.col("source_size") / SHARD_WORDS, F.col("n_rows") / SHARD_ROWS))
    quotas = staged(quotas.select("source", F.col("quota").alias("source_quota"), "source_size", "target", F.greatest(n_shards, F.lit(1)).cast("long").alias("n_shards")), "quotas")  # one row a source
    joined = sized.alias("d").join(quotas.alias("q"), F.expr("d.source <=> q.source")).select("d.*", "q.source_size", "q.target", "q.source_quota", F.pmod("d.h", "q.n_shards").alias("shard"))
    cells = joined.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("source_quota").alias("source_quota"))
    cells = apportion(cells, ["source"], "words", "source_quota", [F.asc("shard")]).select("source", "shard", "words", "quota")
    need = F.least(F.col("quota") * BLOCK, F.col("words") * epochs)
    cells = cells.withColumn("passes", F.coalesce(F.floor(F.try_divide(need, F.col("words"))), F.lit(0)).cast("long"))
    return joined.drop("source_quota"), staged(cells.withColumn("rest", need - F.col("passes") * F.col("words")), "cells")


def line_of(seed: int) -> WindowSpec:
    """A shard's documents in seeded order; equal rows stand side by side."""
    return Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 2), "h"), "doc_id", "h", "size")


def mix(docs: DataFrame, seed: int = 42, share: float = SHARE, epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS, key: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document, and the column `key`, if named, of its row.

    Sources in order of code points, null last, weigh `weights`, repeating; a null source is one of its own. taken counts
    the words that the mix takes of a document, repeats included, at most `epochs` times its size. A null or empty text
    has size 0 and takes 0. Rows with equal ids and texts stand side by side in a shard, ALIKE of them at most. A source's taken
    words come within a block and a shard's rounding of its target. Reruns, and other partitionings, agree. Very long
    texts span many blocks. Other columns, whatever their names, are ignored. An empty table gives an empty result.
    """
    keyed = ["_key"] if key else []
    joined, cells = quotas_of(docs, seed, share, epochs, weights, key)
    # Blocks in seeded order until the rest is filled; the last one gives a part. A block is a row, so no shard is one value.
    numbered = cells.where("rest > 0").select("source", "shard", "words", "rest", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("words") / BLOCK) - 1)).alias("b"))
    size_of = F.least(F.lit(BLOCK).cast("long"), F.col("words") - F.col("b") * BLOCK)
    filled = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), F.coalesce("source", F.lit("\0")), "shard", "b"), "b").rowsBetween(Window.unboundedPreceding, -1)
    parts = numbered.withColumn("before", F.coalesce(F.sum(size_of).over(filled), F.lit(0))).withColumn("gives", F.least(size_of, F.col("rest") - F.col("before"))).where("gives > 0")
    parts = staged(parts.select("source", "shard", "b", "gives"), "blocks")
    # Documents in seeded order, with their first word's place in the shard, and the blocks they touch.
    line = line_of(seed)
    at = F.coalesce(F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = staged(joined.select("*", at.alias("at"), F.row_number().over(line).alias("row")), "placed")
    touched = placed.where("size > 0").select("source", "shard", "row", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / BLOCK), F.floor((F.col("at") + F.col("size") - 1) / BLOCK))).alias("b"))
    same = F.expr("t.source <=> p.source and t.shard = p.shard and t.b = p.b")
    overlap = F.greatest(F.lit(0), F.least(F.col("t.at") + F.col("t.size"), F.col("t.b") * BLOCK + F.col("p.gives")) - F.greatest(F.col("t.at"), F.col("t.b") * BLOCK))
    # Merge joins: files of blocks are small for what they hold, so their size is no bound of a broadcast table.
    extra = touched.alias("t").join(parts.hint("merge").alias("p"), same).select("t.source", "t.shard", "t.row", overlap.alias("words")).groupBy("source", "shard", "row").agg(F.sum("words").alias("extra"))
    whole = placed.alias("d").join(cells.select("source", "shard", "passes").alias("c"), F.expr("d.source <=> c.source and d.shard = c.shard"))
    whole = whole.join(extra.hint("merge").alias("e"), F.expr("d.source <=> e.source and d.shard = e.shard and d.row = e.row"), "left")
    taken = (F.col("c.passes") * F.col("d.size") + F.coalesce("e.extra", F.lit(0))).alias("taken")
    return whole.select("d.doc_id", "d.source", "d.size", "d.source_size", "d.target", taken, *[F.col(f"d.{k}").alias(key) for k in keyed])


def whole_copies(docs: DataFrame, key: str, seed: int = 42, share: float = SHARE, epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """key, copies: the same quotas met by whole documents, for corpora whose texts are not cut.

    A shard's documents are all taken as often as its quota holds all its words; of the rest, they are taken in seeded
    order as long as half of a document or more is within it. So a shard's words come within half of one document of its
    quota, and a source's within half a document a shard and a block of its target. `key` tells rows apart. Edge cases
    are those of mix; a document without words has no copies."""
    joined, cells = quotas_of(docs, seed, share, epochs, weights, key)
    at = F.coalesce(F.sum("size").over(line_of(seed).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = joined.select("source", "shard", "size", "_key", at.alias("at"))
    whole = placed.alias("d").join(cells.alias("c"), F.expr("d.source <=> c.source and d.shard = c.shard"))
    once = (2 * F.col("d.at") + F.col("d.size") <= 2 * F.col("c.rest")).cast("long")
    return whole.select(F.col("d._key").alias(key), F.when(F.col("d.size") > 0, F.col("c.passes") + once).otherwise(0).cast("int").alias("copies"))
