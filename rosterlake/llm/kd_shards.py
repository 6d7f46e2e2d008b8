"""Sharding by a k-d tree over the documents' metadata, with DataFrame operations only.

Every node is split at the weighted median of its widest dimension, weights being bytes, until each leaf holds its
target. Medians are found by histograms: a key of 15-bit digits says where a row stands along a dimension, one pass
adds up the bytes of every digit under the prefix that holds the median, and the next pass looks into that digit. So a
level costs a few passes that combine before they shuffle, and no node is sorted.

Equal texts form a group and have one place along every dimension, that of the group's first document, so they stay in
one shard, unless a group is heavier than LARGEST of a leaf; such a group's rows have places of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import passing
from .common import staged

SHARDS = 8
#: A group of equal texts over this share of a leaf's target may be cut.
LARGEST = 1 / 32
#: Bits of a digit, of a coordinate, and of each of a key's two parts.
DIGIT, COORDINATE, PART = 15, 20, 60
#: A digit that holds no more than this share of its node is not looked into.
FINE = 1 / 8192
GROUP = ["text_hash", "text_crc32", "size"]


def dimensions() -> dict[str, Column]:
    """Metadata of a group along which nodes are split, as numbers; equal sources, or languages, have one number."""
    return {"length": F.log2("size"), "source": F.xxhash64("source").cast("double"), "lang": F.xxhash64("lang").cast("double"), "doc_id": F.col("doc_id").cast("double")}


def numbered(docs: DataFrame) -> DataFrame:
    """Size, checksum and metadata of every row, and its number in the corpus, written, so that it stays the same."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.octet_length(text).cast("long").alias("bytes"), F.xxhash64(text).alias("text_hash"), F.crc32(text).alias("text_crc32"))
    return staged(rows.withColumn("size", F.col("bytes") + 1).drop("bytes"), "numbered")


def placed(rows: DataFrame, shards: int) -> DataFrame:
    """rows with their node and their keys: key_<dimension> for the first part, and `second`, 0 but in heavy groups."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "source", "lang")).alias("first")
    groups = rows.groupBy(*GROUP).agg(F.sum("size").alias("weight"), first).select(*GROUP, "weight", "first.doc_id", "first.source", "first.lang")
    groups = staged(groups.select(*GROUP, "weight", *[x.alias(f"at_{d}") for d, x in dimensions().items()]), "groups")
    names = list(dimensions())
    span = groups.agg(F.sum("weight").alias("total"), *[f(f"at_{d}").alias(f"{n}_{d}") for d in names for n, f in (("min", F.min), ("max", F.max))]).first()
    whole, top = (1 << COORDINATE) - 1, PART - COORDINATE
    mixed = F.shiftrightunsigned(F.xxhash64(*GROUP), 64 - top)

    def key(d: str) -> Column:
        low, high = span[f"min_{d}"], span[f"max_{d}"]
        wide = (high or 0.0) - (low or 0.0)
        at = F.floor((F.col(f"at_{d}") - F.lit(low)) / wide * whole).cast("long") if wide > 0 else F.lit(0).cast("long")
        return F.shiftleft(F.coalesce(at, F.lit(0).cast("long")), top).bitwiseOR(mixed)

    heavy = F.col("weight") > (span["total"] or 0) / shards * LARGEST
    groups = groups.select(*GROUP, heavy.alias("heavy"), *[key(d).alias(f"key_{d}") for d in names])
    # groups are written, so where one text has very many rows Spark splits its side of the join.
    own = F.when(F.col("heavy"), F.shiftrightunsigned(F.xxhash64("doc_id", "row"), 64 - PART)).otherwise(F.lit(0).cast("long"))
    out = rows.join(groups, GROUP).select("row", "doc_id", "size", "text_crc32", *[f"key_{d}" for d in names], own.alias("second"), F.lit(0).alias("node"))
    return staged(out, "level")


def widest(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, dim, weight, want of the nodes that are to be split; nodes has a row a node: node, leaves, first.

    Width is the weighted standard deviation of a coordinate, in parts of its range over the corpus; ties go by name."""
    names, whole = sorted(dimensions()), float(1 << COORDINATE)
    at = {d: F.shiftright(f"key_{d}", PART - COORDINATE) / whole for d in names}
    sums = [F.sum(F.col("size") * at[d] ** k).alias(f"{d}_{k}") for d in names for k in (1, 2)]
    rows = rows.join(F.broadcast(nodes.where("leaves > 1")), "node").groupBy("node", "leaves", "first").agg(F.sum("size").alias("weight"), *sums)
    spread = {d: F.round(F.col(f"{d}_2") / F.col("weight") - (F.col(f"{d}_1") / F.col("weight")) ** 2, 9) for d in names}
    best = F.array_max(F.array(*[F.struct(spread[d].alias("width"), F.lit(-i).alias("i")) for i, d in enumerate(names)]))["i"]
    want = F.col("weight") * F.floor(F.col("leaves") / 2) / F.col("leaves")
    return rows.select("node", "leaves", "first", "weight", want.alias("want"), (-best).cast("int").alias("dim"))


def medians(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, dim, cut, cut_second: rows whose (key, second) is below the cut hold about `want` of the node's bytes."""
    names = sorted(dimensions())
    each = PART // DIGIT
    key = F.element_at(F.array(*[f"key_{d}" for d in names]), F.col("dim") + 1)
    prefix, before = F.lit(0).cast("long"), F.lit(0.0)
    open_nodes, done = nodes.select("node", "dim", "weight", "want", prefix.alias("head"), prefix.alias("tail"), before.alias("before")), None
    for step in range(2 * each):
        left = PART - DIGIT * (step % each)  # bits of this part from the digit on
        part, fixed = (F.col("key"), "head") if step < each else (F.col("second"), "tail")
        known = F.shiftrightunsigned(part, left) == F.col(fixed) if step % each else F.lit(True)
        if step >= each:
            known &= F.col("key") == F.col("head")
        digit = F.shiftrightunsigned(part, left - DIGIT).bitwiseAND((1 << DIGIT) - 1)
        inside = rows.join(F.broadcast(open_nodes), "node").withColumn("key", key).where(known)
        one = (F.min("key") == F.max("key")) & (F.min("second") == F.max("second"))
        bins = inside.groupBy("node", digit.alias("digit")).agg(F.sum("size").alias("bytes"), one.alias("one"))
        order = Window.partitionBy("node").orderBy("digit")
        below = F.coalesce(F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # The digit in which the median falls: the first that reaches it, else (rounding) the last.
        bins = bins.join(F.broadcast(open_nodes), "node").withColumn("below", F.col("before") + below).withColumn("reached", F.col("below") + F.col("bytes") >= F.col("want"))
        here = bins.groupBy("node", "dim", "weight", "want", "head", "tail").agg(F.min_by(F.struct("digit", "below", "bytes", "one"), F.struct(~F.col("reached"), F.when(F.col("reached"), F.col("digit")).otherwise(-F.col("digit")))).alias("m"))
        here = here.select("node", "dim", "weight", "want", "head", "tail", "m.*")
        longer = (F.shiftleft(F.col(fixed), DIGIT) if step % each else F.lit(0).cast("long")) + F.col("digit")
        last = step == 2 * each - 1
        over = (F.col("want") - F.col("below") > F.col("below") + F.col("bytes") - F.col("want")).cast("long")  # the digit goes left
        # A part that ends here is cut behind or before its digit; both sides have to hold something.
        over = F.when(F.col("below") <= 0, 1).when(F.col("below") + F.col("bytes") >= F.col("weight"), 0).otherwise(over)
        bound = F.shiftleft(longer + over, left - DIGIT)
        cut = (bound.alias("cut"), F.lit(0).cast("long").alias("cut_second")) if step < each else (F.col("head").alias("cut"), bound.alias("cut_second"))
        enough = F.col("one") | (F.col("bytes") <= F.col("weight") * FINE) | F.lit(last)
        here = staged(here.select("*", longer.alias("longer"), *cut, enough.alias("enough")), "digits")
        settled = here.where("enough").select("node", "dim", "cut", "cut_second")
        done = settled if done is None else done.unionByName(settled)
        if last or here.where("not enough").isEmpty():
            return done
        head, tail = (F.col("longer"), F.col("tail")) if step < each else (F.col("head"), F.col("longer"))
        open_nodes = here.where("not enough").select("node", "dim", "weight", "want", head.alias("head"), tail.alias("tail"), F.col("below").alias("before"))
    return done


def leaves_of(rows: DataFrame, shards: int) -> DataFrame:
    """row, doc_id, size, text_crc32, shard. Nodes are numbered by level; one row a node is what is broadcast."""
    spark = rows.sparkSession
    names = sorted(dimensions())
    nodes = spark.createDataFrame([(0, shards, 0)], "node int, leaves int, first int")
    while not nodes.where("leaves > 1").isEmpty():
        cuts = staged(medians(rows, widest(rows, nodes)), "cuts")
        known = nodes.join(cuts, "node", "left").select("node", "leaves", "first", "dim", "cut", "cut_second")
        key = F.element_at(F.array(*[f"key_{d}" for d in names]), F.coalesce("dim", F.lit(0)) + 1)
        right = F.coalesce((key > F.col("cut")) | ((key == F.col("cut")) & (F.col("second") >= F.col("cut_second"))), F.lit(False))
        rows = staged(rows.join(F.broadcast(known), "node").select(*[c for c in rows.columns if c != "node"], (2 * F.col("node") + 1 + right.cast("int")).alias("node")), "level")
        half = F.floor(F.col("leaves") / 2).cast("int")
        both = F.array(F.struct((2 * F.col("node") + 1).alias("node"), F.greatest(half, F.lit(1)).alias("leaves"), F.col("first")), F.struct((2 * F.col("node") + 2).alias("node"), (F.col("leaves") - half).alias("leaves"), (F.col("first") + half).alias("first")))
        nodes = staged(nodes.select("leaves", F.explode(F.when(F.col("leaves") > 1, both).otherwise(F.slice(both, 1, 1))).alias("x")).select("x.*"), "nodes")
    return rows.join(F.broadcast(nodes), "node").select("row", "doc_id", "size", "text_crc32", F.col("first").alias("shard"))


def slotted(rows: DataFrame) -> DataFrame:
    """rows with slot: their place in their shard, in the corpus's order, from 0.

    A task of the first reading is a chunk: places inside it are counted by a window, and what shards hold in the
    chunks before it is added. The row number's upper bits are the chunk."""
    rows = rows.withColumn("chunk", F.shiftright("row", 33))
    counts = rows.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = staged(counts.select("shard", "chunk", before.alias("before")), "chunks")
    inside = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("row")) - 1
    return rows.withColumn("inside", inside).join(counts, ["shard", "chunk"]).withColumn("slot", F.col("inside") + F.col("before")).drop("chunk", "inside", "before")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document, in `shards` shards of nearly equal bytes.

    size: UTF-8 bytes of the text plus 1; a null text has none, like an empty one. law is `bytes`: with target bytes
    of all sizes / shards, shards differ from it by a few hundredths, or by about half of the largest document or
    uncut group where those are larger. Equal texts (by hash, checksum and size) share a shard unless they hold over
    LARGEST of the target. A null source, language or id has a place of its own, at the lower end; a group's are those of
    its smallest doc_id, null last. Rows that repeat an id, or a whole row, are rows of their own; which of several
    equal rows goes to which side of a cut depends on the order of reading, as slots do: they number a shard's
    rows in that order, without gaps. grown_shard is null. Very long texts are one row as any. With fewer documents
    than shards some stay empty. Other columns, whatever their names, are ignored. An empty table gives an empty
    result."""
    spark = docs.sparkSession
    with passing(spark):
        rows = slotted(leaves_of(placed(numbered(docs), shards), shards))
        rows = staged(rows.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot")), "shards", lasting=True)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shards_for(docs: DataFrame, target_bytes: int) -> int:
    """How many shards hold target_bytes each, at least 1."""
    total = docs.agg(F.sum(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 1)).first()[0] or 0
    return max(1, round(total / target_bytes))
