"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def stars(rows: DataFrame) -> bool:
    """Whether edges (a, b), a over b, are stars: each a has one b, which is no other's a. A step changes those no more."""
    nodes = rows.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))))
    nodes = nodes.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return not nodes.agg(F.max(F.expr("ups > 1 or ups > 0 and least = 0"))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(a, b) longs -> (node, root): root is the smallest node that node is connected with; roots have no row.

    Each step aggregates before it shuffles and is written to the shared folder; a hub is a join key that Spark may
    split, never one collected group. The number of steps grows with the logarithm of the longest chain. A step's plan
    reads the edges twice, as the driver holds it all. Null ends and loops link nothing.
    """
    rows = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a > b").distinct(), "edges")
    while not stars(rows):
        both = rows.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), "m")
        large = rows.join(least, "b").select("a", F.least("b", "m").alias("b")).distinct()
        joined = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = joined.select(F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))).where("a != b").distinct()
        rows = staged(small, "edges")
    return rows.select(F.col("a").alias("node"), F.col("b").alias("root"))
