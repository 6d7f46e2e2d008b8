"""Rosters kept beside the pools they come from, and solved again only where something changed.

A store has `runs`, the rosters that each run has solved, and `digests`: one row a slate, of its pool and the requests
for it, with the run that has its rosters. A run compares digests, solves the slates whose digest is new, writes their
rosters and then the digests. A run that is cut off before has written rosters that no digest names; they are not read,
and the next run writes them again. Files are as many as tasks, however many slates there are. Runs that no digest names
any more are deleted, and once more than RUNS are named, what is current of them is written as one.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.locks import request_rows
from ..schema import POOL_COLUMNS
from ..staging import delete, staged
from .lineups import Requests, optimal_lineups

RUNS = 16


def fingerprint(rows: DataFrame, columns: list[str]) -> list:
    """Aggregates that don't depend on the order of rows: their number, and two sums of 64-bit hashes."""
    h = [F.xxhash64(F.lit(seed), *columns) for seed in (1, 2)]
    return [F.count(F.lit(1)).alias("n"), *[F.sum(x.cast("decimal(38,0)")).alias(f"h{i}") for i, x in enumerate(h)]]


def digests(pool: DataFrame, asked: DataFrame) -> DataFrame:
    """slate, digest of every slate of the pool: 256 bits over its rows and the requests for it."""
    of_pool = pool.groupBy("slate").agg(*fingerprint(pool, POOL_COLUMNS))
    body = sorted(set(asked.columns) - {"slate"})
    if "slate" in asked.columns:
        wanted = asked.groupBy("slate").agg(*fingerprint(asked, body))
    else:
        wanted = pool.select("slate").distinct().crossJoin(F.broadcast(asked.agg(*fingerprint(asked, body))))  # one row
    both = of_pool.alias("p").join(wanted.alias("w"), "slate", "left")
    parts = F.array(*[F.coalesce(F.col(f"{t}.{c}").cast("string"), F.lit("-")) for t in "pw" for c in ("n", "h0", "h1")])
    return both.select("slate", F.sha2(F.array_join(parts, ",").cast("binary"), 256).alias("digest"))


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table of a store; without rows before the first run."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def refresh_rosters(pool: DataFrame, requests: Requests, store: str) -> int:
    """Bring the store up to date with pool and requests; returns how many slates were solved."""
    spark = pool.sparkSession
    asked = requests if isinstance(requests, DataFrame) else request_rows(spark, requests)
    now = staged(digests(pool, asked), "digests")
    known = staged(stored(spark, f"{store}/digests", T.StructType(now.schema.fields).add("run", "string")), "known")  # written before it is replaced below
    changed = staged(now.join(known.where("run is not null"), ["slate", "digest"], "left_anti"), "changed")
    solved = changed.count()
    run = f"r{uuid.uuid4().hex}"
    if solved:
        part = pool.join(changed.select("slate"), "slate", "left_semi")
        own = asked.join(changed.select("slate"), "slate", "left_semi") if "slate" in asked.columns else asked
        optimal_lineups(part, own).join(changed, "slate").write.parquet(f"{store}/runs/run={run}")
    if solved or now.count() != known.count():
        current = staged(now.join(known, ["slate", "digest"], "left").withColumn("run", F.coalesce("run", F.lit(run))), "current")
        current.write.mode("overwrite").parquet(f"{store}/digests")
        if named(current) > RUNS:
            kept_rosters(spark, store).join(now, "slate").write.parquet(f"{store}/runs/run={run}all")
            current = now.withColumn("run", F.lit(f"{run}all"))
            current.write.mode("overwrite").parquet(f"{store}/digests")
            delete(spark, f"{store}/runs/run={run}")
        gone = known.select("run").where("run is not null").distinct().join(current.select("run").distinct(), "run", "left_anti")
        for row in gone.collect():  # at most RUNS
            delete(spark, f"{store}/runs/run={row['run']}")
    return solved


def named(digests: DataFrame) -> int:
    """How many runs digests name."""
    return digests.select("run").distinct().count()


def kept_rosters(spark: SparkSession, store: str) -> DataFrame:
    """The rosters of the slates that the last run's pool had."""
    current = spark.read.parquet(f"{store}/digests")
    return spark.read.parquet(f"{store}/runs").join(current, ["slate", "digest", "run"], "left_semi").drop("digest", "run")
