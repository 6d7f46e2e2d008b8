"""Requests on a pool: exclusions, locked players, and what remains to be filled.

A pool here has the columns of POOL plus `slate` (any key). Requests are rows (request, dst, one_te, excluded, included);
all requests times all slates times all score variants are solved in one plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..schema import CAP, LIMITS, PLAYERS, POSITIONS, VARIANTS, position_order


class DefenseNotFound(ValueError):
    """The asked defense is in no candidate of the pool."""


@dataclass(frozen=True)
class Request:
    request: str = "default"
    dst: str | None = None
    one_te: bool = False
    excluded: tuple[str, ...] = ()
    included: tuple[str, ...] = ()
    variants: tuple[tuple[float, float], ...] = field(default=VARIANTS)


#: What a request has; a table of requests may also have slate, the one it is for.
REQUEST = "request string, dst string, one_te boolean, excluded array<string>, included array<string>, variant int, w_proj double, w_avg double"


def request_rows(spark: SparkSession, requests: list[Request]) -> DataFrame:
    """One row a request and variant; included names count once."""
    rows = [(r.request, r.dst, bool(r.one_te), list(r.excluded), list(dict.fromkeys(r.included)), i + 1, float(a), float(b)) for r in requests for i, (a, b) in enumerate(r.variants)]
    return spark.createDataFrame(rows, REQUEST)


def request_table(rows: DataFrame, variants: tuple[tuple[float, float], ...] = VARIANTS) -> DataFrame:
    """Requests that are rows themselves: slate, request, and of dst, one_te, excluded, included those that there are.

    A request has a row of REQUEST and slate for each variant; (slate, request) tells requests apart."""
    have = lambda name, otherwise: F.coalesce(F.col(name), otherwise) if name in rows.columns else otherwise
    nobody = F.array().cast("array<string>")
    weights = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("variant"), F.lit(float(a)).alias("w_proj"), F.lit(float(b)).alias("w_avg")) for i, (a, b) in enumerate(variants)]))
    out = rows.select("slate", F.col("request").cast("string").alias("request"), have("dst", F.lit(None).cast("string")).alias("dst"), have("one_te", F.lit(False)).alias("one_te"), have("excluded", nobody).alias("excluded"), F.array_distinct(have("included", nobody)).alias("included"), weights.alias("w"))
    return out.select("slate", "request", "dst", "one_te", "excluded", "included", "w.variant", "w.w_proj", "w.w_avg")


KEY = ["slate", "request", "variant"]


def folded(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests, names) of a table of requests: those of a slate that ask the same are one row, whatever they are called
    and in whatever order their lists are; names has slate, request, variant and one, what that row is called.

    What is asked is known by 128 hash bits, as problems are."""
    lists = ["excluded", "included"]
    sets = requests.withColumns({c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))) for c in lists})
    body = F.to_json(F.struct(*[c for c in sets.columns if c not in KEY]))
    told = sets.withColumn("one", F.concat(*[F.hex(F.xxhash64(F.lit(i), body)) for i in (1, 2)]))
    asked = told.drop("request").withColumnRenamed("one", "request").dropDuplicates(KEY)
    return asked.select(*requests.columns), told.select("slate", "request", "variant", "one")


def toggled(excluded: Column, included: Column, player: Column, into: str = "excluded") -> tuple[Column, Column]:
    """Both lists after a name is toggled in one of them: it goes if it was there, else it comes in and leaves the other."""
    one, other = (excluded, included) if into == "excluded" else (included, excluded)
    there = F.array_contains(one, player)
    one, other = F.when(there, F.array_remove(one, player)).otherwise(F.array_append(one, player)), F.when(there, other).otherwise(F.array_remove(other, player))
    return (one, other) if into == "excluded" else (other, one)


def candidates(pool: DataFrame, requests: DataFrame, included: DataFrame | None = None) -> DataFrame:
    """Pool rows of every request and variant, without excluded players, with idx (pool order), points and locked.

    A variant without weight on averages keeps the projection as it is. A defense is locked if it is the first match of
    `dst`, unless it is excluded or included by name; included names that no candidate has change nothing. Requests with
    a slate are joined to it, however many they are; those without one are a list made by hand, for every slate, and each
    task gets all of them. Names that come from data go into `included` (slate, request, player) instead, which is joined."""
    order = Window.partitionBy("slate").orderBy(position_order(F.col("position")), "rank", "player", "team", "salary")
    rows = pool.withColumn("idx", F.row_number().over(order))
    rows = rows.join(requests, "slate") if "slate" in requests.columns else rows.crossJoin(F.broadcast(requests))  # a driver-made list
    rows = rows.where(F.col("player").isNull() | ~F.coalesce(F.array_contains("excluded", F.col("player")), F.lit(False)))
    points = F.when(F.col("w_avg") > 0, text.blend(F.col("proj_fpts"), F.col("avg_fpts"), (F.col("w_proj"), F.col("w_avg")))).otherwise(F.col("proj_fpts"))
    rows = rows.withColumn("proj_fpts", points)
    named = F.array_contains("included", F.col("player"))
    if included is not None:
        wanted = included.select("slate", "request", "player").distinct().withColumn("_wanted", F.lit(True))
        rows = rows.join(wanted, ["slate", "request", "player"], "left")
        named = named | F.coalesce("_wanted", F.lit(False))
    rows = rows.withColumn("_named", F.coalesce(named, F.lit(False))).drop("_wanted")
    match = F.coalesce((F.col("position") == "DST") & text.matches_name(F.col("player"), F.coalesce("dst", F.lit("$^"))) & F.col("dst").isNotNull(), F.lit(False))
    whole = Window.partitionBy(*KEY)
    rows = rows.withColumn("_dst", F.min(F.when(match, F.struct("idx", "player"))).over(whole))
    by_dst = (F.col("_dst.player") == F.col("player")) & ~F.col("_named")
    rows = rows.withColumn("by_dst", F.coalesce(by_dst, F.lit(False))).withColumnRenamed("_named", "by_name")
    missing = F.col("dst").isNotNull() & F.col("_dst").isNull()
    return rows.withColumn("dst_missing", missing).withColumn("locked", F.col("by_dst") | F.col("by_name")).drop("_dst", "excluded", "included", "w_proj", "w_avg")


def residuals(rows: DataFrame) -> DataFrame:
    """Per slate, request and variant: cap, total and base counts left after the locks, and flex.

    The first row of a locked name pays. Locked QB, RB, TE and DST lower their count down to 0, WR without a floor; a
    defense locked by `dst` sets its count to 0. flex = total - counts; below 0 nothing can be filled."""
    first = rows.where("locked").withColumn("_n", F.row_number().over(Window.partitionBy(*KEY, "player").orderBy("idx"))).where("_n = 1")
    counts = [F.count_if(F.col("by_name") & (F.col("position") == p)).alias(f"_{p}") for p in POSITIONS]
    locked = first.groupBy(*KEY).agg(F.sum("salary").alias("_salary"), F.count(F.lit(1)).alias("_locked"), F.max("by_dst").alias("_by_dst"), *counts)
    every = rows.groupBy(*KEY).agg(F.first("one_te").alias("one_te"), F.max("dst_missing").alias("dst_missing"))
    out = every.join(locked, KEY, "left").na.fill(0).na.fill(False)
    left = {p: F.lit(LIMITS[p]) - F.col(f"_{p}") for p in POSITIONS}
    need = {p: F.greatest(F.lit(0), left[p]) for p in POSITIONS}
    need["DST"] = F.when(F.col("_by_dst"), F.lit(0)).otherwise(need["DST"])
    total = F.lit(PLAYERS) - F.col("_locked")
    out = out.select(*KEY, "one_te", "dst_missing", (F.lit(CAP) - F.col("_salary")).cast("int").alias("cap"), total.cast("int").alias("total"), left["WR"].cast("int").alias("wr_left"), *[need[p].cast("int").alias(f"n_{p.lower()}") for p in POSITIONS])
    return out.withColumn("flex", F.col("total") - F.col("n_qb") - F.col("n_rb") - F.col("n_wr") - F.col("n_te") - F.col("n_dst"))


def compositions(left: DataFrame) -> DataFrame:
    """Per slate, request and variant: every allowed (n_qb, n_rb, n_wr, n_te, n_dst), flex dealt over RB, WR and, unless
    one_te, TE; comp numbers them."""
    extra = F.explode(F.sequence(F.lit(0), F.col("flex")))
    rows = left.where("flex >= 0").withColumn("_rb", extra).withColumn("_wr", F.explode(F.sequence(F.lit(0), F.col("flex") - F.col("_rb"))))
    rows = rows.withColumn("_te", F.col("flex") - F.col("_rb") - F.col("_wr")).where(~F.col("one_te") | (F.col("_te") == 0))
    rows = rows.select(*KEY, "cap", "n_qb", (F.col("n_rb") + F.col("_rb")).alias("n_rb"), (F.col("n_wr") + F.col("_wr")).alias("n_wr"), (F.col("n_te") + F.col("_te")).alias("n_te"), "n_dst")
    return rows.withColumn("comp", (F.col("n_rb") * 100 + F.col("n_wr") * 10 + F.col("n_te")).cast("int"))
