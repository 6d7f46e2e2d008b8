"""What is served: rosters of a request in three score variants, projections, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.locks import KEY, DefenseNotFound, Request, candidates, compositions, folded, request_rows, residuals
from ..schema import CAP, PLAYERS, POOL_COLUMNS, position_order
from ..sources.snapshots import files_of, latest_week, listed_files, read_pools, records
from ..staging import staged
from .solver import SCALE, micro, solve


#: Requests made by hand, for every slate, or a table of them; see request_table.
Requests = list[Request] | DataFrame


#: What of a candidate the optimiser reads.
NARROW = [*KEY, "idx", "player", "position", "salary", "proj_fpts", "one_te", "by_name", "by_dst", "locked", "dst_missing"]


def solved(pool: DataFrame, requests: Requests, included: DataFrame | None = None, columns: list[str] = NARROW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates with columns, residuals, best filling)."""
    asked = requests if isinstance(requests, DataFrame) else request_rows(pool.sparkSession, requests)
    rows = staged(candidates(pool, asked, included).select(*columns), "candidates")
    left = staged(residuals(rows), "residuals")
    free = rows.where("not locked and not dst_missing").join(rows.where("locked").select(*KEY, "player").distinct(), [*KEY, "player"], "left_anti")
    best = solve(free.select(*KEY, "position", "idx", "salary", micro(F.col("proj_fpts")).alias("points")), compositions(left.where("not dst_missing")))
    return rows, left, staged(best, "best")


def once(requests: Requests, included: DataFrame | None) -> tuple[Requests, DataFrame | None]:
    """Of a table of requests, those that ask the same once, and the names of all; see folded. Other requests as they are."""
    if isinstance(requests, DataFrame) and "slate" in requests.columns and included is None:
        asked, names = folded(requests)
        names = staged(names, "names")
        return staged(asked, "asked"), names
    return requests, None


def named(rows: DataFrame, names: DataFrame | None) -> DataFrame:
    """The rows of folded requests for every request that is one of them."""
    if names is None:
        return rows
    return rows.withColumnRenamed("request", "one").join(names, ["slate", "one", "variant"]).select(*rows.columns)


def optimal_lineups(pool: DataFrame, requests: Requests, included: DataFrame | None = None) -> DataFrame:
    """KEY, status, and the 11 pool columns of every roster row.

    Rows are the locked players and the best filling; without a filling, the locked rows with status INFEASIBLE; with an
    asked defense that no candidate has, no rows (see summaries). A picked name brings all pool rows of that name."""
    requests, every = once(requests, included)
    rows, _, best = solved(pool, requests, included, list(dict.fromkeys([*NARROW, *POOL_COLUMNS])))
    picked = best.select(*KEY, F.explode("ids").alias("idx"))
    names = rows.join(picked, [*KEY, "idx"]).select(*KEY, "player").unionByName(rows.where("locked and not dst_missing").select(*KEY, "player")).distinct()
    status = best.select(*KEY, F.lit("OPTIMAL").alias("_status"))
    lineup = rows.join(names, [*KEY, "player"], "left_semi").join(status, KEY, "left")
    return named(lineup.select(*KEY, F.coalesce("_status", F.lit("INFEASIBLE")).alias("status"), "idx", *POOL_COLUMNS), every)


def summaries(pool: DataFrame, requests: Requests, included: DataFrame | None = None) -> DataFrame:
    """KEY, status (OPTIMAL, INFEASIBLE or DST_NOT_FOUND), and totals of the filling: points and salary."""
    requests, every = once(requests, included)
    _, left, best = solved(pool, requests, included)
    status = F.when(F.col("dst_missing"), "DST_NOT_FOUND").when(F.col("points").isNull(), "INFEASIBLE").otherwise("OPTIMAL")
    return named(left.join(best, KEY, "left").select(*KEY, status.alias("status"), (F.col("points") / SCALE).alias("free_points"), F.col("salary").cast("long").alias("free_salary")), every)


def totals(lineups: DataFrame) -> DataFrame:
    """Points, salary and what is left of the cap, per roster."""
    out = lineups.groupBy(*KEY).agg(F.sum("proj_fpts").alias("points"), F.sum("salary").alias("salary"), F.count(F.lit(1)).alias("players"))
    return out.withColumn("points", F.round("points", 2)).withColumn("remaining", F.lit(CAP) - F.col("salary"))


def feasible(lineups: DataFrame) -> DataFrame:
    """Per roster without locks: whether it meets cap, size and position counts."""
    count = lambda p: F.count_if(F.col("position") == p)
    rules = (F.sum("salary") <= CAP) & (F.count(F.lit(1)) == PLAYERS) & (count("QB") == 1) & (count("RB") >= 2) & (count("WR") >= 3) & (count("TE") >= 1) & (count("DST") == 1)
    return lineups.groupBy(*KEY).agg(rules.alias("feasible"))


class RosterService:
    """Stored pools under a folder of CSV snapshots, served by (year, week)."""

    def __init__(self, spark: SparkSession, pools: str, year: int | None = None, week: int | None = None, policy: str = "name"):
        self.spark, self.pools, self.files = spark, pools, listed_files(spark, pools)
        if year is None or week is None:
            row = latest_week(self.files, year, policy).first()
            year, week = row["year"] if year is None else year, row["week"] if week is None else week
        self.year, self.week = year, week

    def pool(self) -> DataFrame:
        return self.week_pool(self.year, self.week)

    def week_pool(self, year: int, week: int) -> DataFrame:
        """Rows of the files of one week; others are listed, but not read."""
        mine = files_of(self.files, year, week)
        rows = read_pools(self.spark, mine or self.pools).where((F.col("file_year") == year) & (F.col("file_week") == week))
        return rows.withColumn("slate", F.format_string("%d_w%d", "file_year", "file_week"))

    def projections(self, year: int | None = None, week: int | None = None) -> DataFrame:
        """Pool rows of a week in serving order; FileNotFoundError if there is none."""
        rows = self.week_pool(year or self.year, week or self.week)
        if rows.isEmpty():
            raise FileNotFoundError(f"no pool of {year or self.year}, week {week or self.week}")
        return rows.select(*POOL_COLUMNS).orderBy(position_order(F.col("position")), "rank")

    def optimize(self, request: Request = Request()) -> DataFrame:
        """Roster rows of all variants in pool order; FileNotFoundError without a pool, DefenseNotFound without the defense."""
        pool = self.pool()
        if pool.isEmpty():
            raise FileNotFoundError(f"no pool of {self.year}, week {self.week}")
        if request.dst and candidates(pool, request_rows(self.spark, [request])).where("not dst_missing").isEmpty():
            raise DefenseNotFound(request.dst)
        return optimal_lineups(pool, [request]).orderBy("variant", "idx")

    def lineups_json(self, request: Request = Request()) -> DataFrame:
        """variant, json: each roster as a JSON array of records of the pool columns."""
        rows = optimal_lineups(self.pool(), [request]).select("variant", "idx", *POOL_COLUMNS)
        return records(rows, ["variant"], [F.col("idx")], POOL_COLUMNS)
