"""python -m rosterlake POOLS [--year Y] [--week W] [--dst NAME] [--one-te] [--exclude NAME]... [--include NAME]...

Prints the three rosters of a week with their points, salary and what is left of the cap."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import staging
from .functions import text
from .operators.locks import DefenseNotFound, Request
from .plans.lineups import RosterService, totals


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="rosterlake", description="Best rosters of a week.")
    parser.add_argument("pools", help="CSV pools, as a path or pattern of files *_{year}_w{week}.csv")
    parser.add_argument("--year", type=int)
    parser.add_argument("--week", type=int)
    parser.add_argument("--dst", help="defense to lock, by name or pattern")
    parser.add_argument("--one-te", action="store_true", help="no second tight end")
    parser.add_argument("--exclude", action="append", default=[], metavar="NAME")
    parser.add_argument("--include", action="append", default=[], metavar="NAME")
    return parser.parse_args(given)


def shown(lineups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roster rows and totals as they are printed."""
    rows = lineups.select("variant", text.display_position(F.col("position")).alias("position"), "player", "team", "opponent", "salary", text.fixed2(F.col("proj_fpts")).alias("points"))
    sums = totals(lineups).select("variant", text.fixed2(F.col("points")).alias("points"), "salary", "remaining").orderBy("variant")
    return rows, sums


def main(given: list[str] | None = None) -> int:
    asked = arguments(given)
    spark = SparkSession.builder.appName("rosterlake").getOrCreate()
    try:
        service = RosterService(spark, asked.pools, asked.year, asked.week)
        lineups = service.optimize(Request(dst=asked.dst, one_te=asked.one_te, excluded=tuple(asked.exclude), included=tuple(asked.include)))
        print(f"{service.year}, week {service.week}")
        for frame in shown(lineups):
            frame.show(100, truncate=False)
        return 0
    except (DefenseNotFound, FileNotFoundError) as missing:
        print(f"{type(missing).__name__}: {missing}")
        return 1
    finally:
        staging.clear(spark)


if __name__ == "__main__":
    raise SystemExit(main())
