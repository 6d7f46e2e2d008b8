"""The candidate pool: rankings and averages by position, cleaned names, grade filter, salaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schema import POOL_COLUMNS, STRICT_GRADES
from ..sources.snapshots import filled


def with_averages(rankings: DataFrame, averages: DataFrame) -> DataFrame:
    """Left join on the raw name inside a page's position; repeated names on the right repeat rows.

    Null names match each other. The key is the position of the page, not the one a ranking row states."""
    right = averages.select(F.col("position").alias("_position"), F.col("player").alias("_player"), "avg_fpts")
    on = F.col("page_position").eqNullSafe(F.col("_position")) & F.col("player").eqNullSafe(F.col("_player"))
    return rankings.join(right, on, "left").drop("_position", "_player")


def union_positions(parts: list[DataFrame]) -> DataFrame:
    """UNION ALL by name; a part without some column has nulls there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def drop_grades(rows: DataFrame, grades: tuple[str, ...] = STRICT_GRADES) -> DataFrame:
    return rows.where(text.not_in(F.col("grade"), grades))


def with_salaries(rows: DataFrame, salaries: DataFrame) -> DataFrame:
    """Inner join on file_year, file_week, player, position; null keys match each other."""
    keys = ["file_year", "file_week", "player", "position"]
    right = salaries.select(*[F.col(k).alias(f"_{k}") for k in keys], "team", "opponent", "salary")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return rows.join(right, on).drop(*[f"_{k}" for k in keys])


def build_pool(rankings: DataFrame, averages: DataFrame, salaries: DataFrame, grades: tuple[str, ...] = STRICT_GRADES, compat: bool = True, dedupe: bool = True) -> DataFrame:
    """Rankings (with page_position, file_year, file_week) -> the 11 pool columns and the file's year and week."""
    rows = with_averages(rankings, averages)
    rows = rows.withColumn("player", text.clean_player(F.col("player"), F.col("position"), compat))
    rows = filled(with_salaries(drop_grades(rows, grades), salaries).select(*POOL_COLUMNS, "file_year", "file_week"))
    return rows.dropDuplicates() if dedupe else rows
