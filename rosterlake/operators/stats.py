"""Statistics pages: renames, key columns, per-game averages, percentages.

All functions take rows of one position's pages with (year, cells array<string>) and the week or week range they cover;
range pages are labelled with the week after the range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schema import ADVANCED, PROJECTIONS, RED_ZONE, SNAPS, STATS, leader_columns
from ..sources.quarantine import Checked, checked, judged_numbers

TEXT = {"player", "team", "position"}


def stats_prefix(column: str) -> str:
    plain = column in ("player", "cmp_perc", "games", "lng", "fpts", "avg_fpts", "rost") or "/" in column
    return column if plain else f"avg_{column}"


def advanced_prefix(column: str) -> str:
    plain = column in ("player", "games", "rtg") or any(x in column for x in ("/", "perc", "lng"))
    return column if plain else f"avg_{column}"


def red_zone_name(column: str) -> str:
    return column if column in ("player", "games", "rost") else f"rz_{column}"


def red_zone_prefix(column: str) -> str:
    name = red_zone_name(column)
    return name if column in ("player", "games", "rost") or "perc" in name or "/" in name else f"avg_{name}"


def renamed(rows: DataFrame, columns: list[str], rename: Callable[[str], str] = str) -> DataFrame:
    """cells by place, numbers as double (null where a cell is no number), percentages still text."""
    out = []
    for i, c in enumerate(columns):
        cell = F.try_element_at("cells", F.lit(i + 1))
        keep_text = c in TEXT or "perc" in c or c == "rost"
        out.append((cell if keep_text else F.trim(F.replace(cell, F.lit(","), F.lit(""))).try_cast("double")).alias(rename(c)))
    return rows.select("year", *out)


def checked_cells(rows: DataFrame, columns: list[str]) -> Checked:
    """Page rows (year, cells) parted into those that `columns` can be read from, and the others with their reason."""
    return checked(judged_numbers(rows, columns, TEXT), "cells")


def keyed(rows: DataFrame, position: str, week: int | Column) -> DataFrame:
    week = F.lit(week) if isinstance(week, int) else week
    return rows.withColumns({"position": F.lit(position.upper()), "season": F.col("year"), "week": week.cast("int")}).drop("year")


def averaged(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.withColumns({c: text.per_game(F.col(f"`{c}`"), F.col("games")) for c in columns})


def percentages(rows: DataFrame, columns: list[str], empty_is_zero: bool = False) -> DataFrame:
    return rows.withColumns({c: text.percent(F.col(c), empty_is_zero) for c in columns})


def bare_player(rows: DataFrame, strip: bool = True) -> DataFrame:
    return rows.withColumn("player", text.before_paren(F.col("player"), strip))


def stats(rows: DataFrame, position: str, weeks: tuple[int, int]) -> DataFrame:
    """Averages per game over weeks (start, end); weeks are required."""
    out = renamed(rows, STATS[position.upper()], stats_prefix)
    totals = [c for c in out.columns if "avg" in c and c != "avg_fpts"]
    return averaged(keyed(percentages(bare_player(out), ["rost"]), position, weeks[1] + 1), totals).drop("fpts")


def weekly_stats(rows: DataFrame, position: str, week: int) -> DataFrame:
    """One week's totals; names keep the blank before the parenthesis."""
    return keyed(bare_player(renamed(rows, STATS[position.upper()]), strip=False), position, week).drop("games", "avg_fpts")


def weekly_projections(rows: DataFrame, position: str, week: int) -> DataFrame:
    """Names lose their last word, the team, but for DST."""
    out = renamed(rows, PROJECTIONS[position.upper()])
    if position.upper() != "DST":
        out = out.withColumn("player", text.without_last_token(F.col("player")))
    return keyed(out, position, week)


def weekly_points(rows: DataFrame, week: int) -> DataFrame:
    """Points of one week from the leaders page; pages of 22 columns are those of 17-week seasons."""

    def pick(weeks: int) -> DataFrame:
        columns = leader_columns(weeks)
        place = lambda c: F.try_element_at("cells", F.lit(columns.index(c) + 1)) if c in columns else F.lit(None).cast("string")
        rows_of = rows.where(F.size("cells") == len(columns))
        return rows_of.select(place("player").alias("player"), place("position").alias("position"), F.col("year").alias("season"), F.lit(week).alias("week"), text.points_cell(place(f"week_{week}")).alias("fpts"))

    return pick(18).unionByName(pick(17)) if week <= 17 else pick(18)


def weekly_advanced(rows: DataFrame, position: str, week: int) -> DataFrame:
    return keyed(bare_player(renamed(rows, ADVANCED[position.upper()])), position, week).drop("games")


def advanced(rows: DataFrame, position: str, weeks: tuple[int, int]) -> DataFrame:
    out = keyed(bare_player(renamed(rows, ADVANCED[position.upper()], advanced_prefix)), position, weeks[1] + 1)
    out = averaged(out, [c for c in out.columns if "avg" in c])
    return percentages(out, {"QB": ["cmp_perc"], "WR": ["tgt_perc"], "TE": ["tgt_perc"]}.get(position.upper(), []), empty_is_zero=True)


def weekly_snaps(rows: DataFrame, position: str, week: int) -> DataFrame:
    return keyed(renamed(rows, SNAPS), position, week).drop("games", "snaps/game")


def snaps(rows: DataFrame, position: str, weeks: tuple[int, int]) -> DataFrame:
    out = keyed(renamed(rows, SNAPS), position, weeks[1] + 1)
    return out.withColumn("avg_fpts", text.per_game(F.col("fpts"), F.col("games"))).drop("snaps", "fpts")


def weekly_red_zone(rows: DataFrame, position: str, week: int) -> DataFrame:
    return keyed(bare_player(renamed(rows, RED_ZONE[position.upper()], red_zone_name)), position, week).drop("games", "rz_fpts/game")


def red_zone(rows: DataFrame, position: str, weeks: tuple[int, int]) -> DataFrame:
    out = keyed(bare_player(renamed(rows, RED_ZONE[position.upper()], red_zone_prefix)), position, weeks[1] + 1)
    out = averaged(out, [c for c in out.columns if "avg" in c])
    own = ["rz_cmp_perc", "rz_rush_perc"] if position.upper() == "QB" else ["rz_rush_perc", "rz_rec_perc", "rz_tgt_perc"]
    return percentages(out, [*own, "rost"]).drop("rz_fpts/game")


def current_week(rows: DataFrame, columns: list[str], default: int | None = 1) -> DataFrame:
    """week: name of the first column that is null in all rows, else the default."""
    counts = rows.agg(*[F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(columns)])
    first = F.coalesce(*[F.when(F.col(str(i)) == 0, F.lit(c)) for i, c in enumerate(columns)])
    return counts.select(F.coalesce(first.try_cast("int"), F.lit(default)).alias("week"))


def trailing_average(weekly: DataFrame, weeks: int = 4) -> DataFrame:
    """avg_fpts over the `weeks` weeks before each row's own, from (player, position, season, week, fpts)."""
    from pyspark.sql import Window

    frame = Window.partitionBy("player", "position", "season").orderBy("week").rangeBetween(-weeks, -1)
    return weekly.withColumn("avg_fpts", text.round1(F.avg("fpts").over(frame)))
