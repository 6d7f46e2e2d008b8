"""Rejected rows: kept with the reason, and counted in the pass that writes them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..staging import staged


@dataclass(frozen=True)
class Checked:
    """Sound rows, and rejected ones with `reason`. counts: rows, sound, rejected, and the distinct reasons (about)."""

    rows: DataFrame
    rejected: DataFrame
    counts: dict[str, int]

    def by_reason(self) -> DataFrame:
        return self.rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def checked(judged: DataFrame, name: str) -> Checked:
    """Part rows by their `reason`, null in sound ones. They are read and written once, and counted on the way."""
    seen = Observation(name)
    bad = F.col("reason").isNotNull()
    counted = judged.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(~bad).alias("sound"), F.count_if(bad).alias("rejected"), F.approx_count_distinct("reason").alias("reasons"))
    rows = staged(counted, f"checked-{name}")
    return Checked(rows.where("reason is null").drop("reason"), rows.where("reason is not null"), dict(seen.get))


def judged_numbers(rows: DataFrame, columns: list[str], texts: set[str]) -> DataFrame:
    """Rows of a statistics page (year, cells) with `reason`: too few cells, no player, or a number cell that is none.

    Empty cells are missing numbers, not wrong ones; percentages may end in %."""
    cell = lambda i: F.trim(F.replace(F.try_element_at("cells", F.lit(i + 1)), F.lit(","), F.lit("")))
    wrong = [F.when((cell(i) != "") & F.btrim(cell(i), F.lit("%")).try_cast("double").isNull(), f"{c} is no number") for i, c in enumerate(columns) if c not in texts]
    player = cell(columns.index("player"))
    return rows.withColumn("reason", F.coalesce(F.when(F.size("cells") < len(columns), "the row has too few cells"), F.when(player.isNull() | (player == ""), "player is empty"), *wrong))
