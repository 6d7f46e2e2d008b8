"""Season, deadline and schedule arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ZONE = "America/New_York"


def season_year(day: Column) -> Column:
    """January and February belong to the season that began the year before."""
    return F.year(day) - F.when(F.month(day).isin(1, 2), 1).otherwise(0)


def next_tuesday_noon(now: Column) -> Column:
    """The coming Tuesday at noon; on a Tuesday before noon, the same day."""
    today = F.to_date(now)
    tuesday = F.when((F.weekday(today) == 1) & (F.hour(now) < 12), today).otherwise(F.next_day(today, "TU"))
    return tuesday.cast("timestamp") + F.expr("INTERVAL 12 HOURS")


def schedule_table(spark: SparkSession) -> DataFrame:
    """job, weekday (Monday 0), hour, zone of every weekly trigger: salaries once, projections hourly on three days."""
    hours = spark.range(10, 21).select(F.col("id").cast("int").alias("hour"))
    days = F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("weekday")
    hourly = hours.select(F.lit("projections").alias("job"), days, "hour")
    return spark.range(1).select(F.lit("salaries").alias("job"), F.lit(1).alias("weekday"), F.lit(9).alias("hour")).unionByName(hourly).withColumn("zone", F.lit(ZONE))


def due(rows: DataFrame, at: str, zone: str | None = None) -> DataFrame:
    """rows with the job whose weekly trigger falls in the hour of their timestamp `at`, one row a job; others are left out.

    With zone, `at` is UTC and is read in that zone; without, it is local time already."""
    local = F.from_utc_timestamp(at, zone) if zone else F.col(at)
    jobs = schedule_table(rows.sparkSession).select("job", F.col("weekday").alias("_weekday"), F.col("hour").alias("_hour"))
    return rows.join(F.broadcast(jobs), (F.weekday(local) == F.col("_weekday")) & (F.hour(local) == F.col("_hour"))).drop("_weekday", "_hour")
