"""Weekly snapshot files: readers that keep the file's own (year, week), the latest-week rule, and writers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..schema import POOL, SALARY, position_order


def read_snapshots(spark: SparkSession, path: str | list[str], schema: T.StructType, na_words: bool = False) -> DataFrame:
    """CSV files named *_{year}_w{week}.csv, with file_year and file_week. Padded cells and CRLF are trimmed.

    na_words also turns the words NA, None and null into missing values, as lenient readers do."""
    rows = spark.read.schema(schema).csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    if na_words:
        rows = rows.withColumns({f.name: F.when(~F.col(f.name).isin("NA", "N/A", "NaN", "nan", "None", "null", "NULL"), F.col(f.name)) for f in schema if isinstance(f.dataType, T.StringType)})
    name = F.col("_metadata.file_path")
    return rows.select("*", text.year_of_file(name).alias("file_year"), text.week_of_file(name).alias("file_week"))


def read_salaries(spark: SparkSession, path: str) -> DataFrame:
    return read_snapshots(spark, path, SALARY)


def read_pools(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_snapshots(spark, path, POOL)


def latest_week(files: DataFrame, year: int | None = None, policy: str = "mtime") -> DataFrame:
    """One row (year, week) from (path, modified): newest file, or largest (year, week) with policy 'name'.

    Ties go to the larger (year, week); no file gives week 1 of the asked year."""
    rows = files.select(text.year_of_file(F.col("path")).alias("year"), text.week_of_file(F.col("path")).alias("week"), "modified").where("week is not null")
    if year is not None:
        rows = rows.where(F.col("year") == year)
    order = F.struct("modified", "year", "week") if policy == "mtime" else F.struct("year", "week")
    best = rows.agg(F.max_by(F.struct("year", "week"), order).alias("best"))
    return best.select(F.coalesce("best.year", F.lit(year).cast("int")).alias("year"), F.coalesce("best.week", F.lit(1)).alias("week"))


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """path, modified of the files under a pattern, without reading their content."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("modificationTime").alias("modified"))


def files_of(files: DataFrame, year: int, week: int) -> list[str]:
    """Paths of the files (path, modified) of one week, as patterns that match just them; a week has a few."""
    path = F.col("path")
    rows = files.where((text.year_of_file(path) == year) & (text.week_of_file(path) == week)).select("path").orderBy("path").collect()
    return [re.sub(r"([*?\[\]{}\\])", r"\\\1", row["path"]) for row in rows]


def filled(rows: DataFrame) -> DataFrame:
    """Missing values become 0 in every column, '0' in text."""
    return rows.na.fill(0).na.fill("0")


def write_partitioned(rows: DataFrame, path: str, keys: tuple[str, str] = ("file_year", "file_week")) -> None:
    """Replace exactly the (year, week) partitions that rows hold; later scans prune by them."""
    rows.dropDuplicates().repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_snapshots(rows: DataFrame, path: str, prefix: str) -> None:
    """CSV snapshots under path, one folder a (file_year, file_week) whose name ends in {prefix}_{year}_w{week}.csv, so that
    read_salaries and read_pools on `{path}/*` find the week by name. Weeks that rows hold are replaced, others stay."""
    named = rows.withColumn("snapshot", F.format_string(f"{prefix}_%d_w%d.csv", "file_year", "file_week")).drop("file_year", "file_week")
    # Tasks move their own files; until all have, these stay in the folder that a dynamic overwrite stages them in.
    moved = {"partitionOverwriteMode": "dynamic", "mapreduce.fileoutputcommitter.algorithm.version": "2"}
    named.repartition("snapshot").write.mode("overwrite").options(**moved).partitionBy("snapshot").csv(path, header=True)


def export_csv(rows: DataFrame, path: str) -> None:
    """One file for people; a single week has a few hundred rows."""
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)


def records(rows: DataFrame, keys: list[str], order: list, columns: list[str] | None = None) -> DataFrame:
    """keys, json: the rows of each key as one JSON array, in order, with `columns`, or all others. A key's rows are one
    roster or one week's pool."""
    ordered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order) if keys else Window.partitionBy(F.lit(0)).orderBy(*order)))
    body = F.struct(*(columns or [c for c in rows.columns if c not in keys]))
    listed = F.array_sort(F.collect_list(F.struct("_n", body.alias("row"))))
    return ordered.groupBy(*keys).agg(F.to_json(F.transform(listed, lambda x: x["row"])).alias("json"))


def in_order(rows: DataFrame) -> DataFrame:
    """Serving order: position, then rank."""
    return rows.orderBy(position_order(F.col("position")), "rank")
