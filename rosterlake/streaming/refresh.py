"""Incremental snapshots: landed files replace their (year, week) partition; the newest landing wins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import text
from ..sources.snapshots import listed_files, read_snapshots, write_partitioned
from ..staging import staged


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the last by `order`; all of order should tell rows apart."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def newest_files(rows: DataFrame) -> DataFrame:
    """Rows of the newest file of each (file_year, file_week) in a batch."""
    newest = rows.groupBy("file_year", "file_week").agg(F.max(F.struct("modified", "path")).alias("_new"))
    return rows.join(newest, ["file_year", "file_week"]).where(F.struct("modified", "path") == F.col("_new")).drop("_new", "modified", "path")


def taken_files(spark: SparkSession, manifest: str) -> DataFrame:
    """path, modified of the files that refresh_changed has taken; none before the first run."""
    files = T.StructType([T.StructField("path", T.StringType()), T.StructField("modified", T.TimestampType())])
    try:
        return spark.read.schema(files).parquet(manifest)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], files)


def refresh_changed(spark: SparkSession, landing: str, target: str, manifest: str, schema: T.StructType) -> int:
    """Take the files under landing that are new or were overwritten under their own name; returns how many it read.

    A file is known by path and modification time. Of each (year, week) the newest file counts, so a week is written only
    if its newest is not taken yet. The manifest is written last: a run that is cut off is repeated with equal results."""
    files = listed_files(spark, landing).withColumns({"file_year": text.year_of_file(F.col("path")), "file_week": text.week_of_file(F.col("path"))}).where("file_week is not null")
    files = files.join(taken_files(spark, manifest).withColumn("_taken", F.lit(True)), ["path", "modified"], "left")
    new = staged(newest_files(files.withColumn("file", F.struct("path", "modified"))).where("_taken is null").select("file.*"), "landed")
    paths = [r["path"] for r in new.select("path").collect()]  # names of a run's new files, one a week
    if paths:
        write_partitioned(read_snapshots(spark, paths, schema), target)
        new.write.mode("append").parquet(manifest)
    return len(paths)


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LANDED = "file_year int, file_week int, modified timestamp, path string"


class Newest(StatefulProcessor):
    """Keeps, for each (file_year, file_week), the newest landing seen by any run; passes on a landing that is newer still."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "modified long, path string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers: object) -> Iterator[Row]:
        best = max((r["modified"], r["path"]) for r in rows)
        known = self.newest.get() if self.newest.exists() else None
        if known is None or best > (known[0], known[1]):
            self.newest.update(best)
            yield Row(file_year=key[0], file_week=key[1], modified=best[0], path=best[1])

    def close(self) -> None:
        pass


def newest_landings(landings: DataFrame) -> DataFrame:
    """A stream of LANDED -> the stream of those that replace their week: newer by (modified, path) than all before them.

    Of several in one batch the newest counts; an older one that lands late, in whatever later batch or run, passes
    nothing on. State is one row a week, kept in the query's checkpoint, without time-out: a week may be corrected at any
    time. Landings without year or week are no snapshots and are left out."""
    known = landings.where("file_year is not null and file_week is not null and modified is not null")
    known = known.withColumn("modified", F.unix_micros("modified"))  # a number has no time zone on its way through Python
    newest = known.groupBy("file_year", "file_week").transformWithState(Newest(), LANDED.replace("timestamp", "long"), "Update", "None")
    return newest.withColumn("modified", F.timestamp_micros("modified"))


def replace_weeks(landings: DataFrame, target: str, checkpoint: str, read: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Take what has come to the stream since the last run, then stop: each week's rows in target become those of its
    newest landing. `read` gives the rows of a batch's winners, with file_year and file_week. A batch that was cut off is
    repeated: the state goes back with it, and the same partitions are written again."""
    spark = landings.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)

    def write(batch: DataFrame, _: int) -> None:
        winners = staged(batch, "winners")  # read twice: by `read`, and to see whether there are any
        if not winners.isEmpty():
            write_partitioned(read(winners), target)

    stream = newest_landings(landings).writeStream.foreachBatch(write).outputMode("update")
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def landed_files(spark: SparkSession, landing: str) -> DataFrame:
    """LANDED of the files that come to a folder, as a stream; their content is not read. By default the source would pass
    over files a week older than the newest; here a week's first file may be of any age."""
    files = spark.readStream.format("binaryFile").option("maxFileAge", "36500d").schema("path string, modificationTime timestamp, length long, content binary").load(landing)
    return files.select(text.year_of_file(F.col("path")).alias("file_year"), text.week_of_file(F.col("path")).alias("file_week"), F.col("modificationTime").alias("modified"), "path")


def refresh(spark: SparkSession, landing: str, target: str, checkpoint: str, schema: T.StructType) -> StreamingQuery:
    """Take what has landed under new names since the last run (CSV files *_{year}_w{week}.csv), then stop. A file that is
    older than the one its week holds changes nothing, however late it lands. The stream's source knows files by name only:
    where files are overwritten, use refresh_changed."""

    def rows(winners: DataFrame) -> DataFrame:
        paths = [r["path"] for r in winners.select("path").collect()]  # names of a run's new files, one a week
        return read_snapshots(spark, paths, schema)

    return replace_weeks(landed_files(spark, landing), target, checkpoint, rows)
