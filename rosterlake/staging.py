"""Tables written to the folder that driver and executors share.

Every application has one folder of its own under spark.checkpoint.dir, and all that the library stages goes there.
`clear` deletes it once results have been read; results that are read lazily need it until then. `passing` deletes
what is staged inside it, where only what is staged as lasting, or brought to the driver, is needed afterwards.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: Folder of the innermost `passing` that runs, below the application's.
PASSING: ContextVar[str] = ContextVar("passing", default="")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder if Spark runs in this process; on several machines a
    folder of the driver would be another one on each executor, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir has to name a folder that all machines of {master} share")
        folder = "file://" + tempfile.mkdtemp(prefix="rosterlake-shared-")
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/rosterlake/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str, lasting: bool = False) -> str:
    inner = "" if lasting else PASSING.get()
    return f"{run_folder(spark)}{inner}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name, lasting)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside go at the end, but for lasting ones. Inside another `passing` it leaves them to that one."""
    if PASSING.get():
        yield
        return
    token = PASSING.set(f"/passing-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        folder = run_folder(spark) + PASSING.get()
        PASSING.reset(token)
        delete(spark, folder)


def delete(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has staged, in whatever file system it is. Unread results are lost with it."""
    delete(spark, run_folder(spark))
