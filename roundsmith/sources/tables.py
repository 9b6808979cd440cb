"""Tables in the folder that all executors share: written once, read by what follows."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Row, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only a local session without it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="roundsmith-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no table has yet; what is there goes when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/roundsmith/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def hand_back(spark: SparkSession) -> None:
    """Executors and the driver collect their garbage, so that their heaps shrink to what they hold.

    A JVM that has sorted keeps its heap near the limit, also while only Python works.  A task per core reaches every executor of
    an idle application; one that is missed only stays as large as it was.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).selectExpr("java_method('java.lang.System', 'gc') AS done").collect()
    slim_driver(spark)


def slim_driver(spark: SparkSession) -> None:
    """The driver collects its garbage: what finished plans held, and the heap that they grew."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settled(parts: list[DataFrame]) -> list[Row]:
    """The single row of each part, each by a plan of its own.

    Spark plans a query again after each of its shuffles; in one plan of all, the driver holds and prints every part each time.
    Two run at a time, so that cores have work while the last tasks of one end.
    """
    with ThreadPoolExecutor(2) as pool:
        rows = list(pool.map(lambda part: part.collect()[0], parts))
    hand_back(parts[0].sparkSession)
    return rows


def make_folders(spark: SparkSession, path: str) -> None:
    """The folders that a table's writer needs, if its path is local: Hadoop forks the driver's JVM for each that it makes itself."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() == "file":
        os.makedirs(f"{place.toUri().getPath()}/_temporary/0/_temporary")


def stored(df: DataFrame, name: str) -> DataFrame:
    """A scan of ``df`` written as Parquet: plans that share it don't repeat the work before it.

    At most one file per core, whatever the number of partitions: for each file that it makes on a local path, Hadoop
    forks the executor's JVM three times, and until the child has become ``chmod`` the executor counts twice.  So the heaps
    are small before the files are made, and again for what follows.  The driver is not forked at all: its folders are made here,
    and no file says that the job is done.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    few = df.coalesce(spark.sparkContext.defaultParallelism)
    # An adaptive plan runs all but its last stage here; the files are made in the last one, from small heaps.
    rows = few._jdf.queryExecution().toRdd()
    hand_back(spark)
    make_folders(spark, path)
    out = DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, few._jdf.schema(), False), spark).write
    out.mode("append").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    hand_back(spark)
    return spark.read.schema(df.schema).parquet(path)
