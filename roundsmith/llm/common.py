"""Shared plumbing of the corpus operators: durable intermediate tables and Arrow mapping."""

from __future__ import annotations

import ctypes
import gc
import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables written so far by this process.
_WRITTEN = itertools.count(1)


def release(spark: SparkSession) -> None:
    """Lets go, on the driver, of what finished plans and freed arrays still hold.

    A driver that runs many small jobs lets its heap grow towards its limit before it collects, and freed NumPy arrays stay with the
    process; both count as its memory.  Shuffle files and broadcasts of finished plans go as well.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session's ``spark.checkpoint.dir`` names it.

    Only a local session without that setting (tests, notebooks) gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="roundsmith-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str, rows: int | None = None, rows_per_file: int = 8192, release_every: int = 8) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return a scan of it.

    This cuts the lineage durably: a lost executor never forces the work before it to be redone.
    Where a bound of its ``rows`` is known, the table is written by as many tasks as that takes, so that many small tables
    are not many more small files.  The table goes when the driver's JVM ends.  After some tables the driver lets go of what is over.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // rows_per_file)))
    path = f"{shared_folder(spark)}/roundsmith/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    if next(_WRITTEN) % release_every == 0:
        release(spark)
    return spark.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, rows: Callable[[dict[str, list]], dict[str, list]], schema: pa.Schema) -> DataFrame:
    """``mapInArrow`` over column lists: ``rows`` gets and returns a dict of Python lists per batch."""
    ddl = _ddl(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = rows(batch.to_pydict())
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in schema], schema=schema)

    return df.mapInArrow(run, ddl)


def _ddl(schema: pa.Schema):
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(schema)


def text_or_empty(column: str = "text"):
    """A null text counts as the empty text everywhere."""
    return F.coalesce(F.col(column), F.lit(""))
