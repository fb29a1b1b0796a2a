"""Where intermediate tables go, and small helpers used by several operators.

Lineage is cut by writing a table into the folder the cluster names in ``spark.checkpoint.dir``; every executor and
the driver see that folder, so losing an executor costs only its running tasks.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch that a task gives back at once where it carries whole texts: the JVM holds each such batch outside its heap.
ROWS_GIVEN = 1024
#: Bytes of a batch that a task gets at once, or one row: it lies outside the JVM's heap, and in the Python worker again.
BYTES_GOT = 8 << 20

#: What this worker process keeps for later tasks, by name.
kept: dict[str, Any] = {}

_own_folder: str | None = None
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. A temporary one only where that is unset and the master
    is local (tests); a cluster without the setting is an error, as each executor would write to its own disk."""
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir has to name a folder that all executors of {master} share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="annalist-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return f"file://{_own_folder}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/annalist/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it again: cuts lineage and pins what later steps see."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _folders[table] = path
    return table


def settle_counted(df: DataFrame, name: str, of: Column | None = None) -> tuple[DataFrame, int]:
    """`settle`, and how many rows there are (or for how many `of` holds), counted as they are written."""
    seen = Observation()
    table = settle(df.observe(seen, (F.count(F.lit(1)) if of is None else F.count_if(of)).alias("rows")), name)
    return table, seen.get["rows"]


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of `settle` that no later plan reads."""
    for settled in tables:
        delete_folder(settled.sparkSession, _folders.pop(settled))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of just this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(column(name).cast("string"), F.lit(""))


def in_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of `batch`, ROWS_GIVEN at a time."""
    for at in range(0, batch.num_rows, ROWS_GIVEN):
        yield batch.slice(at, ROWS_GIVEN)


def bound_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python tasks in batches of about BYTES_GOT, unless it is set to smaller ones. All rows are
    handed over: only how many at a time changes."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name)
    if now.startswith("-") or spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > BYTES_GOT:
        spark.conf.set(name, str(BYTES_GOT))


def drop_kept(but: str | None) -> None:
    for name in kept.keys() - {but}:
        del kept[name]


def give_back() -> None:
    """Return what this process has freed to the system: neither Arrow nor the C library does it by itself."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, before which what tasks of other kinds `kept` in this process goes, and after which its free memory goes back. Tasks of all
    stages run in the same few workers, and what these hold counts against their executor."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept(keeps)
        yield from run(batches)
        give_back()

    return tidy
