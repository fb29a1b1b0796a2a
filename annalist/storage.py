"""Where the library's own tables go: the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset and the master is local."""
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir has to name a folder that all executors of {master} share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="annalist-tables-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return f"file://{_own_folder}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it again."""
    path = f"{shared_folder(df.sparkSession)}/annalist-tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    """A path and its file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    place, files = _at(spark, folder)
    return [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """A small file that readers see whole or not at all; FileExistsError if its name is taken."""
    folder, name = path.rsplit("/", 1)
    draft, files = _at(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")
    place, _ = _at(spark, path)
    out = files.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, place, options)
    except Exception as error:
        files.delete(draft, False)
        if "FileAlreadyExists" in str(error):
            raise FileExistsError(path) from error
        raise


def delete(spark: SparkSession, path: str) -> None:
    place, files = _at(spark, path)
    files.delete(place, True)
