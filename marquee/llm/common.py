"""Helpers shared by the training-data operators: shared-folder tables and word columns."""

from __future__ import annotations

import atexit
import functools
import gc
import shutil
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words for contamination checks: letters, digits and everything beyond ASCII.
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words for counting and shingling: whatever stands between ASCII white space.
SPACE_GAP = r"[\x20\x09-\x0D]+"


@functools.cache
def _local_dir() -> str:
    """One temporary folder for this process, gone at its end."""
    base = tempfile.mkdtemp(prefix="marquee-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"file://{base}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Unset, a temporary folder is used in local mode only; on a cluster that is an error,
    as executors would not see each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_dir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/marquee-{uuid.uuid4().hex[:12]}-{name}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there,
    a lost executor costs a reread only, and later plans do not compute df again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def private(name: str) -> str:
    """A column name that no input has, for columns beside an input's own."""
    return f"_{name}_{uuid.uuid4().hex}"


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of phases that have ended: it does so when the
    driver collects garbage, which may else be long after a phase's result is written. Twice,
    as threads of the job that ended last hold its plan for a moment."""
    for wait in (0.2, 0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(wait)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else (lower() also folds letters beyond ASCII)."""
    return F.translate(text, UPPER, UPPER.lower())


def word_array(text: Column, gap: str) -> Column:
    """The maximal runs of characters outside `gap`; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gap, -1), "")


def crc_mod(column: str, mod: int) -> Column:
    """crc32 of an id as text, modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod
