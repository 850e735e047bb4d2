"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as Spark's and Python's regular expressions write it.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a private one only where none is set, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{_session_dir(spark.sparkContext.applicationId)}"


@cache
def _session_dir(application: str) -> str:
    """A fresh folder of this process for a local session without a shared one; it goes when the process ends."""
    path = tempfile.mkdtemp(prefix=f"kelvora-{application}-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df in the shared folder and read it again: cuts lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """name, or name with underscores where df has such a column, in either case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def words_of(text: str | Column) -> Column:
    """The words of a text (null: none), in order."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(c, F.lit("")), GAP), lambda w: w != "")
