"""Shared pieces of the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is absent and Spark runs in one process (tests, a single machine) a local
    temporary folder stands in; on a cluster its absence is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("helixframe.scratch.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="helixframe-")
        spark.conf.set("helixframe.scratch.dir", root)
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and readable after executors are lost."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files that ``written`` made for ``df`` (they must not be needed any more)."""
    for uri in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text"):
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def computed(df: DataFrame, **columns) -> DataFrame:
    """``df`` with columns that are computed once a row, however often later expressions use them.

    The optimizer would put a column's expression into lambdas that read it, to run for each element;
    it does not look through a generator.
    """
    made = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("__made")
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in columns), made).select("*", "__made.*").drop("__made")


def bucketed(df: DataFrame, tag: str, column: str, buckets: int) -> DataFrame:
    """Like ``written``, in buckets by ``column``: later groupings by it need no exchange of this side."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    name = "helixframe_" + path.rsplit("-", 1)[1]
    df.write.bucketBy(buckets, column).option("path", path).saveAsTable(name)
    return spark.table(name)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with none of ``df``'s, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def trim() -> None:
    """Give free memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps it
        pass


def lean(run: Callable) -> Callable:
    """A partition function after which the Python worker, which lives on, gives its free memory back."""

    @functools.wraps(run)
    def wrapped(*args):
        yield from run(*args)
        trim()

    return wrapped
