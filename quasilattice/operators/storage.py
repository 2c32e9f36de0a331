"""Intermediate tables in the folder that driver and executors share.

A written table cuts the lineage and outlives executors. The folder is spark.checkpoint.dir; where that is unset, a local
session, which has one machine, gets a fresh one, and any other is refused. drop_written() frees what a session wrote, when
nothing that it returned is needed any more.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Tables written at once: each is a job of its own, and small ones leave most of a cluster idle.
AT_ONCE = 8
A, B = TypeVar("A"), TypeVar("B")

_PATHS: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_ql_shared_dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = sc._ql_shared_dir = tempfile.mkdtemp(prefix="ql-shared-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _PATHS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_written(spark: SparkSession) -> int:
    """Deletes the tables written by this process for the session's application; how many there were."""
    jvm, paths = spark._jvm, _PATHS.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)


def written(df: DataFrame, name: str, codec: str = "zstd", by: str | None = None) -> DataFrame:
    """df as a Parquet table, read again; by: a column of few values to partition it by, for pruned reads."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, name)
    writer = df.write.option("compression", codec)
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(schema).parquet(path)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df by the hash of columns in as many parts as a shuffle has: for rows that are few bytes and much work, which files of
    a few megabytes would leave to one task. The number is given, so that Spark doesn't join small parts again."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def at_once(spark: SparkSession, f: Callable[[A], B], items: Iterable[A]) -> list[B]:
    """f of each item, in order, AT_ONCE at a time: for jobs that don't depend on each other. The first error is raised."""
    items = list(items)
    if len(items) < 2:
        return [f(x) for x in items]
    with ThreadPoolExecutor(min(AT_ONCE, len(items))) as pool:
        return [x.result() for x in [pool.submit(inheritable_thread_target(spark)(f), x) for x in items]]


def written_all(frames: dict[str, DataFrame], prefix: str) -> dict[str, DataFrame]:
    """written() of independent tables, several at once."""
    if not frames:
        return {}
    spark = next(iter(frames.values())).sparkSession
    return dict(zip(frames, at_once(spark, lambda name: written(frames[name], f"{prefix}-{name}"), frames), strict=True))


def local_table(spark: SparkSession, rows: Iterable[tuple], ddl: str) -> DataFrame:
    """Rows of the driver (a dictionary's) as a relation whose size the planner knows: joins broadcast it only if that is
    small, and don't shuffle the other side by its few keys. createDataFrame(rows) makes one of unknown size."""
    rows, schema = list(rows), StructType.fromDDL(ddl)
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    table = pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, to_arrow_schema(schema), strict=True)], schema=to_arrow_schema(schema))
    return spark.createDataFrame(table, schema)
