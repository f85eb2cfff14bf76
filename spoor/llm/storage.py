"""Tables that a job writes to the cluster's shared folder to cut lineage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables up to this size, by their files, are broadcast; larger ones are shuffled.
BROADCAST_BYTES = 16 << 20
_open_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a local session (tests) gets a new local one and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, *, keep: bool = False) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: survives lost executors, and its size is known.
    Within a scope() the table goes when the scope ends, unless it is to be kept."""
    path = new_path(df.sparkSession, name)
    if _open_scopes and not keep:
        _open_scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables materialized within are deleted at its end: what is returned must read only kept ones."""
    _open_scopes.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in _open_scopes.pop():
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def byte_size(df: DataFrame) -> int:
    """Spark's own estimate of a table's bytes; exact enough for tables read from files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A table read from files, marked for broadcast if they are at most so large."""
    return F.broadcast(df) if byte_size(df) <= most else df
