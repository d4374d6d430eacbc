"""Tables that cut a long lineage, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; only in local mode, where that may be unset, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/graph-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet, with options of Spark's writer, and read it back."""
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_dir(spark: SparkSession, path: str) -> None:
    """Remove a folder, if it is there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def list_dir(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it isn't there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in files.listStatus(target)] if files.exists(target) else []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A scratch folder that goes when the block ends; nothing may read from it afterwards."""
    path = scratch_dir(spark)
    try:
        yield path
    finally:
        drop_dir(spark, path)
