"""The folder that driver and executors share, and tables that cut lineage there."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a session in one process, as in tests, gets a folder of its own where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder beside the session's checkpoints."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_scratch = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that stored() writes inside are removed at the end, but for those to be kept."""
    outer = getattr(_scratch, "paths", None)
    _scratch.paths = mine = []
    try:
        yield
    finally:
        _scratch.paths = outer
        for path in mine:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df written once as Parquet and read from there: lost executors cost no recomputation of what came before. keep: past the end of scratch()."""
    path = folder(df.sparkSession, f"tidemark-{name}")
    paths = getattr(_scratch, "paths", None)
    if paths is not None and not keep:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
