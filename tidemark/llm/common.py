"""What the operators of this subpackage share: reading, lineage cuts and bounded Arrow batches."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A Python worker holds one slice at a time: so many bytes of texts, rows, and bytes of all columns at the most. A longer single row is a slice of its own.
SLICE_CHARS, SLICE_ROWS, SLICE_BYTES = 2_000_000, 8_192, 32_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session in one process, as in tests, gets one of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        sc = spark.sparkContext
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        where = sc._jsc.sc().getCheckpointDir().get()
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder once and go on from there: lost executors cost no recomputation of what came before."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


_scratch = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that stored() writes inside are removed at the end, but for those to be kept."""
    outer = getattr(_scratch, "paths", None)
    _scratch.paths = mine = []
    _scratch.outer = outer
    try:
        yield
    finally:
        _scratch.paths, _scratch.outer = outer, None
        for path in mine:
            removed(spark, path)


def removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """As cut, but as Parquet: only the columns that are asked for are read again. keep: past the end of scratch()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    paths = getattr(_scratch, "outer" if keep else "paths", None)
    if paths is not None:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Remove a table that stored() wrote; call it when nothing reads it any more."""
    for f in df.inputFiles()[:1]:
        removed(df.sparkSession, f.rpartition("/")[0])


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each has one row, or at most about `most` bytes of texts, SLICE_ROWS rows and SLICE_BYTES bytes in all."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and (held + n > most or i - start >= SLICE_ROWS):
                yield from narrowed(batch.slice(start, i - start))
                start, held = i, 0
            held += int(n)
        yield from narrowed(batch.slice(start))


def narrowed(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Halves of a batch, and halves of those, until each has SLICE_BYTES bytes in all columns or one row."""
    if part.num_rows > 1 and part.nbytes > SLICE_BYTES:
        half = part.num_rows // 2
        yield from narrowed(part.slice(0, half))
        yield from narrowed(part.slice(half))
    else:
        yield part


def gathered(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """As slices(), but small batches are put together too, so that vector code gets long arrays. Every row comes once."""
    held: list[pa.RecordBatch] = []
    size = rows = whole = 0
    for part in slices(batches, text, most):
        n = pc.sum(pc.binary_length(part.column(text))).as_py() or 0
        if held and (size + n > most or rows + part.num_rows > SLICE_ROWS or whole + part.nbytes > SLICE_BYTES):
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size, rows, whole = [], 0, 0, 0
        held.append(part)
        size, rows, whole = size + n, rows + part.num_rows, whole + part.nbytes
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def crc_mod(column: str | Column, m: int) -> Column:
    """crc32 of a key's decimal text, modulo m; NULL keys count as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.encode(F.coalesce(c.cast("string"), F.lit("")), "UTF-8")) % m


def keyed_uniform(*columns: Column) -> Column:
    """A number in [0, 1) that depends on the columns' values only."""
    return (F.xxhash64(*columns).bitwiseAND(F.lit((1 << 52) - 1))).cast("double") / float(1 << 52)
