"""What the text operators share: reading, cutting lineage, bounded batches."""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python task holds as one numpy batch, and of rows sent to it at a time.
CHUNK_BYTES, SENT_BYTES = 1_000_000, 4 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers; only workers of a local master may find it as the driver does."""
    root = Path(__file__).resolve().parents[2]
    known = {Path(p).resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p}
    context = spark.sparkContext
    if (_local(context) and root in known) or getattr(context, "_logspark_shipped", False):
        return
    packed = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "logspark"), "zip", root, "logspark")
    context.addPyFile(packed)
    context._logspark_shipped = True


def _local(context: SparkContext) -> bool:
    """Whether tasks run in the driver's own machine and process."""
    return context.master.startswith("local") and not context.master.startswith("local-cluster")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def arrow(df: DataFrame, run: Callable, schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow with this package sent along.

    Rows reach Python in batches of about SENT_BYTES, where the session hasn't set a bound of its own; a worker that
    has ended its task gives its freed memory back, as Spark keeps it for later ones.
    """
    ship(df.sparkSession)
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if bound not in df.sparkSession.conf.getAll:
        df.sparkSession.conf.set(bound, str(SENT_BYTES))

    def run_and_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _release()

    return df.mapInArrow(run_and_release, schema)


def _release() -> None:
    """Free memory that Arrow and the C library hold back (only glibc has malloc_trim)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder that all executors share and read it from there.

    The folder is the session's spark.checkpoint.dir.  Only where that is
    unset on one machine (tests) a temporary folder of its own is set; on a
    cluster that raises ValueError.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not _local(context):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint(eager=True)


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once for a row, also inside nested lambdas."""
    return F.transform(F.array(value), body)[0]


def fold_bucket(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; the id null counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")) % folds


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Arrow batches cut by size: (rows, their texts as UTF-8 bytes, null as None).

    A chunk has one row at least, so a text longer than limit is a chunk alone.
    """
    for batch in batches:
        raw = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary()).to_pylist()
        first, size = 0, 0
        for k, one in enumerate(raw):
            n = len(one or b"")
            if k > first and size + n > limit:
                yield batch.slice(first, k - first), raw[first:k]
                first, size = k, 0
            size += n
        if len(raw) > first:
            yield batch.slice(first), raw[first:]


def schema_of(df: DataFrame, more: str = "") -> T.StructType:
    """df's columns, all nullable, and those of the DDL text `more`."""
    fields = [T.StructField(f.name, f.dataType, True) for f in df.schema.fields]
    return T.StructType(fields + list(T._parse_datatype_string(more).fields if more else []))
