"""Reading log lines with their order."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logspark.functions.patterns import STAMP
from logspark.functions.text import ansi_as_space, strip_cr, utf8_lossy

#: What an order key is: a line's file, its split's offset, and a number that grows within the split.
ORDER_KEY = "struct<file: string, block: bigint, row: bigint>"


def read_log_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    r"""(line, order_key, file_path, file_size) of all lines of text files, split at \n only.

    order_key sorts lines as they stand in their files, files by path: a split's offset and a number that grows
    within it, taken before any shuffle.  An empty last line is not counted.
    """
    return with_keys(spark.read.option("lineSep", "\n").text(paths).select("value", *_metadata()))


def _metadata() -> list[Column]:
    return [F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_block_start", "file_size")]


def with_keys(values: DataFrame) -> DataFrame:
    """read_log_lines' columns from (value, file_path, file_block_start, file_size) as read, before any shuffle."""
    key = F.struct(F.col("file_path").alias("file"), F.col("file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return values.select(utf8_lossy(F.col("value")).alias("line"), key.alias("order_key"), "file_path", "file_size")


def total_bytes(lines: DataFrame) -> DataFrame:
    """One row (n_bytes): the sizes of the files that read_log_lines has read lines from."""
    return lines.groupBy("file_path").agg(F.first("file_size").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_bytes"))


def stream_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of text files as they arrive in a folder."""
    return spark.readStream.option("lineSep", "\n").text(path).select(utf8_lossy(F.col("value")).alias("line"))


def stream_log_files(spark: SparkSession, path: str) -> DataFrame:
    """What with_keys takes, of text files as they arrive in a folder; a batch holds whole files."""
    return spark.readStream.option("lineSep", "\n").text(path).select("value", *_metadata())


# --- order by stamps -------------------------------------------------------------


def line_stamp(line: Column) -> Column:
    """The time that a line begins with, after blanks and terminal codes; null without one, or where it is no date."""
    head = F.regexp_extract(ansi_as_space(strip_cr(line)), rf"\A[ \t]*({STAMP})", 1)
    return F.try_to_timestamp(F.when(head != "", F.substring(head, 1, 19))).cast("timestamp_ntz")


def carried_in_splits(lines: DataFrame, stamp: str = "stamp", key: str = "order_key") -> DataFrame:
    """lines with `stamp` carried on to the lines behind it without one, inside each split; no shuffle.

    The rows must stand as they were read.  Lines at a split's head, before its first stamp, keep null.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    names = lines.columns
    at, of = names.index(stamp), names.index(key)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            stamps, keys = batch.column(at), batch.column(of)
            files, blocks = keys.field("file"), keys.field("block")
            n = batch.num_rows
            same = pc.and_(pc.equal(files[1:], files[:-1]), pc.equal(blocks[1:], blocks[:-1])) if n > 1 else pa.array([], pa.bool_())
            starts = [0, *(k + 1 for k in pc.indices_nonzero(pc.invert(same)).to_pylist())]
            filled = []
            for a, b in zip(starts, [*starts[1:], n], strict=True):
                here = (files[a].as_py(), blocks[a].as_py())
                before = last if here == split else pa.scalar(None, stamps.type)
                part = pc.fill_null_forward(pa.concat_arrays([pa.array([before.as_py()], stamps.type), stamps.slice(a, b - a)])).slice(1)
                filled.append(part)
                split, last = here, part[-1]
            columns = [pa.concat_arrays(filled) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return lines.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in lines.schema.fields]))


def split_ends(carried: DataFrame, stamp: str = "stamp", key: str = "order_key") -> DataFrame:
    """(file, block, head): the stamp for a split's lines before its own first one; one row a split.

    It is the last stamp of the splits before it in its file, or, where none has one, the file's first stamp.
    """
    row = F.when(F.col(stamp).isNotNull(), F.col(f"{key}.row"))
    ends = carried.groupBy(F.col(f"{key}.file").alias("file"), F.col(f"{key}.block").alias("block")).agg(F.min_by(stamp, row).alias("first"), F.max_by(stamp, row).alias("last"))
    order = Window.partitionBy("file").orderBy("block")
    before = F.last("last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("first", ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return ends.select("file", "block", F.coalesce(before, after).alias("head"))


def in_stamp_order(carried: DataFrame, ends: DataFrame, stamp: str = "stamp", key: str = "order_key") -> DataFrame:
    """carried with heads of splits filled from split_ends, and order_key with the stamp before file, block and row.

    Files are put in order by their stamps, whatever their names: a rotated log reads on from file to file, and
    files written side by side interleave.  Lines of one stamp keep their order in a file.
    """
    file, block = F.col(f"{key}.file"), F.col(f"{key}.block")
    joined = carried.join(ends, (file == F.col("file")) & (block == F.col("block")), "left")
    whole = F.coalesce(F.col(stamp), F.col("head"))
    order = F.struct(whole.alias("stamp"), file.alias("file"), block.alias("block"), F.col(f"{key}.row").alias("row"))
    return joined.select(*(whole.alias(stamp) if c == stamp else order.alias(key) if c == key else F.col(f"`{c}`") for c in carried.columns))
