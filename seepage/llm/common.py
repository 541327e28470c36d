"""Helpers shared by the training-data operators.

Every operator reads whole texts, partitions its work with Spark, and cuts lineage
with Parquet tables written under the shared folder named by spark.checkpoint.dir.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seepage.storage import new_path, stage

#: Texts are handed to numpy in slices of about this many characters, so that a
#: task's memory does not depend on the size of an Arrow batch.
SLICE_CHARS = 2_000_000


#: Write a table to the shared folder and read it back: survives lost executors, ends lineage.
materialize = stage


def bucketed(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """Like materialize, with the files dealt by a column: joins by it alone read the table where it lies and move the other side only.

    A task writes a file for each bucket that it has rows of; rows that a shuffle by the column into as many parts has dealt give one a bucket."""
    table_name = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", new_path(df.sparkSession, name)).option("compression", "zstd").bucketBy(buckets, column).saveAsTable(table_name)
    return df.sparkSession.table(table_name)


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bytes of one Arrow batch that goes to a Python task, so that long texts don't add up.
BATCH_BYTES = 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes; a lower bound stays."""
    with contextlib.suppress(Exception):
        if 0 < int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= BATCH_BYTES:
            return
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def frugal(run):
    """run, for mapInArrow, and then its worker's memory back to the system: Spark keeps idle workers."""

    def outer(batches):
        yield from run(batches)
        give_back()

    return outer


def decided(docs: DataFrame, text_col: str, judge) -> DataFrame:
    """The rows that judge keeps. judge() gives a function from texts to booleans, once a task; only the text column goes to Python."""

    @F.arrow_udf("boolean")
    def keeps(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = judge()
        for part in texts:
            yield pa.array(of(part.to_pylist()), pa.bool_())
        of = None
        give_back()

    return docs.where(keeps(F.col(text_col)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; ids that are null count as the text 'null'."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")) % parts


def runs(sizes: list[int], limit: int):
    """(start, end) runs of items of at most about limit in all; a larger item is a run of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def slices(texts: list, limit: int = SLICE_CHARS):
    return runs([len(t) if t else 0 for t in texts], limit)
