"""A layout on disk for windows: places in the order of an interleaved x-y key, so that a row group covers a small box and its statistics tell whether a window needs it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seepage.operators.aggregate import window_filter
from seepage.schema import SpatialDataset
from seepage.storage import stage

#: Steps along each axis are 2 ** BITS.
BITS = 16
#: Shifts and masks that put a zero between any two bits of a number below 2 ** 16.
SPREAD = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))


def _spread(c: Column) -> Column:
    for shift, mask in SPREAD:
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return c


def interleaved(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """The key of a place in box (x from, x to, y from, y to): the bits of its steps along x and y in turn."""
    step = lambda c, lo, hi: F.floor((c - lo) / max(hi - lo, 1e-300) * (2**BITS - 1)).cast("long")
    return _spread(step(x, *box[:2])).bitwiseOR(F.shiftleft(_spread(step(y, *box[2:])), 1))


def _write(df: DataFrame, keys: list[str], path: str, group_bytes: int) -> None:
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("key_")
    ordered.write.option("parquet.block.size", group_bytes).option("parquet.page.row.count.limit", 4096).parquet(path)


def save_layout(d: SpatialDataset, path: str, group_bytes: int = 16 << 20) -> None:
    """O-13, O-25: spots, and counts with their spots' coordinates, range-partitioned and sorted by the key. An empty data set is written as empty tables.

    Spots whose coordinates are null or not finite lie in no window and come first."""
    finite = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c))
    ends = d.spots.agg(F.min(finite("x")), F.max(finite("x")), F.min(finite("y")), F.max(finite("y"))).first()
    box = tuple(0.0 if e is None else float(e) for e in ends)
    spots = stage(d.spots.withColumn("key_", interleaved(finite("x"), finite("y"), box)), "layout-spots")
    _write(spots, ["key_", "spot_id"], f"{path}/spots", group_bytes)
    placed = d.counts.select("gene_id", "spot_id", "n").join(spots.select("spot_id", "x", "y", "key_"), "spot_id")
    _write(placed, ["key_", "spot_id", "gene_id"], f"{path}/counts", group_bytes)
    for name in ("genes", "cells"):
        if getattr(d, name) is not None:
            getattr(d, name).write.parquet(f"{path}/{name}")


def read_layout(spark: SparkSession, path: str, x_range: tuple[float, float] | None = None, y_range: tuple[float, float] | None = None) -> SpatialDataset:
    """The spots inside a window, both ends included, and their counts. The window reaches both scans, so that row groups and pages outside it aren't read."""
    everything = (float("-inf"), float("inf"))
    crop = lambda df: df if x_range is None and y_range is None else window_filter(df, x_range or everything, y_range or everything)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = {s.getPath().getName() for s in jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(jvm_path)}
    named = {name: spark.read.parquet(f"{path}/{name}") for name in ("genes", "cells") if name in there}
    counts = crop(spark.read.parquet(f"{path}/counts")).select("gene_id", "spot_id", "n")
    return SpatialDataset(crop(spark.read.parquet(f"{path}/spots")), counts, named.get("genes"), named.get("cells"))
