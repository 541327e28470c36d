"""A spatial data set derived from the orders and lineitem tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seepage.schema import SpatialDataset

WIDTH, PITCH, TILE, RADIUS2 = 120, 2, 16, 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dataset(spark: SparkSession, sf_dir: str) -> SpatialDataset:
    """Orders lie on a grid, with a disc-shaped cell in each tile; a line item's part is its gene."""
    key = F.col("o_orderkey").cast("long")
    placed = table(spark, sf_dir, "orders").select(key.alias("spot_id"), ((key % WIDTH) * PITCH).cast("double").alias("x"), (F.floor(key / WIDTH) * PITCH).cast("double").alias("y"))
    tiled = placed.withColumns({"tx": F.floor(F.col("x") / TILE), "ty": F.floor(F.col("y") / TILE)})
    dx, dy = (F.col(a) - F.col(t) * TILE - TILE / 2 for a, t in (("x", "tx"), ("y", "ty")))
    label = F.when(dx * dx + dy * dy <= RADIUS2, F.col("tx") * 1000 + F.col("ty")).otherwise(F.lit(-1))
    spots = tiled.select("spot_id", "x", "y", label.cast("long").alias("label"))
    items = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 20).cast("long").alias("gene_id"), F.col("l_orderkey").cast("long").alias("spot_id"), F.col("l_quantity").cast("double").alias("n"))
    return SpatialDataset(spots, items.groupBy("gene_id", "spot_id").agg(F.sum("n").alias("n")))
