"""Counts that arrive as files: running totals of cells and genes. The reference work is batch; this is for ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seepage.schema import COUNTS
from seepage.storage import stage


def read_counts(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A stream of Parquet counts (gene_id, spot_id, n) from a folder."""
    return spark.readStream.schema(COUNTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_cells(stream: DataFrame, spots: DataFrame) -> DataFrame:
    """(cell_id, library, genes): totals so far of each cell; spots is a static table. State grows with cells, not with rows: for that,
    genes is an approximate distinct count (relative standard deviation 5 %), while library is exact."""
    inside = spots.where("label >= 0").select("spot_id", F.col("label").alias("cell_id"))
    joined = stream.where("n is not null").join(inside, "spot_id")
    return joined.groupBy("cell_id").agg(F.sum("n").alias("library"), F.approx_count_distinct("gene_id").alias("genes"))


def write_latest(totals: DataFrame, path: str, checkpoint: str):
    """Each trigger rewrites the totals of the cells it changed, under a folder for its epoch: a retry overwrites its own folder."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return totals.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


def compact(spark: SparkSession, path: str) -> None:
    """Replace all epochs by one that holds the newest totals of each cell. Run it between triggers, so that latest() need not read every epoch ever written."""
    rows = spark.read.parquet(path)
    last = rows.agg(F.max("epoch")).first()[0]
    stage(latest(spark, path), "totals").write.mode("overwrite").parquet(f"{path}/epoch={last}")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in rows.select("epoch").distinct().where(F.col("epoch") < last).collect():  # a row an epoch
        fs.delete(fs_path(f"{path}/epoch={r['epoch']}"), True)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest totals of each cell."""
    rows = spark.read.parquet(path)
    return rows.groupBy("cell_id").agg(F.max_by(F.struct("library", "genes"), "epoch").alias("t")).select("cell_id", "t.library", "t.genes")
