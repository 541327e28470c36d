"""Results as folders of Parquet, text and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seepage.operators.geometry import area, block_order, circle
from seepage.operators.metrics import merge_incremental
from seepage.operators.ordering import placed, quantiles
from seepage.sources.publish import readable, replace_folder
from seepage.storage import stage


def save_results(corrected: DataFrame, diagnostics: DataFrame, prefix: str) -> None:
    """O-110: {prefix}_corrected as Parquet, {prefix}_diagnostics as one JSON line."""
    corrected.write.mode("overwrite").parquet(f"{prefix}_corrected")
    diagnostics.coalesce(1).write.mode("overwrite").json(f"{prefix}_diagnostics")


def save_annotated(expr: DataFrame, cells: DataFrame, genes: DataFrame, annotations: DataFrame, path: str) -> None:
    """O-112: x (cells by genes, single precision), obs with annotation or Unknown, var."""
    expr.select("cell_id", "gene_id", F.col("n").cast("float").alias("n")).where("n <> 0").write.mode("overwrite").parquet(f"{path}/x")
    cells.join(annotations, "cell_id", "left").withColumn("annotation", F.coalesce("annotation", F.lit("Unknown"))).write.mode("overwrite").parquet(f"{path}/obs")
    genes.write.mode("overwrite").parquet(f"{path}/var")


def cell_layout(expr: DataFrame, cells: DataFrame, block: float = 256.0) -> dict[str, DataFrame]:
    """O-111: the tables of a cell layout, each numbered from 0 by idx.

    expr (gene_id, cell_id, n), cells (cell_id, cx, cy, area) and, where known, border array<struct<x, y>> and dnb_count. Negative values are clipped, zeros dropped,
    counts rounded half to even; counts over 65535 raise. Cells lie in order of their block, then y, x; expression rows by cell, then gene, and in the
    gene-major copy by gene, then cell. A missing area is that of the border, else the median area, else 100; a missing dnb_count is the area; a
    missing border is a circle of the area. sidecar: the exact values, in the order of cell_exp."""
    rows = expr.where("n > 0").withColumn("count", F.rint("n"))
    rows = rows.withColumn("count", F.when(F.col("count") > 65535, F.raise_error(F.lit("a count exceeds 65535"))).otherwise(F.col("count")).cast("int"))
    known = cells if "border" in cells.columns else cells.withColumn("border", F.lit(None).cast("array<struct<x:double,y:double>>"))
    known = known if "dnb_count" in known.columns else known.withColumn("dnb_count", F.lit(None).cast("long"))
    middle = quantiles(known.where("area > 0"), [], "area", {"middle": 0.5})
    known = known.join(F.broadcast(middle), F.lit(True), "left")
    own = F.when(F.col("area") > 0, F.col("area")).when(F.size("border") >= 3, area("border")).otherwise(F.coalesce("middle", F.lit(100.0)))
    known = known.withColumn("area", F.rint(own.cast("double")).cast("long")).drop("middle")
    known = known.withColumn("dnb_count", F.coalesce("dnb_count", "area")).withColumn("border", F.when(F.size("border") >= 3, F.col("border")).otherwise(circle(F.col("cx"), F.col("cy"), F.col("area"))))
    ordered = stage(block_order(known, block), "layout-cells")
    entries = stage(rows.join(ordered.select("cell_id", "pos"), "cell_id").select(F.col("pos").alias("cell"), F.col("gene_id").cast("long").alias("gene_id"), "count", F.col("n").cast("float").alias("value")), "layout-rows")
    each = entries.groupBy("cell").agg(F.count("*").alias("gene_count"), F.sum("count").alias("exp_count"))
    full = ordered.join(each.withColumnRenamed("cell", "pos"), "pos", "left").fillna(0, ["gene_count", "exp_count"])
    cell = placed(full, ["pos"], "idx", {"offset": "gene_count"}).drop("pos")
    genes = entries.groupBy("gene_id").agg(F.count("*").alias("cell_count"), F.sum("count").alias("exp_count"), F.max("count").alias("max_count"))
    gene = placed(genes, ["gene_id"], "place", {"offset": "cell_count"}).drop("place")
    by_cell = placed(entries, ["cell", "gene_id"], "idx")
    return {"cell": cell, "gene": gene, "cell_exp": by_cell.select("idx", "cell", "gene_id", "count"), "gene_exp": placed(entries, ["gene_id", "cell"], "idx").select("idx", "gene_id", "cell", "count"), "sidecar": by_cell.select("idx", "gene_id", "value"), "block_index": cell.groupBy(F.floor(F.col("cy") / block).alias("row"), F.floor(F.col("cx") / block).alias("col")).agg(F.min("idx").alias("first"), F.count("*").alias("cells"))}


def save_cell_layout(expr: DataFrame, cells: DataFrame, path: str, block: float = 256.0) -> None:
    """O-111: the tables of cell_layout() as Parquet under path; the sidecar only if a value is no whole number."""
    tables = cell_layout(expr, cells, block)
    if not tables["sidecar"].where("value <> rint(value)").limit(1).count():
        tables.pop("sidecar")
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def save_official_input(expr: DataFrame, genes: DataFrame, spots: DataFrame, path: str) -> None:
    """O-114: what external programs read: counts as coordinate rows, genes, labels and a slide table whose row is y and whose column is x, as CSV."""
    options = {"header": True}
    expr.select("gene_id", "cell_id", "n").write.mode("overwrite").options(**options).csv(f"{path}/counts")
    genes.write.mode("overwrite").options(**options).csv(f"{path}/genes")
    spots.select("barcode", "tissue", F.col("y").alias("row"), F.col("x").alias("col")).write.mode("overwrite").options(**options).csv(f"{path}/slide")


def save_metrics(metrics: DataFrame, path: str, key: str) -> None:
    """O-113: a table of metrics as JSON lines; rows of a key that is there already are replaced, others stay. A writer that dies loses no old row: load_metrics finds them."""
    spark = metrics.sparkSession
    fresh = stage(metrics, "metrics")
    old = readable(spark, path)
    if old:
        fresh = stage(merge_incremental(spark.read.schema(fresh.schema).json(old), fresh, key), "metrics")
    replace_folder(fresh, path, "json")


def load_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The rows that save_metrics put last."""
    return spark.read.json(readable(spark, path) or path)


def save_matrix_market(expr: DataFrame, n_rows: int, n_cols: int, path: str) -> None:
    """O-115: coordinate lines numbered from 1, in part files of one folder: the header is the first line of the first part, so that the parts, one
    after the other in order of their names, are one file that any reader of the format takes."""
    spark = expr.sparkSession
    head = spark.createDataFrame([(f"%%MatrixMarket matrix coordinate real general\n{n_rows} {n_cols} {expr.count()}",)], "value string").coalesce(1)
    entries = expr.select(F.concat_ws(" ", F.col("gene_id") + 1, F.col("cell_id") + 1, "n").alias("value"))
    head.union(entries).write.mode("overwrite").text(path)  # a union keeps the partitions of its first side first
