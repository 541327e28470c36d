"""O-37, O-118: a whole correction made tile by tile, and its tiles put together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seepage.operators import fit as fits
from seepage.operators import graph
from seepage.storage import stage


def correct_by_tiles(rates: DataFrame, cells: DataFrame, fit: DataFrame, scale: float, radius: float, x_edges: list[float], y_edges: list[float], halo: float | None = None, threshold: float = 0.01, metric: str = "exponential", mode: str | None = "quadratic_p90", percentiles: DataFrame | None = None, tiles: list[tuple[int, int]] | None = None) -> DataFrame:
    """(col, row, gene_id, cell_id, n_raw, n_corrected) of each tile's core cells, made from the cells of that tile and its halo alone.

    Scale, coefficients and percentiles are those of the whole sample. Results are kept apart by tile all the way, so that one tile can be made again by itself: pass it in tiles. A halo
    below the radius would lose neighbours and raises, as do cells outside the outer edges."""
    halo = float(radius) if halo is None else float(halo)
    if halo < radius:
        raise ValueError("halo must be at least the radius")
    points = cells.select(F.col("cell_id").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    specs = graph.core_halo(points, x_edges, y_edges, halo)
    if tiles is not None:
        wanted = F.array(*(F.struct(F.lit(int(c)).alias("col"), F.lit(int(r)).alias("row")) for c, r in tiles)) if tiles else F.array().cast("array<struct<col:int,row:int>>")
        specs = specs.where(F.array_contains(wanted, F.struct(F.col("col").cast("int").alias("col"), F.col("row").cast("int").alias("row"))))
    placed = stage(specs.join(points, "id"), "tiles")
    core = placed.where("is_core")
    dst = core.select("col", "row", F.col("id").alias("dst"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    src = placed.select("col", "row", F.col("id").alias("src"), F.col("x").alias("bx"), F.col("y").alias("by"))
    edges = graph.tile_join(dst, src, radius, ("ax", "ay"), ("bx", "by"), ["col", "row"]).where("dst <> src").select("col", "row", "dst", "src", "d")
    inflow = fits.inflow(edges, fits.passing(rates, fit, threshold), scale, metric, ["col", "row"])
    own = rates.join(core.select("col", "row", F.col("id").alias("cell_id")), "cell_id")
    # A cell is the core of one tile, so that tile and cell lead to one row.
    fixed = fits.corrected(own, None, fit, scale, threshold, metric, mode, percentiles, inflow.drop("col", "row"))
    return fixed.join(core.select("col", "row", F.col("id").alias("cell_id")), "cell_id").select("col", "row", "gene_id", "cell_id", "n_raw", "n_corrected")


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Writes tiles as partitions; those that are there already are replaced, all others stay."""
    tiles.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("col", "row").parquet(path)


def stitched(tiles: DataFrame) -> DataFrame:
    """The tiles' core cells as one table."""
    return tiles.drop("col", "row")
