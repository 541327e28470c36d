"""Range joins on tiles: an equi-join on tile numbers with a distance filter, in place of a theta join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tile_join(a: DataFrame, b: DataFrame, radius: float, a_xy: tuple[str, str], b_xy: tuple[str, str], keys: list[str] = ()) -> DataFrame:
    """O-31: all pairs of rows at a distance d <= radius, once each. Column names of a and b must differ but for keys, which both have and which pairs agree in.

    Tiles have the radius as side; b goes to its 3 x 3 tiles, so each pair meets in a's tile only. Dense tiles are
    left to adaptive skew joins."""
    if radius <= 0:
        raise ValueError("radius must be positive")
    tile = lambda c: F.floor(F.col(c) / radius).cast("long")
    left = a.withColumns({"tx": tile(a_xy[0]), "ty": tile(a_xy[1])})
    near = F.array(*(F.struct((tile(b_xy[0]) + i).alias("tx"), (tile(b_xy[1]) + j).alias("ty")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    right = b.withColumn("tile", F.explode(near)).select(*b.columns, "tile.tx", "tile.ty")
    dx, dy = F.col(a_xy[0]) - F.col(b_xy[0]), F.col(a_xy[1]) - F.col(b_xy[1])
    pairs = left.join(right, [*keys, "tx", "ty"]).withColumn("d2", dx * dx + dy * dy).where(F.col("d2") <= radius * radius)
    return pairs.withColumn("d", F.sqrt("d2")).drop("tx", "ty", "d2")


def bin_cell_edges(bin_table: DataFrame, cell_table: DataFrame, radius: float) -> DataFrame:
    """O-33: (bin_id, cell_id, bin_area, d)."""
    left = bin_table.select("bin_id", F.col("area").alias("bin_area"), "bx", "by")
    return tile_join(left, cell_table.select("cell_id", "cx", "cy"), radius, ("bx", "by"), ("cx", "cy")).select("bin_id", "cell_id", "bin_area", "d")


def cell_cell_edges(cell_table: DataFrame, radius: float) -> DataFrame:
    """O-32, O-34: (dst, src, d), both directions, without loops."""
    left = cell_table.select(F.col("cell_id").alias("dst"), F.col("cx").alias("ax"), F.col("cy").alias("ay"))
    right = cell_table.select(F.col("cell_id").alias("src"), F.col("cx").alias("bx"), F.col("cy").alias("by"))
    return tile_join(left, right, radius, ("ax", "ay"), ("bx", "by")).where("dst <> src").select("dst", "src", "d")


def neighbour_flags(cell_table: DataFrame, sources: DataFrame, radius: float) -> DataFrame:
    """O-35: (cell_id, category): source, neighbour of a source within radius, or other. sources: (cell_id)."""
    points = cell_table.join(sources.select("cell_id").distinct(), "cell_id", "left_semi").select(F.col("cell_id").alias("source_id"), F.col("cx").alias("sx"), F.col("cy").alias("sy"))
    near = tile_join(cell_table.select("cell_id", "cx", "cy"), points, radius, ("cx", "cy"), ("sx", "sy"))
    near = near.groupBy("cell_id").agg(F.max(F.col("cell_id") == F.col("source_id")).alias("own"))
    category = F.when(F.col("own"), "source").when(F.col("own").isNotNull(), "neighbour").otherwise("other")
    return cell_table.select("cell_id").join(near, "cell_id", "left").select("cell_id", category.alias("category"))


def nearest_within(targets: DataFrame, points: DataFrame, largest: float) -> DataFrame:
    """O-36: (point_id, target_id): the nearest target, kept if within its own radius; ties: smaller id.

    targets (target_id, tx_, ty_, radius), points (point_id, px, py); no radius is over largest."""
    pairs = tile_join(points, targets, largest, ("px", "py"), ("tx_", "ty_"))
    best = pairs.groupBy("point_id").agg(F.min(F.struct("d", "target_id", "radius")).alias("b"))
    return best.where("b.d <= b.radius").select("point_id", "b.target_id")


def core_halo(points: DataFrame, x_edges: list[float], y_edges: list[float], halo: float) -> DataFrame:
    """O-37: (id, col, row, is_core): every tile whose bounds grown by halo hold the point; exactly one of them is its core.

    Inner edges alone decide on the core, and a point on one belongs to the tile after it. Points outside the outer edges raise. With a column
    tissue of 1 and 0, that holds for points of 1; the others are context only: no tile is their core, and they may lie outside.
    A point's few tile numbers come from its place by a binary search over the edges' list, so no point meets all tiles."""
    nx, ny = len(x_edges) - 1, len(y_edges) - 1
    if nx < 1 or ny < 1:
        raise ValueError("edges must bound at least one tile")
    out_of = lambda c, e: (F.col(c) < e[0]) | (F.col(c) > e[-1]) | F.col(c).isNull()
    tissue = F.col("tissue") == 1 if "tissue" in points.columns else F.lit(True)
    checked = points.withColumn("tissue_", tissue).withColumn("x", F.when(F.col("tissue_") & (out_of("x", x_edges) | out_of("y", y_edges)), F.raise_error(F.lit("points fall outside the tile bounds"))).otherwise(F.col("x")))
    below = lambda value, e, strict: F.size(F.filter(F.array(*(F.lit(float(x)) for x in e)), (lambda x: x < value) if strict else (lambda x: x <= value)))

    def spans(c: str, e: list[float], n: int) -> tuple[Column, Column]:
        own = F.least(below(F.col(c), e[1:-1], False), F.lit(n - 1)) if n > 1 else F.lit(0)
        low = F.greatest(below(F.col(c) - halo, e[1:], True), F.lit(0))  # tiles whose upper bound is at least c - halo
        high = F.least(below(F.col(c) + halo, e[:-1], False) - 1, F.lit(n - 1))  # tiles whose lower bound is at most c + halo
        return own, F.when(low <= high, F.sequence(low, F.greatest(low, high)))

    (ox, sx), (oy, sy) = spans("x", x_edges, nx), spans("y", y_edges, ny)
    wide = checked.select("id", "tissue_", ox.alias("ox"), oy.alias("oy"), F.explode(sx).alias("col"), sy.alias("sy")).withColumn("row", F.explode("sy"))
    return wide.select("id", "col", "row", (F.col("tissue_") & (F.col("col") == F.col("ox")) & (F.col("row") == F.col("oy"))).alias("is_core"))


def stitch(tiles: DataFrame, specs: DataFrame) -> DataFrame:
    """O-118: results of tiles (col, row, id, ...) -> the rows of each id from its core tile; specs come from core_halo."""
    return tiles.join(specs.where("is_core").select("id", "col", "row"), ["id", "col", "row"]).drop("col", "row")
