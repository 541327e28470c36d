"""Polygons, labels and layouts of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seepage.operators.ordering import placed, quantiles


def contains(px: Column, py: Column, border: Column) -> Column:
    """O-28: even-odd test of a point against border array<struct<x, y>>, folded over its edges."""
    n = F.size(border)

    def edge(inside: Column, i: Column) -> Column:
        a, b = F.get(border, i), F.get(border, (i + n - 1) % n)
        apart = (a["y"] > py) != (b["y"] > py)
        cross = (b["x"] - a["x"]) * (py - a["y"]) / F.when(b["y"] == a["y"], F.lit(1.0)).otherwise(b["y"] - a["y"]) + a["x"]
        return inside != (apart & (px < cross))

    return F.when(n < 3, F.lit(False)).otherwise(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), edge))


def label_points(points: DataFrame, borders: DataFrame, tile: float | None = None) -> DataFrame:
    """O-27: points (spot_id, x, y) and borders (cell_id, cx, cy, border) -> (spot_id, x, y, cell_id), -1 outside all cells.

    Borders go to the tiles that their bounding box meets (tile side: twice the median box width, one number);
    of several cells the nearest centre wins, ties to the smaller id."""
    box = borders.where(F.size("border") >= 3)
    part = lambda axis: F.transform("border", lambda p: p[axis])
    box = box.select("cell_id", "cx", "cy", "border", *(f(part(a)).alias(f"{n}_{a}") for a in "xy" for n, f in (("lo", F.array_min), ("hi", F.array_max))))
    if tile is None:
        width = quantiles(box.select((F.col("hi_x") - F.col("lo_x")).alias("w")), [], "w", {"w": 0.5}).first()
        width = width["w"] if width else None
        tile = max(2 * (width or 1.0), 1e-9)
    at = lambda c: F.floor(F.col(c) / tile)
    spread = box.withColumn("tx", F.explode(F.sequence(at("lo_x"), at("hi_x")))).withColumn("ty", F.explode(F.sequence(at("lo_y"), at("hi_y"))))
    near = points.withColumns({"tx": at("x"), "ty": at("y")}).join(spread, ["tx", "ty"])
    near = near.where(F.col("x").between(F.col("lo_x"), F.col("hi_x")) & F.col("y").between(F.col("lo_y"), F.col("hi_y")))
    hits = near.where(contains(F.col("x"), F.col("y"), F.col("border")))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    best = hits.groupBy("spot_id").agg(F.min(F.struct((dx * dx + dy * dy).alias("d2"), "cell_id")).alias("b")).select("spot_id", "b.cell_id")
    return points.join(best, "spot_id", "left").withColumn("cell_id", F.coalesce("cell_id", F.lit(-1).cast("long")))


def area(border: Column) -> Column:
    """O-73: shoelace area, rounded half to even."""
    n = F.size(border)
    cross = lambda s, i: s + F.get(border, i)["x"] * F.get(border, (i + 1) % n)["y"] - F.get(border, (i + 1) % n)["x"] * F.get(border, i)["y"]
    return F.when(n < 3, F.lit(0.0)).otherwise(F.rint(F.abs(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), cross)) / 2))


def circle(cx: Column, cy: Column, cell_area: Column, points: int = 32) -> Column:
    """O-73: a border for a cell that has none: a circle of its area."""
    radius = F.sqrt(cell_area / F.pi())
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.struct((cx + radius * F.cos(i * (2 * F.pi() / points))).alias("x"), (cy + radius * F.sin(i * (2 * F.pi() / points))).alias("y")))


def to_relative(border: Column, cx: Column, cy: Column, scale: float, points: int = 32) -> Column:
    """O-30: int16 offsets from the centre in storage units, padded with 32767."""
    clip = lambda v: F.least(F.greatest(F.rint(v), F.lit(-32766.0)), F.lit(32766.0)).cast("smallint")
    own = F.transform(F.slice(border, 1, points), lambda p: F.struct(clip((p["x"] - cx) / scale).alias("x"), clip((p["y"] - cy) / scale).alias("y")))
    pad = F.array_repeat(F.struct(F.lit(32767).cast("smallint").alias("x"), F.lit(32767).cast("smallint").alias("y")), points)
    return F.slice(F.concat(own, pad), 1, points)


def to_absolute(relative: Column, cx: Column, cy: Column, scale: float) -> Column:
    """O-30: the border in coordinates, without padding."""
    own = F.filter(relative, lambda p: (p["x"] != 32767) & (p["y"] != 32767))
    return F.transform(own, lambda p: F.struct((cx + p["x"] * scale).alias("x"), (cy + p["y"] * scale).alias("y")))


def union_spots(cells: DataFrame, bins: DataFrame) -> DataFrame:
    """O-102: cells and background bins as one list of spots (barcode, x, y, tissue)."""
    a = cells.select(F.concat(F.lit("cell_"), F.col("cell_id").cast("string")).alias("barcode"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.lit(1).alias("tissue"))
    b = bins.select(F.concat(F.lit("background_"), F.col("bin_id").cast("string")).alias("barcode"), F.col("bx").alias("x"), F.col("by").alias("y"), F.lit(0).alias("tissue"))
    return a.unionByName(b)


def contiguous_labels(spots: DataFrame) -> DataFrame:
    """O-103: adds cell_index, labels numbered from 0 in order; -1 outside."""
    index = placed(spots.where("label >= 0").select("label").distinct(), ["label"], "cell_index")
    return spots.join(index, "label", "left").withColumn("cell_index", F.coalesce("cell_index", F.lit(-1).cast("long")))


def block_order(cells: DataFrame, block: float) -> DataFrame:
    """O-67: adds pos, the place of a cell in order of its block (rows first), then y, x."""
    return placed(cells, [F.floor(F.col("cy") / block), F.floor(F.col("cx") / block), "cy", "cx", "cell_id"], "pos")


def cell_offsets(cell_expr: DataFrame) -> DataFrame:
    """O-111: (cell_id, gene_count, exp_count, offset) of expression rows laid out by cell."""
    each = cell_expr.groupBy("cell_id").agg(F.count("*").alias("gene_count"), F.sum("n").cast("long").alias("exp_count"))
    return placed(each, ["cell_id"], "place_", {"offset": "gene_count"}).drop("place_")
