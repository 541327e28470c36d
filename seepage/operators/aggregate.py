"""Aggregation of spots to cells and to background bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seepage.operators.ordering import quantiles


def cells(spots: DataFrame) -> DataFrame:
    """O-40: (cell_id, area, cx, cy): spot count and mean position of each non-negative label."""
    inside = spots.where("label >= 0")
    return inside.groupBy(F.col("label").alias("cell_id")).agg(F.count("*").alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def cell_expression(spots: DataFrame, counts: DataFrame) -> DataFrame:
    """O-40, O-51: (gene_id, cell_id, n)."""
    inside = spots.where("label >= 0").select("spot_id", F.col("label").alias("cell_id"))
    return counts.join(inside, "spot_id").groupBy("gene_id", "cell_id").agg(F.sum("n").alias("n"))


def empty_bins(spots: DataFrame, bin_size: float) -> DataFrame:
    """O-41: (spot_id, x, y, bin_id) of the spots outside cells, on a grid from their own least corner.

    The grid's extent is one row, so the cross join is with a scalar."""
    if bin_size <= 0:
        raise ValueError("bin_size must be positive")
    empty = spots.where("label < 0").select("spot_id", "x", "y")
    extent = empty.agg(*(f(c).alias(f"{name}_{c}") for c in "xy" for name, f in (("lo", F.min), ("hi", F.max))))
    joined = empty.crossJoin(F.broadcast(extent))
    number = lambda c: F.greatest(F.lit(1).cast("long"), F.ceil((F.col(f"hi_{c}") - F.col(f"lo_{c}")) / bin_size))
    place = lambda c: F.least(F.floor((F.col(c) - F.col(f"lo_{c}")) / bin_size), number(c) - 1)
    return joined.select("spot_id", "x", "y", (place("x") * number("y") + place("y")).cast("long").alias("bin_id"))


def empty_bins_of_sizes(spots: DataFrame, sizes: list[float]) -> DataFrame:
    """O-141: empty_bins for several sizes at once: (bin_size, spot_id, x, y, bin_id)."""
    parts = [empty_bins(spots, size).select(F.lit(float(size)).alias("bin_size"), "*") for size in sizes]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def bins(empty: DataFrame) -> DataFrame:
    """O-41: (bin_id, area, bx, by); only bins with spots exist, and their place is the mean of their spots."""
    return empty.groupBy("bin_id").agg(F.count("*").alias("area"), F.avg("x").alias("bx"), F.avg("y").alias("by"))


def bin_expression(empty: DataFrame, counts: DataFrame) -> DataFrame:
    """O-42: (gene_id, bin_id, y)."""
    return counts.join(empty.select("spot_id", "bin_id"), "spot_id").groupBy("gene_id", "bin_id").agg(F.sum("n").alias("y"))


def gene_ranks(counts: DataFrame, bin_expr: DataFrame, bin_table: DataFrame) -> DataFrame:
    """O-43, O-61: (gene_id, background, rank) of every gene by mean background expression; ties: larger gene_id first.

    A row for each gene meets in the rank window; genes are few beside counts."""
    total = bin_table.agg(F.sum("area").alias("w"))
    background = bin_expr.groupBy("gene_id").agg(F.sum("y").alias("y"))
    genes = counts.select("gene_id").distinct().join(background, "gene_id", "left").crossJoin(F.broadcast(total))
    mean = genes.select("gene_id", (F.coalesce("y", F.lit(0.0)) / F.col("w")).alias("background"))
    order = Window.orderBy(F.desc("background"), F.desc("gene_id"))
    return mean.withColumn("rank", F.row_number().over(order))


def source_rates(cell_expr: DataFrame, cell_table: DataFrame) -> DataFrame:
    """O-45: (gene_id, cell_id, n, area, s), s = n / area, 0 without area."""
    joined = cell_expr.join(cell_table.select("cell_id", "area"), "cell_id")
    return joined.select("gene_id", "cell_id", "n", "area", F.when(F.col("area") > 0, F.col("n") / F.col("area")).otherwise(0.0).alias("s"))


def expression_weights(rates: DataFrame) -> DataFrame:
    """O-49: rates with s replaced by s*s / (s + median of the gene's positive s)."""
    middle = quantiles(rates.where("s > 0"), ["gene_id"], "s", {"median": 0.5})
    joined = rates.join(middle, "gene_id", "left")
    return joined.withColumn("s", F.when(F.col("s") > 0, F.col("s") * F.col("s") / (F.col("s") + F.col("median"))).otherwise(0.0)).drop("median")


def rate_percentiles(rates: DataFrame) -> DataFrame:
    """O-50: (gene_id, p50, p90) of positive rates, interpolated linearly."""
    return quantiles(rates.where("s > 0"), ["gene_id"], "s", {"p50": 0.5, "p90": 0.9})


def window_filter(spots: DataFrame, x_range: tuple[float, float], y_range: tuple[float, float]) -> DataFrame:
    """O-25: spots inside a rectangle, both ends included; reaches the scan as pushed filters."""
    return spots.where(F.col("x").between(*x_range) & F.col("y").between(*y_range))


def shrink_range(x_range: tuple[float, float], y_range: tuple[float, float], n_runs: int, step: int) -> tuple:
    """O-26: a concentric window of side * (1 - step / n_runs)."""
    keep = 1 - step / n_runs
    out = []
    for lo, hi in (x_range, y_range):
        half = (hi - lo) * keep / 2
        out.append(((lo + hi) / 2 - half, (lo + hi) / 2 + half))
    return tuple(out)


def clip(value: Column) -> Column:
    """O-29: negative values become 0; null stays null."""
    return F.when(value < 0, F.lit(0.0)).otherwise(value)
