"""Selections of genes, methods and cells. Top-k operators keep k rows because that is what they are for."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seepage.functions.scalar import ratio
from seepage.operators.metrics import MOMENTS, first_of_highest, moment_sums, paired, pearson
from seepage.operators.ordering import placed
from seepage.storage import stage


def top_improved(improvement: DataFrame, n: int = 10) -> DataFrame:
    """O-65: the n genes of largest positive improvement among those with positive raw correlation; ties: smaller id."""
    return improvement.where("r_raw > 0 and improvement > 0").orderBy(F.desc("improvement"), "gene_id").limit(n)


def ratio_extremes(profiles: DataFrame, a: int, b: int, n: int) -> DataFrame:
    """O-66: (gene_id, ratio, side): the n genes of largest and of smallest mean in group a over b; undefined ratios are out.

    A row for each gene meets in the window."""
    mean = lambda g: F.coalesce(F.sum(F.when(F.col("grp") == g, F.col("mean"))), F.lit(0.0))
    each = profiles.groupBy("gene_id").agg(ratio(mean(a), mean(b)).alias("ratio")).where("ratio is not null")
    up, down = Window.orderBy(F.desc("ratio"), "gene_id"), Window.orderBy("ratio", "gene_id")
    ranked = each.withColumns({"u": F.row_number().over(up), "d": F.row_number().over(down)})
    side = F.when(F.col("u") <= n, "top").when(F.col("d") <= n, "bottom")
    return ranked.select("gene_id", "ratio", side.alias("side")).where("side is not null")


def best_method(scores: DataFrame, scenario: str, method: str, value: str, least: bool = True) -> DataFrame:
    """O-68: (scenario, method, value) of the best value of each scenario; ties: first method in order."""
    key = F.col(value) if least else -F.col(value)
    best = scores.where(F.col(value).isNotNull()).groupBy(scenario).agg(F.min(F.struct(key.alias("k"), F.col(method).alias("m"), F.col(value).alias("v"))).alias("b"))
    return best.select(scenario, F.col("b.m").alias(method), F.col("b.v").alias(value))


def highly_variable(values: DataFrame, n_cells: int, n: int, bins: int = 20) -> DataFrame:
    """O-69: (gene_id, dispersion): log dispersion standardised inside bins of equal width in log mean, largest n first.

    A bin of one gene gives it 1. Values are on the log scale; means and variances are of their exponentials less 1."""
    raw = F.expm1("v")
    stats = values.groupBy("gene_id").agg(F.sum(raw).alias("s"), F.sum(raw * raw).alias("q"))
    mean = F.col("s") / n_cells
    variance = (F.col("q") - F.col("s") * F.col("s") / n_cells) / (n_cells - 1)
    stats = stats.select("gene_id", F.log1p(mean).alias("m"), F.ln(F.when((mean > 0) & (variance > 0), variance / F.when(mean > 0, mean))).alias("d"))
    span = stats.agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    place = F.least(F.floor((F.col("m") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0) * bins), F.lit(bins - 1))
    binned = stats.crossJoin(F.broadcast(span)).withColumn("bin", place)
    w = Window.partitionBy("bin")
    z = F.when(F.count("d").over(w) > 1, F.try_divide(F.col("d") - F.avg("d").over(w), F.stddev_samp("d").over(w))).otherwise(F.lit(1.0))
    return binned.select("gene_id", F.when(F.col("d").isNotNull(), z).alias("dispersion")).where("dispersion is not null").orderBy(F.desc("dispersion"), "gene_id").limit(n)


#: Genes whose means and variances every task of the local regression gets: 16 bytes each.
TREND_GENES = 200_000


def _local_quadratic(x: np.ndarray, y: np.ndarray, at: np.ndarray, span: float) -> np.ndarray:
    """Values at `at` of quadratic fits to the nearest share span of the points (x, y), x sorted, weighed by the tricube of their distance."""
    q = max(min(len(x), 3), int(np.floor(span * len(x) + 1e-9)))
    out = np.empty(len(at))
    for i, x0 in enumerate(at):
        # The q nearest points are a run of x: its start is where the next point is not nearer than its first.
        lo, hi = 0, len(x) - q
        while lo < hi:
            mid = (lo + hi) // 2
            if x0 - x[mid] > x[mid + q] - x0:
                lo = mid + 1
            else:
                hi = mid
        d = x[lo : lo + q] - x0
        h = np.abs(d).max()
        if h <= 0:
            out[i] = y[lo : lo + q].mean()
            continue
        # Ties with the farthest weigh nothing, so that it does not matter which of them are in.
        w = (1 - (np.abs(d) / h) ** 3).clip(0) ** 3
        u, v = d / h, y[lo : lo + q]
        s = [(w * u**k).sum() for k in range(5)]
        t = [(w * v * u**k).sum() for k in range(3)]
        m = np.array([s[0:3], s[1:4], s[2:5]])
        if abs(np.linalg.det(m)) > 1e-12 * s[0] ** 3:
            out[i] = np.linalg.solve(m, t)[0]
        else:
            out[i] = np.linalg.lstsq(m, np.array(t), rcond=1e-9)[0][0]
    return out


def variance_trend(stats: DataFrame, span: float = 0.3) -> DataFrame:
    """(gene_id, mean, variance) -> (gene_id, mean, variance, expected): the standard deviation that genes of that mean have, by a local quadratic regression of log10 variance on log10 mean.

    Genes without variance take no part and get null. A row for each gene: at most TREND_GENES of them, or it raises."""
    known = stage(stats.where("mean > 0 and variance > 0"), "trend")
    n = known.count()
    if n > TREND_GENES:
        raise ValueError(f"a trend over {n} genes; at most {TREND_GENES}")
    rows = known.select(F.log10("mean").alias("x"), F.log10("variance").alias("y")).orderBy("x", "y").collect()
    x, y = (np.array([r[k] for r in rows]) for k in ("x", "y"))

    @F.pandas_udf("double")
    def expected(at: pd.Series) -> pd.Series:
        return pd.Series(10 ** (_local_quadratic(x, y, at.to_numpy(), span) / 2))

    fitted = known.select("gene_id", expected(F.log10("mean")).alias("expected"))
    return stats.join(fitted, "gene_id", "left")


def stabilised_variance(counts: DataFrame, n_cells: int, n: int | None, span: float = 0.3) -> DataFrame:
    """O-69: (gene_id, mean, variance, norm_variance) of the n genes of largest variance after standardising counts by the trend of variance on mean (all genes, if n is None).

    counts (gene_id, cell_id, n), zeros not stored. Standardised values are clipped above the square root of the number of cells. Genes without variance have 0. Ties: smaller id."""
    sums = counts.groupBy("gene_id").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    mean = F.col("s") / n_cells
    stats = stage(sums.select("gene_id", mean.alias("mean"), F.greatest((F.col("q") - F.col("s") * mean) / (n_cells - 1), F.lit(0.0)).alias("variance")), "gene-stats")
    trend = stage(variance_trend(stats, span), "trend")
    z = F.least((F.col("n") - F.col("mean")) / F.col("expected"), F.lit(math.sqrt(n_cells)))
    held = counts.join(trend.where("expected > 0").select("gene_id", "mean", "expected"), "gene_id")
    held = held.groupBy("gene_id").agg(F.sum(z * z).alias("zz"), F.count("*").alias("stored"))
    zero = F.col("mean") / F.col("expected")
    value = (F.col("zz") + (n_cells - F.col("stored")) * zero * zero) / (n_cells - 1)
    out = trend.join(held, "gene_id", "left").select("gene_id", "mean", "variance", F.coalesce(value, F.lit(0.0)).alias("norm_variance"))
    return out if n is None else out.orderBy(F.desc("norm_variance"), "gene_id").limit(n)


def first_types(weights: DataFrame, key: str, kind: str, value: str) -> DataFrame:
    """O-99: (key, first_type, score_delta): the kind of largest value (ties: smaller) and its lead over the least."""
    best = weights.groupBy(key).agg(first_of_highest(kind, value).alias("first_type"), F.max(value).alias("most"), F.min(value).alias("least"))
    return best.select(key, "first_type", (F.col("most") - F.col("least")).alias("score_delta"))


def sample_per_group(members: DataFrame, group: str, key: str, least: int, most: int, seed: int) -> DataFrame:
    """O-101: groups of at least least members, at most most of each, in order of a digest of key and seed."""
    order = F.md5(F.concat_ws("_", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    sizes = members.groupBy(group).agg(F.count("*").alias("size")).where(F.col("size") >= least)
    ranked = members.join(sizes, group).withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(order, key)))
    return ranked.where(F.col("rank") <= most).drop("rank", "size")


def alignment(table: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """O-19: one row (n_duplicate, n_missing, n_extra) about the keys of a table against those expected."""
    found = table.groupBy(key).agg(F.count("*").alias("n"))
    both = found.join(expected.select(key).distinct().withColumn("want", F.lit(1)), key, "full")
    return both.agg(F.count_if(F.col("n") > 1).alias("n_duplicate"), F.count_if(F.col("n").isNull()).alias("n_missing"), F.count_if(F.col("want").isNull()).alias("n_extra"))


def compare(a: DataFrame, b: DataFrame, n_genes: int, n_cells: int, column: str = "n") -> DataFrame:
    """O-92: one row (pearson, spearman, rmse, cell_pearson) of two matrices of n_genes x n_cells."""
    both = paired(a, b, ["cell_id", "gene_id"], column, column)
    size = float(n_genes * n_cells)
    whole = both.agg(*moment_sums()).select(pearson(F.lit(size), *(F.col(m) for m in MOMENTS)).alias("pearson"), F.sqrt(F.col("sdd") / size).alias("rmse"))
    cells = both.groupBy("cell_id").agg(*moment_sums()).select(pearson(F.lit(float(n_genes)), *(F.col(m) for m in MOMENTS)).alias("r"))
    ranked = ranks_with_zeros(both.select("cell_id", "gene_id", F.col("x").alias("v")), size).withColumnRenamed("rank_", "x")
    ranked = ranked.join(ranks_with_zeros(both.select("cell_id", "gene_id", F.col("y").alias("v")), size).withColumnRenamed("rank_", "y"), ["cell_id", "gene_id"])
    sums = ranked.agg(F.count("*").alias("stored"), *moment_sums())
    zeros = zero_rank(both.select(F.col("x").alias("v")), size).select(F.col("rank_").alias("zx")).crossJoin(zero_rank(both.select(F.col("y").alias("v")), size).select(F.col("rank_").alias("zy")))
    s, rest = sums.crossJoin(zeros), F.lit(size) - F.col("stored")
    x, y = F.col("zx"), F.col("zy")
    spearman = s.select(pearson(F.lit(size), F.col("sx") + rest * x, F.col("sy") + rest * y, F.col("sxx") + rest * x * x, F.col("syy") + rest * y * y, F.col("sxy") + rest * x * y).alias("spearman"))
    return whole.crossJoin(spearman).crossJoin(cells.agg(F.avg("r").alias("cell_pearson"))).select("pearson", "spearman", "rmse", "cell_pearson")


def value_ranks(values: DataFrame, size: float) -> DataFrame:
    """(v, rank_): the mean rank of each distinct value among size elements, those without a row being 0."""
    missing = values.agg((F.lit(size) - F.count("*")).cast("long").alias("c")).select(F.lit(0.0).alias("v"), "c")
    counts = values.groupBy("v").agg(F.count("*").alias("c")).unionByName(missing).groupBy("v").agg(F.sum("c").alias("c"))
    return placed(counts, ["v"], "place_", {"before_": "c"}).select("v", (F.col("before_") + (F.col("c") + 1) / 2).alias("rank_"))


def ranks_with_zeros(rows: DataFrame, size: float) -> DataFrame:
    """rows (cell_id, gene_id, v) -> (cell_id, gene_id, rank_)."""
    return rows.join(value_ranks(rows.select("v"), size), "v").drop("v")


def zero_rank(values: DataFrame, size: float) -> DataFrame:
    return value_ranks(values, size).where("v = 0").select("rank_")


def corrected_genes(fit: DataFrame, threshold: float) -> DataFrame:
    """O-144: (gene_id) of the genes whose goodness of fit reaches the threshold."""
    return fit.where(F.col("r2") >= threshold).select("gene_id")


def method_wins(best: DataFrame, method: str) -> DataFrame:
    """O-68: (method, wins): how many scenarios each method is the best of."""
    return best.groupBy(method).agg(F.count("*").alias("wins"))


def checked_shares(rows: DataFrame, methods: list[str], least: int = 1000) -> DataFrame:
    """O-100: (method, n_cells, n_singlet, pct_singlet) in the order of methods. Raises unless there is one row for each of the methods, all with the
    same number of cells, at least least, and shares that follow from the counts. Methods are few."""
    found = rows.select("method", "n_cells", "n_singlet", "pct_singlet").limit(10 * len(methods) + 10).collect()
    if sorted(r.method for r in found) != sorted(methods):
        raise ValueError(f"expected one row for each of {sorted(methods)}")
    if len({r.n_cells for r in found}) != 1 or found[0].n_cells < least:
        raise ValueError("every method needs the same, large enough number of cells")
    if any(abs(r.pct_singlet - 100 * r.n_singlet / r.n_cells) > 1e-10 for r in found):
        raise ValueError("pct_singlet does not match n_singlet / n_cells")
    return rows.orderBy(F.array_position(F.array(*map(F.lit, methods)), F.col("method"))).select("method", "n_cells", "n_singlet", "pct_singlet")
