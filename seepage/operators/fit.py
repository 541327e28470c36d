"""Leakage fit: one distance scale for the sample, one coefficient and goodness of fit for each gene, and the correction.

Missing (gene, bin) pairs are zeros and add nothing to any sum, so sums over stored rows suffice:
alpha = yn / nn, rss = yy - 2 alpha yn + alpha^2 nn, total = sum over all bins of w (y - mean)^2."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seepage.functions.kernels import kernel, penalty

EPS = 1e-15


def kernel_sums(edges: DataFrame, rates: DataFrame, scales: list[float], metric: str = "exponential") -> DataFrame:
    """O-44: (gene_id, bin_id, w, n_0 .. n_k): bin area times the kernel-weighted sum of rates, for all scales in one pass."""
    w = kernel(metric)
    sums = [(F.first("bin_area") * F.sum(w(F.col("d"), F.lit(float(x))) * F.col("s"))).alias(f"n_{i}") for i, x in enumerate(scales)]
    joined = edges.join(rates.select("gene_id", "cell_id", "s"), "cell_id")
    return joined.groupBy("gene_id", "bin_id").agg(F.first("bin_area").alias("w"), *sums)


def moments(pred: DataFrame, bin_expr: DataFrame, count: int) -> DataFrame:
    """(gene_id, nn_i, yn_i): weighted sums of squares and products of predictions and observations, a pair for each scale."""
    joined = pred.join(bin_expr, ["gene_id", "bin_id"], "left").fillna(0.0, ["y"])
    n = lambda i: F.col(f"n_{i}")
    sums = [f for i in range(count) for f in (F.sum(F.col("w") * n(i) * n(i)).alias(f"nn_{i}"), F.sum(F.col("w") * F.col("y") * n(i)).alias(f"yn_{i}"))]
    return joined.groupBy("gene_id").agg(*sums)


def alpha_of(yn: Column, nn: Column) -> Column:
    return F.when(nn > 0, F.greatest(yn / F.when(nn > 0, nn), F.lit(0.0))).otherwise(0.0)


def residual(yy: Column, alpha: Column, yn: Column, nn: Column) -> Column:
    return F.greatest(yy - 2 * alpha * yn + alpha * alpha * nn, F.lit(0.0))


def scale_search(pred: DataFrame | None, bin_expr: DataFrame, bin_table: DataFrame, genes: DataFrame, scales: list[float], known: DataFrame | None = None) -> DataFrame:
    """O-46: (pos, scale, rss) for each scale over the given genes. known: the moments, where pred was not made."""
    known = moments(pred, bin_expr, len(scales)) if known is None else known
    seen = bin_expr.join(genes.select("gene_id"), "gene_id", "left_semi").join(bin_table.select("bin_id", "area"), "bin_id")
    yy = seen.groupBy("gene_id").agg(F.sum(F.col("area") * F.col("y") * F.col("y")).alias("yy"))
    sums = genes.select("gene_id").join(known, "gene_id", "left").join(yy, "gene_id", "left").fillna(0.0)
    entry = lambda i, x: F.struct(F.lit(i).alias("pos"), F.lit(float(x)).alias("scale"), residual(F.col("yy"), alpha_of(F.col(f"yn_{i}"), F.col(f"nn_{i}")), F.col(f"yn_{i}"), F.col(f"nn_{i}")).alias("rss"))
    each = sums.select(F.explode(F.array(*(entry(i, x) for i, x in enumerate(scales)))).alias("e")).select("e.*")
    return each.groupBy("pos", "scale").agg(F.sum("rss").alias("rss"))


def scale_sweep(pred: DataFrame, bin_expr: DataFrame, bin_table: DataFrame, genes: DataFrame, scales: list[float]) -> DataFrame:
    """O-140: (scale, alpha_mean, r2_mean) of the fit at each scale, all from the sums of one pass; genes without variance are left out of the mean of r2."""
    total = bin_table.agg(F.sum("area").cast("double").alias("big"))
    seen = bin_expr.join(bin_table.select("bin_id", "area"), "bin_id")
    first = seen.groupBy("gene_id").agg(F.sum(F.col("area") * F.col("y")).alias("wy"), F.sum(F.col("area") * F.col("y") * F.col("y")).alias("yy"))
    sums = genes.select("gene_id").join(first, "gene_id", "left").join(moments(pred, bin_expr, len(scales)), "gene_id", "left").fillna(0.0).crossJoin(F.broadcast(total))
    spread = F.col("yy") - F.col("wy") * F.col("wy") / F.col("big")

    def entry(i, x):
        alpha = alpha_of(F.col(f"yn_{i}"), F.col(f"nn_{i}"))
        r2 = F.when(spread > EPS, 1 - residual(F.col("yy"), alpha, F.col(f"yn_{i}"), F.col(f"nn_{i}")) / F.when(spread > EPS, spread))
        return F.struct(F.lit(float(x)).alias("scale"), alpha.alias("alpha"), r2.alias("r2"))

    each = sums.select(F.explode(F.array(*(entry(i, x) for i, x in enumerate(scales)))).alias("e")).select("e.*")
    return each.groupBy("scale").agg(F.avg("alpha").alias("alpha_mean"), F.avg("r2").alias("r2_mean"))


def best_scale(search: DataFrame) -> DataFrame:
    """O-46: one row (scale, rss): the least residual; ties: the earlier scale."""
    return search.agg(F.min(F.struct("rss", "pos", "scale")).alias("b")).select("b.scale", "b.rss")


def gene_fit(pred: DataFrame | None, bin_expr: DataFrame, bin_table: DataFrame, ranks: DataFrame, n_high: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """O-47: (gene_id, rank, alpha, r2) of the n_high highest-ranked genes; pred holds the chosen scale as n_0, or known its moments.

    The total sum of squares is summed about the mean, which doesn't cancel. Genes without background get alpha 0, r2 1."""
    known = moments(pred, bin_expr, 1) if known is None else known
    chosen = ranks if n_high is None else ranks.where(F.col("rank") <= n_high)
    total = bin_table.agg(F.sum("area").cast("double").alias("big"))
    seen = bin_expr.join(bin_table.select("bin_id", "area"), "bin_id")
    first = seen.groupBy("gene_id").agg(F.sum(F.col("area") * F.col("y")).alias("wy"), F.sum(F.col("area") * F.col("y") * F.col("y")).alias("yy"), F.sum("area").alias("wa"))
    sums = chosen.select("gene_id", "rank").join(first, "gene_id", "left").join(known, "gene_id", "left").fillna(0).crossJoin(F.broadcast(total))
    mean = sums.withColumn("mean", F.col("wy") / F.col("big"))
    about = seen.join(mean.select("gene_id", "mean"), "gene_id").groupBy("gene_id").agg(F.sum(F.col("area") * (F.col("y") - F.col("mean")) * (F.col("y") - F.col("mean"))).alias("about"))
    full = mean.join(about, "gene_id", "left").fillna(0.0, ["about"])
    alpha = alpha_of(F.col("yn_0"), F.col("nn_0"))
    full = full.withColumns({"alpha": alpha, "tot": F.col("about") + F.col("mean") * F.col("mean") * (F.col("big") - F.col("wa"))})
    full = full.withColumn("rss", residual(F.col("yy"), F.col("alpha"), F.col("yn_0"), F.col("nn_0")))
    r2 = F.when(F.col("tot") > EPS, 1 - F.col("rss") / F.when(F.col("tot") > EPS, F.col("tot"))).when(F.col("rss") > EPS, 0.0).otherwise(1.0)
    return full.select("gene_id", "rank", "alpha", r2.alias("r2"))


def inflow(edges_cc: DataFrame, rates: DataFrame, scale: float, metric: str = "exponential", keys: list[str] = ()) -> DataFrame:
    """O-48: (keys, gene_id, cell_id, inflow): the kernel-weighted sum of the rates of a cell's neighbours. keys: further columns of the edges that results are kept apart by."""
    given = rates.select("gene_id", F.col("cell_id").alias("src"), "s")
    weighted = kernel(metric)(F.col("d"), F.lit(float(scale))) * F.col("s")
    return edges_cc.join(given, "src").groupBy(*keys, "gene_id", F.col("dst").alias("cell_id")).agg(F.sum(weighted).alias("inflow"))


def passing(rates: DataFrame, fit: DataFrame, threshold: float) -> DataFrame:
    """The rates of the genes whose fit reaches the threshold."""
    return rates.join(fit.where(F.col("r2") >= threshold).select("gene_id"), "gene_id", "left_semi")


def corrected(cell_expr_rates: DataFrame, edges_cc: DataFrame | None, fit: DataFrame, scale: float, threshold: float = 0.01, metric: str = "exponential", mode: str | None = "quadratic_p90", percentiles: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """O-48: (gene_id, cell_id, n_raw, n_corrected) of every stored row; genes that miss the threshold stay as they are.

    percentiles: (gene_id, p50, p90), needed with a penalty mode, which weighs by the target cell's own rate. known: the inflow, where it was made without edges."""
    good = fit.where(F.col("r2") >= threshold).select("gene_id", "alpha")
    rates = cell_expr_rates
    known = inflow(edges_cc, passing(rates, fit, threshold), scale, metric) if known is None else known
    out = rates.join(good, "gene_id", "left").join(known, ["gene_id", "cell_id"], "left").fillna(0.0, ["inflow"])
    ambient = F.col("alpha") * F.col("area") * F.col("inflow")
    if mode is not None:
        out = out.join(percentiles, "gene_id", "left")
        ambient = ambient * penalty(mode)(F.col("s"), F.col("p50"), F.col("p90"))
    value = F.when(F.col("alpha").isNull(), F.col("n")).otherwise(F.greatest(F.col("n") - ambient, F.lit(0.0)))
    return out.select("gene_id", "cell_id", F.col("n").alias("n_raw"), value.alias("n_corrected"))
