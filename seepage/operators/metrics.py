"""Quality and evaluation metrics on long tables. Zeros are not stored, so means divide by known numbers of members."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seepage.functions.scalar import log2_fold_change, log_cp10k, ratio
from seepage.operators.aggregate import clip
from seepage.operators.ordering import placed, quantiles


def library_sizes(cells: DataFrame, expr: DataFrame) -> DataFrame:
    """O-52: (cell_id, library) with 0 for cells without rows; negative values clipped. Non-finite values raise."""
    bad = F.raise_error(F.lit("expression must hold finite numbers"))
    value = F.when(F.isnan("n") | (F.abs(F.col("n")) == float("inf")), bad).otherwise(clip(F.col("n")))
    sums = expr.groupBy("cell_id").agg(F.sum(value).alias("library"))
    return cells.select("cell_id").join(sums, "cell_id", "left").select("cell_id", F.coalesce("library", F.lit(0.0)).alias("library"))


def library_summary(cells: DataFrame, expr: DataFrame) -> DataFrame:
    """O-52: one row of library statistics; zero_libraries() has the ids of cells without counts."""
    sizes = library_sizes(cells, expr)
    negative = expr.agg(F.count_if(F.col("n") < 0).alias("n_negative"))
    stats = sizes.agg(F.count("*").alias("n_cells"), F.count_if(F.col("library") == 0).alias("n_zero"), F.sum("library").alias("total"), F.min("library").alias("least"), F.max("library").alias("most"))
    middle = quantiles(sizes, [], "library", {"median": 0.5})
    return stats.join(middle, F.lit(True), "left").select("n_cells", "n_zero", "total", "least", "median", "most").crossJoin(negative)


def zero_libraries(cells: DataFrame, expr: DataFrame) -> DataFrame:
    """O-52: (cell_id) of the cells whose library is 0."""
    return library_sizes(cells, expr).where("library = 0").select("cell_id")


def normalised(cells: DataFrame, expr: DataFrame) -> DataFrame:
    """O-70: (gene_id, cell_id, v): log1p of counts per ten thousand."""
    joined = expr.join(library_sizes(cells, expr), "cell_id")
    return joined.select("gene_id", "cell_id", log_cp10k(F.col("n"), F.col("library")).alias("v"))


def pseudobulk(norm: DataFrame, groups: DataFrame, min_cells: int = 3) -> DataFrame:
    """O-53, O-54: (grp, gene_id, mean): mean over all cells of a group, rows or not. groups (cell_id, grp); unknown names drop out."""
    known = groups.where(F.col("grp").isNotNull() & ~F.col("grp").cast("string").isin("", "Unknown", "nan", "None"))
    sizes = known.groupBy("grp").agg(F.count("*").alias("members")).where(F.col("members") >= min_cells)
    sums = norm.join(known, "cell_id").groupBy("grp", "gene_id").agg(F.sum("v").alias("total"))
    return sums.join(sizes, "grp").select("grp", "gene_id", (F.col("total") / F.col("members")).alias("mean"))


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """A correlation from moments; null where either side is constant."""
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    flat = (vx <= 1e-12 * F.greatest(n * sxx, F.lit(1e-300))) | (vy <= 1e-12 * F.greatest(n * syy, F.lit(1e-300)))
    return F.when(~flat, (n * sxy - sx * sy) / F.sqrt(F.when(~flat, vx * vy)))


def paired(a: DataFrame, b: DataFrame, keys: list[str], a_col: str, b_col: str) -> DataFrame:
    """Full outer join of two long tables with zeros for missing rows: (keys, x, y)."""
    joined = a.select(*keys, F.col(a_col).alias("x")).join(b.select(*keys, F.col(b_col).alias("y")), keys, "full")
    return joined.fillna(0.0, ["x", "y"])


def moment_sums() -> list[Column]:
    x, y = F.col("x"), F.col("y")
    return [F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"), F.sum((x - y) * (x - y)).alias("sdd")]


MOMENTS = ("sx", "sy", "sxx", "syy", "sxy")


def cell_r2(pred: DataFrame, truth: DataFrame, n_genes: int, a_col: str = "n", b_col: str = "n") -> DataFrame:
    """O-81: (cell_id, r2): squared correlation of a cell's profiles over all genes; null for constant profiles."""
    sums = paired(pred, truth, ["cell_id", "gene_id"], a_col, b_col).groupBy("cell_id").agg(*moment_sums())
    c = pearson(F.lit(float(n_genes)), *(F.col(m) for m in MOMENTS))
    return sums.select("cell_id", F.when(c.isNotNull(), F.least(c * c, F.lit(1.0))).alias("r2"))


def cell_determination(pred: DataFrame, truth: DataFrame, n_genes: int, a_col: str = "n", b_col: str = "n") -> DataFrame:
    """O-83: (cell_id, r2): 1 - residual / total sum of squares of the truth (y)."""
    sums = paired(pred, truth, ["cell_id", "gene_id"], a_col, b_col).groupBy("cell_id").agg(*moment_sums())
    return sums.select("cell_id", (1 - ratio(F.col("sdd"), F.col("syy") - F.col("sy") * F.col("sy") / n_genes)).alias("r2"))


def summary(values: DataFrame, column: str) -> DataFrame:
    """O-82: one row: mean, median, quartiles, number of defined values."""
    middle = quantiles(values, [], column, {"median": 0.5, "q25": 0.25, "q75": 0.75})
    return values.agg(F.avg(column).alias("mean"), F.count(column).alias("n_valid")).join(middle, F.lit(True), "left").select("mean", "median", "q25", "q75", "n_valid")


def rmse(pred: DataFrame, truth: DataFrame, elements: int, a_col: str = "n", b_col: str = "n") -> DataFrame:
    """O-80: one row; the mean is over all elements of the matrix, stored or not."""
    both = paired(pred, truth, ["cell_id", "gene_id"], a_col, b_col)
    return both.agg(F.sqrt(F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y"))) / elements).alias("rmse"))


def rmse_change(raw: DataFrame, fixed: DataFrame, truth: DataFrame, cells: DataFrame, elements: int) -> DataFrame:
    """O-80: one row (raw, fixed, reduction): RMSE of log1p counts per ten thousand against the truth's, and its reduction in percent."""
    want = normalised(cells, truth)
    one = lambda df, name: rmse(normalised(cells, df), want, elements, "v", "v").withColumnRenamed("rmse", name)
    return one(raw, "raw").crossJoin(one(fixed, "fixed")).withColumn("reduction", 100 * (1 - ratio(F.col("fixed"), F.col("raw"))))


def average_ranks(values: DataFrame, by: list[str], column: str) -> DataFrame:
    """Adds rank_: the mean rank of ties inside each group."""
    w = Window.partitionBy(*by).orderBy(column)
    ties = Window.partitionBy(*by, column)
    return values.withColumn("rank_", F.rank().over(w) + (F.count("*").over(ties) - 1) / 2)


def concordance(profiles: DataFrame, reference: DataFrame, method: str = "pearson", genes: DataFrame | None = None, least: int = 0) -> DataFrame:
    """O-85, O-86, O-92: (grp, r, shared) over shared genes. Inputs: (grp, gene_id, mean). genes (gene_id) masks the genes; fewer than least shared
    genes over all groups raise ValueError."""
    if genes is not None:
        profiles = profiles.join(genes.select("gene_id"), "gene_id", "left_semi")
    if least and profiles.select("gene_id").distinct().join(reference.select("gene_id").distinct(), "gene_id").count() < least:
        raise ValueError(f"fewer than {least} genes are shared with the reference")
    both = profiles.select("grp", "gene_id", F.col("mean").alias("x")).join(reference.select("grp", "gene_id", F.col("mean").alias("y")), ["grp", "gene_id"])
    if method == "spearman":
        both = average_ranks(both, ["grp"], "x").withColumn("x", F.col("rank_")).drop("rank_")
        both = average_ranks(both, ["grp"], "y").withColumn("y", F.col("rank_")).drop("rank_")
    elif method != "pearson":
        raise ValueError("method must be pearson or spearman")
    sums = both.groupBy("grp").agg(F.count("*").alias("shared"), *moment_sums())
    return sums.select("grp", pearson(F.col("shared").cast("double"), *(F.col(m) for m in MOMENTS)).alias("r"), "shared")


def group_correlations(profiles: DataFrame, n_genes: int) -> DataFrame:
    """O-84, O-89: (a, b, r) of all pairs a < b of group profiles (groups are few), over all genes with zeros."""
    x = profiles.select(F.col("grp").alias("a"), "gene_id", F.col("mean").alias("x"))
    y = profiles.select(F.col("grp").alias("b"), "gene_id", F.col("mean").alias("y"))
    own = lambda df, c, k: df.groupBy(c).agg(F.sum(k).alias(f"s{k}"), F.sum(F.col(k) * F.col(k)).alias(f"s{k}{k}"))
    cross = x.join(y, "gene_id").where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("sxy"))
    joined = cross.join(own(x, "a", "x"), "a").join(own(y, "b", "y"), "b")
    return joined.select("a", "b", pearson(F.lit(float(n_genes)), *(F.col(m) for m in MOMENTS)).alias("r"))


def mean_between(correlations: DataFrame) -> DataFrame:
    """O-84: one row (mean_r, pairs): the mean of the defined correlations between groups."""
    return correlations.agg(F.avg("r").alias("mean_r"), F.count("r").alias("pairs"))


def gene_improvement(raw: DataFrame, fixed: DataFrame, reference: DataFrame, n_groups: int) -> DataFrame:
    """O-86: (gene_id, r_raw, r_fixed, improvement): correlation with the reference over groups."""

    def r(df, name):
        both = paired(df, reference, ["gene_id", "grp"], "mean", "mean").groupBy("gene_id").agg(*moment_sums())
        return both.select("gene_id", pearson(F.lit(float(n_groups)), *(F.col(m) for m in MOMENTS)).alias(name))

    joined = r(raw, "r_raw").join(r(fixed, "r_fixed"), "gene_id")
    return joined.withColumn("improvement", F.col("r_fixed") - F.col("r_raw"))


def first_of_highest(group: str, value: str) -> Column:
    """The group of the largest value; of ties the first in the groups' own order, be they numbers or texts."""
    return F.min_by(group, F.struct(-F.col(value), F.col(group)))


def contamination(profiles: DataFrame, reference: DataFrame, n_groups: int) -> DataFrame:
    """O-87: (gene_id, target, score): mean outside the reference's highest group over the mean inside it; null if that is not positive, or if there is one group."""
    target = reference.groupBy("gene_id").agg(first_of_highest("grp", "mean").alias("target"))
    sums = profiles.join(target, "gene_id").groupBy("gene_id", "target").agg(F.sum("mean").alias("total"), F.sum(F.when(F.col("grp") == F.col("target"), F.col("mean")).otherwise(0.0)).alias("own"))
    score = F.when(F.col("own") > 0, ratio((F.col("total") - F.col("own")) / F.when(F.col("own") > 0, F.col("own")), F.lit(float(n_groups - 1))))
    return sums.select("gene_id", "target", score.alias("score"))


def contamination_summary(profiles: DataFrame, reference: DataFrame, n_groups: int, raw: DataFrame) -> DataFrame:
    """O-87: one row: mean, median and number of the defined scores, the mean and median reduction against raw over the genes with a raw score, and both mean reduction and number for genes whose raw score is above 1."""
    own = contamination(profiles, reference, n_groups).select("gene_id", "score")
    before = contamination(raw, reference, n_groups).where("score is not null").select("gene_id", F.col("score").alias("raw"))
    both = own.join(before, "gene_id", "left").withColumn("less", F.col("raw") - F.col("score"))
    high = F.col("raw") > 1
    sums = both.agg(F.avg("score").alias("mean_score"), F.count("score").alias("n_genes"), F.avg("less").alias("mean_reduction"), F.avg(F.when(high, F.col("less"))).alias("mean_reduction_high"), F.count_if(high).alias("n_high"))
    middle = quantiles(both, [], "score", {"median_score": 0.5}).join(quantiles(both, [], "less", {"median_reduction": 0.5}), F.lit(True), "full")
    return sums.join(middle, F.lit(True), "left")


def specificity(reference: DataFrame, threshold: float = 0.15, least: float = 1.0) -> DataFrame:
    """O-88: (gene_id, target, specificity, peak, marker): largest share of a gene's total, and whether it is a marker."""
    g = reference.groupBy("gene_id").agg(F.max("mean").alias("peak"), F.sum("mean").alias("total"), first_of_highest("grp", "mean").alias("target"))
    share = ratio(F.col("peak"), F.col("total"))
    return g.select("gene_id", "target", share.alias("specificity"), "peak", (F.coalesce(share >= threshold, F.lit(False)) & (F.col("peak") >= least)).alias("marker"))


def t_statistics(values: DataFrame, groups: DataFrame, genes: DataFrame, min_cells: int = 3) -> DataFrame:
    """O-90: (gene_id, a, b, t, df): pooled-variance t of all pairs a < b of groups, zeros included."""
    sizes = groups.groupBy("grp").agg(F.count("*").alias("m")).where(F.col("m") >= min_cells)
    sums = values.join(genes.select("gene_id"), "gene_id", "left_semi").join(groups, "cell_id").groupBy("grp", "gene_id").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"))
    full = sizes.crossJoin(genes.select("gene_id")).join(sums, ["grp", "gene_id"], "left").fillna(0.0, ["s", "ss"])  # groups x genes: few by few
    a = full.select("gene_id", F.col("grp").alias("a"), F.col("m").alias("ma"), F.col("s").alias("sa"), F.col("ss").alias("qa"))
    b = full.select("gene_id", F.col("grp").alias("b"), F.col("m").alias("mb"), F.col("s").alias("sb"), F.col("ss").alias("qb"))
    j = a.join(b, "gene_id").where("a < b")
    df = F.col("ma") + F.col("mb") - 2
    pooled = (F.col("qa") - F.col("sa") * F.col("sa") / F.col("ma") + F.col("qb") - F.col("sb") * F.col("sb") / F.col("mb")) / df
    scale = F.sqrt(F.greatest(pooled, F.lit(0.0)) * (1 / F.col("ma") + 1 / F.col("mb")))
    return j.select("gene_id", "a", "b", F.when(scale > 1e-12, (F.col("sa") / F.col("ma") - F.col("sb") / F.col("mb")) / F.when(scale > 1e-12, scale)).alias("t"), df.alias("df"))


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p of a t statistic: the regularised incomplete beta function I(df / (df + t^2); df / 2, 1 / 2) by its continued fraction.

    Spark has no such function, so it is taken in Arrow batches of a row for each test."""

    def two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
        t, df = t.to_numpy(dtype=float), df.to_numpy(dtype=float)
        x = df / (df + t * t)
        a, b = df / 2, np.full(len(df), 0.5)
        log_gamma = np.vectorize(math.lgamma, otypes=[float])

        def part(x, a, b):
            """x^a (1 - x)^b / (a B(a, b)) times the fraction, which converges for x below (a + 1) / (a + b + 2)."""
            front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
            c, d = np.ones(len(x)), 1 / (1 - (a + b) * x / (a + 1))
            f = d.copy()
            for m in range(1, 400):
                for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                    d = 1 / np.where(np.abs(1 + step * d) < 1e-300, 1e-300, 1 + step * d)
                    c = np.where(np.abs(1 + step / c) < 1e-300, 1e-300, 1 + step / c)
                    f = f * c * d
            return front * f

        low = x < (a + 1) / (a + b + 2)
        odd = np.isnan(t) | np.isinf(t) | (t == 0)
        inner = np.where(odd, 0.5, x)
        p = np.where(low, part(np.where(low, inner, 0.5), a, b), 1 - part(np.where(low, 0.5, np.where(odd, 0.5, 1 - x)), b, a))
        p = np.where(t == 0, 1.0, np.where(np.isinf(t), 0.0, np.clip(p, 0, 1)))
        return pd.Series(np.where(np.isnan(t), np.nan, p))

    return F.pandas_udf(two_sided, T.DoubleType())(t, df)


def differential_genes(values: DataFrame, groups: DataFrame, genes: DataFrame, n_cells: int, top: int = 200, level: float = 0.05, min_cells: int = 3) -> DataFrame:
    """O-90, O-139: one row (n_tests, n_de): tests of the top most variable genes between all pairs of groups, and those with p below level."""
    few = variable_genes(values, n_cells, top)
    tests = t_statistics(values, groups, genes.join(few.select("gene_id"), "gene_id", "left_semi"), min_cells).where("t is not null")
    return tests.withColumn("p", student_p(F.col("t"), F.col("df").cast("double"))).agg(F.count("*").alias("n_tests"), F.count_if(F.col("p") < level).alias("n_de"))


def class_spearman(profiles: DataFrame, genes: DataFrame) -> DataFrame:
    """O-89, O-139: one row (mean_r, pairs): mean Spearman correlation of all pairs of group profiles over all genes, missing means 0, undefined ones 0.

    Groups x genes rows: few by few."""
    full = profiles.select("grp").distinct().crossJoin(genes.select("gene_id").distinct()).join(profiles.select("grp", "gene_id", "mean"), ["grp", "gene_id"], "left").fillna(0.0, ["mean"])
    ranked = average_ranks(full, ["grp"], "mean")
    x = ranked.select(F.col("grp").alias("a"), "gene_id", F.col("rank_").alias("x"))
    y = ranked.select(F.col("grp").alias("b"), "gene_id", F.col("rank_").alias("y"))
    sums = x.join(y, "gene_id").where("a < b").groupBy("a", "b").agg(F.count("*").cast("double").alias("n"), *moment_sums())
    r = pearson(F.col("n"), *(F.col(m) for m in MOMENTS))
    return sums.select(F.coalesce(r, F.lit(0.0)).alias("r")).agg(F.avg("r").alias("mean_r"), F.count("*").alias("pairs"))


def reference_profiles(values: DataFrame, symbols: DataFrame, groups: DataFrame, min_cells: int = 20) -> DataFrame:
    """O-55: (grp, gene_name, mean) of normalised values: '/' in group names becomes '-', groups need min_cells cells, genes of one name are averaged.

    values (gene_id, cell_id, v), symbols (gene_id, gene_name), groups (cell_id, grp)."""
    named = groups.where("grp is not null").withColumn("grp", F.replace(F.col("grp").cast("string"), F.lit("/"), F.lit("-")))
    sizes = named.groupBy("grp").agg(F.count("*").alias("members")).where(F.col("members") >= min_cells)
    sums = values.join(named, "cell_id").join(symbols, "gene_id").groupBy("grp", "gene_name").agg(F.sum("v").alias("total"))
    copies = symbols.groupBy("gene_name").agg(F.count("*").alias("copies"))  # genes without a row count as 0
    full = sizes.crossJoin(copies).join(sums, ["grp", "gene_name"], "left")  # groups x genes: few by few
    return full.select("grp", "gene_name", (F.coalesce("total", F.lit(0.0)) / F.col("members") / F.col("copies")).alias("mean"))


def panel_summary(scores: DataFrame, panels: DataFrame) -> DataFrame:
    """O-59: (panel, n, mean and median of retention and removal) of scores (gene_id, retention, removal) by panels (gene_id, panel)."""
    joined = panels.join(scores, "gene_id")
    means = joined.groupBy("panel").agg(F.count("*").alias("n"), F.avg("retention").alias("retention_mean"), F.avg("removal").alias("removal_mean"))
    for c in ("retention", "removal"):
        means = means.join(quantiles(joined, ["panel"], c, {f"{c}_median": 0.5}), "panel", "left")
    return means


def class_shares(calls: DataFrame, method: str, call: str) -> DataFrame:
    """O-60: (method, call, n, percent): how often each class was called by each method."""
    n = calls.groupBy(method, call).agg(F.count("*").alias("n"))
    return n.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(method)))


def top_genes(expr: DataFrame, n: int) -> DataFrame:
    """O-63: (gene_id, total) of the n genes of largest total; ties: smaller id. A top-k, not a cap."""
    return expr.groupBy("gene_id").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "gene_id").limit(n)


def variable_genes(values: DataFrame, n_cells: int, n: int) -> DataFrame:
    """O-64: (gene_id, variance) of the n genes of largest population variance over all cells."""
    v = values.groupBy("gene_id").agg((F.sum(F.col("v") * F.col("v")) / n_cells - F.pow(F.sum("v") / n_cells, 2)).alias("variance"))
    return v.orderBy(F.desc("variance"), "gene_id").limit(n)


def retention_removal(profiles: DataFrame, raw: DataFrame, reference: DataFrame, sizes: DataFrame, share: float = 0.25) -> DataFrame:
    """O-59: (gene_id, retention, removal): pooled means in and out of source groups (reference at least share of its peak), against raw."""
    peak = reference.groupBy("gene_id").agg(F.max("mean").alias("peak"))
    source = reference.join(peak, "gene_id").select("gene_id", "grp", (F.col("mean") >= share * F.col("peak")).alias("is_source"))

    def pooled(df, name):
        # Groups without a row of the reference are no source; sizes cover all of a gene's groups.
        full = source.select("gene_id").distinct().crossJoin(sizes).join(source, ["gene_id", "grp"], "left").join(df, ["gene_id", "grp"], "left").fillna(0.0, ["mean"]).fillna(False, ["is_source"])
        part = lambda on: ratio(F.sum(F.when(on, F.col("mean") * F.col("members"))), F.sum(F.when(on, F.col("members"))))
        return full.groupBy("gene_id").agg(part(F.col("is_source")).alias(f"{name}_in"), part(~F.col("is_source")).alias(f"{name}_out"))

    j = pooled(profiles, "new").join(pooled(raw, "old"), "gene_id")
    return j.select("gene_id", ratio(F.col("new_in"), F.col("old_in")).alias("retention"), (1 - ratio(F.col("new_out"), F.col("old_out"))).alias("removal"))


def fold_change_delta(raw: DataFrame, fixed: DataFrame, a: int, b: int) -> DataFrame:
    """O-95: (gene_id, raw_fc, fixed_fc, delta, improved): log2 fold change of group a over b, and whether it moved away from 0."""

    def fc(df, name):
        mean = lambda g: F.coalesce(F.sum(F.when(F.col("grp") == g, F.col("mean"))), F.lit(0.0))
        return df.where(F.col("grp").isin(a, b)).groupBy("gene_id").agg(log2_fold_change(mean(a), mean(b)).alias(name))

    j = fc(raw, "raw_fc").join(fc(fixed, "fixed_fc"), "gene_id").withColumn("delta", F.col("fixed_fc") - F.col("raw_fc"))
    return j.withColumn("improved", F.when(F.col("raw_fc") >= 0, F.col("delta") > 0).otherwise(F.col("delta") < 0))


def route_change(profiles: DataFrame, ligand: int, receptor: int, before: str, after: str, half: float = 50.0) -> DataFrame:
    """O-96, O-97: (source, target, raw_p, fixed_p, retained, change): for each pair of groups the probability of a ligand of one meeting the receptor of the
    other, by two methods, and the share in percent that remains. profiles (method, grp, gene_id, mean); groups are few."""
    x = profiles.where(F.col("gene_id") == ligand).select("method", F.col("grp").alias("source"), F.col("mean").alias("x"))
    y = profiles.where(F.col("gene_id") == receptor).select("method", F.col("grp").alias("target"), F.col("mean").alias("y"))
    route = x.join(y, "method").withColumn("p", F.col("x") * F.col("y") / (half + F.col("x") * F.col("y")))
    of = lambda m: F.sum(F.when(F.col("method") == m, F.col("p")))
    sums = route.groupBy("source", "target").agg(of(before).alias("raw_p"), of(after).alias("fixed_p"))
    share = ratio(F.col("fixed_p"), F.col("raw_p"))
    return sums.select("source", "target", "raw_p", "fixed_p", (100 * share).alias("retained"), (100 * (share - 1)).alias("change"))


def top_two(weights: DataFrame, key: str, value: str) -> DataFrame:
    """O-60: (key, top1, top2, gap, entropy) of weights normalised by row; null where they sum to 0. Rows are short."""
    total = weights.groupBy(key).agg(F.sort_array(F.collect_list(value), asc=False).alias("w"), F.sum(value).alias("total"))
    p = F.transform("w", lambda x: x / F.when(F.col("total") > 0, F.col("total")))
    rows = total.where("total > 0").select(key, p.alias("p"))
    second = F.coalesce(F.get("p", F.lit(1)), F.lit(0.0))
    entropy = F.aggregate("p", F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.ln(F.when(x > 0, x))).otherwise(0.0))
    return rows.select(key, F.get("p", F.lit(0)).alias("top1"), second.alias("top2"), (F.get("p", F.lit(0)) - second).alias("gap"), entropy.alias("entropy"))


def common_members(members: DataFrame, group: str, key: str) -> DataFrame:
    """O-98: keys that every group holds."""
    n = members.select(group).distinct().agg(F.count("*").alias("groups"))
    each = members.groupBy(key).agg(F.countDistinct(group).alias("seen"))
    return each.crossJoin(F.broadcast(n)).where("seen = groups").select(key)


def merge_incremental(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """O-113, O-116: old rows without the keys of new, and new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def adjusted_rand(labels: DataFrame, a: str, b: str) -> DataFrame:
    """O-91: one row (ari) from the contingency counts of two labellings."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = labels.groupBy(a, b).agg(F.count("*").alias("n"))
    both = cells.agg(pairs("n").alias("both"), F.sum("n").alias("total"))
    ra = labels.groupBy(a).agg(F.count("*").alias("n")).agg(pairs("n").alias("ra"))
    rb = labels.groupBy(b).agg(F.count("*").alias("n")).agg(pairs("n").alias("rb"))
    one = both.crossJoin(ra).crossJoin(rb).withColumn("expected", F.col("ra") * F.col("rb") / F.when(F.col("total") > 1, F.col("total") * (F.col("total") - 1) / 2))
    return one.select(ratio(F.col("both") - F.col("expected"), (F.col("ra") + F.col("rb")) / 2 - F.col("expected")).alias("ari"))
