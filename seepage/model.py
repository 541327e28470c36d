"""The leakage model: fit and correct a spatial data set."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seepage.functions.kernels import ARRAY_KERNELS, KERNELS
from seepage.operators import aggregate, blocks, fit, graph, tiling, validate
from seepage.operators.ordering import quantiles
from seepage.schema import SpatialDataset
from seepage.storage import stage


@dataclass
class LeakageModel:
    """Parameters are in the units of the coordinates; evaluation_model() has those of large comparisons. After fit_transform: lambda_, fit_, search_, diagnostics_."""

    bin_size: float = 50.0
    max_radius: float = 200.0
    #: The default grid.
    lambda_grid: tuple = (10.0, 20.0, 30.0, 50.0, 70.0, 100.0, 150.0, 200.0)
    n_high_genes: int | None = None
    n_lambda_genes: int = 50
    metric: str = "exponential"
    r2_threshold: float = 0.01
    use_expr_weight: bool = False
    penalty_mode: str | None = "quadratic_p90"
    #: rows: edges joined to rates; blocks: matrix products by tile and block of genes; auto: blocks where the row path would make too many rows.
    backend: str = "auto"
    lambda_: float | None = field(default=None, init=False)

    def __post_init__(self):
        """O-23."""
        number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)
        for name in ("bin_size", "max_radius"):
            if not number(getattr(self, name)) or getattr(self, name) <= 0:
                raise ValueError(f"{name} must be a positive finite number")
        if self.metric not in KERNELS:
            raise ValueError(f"metric must be one of {sorted(KERNELS)}")
        if len(self.lambda_grid) == 0 or not all(number(x) and x > 0 for x in self.lambda_grid):
            raise ValueError("lambda_grid must hold positive finite numbers")
        for name in ("n_lambda_genes", "n_high_genes"):
            n = getattr(self, name)
            if not (name == "n_high_genes" and n is None) and (not isinstance(n, int) or isinstance(n, bool) or n < 1):
                raise ValueError(f"{name} must be a whole number of at least 1")
        if self.backend not in ("auto", "rows", "blocks"):
            raise ValueError("backend must be auto, rows or blocks")
        if self.backend == "blocks" and self.metric not in ARRAY_KERNELS:
            raise ValueError(f"blocks need one of the kernels {sorted(ARRAY_KERNELS)}")
        if not number(self.r2_threshold) or not 0 <= self.r2_threshold <= 1:
            raise ValueError("r2_threshold must lie in [0, 1]")

    def fit_transform(self, data: SpatialDataset, check: bool = True) -> DataFrame:
        """(gene_id, cell_id, n_raw, n_corrected). Stage tables are written on the way, and the scale and the backend chosen; the result itself is lazy."""
        if check:
            validate.check_inputs(data)
        spots, counts = data.spots, data.counts
        cells = stage(aggregate.cells(spots), "cells")
        empty = aggregate.empty_bins(spots, self.bin_size)
        bin_table = stage(aggregate.bins(empty), "bins")
        bin_expr = stage(aggregate.bin_expression(empty, counts), "bin-expr")
        rates = aggregate.source_rates(aggregate.cell_expression(spots, counts), cells)
        raw = stage(rates, "rates")
        rates = stage(aggregate.expression_weights(raw), "weighted") if self.use_expr_weight else raw
        ranks = stage(aggregate.gene_ranks(counts, bin_expr, bin_table), "ranks")
        edges = stage(graph.bin_cell_edges(bin_table, cells, self.max_radius), "edges-bc")
        chosen = ranks if self.n_high_genes is None else ranks.where(F.col("rank") <= self.n_high_genes)
        n_genes = chosen.count()
        self.backend_ = blocks.choose(edges, rates, n_genes, self.metric) if self.backend == "auto" else self.backend
        by_blocks = self.backend_ == "blocks"

        def moments(genes: DataFrame, scales: list[float]) -> DataFrame:
            some = rates.join(genes.select("gene_id"), "gene_id", "left_semi")
            if by_blocks:
                return blocks.moments(bin_table, cells, some, bin_expr, self.max_radius, scales, self.metric, n_genes)
            return fit.moments(fit.kernel_sums(edges, some, scales, self.metric), bin_expr, len(scales))

        self.search_ = None
        if self.metric != "inverse":
            few = chosen.where(F.col("rank") <= self.n_lambda_genes)
            grid = list(self.lambda_grid)
            self.search_ = stage(fit.scale_search(None, bin_expr, bin_table, few, grid, moments(few, grid)), "search")
            self.lambda_ = fit.best_scale(self.search_).first()["scale"]
        scale = self.lambda_ or 1.0
        self.fit_ = stage(fit.gene_fit(None, bin_expr, bin_table, ranks, self.n_high_genes, moments(chosen, [scale])), "fit")
        edges_cc = stage(graph.cell_cell_edges(cells, self.max_radius), "edges-cc")
        self.percentiles_ = stage(aggregate.rate_percentiles(rates), "percentiles") if self.penalty_mode else None
        self.cells_, self.rates_ = cells, rates
        known = blocks.inflow(cells, fit.passing(rates, self.fit_, self.r2_threshold), self.max_radius, scale, self.metric, n_genes) if by_blocks else None
        out = fit.corrected(rates, edges_cc, self.fit_, scale, self.r2_threshold, self.metric, self.penalty_mode, self.percentiles_, known)
        if self.use_expr_weight:  # amounts come from the raw rates
            out = out.drop("n_raw").join(raw.select("gene_id", "cell_id", F.col("n").alias("n_raw")), ["gene_id", "cell_id"]).select("gene_id", "cell_id", "n_raw", "n_corrected")
        self.diagnostics_ = diagnostics(self, cells, bin_table, edges, edges_cc)
        return out

    def correct_tiles(self, x_edges: list[float], y_edges: list[float], halo: float | None = None, tiles: list[tuple[int, int]] | None = None) -> DataFrame:
        """O-37, O-118: after fit_transform, the correction made tile by tile, with the fitted scale, coefficients and percentiles: (col, row, gene_id, cell_id, n_raw, n_corrected).

        Every tile sees its own cells and those within halo (max_radius at least) alone; tiles: only these. Put together by tiling.stitched, the tiles equal the whole."""
        return tiling.correct_by_tiles(self.rates_, self.cells_, self.fit_, self.lambda_ or 1.0, self.max_radius, x_edges, y_edges, halo, self.r2_threshold, self.metric, self.penalty_mode, self.percentiles_, tiles)


def diagnostics(model: LeakageModel, cells: DataFrame, bin_table: DataFrame, edges: DataFrame, edges_cc: DataFrame) -> DataFrame:
    """O-93: one row about the fit."""
    good = F.col("r2") >= model.r2_threshold
    genes = model.fit_.agg(F.count("*").alias("n_genes_selected"), F.count_if(good).alias("n_genes_corrected"), F.avg("alpha").alias("alpha_mean"), F.avg("r2").alias("r2_mean"), F.sort_array(F.collect_list(F.struct("rank", "gene_id", "alpha", "r2"))).alias("genes"))
    areas = lambda df, p: df.agg(F.count("*").alias(f"n_{p}s"), F.avg("area").alias(f"{p}_area_mean"), F.min("area").alias(f"{p}_area_min"), F.max("area").alias(f"{p}_area_max")).join(quantiles(df, [], "area", {f"{p}_area_median": 0.5}), F.lit(True), "left")
    out = genes.crossJoin(areas(cells, "cell")).crossJoin(areas(bin_table, "bin")).crossJoin(edges.agg(F.count("*").alias("n_edges_bin_cell"))).crossJoin(edges_cc.agg(F.count("*").alias("n_edges_cell_cell")))
    extra = {"scale": F.lit(model.lambda_).cast("double"), "metric": F.lit(model.metric), "bin_size": F.lit(float(model.bin_size)), "max_radius": F.lit(float(model.max_radius)), "r2_threshold": F.lit(float(model.r2_threshold)), "backend": F.lit(model.backend_)}
    if model.search_ is not None:
        out = out.crossJoin(model.search_.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "rss"))), lambda e: e["rss"]).alias("rss"), F.min("rss").alias("rss_best")))
    return out.withColumns(extra)


def evaluation_model(**changes) -> LeakageModel:
    """O-137: the parameters of method comparisons: 25 um bins, a radius of 300 um, scales up to 300 um from 100 genes."""
    return LeakageModel(**{"bin_size": 25.0, "max_radius": 300.0, "lambda_grid": (10.0, 20.0, 30.0, 50.0, 70.0, 100.0, 150.0, 200.0, 300.0), "n_lambda_genes": 100, **changes})
