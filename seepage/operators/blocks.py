"""Kernel-weighted sums by blocks of a tile's places and some genes: matrix products in place of a row for each edge and gene.

The row path of `fit` joins edges to rates, which makes genes x degree rows of every cell. Here targets (bins or cells) lie in tiles of twice the
radius; a source cell goes to the tiles that it can reach, and genes are dealt to blocks. A task gets the places, the rates and the observations of one tile and one
block of genes, and multiplies its kernel matrix (slabs of targets x sources) by its rates (sources x genes). Sums over a tile's targets leave the task as a row for each
gene, corrections as a row for each stored rate. Tiles of more places than DENSE, which no block should hold, are left to the row path; both add up."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seepage.functions.kernels import ARRAY_KERNELS
from seepage.operators import fit, graph
from seepage.storage import stage

#: Rows of the row path above which blocks are chosen.
ROW_LIMIT = 2e9
#: Bytes of a block's matrices, places of a tile that a task takes, and targets of a slab.
WORKING_SET = 1 << 28
DENSE = 20_000
SLAB = 256


def genes_per_block(rows: int, columns: int, most: int, item: int = 8, budget: int = WORKING_SET) -> int:
    """O-131: as many genes as let six arrays of the larger side stay inside the budget; at least one, at most most."""
    return max(1, min(max(1, int(most)), int(budget) // max(1, 6 * max(int(rows), int(columns)) * int(item))))


def joined_rows(edges: DataFrame, rates: DataFrame) -> int:
    """Rows that the row path would make: for each cell, its edges times its genes."""
    degree = edges.groupBy("cell_id").agg(F.count("*").alias("e"))
    genes = rates.groupBy("cell_id").agg(F.count("*").alias("g"))
    return int(degree.join(genes, "cell_id").agg(F.sum(F.col("e") * F.col("g"))).first()[0] or 0)


def choose(edges: DataFrame, rates: DataFrame, n_genes: int, metric: str) -> str:
    """"blocks" where the row path would make more than ROW_LIMIT rows, else "rows". Kernels without an array form stay with rows."""
    if metric not in ARRAY_KERNELS or edges.count() * n_genes <= ROW_LIMIT:
        return "rows"
    return "blocks" if joined_rows(edges, rates) > ROW_LIMIT else "rows"


@dataclass
class Layout:
    """Targets and sources by tile: targets (tx, ty, id, x, y, area), sources (tx, ty, id, x, y), the dense tiles (tx, ty) apart, and genes in each block."""

    targets: DataFrame
    sources: DataFrame
    dense: DataFrame
    n_dense: int
    blocks: int
    radius: float


def layout(targets: DataFrame, sources: DataFrame, radius: float, n_genes: int) -> Layout:
    """targets (id, x, y, area), sources (id, x, y)."""
    side = 2 * float(radius)
    reach = float(radius) * (1 + 1e-9)  # a distance of just the radius must not be lost to rounding
    tile = lambda c: F.floor(c / side)
    span = lambda c: F.sequence(tile(F.col(c) - reach), tile(F.col(c) + reach))
    t = stage(targets.select(tile(F.col("x")).alias("tx"), tile(F.col("y")).alias("ty"), "id", "x", "y", F.col("area").cast("double").alias("area")), "block-targets")
    s = sources.select("id", "x", "y", F.explode(span("x")).alias("tx"), span("y").alias("tys"))
    used = t.select("tx", "ty").distinct()
    s = stage(s.select("tx", F.explode("tys").alias("ty"), "id", "x", "y").join(used, ["tx", "ty"], "left_semi"), "block-sources")
    sizes = t.groupBy("tx", "ty").agg(F.count("*").alias("t")).join(s.groupBy("tx", "ty").agg(F.count("*").alias("s")), ["tx", "ty"])
    dense = stage(sizes.where(F.greatest("t", "s") > DENSE).select("tx", "ty"), "block-dense")
    most = sizes.agg(F.max(F.least(F.col("t"), F.lit(DENSE))), F.max(F.least(F.col("s"), F.lit(DENSE)))).first()
    per_block = genes_per_block(most[0] or 1, most[1] or 1, n_genes)
    return Layout(t, s, dense, dense.count(), -(-n_genes // per_block) if n_genes else 1, radius)


def _rows(plan: Layout, rates: DataFrame, observed: DataFrame) -> DataFrame:
    """One long table of what a (tile, block of genes) needs: kind 0 targets, 1 sources, 2 rates (gene_id, cell_id, s), 3 observations (gene_id, id, y)."""
    block = F.pmod(F.xxhash64("gene_id"), F.lit(plan.blocks)).cast("int").alias("block")
    every = F.explode(F.sequence(F.lit(0), F.lit(plan.blocks - 1))).alias("block")
    sparse = lambda df: df.join(F.broadcast(plan.dense), ["tx", "ty"], "left_anti") if plan.n_dense else df  # noqa: E731  dense tiles are few: each holds DENSE places
    t, s = sparse(plan.targets), sparse(plan.sources)
    none = F.lit(None)
    row = lambda kind, a, b, x, y, v: [F.lit(kind).cast("tinyint").alias("kind"), a.cast("long").alias("a"), b.cast("long").alias("b"), x.cast("double").alias("x"), y.cast("double").alias("y"), v.cast("double").alias("v")]
    places = t.select("tx", "ty", every, *row(0, F.col("id"), none, F.col("x"), F.col("y"), F.col("area")))
    givers = s.select("tx", "ty", every, *row(1, F.col("id"), none, F.col("x"), F.col("y"), none))
    given = rates.select("gene_id", F.col("cell_id").alias("id"), "s").join(s.select("tx", "ty", "id"), "id").select("tx", "ty", block, *row(2, F.col("id"), F.col("gene_id"), none, none, F.col("s")))
    seen = observed.join(t.select("tx", "ty", "id"), "id").select("tx", "ty", block, *row(3, F.col("id"), F.col("gene_id"), none, none, F.col("y")))
    return places.unionByName(givers).unionByName(given).unionByName(seen)


class Block:
    """The arrays of one tile and block of genes."""

    def __init__(self, rows: pa.Table, radius: float):
        kind, a, x, y, v = (rows.column(c).to_numpy() for c in ("kind", "a", "x", "y", "v"))
        genes = rows.column("b")
        t, s, r, o = (np.flatnonzero(kind == k) for k in range(4))
        t, s = t[np.argsort(a[t], kind="stable")], s[np.argsort(a[s], kind="stable")]
        self.radius = radius
        self.id, self.x, self.y, self.area = a[t], x[t], y[t], v[t]
        self.source, self.sx, self.sy = a[s], x[s], y[s]
        self.of_rate, self.rate, rate_gene = np.searchsorted(self.source, a[r]), v[r], genes.take(pa.array(r)).to_numpy()
        self.of_seen, self.seen, seen_gene = np.searchsorted(self.id, a[o]), v[o], genes.take(pa.array(o)).to_numpy()
        self.genes = np.unique(np.concatenate((rate_gene, seen_gene)).astype(np.int64))
        self.rate_gene, self.seen_gene = np.searchsorted(self.genes, rate_gene), np.searchsorted(self.genes, seen_gene)
        self.rates = np.zeros((len(self.source), len(self.genes)))
        np.add.at(self.rates, (self.of_rate, self.rate_gene), self.rate)

    def slabs(self, weigh, scales: list[float], loops: bool) -> Iterator[tuple[slice, list[np.ndarray]]]:
        """(targets, for each scale their weighted sums by gene); without loops a source does not give to itself."""
        for a in range(0, len(self.id), SLAB):
            some = slice(a, a + SLAB)
            dx, dy = self.x[some, None] - self.sx, self.y[some, None] - self.sy
            d2 = dx * dx + dy * dy
            near = d2 <= self.radius * self.radius
            if not loops:
                near &= self.id[some, None] != self.source
            used = np.flatnonzero(near.any(axis=0))
            d, near = np.sqrt(d2[:, used]), near[:, used]
            yield some, [np.where(near, weigh(d, x), 0.0) @ self.rates[used] for x in scales]


def _moments_of(weigh, scales: list[float], radius: float):
    names = [f"{m}_{i}" for i in range(len(scales)) for m in ("nn", "yn")]

    def run(rows: pa.Table) -> pa.Table:
        b = Block(rows, radius)
        out = np.zeros((2 * len(scales), len(b.genes)))
        order = np.argsort(b.of_seen, kind="stable")
        of_seen, seen, seen_gene = b.of_seen[order], b.seen[order], b.seen_gene[order]
        for some, sums in b.slabs(weigh, scales, True):
            w = b.area[some]
            lo, hi = np.searchsorted(of_seen, [some.start, some.start + len(w)])
            observed = np.zeros((len(w), len(b.genes)))
            observed[of_seen[lo:hi] - some.start, seen_gene[lo:hi]] = seen[lo:hi]
            for i, n in enumerate(sums):
                n = w[:, None] * n
                out[2 * i] += w @ (n * n)
                out[2 * i + 1] += w @ (observed * n)
        return pa.table({"gene_id": pa.array(b.genes, pa.int64()), **{k: pa.array(x) for k, x in zip(names, out)}})

    return run, "gene_id long, " + ", ".join(f"{k} double" for k in names)


def moments(bin_table: DataFrame, cell_table: DataFrame, rates: DataFrame, bin_expr: DataFrame, radius: float, scales: list[float], metric: str = "exponential", n_genes: int | None = None) -> DataFrame:
    """O-44, O-45: what fit.moments gives for fit.kernel_sums of all edges: (gene_id, nn_i, yn_i) for each scale."""
    n_genes = rates.select("gene_id").distinct().count() if n_genes is None else n_genes
    targets = bin_table.select(F.col("bin_id").alias("id"), F.col("bx").alias("x"), F.col("by").alias("y"), "area")
    plan = layout(targets, cell_table.select(F.col("cell_id").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y")), radius, n_genes)
    observed = bin_expr.join(rates.select("gene_id").distinct(), "gene_id", "left_semi").select("gene_id", F.col("bin_id").alias("id"), "y")
    run, schema = _moments_of(ARRAY_KERNELS[metric], [float(x) for x in scales], float(radius))
    parts = _rows(plan, rates, observed).groupBy("tx", "ty", "block").applyInArrow(run, schema)
    if plan.n_dense:
        crowded = plan.targets.join(F.broadcast(plan.dense), ["tx", "ty"], "left_semi").select(F.col("id").alias("bin_id"), "area", F.col("x").alias("bx"), F.col("y").alias("by"))
        pred = fit.kernel_sums(graph.bin_cell_edges(crowded, cell_table, radius), rates, scales, metric)
        parts = parts.unionByName(fit.moments(pred, bin_expr, len(scales)))
    return parts.groupBy("gene_id").agg(*(F.sum(c).alias(c) for c in parts.columns[1:]))


def _inflow_of(weigh, scale: float, radius: float):
    def run(rows: pa.Table) -> pa.Table:
        b = Block(rows, radius)
        order = np.argsort(b.of_seen, kind="stable")
        of_seen, seen_gene = b.of_seen[order], b.seen_gene[order]
        value = np.zeros(len(order))
        for some, (n,) in b.slabs(weigh, [scale], False):
            lo, hi = np.searchsorted(of_seen, [some.start, some.stop])
            value[lo:hi] = n[of_seen[lo:hi] - some.start, seen_gene[lo:hi]]
        return pa.table({"gene_id": pa.array(b.genes[seen_gene], pa.int64()), "cell_id": pa.array(b.id[of_seen], pa.int64()), "inflow": pa.array(value)})

    return run, "gene_id long, cell_id long, inflow double"


def inflow(cell_table: DataFrame, rates: DataFrame, radius: float, scale: float, metric: str = "exponential", n_genes: int | None = None) -> DataFrame:
    """O-48: (gene_id, cell_id, inflow) of every row of rates: the kernel-weighted sum of the other cells' rates within the radius."""
    n_genes = rates.select("gene_id").distinct().count() if n_genes is None else n_genes
    places = cell_table.select(F.col("cell_id").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"), "area")
    plan = layout(places, places.drop("area"), radius, n_genes)
    observed = rates.select("gene_id", F.col("cell_id").alias("id"), F.col("s").alias("y"))
    run, schema = _inflow_of(ARRAY_KERNELS[metric], float(scale), float(radius))
    found = _rows(plan, rates, observed).groupBy("tx", "ty", "block").applyInArrow(run, schema)
    if plan.n_dense:
        crowded = plan.targets.join(F.broadcast(plan.dense), ["tx", "ty"], "left_semi").select(F.col("id").alias("cell_id"), F.col("x").alias("cx"), F.col("y").alias("cy"))
        found = found.unionByName(fit.inflow(graph.cell_cell_edges(cell_table, radius).join(crowded.select(F.col("cell_id").alias("dst")), "dst", "left_semi"), rates, scale, metric))
    return found

