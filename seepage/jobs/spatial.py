"""Registered queries of the leakage model's stages on the derived spatial data set, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seepage.functions.kernels import KERNELS, PENALTIES
from seepage.model import LeakageModel
from seepage.operators import aggregate, fit, geometry, graph, tiling, validate
from seepage.operators.ordering import placed
from seepage.sources import cellbin, sinks
from seepage.sources.adapter import dataset
from seepage.storage import stage

BIN, RADIUS, SCALES, N_LAMBDA, THRESHOLD = 10, 30, (5.0, 10.0, 20.0), 10, 0.01
X_RANGE, Y_RANGE = (20.0, 120.0), (10.0, 90.0)
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: The stages in SQL; DuckDB runs the parts that a query refers to.
BASE = f"""
WITH raw AS (SELECT CAST(o_orderkey AS BIGINT) spot_id, CAST(o_orderkey % 120 AS DOUBLE) * 2 x, CAST(o_orderkey // 120 AS DOUBLE) * 2 y FROM orders),
tiled AS (SELECT *, CAST(floor(x / 16) AS BIGINT) tx, CAST(floor(y / 16) AS BIGINT) ty FROM raw),
spots AS (SELECT spot_id, x, y, CASE WHEN (x - tx * 16 - 8) * (x - tx * 16 - 8) + (y - ty * 16 - 8) * (y - ty * 16 - 8) <= 30 THEN tx * 1000 + ty ELSE CAST(-1 AS BIGINT) END label FROM tiled),
counts AS (SELECT CAST(l_partkey % 20 AS BIGINT) gene_id, CAST(l_orderkey AS BIGINT) spot_id, CAST(sum(l_quantity) AS DOUBLE) n FROM lineitem GROUP BY 1, 2),
cells AS (SELECT label cell_id, count(*) area, avg(x) cx, avg(y) cy FROM spots WHERE label >= 0 GROUP BY 1),
cell_expr AS (SELECT gene_id, label cell_id, sum(n) n FROM counts JOIN spots USING (spot_id) WHERE label >= 0 GROUP BY 1, 2),
ext AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM spots WHERE label < 0),
grid AS (SELECT *, greatest(1, CAST(ceil((x1 - x0) / {BIN}) AS BIGINT)) nx, greatest(1, CAST(ceil((y1 - y0) / {BIN}) AS BIGINT)) ny FROM ext),
empty_map AS (SELECT spot_id, x, y, least(CAST(floor((x - x0) / {BIN}) AS BIGINT), nx - 1) * ny + least(CAST(floor((y - y0) / {BIN}) AS BIGINT), ny - 1) bin_id FROM spots, grid WHERE label < 0),
bins AS (SELECT bin_id, count(*) area, avg(x) bx, avg(y) cy FROM empty_map GROUP BY 1),
bin_expr AS (SELECT gene_id, bin_id, sum(n) y FROM counts JOIN empty_map USING (spot_id) GROUP BY 1, 2),
genes AS (SELECT DISTINCT gene_id FROM counts),
big AS (SELECT CAST(sum(area) AS DOUBLE) w FROM bins),
ranked AS (SELECT gene_id, background, row_number() OVER (ORDER BY background DESC, gene_id DESC) rk FROM (SELECT g.gene_id, coalesce(sum(y), 0) / (SELECT w FROM big) background FROM genes g LEFT JOIN bin_expr USING (gene_id) GROUP BY 1)),
src AS (SELECT gene_id, cell_id, n, area, n / area s FROM cell_expr JOIN cells USING (cell_id)),
ebc AS (SELECT bin_id, cell_id, b.area bin_area, sqrt((bx - cx) * (bx - cx) + (b.cy - c.cy) * (b.cy - c.cy)) d FROM bins b, cells c WHERE (bx - cx) * (bx - cx) + (b.cy - c.cy) * (b.cy - c.cy) <= {RADIUS * RADIUS}),
ecc AS (SELECT a.cell_id dst, b.cell_id src, sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) d FROM cells a, cells b WHERE a.cell_id <> b.cell_id AND (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) <= {RADIUS * RADIUS}),
lam AS (SELECT * FROM (VALUES (0, 5.0::DOUBLE), (1, 10.0::DOUBLE), (2, 20.0::DOUBLE)) l(pos, scale)),
pred AS (SELECT pos, scale, gene_id, bin_id, any_value(bin_area) w, any_value(bin_area) * sum(exp(-d / scale) * s) n FROM ebc JOIN src USING (cell_id), lam GROUP BY 1, 2, 3, 4),
mom AS (SELECT pos, scale, gene_id, sum(p.w * n * n) nn, sum(p.w * coalesce(y, 0) * n) yn FROM pred p LEFT JOIN bin_expr USING (gene_id, bin_id) GROUP BY 1, 2, 3),
seen AS (SELECT gene_id, sum(area * y) wy, sum(area * y * y) yy FROM bin_expr JOIN bins USING (bin_id) GROUP BY 1),
fits AS (SELECT g.gene_id, g.rk, l.pos, l.scale, coalesce(wy, 0) wy, coalesce(yy, 0) yy, coalesce(yn, 0) yn, coalesce(nn, 0) nn, CASE WHEN coalesce(nn, 0) > 0 THEN greatest(yn / nn, 0) ELSE 0 END alpha
  FROM ranked g CROSS JOIN lam l LEFT JOIN seen USING (gene_id) LEFT JOIN mom m ON m.gene_id = g.gene_id AND m.pos = l.pos),
search AS (SELECT pos, scale, sum(greatest(yy - 2 * alpha * yn + alpha * alpha * nn, 0)) rss FROM fits WHERE rk <= {N_LAMBDA} GROUP BY 1, 2),
best AS (SELECT scale, rss FROM search ORDER BY rss, pos LIMIT 1),
fit AS (SELECT gene_id, rk, alpha, CASE WHEN yy - wy * wy / w > 1e-15 THEN 1 - greatest(yy - 2 * alpha * yn + alpha * alpha * nn, 0) / (yy - wy * wy / w)
  WHEN greatest(yy - 2 * alpha * yn + alpha * alpha * nn, 0) > 1e-15 THEN 0 ELSE 1 END r2 FROM fits, big WHERE scale = (SELECT scale FROM best)),
pct AS (SELECT gene_id, quantile_cont(s, 0.5) p50, quantile_cont(s, 0.9) p90 FROM src WHERE s > 0 GROUP BY 1),
inflow AS (SELECT gene_id, dst cell_id, sum(exp(-d / (SELECT scale FROM best)) * s) i FROM ecc JOIN (SELECT gene_id, cell_id src, s FROM src) USING (src) GROUP BY 1, 2),
corr AS (SELECT s.gene_id, s.cell_id, n n_raw, CASE WHEN r2 >= {THRESHOLD} THEN greatest(n - alpha * area * coalesce(i, 0) / (1 + (s / p90) * (s / p90)), 0) ELSE n END n_corrected
  FROM src s JOIN fit USING (gene_id) LEFT JOIN inflow USING (gene_id, cell_id) JOIN pct USING (gene_id))
"""  # fmt: skip


def r(c: str | Column, digits: int = 6) -> Column:
    """Rounded, so that the order of a sum does not show; no negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def query(name: str, sql: str):
    def put(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = BASE + sql
        return f

    return put


class Stages:
    """Stage tables of one data set, each made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.data = dataset(spark, sf_dir)
        self.made: dict[str, DataFrame] = {}

    def get(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = stage(getattr(self, "_" + name)(), name)
        return self.made[name]

    def _cells(self):
        return aggregate.cells(self.data.spots)

    def _cell_expr(self):
        return aggregate.cell_expression(self.data.spots, self.data.counts)

    def _empty(self):
        return aggregate.empty_bins(self.data.spots, BIN)

    def _bins(self):
        return aggregate.bins(self.get("empty"))

    def _bin_expr(self):
        return aggregate.bin_expression(self.get("empty"), self.data.counts)

    def _ranks(self):
        return aggregate.gene_ranks(self.data.counts, self.get("bin_expr"), self.get("bins"))

    def _rates(self):
        return aggregate.source_rates(self.get("cell_expr"), self.get("cells"))

    def _ebc(self):
        return graph.bin_cell_edges(self.get("bins"), self.get("cells"), RADIUS)

    def _ecc(self):
        return graph.cell_cell_edges(self.get("cells"), RADIUS)

    def _pred(self):
        return fit.kernel_sums(self.get("ebc"), self.get("rates"), list(SCALES))

    def _search(self):
        return fit.scale_search(self.get("pred"), self.get("bin_expr"), self.get("bins"), self.get("ranks").where(F.col("rank") <= N_LAMBDA), list(SCALES))

    def scale(self) -> float:
        return fit.best_scale(self.get("search")).first()["scale"]

    def _fit(self):
        at = SCALES.index(self.scale())
        pred = self.get("pred").select("gene_id", "bin_id", "w", F.col(f"n_{at}").alias("n_0"))
        return fit.gene_fit(pred, self.get("bin_expr"), self.get("bins"), self.get("ranks"))

    def _corrected(self):
        return fit.corrected(self.get("rates"), self.get("ecc"), self.get("fit"), self.scale(), THRESHOLD, percentiles=aggregate.rate_percentiles(self.get("rates")))


@query("o40_cell_summary", "SELECT cell_id, area, round(cx, 6) cx, round(cy, 6) cy FROM cells")
def o40_cell_summary(spark, sf_dir):
    return aggregate.cells(dataset(spark, sf_dir).spots).select("cell_id", "area", r("cx").alias("cx"), r("cy").alias("cy"))


@query("o40_cell_expr", "SELECT gene_id, cell_id, n FROM cell_expr")
def o40_cell_expr(spark, sf_dir):
    data = dataset(spark, sf_dir)
    return aggregate.cell_expression(data.spots, data.counts)


@query("o41_bin_summary", "SELECT bin_id, area, round(bx, 6) bx, round(cy, 6) cy FROM bins")
def o41_bin_summary(spark, sf_dir):
    return aggregate.bins(aggregate.empty_bins(dataset(spark, sf_dir).spots, BIN)).select("bin_id", "area", r("bx").alias("bx"), r("by").alias("cy"))


@query("o42_bin_expr", "SELECT gene_id, bin_id, y FROM bin_expr")
def o42_bin_expr(spark, sf_dir):
    data = dataset(spark, sf_dir)
    return aggregate.bin_expression(aggregate.empty_bins(data.spots, BIN), data.counts)


@query("o61_gene_rank", "SELECT gene_id, round(background, 6) background, CAST(rk AS BIGINT) rk FROM ranked")
def o61_gene_rank(spark, sf_dir):
    return Stages(spark, sf_dir).get("ranks").select("gene_id", r("background").alias("background"), F.col("rank").cast("long").alias("rk"))


@query("o33_edges_bc", "SELECT bin_id, cell_id, round(d, 6) d FROM ebc")
def o33_edges_bc(spark, sf_dir):
    return Stages(spark, sf_dir).get("ebc").select("bin_id", "cell_id", r("d").alias("d"))


@query("o34_edges_cc", "SELECT dst, src, round(d, 6) d FROM ecc")
def o34_edges_cc(spark, sf_dir):
    return Stages(spark, sf_dir).get("ecc").select("dst", "src", r("d").alias("d"))


@query("o38_kernels", "SELECT bin_id, cell_id, round(exp(-d / 10), 6) exponential, round(exp(-(d * d) / 200), 6) gaussian, round(1 / (d + 1e-6), 6) inverse FROM ebc")
def o38_kernels(spark, sf_dir):
    return Stages(spark, sf_dir).get("ebc").select("bin_id", "cell_id", *(r(w(F.col("d"), F.lit(10.0))).alias(k) for k, w in KERNELS.items()))


@query("o44_kernel_sum", "SELECT scale, gene_id, bin_id, round(n, 4) n FROM pred")
def o44_kernel_sum(spark, sf_dir):
    each = F.explode(F.array(*(F.struct(F.lit(x).alias("scale"), F.col(f"n_{i}").alias("n")) for i, x in enumerate(SCALES)))).alias("e")
    return Stages(spark, sf_dir).get("pred").select("gene_id", "bin_id", each).select("e.scale", "gene_id", "bin_id", r("e.n", 4).alias("n"))


@query("o46_lambda_rss", "SELECT scale, round(rss, 1) rss FROM search")
def o46_lambda_rss(spark, sf_dir):
    return Stages(spark, sf_dir).get("search").select("scale", r("rss", 1).alias("rss"))


@query("o46_lambda_best", "SELECT scale, round(rss, 1) rss FROM best")
def o46_lambda_best(spark, sf_dir):
    return fit.best_scale(Stages(spark, sf_dir).get("search")).select("scale", r("rss", 1).alias("rss"))


@query("o47_alpha_r2", "SELECT gene_id, CAST(rk AS BIGINT) rk, round(alpha, 6) alpha, round(r2, 6) r2 FROM fit")
def o47_alpha_r2(spark, sf_dir):
    return Stages(spark, sf_dir).get("fit").select("gene_id", F.col("rank").cast("long").alias("rk"), r("alpha").alias("alpha"), r("r2").alias("r2"))


@query("o49_expr_weight", "SELECT gene_id, cell_id, round(s * s / (s + p50), 6) s FROM src JOIN pct USING (gene_id)")
def o49_expr_weight(spark, sf_dir):
    return aggregate.expression_weights(Stages(spark, sf_dir).get("rates")).select("gene_id", "cell_id", r("s").alias("s"))


@query("o50_penalty_modes", "SELECT gene_id, cell_id, round(1 / (1 + s / p90), 6) linear_p90, round(1 / (1 + s / p50), 6) linear_p50, round(1 / (1 + (s / p90) * (s / p90)), 6) quadratic_p90, round(exp(-s / p90), 6) exponential_p90, round(CASE WHEN s <= p50 THEN 1 ELSE p50 / s END, 6) inverse_p50 FROM src JOIN pct USING (gene_id)")
def o50_penalty_modes(spark, sf_dir):
    rates = Stages(spark, sf_dir).get("rates")
    joined = rates.join(F.broadcast(aggregate.rate_percentiles(rates)), "gene_id")  # a row for each gene
    return joined.select("gene_id", "cell_id", *(r(f(F.col("s"), F.col("p50"), F.col("p90"))).alias(k) for k, f in PENALTIES.items()))


@query("o48_corrected", "SELECT gene_id, cell_id, n_raw, round(n_corrected, 4) n_corrected FROM corr")
def o48_corrected(spark, sf_dir):
    """The flagship: fit and correct the whole data set."""
    model = LeakageModel(bin_size=BIN, max_radius=RADIUS, lambda_grid=SCALES, n_lambda_genes=N_LAMBDA, r2_threshold=THRESHOLD)
    return model.fit_transform(dataset(spark, sf_dir)).select("gene_id", "cell_id", "n_raw", r("n_corrected", 4).alias("n_corrected"))


@query("o93_diagnostics", f"""SELECT count(*) n_genes_selected, sum((r2 >= {THRESHOLD})::BIGINT)::BIGINT n_genes_corrected, round(avg(alpha), 6) alpha_mean, round(avg(r2), 6) r2_mean,
 any_value((SELECT count(*) FROM cells)) n_cells, any_value((SELECT count(*) FROM bins)) n_bins, any_value((SELECT round(avg(area), 6) FROM bins)) bin_area_mean, any_value((SELECT count(*) FROM ebc)) n_edges_bin_cell,
 any_value((SELECT count(*) FROM ecc)) n_edges_cell_cell, any_value((SELECT scale FROM best)) scale, any_value((SELECT round(rss, 1) FROM best)) rss_best FROM fit""")
def o93_diagnostics(spark, sf_dir):
    model = LeakageModel(bin_size=BIN, max_radius=RADIUS, lambda_grid=SCALES, n_lambda_genes=N_LAMBDA, r2_threshold=THRESHOLD)
    model.fit_transform(dataset(spark, sf_dir), check=False)
    keep = ["n_genes_selected", "n_genes_corrected", r("alpha_mean").alias("alpha_mean"), r("r2_mean").alias("r2_mean"), "n_cells", "n_bins", r("bin_area_mean").alias("bin_area_mean"), "n_edges_bin_cell", "n_edges_cell_cell", "scale", r("rss_best", 1).alias("rss_best")]
    return model.diagnostics_.select(*keep)


@query("o94_gene_flags", f"SELECT gene_id, rk <= {N_LAMBDA} selected, rk <= {N_LAMBDA} AND r2 >= {THRESHOLD} corrected, CASE WHEN rk <= {N_LAMBDA} THEN round(r2, 6) END r2 FROM fit")
def o94_gene_flags(spark, sf_dir):
    stages = Stages(spark, sf_dir)
    genes = stages.data.counts.select("gene_id").distinct()
    fitted = stages.get("fit").where(F.col("rank") <= N_LAMBDA)
    return genes.join(fitted, "gene_id", "left").select("gene_id", F.col("rank").isNotNull().alias("selected"), F.coalesce(F.col("r2") >= THRESHOLD, F.lit(False)).alias("corrected"), r("r2").alias("r2"))


@query("o25_window", f"SELECT spot_id, x, y, label FROM spots WHERE x BETWEEN {X_RANGE[0]} AND {X_RANGE[1]} AND y BETWEEN {Y_RANGE[0]} AND {Y_RANGE[1]}")
def o25_window(spark, sf_dir):
    return aggregate.window_filter(dataset(spark, sf_dir).spots, X_RANGE, Y_RANGE)


@query("o35_neighbour_flag", """, near AS (SELECT cell_id, max((cell_id = src)::INT) own FROM (SELECT a.cell_id, b.cell_id src FROM cells a, cells b WHERE b.area >= (SELECT max(area) FROM cells) AND (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) <= 400) GROUP BY 1)
SELECT cell_id, CASE WHEN own = 1 THEN 'source' WHEN own = 0 THEN 'neighbour' ELSE 'other' END category FROM cells LEFT JOIN near USING (cell_id)""")
def o35_neighbour_flag(spark, sf_dir):
    cells = Stages(spark, sf_dir).get("cells")
    return graph.neighbour_flags(cells, cells.join(F.broadcast(cells.agg(F.max("area").alias("area"))), "area"), 20.0)


@query("o36_nearest_within", """, p AS (SELECT spot_id, cell_id, (x - cx) * (x - cx) + (y - cy) * (y - cy) d2 FROM spots, cells WHERE (x - cx) * (x - cx) + (y - cy) * (y - cy) <= 100)
SELECT spot_id point_id, arg_min(cell_id, (d2, cell_id)) target_id FROM p GROUP BY 1 HAVING sqrt(min(d2)) <= 3.0 + arg_min(cell_id, (d2, cell_id)) % 3""")
def o36_nearest_within(spark, sf_dir):
    stages = Stages(spark, sf_dir)
    targets = stages.get("cells").select(F.col("cell_id").alias("target_id"), F.col("cx").alias("tx_"), F.col("cy").alias("ty_"), (3.0 + F.col("cell_id") % 3).alias("radius"))
    return graph.nearest_within(targets, stages.data.spots.select(F.col("spot_id").alias("point_id"), F.col("x").alias("px"), F.col("y").alias("py")), 10.0)


@query("o37_core_halo", """, g AS (SELECT ceil((max(cx) + 1) / 3) w, ceil((max(cy) + 1) / 3) h FROM cells), t AS (SELECT * FROM (VALUES (0), (1), (2)) t(i))
SELECT cell_id id, a.i col, b.i "row", least(floor(cx / w), 2) = a.i AND least(floor(cy / h), 2) = b.i is_core FROM cells, g, t a, t b WHERE cx BETWEEN a.i * w - 15 AND (a.i + 1) * w + 15 AND cy BETWEEN b.i * h - 15 AND (b.i + 1) * h + 15""")
def o37_core_halo(spark, sf_dir):
    points = Stages(spark, sf_dir).get("cells").select(F.col("cell_id").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    return graph.core_halo(points, *_tiles(points), 15.0)


def _tiles(points: DataFrame) -> list[list[float]]:
    """Edges of 3 x 3 equal tiles that cover the points."""
    far = points.agg(F.ceil((F.max("x") + 1) / 3).alias("w"), F.ceil((F.max("y") + 1) / 3).alias("h")).first()
    return [[float(i * step) for i in range(4)] for step in (far["w"], far["h"])]


@query("o118_stitch", "SELECT cell_id id, area FROM cells")
def o118_stitch(spark, sf_dir):
    """O-118: results made tile by tile, halo included, and put together from the cores."""
    cells = Stages(spark, sf_dir).get("cells")
    points = cells.select(F.col("cell_id").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    specs = graph.core_halo(points, *_tiles(points), 15.0)
    tiles = specs.join(cells.select(F.col("cell_id").alias("id"), "area"), "id").select("id", "col", "row", "area")
    return graph.stitch(tiles, specs)


@query("o28_pip", """, e AS (SELECT cell_id, i, cx + 7 * cos(i * pi() / 4) xi, cy + 7 * sin(i * pi() / 4) yi, cx + 7 * cos((i + 7) % 8 * pi() / 4) xj, cy + 7 * sin((i + 7) % 8 * pi() / 4) yj, cx, cy FROM cells, range(8) r(i)),
hit AS (SELECT spot_id, cell_id, any_value((x - cx) * (x - cx) + (y - cy) * (y - cy)) d2 FROM spots, e WHERE x BETWEEN cx - 8 AND cx + 8 AND y BETWEEN cy - 8 AND cy + 8 GROUP BY 1, 2
  HAVING sum(((yi > y) <> (yj > y) AND x < (xj - xi) * (y - yi) / (CASE WHEN yj = yi THEN 1 ELSE yj - yi END) + xi)::INT) % 2 = 1)
SELECT s.spot_id, coalesce(h.cell_id, -1) cell_id FROM spots s LEFT JOIN (SELECT spot_id, arg_min(cell_id, (d2, cell_id)) cell_id FROM hit GROUP BY 1) h USING (spot_id)""")
def o28_pip(spark, sf_dir):
    stages = Stages(spark, sf_dir)
    at = lambda f, c: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.col(c) + 7 * f(i * F.pi() / 4))
    borders = stages.get("cells").select("cell_id", "cx", "cy", F.arrays_zip(at(F.cos, "cx").alias("x"), at(F.sin, "cy").alias("y")).alias("border"))
    return geometry.label_points(stages.data.spots.select("spot_id", "x", "y"), borders).select("spot_id", "cell_id")


@query("o102_union_spots", """SELECT 'cell_' || cell_id barcode, round(cx, 6) x, round(cy, 6) y, 1 tissue FROM cells UNION ALL SELECT 'background_' || bin_id, round(bx, 6), round(cy, 6), 0 FROM bins""")
def o102_union_spots(spark, sf_dir):
    stages = Stages(spark, sf_dir)
    return geometry.union_spots(stages.get("cells"), stages.get("bins")).select("barcode", r("x").alias("x"), r("y").alias("y"), "tissue")


@query("o103_contiguous_labels", "SELECT spot_id, CASE WHEN label >= 0 THEN dense_rank() OVER (PARTITION BY label >= 0 ORDER BY label) - 1 ELSE -1 END cell_index FROM spots")
def o103_contiguous_labels(spark, sf_dir):
    return geometry.contiguous_labels(dataset(spark, sf_dir).spots).select("spot_id", "cell_index")


@query("o22_contract_checks", """SELECT (SELECT count(*) FROM spots WHERE x IS NULL OR y IS NULL OR isnan(x) OR isnan(y)) bad_coordinates, (SELECT count(*) FROM spots WHERE label IS NULL) bad_labels, (SELECT count(*) FROM spots WHERE label >= 0) in_cells,
 (SELECT count(*) FROM spots WHERE label < 0) outside, (SELECT count(*) FROM counts WHERE n IS NULL OR isnan(n)) bad_expression, (SELECT count(*) FROM counts WHERE n < 0) negative, (SELECT count(*) FROM counts WHERE spot_id NOT IN (SELECT spot_id FROM spots)) orphans""")
def o22_contract_checks(spark, sf_dir):
    return validate.contract_counts(dataset(spark, sf_dir))


@query("o67_block_order", "SELECT cell_id, row_number() OVER (ORDER BY floor(cy / 64), floor(cx / 64), cy, cx, cell_id) - 1 pos FROM cells")
def o67_block_order(spark, sf_dir):
    return geometry.block_order(Stages(spark, sf_dir).get("cells"), 64).select("cell_id", "pos")


@query("o111_offsets", "SELECT cell_id, count(*) gene_count, CAST(sum(n) AS BIGINT) exp_count, CAST(coalesce(sum(count(*)) OVER (ORDER BY cell_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) \"offset\" FROM cell_expr GROUP BY 1")
def o111_offsets(spark, sf_dir):
    return geometry.cell_offsets(Stages(spark, sf_dir).get("cell_expr"))


@query("o07_cellbin_decode", "SELECT gene_id, CAST(row_number - 1 AS BIGINT) spot_id, n FROM cell_expr JOIN (SELECT cell_id, row_number() OVER (ORDER BY floor(cy / 64), floor(cx / 64), cy, cx, cell_id) AS row_number FROM cells) o USING (cell_id)")
def o07_cellbin_decode(spark, sf_dir):
    """O-07, O-10, O-111: the expression laid out by cell, and read back by the cells' row counts."""
    stages = Stages(spark, sf_dir)
    made = sinks.cell_layout(stages.get("cell_expr"), stages.get("cells"), 64)
    cell = made["cell"].select("idx", F.col("cell_id").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"), "gene_count")
    gene = made["gene"].select(F.col("gene_id").alias("idx"), F.col("gene_id").cast("string").alias("gene_name"))
    return cellbin.read_cellbin(cell, gene, made["cell_exp"], made["sidecar"]).counts


@query("o08_legacy_layout", "SELECT gene_id, CAST(dense_rank() OVER (ORDER BY cell_id) - 1 AS BIGINT) spot_id, n FROM cells JOIN cell_expr USING (cell_id)")
def o08_legacy_layout(spark, sf_dir):
    stages = Stages(spark, sf_dir)
    used = stages.get("cells").join(stages.get("cell_expr").select("cell_id").distinct(), "cell_id", "left_semi")
    return cellbin.read_legacy(used.select(F.col("cell_id").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y")), stages.get("cell_expr").select("cell_id", "gene_id", F.col("n").alias("count"))).counts


def _bin_file(stages: Stages) -> tuple[DataFrame, DataFrame]:
    """The counts as a bin matrix: expression rows by gene, and the genes' offsets."""
    spots = stages.data.spots.select("spot_id", "x", "y")
    rows = placed(stages.data.counts.join(spots, "spot_id").select("gene_id", "x", "y", F.col("n").alias("count")), ["gene_id", "x", "y"], "idx")
    rows = stage(rows, "bin-file")
    genes = rows.groupBy("gene_id").agg(F.count("*").alias("count"), F.min("idx").alias("offset"))
    return genes.select(F.col("gene_id").alias("idx"), F.col("gene_id").cast("string").alias("gene_name"), "offset", "count"), rows


@query("o11_bin_scan", f"""SELECT gene_id, x, y, n FROM counts JOIN spots USING (spot_id) WHERE x BETWEEN {X_RANGE[0]} AND {X_RANGE[1]} AND y BETWEEN {Y_RANGE[0]} AND {Y_RANGE[1]}""")
def o11_bin_scan(spark, sf_dir):
    """O-11: a bin matrix, cropped to a region by the scan."""
    d = cellbin.read_bins(*_bin_file(Stages(spark, sf_dir)), region_um=(*X_RANGE, *Y_RANGE), pitch_um=1.0)
    return d.counts.join(d.spots, "spot_id").select("gene_id", "x", "y", "n")


@query("o12_bin_pair", """, e AS (SELECT cell_id, i, cx + 7 * cos(i * pi() / 4) xi, cy + 7 * sin(i * pi() / 4) yi, cx + 7 * cos((i + 7) % 8 * pi() / 4) xj, cy + 7 * sin((i + 7) % 8 * pi() / 4) yj, cx, cy FROM cells, range(8) r(i)),
held AS (SELECT DISTINCT spot_id, x, y FROM counts JOIN spots USING (spot_id)),
hit AS (SELECT spot_id, cell_id, any_value((x - cx) * (x - cx) + (y - cy) * (y - cy)) d2 FROM held, e WHERE x BETWEEN cx - 8 AND cx + 8 AND y BETWEEN cy - 8 AND cy + 8 GROUP BY 1, 2
  HAVING sum(((yi > y) <> (yj > y) AND x < (xj - xi) * (y - yi) / (CASE WHEN yj = yi THEN 1 ELSE yj - yi END) + xi)::INT) % 2 = 1),
own AS (SELECT spot_id, arg_min(cell_id, (d2, cell_id)) cell_id FROM hit GROUP BY 1)
SELECT h.x, h.y, coalesce(dense_rank() OVER (PARTITION BY o.cell_id IS NULL ORDER BY o.cell_id) - 1, -1) * (o.cell_id IS NOT NULL)::BIGINT - (o.cell_id IS NULL)::BIGINT label FROM held h LEFT JOIN own o USING (spot_id)""")
def o12_bin_pair(spark, sf_dir):
    """O-12: spots of a bin matrix labelled by the borders of cells, the labels numbered over cells that hold a spot."""
    stages = Stages(spark, sf_dir)
    at = lambda f, c: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.col(c) + 7 * f(i * F.pi() / 4))
    borders = stages.get("cells").select("cell_id", F.col("cell_id").alias("original_id"), "cx", "cy", F.arrays_zip(at(F.cos, "cx").alias("x"), at(F.sin, "cy").alias("y")).alias("border"))
    return cellbin.pair(cellbin.read_bins(*_bin_file(stages), pitch_um=1.0), borders).spots.select("x", "y", "label")


@query("o15_annotated", "SELECT spot_id, CASE WHEN area >= (SELECT avg(area) FROM cells) THEN 'large' END annotation FROM spots LEFT JOIN cells ON label = cell_id")
def o15_annotated(spark, sf_dir):
    """O-15: only the cells that the metadata lists stay cells; here those of at least the mean area."""
    stages = Stages(spark, sf_dir)
    cells = stages.get("cells")
    listed = cells.crossJoin(F.broadcast(cells.agg(F.avg("area").alias("middle")))).where("area >= middle").select("cell_id", F.lit("T1").alias("section_id"), F.lit("large").alias("annotation"))
    data, names = cellbin.annotated(stages.data, listed, "T1")
    return data.spots.join(names, F.col("label") == F.col("cell_id"), "left").select("spot_id", "annotation")


@query("o16_largest_genes", ", t AS (SELECT gene_id, row_number() OVER (ORDER BY sum(n) DESC, gene_id DESC) - 1 k FROM counts GROUP BY 1) SELECT CAST(k AS BIGINT) gene_id, spot_id, n FROM counts JOIN t USING (gene_id) WHERE k < 8")
def o16_largest_genes(spark, sf_dir):
    return cellbin.largest_genes(dataset(spark, sf_dir), 8).counts


@query("o140_scale_sweep", f", tot AS (SELECT pos, scale, avg(CASE WHEN yy - wy * wy / w > 1e-15 THEN 1 - greatest(yy - 2 * alpha * yn + alpha * alpha * nn, 0) / (yy - wy * wy / w) END) r2, avg(alpha) alpha FROM fits, big GROUP BY 1, 2) SELECT scale, round(alpha, 6) alpha_mean, round(r2, 6) r2_mean FROM tot")
def o140_scale_sweep(spark, sf_dir):
    """O-140: every forced scale's fit, from one pass over the edges."""
    stages = Stages(spark, sf_dir)
    out = fit.scale_sweep(stages.get("pred"), stages.get("bin_expr"), stages.get("bins"), stages.get("ranks"), list(SCALES))
    return out.select("scale", r("alpha_mean").alias("alpha_mean"), r("r2_mean").alias("r2_mean"))


@query("o141_bin_sweep", """, s AS (SELECT * FROM (VALUES (6.0::DOUBLE), (10.0::DOUBLE), (20.0::DOUBLE)) v(size)), m AS (SELECT size, spot_id, least(CAST(floor((x - x0) / size) AS BIGINT), greatest(1, CAST(ceil((x1 - x0) / size) AS BIGINT)) - 1) * greatest(1, CAST(ceil((y1 - y0) / size) AS BIGINT)) + least(CAST(floor((y - y0) / size) AS BIGINT), greatest(1, CAST(ceil((y1 - y0) / size) AS BIGINT)) - 1) b FROM spots, ext, s WHERE label < 0),
k AS (SELECT size, b, count(*) area FROM m GROUP BY 1, 2) SELECT size bin_size, count(*) n_bins, round(avg(area), 6) area_mean, (SELECT sum(n) FROM counts JOIN m USING (spot_id) WHERE m.size = k.size) total FROM k GROUP BY 1""")
def o141_bin_sweep(spark, sf_dir):
    """O-141: the background bins of several sizes in one job."""
    stages = Stages(spark, sf_dir)
    empty = aggregate.empty_bins_of_sizes(stages.data.spots, [6.0, 10.0, 20.0])
    table = empty.groupBy("bin_size", "bin_id").agg(F.count("*").alias("area")).groupBy("bin_size").agg(F.count("*").alias("n_bins"), r(F.avg("area")).alias("area_mean"))
    totals = empty.join(stages.data.counts, "spot_id").groupBy("bin_size").agg(F.sum("n").alias("total"))
    return table.join(totals, "bin_size")


def _model(**more) -> LeakageModel:
    return LeakageModel(bin_size=BIN, max_radius=RADIUS, lambda_grid=SCALES, n_lambda_genes=N_LAMBDA, r2_threshold=THRESHOLD, **more)


@query("o44_block_fit", "SELECT gene_id, CAST(rk AS BIGINT) rk, round(alpha, 6) alpha, round(r2, 6) r2 FROM fit")
def o44_block_fit(spark, sf_dir):
    """O-44 by matrix products: the fit of every gene from sums over tiles and blocks of genes."""
    model = _model(backend="blocks")
    model.fit_transform(dataset(spark, sf_dir), check=False)
    return model.fit_.select("gene_id", F.col("rank").cast("long").alias("rk"), r("alpha").alias("alpha"), r("r2").alias("r2"))


@query("o48_block_corrected", "SELECT gene_id, cell_id, n_raw, round(n_corrected, 4) n_corrected FROM corr")
def o48_block_corrected(spark, sf_dir):
    """O-48 by matrix products."""
    return _model(backend="blocks").fit_transform(dataset(spark, sf_dir), check=False).select("gene_id", "cell_id", "n_raw", r("n_corrected", 4).alias("n_corrected"))


@query("o37_tiled_correction", "SELECT gene_id, cell_id, n_raw, round(n_corrected, 4) n_corrected FROM corr")
def o37_tiled_correction(spark, sf_dir):
    """O-37, O-118: the correction made in 3 x 3 tiles with a halo of the radius, and stitched by core."""
    model = _model()
    model.fit_transform(dataset(spark, sf_dir), check=False)
    tiles = model.correct_tiles(*_tiles(model.cells_.select(F.col("cx").alias("x"), F.col("cy").alias("y"))))
    return tiling.stitched(tiles).select("gene_id", "cell_id", "n_raw", r("n_corrected", 4).alias("n_corrected"))
