"""Registered queries of the evaluation metrics, each with its SQL.

Cells belong to groups by their tile column (group = cell_id / 1000 mod 5). The 'fixed' table is the raw one less
an amount that depends on gene and cell, and the reference is the raw table's cells with a library of the mean at least, so that every metric has two sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seepage.functions.scalar import log2_fold_change
from seepage.jobs.spatial import BASE, Stages, r
from seepage.operators import metrics
from seepage.sources.adapter import table
from seepage.storage import stage

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
GENES, GROUPS = 20, 5

MORE = BASE + """,
grp AS (SELECT cell_id, CAST((cell_id // 1000) % 5 AS BIGINT) grp FROM cells),
members AS (SELECT grp, count(*) members FROM grp GROUP BY 1 HAVING count(*) >= 3),
lib AS (SELECT cell_id, coalesce(sum(CASE WHEN n < 0 THEN 0 ELSE n END), 0) library FROM cells LEFT JOIN cell_expr USING (cell_id) GROUP BY 1),
fixed AS (SELECT gene_id, cell_id, greatest(n - (gene_id + cell_id) % 7, 0) n FROM cell_expr),
norm AS (SELECT gene_id, cell_id, ln(1 + n / greatest(library, 1) * 1e4) v FROM cell_expr JOIN lib USING (cell_id)),
pb_raw AS (SELECT grp, gene_id, sum(n) / any_value(members) mean FROM cell_expr JOIN grp USING (cell_id) JOIN members USING (grp) GROUP BY 1, 2),
pb_fixed AS (SELECT grp, gene_id, sum(n) / any_value(members) mean FROM fixed JOIN grp USING (cell_id) JOIN members USING (grp) GROUP BY 1, 2),
odd AS (SELECT grp, count(*) members FROM grp JOIN lib USING (cell_id) WHERE library >= (SELECT avg(library) FROM lib) GROUP BY 1 HAVING count(*) >= 3),
ref AS (SELECT grp, gene_id, sum(n) / any_value(members) mean FROM cell_expr JOIN grp USING (cell_id) JOIN odd USING (grp) JOIN lib USING (cell_id) WHERE library >= (SELECT avg(library) FROM lib) GROUP BY 1, 2),
cg AS (SELECT c.cell_id, g.gene_id FROM cells c, genes g),
xy AS (SELECT cell_id, gene_id, coalesce(f.n, 0) x, coalesce(e.n, 0) y FROM cell_expr e FULL JOIN fixed f USING (cell_id, gene_id)),
pear AS (SELECT cell_id, 20.0::DOUBLE n, sum(x) sx, sum(y) sy, sum(x * x) sxx, sum(y * y) syy, sum(x * y) sxy, sum((x - y) * (x - y)) sdd FROM xy GROUP BY 1)
"""  # fmt: skip


def corr(n: str, m: str = "") -> str:
    """A correlation of moment columns in SQL; null for a constant side."""
    vx, vy = f"({n} * {m}sxx - {m}sx * {m}sx)", f"({n} * {m}syy - {m}sy * {m}sy)"
    return f"(CASE WHEN {vx} > 1e-12 * greatest({n} * {m}sxx, 1e-300) AND {vy} > 1e-12 * greatest({n} * {m}syy, 1e-300) THEN ({n} * {m}sxy - {m}sx * {m}sy) / sqrt({vx} * {vy}) END)"


def query(name: str, sql: str, base: str = MORE):
    def put(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = base + sql
        return f

    return put


class Tables(Stages):
    def groups(self) -> DataFrame:
        return self.get("cells").select("cell_id", (F.floor(F.col("cell_id") / 1000) % GROUPS).cast("long").alias("grp"))

    def fixed(self) -> DataFrame:
        return self.get("cell_expr").withColumn("n", F.greatest(F.col("n") - (F.col("gene_id") + F.col("cell_id")) % 7, F.lit(0.0)))

    def _norm(self) -> DataFrame:
        return metrics.normalised(self.get("cells"), self.get("cell_expr"))

    def _pb_raw(self) -> DataFrame:
        return metrics.pseudobulk(self.get("cell_expr").withColumnRenamed("n", "v"), self.groups())

    def _pb_fixed(self) -> DataFrame:
        return metrics.pseudobulk(self.fixed().withColumnRenamed("n", "v"), self.groups())

    def _reference(self) -> DataFrame:
        sizes = metrics.library_sizes(self.get("cells"), self.get("cell_expr"))
        rich = sizes.crossJoin(F.broadcast(sizes.agg(F.avg("library").alias("middle")))).where("library >= middle")  # one row
        return metrics.pseudobulk(self.get("cell_expr").withColumnRenamed("n", "v"), self.groups().join(rich.select("cell_id"), "cell_id", "left_semi"))


@query("o52_library_qc", "SELECT count(*) n_cells, count(*) FILTER (WHERE library = 0) n_zero, sum(library) total, min(library) least, median(library) median, max(library) most, (SELECT count(*) FROM cell_expr WHERE n < 0) n_negative FROM lib")
def o52_library_qc(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return metrics.library_summary(t.get("cells"), t.get("cell_expr"))


@query("o70_log_cp10k", "SELECT gene_id, cell_id, round(v, 6) v FROM norm")
def o70_log_cp10k(spark, sf_dir):
    return Tables(spark, sf_dir).get("norm").select("gene_id", "cell_id", r("v").alias("v"))


@query("o53_pseudobulk", "SELECT grp, gene_id, round(sum(v) / any_value(members), 6) mean FROM norm JOIN grp USING (cell_id) JOIN members USING (grp) GROUP BY 1, 2")
def o53_pseudobulk(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return metrics.pseudobulk(t.get("norm"), t.groups()).select("grp", "gene_id", r("mean").alias("mean"))


@query("o63_top_genes_total", "SELECT gene_id, sum(n) total FROM cell_expr GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def o63_top_genes_total(spark, sf_dir):
    return metrics.top_genes(Tables(spark, sf_dir).get("cell_expr"), 8)


@query("o64_top_var", "SELECT gene_id, round(sum(v * v) / c - (sum(v) / c) * (sum(v) / c), 6) variance FROM norm, (SELECT count(*)::DOUBLE c FROM cells) GROUP BY gene_id, c ORDER BY sum(v * v) / c - (sum(v) / c) * (sum(v) / c) DESC, 1 LIMIT 8")
def o64_top_var(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return metrics.variable_genes(t.get("norm"), t.get("cells").count(), 8).select("gene_id", r("variance").alias("variance"))


@query("o71_log2fc", ", m AS (SELECT gene_id, coalesce(sum(mean) FILTER (WHERE grp = 0), 0) a, coalesce(sum(mean) FILTER (WHERE grp = 1), 0) b FROM pb_raw GROUP BY 1) SELECT gene_id, round(log2((a + 0.01) / (b + 0.01)), 6) log2fc FROM m")
def o71_log2fc(spark, sf_dir):
    mean = lambda g: F.coalesce(F.sum(F.when(F.col("grp") == g, F.col("mean"))), F.lit(0.0))
    return Tables(spark, sf_dir).get("pb_raw").groupBy("gene_id").agg(r(log2_fold_change(mean(0), mean(1))).alias("log2fc"))


@query("o80_rmse", "SELECT round(sqrt(sum((x - y) * (x - y)) / ((SELECT count(*) FROM cells) * 20)), 6) rmse FROM xy")
def o80_rmse(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return metrics.rmse(t.fixed(), t.get("cell_expr"), t.get("cells").count() * GENES).select(r("rmse").alias("rmse"))


@query("o81_cell_r2", f"SELECT cell_id, CASE WHEN {corr('n')} IS NOT NULL THEN round(least(power({corr('n')}, 2), 1), 6) END r2 FROM pear")
def o81_cell_r2(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return metrics.cell_r2(t.fixed(), t.get("cell_expr"), GENES).select("cell_id", r("r2").alias("r2"))


@query("o82_r2_summary", f", c AS (SELECT CASE WHEN {corr('n')} IS NOT NULL THEN least(power({corr('n')}, 2), 1) END r2 FROM pear) SELECT round(avg(r2), 6) mean, round(median(r2), 6) median, round(quantile_cont(r2, 0.25), 6) q25, round(quantile_cont(r2, 0.75), 6) q75, count(r2) n_valid FROM c")
def o82_r2_summary(spark, sf_dir):
    t = Tables(spark, sf_dir)
    s = metrics.summary(metrics.cell_r2(t.fixed(), t.get("cell_expr"), GENES), "r2")
    return s.select(*(r(c).alias(c) for c in ("mean", "median", "q25", "q75")), "n_valid")


@query("o83_cell_determination", "SELECT cell_id, CASE WHEN syy - sy * sy / 20 <> 0 THEN round(1 - sdd / (syy - sy * sy / 20), 6) END r2 FROM pear")
def o83_cell_determination(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return metrics.cell_determination(t.fixed(), t.get("cell_expr"), GENES).select("cell_id", r("r2").alias("r2"))


@query("o84_group_corr", f""", m AS (SELECT a.grp a, b.grp b, sum(a.mean * b.mean) sxy FROM pb_raw a JOIN pb_raw b USING (gene_id) WHERE a.grp < b.grp GROUP BY 1, 2), o AS (SELECT grp, sum(mean) s, sum(mean * mean) q FROM pb_raw GROUP BY 1),
k AS (SELECT m.a, m.b, sxy, x.s sx, x.q sxx, y.s sy, y.q syy FROM m JOIN o x ON x.grp = a JOIN o y ON y.grp = b) SELECT a, b, round({corr('20')}, 6) r FROM k""")
def o84_group_corr(spark, sf_dir):
    return metrics.group_correlations(Tables(spark, sf_dir).get("pb_raw"), GENES).select("a", "b", r("r").alias("r"))


CONCORD = ", j AS (SELECT grp, gene_id, f.mean x, ref.mean y FROM pb_fixed f JOIN ref USING (grp, gene_id))"
SUMS = "count(*)::DOUBLE n, sum(x) sx, sum(y) sy, sum(x * x) sxx, sum(y * y) syy, sum(x * y) sxy"


@query("o85_concordance_pearson", f"{CONCORD}, k AS (SELECT grp, {SUMS} FROM j GROUP BY 1) SELECT grp, round({corr('n')}, 6) r, CAST(n AS BIGINT) shared FROM k")
def o85_concordance_pearson(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return metrics.concordance(t.get("pb_fixed"), t.get("reference")).select("grp", r("r").alias("r"), "shared")


@query("o85_concordance_spearman", f"""{CONCORD}, q AS (SELECT grp, rank() OVER (PARTITION BY grp ORDER BY x) + (count(*) OVER (PARTITION BY grp, x) - 1) / 2.0::DOUBLE x, rank() OVER (PARTITION BY grp ORDER BY y) + (count(*) OVER (PARTITION BY grp, y) - 1) / 2.0::DOUBLE y FROM j),
k AS (SELECT grp, {SUMS} FROM q GROUP BY 1) SELECT grp, round({corr('n')}, 6) r, CAST(n AS BIGINT) shared FROM k""")
def o85_concordance_spearman(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return metrics.concordance(t.get("pb_fixed"), t.get("reference"), "spearman").select("grp", r("r").alias("r"), "shared")


def _gene_moments(name: str) -> str:
    return f"(SELECT gene_id, sum(x) sx, sum(y) sy, sum(x * x) sxx, sum(y * y) syy, sum(x * y) sxy FROM (SELECT gene_id, grp, coalesce(p.mean, 0) x, coalesce(ref.mean, 0) y FROM {name} p FULL JOIN ref USING (gene_id, grp)) GROUP BY 1)"


@query("o86_gene_improvement", f", k AS (SELECT gene_id, {corr('5', 'a.')} r_raw, {corr('5', 'b.')} r_fixed FROM {_gene_moments('pb_raw')} a JOIN {_gene_moments('pb_fixed')} b USING (gene_id)) SELECT gene_id, round(r_raw, 6) r_raw, round(r_fixed, 6) r_fixed, round(r_fixed - r_raw, 6) improvement FROM k")
def o86_gene_improvement(spark, sf_dir):
    t = Tables(spark, sf_dir)
    g = metrics.gene_improvement(t.get("pb_raw"), t.get("pb_fixed"), t.get("reference"), GROUPS)
    return g.select("gene_id", *(r(c).alias(c) for c in ("r_raw", "r_fixed", "improvement")))


TARGET = ", target AS (SELECT gene_id, arg_max(grp, (mean, -grp)) target, max(mean) peak, sum(mean) total FROM ref GROUP BY 1)"


@query("o87_contamination", f"{TARGET}, s AS (SELECT gene_id, target, sum(mean) total, sum(CASE WHEN grp = target THEN mean ELSE 0 END) own FROM pb_fixed JOIN target USING (gene_id) GROUP BY 1, 2) SELECT gene_id, target, CASE WHEN own > 0 THEN round((total - own) / 4 / own, 6) END score FROM s")
def o87_contamination(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return metrics.contamination(t.get("pb_fixed"), t.get("reference"), GROUPS).select("gene_id", "target", r("score").alias("score"))


def _scores(name: str) -> str:
    return f"(SELECT gene_id, CASE WHEN own > 0 THEN (total - own) / 4 / own END score FROM (SELECT gene_id, sum(mean) total, sum(CASE WHEN grp = target THEN mean ELSE 0 END) own FROM {name} JOIN target USING (gene_id) GROUP BY 1))"


@query("o87_contamination_summary", f"""{TARGET}, b AS (SELECT f.score, r.score raw, r.score - f.score less FROM {_scores('pb_fixed')} f LEFT JOIN {_scores('pb_raw')} r USING (gene_id))
SELECT round(avg(score), 6) mean_score, round(median(score), 6) median_score, count(score) n_genes, round(avg(less), 6) mean_reduction, round(median(less), 6) median_reduction, round(avg(less) FILTER (WHERE raw > 1), 6) mean_reduction_high, count(*) FILTER (WHERE raw > 1) n_high FROM b""")
def o87_contamination_summary(spark, sf_dir):
    t = Tables(spark, sf_dir)
    one = metrics.contamination_summary(t.get("pb_fixed"), t.get("reference"), GROUPS, t.get("pb_raw"))
    return one.select(*(r(c).alias(c) for c in ("mean_score", "median_score", "mean_reduction", "median_reduction", "mean_reduction_high")), "n_genes", "n_high")


@query("o88_specificity", f"{TARGET} SELECT gene_id, target, round(peak / total, 6) specificity, round(peak, 6) peak, peak / total >= 0.21 AND peak >= 1 marker FROM target")
def o88_specificity(spark, sf_dir):
    s = metrics.specificity(Tables(spark, sf_dir).get("reference"), 0.21)
    return s.select("gene_id", "target", r("specificity").alias("specificity"), r("peak").alias("peak"), "marker")


@query("o90_t_stat", """, k AS (SELECT grp, gene_id, any_value(members) m, coalesce(sum(v), 0) s, coalesce(sum(v * v), 0) q FROM members CROSS JOIN genes LEFT JOIN (SELECT * FROM norm JOIN grp USING (cell_id)) z USING (grp, gene_id) GROUP BY 1, 2),
w AS (SELECT a.gene_id, a.grp a, b.grp b, a.m + b.m - 2 df, a.s / a.m - b.s / b.m diff, sqrt(greatest((a.q - a.s * a.s / a.m + b.q - b.s * b.s / b.m) / (a.m + b.m - 2), 0) * (1 / a.m + 1 / b.m)) se FROM k a JOIN k b USING (gene_id) WHERE a.grp < b.grp)
SELECT gene_id, a, b, CASE WHEN se > 1e-12 THEN round(diff / se, 6) END t, df FROM w""")
def o90_t_stat(spark, sf_dir):
    t = Tables(spark, sf_dir)
    genes = t.data.counts.select("gene_id").distinct()
    return metrics.t_statistics(t.get("norm"), t.groups(), genes).select("gene_id", "a", "b", r("t").alias("t"), "df")


@query("o91_adjusted_rand", """, l AS (SELECT grp a, cell_id % 3 b FROM grp), c AS (SELECT a, b, count(*) n FROM l GROUP BY 1, 2), k AS (SELECT sum(n * (n - 1) / 2) x, sum(n) t FROM c), ra AS (SELECT sum(n * (n - 1) / 2) v FROM (SELECT count(*) n FROM l GROUP BY a)), rb AS (SELECT sum(n * (n - 1) / 2) v FROM (SELECT count(*) n FROM l GROUP BY b))
SELECT round((x - ra.v * rb.v / (t * (t - 1) / 2)) / ((ra.v + rb.v) / 2 - ra.v * rb.v / (t * (t - 1) / 2)), 6) ari FROM k, ra, rb""")
def o91_adjusted_rand(spark, sf_dir):
    labels = Tables(spark, sf_dir).groups().select(F.col("grp").alias("a"), (F.col("cell_id") % 3).alias("b"))
    return metrics.adjusted_rand(labels, "a", "b").select(r("ari").alias("ari"))


@query("o57_pivot_summary", """, s AS (SELECT grp, n FROM cell_expr JOIN grp USING (cell_id) WHERE gene_id = 0)
SELECT method, round(avg(n) FILTER (WHERE grp = 0), 6) mean_a, round(avg(n) FILTER (WHERE grp = 1), 6) mean_b, median(n) FILTER (WHERE grp = 0) median_a, median(n) FILTER (WHERE grp = 1) median_b, count(*) FILTER (WHERE grp = 0) count_a, count(*) FILTER (WHERE grp = 1) count_b,
 round(log2((avg(n) FILTER (WHERE grp = 0) + 1e-6) / (avg(n) FILTER (WHERE grp = 1) + 1e-6)), 6) log2fc
FROM (SELECT 'raw' method, grp, n FROM cell_expr JOIN grp USING (cell_id) WHERE gene_id = 0 UNION ALL SELECT 'fixed', grp, n FROM fixed JOIN grp USING (cell_id) WHERE gene_id = 0) GROUP BY 1""")
def o57_pivot_summary(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.get("cell_expr").withColumn("method", F.lit("raw")).unionByName(t.fixed().withColumn("method", F.lit("fixed"))).where("gene_id = 0").join(t.groups(), "cell_id")
    wide = rows.withColumn("side", F.when(F.col("grp") == 0, "a").when(F.col("grp") == 1, "b")).groupBy("method").pivot("side", ["a", "b"]).agg(F.avg("n").alias("mean"), F.expr("percentile(n, 0.5)").alias("median"), F.count("n").alias("count"))
    return wide.select("method", *(r(f"{s}_mean").alias(f"mean_{s}") for s in "ab"), *(F.col(f"{s}_median").alias(f"median_{s}") for s in "ab"), *(F.coalesce(f"{s}_count", F.lit(0)).cast("long").alias(f"count_{s}") for s in "ab"), r(log2_fold_change(F.col("a_mean"), F.col("b_mean"), 1e-6)).alias("log2fc"))


@query("o58_specificity_score", """, v AS (SELECT avg(n) FILTER (WHERE grp = 0) a, avg(n) FILTER (WHERE grp <> 0) b FROM fixed JOIN grp USING (cell_id) WHERE gene_id = 1), w AS (SELECT avg(n) FILTER (WHERE grp = 0) a, avg(n) FILTER (WHERE grp <> 0) b FROM cell_expr JOIN grp USING (cell_id) WHERE gene_id = 1)
SELECT round(v.a, 6) mean_source, round(v.b, 6) mean_other, round(v.a / nullif(v.b, 0), 6) ratio, round(100 * v.a / nullif(w.a, 0), 6) retained, round(100 * (1 - v.b / nullif(w.b, 0)), 6) removed FROM v, w""")
def o58_specificity_score(spark, sf_dir):
    t = Tables(spark, sf_dir)
    means = lambda df, p: df.where("gene_id = 1").join(t.groups(), "cell_id").agg(F.avg(F.when(F.col("grp") == 0, F.col("n"))).alias(f"{p}a"), F.avg(F.when(F.col("grp") != 0, F.col("n"))).alias(f"{p}b"))
    one = means(t.fixed(), "v").crossJoin(means(t.get("cell_expr"), "w"))
    q = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return one.select(r("va").alias("mean_source"), r("vb").alias("mean_other"), r(q("va", "vb")).alias("ratio"), r(100 * q("va", "wa")).alias("retained"), r(100 * (1 - q("vb", "wb"))).alias("removed"))


def _pooled(name: str) -> str:
    on = "coalesce(r.mean, 0) >= 0.25 * peak AND r.mean IS NOT NULL"
    return f"(SELECT g.gene_id, sum(CASE WHEN {on} THEN coalesce(p.mean, 0) * members END) / nullif(sum(CASE WHEN {on} THEN members END), 0) i, sum(CASE WHEN NOT ({on}) THEN coalesce(p.mean, 0) * members END) / nullif(sum(CASE WHEN NOT ({on}) THEN members END), 0) o FROM target g CROSS JOIN members m LEFT JOIN ref r ON r.gene_id = g.gene_id AND r.grp = m.grp LEFT JOIN {name} p ON p.gene_id = g.gene_id AND p.grp = m.grp GROUP BY 1)"


@query("o59_retention_removal", f"{TARGET} SELECT gene_id, round(a.i / nullif(b.i, 0), 6) retention, round(1 - a.o / nullif(b.o, 0), 6) removal FROM {_pooled('pb_fixed')} a JOIN {_pooled('pb_raw')} b USING (gene_id)")
def o59_retention_removal(spark, sf_dir):
    t = Tables(spark, sf_dir)
    sizes = t.groups().groupBy("grp").agg(F.count("*").alias("members")).where("members >= 3")
    return metrics.retention_removal(t.get("pb_fixed"), t.get("pb_raw"), t.get("reference"), sizes).select("gene_id", r("retention").alias("retention"), r("removal").alias("removal"))


@query("o60_top2_entropy", """, t AS (SELECT cell_id, sum(n) total, list_sort(list(n), 'DESC') w FROM cell_expr GROUP BY 1) SELECT cell_id, round(w[1] / total, 6) top1, round(coalesce(w[2], 0) / total, 6) top2, round((w[1] - coalesce(w[2], 0)) / total, 6) gap, round(list_sum(list_transform(w, lambda x: CASE WHEN x > 0 THEN -(x / total) * ln(x / total) ELSE 0 END)), 6) entropy FROM t WHERE total > 0""")
def o60_top2_entropy(spark, sf_dir):
    return metrics.top_two(Tables(spark, sf_dir).get("cell_expr"), "cell_id", "n").select("cell_id", *(r(c).alias(c) for c in ("top1", "top2", "gap", "entropy")))


def _fc(name: str) -> str:
    return f"(SELECT gene_id, log2((coalesce(sum(mean) FILTER (WHERE grp = 0), 0) + 0.01) / (coalesce(sum(mean) FILTER (WHERE grp = 1), 0) + 0.01)) fc FROM {name} WHERE grp IN (0, 1) GROUP BY 1)"


@query("o95_log2fc_delta", f"SELECT gene_id, round(a.fc, 6) raw_fc, round(b.fc, 6) fixed_fc, round(b.fc - a.fc, 6) delta, CASE WHEN a.fc >= 0 THEN b.fc - a.fc > 0 ELSE b.fc - a.fc < 0 END improved FROM {_fc('pb_raw')} a JOIN {_fc('pb_fixed')} b USING (gene_id)")
def o95_log2fc_delta(spark, sf_dir):
    t = Tables(spark, sf_dir)
    d = metrics.fold_change_delta(t.get("pb_raw"), t.get("pb_fixed"), 0, 1)
    return d.select("gene_id", *(r(c).alias(c) for c in ("raw_fc", "fixed_fc", "delta")), "improved")


@query("o96_route_summary", """, route AS (SELECT x.grp source, y.grp target, x.mean * y.mean / (50 + x.mean * y.mean) p, method FROM (SELECT *, 'raw' method FROM pb_raw UNION ALL SELECT *, 'fixed' FROM pb_fixed) x JOIN (SELECT grp, gene_id, mean, 'raw' m FROM pb_raw UNION ALL SELECT grp, gene_id, mean, 'fixed' FROM pb_fixed) y ON x.gene_id = 0 AND y.gene_id = 1 AND x.method = y.m)
SELECT method, round(sum(p), 6) total, round(sum(p) FILTER (WHERE source = target), 6) autocrine, round(sum(p) FILTER (WHERE source <> target), 6) paracrine, round(sum(p) FILTER (WHERE source = target) / nullif(sum(p) FILTER (WHERE source <> target), 0), 6) ratio FROM route GROUP BY 1""")
def o96_route_summary(spark, sf_dir):
    """O-96, O-97: routes from the ligand (gene 0) of one group to the receptor (gene 1) of another. Groups are few."""
    t = Tables(spark, sf_dir)
    both = t.get("pb_raw").withColumn("method", F.lit("raw")).unionByName(t.get("pb_fixed").withColumn("method", F.lit("fixed")))
    ligand = both.where("gene_id = 0").select("method", F.col("grp").alias("source"), F.col("mean").alias("x"))
    receptor = both.where("gene_id = 1").select("method", F.col("grp").alias("target"), F.col("mean").alias("y"))
    route = ligand.join(receptor, "method").withColumn("p", F.col("x") * F.col("y") / (50 + F.col("x") * F.col("y")))
    on = lambda c: F.sum(F.when(c, F.col("p")))
    same = F.col("source") == F.col("target")
    sums = route.groupBy("method").agg(F.sum("p").alias("total"), on(same).alias("autocrine"), on(~same).alias("paracrine"))
    return sums.select("method", *(r(c).alias(c) for c in ("total", "autocrine", "paracrine")), r(F.try_divide("autocrine", "paracrine")).alias("ratio"))


@query("o98_common_cells", "SELECT cell_id FROM cell_expr GROUP BY 1 HAVING count(DISTINCT gene_id) = (SELECT count(DISTINCT gene_id) FROM cell_expr)")
def o98_common_cells(spark, sf_dir):
    return metrics.common_members(Tables(spark, sf_dir).get("cell_expr"), "gene_id", "cell_id")


@query("o116_incremental_merge", ", n AS (SELECT gene_id, cell_id, n FROM fixed WHERE n > 0) SELECT gene_id, cell_id, n FROM cell_expr WHERE cell_id NOT IN (SELECT cell_id FROM n) UNION ALL SELECT gene_id, cell_id, n FROM n")
def o116_incremental_merge(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return metrics.merge_incremental(t.get("cell_expr"), t.fixed().select("gene_id", "cell_id", "n").where("n > 0"), "cell_id").select("gene_id", "cell_id", "n")


@query("o53_embedding_profiles", "WITH m AS (SELECT label, count(*) c FROM embeddings WHERE label IS NOT NULL GROUP BY 1), x AS (SELECT label, unnest(embedding) v, generate_subscripts(embedding, 1) - 1 dim FROM embeddings WHERE label IS NOT NULL) SELECT CAST(label AS BIGINT) grp, CAST(dim AS BIGINT) gene_id, round(sum(v::DOUBLE) / any_value(c), 6) mean FROM x JOIN m USING (label) WHERE c >= 3 GROUP BY 1, 2", "")
def o53_embedding_profiles(spark, sf_dir):
    """O-53 on a dense table: label means of embedding dimensions."""
    e = table(spark, sf_dir, "embeddings").where("label is not null")
    rows = e.select(F.col("vec_id").alias("cell_id"), F.posexplode("embedding").alias("gene_id", "v")).select("cell_id", F.col("gene_id").cast("long").alias("gene_id"), F.col("v").cast("double").alias("v"))
    groups = e.select(F.col("vec_id").alias("cell_id"), F.col("label").cast("long").alias("grp"))
    return metrics.pseudobulk(stage(rows, "dims"), groups).select("grp", "gene_id", r("mean").alias("mean"))
