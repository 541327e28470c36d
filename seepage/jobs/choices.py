"""Registered queries of selections and comparisons, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seepage.jobs.evaluation import GENES, GROUPS, MORE, Tables, _gene_moments, corr
from seepage.jobs.spatial import r
from seepage.operators import clustering, metrics, selection
from seepage.sources.adapter import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def put(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = MORE + sql
        return f

    return put


@query("o65_top_improved", f", k AS (SELECT gene_id, {corr('5', 'a.')} r_raw, {corr('5', 'b.')} - {corr('5', 'a.')} improvement FROM {_gene_moments('pb_raw')} a JOIN {_gene_moments('pb_fixed')} b USING (gene_id)) SELECT gene_id, round(improvement, 6) improvement FROM k WHERE r_raw > 0 AND improvement > 0 ORDER BY k.improvement DESC, 1 LIMIT 10")
def o65_top_improved(spark, sf_dir):
    t = Tables(spark, sf_dir)
    g = metrics.gene_improvement(t.get("pb_raw"), t.get("pb_fixed"), t.get("reference"), GROUPS)
    return selection.top_improved(g).select("gene_id", r("improvement").alias("improvement"))


@query("o66_ratio_extremes", """, m AS (SELECT gene_id, coalesce(sum(mean) FILTER (WHERE grp = 0), 0) / nullif(coalesce(sum(mean) FILTER (WHERE grp = 1), 0), 0) ratio FROM pb_raw GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY ratio DESC, gene_id) u, row_number() OVER (ORDER BY ratio, gene_id) d FROM m WHERE ratio IS NOT NULL)
SELECT gene_id, round(ratio, 6) ratio, CASE WHEN u <= 4 THEN 'top' ELSE 'bottom' END side FROM k WHERE u <= 4 OR d <= 4""")
def o66_ratio_extremes(spark, sf_dir):
    return selection.ratio_extremes(Tables(spark, sf_dir).get("pb_raw"), 0, 1, 4).select("gene_id", r("ratio").alias("ratio"), "side")


@query("o68_best_method", """, s AS (SELECT r.grp, 'raw' method, sqrt(avg((p.mean - r.mean) * (p.mean - r.mean))) rmse FROM ref r JOIN pb_raw p USING (grp, gene_id) GROUP BY 1 UNION ALL SELECT r.grp, 'fixed', sqrt(avg((p.mean - r.mean) * (p.mean - r.mean))) FROM ref r JOIN pb_fixed p USING (grp, gene_id) GROUP BY 1)
SELECT grp, arg_min(method, (rmse, method)) method, round(min(rmse), 6) rmse FROM s GROUP BY 1""")
def o68_best_method(spark, sf_dir):
    t = Tables(spark, sf_dir)
    both = t.get("pb_raw").withColumn("method", F.lit("raw")).unionByName(t.get("pb_fixed").withColumn("method", F.lit("fixed")))
    diff = both.join(t.get("reference").withColumnRenamed("mean", "ref"), ["grp", "gene_id"]).withColumn("d", F.col("mean") - F.col("ref"))
    scores = diff.groupBy("grp", "method").agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"))
    return selection.best_method(scores, "grp", "method", "rmse").select("grp", "method", r("rmse").alias("rmse"))


@query("o69_highly_variable", """, c AS (SELECT count(*)::DOUBLE c FROM cells), s AS (SELECT gene_id, sum(exp(v) - 1) s, sum((exp(v) - 1) * (exp(v) - 1)) q FROM norm GROUP BY 1), m AS (SELECT gene_id, ln(1 + s / c) m, CASE WHEN (q - s * s / c) > 0 THEN ln((q - s * s / c) / (c - 1) / (s / c)) END d FROM s, c),
b AS (SELECT *, least(floor((m - (SELECT min(m) FROM m)) / (SELECT max(m) - min(m) FROM m) * 20), 19) bin FROM m), z AS (SELECT gene_id, CASE WHEN count(d) OVER w > 1 THEN (d - avg(d) OVER w) / stddev_samp(d) OVER w ELSE 1.0 END z FROM b WINDOW w AS (PARTITION BY bin))
SELECT gene_id, round(z, 4) dispersion FROM z WHERE z IS NOT NULL ORDER BY z DESC, 1 LIMIT 20""")
def o69_highly_variable(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return selection.highly_variable(t.get("norm"), t.get("cells").count(), GENES).select("gene_id", r("dispersion", 4).alias("dispersion"))


@query("o99_first_type", "SELECT cell_id, arg_max(gene_id, (n, -gene_id)) first_type, max(n) - min(n) score_delta FROM cell_expr GROUP BY 1")
def o99_first_type(spark, sf_dir):
    return selection.first_types(Tables(spark, sf_dir).get("cell_expr"), "cell_id", "gene_id", "n")


@query("o101_reference_sample", "SELECT grp, cell_id FROM (SELECT grp, cell_id, row_number() OVER (PARTITION BY grp ORDER BY md5(cell_id || '_7'), cell_id) k FROM grp JOIN members USING (grp) WHERE members >= 5) WHERE k <= 10")
def o101_reference_sample(spark, sf_dir):
    return selection.sample_per_group(Tables(spark, sf_dir).groups(), "grp", "cell_id", 5, 10, 7).select("grp", "cell_id")


@query("o19_alignment", ", f AS (SELECT label cell_id, count(*) n FROM spots GROUP BY 1), w AS (SELECT DISTINCT cell_id FROM cell_expr) SELECT count(*) FILTER (WHERE n > 1) n_duplicate, count(*) FILTER (WHERE n IS NULL) n_missing, count(*) FILTER (WHERE want IS NULL) n_extra FROM f FULL JOIN (SELECT cell_id, 1 want FROM w) USING (cell_id)")
def o19_alignment(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return selection.alignment(t.data.spots.withColumnRenamed("label", "cell_id"), t.get("cell_expr"), "cell_id")


RANKS = """, e AS (SELECT cell_id, gene_id, coalesce(x, 0) x, coalesce(y, 0) y FROM cg LEFT JOIN xy USING (cell_id, gene_id)), rk AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE x, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE y FROM e)"""


@query("o92_compare", f"{RANKS}, a AS (SELECT 20.0::DOUBLE * (SELECT count(*) FROM cells) n, sum(x) sx, sum(y) sy, sum(x * x) sxx, sum(y * y) syy, sum(x * y) sxy, sum((x - y) * (x - y)) sdd FROM xy) SELECT round({corr('n')}, 6) pearson, (SELECT round(corr(x, y), 6) FROM rk) spearman, round(sqrt(sdd / n), 6) rmse, (SELECT round(avg({corr('n')}), 6) FROM pear) cell_pearson FROM a")
def o92_compare(spark, sf_dir):
    t = Tables(spark, sf_dir)
    one = selection.compare(t.fixed(), t.get("cell_expr"), GENES, t.get("cells").count())
    return one.select(*(r(c).alias(c) for c in ("pearson", "spearman", "rmse", "cell_pearson")))


#: The names of groups as texts, as annotations are.
NAMES = ", names AS (SELECT * FROM (VALUES (0, 'T cell'), (1, 'B cell'), (2, 'Fibroblast'), (3, 'Endothelial'), (4, 'Tumour/edge')) v(grp, kind))"


def _named(df, spark):
    names = spark.createDataFrame([(0, "T cell"), (1, "B cell"), (2, "Fibroblast"), (3, "Endothelial"), (4, "Tumour/edge")], "grp long, kind string")
    return df.join(F.broadcast(names), "grp").drop("grp").withColumnRenamed("kind", "grp")


@query("o87_text_groups", f"""{NAMES}, rn AS (SELECT kind grp, gene_id, mean FROM ref JOIN names USING (grp)), fn AS (SELECT kind grp, gene_id, mean FROM pb_fixed JOIN names USING (grp)),
tt AS (SELECT gene_id, arg_min(grp, (-mean, grp)) target, max(mean) peak, sum(mean) total FROM rn GROUP BY 1), s AS (SELECT gene_id, target, sum(mean) total, sum(CASE WHEN grp = target THEN mean ELSE 0 END) own FROM fn JOIN tt USING (gene_id) GROUP BY 1, 2)
SELECT gene_id, s.target, CASE WHEN own > 0 THEN round((s.total - own) / 4 / own, 6) END score, round(peak / tt.total, 6) specificity FROM s JOIN tt USING (gene_id)""")
def o87_text_groups(spark, sf_dir):
    t = Tables(spark, sf_dir)
    reference = _named(t.get("reference"), spark)
    scores = metrics.contamination(_named(t.get("pb_fixed"), spark), reference, GROUPS)
    return scores.join(metrics.specificity(reference).select("gene_id", "specificity"), "gene_id").select("gene_id", "target", r("score").alias("score"), r("specificity").alias("specificity"))


@query("o99_text_types", f"{NAMES}, w AS (SELECT cell_id, kind, n FROM cell_expr JOIN names ON gene_id % 5 = grp), m AS (SELECT cell_id, kind, sum(n) n FROM w GROUP BY 1, 2) SELECT cell_id, arg_min(kind, (-n, kind)) first_type, max(n) - min(n) score_delta FROM m GROUP BY 1")
def o99_text_types(spark, sf_dir):
    kinds = _named(Tables(spark, sf_dir).get("cell_expr").withColumn("grp", F.col("gene_id") % 5), spark).groupBy("cell_id", F.col("grp").alias("kind")).agg(F.sum("n").alias("n"))
    return selection.first_types(kinds, "cell_id", "kind", "n")


@query("o89_class_spearman", """, full_ AS (SELECT grp, gene_id, coalesce(mean, 0) mean FROM (SELECT DISTINCT grp FROM pb_raw) CROSS JOIN genes LEFT JOIN pb_raw USING (grp, gene_id)),
q AS (SELECT grp, gene_id, rank() OVER (PARTITION BY grp ORDER BY mean) + (count(*) OVER (PARTITION BY grp, mean) - 1) / 2.0::DOUBLE x FROM full_), k AS (SELECT a.grp a, b.grp b, coalesce(corr(a.x, b.x), 0) c FROM q a JOIN q b USING (gene_id) WHERE a.grp < b.grp GROUP BY 1, 2) SELECT round(avg(c), 6) mean_r, count(*) pairs FROM k""")
def o89_class_spearman(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return metrics.class_spearman(t.get("pb_raw"), t.data.counts.select("gene_id").distinct()).select(r("mean_r").alias("mean_r"), "pairs")


#: Two-sided p of t with a whole number of degrees of freedom, by the finite series in the cosine of atan(t / sqrt(df)).
SERIES = """, k AS (SELECT grp, gene_id, any_value(members) m, coalesce(sum(v), 0) s, coalesce(sum(v * v), 0) q FROM members CROSS JOIN genes LEFT JOIN (SELECT * FROM norm JOIN grp USING (cell_id)) z USING (grp, gene_id) GROUP BY 1, 2),
w AS (SELECT a.gene_id, a.grp a, b.grp b, a.m + b.m - 2 df, a.s / a.m - b.s / b.m diff, sqrt(greatest((a.q - a.s * a.s / a.m + b.q - b.s * b.s / b.m) / (a.m + b.m - 2), 0) * (1 / a.m + 1 / b.m)) se FROM k a JOIN k b USING (gene_id) WHERE a.grp < b.grp),
tv AS (SELECT gene_id, a, b, df, atan(abs(diff / se) / sqrt(df)) th FROM w WHERE se > 1e-12),
terms AS (SELECT gene_id, a, b, df, th, i, CASE WHEN df % 2 = 0 THEN exp(sum(CASE WHEN i = 0 THEN 0 ELSE ln((2 * i - 1) / (2.0 * i)) END) OVER o) * cos(th) ** (2 * i) ELSE exp(sum(CASE WHEN i = 0 THEN 0 ELSE ln((2.0 * i) / (2 * i + 1)) END) OVER o) * cos(th) ** (2 * i + 1) END x
  FROM (SELECT *, unnest(range(0, CASE WHEN df % 2 = 0 THEN df // 2 ELSE (df - 1) // 2 END)) i FROM tv) WINDOW o AS (PARTITION BY gene_id, a, b ORDER BY i)),
pv AS (SELECT t.gene_id, t.a, t.b, 1 - CASE WHEN any_value(t.df) % 2 = 0 THEN sin(any_value(t.th)) * coalesce(sum(x), 0) ELSE 2 / pi() * (any_value(t.th) + sin(any_value(t.th)) * coalesce(sum(x), 0)) END p FROM tv t LEFT JOIN terms USING (gene_id, a, b) GROUP BY 1, 2, 3)
"""


@query("o90_p_value", f"{SERIES} SELECT gene_id, a, b, round(p, 6) p FROM pv")
def o90_p_value(spark, sf_dir):
    t = Tables(spark, sf_dir)
    tests = metrics.t_statistics(t.get("norm"), t.groups(), t.data.counts.select("gene_id").distinct()).where("t is not null")
    return tests.select("gene_id", "a", "b", r(metrics.student_p(F.col("t"), F.col("df").cast("double"))).alias("p"))


@query("o90_de_count", f"{SERIES}, top AS (SELECT gene_id FROM norm, (SELECT count(*)::DOUBLE c FROM cells) GROUP BY gene_id, c ORDER BY sum(v * v) / c - (sum(v) / c) * (sum(v) / c) DESC, 1 LIMIT 12) SELECT count(*) n_tests, count(*) FILTER (WHERE p < 0.05) n_de FROM pv WHERE gene_id IN (SELECT gene_id FROM top)")
def o90_de_count(spark, sf_dir):
    """O-90, O-139: over the 12 most variable of the 20 genes; the top 200 of the measure is its feature."""
    t = Tables(spark, sf_dir)
    return metrics.differential_genes(t.get("norm"), t.groups(), t.data.counts.select("gene_id").distinct(), t.get("cells").count(), 12)


@query("o55_reference_profiles", f"{NAMES}, c AS (SELECT replace(kind, '/', '-') grp, count(*) members FROM grp JOIN names USING (grp) GROUP BY 1 HAVING count(*) >= 20), sy AS (SELECT gene_id, 'G' || gene_id % 15 gene_name FROM genes), cp AS (SELECT gene_name, count(*) copies FROM sy GROUP BY 1), s AS (SELECT replace(kind, '/', '-') grp, gene_name, sum(v) total FROM norm JOIN grp USING (cell_id) JOIN names USING (grp) JOIN sy USING (gene_id) GROUP BY 1, 2) SELECT grp, gene_name, round(coalesce(total, 0) / members / copies, 6) mean FROM c CROSS JOIN cp LEFT JOIN s USING (grp, gene_name)")
def o55_reference_profiles(spark, sf_dir):
    t = Tables(spark, sf_dir)
    symbols = t.data.counts.select("gene_id").distinct().withColumn("gene_name", F.concat(F.lit("G"), (F.col("gene_id") % 15).cast("string")))
    return metrics.reference_profiles(t.get("norm"), symbols, _named(t.groups(), spark)).select("grp", "gene_name", r("mean").alias("mean"))


@query("o68_method_wins", """, s AS (SELECT r.grp, 'raw' method, sqrt(avg((p.mean - r.mean) * (p.mean - r.mean))) rmse FROM ref r JOIN pb_raw p USING (grp, gene_id) GROUP BY 1 UNION ALL SELECT r.grp, 'fixed', sqrt(avg((p.mean - r.mean) * (p.mean - r.mean))) FROM ref r JOIN pb_fixed p USING (grp, gene_id) GROUP BY 1)
SELECT method, count(*) wins FROM (SELECT grp, arg_min(method, (rmse, method)) method FROM s GROUP BY 1) GROUP BY 1""")
def o68_method_wins(spark, sf_dir):
    return selection.method_wins(o68_best_method(spark, sf_dir), "method")


@query("o52_zero_cells", "SELECT cell_id FROM lib WHERE library = 0")
def o52_zero_cells(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return metrics.zero_libraries(t.get("cells"), t.get("cell_expr"))


@query("o144_corrected_genes", "SELECT gene_id FROM fit WHERE r2 >= 0.01")
def o144_corrected_genes(spark, sf_dir):
    return selection.corrected_genes(Tables(spark, sf_dir).get("fit"), 0.01)


@query("o97_route_change", """, route AS (SELECT x.method, x.grp source, y.grp target, x.mean * y.mean / (50 + x.mean * y.mean) p FROM (SELECT *, 'raw' method FROM pb_raw UNION ALL SELECT *, 'fixed' FROM pb_fixed) x JOIN (SELECT grp, gene_id, mean, 'raw' m FROM pb_raw UNION ALL SELECT grp, gene_id, mean, 'fixed' FROM pb_fixed) y ON x.gene_id = 0 AND y.gene_id = 1 AND x.method = y.m),
q AS (SELECT source, target, sum(p) FILTER (WHERE method = 'raw') raw_p, sum(p) FILTER (WHERE method = 'fixed') fixed_p FROM route GROUP BY 1, 2) SELECT source, target, round(raw_p, 6) raw_p, round(fixed_p, 6) fixed_p, round(100 * fixed_p / nullif(raw_p, 0), 6) retained, round(100 * (fixed_p / nullif(raw_p, 0) - 1), 6) change FROM q""")
def o97_route_change(spark, sf_dir):
    """O-96, O-97: each route's probability, and what remains of it against the raw table."""
    t = Tables(spark, sf_dir)
    both = t.get("pb_raw").withColumn("method", F.lit("raw")).unionByName(t.get("pb_fixed").withColumn("method", F.lit("fixed")))
    return metrics.route_change(both, 0, 1, "raw", "fixed").select("source", "target", *(r(c).alias(c) for c in ("raw_p", "fixed_p", "retained", "change")))


NORMS = """, fl AS (SELECT cell_id, coalesce(sum(n), 0) library FROM cells LEFT JOIN fixed USING (cell_id) GROUP BY 1), fnorm AS (SELECT gene_id, cell_id, ln(1 + n / greatest(library, 1) * 1e4) v FROM fixed JOIN fl USING (cell_id)),
truth AS (SELECT gene_id, cell_id, n / 2 n FROM cell_expr), tl AS (SELECT cell_id, coalesce(sum(n), 0) library FROM cells LEFT JOIN truth USING (cell_id) GROUP BY 1), tnorm AS (SELECT gene_id, cell_id, ln(1 + n / greatest(library, 1) * 1e4) v FROM truth JOIN tl USING (cell_id)),
er AS (SELECT sqrt(sum((coalesce(a.v, 0) - coalesce(b.v, 0)) ** 2) / ((SELECT count(*) FROM cells) * 20)) e FROM norm a FULL JOIN tnorm b USING (gene_id, cell_id)), ef AS (SELECT sqrt(sum((coalesce(a.v, 0) - coalesce(b.v, 0)) ** 2) / ((SELECT count(*) FROM cells) * 20)) e FROM fnorm a FULL JOIN tnorm b USING (gene_id, cell_id))"""


@query("o80_rmse_log", f"{NORMS} SELECT round(ef.e, 6) fixed, round(er.e, 6) raw FROM er, ef")
def o80_rmse_log(spark, sf_dir):
    """O-80: against half the counts, which have nearly the same profiles."""
    t = Tables(spark, sf_dir)
    truth = t.get("cell_expr").withColumn("n", F.col("n") / 2)
    return metrics.rmse_change(t.get("cell_expr"), t.fixed(), truth, t.get("cells"), t.get("cells").count() * GENES).select(r("fixed").alias("fixed"), r("raw").alias("raw"))


@query("o84_mean_between", f""", m AS (SELECT a.grp a, b.grp b, sum(a.mean * b.mean) sxy FROM pb_raw a JOIN pb_raw b USING (gene_id) WHERE a.grp < b.grp GROUP BY 1, 2), o AS (SELECT grp, sum(mean) s, sum(mean * mean) q FROM pb_raw GROUP BY 1),
k AS (SELECT m.a, m.b, sxy, x.s sx, x.q sxx, y.s sy, y.q syy FROM m JOIN o x ON x.grp = a JOIN o y ON y.grp = b) SELECT round(avg({corr('20')}), 6) mean_r, count({corr('20')}) pairs FROM k""")
def o84_mean_between(spark, sf_dir):
    return metrics.mean_between(metrics.group_correlations(Tables(spark, sf_dir).get("pb_raw"), GENES)).select(r("mean_r").alias("mean_r"), "pairs")


@query("o60_class_shares", ", k AS (SELECT cell_id, arg_max(gene_id, (n, -gene_id)) kind, max(n) m, (SELECT avg(n) FROM cell_expr) mid FROM cell_expr GROUP BY 1) SELECT CASE WHEN m >= mid THEN 'sure' ELSE 'unsure' END method, kind call, count(*) n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY CASE WHEN m >= mid THEN 'sure' ELSE 'unsure' END), 6) percent FROM k GROUP BY 1, 2, m >= mid")
def o60_class_shares(spark, sf_dir):
    expr = Tables(spark, sf_dir).get("cell_expr")
    first = selection.first_types(expr, "cell_id", "gene_id", "n").join(expr.groupBy("cell_id").agg(F.max("n").alias("m")), "cell_id")
    calls = first.crossJoin(F.broadcast(expr.agg(F.avg("n").alias("mid")))).select(F.when(F.col("m") >= F.col("mid"), "sure").otherwise("unsure").alias("method"), F.col("first_type").alias("call"))
    return metrics.class_shares(calls, "method", "call").select("method", "call", "n", r("percent").alias("percent"))


@query("o91_silhouette", "")
def o91_silhouette(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").alias("v"))
    return clustering.silhouette(vectors, "label").select(r("score", 4).alias("score"), "n")


ORACLE_SQL["o91_silhouette"] = """WITH e AS (SELECT row_number() OVER () k, label, CAST(embedding AS DOUBLE[]) v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
d AS (SELECT a.k, a.label own, b.label other, sum(list_distance(a.v, b.v) ** 2) total, count(*) n FROM e a JOIN e b ON a.k <> b.k GROUP BY 1, 2, 3),
s AS (SELECT k, max(CASE WHEN own = other THEN total / n END) a, min(CASE WHEN own <> other THEN total / n END) b FROM d GROUP BY 1)
SELECT round(avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 4) score, count(*) n FROM s WHERE b IS NOT NULL"""


@query("o91_silhouette_euclidean", "")
def o91_silhouette_euclidean(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").alias("v"))
    return clustering.euclidean_silhouette(vectors, "label").select(r("score", 4).alias("score"), "n")


ORACLE_SQL["o91_silhouette_euclidean"] = ORACLE_SQL["o91_silhouette"].replace("list_distance(a.v, b.v) ** 2", "list_distance(a.v, b.v)")


@query("o91_svd_lengths", "SELECT cell_id, round(sum(v * v), 3) squares FROM norm GROUP BY 1")
def o91_svd_lengths(spark, sf_dir):
    """O-91: over as many components as there are genes, a cell's vector keeps its length."""
    parts, _ = clustering.truncated_svd(Tables(spark, sf_dir).get("norm"), "cell_id", "gene_id", "v", GENES)
    return parts.select("cell_id", r(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 3).alias("squares"))


@query("o91_svd_products", "SELECT a.cell_id a, b.cell_id b, round(sum(a.v * b.v), 3) product FROM norm a JOIN norm b USING (gene_id) WHERE b.cell_id = a.cell_id + 1 GROUP BY 1, 2")
def o91_svd_products(spark, sf_dir):
    """O-91: and neighbouring cells' vectors keep their inner products."""
    parts, _ = clustering.truncated_svd(Tables(spark, sf_dir).get("norm"), "cell_id", "gene_id", "v", GENES)
    other = parts.select((F.col("cell_id") - 1).alias("cell_id"), F.col("v").alias("w"))
    dot = F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return parts.join(other, "cell_id").select(F.col("cell_id").alias("a"), (F.col("cell_id") + 1).alias("b"), r(dot, 3).alias("product"))


def o91_cluster_ari(spark, sf_dir):
    """O-91: k-means on the truncated singular vectors of all genes' log-normalised counts against the cells' groups. Its steps have no SQL; tests hold them against numpy."""
    t = Tables(spark, sf_dir)
    parts, _ = clustering.truncated_svd(t.get("norm"), "cell_id", "gene_id", "v", 10)
    found = clustering.clusters(parts, "cell_id", GROUPS).join(t.groups(), "cell_id")
    return metrics.adjusted_rand(found, "cluster", "grp").select(r("ari").alias("ari"))


QUERIES["o91_cluster_ari"] = o91_cluster_ari


#: Moments of the tricube-weighed points about each gene's own mean, and the quadratic's value there by Cramer's rule.
TREND = """, c AS (SELECT count(*)::DOUBLE c FROM cells), s AS (SELECT gene_id, sum(n) s, sum(n * n) q FROM cell_expr GROUP BY 1), g AS (SELECT gene_id, s / c m, greatest((q - s * (s / c)) / (c - 1), 0) va FROM s, c),
p AS (SELECT gene_id, m, va, log10(m) x, log10(va) y FROM g WHERE m > 0 AND va > 0), k AS (SELECT greatest(least(count(*), 3), floor(0.3::DOUBLE * count(*) + 1e-9)) q FROM p),
nb AS (SELECT a.gene_id, b.y, b.x - a.x d, row_number() OVER (PARTITION BY a.gene_id ORDER BY abs(b.x - a.x), b.x) i FROM p a CROSS JOIN p b), h AS (SELECT gene_id, max(abs(d)) h FROM nb, k WHERE i <= q GROUP BY 1),
w AS (SELECT gene_id, y, d / h u, power(1 - power(abs(d) / h, 3), 3) w FROM nb JOIN h USING (gene_id), k WHERE i <= q),
z AS (SELECT gene_id, sum(w) s0, sum(w * u) s1, sum(w * u ** 2) s2, sum(w * u ** 3) s3, sum(w * u ** 4) s4, sum(w * y) t0, sum(w * y * u) t1, sum(w * y * u ** 2) t2 FROM w GROUP BY 1),
f AS (SELECT gene_id, power(10, (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)) / 2) sd FROM z),
e AS (SELECT gene_id, m, va, (sum(power(least((n - m) / sd, sqrt(c)), 2)) + (c - count(*)) * power(m / sd, 2)) / (c - 1) nv FROM cell_expr JOIN p USING (gene_id) JOIN f USING (gene_id), c GROUP BY gene_id, m, va, sd, c)"""


@query("o69_stabilised_variance", f"{TREND} SELECT gene_id, round(m, 4) mean, round(va, 4) variance, round(nv, 4) norm_variance FROM e ORDER BY nv DESC, gene_id LIMIT 12")
def o69_stabilised_variance(spark, sf_dir):
    """O-69: the 12 genes of largest variance about the trend."""
    t = Tables(spark, sf_dir)
    return selection.stabilised_variance(t.get("cell_expr"), t.get("cells").count(), 12).select("gene_id", *(r(c, 4).alias(c) for c in ("mean", "variance", "norm_variance")))
