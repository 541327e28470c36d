import numpy as np
import pytest
from pyspark.sql import functions as F

from seepage.operators import clustering as C
from seepage.operators import metrics as M
from seepage.operators import selection as S


def long(spark, matrix, rows="cell_id", cols="gene_id"):
    return spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(matrix) for j, v in enumerate(r) if v], f"{rows} long, {cols} long, n double")


def test_cell_r2(spark):
    got = M.cell_r2(long(spark, [[2, 1, 0], [1, 0, 1], [1, 1, 1]]), long(spark, [[0, 1, 2], [0, 1, 0], [1, 2, 3]]), 3).orderBy("cell_id").collect()
    assert [r.r2 for r in got[:2]] == pytest.approx([1, 1]) and got[2].r2 is None


def test_library_qc(spark):
    cells = spark.createDataFrame([(100,), (101,), (102,)], "cell_id long")
    expr = spark.createDataFrame([(0, 100, 3.0), (1, 101, 4.0), (1, 102, -1.0)], "gene_id long, cell_id long, n double")
    r = M.library_summary(cells, expr).first()
    assert (r.n_cells, r.n_zero, r.n_negative, r.total) == (3, 1, 1, 7)
    with pytest.raises(Exception, match="finite"):
        M.library_sizes(cells, expr.withColumn("n", F.lit(float("nan")))).collect()


def test_ranks_and_rand(spark):
    df = spark.createDataFrame([(0, 5.0), (0, 5.0), (0, 1.0), (0, 9.0)], "g int, v double")
    assert sorted(r.rank_ for r in M.average_ranks(df, ["g"], "v").collect()) == [1, 2.5, 2.5, 4]
    same = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "b"), (3, "c")], "a int, b string")
    assert M.adjusted_rand(same, "a", "b").first().ari == pytest.approx(1)


def test_pseudobulk_divides_by_group_size(spark):
    groups = spark.createDataFrame([(0, "A"), (1, "A"), (2, "A"), (3, "Unknown"), (4, "B")], "cell_id long, grp string")
    norm = spark.createDataFrame([(0, 0, 6.0), (3, 0, 9.0), (4, 0, 1.0)], "cell_id long, gene_id long, v double")
    assert [tuple(r) for r in M.pseudobulk(norm, groups).collect()] == [("A", 0, 2.0)]


def test_p_values(spark):
    # Critical values of Student's t at 0.05, as every table has them.
    rows = [(12.706, 1, 0.05), (4.303, 2, 0.05), (2.228, 10, 0.05), (2.042, 30, 0.05), (1.980, 120, 0.05), (1.96, 1_000_000, 0.05), (0.0, 5, 1.0), (3.169, 10, 0.01), (-2.228, 10, 0.05)]
    df = spark.createDataFrame(rows, "t double, df long, p double")
    for r in df.withColumn("got", M.student_p(F.col("t"), F.col("df").cast("double"))).collect():
        assert r.got == pytest.approx(r.p, rel=5e-3)


def test_class_metrics(spark):
    genes = spark.range(4).withColumnRenamed("id", "gene_id")
    rows = [("A", 0, 1.0), ("A", 1, 2.0), ("A", 2, 3.0), ("B", 0, 2.0), ("B", 1, 4.0), ("B", 2, 9.0), ("C", 0, 3.0), ("C", 1, 2.0), ("C", 2, 1.0)]
    got = M.class_spearman(spark.createDataFrame(rows, "grp string, gene_id long, mean double"), genes).first()
    # With the gene that no class has: A and B agree; C has ranks 4, 3, 2, 1 against 2, 3, 4, 1.
    assert got.pairs == 3 and got.mean_r == pytest.approx((1 + 2 * 0.2) / 3)
    groups = spark.createDataFrame([(i, "xy"[i % 2]) for i in range(12)], "cell_id long, grp string")
    values = spark.createDataFrame([(i, 0, 5.0 * (i % 2) + 0.1 * (i // 2)) for i in range(12)] + [(i, 1, float(i // 2)) for i in range(12)], "cell_id long, gene_id long, v double").where("v <> 0")
    r = M.differential_genes(values, groups, genes, 12).first()
    assert (r.n_tests, r.n_de) == (2, 1)


def test_text_groups_and_one_group(spark):
    ref = spark.createDataFrame([("T cell", 0, 3.0), ("B cell", 0, 3.0), ("B cell", 1, 1.0)], "grp string, gene_id long, mean double")
    assert {r.gene_id: r.target for r in M.specificity(ref).collect()} == {0: "B cell", 1: "B cell"}
    got = {r.gene_id: (r.target, r.score) for r in M.contamination(ref, ref, 2).collect()}
    assert got == {0: ("B cell", 1.0), 1: ("B cell", 0.0)}
    assert {r.score for r in M.contamination(ref.where("grp = 'B cell'"), ref.where("grp = 'B cell'"), 1).collect()} == {None}
    w = spark.createDataFrame([(1, "x", 0.2), (1, "a", 0.2), (1, "b", 0.1)], "cell int, kind string, v double")
    assert tuple(S.first_types(w, "cell", "kind", "v").first()) == (1, "a", pytest.approx(0.1))


def test_reference_profiles(spark):
    values = spark.createDataFrame([(i % 3, i, 1.0 + i % 2) for i in range(40)], "gene_id long, cell_id long, v double")
    symbols = spark.createDataFrame([(0, "A"), (1, "A"), (2, "B")], "gene_id long, gene_name string")
    groups = spark.createDataFrame([(i, "a/b" if i < 25 else "few") for i in range(40)], "cell_id long, grp string")
    got = {(r.grp, r.gene_name): r.mean for r in M.reference_profiles(values, symbols, groups).collect()}
    want = lambda keep: sum(1.0 + i % 2 for i in range(25) if keep(i % 3)) / 25
    assert got == {("a-b", "A"): pytest.approx(want(lambda g: g < 2) / 2), ("a-b", "B"): pytest.approx(want(lambda g: g == 2))}


def test_compare_spearman(spark):
    a = [[5, 0, 1, 0], [0, 2, 2, 0], [1, 0, 0, 9]]
    b = [[4, 0, 2, 0], [0, 1, 3, 1], [0, 0, 0, 7]]
    flat = lambda m: [v for r in m for v in r]
    rank = lambda vs: [sum(u < v for u in vs) + (sum(u == v for u in vs) + 1) / 2 for v in vs]
    want = np.corrcoef(rank(flat(a)), rank(flat(b)))[0, 1]
    assert S.compare(long(spark, a), long(spark, b), 4, 3).first().spearman == pytest.approx(want)


def test_shared_shares(spark):
    rows = [("b", 2000, 500, 25.0), ("a", 2000, 1000, 50.0)]
    df = spark.createDataFrame(rows, "method string, n_cells long, n_singlet long, pct_singlet double")
    assert [r.method for r in S.checked_shares(df, ["a", "b"]).collect()] == ["a", "b"]
    for bad, word in ((df.limit(1), "one row"), (df.withColumn("pct_singlet", F.lit(1.0)), "match"), (df.withColumn("n_cells", F.col("n_singlet")), "same")):
        with pytest.raises(ValueError, match=word):
            S.checked_shares(bad, ["a", "b"])


def test_clusters_and_silhouette(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "abc"[i % 3], (rng.standard_normal(6) * 0.3 + 4 * np.eye(6)[i % 3]).tolist()) for i in range(90)]
    df = spark.createDataFrame([*rows, (900, None, [0.0] * 6)], "cell_id long, grp string, v array<double>")
    parts = C.principal_components(df.where("grp is not null"), "cell_id", 2)
    found = C.clusters(parts, "cell_id", 3).join(df.select("cell_id", "grp"), "cell_id")
    assert M.adjusted_rand(found, "cluster", "grp").first().ari == pytest.approx(1)
    got = C.silhouette(df, "grp").first()
    x, y = np.array([v for _, _, v in rows]), [g for _, g, _ in rows]
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    s = []
    for i in range(90):
        mean = lambda g: np.mean([d[i, j] for j in range(90) if y[j] == g and j != i])
        a, b = mean(y[i]), min(mean(g) for g in "abc" if g != y[i])
        s.append((b - a) / max(a, b))
    assert got.n == 90 and got.score == pytest.approx(np.mean(s))
    values = spark.createDataFrame([(0, 1, 2.0), (5, 1, 3.0), (5, 2, 1.0)], "gene_id long, cell_id long, v double")
    assert sorted((r.cell_id, r.v) for r in C.cell_vectors(values, spark.createDataFrame([(5,), (0,)], "gene_id long")).collect()) == [(1, [2.0, 3.0]), (2, [0.0, 1.0])]


def test_panels_and_least_genes(spark):
    scores = spark.createDataFrame([(0, 0.5, 0.2), (1, 1.0, 0.4), (2, 0.0, None)], "gene_id long, retention double, removal double")
    panels = spark.createDataFrame([(0, "p"), (1, "p"), (2, "p")], "gene_id long, panel string")
    row = M.panel_summary(scores, panels).first()
    assert (row.n, row.retention_median, row.retention_mean) == (3, 0.5, 0.5) and row.removal_median == pytest.approx(0.3)
    ref = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, 4.0)], "grp string, gene_id long, mean double")
    with pytest.raises(ValueError, match="10"):
        M.concordance(ref, ref, least=10)
    assert M.concordance(ref, ref, genes=ref.where("gene_id < 2")).first().shared == 2


def test_contamination_summary(spark):
    reference = spark.createDataFrame([("a", g, 5.0) for g in range(4)] + [("b", g, 1.0) for g in range(4)], "grp string, gene_id int, mean double")
    raw = spark.createDataFrame([("a", 0, 2.0), ("b", 0, 4.0), ("a", 1, 4.0), ("b", 1, 2.0), ("a", 2, 0.0), ("b", 2, 3.0), ("a", 3, 1.0), ("b", 3, 0.5)], "grp string, gene_id int, mean double")
    fixed = spark.createDataFrame([("a", 0, 2.0), ("b", 0, 1.0), ("a", 1, 4.0), ("b", 1, 1.0), ("a", 2, 1.0), ("b", 2, 3.0), ("a", 3, 0.0), ("b", 3, 0.5)], "grp string, gene_id int, mean double")
    one = M.contamination_summary(fixed, reference, 2, raw).first()
    # Scores 0.5, 0.25, 3 and none; raw 2, 0.5, none and 0.5.
    assert (one.mean_score, one.median_score, one.n_genes) == (1.25, 0.5, 3)
    assert (one.mean_reduction, one.median_reduction, one.mean_reduction_high, one.n_high) == (0.875, 0.875, 1.5, 1)
