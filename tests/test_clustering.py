import time

import numpy as np
import pytest

from seepage.operators import clustering, selection


def table_of(x):
    return [(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))]


def matrix_of(rows, n, k):
    out = np.zeros((n, k))
    for r in rows:
        out[r.cell_id] = r.v
    return out


def test_truncated_svd(spark):
    rng = np.random.default_rng(1)
    n, g, k = 150, 90, 5
    x = rng.gamma(1.0, size=(n, 3)) @ rng.gamma(0.7, size=(3, g)) * 4 + rng.random((n, g)) * (rng.random((n, g)) < 0.3)
    x[17] = 0  # a cell without rows has no vector
    x[:, 5] = 0
    df = spark.createDataFrame(table_of(x), "cell_id long, gene_id long, v double").selectExpr("*", "1 AS f_", "2 AS k_").repartition(5)
    parts, sigma = clustering.truncated_svd(df, "cell_id", "gene_id", "v", k)
    rows = parts.collect()
    got = matrix_of(rows, n, k)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert len(rows) == n - 1 and sigma == pytest.approx(s[:k], rel=0.1) and sigma[:3] == pytest.approx(s[:3], rel=1e-7)
    # The angle between the three strong components' space and numpy's.
    mine = got[:, :3] / np.linalg.norm(got[:, :3], axis=0)
    assert np.linalg.norm(mine - u[:, :3] @ (u[:, :3].T @ mine)) < 1e-6
    assert np.linalg.norm(x - got @ np.linalg.lstsq(got, x, rcond=None)[0]) <= 1.02 * np.linalg.norm(x - (u[:, :k] * s[:k]) @ np.linalg.svd(x)[2][:k])


def test_truncated_svd_of_low_rank_and_nothing(spark):
    x = np.outer(np.arange(1.0, 7.0), [1.0, 2.0, 0.0, 3.0])
    df = spark.createDataFrame(table_of(x), "cell_id long, gene_id long, v double")
    parts, sigma = clustering.truncated_svd(df, "cell_id", "gene_id", "v", 2)
    got = matrix_of(parts.collect(), 7, 2)[:6]
    assert sigma == pytest.approx([np.linalg.norm(x), 0.0], abs=1e-6) and np.abs(got[:, 0]) == pytest.approx(np.linalg.norm(x, axis=1)) and np.abs(got[:, 1]).max() < 1e-6
    parts, sigma = clustering.truncated_svd(df.limit(0), "cell_id", "gene_id", "v", 2)
    assert parts.count() == 0 and sigma == [0.0, 0.0]


def test_clusters_of_truncated_svd_find_the_groups(spark):
    rng = np.random.default_rng(2)
    kind = np.arange(120) % 3
    x = rng.poisson(np.where(np.arange(60)[None, :] % 3 == kind[:, None], 6.0, 0.5)).astype(float)
    df = spark.createDataFrame(table_of(x), "cell_id long, gene_id long, v double")
    parts, _ = clustering.truncated_svd(df, "cell_id", "gene_id", "v", 3)
    found = {r.cell_id: r.cluster for r in clustering.clusters(parts, "cell_id", 3).collect()}
    assert len({(kind[c], k) for c, k in found.items()}) == 3


def brute_silhouette(v, label):
    v, scores = np.array(v, float), []
    for i, own in enumerate(label):
        d = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
        by = {k: [d[j] for j, x in enumerate(label) if x == k and j != i] for k in set(label)}
        b = min(np.mean(x) for k, x in by.items() if k != own)
        a = np.mean(by[own]) if by[own] else 0
        scores.append((b - a) / max(a, b) if by[own] and max(a, b) > 0 else 0.0)
    return np.mean(scores)


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_euclidean_silhouette(spark, monkeypatch, block):
    monkeypatch.setattr(clustering, "BLOCK", block)
    monkeypatch.setattr(clustering, "SLAB", 5)
    rng = np.random.default_rng(3)
    label = ["a"] * 30 + ["b"] * 40 + ["c"] * 9 + ["alone"]
    v = [(rng.standard_normal(4) + {"a": 0, "b": 2, "c": 9, "alone": -5}[k]).tolist() for k in label]
    v[3] = v[4] = v[5]
    rows = [*zip(v, label), (v[0], None), (None, "a"), (v[1], "Unknown"), (v[2], "nan")]
    got = clustering.euclidean_silhouette(spark.createDataFrame(rows, "v array<double>, kind string").selectExpr("*", "1 AS row", "2 AS own"), "kind").first()
    assert got.n == len(label) and got.score == pytest.approx(brute_silhouette(v, label), rel=1e-12)


def euclidean_of(spark, v, label):
    return clustering.euclidean_silhouette(spark.createDataFrame(list(zip([x.tolist() for x in np.asarray(v)], label)), "v array<double>, kind string"), "kind").first()


def test_euclidean_silhouette_with_empty_blocks(spark, monkeypatch):
    monkeypatch.setattr(clustering, "BLOCK", 1)
    v, label = np.random.default_rng(5).standard_normal((9, 3)), list("aabbabcbc")
    got = euclidean_of(spark, v, label)
    assert got.n == 9 and got.score == pytest.approx(brute_silhouette(v, label), rel=1e-12)


@pytest.mark.parametrize("slab", [3, 512])
def test_euclidean_silhouette_of_copies_and_near_vectors(spark, monkeypatch, slab):
    monkeypatch.setattr(clustering, "SLAB", slab)
    rng = np.random.default_rng(6)
    near = 1e5 + rng.standard_normal((8, 5)) * np.array([1e-4] * 4 + [1e-9] * 4)[:, None]  # products of vectors lose all digits of such distances
    v = np.concatenate([near, near[[0, 0, 3]], rng.standard_normal((6, 5)), [[0.0] * 5, [-0.0] * 5, [0.0] * 5, [1e9] * 5, [1e9] * 5]])
    label = [*"abababab", *"aab", *"ccabcc", *"ccacd"]
    got = euclidean_of(spark, v, label)
    assert got.n == len(label) and got.score == pytest.approx(brute_silhouette(v, label), rel=1e-11)


def test_euclidean_silhouette_outruns_a_loop_over_dimensions(spark):
    rng = np.random.default_rng(7)
    v, label = rng.standard_normal((20_000, 64)), rng.integers(0, 3, 20_000)
    label[:2] = 3
    start, d2 = time.perf_counter(), np.zeros((256, 4096))
    for d in range(64):
        gap = v[:256, d, None] - v[None, :4096, d]
        d2 += gap * gap
    plain = (time.perf_counter() - start) / d2.size
    df = spark.createDataFrame([(x.tolist(), int(k)) for x, k in zip(v, label)], "v array<double>, kind int").cache()
    df.count()
    start = time.perf_counter()
    got = clustering.euclidean_silhouette(df, "kind").first()
    assert time.perf_counter() - start < plain * len(v) ** 2 / 8  # a loop takes twice as long in four tasks
    square, member, score = (v * v).sum(axis=1), np.eye(4)[label], 0.0
    n = member.sum(axis=0)
    for i in range(0, len(v), 1000):
        own = label[i : i + 1000]
        total = np.sqrt(np.maximum(square[i : i + 1000, None] - 2 * v[i : i + 1000] @ v.T + square, 0))
        total[np.arange(len(own)), np.arange(i, i + len(own))] = 0
        total = total @ member
        a = total[np.arange(len(own)), own] / (n[own] - 1)
        b = np.where(np.eye(4)[own] > 0, np.inf, total / n).min(axis=1)
        score += ((b - a) / np.maximum(a, b)).sum()
    df.unpersist()
    assert got.n == len(v) and got.score == pytest.approx(score / len(v), rel=1e-9)


def test_euclidean_silhouette_of_vectors_of_two_lengths(spark):
    df = spark.createDataFrame([([1.0, 2.0], "a"), ([2.0], "b"), ([3.0], "b")], "v array<double>, kind string")
    with pytest.raises(ValueError, match="1 and of 2"):
        clustering.euclidean_silhouette(df, "kind")


def test_silhouette_of_nothing_and_of_one_label(spark):
    df = spark.createDataFrame([([1.0, 2.0], "a"), ([2.0, 2.0], "a")], "v array<double>, kind string")
    for f in (clustering.euclidean_silhouette, clustering.silhouette):
        assert f(df, "kind").first().n == 0 and f(df.limit(0), "kind").first().n == 0


def loess(x, y, span=0.3):
    """Weighted least squares at each point, over all points sorted by distance."""
    q = max(min(len(x), 3), int(span * len(x) + 1e-9))
    out = []
    for x0 in x:
        near = np.argsort(np.abs(x - x0), kind="stable")[:q]
        d = np.abs(x[near] - x0)
        w = np.sqrt((1 - (d / d.max()) ** 3).clip(0) ** 3)
        a = np.vander(x[near] - x0, 3)
        out.append(np.linalg.lstsq(a * w[:, None], y[near] * w, rcond=None)[0][-1])
    return np.array(out)


def test_stabilised_variance(spark):
    rng = np.random.default_rng(4)
    n, g = 200, 80
    mean = np.exp(rng.uniform(-2, 4, g))
    x = rng.negative_binomial(2.0, 2.0 / (2.0 + mean), (n, g)).astype(float)
    x[:, 7] = 0
    x[:, 8] = 3  # no variance
    x[:, 9] = np.where(np.arange(n) == 0, 5000, x[:, 9])  # one outlier is clipped
    df = spark.createDataFrame(table_of(x), "cell_id long, gene_id long, n double").repartition(4)
    got = {r.gene_id: r for r in selection.stabilised_variance(df, n, None).collect()}
    m, v = x.mean(axis=0), x.var(axis=0, ddof=1)
    ok = np.flatnonzero((m > 0) & (v > 0))
    sd = np.sqrt(10 ** loess(np.log10(m[ok]), np.log10(v[ok])))
    z = np.minimum((x[:, ok] - m[ok]) / sd, np.sqrt(n))
    want = (z * z).sum(axis=0) / (n - 1)
    assert [got[j].norm_variance for j in ok] == pytest.approx(want, rel=1e-8) and got[8].norm_variance == 0 and 7 not in got
    top = [r.gene_id for r in selection.stabilised_variance(df, n, 10).collect()]
    assert top == [int(ok[i]) for i in np.argsort(-want)[:10]]


def test_stabilised_variance_of_few_and_alike(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 1.0), (1, 1, 2.0)], "gene_id long, cell_id long, n double")
    assert len(selection.stabilised_variance(df, 4, 5).collect()) == 2  # genes of one mean
    assert selection.stabilised_variance(df.limit(0), 4, 5).count() == 0
