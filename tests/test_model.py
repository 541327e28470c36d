import numpy as np
import pytest

from seepage.model import LeakageModel
from seepage.operators import aggregate, graph, validate
from seepage.schema import COUNTS, SPOTS, SpatialDataset

ALPHA = [0.17832619, 0.45621741, 0.49097834, 0.61318456, 0.13685359, 0.5320928, 0.11432464, 0.10406752]
R2 = [0.13247086, 0.31476743, 0.33730105, 0.49643635, 0.25559876, 0.26325277, -0.1596636, 0.15564221]


def discs(spark):
    ys, xs = np.meshgrid(np.arange(24), np.arange(24), indexing="ij")
    x, y = xs.ravel().astype(float), ys.ravel().astype(float)
    label = np.full(len(x), -1)
    for k, (cx, cy) in enumerate([(6, 6), (18, 6), (6, 18), (18, 18)]):
        label[(x - cx) ** 2 + (y - cy) ** 2 <= 4.5**2] = k
    rng = np.random.RandomState(3)
    expr = rng.poisson(0.3, (8, len(x))).astype(float)
    for k in range(4):
        at = np.flatnonzero(label == k)
        expr[k, at] += rng.poisson(3.0, len(at))
    spots = [(i, float(x[i]), float(y[i]), int(label[i])) for i in range(len(x))]
    counts = [(int(g), int(i), float(expr[g, i])) for g, i in zip(*np.nonzero(expr))]
    return SpatialDataset(spark.createDataFrame(spots, SPOTS), spark.createDataFrame(counts, COUNTS)), x, y, label, expr


def test_end_to_end(spark):
    data, *_ = discs(spark)
    model = LeakageModel(bin_size=4, max_radius=30, lambda_grid=(5, 10, 20), n_lambda_genes=4)
    out = model.fit_transform(data).toPandas()
    fit = model.fit_.toPandas().sort_values("rank")
    assert model.lambda_ == 20 and fit.gene_id.tolist() == [3, 5, 4, 7, 1, 6, 2, 0]
    assert np.allclose(fit.alpha, ALPHA, atol=1e-7) and np.allclose(fit.r2, R2, atol=1e-7)
    rss = [r.rss for r in model.search_.orderBy("pos").collect()]
    assert np.allclose(rss, [6699.040179518698, 5338.391123951419, 4535.030213641596], rtol=1e-12)
    assert out.n_raw.sum() == 1417 and np.isclose(out.n_corrected.sum(), 1111.7710480571072, rtol=1e-10)
    d = model.diagnostics_.first()
    assert d.n_cells == 4 and d.n_bins == 32 and d.n_genes_corrected == 7 and d["scale"] == 20


def test_inverse_kernel_and_expression_weight(spark):
    data, *_ = discs(spark)
    model = LeakageModel(bin_size=4, max_radius=30, metric="inverse", use_expr_weight=True, penalty_mode=None)
    out = model.fit_transform(data).toPandas()
    assert model.lambda_ is None and (out.n_corrected <= out.n_raw + 1e-9).all() and (out.n_corrected >= 0).all()


@pytest.mark.parametrize("bad", [{"bin_size": 0}, {"max_radius": -1}, {"metric": "x"}, {"lambda_grid": ()}, {"n_lambda_genes": 0}, {"r2_threshold": 2}])
def test_parameters(bad):
    with pytest.raises(ValueError):
        LeakageModel(**bad)


def test_graphs(spark):
    cells = spark.createDataFrame([(0, 0.0, 0.0), (1, 10.0, 0.0), (2, 0.0, 10.0), (3, 100.0, 100.0)], "cell_id long, cx double, cy double")
    got = {(r.dst, r.src): round(r.d, 6) for r in graph.cell_cell_edges(cells, 20).collect()}
    assert got == {(0, 1): 10, (1, 0): 10, (0, 2): 10, (2, 0): 10, (1, 2): round(200**0.5, 6), (2, 1): round(200**0.5, 6)}
    flags = {r.cell_id: r.category for r in graph.neighbour_flags(cells, cells.where("cell_id = 0"), 10.0).collect()}
    assert flags == {0: "source", 1: "neighbour", 2: "neighbour", 3: "other"}
    pts = spark.createDataFrame([(0, 1.0, 1.0), (1, 50.0, 50.0), (2, 9.0, 0.5)], "point_id long, px double, py double")
    targets = cells.selectExpr("cell_id AS target_id", "cx AS tx_", "cy AS ty_", "2D AS radius")
    assert {(r.point_id, r.target_id) for r in graph.nearest_within(targets, pts, 2.0).collect()} == {(0, 0), (2, 1)}


def test_bins(spark):
    rows = [(i, float(i % 20) * 5, float(i // 20) * 5, -1) for i in range(1000)]
    spots = spark.createDataFrame(rows, SPOTS)
    portrait = aggregate.bins(aggregate.empty_bins(spots, 10.0)).toPandas()
    turned = aggregate.bins(aggregate.empty_bins(spots.selectExpr("spot_id", "y AS x", "x AS y", "label"), 10.0)).toPandas()
    assert portrait.area.sum() == 1000 and sorted(portrait.area) == sorted(turned.area)
    with pytest.raises(ValueError):
        aggregate.empty_bins(spots, 0)


def test_core_halo(spark):
    pts = spark.createDataFrame([(0, 1.0, 1.0, 1), (1, 5.0, 5.0, 1), (2, 10.0, 10.0, 1), (3, 4.5, 9.0, 1), (4, 10.5, 0.0, 0), (5, 5.0, 2.0, 0)], "id long, x double, y double, tissue int")
    rows = graph.core_halo(pts, [0, 5, 10], [0, 5, 10], 1.0).collect()
    assert {r.id: (r.col, r.row) for r in rows if r.is_core} == {0: (0, 0), 1: (1, 1), 2: (1, 1), 3: (0, 1)}
    assert len([r for r in rows if r.id == 1]) == 4 and {(r.col, r.row) for r in rows if r.id == 4} == {(1, 0)} and {(r.col, r.row) for r in rows if r.id == 5} == {(0, 0), (1, 0)}
    with pytest.raises(Exception, match="outside"):
        graph.core_halo(pts.drop("tissue"), [0, 5, 10], [0, 5, 10], 1.0).collect()


@pytest.mark.parametrize("spots,counts,word", [
    ([(0, 0.0, 0.0, 1), (1, 1.0, 0.0, -1)], [(0, 0, -1.0)], "non-negative"),
    ([(0, 0.0, 0.0, 1), (1, 1.0, 0.0, -1)], [(0, 0, float("nan"))], "expression"),
    ([(0, float("nan"), 0.0, 1), (1, 1.0, 0.0, -1)], [(0, 0, 1.0)], "coordinates"),
    ([(0, 0.0, 0.0, None), (1, 1.0, 0.0, -1)], [(0, 0, 1.0)], "integer-valued"),
    ([(0, 0.0, 0.0, -1)], [(0, 0, 1.0)], "no cell"),
    ([(0, 0.0, 0.0, 1)], [(0, 0, 1.0)], "out-of-mask"),
    ([(0, 0.0, 0.0, 1), (1, 1.0, 0.0, -1)], [(0, 9, 1.0)], "expression"),
])
def test_contract(spark, spots, counts, word):
    with pytest.raises(ValueError, match=word):
        validate.check_inputs(SpatialDataset(spark.createDataFrame(spots, SPOTS), spark.createDataFrame(counts, COUNTS)))
