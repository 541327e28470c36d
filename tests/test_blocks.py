import numpy as np
import pytest
from pyspark.sql import functions as F

from seepage.model import LeakageModel
from seepage.operators import blocks, fit, graph, ordering, tiling
from tests.test_model import discs


def scene(spark, seed=1, n_bins=260, n_cells=180, n_genes=7, size=90.0):
    rng = np.random.default_rng(seed)
    place = lambda n: [(float(x), float(y)) for x, y in rng.uniform(-size / 2, size / 2, (n, 2)).round(2)]
    bins = [(i, int(rng.integers(1, 9)), x, y) for i, (x, y) in enumerate(place(n_bins))]
    cells = [(1000 + i, int(rng.integers(1, 30)), x, y) for i, (x, y) in enumerate(place(n_cells))]
    bins += [(9000, 3, 0.0, 0.0), (9001, 2, 20.0, 0.0), (9002, 1, 500.0, 500.0)]  # just the radius apart; far away
    cells += [(9100, 4, 10.0, 0.0), (9101, 4, 10.0, 0.0), (9102, 5, 0.0, 10.0)]
    rates = [(g, c, float(a * s), float(a), float(s)) for c, a, *_ in cells for g in range(n_genes) if (s := rng.gamma(0.6)) > 0.4]
    seen = [(g, b, float(rng.integers(1, 20))) for b, *_ in bins for g in range(n_genes + 1) if rng.random() < 0.5]
    return (
        spark.createDataFrame(bins, "bin_id long, area long, bx double, by double"),
        spark.createDataFrame(cells, "cell_id long, area long, cx double, cy double"),
        spark.createDataFrame(rates, "gene_id long, cell_id long, n double, area double, s double"),
        spark.createDataFrame(seen, "gene_id long, bin_id long, y double"),
    )


def as_dict(df, keys):
    return {tuple(r[k] for k in keys): [v for k, v in r.asDict().items() if k not in keys] for r in df.collect()}


@pytest.mark.parametrize("metric", ["exponential", "gaussian", "inverse"])
def test_moments_equal_the_row_path(spark, metric):
    bins, cells, rates, seen = scene(spark)
    edges = graph.bin_cell_edges(bins, cells, 10.0)
    want = as_dict(fit.moments(fit.kernel_sums(edges, rates, [4.0, 9.0], metric), seen, 2), ["gene_id"])
    got = as_dict(blocks.moments(bins, cells, rates, seen, 10.0, [4.0, 9.0], metric), ["gene_id"])
    assert set(want) == set(got)
    assert all(got[k] == pytest.approx(want[k], rel=1e-10) for k in want)


def test_small_blocks_and_dense_tiles(spark, monkeypatch):
    bins, cells, rates, seen = scene(spark, 2)
    want = as_dict(fit.moments(fit.kernel_sums(graph.bin_cell_edges(bins, cells, 10.0), rates, [5.0]), seen, 1), ["gene_id"])
    edges = graph.cell_cell_edges(cells, 10.0)
    flows = as_dict(fit.inflow(edges, rates, 5.0), ["gene_id", "cell_id"])
    monkeypatch.setattr(blocks, "SLAB", 3)
    monkeypatch.setattr(blocks, "WORKING_SET", 1)
    genes_per_block = blocks.genes_per_block
    monkeypatch.setattr(blocks, "genes_per_block", lambda rows, columns, most: genes_per_block(rows, columns, most, budget=1))  # a gene a block
    for dense in (20_000, 25, 0):
        monkeypatch.setattr(blocks, "DENSE", dense)
        got = as_dict(blocks.moments(bins, cells, rates, seen, 10.0, [5.0]), ["gene_id"])
        assert all(got[k] == pytest.approx(want[k], rel=1e-10) for k in want) and set(got) == set(want)
        flow = as_dict(blocks.inflow(cells, rates, 10.0, 5.0), ["gene_id", "cell_id"])
        held = as_dict(rates.select("gene_id", "cell_id"), ["gene_id", "cell_id"])
        assert all(flow.get(k, [0.0]) == pytest.approx(flows.get(k, [0.0]), rel=1e-10) for k in held)


def test_gene_block_rule():
    assert blocks.genes_per_block(1000, 10, 500) == 500
    assert blocks.genes_per_block(10**6, 10, 500, budget=6 * 8 * 10**6 * 7) == 7
    assert blocks.genes_per_block(10**9, 10, 500) == 1 and blocks.genes_per_block(0, 0, 0) == 1


def test_choice_follows_the_rows(spark, monkeypatch):
    bins, cells, rates, _ = scene(spark, 3)
    edges = graph.bin_cell_edges(bins, cells, 10.0)
    rows = edges.join(rates, "cell_id").count()
    assert blocks.joined_rows(edges, rates) == rows
    monkeypatch.setattr(blocks, "ROW_LIMIT", rows)
    assert blocks.choose(edges, rates, 7, "exponential") == "rows"
    monkeypatch.setattr(blocks, "ROW_LIMIT", rows - 1)
    assert blocks.choose(edges, rates, 7, "exponential") == "blocks" and blocks.choose(edges, rates, 7, "mine") == "rows"


def test_models_agree(spark):
    data, *_ = discs(spark)
    made = {}
    for backend in ("rows", "blocks"):
        model = LeakageModel(bin_size=4, max_radius=30, lambda_grid=(5, 10, 20), n_lambda_genes=4, backend=backend)
        made[backend] = (as_dict(model.fit_transform(data), ["gene_id", "cell_id"]), as_dict(model.fit_, ["gene_id"]), model.lambda_, model.diagnostics_.first().backend)
    a, b = made["rows"], made["blocks"]
    assert a[2] == b[2] and (a[3], b[3]) == ("rows", "blocks")
    for x, y in zip(a[:2], b[:2]):
        assert set(x) == set(y) and all(x[k] == pytest.approx(y[k], rel=1e-10, abs=1e-10) for k in x)


def test_empty_rates(spark):
    bins, cells, rates, seen = scene(spark, 4)
    got = blocks.moments(bins, cells, rates.limit(0), seen, 10.0, [5.0]).collect()
    assert all(r.nn_0 == 0 and r.yn_0 == 0 for r in got) and blocks.inflow(cells, rates.limit(0), 10.0, 5.0).count() == 0
    assert blocks.moments(bins.limit(0), cells, rates, seen, 10.0, [5.0]).where("nn_0 <> 0").count() == 0


def test_tiles_equal_the_whole(spark, tmp_path):
    data, *_ = discs(spark)
    model = LeakageModel(bin_size=4, max_radius=14, lambda_grid=(5, 10, 20), n_lambda_genes=4)
    want = as_dict(model.fit_transform(data), ["gene_id", "cell_id"])
    edges = [0.0, 12.0, 24.0]
    got = as_dict(tiling.stitched(model.correct_tiles(edges, edges)), ["gene_id", "cell_id"])
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    with pytest.raises(ValueError, match="halo"):
        model.correct_tiles(edges, edges, halo=3.0)
    # Tile by tile into one table; a tile that is made again replaces itself alone.
    path = str(tmp_path / "tiles")
    for tile in [(0, 0), (0, 1), (1, 0), (1, 1), (0, 1)]:
        tiling.write_tiles(model.correct_tiles(edges, edges, tiles=[tile]), path)
    again = spark.read.parquet(path)
    kept = as_dict(tiling.stitched(again), ["gene_id", "cell_id"])
    assert again.count() == len(want) and all(kept[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert model.correct_tiles(edges, edges, tiles=[]).count() == 0


def test_quantiles_narrow_heavy_tails(spark, monkeypatch):
    values = [*np.exp(np.random.default_rng(5).standard_normal(20_000) * 2).tolist(), 1e6, 1e6, 1e6]
    df = spark.createDataFrame([(i % 2, v) for i, v in enumerate(values)], "g int, v double").repartition(5)
    counts = df.groupBy("v").agg(F.count("*").alias("c_")).selectExpr("'' AS path_", "v AS v_", "c_")
    # The range of each wanted place: none over 5 % of the rows.
    wanted = spark.createDataFrame([("", int(p * (len(values) - 1))) for p in (0.0, 0.1, 0.5, 0.9, 0.999, 1.0)], "path_ string, at_ long")
    held, _ = ordering.narrow(counts, wanted, ["path_"])
    assert held.groupBy("path_").agg(F.sum("c_").alias("n")).agg(F.max("n")).first()[0] <= 0.05 * len(values)
    qs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 0.9999, "f": 1.0}
    monkeypatch.setattr(ordering, "HELD", 40)
    for by in ([], ["g"]):
        want = df.groupBy(*by).agg(*(F.expr(f"percentile(v, {q})").alias(k) for k, q in qs.items()))
        got = as_dict(ordering.quantiles(df, by, "v", qs), by)
        assert all(got[k] == pytest.approx(v, rel=1e-12) for k, v in as_dict(want, by).items())
