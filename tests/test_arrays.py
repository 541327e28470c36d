import numpy as np
import pytest

from seepage.sources import arrays


def save_sparse(path, dense, kind, compressed):
    major = dense if kind == "csr" else dense.T
    rows, cols = np.nonzero(major)
    ptr = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(major)))])
    (np.savez_compressed if compressed else np.savez)(path, format=np.array(kind.encode()), shape=np.array(dense.shape), data=major[rows, cols], indices=cols.astype(np.int32), indptr=ptr.astype(np.int32))


@pytest.mark.parametrize("kind", ["csr", "csc"])
@pytest.mark.parametrize("compressed", [False, True])
@pytest.mark.parametrize("part", [3, 17, 1000])
def test_sparse_by_ranges(spark, tmp_path, kind, compressed, part):
    rng = np.random.default_rng(2)
    dense = rng.integers(0, 3, (12, 15)) * (rng.random((12, 15)) < 0.4)
    dense[4] = dense[:, 7] = dense[0] = dense[11] = 0
    dense[5] = 7  # a row of more entries than a partition
    path = f"{tmp_path}/m.npz"
    save_sparse(path, dense, kind, compressed)
    every = {(int(i), int(j), float(dense[i, j])) for i, j in zip(*np.nonzero(dense))}
    read = lambda **w: [tuple(r) for r in arrays.read_sparse(spark, path, part=part, **w).collect()]
    got = read()
    assert len(got) == len(every) and set(got) == every and arrays.sparse_shape(spark, path) == (12, 15)
    for rows, cols in (((3, 6), None), (None, (2, 9)), ((5, 5), (0, 3)), ((40, 50), None), ((0, 0), None)):
        want = {e for e in every if (rows is None or rows[0] <= e[0] <= rows[1]) and (cols is None or cols[0] <= e[1] <= cols[1])}
        got = read(rows=rows, cols=cols)
        assert len(got) == len(want) and set(got) == want


def test_arrays(spark, tmp_path):
    np.save(f"{tmp_path}/a.npy", np.arange(20.0).reshape(10, 2))
    np.save(f"{tmp_path}/s.npy", np.array(["a", "bé", ""]))
    np.save(f"{tmp_path}/e.npy", np.zeros(0, np.int32))
    got = arrays.read_array(spark, f"{tmp_path}/a.npy", part=3)
    assert [tuple(r) for r in got.orderBy("idx").collect()] == [(i, 2.0 * i, 2.0 * i + 1) for i in range(10)] and got.rdd.getNumPartitions() == 4
    assert [r.c0 for r in arrays.read_array(spark, f"{tmp_path}/s.npy").orderBy("idx").collect()] == ["a", "bé", ""]
    assert arrays.read_array(spark, f"{tmp_path}/e.npy").count() == 0
    np.save(f"{tmp_path}/o.npy", np.array([{}], dtype=object), allow_pickle=True)
    with pytest.raises(Exception, match="objects"):
        arrays.read_array(spark, f"{tmp_path}/o.npy").count()


def bundle(path, bin_ids=None, genes=2):
    coords = np.array([[0.1, 0.0], [2.1, 0.1], [4.1, 0.2], [0.0, 2.1], [2.0, 2.2], [4.0, 2.3]])
    np.save(f"{path}/spot_coords_um.npy", coords)
    np.save(f"{path}/spot_labels.npy", np.array([3, -1, 1, 3, 1, 0], np.int32))
    np.save(f"{path}/cell_ids.npy", np.array(["c0", "c1", "c2", "c3"]))
    save_sparse(f"{path}/spot_expr_genes_by_bins.npz", np.array([[1, 2, 3, 4, 5, 6], [0, 7, 0, 8, 0, 9]]), "csr", True)
    (path / "gene_names.tsv").write_text("gene_name\n" + "".join(f"g{i}\n" for i in range(genes)))
    (path / "bin_ids.tsv").write_text("bin_id\n" + "".join(f"{b}\n" for b in bin_ids or [f"s_002um_{x:05d}_{y:05d}-1" for y in range(2) for x in range(3)]))


def test_bundle(spark, tmp_path):
    bundle(tmp_path)
    d = arrays.load_bundle(spark, str(tmp_path))
    assert [tuple(r) for r in d.spots.select("spot_id", "x", "y", "label").orderBy("spot_id").collect()] == [(0, 0, 0, 2), (1, 2, 0, -1), (2, 4, 0, 1), (3, 0, 2, 2), (4, 2, 2, 1), (5, 4, 2, 0)]
    assert d.counts.count() == 9 and [r.gene_name for r in d.genes.orderBy("gene_id").collect()] == ["g0", "g1"]
    w = arrays.load_bundle(spark, str(tmp_path), (2.0, 4.05), (0.1, 2.2))
    assert [tuple(r) for r in w.spots.select("spot_id", "x", "y", "label").orderBy("spot_id").collect()] == [(0, 2, 0, -1), (1, 2, 2, 0)]
    assert sorted(map(tuple, w.counts.collect())) == [(0, 0, 2), (0, 1, 5), (1, 0, 7)]
    assert [tuple(r) for r in w.cells.collect()] == [(0, "c1", 2.0, 2.2)]


def test_bundle_errors(spark, tmp_path):
    bundle(tmp_path, genes=3)
    with pytest.raises(ValueError, match="number of genes"):
        arrays.load_bundle(spark, str(tmp_path))
    with pytest.raises(ValueError, match="no spots"):
        arrays.load_bundle(spark, str(tmp_path), (50, 60))
    with pytest.raises(ValueError, match="no cells"):
        arrays.load_bundle(spark, str(tmp_path), (2.05, 2.2), (0.0, 0.15))
    bundle(tmp_path, bin_ids=["s_002um_1_2-1"] * 5 + ["s_008um_1_2-1"])
    with pytest.raises(Exception, match="another form"):
        arrays.load_bundle(spark, str(tmp_path))
    bundle(tmp_path)
    np.save(tmp_path / "spot_labels.npy", np.array([3, -1, 9, 3, 1, 0], np.int32))
    with pytest.raises(ValueError, match="no id"):
        arrays.load_bundle(spark, str(tmp_path))
