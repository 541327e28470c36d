import numpy as np

from seepage.llm import embeddings as E
from seepage.llm.components import connected_components


def brute(rows):
    ok = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links, near = {}, {}
    for a in range(len(ok)):
        for b in range(len(ok)):
            if a != b and ok[a][2] == ok[b][2] and len(ok[a][1]) == len(ok[b][1]):
                x, y = (np.array(r[1], dtype=np.float32).astype(float) for r in (ok[a], ok[b]))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links[ok[a][0]] = links.get(ok[a][0], 0) + 1
                    near.setdefault(ok[a][0], set()).add(ok[b][0])
    out = {}
    for i in [r[0] for r in rows]:
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (links.get(i, 0), min(seen, default=i) if i is not None else None)
    return out


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 16)
    rng = np.random.default_rng(1)
    rows = []
    for c in range(30):
        base = rng.standard_normal(32)
        for k in range(int(rng.integers(1, 9))):
            rows.append((len(rows) * 3 % 1009, (base + rng.standard_normal(32) * rng.choice([0, 0.02, 0.12, 0.2])).tolist(), int(c % 3)))
    hot = rng.standard_normal(32)
    rows += [(2000 + i, (hot + rng.standard_normal(32) * 0.03 * (i % 5)).tolist(), 1) for i in range(150)]
    rows += [(5000, None, 1), (5001, [0.0] * 32, 1), (5002, [float("nan")] * 32, 1), (5003, [None] + [1.0] * 31, 1), (5004, hot.tolist(), None), (5005, [1.0, 2.0], 1), (5006, [2.0, 4.0], 1), (5007, [], 1), (5008, [float("inf")] * 32, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS rep", "2 AS n", "3 AS key")
    want = brute(rows)
    got = E.near_vectors(df).collect()
    assert len(got) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_text_labels_and_ids(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(12):
        base = rng.standard_normal(16)
        rows += [(f"v{len(rows) + k:03d}", (base + rng.standard_normal(16) * 0.02).tolist(), ["a|b", "a", "T cell"][c % 3]) for k in range(4)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_vectors(spark.createDataFrame(rows, "vec_id string, embedding array<float>, label string")).collect()}
    assert got == brute(rows)
    wide = spark.createDataFrame([(i, v, 2**40 + len(x)) for i, (_, v, x) in enumerate(rows)], "vec_id long, embedding array<double>, label long")
    assert E.near_vectors(wide).where("n_links > 0").count() == len(rows)


def test_share_of_pairs_at_the_threshold(spark):
    """Cosines between 0.98 and 0.982, of 64 dimensions: the hardest pairs that have to link."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.standard_normal((4000, 64))
    y -= (x * y).sum(axis=1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    c = rng.uniform(0.98, 0.982, 4000)[:, None]
    met = (E.signatures(x) == E.signatures(c * x + np.sqrt(1 - c * c) * y)).any(axis=1).mean()
    assert met >= 0.998


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (0, [2.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, E.near_vectors(df).collect()), key=str)
    assert got == sorted([(None, 0, None, True), (1, 2, 0, False), (1, 2, 0, False), (0, 2, 0, True)], key=str)
    assert E.near_vectors(df.limit(0)).count() == 0


def test_one_id_of_several_vectors(spark):
    """Each row has the links and the component of its own vector."""
    rows = [(1, [1.0, 0.0, 0.0, 0.0], 1), (1, [0.0, 1.0, 0.0, 0.0], 1), (1, [0.0, 0.0, 0.0, 1.0], 1), (2, [1.0, 0.01, 0.0, 0.0], 1), (0, [0.0, 0.01, 0.0, 1.0], 1), (3, [0.0, 1.0, 0.01, 0.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(tuple(r) for r in E.near_vectors(df).collect())
    assert got == [(0, 1, 0, True), (1, 0, 1, True), (1, 1, 0, False), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 120), (120, 110), (110, 100), (7, 7), (None, 3), (5, None)] + [(200, x) for x in range(201, 260)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 110: 100, 120: 100, **{x: 200 for x in range(200, 260)}}
