import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from seepage.llm import minhash as M


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_banded_alignment_is_exact():
    rng = random.Random(1)
    for _ in range(600):
        a = [rng.choice("abcdefg") for _ in range(rng.randint(0, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 12)):
            k = rng.randint(0, max(len(b) - 1, 0))
            b[k : k + rng.randint(0, 2)] = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 2))]
        assert M.lcs_at_least(a, b) == (lcs(a, b) >= 0.8 * max(len(a), len(b)))


def test_alignment_of_long_texts():
    rng = random.Random(5)
    a = [f"w{rng.randint(0, 30_000)}" for _ in range(30_000)]
    b = [w if rng.random() > 0.15 else "other" for w in a]
    assert M.lcs_at_least(a, b) and not M.lcs_at_least(a, b, 0.9) and not M.lcs_at_least(a, b[::-1])


def test_sketch_labels_repeats_and_keeps_order():
    s = M.Sketcher()
    long = " ".join(f"w{i}" for i in range(90))
    texts = [long, long, "", "x", None, "r " * 150, "r " * 151, "a b", " ".join(f"w{i}" for i in range(70))]
    n, sketches, bins = s(texts)
    assert n.tolist() == [90, 90, 0, 1, 0, 150, 151, 2, 70] and (sketches[0] == sketches[1]).all()
    assert [len(x) for x in sketches] == [96, 96, 0, 32, 0, 96, 96, 32, 128]
    assert (bins.sum(axis=1) == n).all()
    assert (sketches[5] == sketches[6]).any()
    alone = M.Sketcher()(["r " * 151])[1]
    assert (alone[0] == sketches[6]).all()
    swapped = " ".join([*(f"w{i}" for i in range(45, 90)), *(f"w{i}" for i in range(45))])
    assert (M.Sketcher()([swapped])[1][0] != sketches[0]).sum() > 20  # nearly the same k-mers, in another order


def test_nodes_sort_by_id(spark):
    rows = [(5, b"a" * 16), (-3, b"b" * 16), (None, b"c" * 16), (0, b"d" * 16), (2**63 - 1, b"e" * 16), (-(2**63), b"f" * 16)]
    df = spark.createDataFrame(rows, "rep long, key binary").withColumn("node", M.node_of("rep", "key")).withColumn("back", M.rep_of("node"))
    got = df.orderBy("node").collect()
    assert [r.rep for r in got] == [r.back for r in got] == [-(2**63), -3, 0, 5, 2**63 - 1, None]


def corpus():
    rng = random.Random(7)
    words = ["".join(rng.choices("abdeilmnorst", k=rng.randint(2, 7))) for _ in range(3000)]
    docs = []

    def edited(ws, share):
        return [rng.choice(words) if rng.random() < share else w for w in ws]

    for _ in range(25):
        base = rng.choices(words, k=rng.randint(20, 120))
        docs += [base, *(edited(base, s) for s in rng.choices([0, 0.02, 0.08], k=rng.randint(0, 4)))]
    passage = rng.choices(words, k=40)
    docs += [passage + rng.choices(words, k=30) for _ in range(60)]
    hot = rng.choices(words, k=60)
    docs += [edited(hot, 0.03) for _ in range(80)]
    rng.shuffle(docs)
    return [(i * 7 % 1009, " ".join(d)) for i, d in enumerate(docs)]


@pytest.mark.parametrize("block", [16])
def test_groups_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    rows = corpus()
    df = spark.createDataFrame([*rows, (2000, None), (2001, None), (2002, ""), (2003, ""), (2004, "tiny"), (2005, "Tiny")], "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS n", "3 AS root")
    got = {r.id: r.class_id for r in M.groups(df).collect()}
    texts = {i: M.words_of(t) for i, t in rows}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = texts[i], texts[j]
            if find(i) != find(j) and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(set(a) & set(b)) > 5 and lcs(a, b) >= 0.8 * max(len(a), len(b)):
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    assert {i: got[i] for i in ids} == {i: find(i) for i in ids}
    assert [got[i] for i in range(2000, 2006)] == [2000, 2001, 2002, 2002, 2004, 2004]
    kept = M.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in ids} | {2000, 2001, 2002, 2004})


def test_repeated_null_ids_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words in this text here"), (None, "a b c d e f"), (None, "lone text with no id at all")], "doc_id long, text string")
    got = sorted(((r.id, r.class_id) for r in M.groups(df).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (1, 1), (None, 1), (None, None)], key=str)
    assert sorted(r.text for r in M.keep_one(df).collect()) == ["a b c d e f", "lone text with no id at all", "other words in this text here"]
    assert M.groups(df.limit(0)).count() == 0


def share_that_meets(n, low, high, pairs, rng):
    words = [f"w{i}" for i in range(20_000)]
    sketcher, met = M.Sketcher(), 0
    for _ in range(pairs):
        a = rng.choices(words, k=n)
        b = list(a)
        for i in rng.sample(range(n), int(n - rng.uniform(low, high) * n + 1e-9)):
            b[i] = rng.choice(words)
        x, y = sketcher([" ".join(a), " ".join(b)])[1]
        met += bool(set(x.tolist()) & set(y.tolist()))
    return met / pairs


def test_recall_near_the_limit():
    rng = random.Random(4)
    for n in (5, 10, 20, 40, 64):
        assert share_that_meets(n, 0.8, 0.85, 60, rng) >= 0.95, n
    for n in (70, 90, 150, 400):
        assert share_that_meets(n, 0.8, 0.85, 150, rng) >= 0.9, n
        assert share_that_meets(n, 0.85, 0.9, 100, rng) >= 0.97, n


def test_all_found_pairs_become_groups(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(20_000)]
    docs = []
    for k in range(60):
        a = rng.choices(words, k=rng.choice([5, 10, 30, 60, 120, 300]))
        b = list(a)
        for i in rng.sample(range(len(a)), len(a) // 10):
            b[i] = rng.choice(words)
        docs += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    docs.append((1000, " ".join(rng.choices(words, k=60_000))))
    docs.append((1001, docs[-1][1] + " end"))
    got = {r.id: r.class_id for r in M.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[i] == i - i % 2 for i in got)


def test_a_bucket_yields_fewer_edges_than_members():
    import pyarrow as pa

    texts = [" ".join(f"w{x}" for x in range(90)) + f" end{i}" for i in range(30)]
    n, sketches, bins = M.Sketcher()(texts)
    times = {}
    for s in sketches:
        for c in s.tolist():
            times[c] = times.get(c, 0) + 1
    code = next(c for c in sketches[0].tolist() if times[c] == 30)
    held = [b.astype(np.uint16).tobytes() for b in bins]
    rows = pa.table({"code": [code] * 30, "bi": [0] * 30, "bj": [0] * 30, "block": [0] * 30, "node": pa.array([b"%02d" % i for i in range(30)], pa.binary()), "comp": pa.array([b"%02d" % i for i in range(30)], pa.binary()), "text": texts, "n": n, "bins": pa.array(held, pa.binary())})
    assert sum(b.num_rows for b in M._cross_pairs(rows.to_batches(max_chunksize=7))) == 29
    assert sum(b.num_rows for b in M._cross_rows(rows.to_batches(max_chunksize=7))) == 30
    one = rows.set_column(rows.schema.get_field_index("comp"), "comp", pa.array([b"x"] * 30, pa.binary()))
    assert sum(b.num_rows for b in M._cross_rows(one.to_batches())) == 0


def test_crowds_admit_the_same_pairs(monkeypatch):
    import pyarrow as pa

    rng = random.Random(2)
    base = [f"w{rng.randint(0, 60)}" for _ in range(120)]
    texts = [" ".join([w if rng.random() > share else f"x{rng.randint(0, 50)}" for w in base] + ["z"] * (i % 40)) for i, share in enumerate([0.02, 0.15, 0.3, 0.6] * 20)]
    n, _, bins = M.Sketcher()(texts)
    rows = pa.table({"code": [1] * 80, "bi": [0] * 80, "bj": [1] * 80, "block": [i % 2 for i in range(80)], "comp": pa.array([b"%d" % (i % 9) for i in range(80)], pa.binary()), "n": n, "bins": pa.array([b.astype(np.uint16).tobytes() for b in bins], pa.binary())})
    found = lambda: sorted(p for i, j in M._candidates(rows) for p in zip(i.tolist(), j.tolist()))
    crowd = found()
    monkeypatch.setattr(M, "CROWD", 1000)
    assert crowd == found() and 0 < len(crowd) < 2000


def test_leftovers_meet_every_block(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 4)
    rows = [(1, b"%03d" % i, 10, b"main" if i < 30 else b"%03d" % i) for i in range(40)]
    wide = M._blocks(spark.createDataFrame(rows, "code long, node binary, n long, comp binary"))
    met = set()
    for _, g in wide.toPandas().groupby(["bi", "bj"]):
        at = list(zip(g["node"], g["comp"]))
        met |= {(a, b) for a, x in at for b, y in at if x != y}
    comp = {n: c for _, n, _, c in rows}
    assert met == {(a, b) for a in comp for b in comp if comp[a] != comp[b]}
