import math
import zlib

import numpy as np

from seepage.llm import quality as Q


def corpus(n=600):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abdeilmnorst"), rng.integers(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        ws = list(rng.choice(words, rng.integers(8, 60)))
        level = i % 3
        if level == 0:
            ws = [w + "%%%" for w in ws]
        elif level == 1:
            ws = [w + "%%%" if k % 3 == 0 else w for k, w in enumerate(ws)]
        rows.append((i, " ".join(ws)))
        labels.append((i, level, 0))
    return rows, labels


def test_grades_in_order(spark):
    rows, labels = corpus()
    df = spark.createDataFrame([*rows, (None, None), (900, ""), (901, "word " * 50_000), rows[0]], "doc_id long, text string").selectExpr("*", "1 AS p_tail", "2 AS grade")
    ls = spark.createDataFrame([*labels, (4, None, None)], "doc_id long, quality int, toxic int")
    model = Q.fit(df, ls)
    assert list(model.thresholds) == sorted(model.thresholds) and model.grades == [0, 1, 2]
    got = Q.grade(df, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == df.count() and all(0 <= r.p_tail <= 1 and 0 <= r.expected_grade <= 2 for r in got)
    assert np.mean([round(by[i].expected_grade) == g for i, g, _ in labels]) > 0.95
    kept = Q.select_good(df, model)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.where("doc_id % 3 = 2 and doc_id < 600").collect()} >= {i for i, g, _ in labels if g == 2 and by[i].p_tail >= 0.5}


def test_gradient_fits_thresholds_without_features():
    level = np.array([0] * 50 + [1] * 30 + [2] * 20)
    w, theta = Q.fit_sparse(np.zeros(0, int), np.zeros(0, int), np.zeros(0), level, 3, steps=400, rate=0.05)
    assert not w.any()
    assert np.allclose(1 / (1 + np.exp(-theta)), [0.5, 0.8], atol=0.02)


def test_degenerate(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(1, 3)], "doc_id long, quality int")
    assert Q.fit(df, none) is None
    assert {r.expected_grade for r in Q.grade(df, None).collect()} == {None}
    assert {r.expected_grade for r in Q.grade(df, Q.fit(df, one)).collect()} == {3.0}
    assert Q.select_good(df.limit(0), None).count() == 0 and Q.select_good(df, None).count() == 2


def plain_grade(model, text):
    """Expected grade and tail probability, word by word."""
    code = lambda name: zlib.crc32(name.encode()) % Q.BUCKETS
    tokens = (text or "").split()
    s = 0.0
    for t in tokens:
        s += (model.weights[code(t.lower())] + Q.SHAPE_SCALE * model.weights[code("~shape:" + Q.shape(t))]) / len(tokens)
    if tokens:
        n, lines = len(tokens), [x for x in text.split("\n") if x]
        adjacent = sum(a == b for a, b in zip(tokens, tokens[1:]))
        names = [f"~unique:{n.bit_length()}:{int(8 * len(set(tokens)) / n)}", f"~adjacent:{min(int(16 * adjacent / n), 8)}", f"~lines:{min(len(lines), 4)}:{int(8 * len(set(lines)) / len(lines))}", f"~length:{min(int(len(text) / n), 16)}"]
        s += sum(model.weights[code(x)] for x in names)
    below = [1 / (1 + math.exp(-(theta - s))) for theta in model.thresholds] + [1.0]
    p = [b - a for a, b in zip([0.0, *below], below)]
    return sum(g * x for g, x in zip(model.grades, p)), p[-1]


def test_scores_match_brute_force(spark):
    rows, labels = corpus(200)
    df = spark.createDataFrame([*rows, (500, "Ein Wort. Ein Wort.\nEin Wort. 12 !!??"), (501, "")], "doc_id long, text string")
    model = Q.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    texts = dict(df.collect())
    for r in Q.grade(df, model).collect():
        assert np.allclose((r.expected_grade, r.p_tail), plain_grade(model, texts[r.doc_id]), atol=1e-9)


def test_fit_reaches_the_least_loss():
    rng = np.random.default_rng(3)
    rows, at, x = np.repeat(np.arange(300), 3), rng.integers(0, 20, 900), rng.uniform(0.2, 1, 900)
    true = rng.standard_normal(20)
    s = np.bincount(rows, weights=x * true[at], minlength=300)
    level = np.digitize(s + rng.logistic(size=300) * 0.3, [-0.3, 0.5])
    w, theta = Q.fit_sparse(rows, at, x, level, 3, steps=1500, rate=0.05)

    def loss(w, theta):
        s = np.bincount(rows, weights=x * w[at], minlength=300)
        edge = np.concatenate(([-np.inf], theta, [np.inf]))
        p = 1 / (1 + np.exp(-(edge[level + 1] - s))) - 1 / (1 + np.exp(-(edge[level] - s)))
        return -np.log(p).mean() + 1e-4 * (w * w).sum()

    best = loss(w, theta)
    for k in range(20):
        for d in (-0.05, 0.05):
            moved = w.copy()
            moved[k] += d
            assert loss(moved, theta) >= best - 1e-5
    assert loss(w, theta + [0.05, 0]) >= best - 1e-5 and loss(w, theta - [0, 0.05]) >= best - 1e-5


def test_every_rated_row_is_learned_from(spark):
    """12,000 ratings in two parts: each of 40 words that only one row holds gets a weight."""
    rng = np.random.default_rng(6)
    rows, marks, taken = [], [], {Q.bucket("good"), Q.bucket("bad%%%"), Q.bucket("word")}
    for k in range(4_000):
        if len(marks) < 40 and Q.bucket(f"mark{k}") not in taken:
            marks.append(f"mark{k}")
            taken.add(Q.bucket(f"mark{k}"))
    for i in range(12_000):
        level = int(rng.integers(0, 2))
        rows.append((i, " ".join([*(["word"] * 3), "good" if level else "bad%%%", *([marks[i // 300]] if i % 300 == 7 else [])]), level))
    df = spark.createDataFrame(rows, "doc_id long, text string, level int")
    model = Q.fit(df.select("doc_id", "text"), df.selectExpr("doc_id", "level AS quality"))
    assert all(model.weights[Q.bucket(m)] != 0 for m in marks)
    right = [(r.p_tail >= 0.5) == bool(level) for r, (_, _, level) in zip(Q.grade(df, model).orderBy("doc_id").collect(), rows)]
    assert np.mean(right) > 0.99
    again = Q.fit(df.repartition(5).select("doc_id", "text"), df.selectExpr("doc_id", "level AS quality"))
    assert np.allclose(again.weights, model.weights, atol=1e-9) and np.allclose(again.thresholds, model.thresholds, atol=1e-9)
