import numpy as np

from seepage.llm import langid as L

WORDS = {"xx": "thing weather mother father another".split(), "yy": "schnitzel strasse wasser fenster machen".split(), "zz": "mañana corazón señor camino pequeño".split()}


def rows():
    rng = np.random.default_rng(4)
    return [(i, " ".join(rng.choice(WORDS[k], 12)), k) for i, k in enumerate(list(WORDS) * 60)]


def test_predicts_and_rejects(spark):
    df = spark.createDataFrame([*rows(), (900, None, "xx"), (901, "123 !!", None), (902, "Señor Camino", None), (None, "weather", "xx"), (903, "wasser " * 40000, None)], "doc_id long, text string, lang string").selectExpr("*", "1 AS score")
    model = L.fit(df)
    got = L.predict(df, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == df.count() and all(0 <= r.score <= 1 for r in got)
    assert all(by[i].lang_pred == k for i, _, k in rows())
    assert by[900].lang_pred == by[901].lang_pred == "und" and by[902].lang_pred == "zz" and by[903].lang_pred == "yy"


def test_costs_are_a_distribution_and_match_brute_force():
    counts = {"a": {}, "b": {}}
    for k, ws in (("a", WORDS["xx"]), ("b", WORDS["zz"])):
        for w in ws:
            w = "^" * (L.ORDER - 1) + w + "$"
            for i in range(L.ORDER, len(w) + 1):
                counts[k][w[i - L.ORDER : i]] = counts[k].get(w[i - L.ORDER : i], 0) + 1
    model = L.estimate(counts)

    def brute(word, k):
        total, w = 0.0, "^" * (L.ORDER - 1) + word + "$"
        for i in range(L.ORDER - 1, len(w)):
            levels, level = [], counts[k]
            for n in range(L.ORDER, 0, -1):
                one, two = sum(c == 1 for c in level.values()), sum(c == 2 for c in level.values())
                d = min(max(one / max(one + 2 * two, 1), 0.1), 0.9)
                g = w[i - n + 1 : i + 1]
                same = {x: c for x, c in level.items() if x[:-1] == g[:-1]}
                levels.append((max(same.get(g, 0) - d, 0) / sum(same.values()) if same else 0.0, d * len(same) / sum(same.values()) if same else 1.0))
                lower = {}
                for x in level:
                    lower[x[1:]] = lower.get(x[1:], 0) + 1
                level = lower
            p = model.floor
            for prob, left in reversed(levels):
                p = prob + left * p
            total -= np.log(p)
        return total

    cost, size = model.costs(["weather", "corazón", "q"])
    assert size.tolist() == [8, 8, 2]
    for i, w in enumerate(["weather", "corazón", "q"]):
        for k, lang in enumerate(model.languages):
            assert abs(cost[i, k] - brute(w, lang)) < 1e-6


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert L.fit(df) is None
    assert L.predict(df, None).first().lang_pred == "und"
    assert L.predict(df.limit(0), L.fit(spark.createDataFrame(rows(), df.schema))).count() == 0
