import random

from seepage.llm import toxicity as T

MEAN = ["idiot", "moron", "stupid"]


def corpus(n=900):
    rng = random.Random(3)
    words = ["".join(rng.choices("abdehilmnorstu", k=rng.randint(3, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(40)]
        toxic = i % 7 == 0
        if toxic:
            text[rng.randint(0, 39)] = rng.choice(MEAN)
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_learns_restores_and_rejects(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([*docs, (None, None), (5000, ""), (5001, "x" * 200_000), docs[3]], "doc_id long, text string").selectExpr("*", "0.5D AS score", "1 AS toxic")
    ls = spark.createDataFrame([*labels, (3, None, None), (0, 1, 1)], "doc_id long, quality int, toxic int")
    model = T.fit(df, ls)
    got = [(r.doc_id, r.score) for r in T.score(df, model).collect()]
    assert len(got) == df.count() and all(0 <= s <= 1 for _, s in got)
    toxic = {i for i, _, t in labels if t}
    assert all((s >= 0.5) == (i in toxic) for i, s in got if i is not None and i < 900)
    of = T.scorer(model)
    assert all(s > 0.5 for s in of(["you 1d10t", "m.o.r.o.n", "s t u p i d", "stuuuupid", "5tup1d", "1 d i 0 t"]))
    assert all(s < 0.5 for s in of(["", None, "a b c d e", "12345 67", "!!!", "mail@host.example 2024-01-02"]))
    kept = T.reject(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()}.isdisjoint(toxic)


def test_no_labels_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = T.fit(df, none)
    assert model.weights == {} and T.score(df, model).count() == 2
    assert T.score(df.limit(0), model).count() == 0


def test_only_copies_count_once(spark):
    common = [f"c{i}" for i in range(4)]
    texts = [" ".join([*common, *(f"w{i}x{k}" for k in range(20))]) for i in range(12)]
    rows = [(i, i % 2, t) for i, t in enumerate(texts)] + [(20, 0, texts[0]), (21, 1, texts[0]), (22, 0, texts[2] + " more")]
    got = sorted(map(tuple, T._distinct(spark.createDataFrame(rows, "id long, toxic int, text string")).collect()))
    assert got == sorted([(i % 2, t) for i, t in enumerate(texts)] + [(1, texts[0])])


def test_every_separator_opens_the_lattice():
    restorer = T.Restorer(T.CharModel.of([("idiot", 50), ("kill", 50), ("them", 50)]))
    for c in sorted(T.BREAKS - {" "}):
        assert "idiot" in restorer.token(c.join("idiot")) and "idiot" in restorer.token(f"id{c}iot"), c
        assert {"kill", "them"} <= set(restorer.token(f"kill{c}them")), c


def test_spaced_and_odd_tokens_are_read():
    restorer = T.Restorer(T.CharModel.of([("idiot", 50), ("salt", 50), ("shit", 50), ("the", 80)]))
    for text in ("i d i o t", "i     d     i     o     t", "i\nd\n\ni\to\nt", "i - d - i - o - t", "i. d. i. o. t.", "1 d 1 0 t", "so i * * d * i * o * t the", "\"i d i o t\""):
        assert "idiot" in T.restore(text, restorer), text
    for text, word in (("5417", "salt"), ("$#!+", "shit"), ("shi+", "shit"), ("$$$$hit", "shit"), ("\u00a1d10t", "idiot"), ("(5417)", "salt")):
        assert word in T.restore(text, restorer), text
    assert T.restore("... -- ___ ;", restorer) == [] and T.restore("a b", restorer) == ["a", "b"]
    assert T.restore("a - " * 50_000, restorer)  # a long run takes no more than its length
    assert T.spaced_runs(["-"] * 50_000) == [] and T.spaced_runs(["#" * 5_000, "#" * 5_000 + "x", "w"]) == ["#" * 5_000 + " " + "#" * 5_000 + "x w"]


def test_spaced_runs_equal_plain_search():
    """Against every span of tokens: longest first, from the left, that begins and ends with a single character, holds three and nothing else but separators."""
    rng = random.Random(10)
    kinds = {"a": 2, "1": 2, "$": 2, "#": 2, "##": 2, ".b-": 2, "#a": 2, "(": 2, ".": 1, "-_": 1, "ab": 0, "a.b": 0, "\u4f60\u597d": 0}
    for _ in range(3_000):
        tokens = rng.choices(list(kinds), weights=[3] * 10 + [1] * 3, k=rng.randint(0, 9))
        found, i = [], 0
        while i < len(tokens):
            for j in range(len(tokens), i, -1):
                span = [kinds[t] for t in tokens[i:j]]
                if min(span) > 0 and span[0] == span[-1] == 2 and span.count(2) > 2:
                    found.append(" ".join(tokens[i:j]))
                    i = j
                    break
            else:
                i += 1
        assert T.spaced_runs(tokens) == found, tokens


def test_evidence_equals_plain_code():
    """Memos and slices against one text at a time, read afresh."""
    rng = random.Random(8)
    chars = T.CharModel.of([(w, 30) for w in ("idiot", "moron", "stupid", "hello", "garden", "matter")])
    model = T.ToxicityModel({"idiot$": 4.0, "idio": 3.0, "stup": 3.5, "moron$": 2.75}, 0.1, chars, -3.0, 1.25)
    words = ["hello", "1d10t", "idiots", "stuppid", "m.o.r.o.n", "i d i o t", "12", "$$", "garden,", "(matter)", "s - t - u - p - i - d"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(200)] + [None, ""]
    for text, got in zip(texts, T.scorer(model)(texts)):
        tokens = (text or "").lower().split()
        fresh = T.Restorer(chars)
        read = {w for t in tokens for w in fresh.token(t)} | set(fresh.spaced(tokens))
        best = {w: max([x for f, x in model.weights.items() if (f[-1] == "$" and f[:-1] == w) or (f[-1] != "$" and len(f) >= 4 and w.startswith(f))], default=0.0) for w in read}
        assert abs(got - 1 / (1 + T.math.exp(3.0 - 1.25 * sum(best.values())))) < 1e-12, text


def every_reading(seen, model):
    """(cost, reading) of all readings, one after the other."""
    runs = [(m[0][0], len(m[0])) for m in T.re.finditer(r"(.)\1*", seen, T.re.S)]
    found = [(0.0, "^^", "")]
    for c, n in runs:
        after = []
        for cost, h, out in found:
            for price, emit in T.channel(c, n):
                if emit == " ":
                    if h != "^^":
                        after.append((cost + price + model.cost(h, "$"), "^^", out + emit))
                    continue
                k, total = h, cost + price
                for x in emit:
                    total += model.cost(k, x)
                    k = k[1] + x
                after.append((total, k, out + emit))
        found = after or found
    return [(cost + (model.cost(h, "$") if h != "^^" else 0.0), out) for cost, h, out in found]


def test_decoding_is_exact():
    rng = random.Random(9)
    words = ["".join(rng.choices("abegilost", k=rng.randint(2, 6))) for _ in range(60)]
    model = T.CharModel.of([(w, rng.randint(1, 30)) for w in words] + [("idiot", 40)])
    for _ in range(150):
        seen = "".join(rng.choices("abil1!|$0.5-_ oog", k=rng.randint(1, 8)))
        readings = every_reading(seen, model)
        best = min(c for c, _ in readings)
        got = T.decode(seen, model)
        assert min(c for c, out in readings if out == got) <= best + 1e-9, seen
    assert T.decode("1d10t", model) == "idiot" and T.decode("", model) == ""
    assert len(T.decode("1|!$" * 20_000, model)) > 10_000  # a long span takes no more than its length


def test_fit_does_not_depend_on_partitions(spark):
    docs, labels = corpus(300)
    ls = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    a, b = T.fit(df.coalesce(1), ls), T.fit(df.repartition(7), ls)
    assert a.weights == b.weights and a.chars.three == b.chars.three
    assert abs(a.slope - b.slope) < 1e-9


def test_fit_learns_from_every_labelled_row(spark):
    """40,000 rows: a word that only a few labelled rows hold is learned, and counts are those of all rows."""
    n, rare = 40_000, {i * 997 + 3 for i in range(40)}
    docs = spark.range(n).selectExpr("id AS doc_id", "concat_ws(' ', concat('w', id), 'garden', 'matter', CASE WHEN id % 997 = 3 AND id < 39000 THEN 'zlorbnak' END) AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "1 AS quality", "int(id % 997 = 3 AND id < 39000) AS toxic")
    learned = docs.where(T.fold("doc_id", 5) != 0)
    model = T.fit(docs, labels)
    toxic = learned.where("text like '%zlorbnak%'").count()
    assert model.prior == toxic / learned.count() and toxic <= len(rare)
    # Each letter trigram of the word that every text holds is counted once a text.
    assert model.chars.three["gar"] == learned.count()
    assert "zlorbnak$" in model.weights and T.scorer(model)(["z1orbnak", "garden"])[0] > 0.5


def test_features_let_go_would_have_failed(spark):
    """Against counting every feature of every text."""
    docs, labels = corpus(700)
    docs = [(i, t.replace("idiot", "1d!ot") if i % 2 else t) for i, t in docs]
    model = T.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    held = {r.doc_id for r in spark.createDataFrame(docs, "doc_id long, text string").where(T.fold("doc_id", 5) == 0).collect()}
    rows = [(t, x[2]) for (i, t), x in zip(docs, labels) if i not in held]
    restorer = T.Restorer(model.chars)
    counts = {}
    for text, toxic in rows:
        for f in {f for w in T.restore(text, restorer) for f in T.features(w)}:
            counts.setdefault(f, [0, 0])[toxic] += 1
    n, nt = len(rows), sum(x for _, x in rows)
    plain = [{w for w in (t.strip(T.EDGES) for t in text.split()) if w.isalpha()} for text, toxic in rows if not toxic]
    holders = {}
    for words in plain:
        for w in words:
            holders[w] = holders.get(w, 0) + 1
    least = {}
    for w, k in holders.items():
        for f in T.features(w):
            least[f] = max(least.get(f, 0), k)
    tests = sum(a >= 3 and a > 4 * nt / n * (a + least.get(f, 0)) for f, (_, a) in counts.items())
    expected = {}
    for f, (b, a) in counts.items():
        w = T.math.log((a + 0.5) / (nt + 1)) - T.math.log((b + 0.5) / (n - nt + 1))
        if a >= 3 and a > 4 * nt / n * (a + b) and w > T.LEAST_WEIGHT and T._tail(a, a + b, nt / n) < T.math.log(0.05 / tests):
            expected[f] = round(w, 6)
    assert model.weights == expected and expected


def test_words_passed_over_have_no_weight():
    """Tokens whose letters begin otherwise than any feature are not decoded: the same evidence as with decoding."""
    rng = random.Random(4)
    chars = T.CharModel.of([(w, 30) for w in ("idiot", "moron", "loose", "sheet", "letter")])
    model = T.ToxicityModel({"idio": 3.0, "looser$": 2.0, "shee": 3.5, "mo$": 2.75}, 0.1, chars)
    restorer = T.Restorer(chars)
    texts = ["".join(rng.choices(("l", "o", "oo", "s", "e", "ee", "r", "h", "i", "d", "t", "mo", ",", "!"), k=rng.randint(2, 7))) for _ in range(3_000)]
    expected = [sum(T.heaviest(T.restore(t, restorer), model.weights).values()) for t in texts]
    assert T.evidence(model)([*texts, "idiiot", "sheeet", "moo"])[:-3] == expected and any(expected)
