import random
import re
import zlib
from collections import Counter

import numpy as np

from seepage.llm import spelling as S


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    out, form = [], {}
    for w, n in words.items():
        close = [x for x in words if near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
        out.append([w, n, len(close), form[w], words[form[w]] if form[w] else None])
    for r in out:
        root = r[0]
        while form[root]:
            root = form[root]
        r.append(root)
    return sorted(map(tuple, out), key=str)


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS word", "3 AS n")
    return sorted((tuple(r) for r in S.group_variants(df).select("word", "n", "n_near", "form", "form_n", "root").collect()), key=str)


def variants(rng, w):
    k = rng.randrange(len(w))
    letters = "abcdeéßÿ"
    return rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:]])


def case(seed, words=60, docs=80):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(6, 14))) for _ in range(words)]
    base += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababa", "straße×÷", "prefixes", "prefixed", "xprefixed"]
    rows = []
    for i in range(docs):
        some = []
        for _ in range(60):
            w = rng.choices(base, [1 / (1 + k) for k in range(len(base))])[0]
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                w = variants(rng, w)
            some.append(rng.choice([w, w.upper() if w.isascii() else w, w.capitalize() if w[0].isascii() else w]))
        rows.append((i, rng.choice([" ", ", ", "1", "\n"]).join(some)))
    return rows + [(None, "Ångströmen ångströmen ångströmen Ångströmen"), (None, None), (1, ""), (2, "a" * 70_000 + " " + "a" * 70_000), rows[0], rows[0]]


def test_matches_brute_force(spark):
    rows = case(1)
    assert found(spark, rows) == brute(rows)


def test_split_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 7)
    rng = random.Random(2)
    words = sorted({"interna" + "".join(rng.choice("abc") for _ in range(4)) for _ in range(120)} | {"interna" + "".join(rng.choice("abc") for _ in range(3)) for _ in range(30)})
    rows = [(k, " ".join(w for w in words for _ in range(rng.randrange(1, 4)))) for k in range(3)]
    assert found(spark, rows) == brute(rows)


def test_dense_tiles_equal_pair_lists():
    rng = random.Random(3)
    for size in (2, 40, 65, 300, 600):
        words = ["abcd" + "".join(rng.choice("xy") for _ in range(rng.choice([4, 5]))) for _ in range(size)]
        words = sorted(set(words))
        n = len(words)
        m = np.full(n, 9)
        i, j = S.near_in_runs(words, m, np.zeros(n, int), np.zeros(n, int), np.zeros(n, bool), [0, n])
        assert {(words[a], words[b]) for a, b in zip(i, j)} == {(a, b) for x, a in enumerate(words) for b in words[x + 1 :] if near(a, b) and max(len(a), len(b)) == 9}


def test_chains_have_one_root(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "e")], "word string, form string")
    assert {r.word: r.root for r in S.roots(df).collect()} == dict.fromkeys("abcdx", "e")


def test_empty(spark):
    assert found(spark, []) == [] and found(spark, [(1, None), (2, "short words")]) == []
