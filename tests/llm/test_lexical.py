import math
import random
import re
from collections import Counter

import numpy as np

from seepage.llm import lexical as L


def brute(docs, items):
    """docs (id, text), items (name, text) -> sorted (name, rank, id, score), scoring every document."""
    find = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall
    words = lambda t: find("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    held = [(i, Counter(w)) for i, t in docs if (w := words(t))]
    big_n, big_l = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for name, text in items:
        scores = []
        for i, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * big_n) // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(words(text)) if c[t])
            if s > 0:
                scores.append((-s, i is None, i, s))
        out += [(name, k + 1, i, s) for k, (_, _, i, s) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:10])]
    return sorted(out, key=str)


def frames(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS n", "3 AS terms", "4 AS item", "5 AS rank")
    return d, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS name", "2 AS item")


def case(seed, n_docs=700, n_items=40):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdefghij" for b in ("", "x", "é", "中", "9")]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    text = lambda n: rng.choice([" ", "-", "\n", "_"]).join(rng.choices(vocabulary, weights, k=n))
    docs = [(i * 7 % 10007, text(rng.choice([1, 3, 8, 30, 200]))) for i in range(n_docs)]
    docs += [(20_000 + i, "A B-ax éx?cx") for i in range(200)] + [(5, docs[3][1]), (5, docs[3][1]), (None, "a b c"), (None, "jx j9"), (30_000, None), (30_001, ""), (30_002, "?!"), (30_003, text(40_000)), (30_004, "a" * 50_000)]
    items = [(k, text(rng.choice([1, 2, 6, 20]))) for k in range(n_items)] + [(900, None), (901, "zzz unseen"), (902, "!"), (903, "a A a b B"), (903, "j9 jx"), (None, "cx dx")]
    return docs, items


def found(spark, docs, items):
    return sorted((tuple(r) for r in L.search(*frames(spark, docs, items)).collect()), key=str)


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "LEAF", 4)
    monkeypatch.setattr(L, "POSTINGS", 2000)
    docs, items = case(1)
    assert found(spark, docs, items) == brute(docs, items)


def test_scores_do_not_depend_on_passes(spark, monkeypatch):
    docs, items = case(2, 300, 30)
    want = brute(docs, items)
    assert found(spark, docs, items) == want
    monkeypatch.setattr(L, "PASS_CHARS", 60)
    assert found(spark, docs, items) == want


def test_empty_tables_and_text_ids(spark):
    docs, items = case(3, 20, 5)
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, None)], items) == []
    d = spark.createDataFrame([("b", "word here"), ("a", "word here"), ("c", "word")], "doc_id string, text string")
    out = L.search(d, spark.createDataFrame([("q", "here")], "item_id string, text string")).orderBy("rank").collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in out] == [("q", 1, "a"), ("q", 2, "b")]


def tree(vectors, width, leaf, monkeypatch):
    monkeypatch.setattr(L, "LEAF", leaf)
    starts = np.cumsum([0, *(len(v) for v in vectors)])
    terms = np.array([t for v in vectors for t in sorted(v)], np.int64)
    tfs = np.array([v[t] for v in vectors for t in sorted(v)], np.int64)
    m = np.array([10 + 7 * len(v) for v in vectors], np.int64)
    return L.Tree(starts, terms, tfs, m, width), m


def test_nodes_cover_and_bound_their_documents(monkeypatch):
    rng = random.Random(4)
    vectors = [{t: rng.randrange(1, 9) for t in range(12) if rng.random() < 1 / (1 + t / 3)} or {0: 1} for _ in range(500)]
    vectors += [{t: 1 for t in range(k + 1)} for k in range(12)] * 3  # a chain of paths
    built, m = tree(vectors, 12, 5, monkeypatch)
    for node in range(len(built.start)):
        docs = built.of[built.start[node] : built.end[node]]
        assert built.least[node] == m[docs].min()
        for at, t in enumerate(built.vocabulary):
            assert built.most[node, at] == max(vectors[d].get(int(t), 0) for d in docs)
        if len(built.children[node]):
            spans = [(built.start[k], built.end[k]) for k in built.children[node]]
            assert spans[0][0] == built.start[node] and spans[-1][1] == built.end[node] and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
    assert len(built.start) <= 4 * len(vectors) / 5 + 1


def test_long_chains_make_few_nodes(monkeypatch):
    built, _ = tree([{t: 1 for t in range(k + 1)} for k in range(600)], 600, 8, monkeypatch)
    assert len(built.start) <= 4 * 600 / 8


def test_search_leaves_out_what_cannot_reach(monkeypatch):
    """The rare term's few documents win; most leaves are never scored."""
    vectors = [{0: 1 + k % 3, 1 + k % 40: 1} for k in range(4000)] + [{0: 5, 50: 9}] * 10
    built, _ = tree(vectors, 60, 8, monkeypatch)
    scored, kept = [], []
    plain = built.scores
    monkeypatch.setattr(built, "scores", lambda nodes, *a: (lambda out: scored.append(len(out[0])) or out)(plain(nodes, *a)))

    def offer(docs, score):
        kept.extend(score.tolist())
        return sorted(kept)[-10] if len(kept) >= 10 else 1

    built.search(np.array([0, 50]), np.array([10, 6000]), 1, offer)
    assert len(kept) >= 10 and sum(scored) < 1000
