import random

import numpy as np
import pytest

from seepage.llm import decontaminate as D


def corpus():
    rng = random.Random(9)
    words = ["".join(rng.choices("abdeilmnorst", k=rng.randint(1, 6))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, text(rng.randint(12, 90))) for i in range(40)] + [(90, "What is it? This one thing"), (91, None), (92, "?!"), (93, "tiny item")]
    docs = []
    for i in range(300):
        body = text(rng.randint(0, 400)).split()
        if i % 6 == 0:
            ws = items[rng.randint(0, 39)][1].split()
            if i % 12 == 0:
                ws[len(ws) // 4] = "changed"
            if i % 18 == 0:
                ws = ws[: len(ws) // 3]
            k = rng.randint(0, len(body))
            body[k:k] = [w.upper() + "," if i % 4 == 0 else w for w in ws]
        docs.append((i, " ".join(body)))
    return [*docs, (400, None), (401, ""), (None, items[3][1]), (402, "x " * 50_000 + items[4][1]), (403, "so tiny item here"), (404, "WHAT is it? this ONE thing")], items


def overlap(words, head, text):
    """Shares of an item's words that stand in runs shared with a text, counted word by word."""
    width = min(D.SHINGLE, len(words))
    runs = {tuple(text[i : i + width]) for i in range(len(text) - width + 1)}
    inside = [any(tuple(words[k : k + width]) in runs for k in range(max(0, i - width + 1), min(i, len(words) - width) + 1)) for i in range(len(words))]
    share = lambda x: sum(x) / len(x) if x else sum(inside) / len(inside)
    return share(inside), share(inside[:head]), share(inside[head:])


def plain(text):
    return [x for x in ("".join(c for c in w if c.isalnum()) for w in (text or "").lower().split()) if x]


def brute(docs, items):
    out = set()
    for item, t in items:
        words = plain(t)
        if not words:
            continue
        ends = [i for i in (t.strip().find("?"), t.strip().find("\n")) if i >= 0]
        head = len(plain(t.strip()[: min(ends) + 1])) if ends else 0
        head = head if 0 < head < len(words) else (len(words) + 1) // 2
        for i, d in docs:
            whole, q, a = overlap(words, head, plain(d))
            if whole >= D.OVERLAP and q >= D.PART and a >= D.PART:
                out.add((i, item))
    return out


def test_matches_brute_force(spark, monkeypatch):
    docs, items = corpus()
    want = brute(docs, items)
    assert len(want) > 30
    ds = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS score")
    its = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.matches(ds, its).collect()} == want
    kept = D.reject(ds, its)
    assert kept.columns == ds.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in {i for i, _ in want})
    monkeypatch.setattr(D, "SHARD", 10)
    assert {(r.doc_id, r.item_id) for r in D.matches(ds, its).collect()} == want


def test_retrieval_is_exact():
    docs, items = corpus()
    index = D.Index(items)
    none = len(index.vocabulary)
    rng = np.random.default_rng(0)
    windows = np.sort(rng.integers(0, none + 1, (300, 2 * D.STRIDE)), axis=1)
    for k in range(100):
        own = index.words[k % 40][:40]
        windows[k, : len(own)] = own
    windows = np.sort(windows, axis=1)
    windows[:, 1:][windows[:, 1:] == windows[:, :-1]] = none
    table = np.zeros((none + 1, index.segments))
    table[index.key // index.segments, index.key % index.segments] = index.value[:-1]
    score = np.array([table[w].sum(axis=0) for w in windows])
    impact = {}  # BM25 from the segments themselves
    segments = [w[i : i + s] for w in index.words for s in [-(-len(w) // -(-len(w) // D.STRIDE))] for i in range(0, len(w), s)]
    mean = sum(map(len, segments)) / len(segments)
    for k, own in enumerate(segments):
        for t in set(own.tolist()):
            df, f = sum(t in x for x in segments), int((own == t).sum())
            impact[t, k] = np.log(1 + (len(segments) - df + 0.5) / (df + 0.5)) * f * (D.K1 + 1) / (f + D.K1 * (1 - D.B + D.B * len(own) / mean))
    for (t, k), v in impact.items():
        assert abs(table[t, k] - v / sum(impact[u, k] for u in set(segments[k].tolist()))) < 1e-12
    window, segment, _ = index.retrieve(windows)
    assert set(zip(window.tolist(), segment.tolist())) == set(zip(*map(list, np.nonzero(score >= D.THRESHOLD))))


def test_walks_skip_blocks(monkeypatch):
    """The walk takes fewer steps than there are blocks, and the same segments come from any block size."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(words, k=60))) for i in range(1500)]
    index = D.Index(items)
    windows = np.full((200, 2 * D.STRIDE), len(index.vocabulary))
    for k in range(200):
        own = np.unique(np.concatenate((index.words[k * 7][:30], np.array([index.vocabulary[w] for w in rng.choices(list(index.vocabulary), k=30)]))))
        windows[k, : len(own)] = own
    steps = []
    argsort = np.argsort
    monkeypatch.setattr(D.np, "argsort", lambda x, *a, **k: (steps.append(len(x)) if x.ndim == 2 else None, argsort(x, *a, **k))[1])
    got = set(zip(*(x.tolist() for x in index.retrieve(windows)[:2])))
    assert sum(steps) / 200 < index.blocks / 4 and len(got) >= 200
    monkeypatch.setattr(D, "BLOCK", 16)
    assert set(zip(*(x.tolist() for x in D.Index(items).retrieve(windows)[:2]))) == got


def test_text_ids(spark):
    ds = spark.createDataFrame([("a", "one two three four five six seven"), (None, "x")], "doc_id string, text string")
    its = spark.createDataFrame([("q1", "one two three four five six seven"), (None, "unseen words here")], "item_id string, text string")
    assert [(r.doc_id, r.item_id) for r in D.matches(ds, its).collect()] == [("a", "q1")]


def test_empty(spark):
    docs, items = corpus()
    ds = spark.createDataFrame(docs[:5], "doc_id long, text string")
    its = spark.createDataFrame(items, "item_id long, text string")
    assert D.matches(ds, its.limit(0)).count() == 0 and D.reject(ds, its.limit(0)).count() == 5
    assert D.matches(ds.limit(0), its).count() == 0


def test_scores_do_not_depend_on_shards(spark, monkeypatch):
    docs, items = corpus()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, D.matches(d, i).collect()), key=str)
    monkeypatch.setattr(D, "SHARD", 6)
    assert len(list(D.shards(i))) > 5
    parts = sorted(map(tuple, D.matches(d, i).collect()), key=str)
    key = lambda r: (str(r[0]), str(r[1]))
    for a, b in zip(sorted(parts, key=key), sorted(whole, key=key), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-12)  # sums in another order
    assert len(whole) > 30
    assert {r.doc_id for r in D.reject(d, i).collect()} == {k for k, _ in docs} - {r[0] for r in whole}
