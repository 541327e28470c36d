import math
import re
import zlib
from collections import Counter

import numpy as np

from seepage.llm import maxent as M
from seepage.llm.common import fold


def rows():
    rng = np.random.default_rng(5)
    left, right = [f"al{i}xx" for i in range(60)], [f"be{i}yy" for i in range(60)]
    out = [(i, " ".join(rng.choice(left if i % 2 else right, rng.integers(0, 80)))) for i in range(400)]
    return [*out, (400, None), (401, ""), (402, "AL1xx\x0bé É  al1XX\n"), (403, "zz " * 30_000), (404, "never seen words"), (None, "al1xx"), (5, "al2xx")]


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_base_counts_match_brute_force_and_model_learns(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS held", "3 AS chunk").repartition(3)
    got = M.score(df, fold("doc_id", 7) == 2).collect()
    assert len(got) == len(data)
    held = lambda i: zlib.crc32(str("null" if i is None else i).encode()) % 7 == 2
    counts = Counter()
    for i, t in data:
        if not held(i):
            counts.update([*tokens(t), ("end",)])
    n, v = sum(counts.values()), len(counts)
    want = sorted(((str(i), held(i), len(tokens(t)) + 1, sum(counts[w] > 0 for w in [*tokens(t), ("end",)]), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*tokens(t), ("end",)]), 6)) for i, t in data))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    test = [r for r in got if r.held_out and r.n_known > 20]
    assert len(test) > 20 and sum(r.score for r in test) > sum(r.base_score for r in test)
    assert all(r.score <= 0 and np.isfinite(r.score) for r in got)


def test_probabilities_of_all_words_sum_to_one():
    rng = np.random.default_rng(0)
    weights = [rng.standard_normal(m.shape).astype(np.float32) for m in M.empty_weights()]
    vocabulary = [f"w{i}{'abc'[i % 3]}".encode() for i in range(900)]
    counts = {w: int(c) for w, c in zip(vocabulary, rng.integers(1, 50, len(vocabulary)))}
    classes = M.Classes.of(np.arange(M.ENDINGS) % M.CLASSES, sorted(counts.items(), key=lambda x: -x[1])[:700])
    sums = Counter()
    for w, c in counts.items():
        sums[M.ending(w), M.bucket_part(w), "n"] += c
        sums[M.ending(w), M.bucket_part(w), "v"] += 1
    totals = M.part_totals(classes, [(e, p, sums[e, p, "n"], sums[e, p, "v"]) for e, p, k in list(sums) if k == "n"], counts)
    hashes = np.array([M.word_hash(w) for w in vocabulary], np.uint64).view(np.int64)
    endings = np.array([M.ending(w) for w in vocabulary])
    of_word, part = classes(M.pa.array(vocabulary, M.pa.binary()), hashes, endings, np.array([M.bucket_part(w) for w in vocabulary]))
    assert len(set(zip(of_word[part < M.NAMED].tolist(), part[part < M.NAMED].tolist()))) == (part < M.NAMED).sum()
    codes = np.array([c for w in range(len(vocabulary)) for c in (7, 11, w)], np.int32)  # the same two words before each
    x, y, u, z = M.history(codes, np.full(len(vocabulary), 3), hashes, of_word, part)
    third = np.arange(len(vocabulary)) * 4 + 2
    p_class = np.exp(M.log_softmax(M.logits(weights[0], x[third], np.zeros(len(third), int))))
    p_part = np.exp(M.log_softmax(M.logits(weights[1], u[third], y[third])))
    rows = np.arange(len(third))
    own = p_class[rows, y[third]] * p_part[rows, z[third]]
    inside = np.array([1.0 if p < M.NAMED else (counts[w] + 1) / totals[c, p] for w, c, p in zip(vocabulary, of_word, part)])
    known = (own * inside).sum()
    # What no word has: the end, unseen words of each bucket part, and named parts without a word.
    rest = p_class[0, M.CLASSES]
    taken = set(zip(of_word.tolist(), part.tolist()))
    for c in range(M.CLASSES):
        first = np.flatnonzero(of_word == c)[0]
        for p in range(M.PARTS):
            rest += p_class[0, c] * p_part[first, p] * (1 / totals[c, p] if p >= M.NAMED else float((c, p) not in taken))
    assert abs(known + rest - 1) < 1e-5
    assert y[third + 1].tolist() == [M.CLASSES] * len(third) and (x[0] == x[4]).all() and (x[1] != x[2]).any()


def test_words_of_one_crc_stay_apart(spark):
    df = spark.createDataFrame([(i, "plumless plumless") for i in range(7) if zlib.crc32(str(i).encode()) % 7 != 2][:1] + [(1000 + i, "buckeroo") for i in range(100) if zlib.crc32(str(1000 + i).encode()) % 7 == 2][:1], "doc_id long, text string")
    got = {r.held_out: r for r in M.score(df, fold("doc_id", 7) == 2).collect()}
    assert got[True].n_known == 1 and got[True].train_tokens == 3 and abs(got[True].base_score - (math.log10(1 / 6) + math.log10(2 / 6))) < 1e-9
    assert got[False].n_known == 3


def test_scores_repeat(spark):
    df = spark.createDataFrame([*rows(), *rows()[:5]], "doc_id long, text string").repartition(4, "doc_id")
    key = lambda r: (str(r.doc_id), r.n_tokens, r.base_score, r.score)
    a, b = (sorted(map(key, M.score(df, fold("doc_id", 7) == 2).collect())) for _ in range(2))
    assert a == b


def test_common_words_of_one_hash(monkeypatch):
    monkeypatch.setattr(M, "word_hash", lambda w: 5 if w in (b"a", b"b") else 1 << 63)
    found = M.common_words(M.pa.table({"word": M.pa.array([b"b", b"a", b"c"], M.pa.binary()), "c": [1, 2, 3]}))
    assert found.to_pydict() == {"word": [b"c", b"a"], "c": [3, 2]}


def test_no_training_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in M.score(df, fold("doc_id", 1) == 0).collect()}
    assert got[1].base_score == 0 and got[1].n_known == 0 and got[2].n_tokens == 1 and got[1].train_tokens == 0
    assert M.score(df.limit(0), fold("doc_id", 7) == 2).count() == 0


def test_classes_follow_neighbours():
    rng = np.random.default_rng(1)
    counts = np.zeros((M.ENDINGS, M.ENDINGS))
    for lo, hi in ((0, 40), (40, 90), (90, 200)):
        counts[lo:hi, lo:hi] = rng.poisson(5, (hi - lo, hi - lo))
    classes = M.cluster(counts)
    assert all(not set(classes[:40]) & set(classes[40:90]) and not set(x) & set(y) for x, y in ((classes[:90], classes[90:200]),))


def test_rare_words_come_by_the_join(spark, monkeypatch):
    monkeypatch.setattr(M, "FREQUENT", 1)
    test_base_counts_match_brute_force_and_model_learns(spark)


def test_word_hash_has_64_bits():
    assert M.word_hash(b"hxcmqurip") != M.word_hash(b"oxexryexh")


def test_chunks_stay_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(M, "FREQUENT", 1)
    df = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)
    plan = M.score(df, fold("doc_id", 7) == 2)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("\n") if "Exchange hashpartitioning(chunk" in line]
    assert len(moved) <= 2 and "Bucketed: true" in plan, plan  # found, by chunk; the chunks' table is read by its buckets
    scan = plan[: plan.index("Bucketed: true")].split("\n")[-5:]
    assert not any("Exchange" in line for line in scan), scan


def test_plain_forms_equal_the_fast_ones():
    """Softmax of chosen places, in and out of the range that needs no shift; numbers of words in one go."""
    rng = np.random.default_rng(5)
    for size in (1.0, 30.0, 500.0):
        z = (rng.normal(size=(400, 17)) * size).astype(np.float32)
        y = rng.integers(0, 17, 400)
        plain = M.log_softmax(z.astype(float))
        assert np.allclose(M.chosen(z.copy(), y), plain[np.arange(400), y], rtol=1e-5, atol=1e-5)
        g, total = M.exps(z.copy())
        assert np.allclose(g / total[:, None], np.exp(plain), atol=1e-5)
    assert len(M.chosen(np.zeros((0, 17), np.float32), np.zeros(0, int))) == 0
    words = [b"", b"a", b"ab", b"abc", "été".encode(), *(b"w%d" % i for i in range(500))]
    hashes, endings, spare = M.word_numbers(words)
    assert hashes.view(np.uint64).tolist() == [M.word_hash(w) for w in words]
    assert endings.tolist() == [M.ending(w) for w in words] and spare.tolist() == [M.bucket_part(w) for w in words]
    assert [len(x) for x in M.word_numbers([])] == [0, 0, 0]
