import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from seepage.llm import mixing as M


def fill(sizes: list[int], weights: list[float], total: float) -> list[float]:
    """Targets by resharing, round by round."""
    out, stopped = [0.0] * len(sizes), set()
    while True:
        rest = total - sum(2 * sizes[i] for i in stopped)
        share = sum(weights[i] for i in range(len(sizes)) if i not in stopped)
        for i in range(len(sizes)):
            out[i] = 2.0 * sizes[i] if i in stopped else rest * weights[i] / share
        new = {i for i in range(len(sizes)) if i not in stopped and out[i] > 2 * sizes[i]}
        if not new:
            return out
        stopped |= new


def brute(rows):
    """rows (doc_id, text, source) -> sorted (doc_id, size, source_size, target, taken), by plain loops."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows if s is not None}, key=lambda s: [ord(c) for c in s]) + ([None] if any(s is None for _, _, s in rows) else [])
    words = [sum(n for n, r in zip(size, rows) if r[2] == s) for s in names]
    target = fill(words, [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))], 1.5 * sum(words)) if rows else []
    out = []
    for s, whole, t in zip(names, words, target):
        mine = [i for i, r in enumerate(rows) if r[2] == s]
        lam = t / whole if whole else 0.0
        copies = dict.fromkeys(mine, int(lam))
        p = lam - int(lam)
        room = t - sum(copies[i] * size[i] for i in mine)
        ranked = []
        for i in mine:
            if p > 0 and size[i]:
                text = hashlib.md5((rows[i][1] or "").encode()).hexdigest()
                u = (int(hashlib.md5(f"{'null' if rows[i][0] is None else rows[i][0]}:0:{text}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                q = u / (1 - u) * ((1 - p) / p)
                ranked.append((int(q / (1 + q) * 2**52), i))
        ranked.sort()
        for _ in range(2):
            room_now, stop = room, False
            for rank, i in list(ranked):
                if size[i] > room_now or stop:
                    continue
                if size[i] > room:
                    stop = True
                else:
                    copies[i] += 1
                    room -= size[i]
                    ranked.remove((rank, i))
        best = min(((abs(room - size[i]), rank, i) for rank, i in ranked if abs(room - size[i]) < room), default=None)
        if best:
            copies[best[2]] += 1
        out += [(rows[i][0], size[i], whole, t, copies[i] * size[i]) for i in mine]
    return out


def key(row):
    return tuple((v is None, 0 if v is None else v) for v in row)


def same(found, want):
    found, want = sorted(map(tuple, found), key=key), sorted(want, key=key)
    assert [r[:3] + r[4:] for r in found] == [r[:3] + r[4:] for r in want]
    assert [r[3] for r in found] == pytest.approx([r[3] for r in want], rel=1e-12)


def mixed(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS sid", "2 AS rank", "3 AS size", "4 AS room", "5 AS target")
    return M.mix(df, **more)


COLUMNS = ["doc_id", "size", "source_size", "target", "taken"]


def test_matches_brute_force(spark):
    rng = random.Random(3)
    text = lambda n: " ".join("w%d" % rng.randrange(50) for _ in range(n))
    rows = [(i, text(int(rng.paretovariate(0.9) * 8)), rng.choice(["a", "b", "é", "Z", "", "\U0001f600", "ﬁ"])) for i in range(600)]
    rows += [(1000 + i, text(rng.randrange(1, 40)), "hot") for i in range(400)]
    rows += [(None, "one two", None), (None, "three", None), (7, None, None), (8, "", "a"), (9, " \t\n", "b"), (10, "x y\x0bz", None), (11, text(30_000), "a"), (12, "only", "single")]
    found = mixed(spark, rows)
    same(found.select(COLUMNS).collect(), brute(rows))


def test_words_come_near_targets(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(1.1) * 20)), "s%d" % (i % 7 if i % 3 else 0)) for i in range(3000)]
    out = mixed(spark, rows).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    assert all(abs(r.taken - r.target) <= max(3, 0.001 * r.target) and r.over <= 0 for r in out)
    assert sum(r.target for r in out) == pytest.approx(1.5 * sum(r.source_size for r in out))


def test_repeated_rows_and_reruns(spark):
    rows = [(1, "a b c", "s")] * 500 + [(2, "d e", "t")] * 300 + [(3, "f", "u")] * 100
    first = mixed(spark, rows).select(COLUMNS).collect()
    again = M.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(7)).select(COLUMNS).collect()
    assert sorted(first) == sorted(again)
    for source_size, target in {(r.source_size, r.target) for r in first}:
        taken = sum(r.taken for r in first if r.source_size == source_size)
        assert abs(taken - target) <= 1.5


def test_preferences_set_the_odds(spark):
    """Of equal sizes, the share that is taken follows the preference, over seeds; none is taken more than twice."""
    rows = [(i, "a b c d", "s") for i in range(300)] + [(1000 + i, "a b c d", "t") for i in range(600)]
    prefer = F.when(F.col("doc_id") % 3 == 0, 3.0).when(F.col("doc_id") % 3 == 1, 1.0).otherwise(0.0)
    copies = {0: 0, 1: 0, 2: 0}
    for seed in range(3):
        out = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=0.5, weights=(1.0, 2.0), prefer=prefer, seed=seed).collect()
        assert abs(sum(r.taken for r in out) - 0.5 * 3600) <= 4 and max(r.copies for r in out) <= 2
        for r in out:
            copies[r.doc_id % 3] += r.copies
    assert copies[2] == 0 and copies[0] / copies[1] == pytest.approx(3.0, rel=0.25)


def test_preferences_fill_up(spark):
    rows = [(i, "a b", "s") for i in range(40)]
    prefer = F.when(F.col("doc_id") < 4, 1000.0)
    out = {r.doc_id: r.copies for r in M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=1.0, prefer=prefer).collect()}
    assert all(out[i] == 2 for i in range(4)) and sum(out.values()) == 40


def test_empty_and_wordless(spark):
    assert mixed(spark, []).collect() == []
    out = mixed(spark, [(1, None, "a"), (2, "", None)]).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in out] == [(0, 0, 0.0, 0)] * 2


def test_plan_has_no_python(spark):
    plan = mixed(spark, [(1, "a b", "s")])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
