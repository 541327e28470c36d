import base64
import random

import public_tokenizers as P
import tiktoken

import corpus_pipeline as C
from seepage.llm import decontaminate, minhash, quality, toxicity


def tables(spark, path):
    rng = random.Random(2)
    words = ["".join(rng.choices("abdeilmnorst", k=rng.randint(2, 7))) for _ in range(800)]
    docs, labels = [], []
    items = [(k, " ".join(rng.choices(words, k=30))) for k in range(10)]
    for i in range(900):
        ws = rng.choices(words, k=rng.randint(20, 80))
        toxic, good = i % 9 == 0, i % 5 != 0
        if toxic:
            ws[3] = rng.choice(["idiot", "moron"])
        if not good:
            ws = [w + "%%%" for w in ws]
        if i % 20 == 1:
            ws[5:5] = items[i % 10][1].split()
        if i % 30 == 2:
            ws = docs[-1][1].split() + ["extra"] if docs else ws
            toxic, good = labels[-1][2], labels[-1][1]
        docs.append((i, " ".join(ws), "en", "s", 1))
        labels.append((i, int(good), int(toxic)))
    docs += [(2000, None, "en", "s", 0), (2001, "", None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs, labels, items


def test_matches_brute_force(spark, tmp_path):
    """The same decisions, one text at a time in plain Python, from models fitted on the same rows."""
    path = str(tmp_path)
    docs, labels, items = tables(spark, path)
    assert [n for n, _ in C.STAGES] == ["toxicity", "quality", "minhash", "decontamination", "bpe"]
    df, ls = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    rows = [(d[0], d[1]) for d in docs]
    harsh = toxicity.scorer(toxicity.fit(df, ls))
    rows = [(i, t) for i, t in rows if harsh([t])[0] < 0.5]
    kept = spark.createDataFrame(rows, "doc_id long, text string")
    tail = quality._graded(quality.fit(kept, ls), None)
    rows = [(i, t) for i, t in rows if tail([t])[1][0] >= 0.5]
    groups: list[list] = []
    for i, t in rows:
        near = [g for g in groups if t is not None and any(u == t or u and t and minhash.lcs_at_least(minhash.words_of(t), minhash.words_of(u)) for _, u in g)]
        groups = [g for g in groups if g not in near] + [[x for g in near for x in g] + [(i, t)]]
    rows = [min(g) for g in groups]
    leaks = decontaminate.matcher(decontaminate.Index(items))
    rows = [(i, t) for i, t in rows if not leaks([t])[0]]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: list(r.ids) for r in C.run(spark, path).collect()}
    assert got == {i: library.encode_ordinary(t or "") for i, t in rows}
    clean = {i for i, q, t in labels if q and not t and i % 20 != 1 and i % 30 != 2}
    assert len(clean - set(got)) <= 0.03 * len(clean)
    assert not any(t for i, q, t in labels if i in got)


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    path = str(tmp_path)
    tables(spark, path)
    df = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, df, path)
        assert out.columns == df.columns and out.count() == 0
    assert C.STAGES[-1][1](spark, df, path).count() == 0
