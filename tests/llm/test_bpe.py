import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from seepage.llm import bpe

VOCABULARY = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    alphabet = list("abcde  \n\t'stAZ09é  　\x1c\x85ß漢字🙂́-_.,!?") + ["the ", " ing", "'re", "\r\n", "aaaa", "  "]
    return ["", " ", "a" * 5000, "ab" * 3000, "hello world", "it's we'll they've  x", *("".join(rng.choices(alphabet, k=rng.randint(1, 200))) for _ in range(400))]


def test_matches_the_library(spark, library):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "same"), (7, None), (7, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS id", "'x' AS n_tokens")
    got = bpe.decode(bpe.encode(df, VOCABULARY, P.PATTERN), VOCABULARY).collect()
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append((library.encode_ordinary(t or ""), (t or "").encode()))
    assert len(got) == len(rows)
    for r in got:
        assert (list(r.ids), bytes(r.decoded)) in want[r.doc_id]


def test_words_whose_merges_are_out_of_rank_order():
    ranks = {bytes([b]): b for b in range(256)} | {b"aba": 300, b"ab": 305, b"abab": 310, b"bc": 301, b"abc": 302}
    replay = bpe.MergeReplay(ranks)
    words = [b"abab", b"abc", b"aabcab", b"ababab", b"", b"zz"]
    want = [[ranks[w]] if w in ranks else bpe.encode_one(w, ranks) for w in words]
    counts, ids = replay.encode(words)
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_round_trip_equals_encode_and_decode(spark, library):
    rng = random.Random(8)
    long = "".join(rng.choices("abcdefghij0123456789", k=1_200_000))  # megabytes without white space are few pieces or many
    rows = [(i, t) for i, t in enumerate(texts())] + [(5000, long), (5001, "x " * 700_000), (None, None), (7, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS n_tokens")
    got = bpe.round_trip(df, VOCABULARY, P.PATTERN, keep_ids=True).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()
        want.setdefault(i, []).append((ids, len(ids), *digest))
    for r in got:
        assert (list(r.ids), r.n_tokens, r.ids_sha256, r.decoded_sha256) in want[r.doc_id]


def test_small_memos_change_nothing(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_PIECES", 5)
    monkeypatch.setattr(bpe, "RUN_BYTES", 50)
    encode = bpe._encoder(P.PATTERN, bpe.read_ranks(spark, VOCABULARY))
    own = texts()
    got = [ids[a : a + n].tolist() for _, sizes, ids in encode(bpe.pa.array(own)) for n, a in zip(sizes, [0, *bpe.np.cumsum(sizes)[:-1].tolist()])]
    assert got == [library.encode_ordinary(t) for t in own]


def test_digests_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "hello"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.round_trip(df, VOCABULARY, P.PATTERN).collect()}
    assert got[2].n_tokens == 0 and got[2].ids_sha256 == got[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[1].decoded_sha256 == hashlib.sha256(b"hello").hexdigest() and len(got[1]) == 4
    assert bpe.encode(df.limit(0), VOCABULARY, P.PATTERN).count() == bpe.round_trip(df.limit(0), VOCABULARY, P.PATTERN).count() == 0
