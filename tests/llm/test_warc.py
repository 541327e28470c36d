import base64
import hashlib

import pytest

from seepage.llm import warc as W


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def walk(data: bytes):
    """The records of an archive, read one after the other."""
    at, out = 0, []
    while data[at:].startswith(W.MAGIC.encode()):
        found = W.parse_header(data[at + len(W.MAGIC) :])
        if not found:
            break
        fields, head = found
        body = at + len(W.MAGIC) + head
        n = int(fields["content-length"])
        out.append((at, fields["warc-record-id"], data[body : body + n]))
        at = body + n + 4
    return out


def pages():
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(i, f"<p>{i}</p>" * (i % 50) + ("é\n\r\n\r\n" if i % 7 else "")) for i in range(400)]
    rows += [(1000 + i, "same payload") for i in range(60)] + [(2000, None), (2001, ""), (2002, fake), (2003, "x" + fake * 40), (2004, "WARC/1.1\r\n" * 9), (2005, "WARC/1.1\r\n\r\n\r\n"), (2006, "y" * 300_000 + fake)]
    return rows


@pytest.mark.parametrize("split,most", [("20000b", 200_000), ("20000b", 0), ("128m", 200_000)])
def test_round_trip_through_splits(spark, tmp_path, monkeypatch, split, most):
    monkeypatch.setattr(W, "BROADCAST_SPLITS", most)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = pages()
        df = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "1 AS start", "'z' AS payload", "2 AS id").coalesce(2)
        W.write(df, f"{tmp_path}/a")
        got = {(r.file.split("/")[-1], r.start): bytes(r.payload) for r in W.read(spark, f"{tmp_path}/a").collect()}
        want = {}
        for f in (tmp_path / "a").glob("part-*"):
            want.update({(f.name, at): body for at, _, body in walk(f.read_bytes())})
        assert got == want and len(got) == len(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_query(spark, tmp_path):
    rows = [*pages(), (None, "no id"), (3, "again")]
    spark.createDataFrame([(i, f"http://a/{i} x\r\nWARC-Type: revisit" if i else None, h) for i, h in rows], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = W.op9_warc(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    first = {}
    for i, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = sorted(((i, len((h or "").encode()), digest((h or "").encode()), "response" if i is None or first[h or ""] == i else "revisit", None if i is None or first[h or ""] == i else first[h or ""]) for i, h in rows), key=str)
    assert sorted(map(tuple, got), key=str) == want


def test_least_bytes_broken_chain_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "abcdef"), (4, "abcdef")], "page_id long, html string")
    plan = {r.id: r.refers_to for r in W.plan_records(df, "page_id", "html", 3).collect()}
    assert plan == {1: None, 2: None, 3: None, 4: 3}
    good = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "part-0").write_bytes((good + "junk" + good).encode())
    (tmp_path / "b" / "part-1").write_bytes(("junk" + good).encode())
    assert [(r.start, bytes(r.payload)) for r in W.read(spark, f"{tmp_path}/b").collect()] == [(0, b"hi")]
    W.write(df.limit(0), f"{tmp_path}/c")
    assert W.read(spark, f"{tmp_path}/c").count() == 0


def test_long_and_folded_headers(spark, tmp_path):
    long = "X-Note: " + "n" * 200_000 + "\r\n"
    one = lambda i, more: f"WARC/1.1\r\nWARC-Type: response\r\n{more}WARC-Record-ID: <urn:page:{i}>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "part-0").write_bytes((one(1, long) + one(2, "X-Folded: a\r\n b\r\n\tc\r\n") + one(3, "")).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000b")
    try:
        got = W.read(spark, f"{tmp_path}/d").orderBy("start").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.fields["warc-record-id"] for r in got] == [f"<urn:page:{i}>" for i in (1, 2, 3)]
    assert got[1].fields["x-folded"] == "a b c" and len(got[0].fields["x-note"]) == 200_000


def test_mandatory_fields(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a", "x"), (2, None, "x"), (3, " ", "z")], "page_id long, url string, html string")
    W.write(df, f"{tmp_path}/e", uri_col="url", date="2024-01-31T00:00:00Z")
    fields = {r.fields["warc-record-id"]: r.fields for r in W.read(spark, f"{tmp_path}/e").collect()}
    assert all({"warc-type", "warc-record-id", "warc-date", "content-length"} <= set(f) for f in fields.values())
    assert fields["<urn:page:1>"]["warc-target-uri"] == "http://a" and "warc-target-uri" not in fields["<urn:page:3>"]


def test_only_repeated_payloads_are_moved(spark, tmp_path, monkeypatch):
    """Payloads that occur once reach no shuffle; numbers that digests share by chance do no harm."""
    rows = [(i, f"<p>{i}</p>" if i % 50 else "<p>copy</p>") for i in range(300)] + [(None, "<p>copy</p>"), (0, "<p>copy</p>"), (900, None), (901, "")]
    df = spark.createDataFrame(rows, "page_id long, html string")
    for numbers in (1 << 20, 3):
        monkeypatch.setattr(W, "NUMBERS", numbers)
        found = W.plan_records(df, "page_id", "html")
        got = sorted(((r.id, r.payload, r.refers_to) for r in found.collect()), key=str)
        first = {}
        for i, h in rows:
            first[h or ""] = min(x for x, y in rows if (y or "") == (h or "") and x is not None)
        assert got == sorted(((i, h or "", first[h or ""] if i != first[h or ""] else None) for i, h in rows), key=str)
    monkeypatch.setattr(W, "NUMBERS", 1 << 20)
    df.write.parquet(str(tmp_path / "pages"))
    found = W.plan_records(spark.read.parquet(str(tmp_path / "pages")), "page_id", "html")
    found.write.format("noop").mode("overwrite").save()
    plan = found._jdf.queryExecution().executedPlan().toString()
    alone = plan.split("SortMergeJoin")[0]
    assert "LeftAnti" in alone and alone.count("Exchange hashpartitioning(") == alone.count("Exchange hashpartitioning(number")
