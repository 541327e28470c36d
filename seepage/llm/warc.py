"""WARC archives: written from rows, read back by boundary-chain verification.

Writing: records are lines of Spark's text writer whose line separator is the empty line that ends a
record, so archives are plain files of any store Spark writes to. Records have the mandatory fields (type, id, date, length), and
the target URI where a column has it. Of records with equal
payloads of at least min_bytes, that of the smallest id is a response and the others revisit it.

Reading: tasks cut the archives at every place that looks like the start of a record and emit, for each
that has a readable header, the offset of the record that should follow. Pointer jumping from offset 0
of each file (hops from split to split double with every step, and each step is written to the shared
folder) keeps the records that the chain really visits; look-alikes inside payloads are never reached and
are joined to the record that holds them. A chain that breaks ends the file there: what it cannot reach is not a record.
Headers may be of any length and their fields folded over lines; of a repeated field the last counts.

Null payloads are empty. Rows with equal ids stay apart: those that repeat the smallest id of a group are
all responses; a null id sorts last and writes no refers-to target. Extra columns are not archived.
"""

from __future__ import annotations

import re
from datetime import UTC, datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seepage.llm.common import bound_batches, frugal, materialize, table
from seepage.storage import new_path

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: Records of an archive file, at most.
FILE_RECORDS = 4_000
#: Splits whose entries go to every task; more are joined.
BROADCAST_SPLITS = 200_000
#: Numbers that digests are hashed to; those of repeated payloads go to every task.
NUMBERS = 1 << 20
_FIELD = re.compile(r"^([!-9;-~]+):[ \t]*(.*)$")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of a SHA-1: each 5 hex digits are 4 characters."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _ALPHABET)


def plan_records(rows: DataFrame, id_col: str, payload_col: str, min_bytes: int = 0, uri_col: str | None = None) -> DataFrame:
    """rows -> (id, uri, payload, bytes, digest, refers_to): which records revisit which response."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    uri = F.col(uri_col) if uri_col else F.lit(None)
    full = rows.select(F.col(id_col).cast("long").alias("id"), uri.cast("string").alias("uri"), payload.alias("payload"))
    full = full.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": base32_sha1(F.col("payload").cast("binary"))})
    first = full.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    repeated = materialize(first.where("n > 1").select("digest", "bytes", "first"), "warc-repeated")
    # Payloads that are surely alone stay where they are; only those that share a number with a repeated one move to the join.
    number = F.pmod(F.xxhash64("digest"), F.lit(NUMBERS)).alias("number")
    numbered, shared = full.withColumn("number", number), F.broadcast(repeated.select(number).distinct())
    alone = numbered.join(shared, "number", "left_anti").withColumn("refers_to", F.lit(None).cast("long"))
    joined = numbered.join(shared, "number", "left_semi").join(repeated.hint("merge"), ["digest", "bytes"], "left")
    joined = joined.withColumn("refers_to", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")))
    columns = ["id", "uri", "payload", "bytes", "digest", "refers_to"]
    return alone.select(columns).unionByName(joined.select(columns))


def record_text(date: str, r: str = "response") -> Column:
    """A record, without the empty line that ends it."""
    revisit = F.col("refers_to").isNotNull()
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit(r))),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("none")), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.when(F.trim("uri") != "", F.trim("uri")), r"\s+", "%20")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), F.when(revisit, F.lit("")).otherwise(F.col("payload")))


def write(rows: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = 0, uri_col: str | None = None, date: str | None = None) -> None:
    """Archive files of at most FILE_RECORDS records in the folder path; date: that of all records, as in 2024-01-31T00:00:00Z, now if not given."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    records = plan_records(rows, id_col, payload_col, min_bytes, uri_col).select(record_text(date).alias("value"))
    records.write.option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse_header(text: bytes) -> tuple[dict[str, str], int] | None:
    """(fields in lower case, bytes of the header with its empty line) of what follows MAGIC; None if unreadable."""
    end = text.find(END.encode())
    if end < 0:
        return None
    fields: dict[str, str] = {}
    name = None
    for line in text[:end].decode("utf-8", "replace").split("\r\n"):
        if name and line[:1] in (" ", "\t"):  # the field before goes on
            fields[name] = f"{fields[name]} {line.strip()}".strip()
            continue
        m = _FIELD.match(line)
        if not m:
            return None
        name = m[1].lower()
        fields[name] = m[2].strip()
    if not re.fullmatch(r"[0-9]{1,18}", fields.get("content-length", "")) or "warc-type" not in fields:
        return None
    return fields, end + len(END)


PLACE = "file string, split long, at long, size long, head long, length long"


def _scan(batches):
    """Cuts of a task's splits with their offsets from the first cut of their split, without their text."""
    now, at = None, 0
    for batch in batches:
        rows = []
        for file, split, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (file, split) != now:
                now, at = (file, split), 0
            found = parse_header(text)
            rows.append((file, split, at, len(text), found[1] if found else None, int(found[0]["content-length"]) if found else None))
            at += len(text) + len(MAGIC)
        kinds = [pa.string(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file", "split", "at", "size", "head", "length"])


RECORD = "file string, start long, next long, fields map<string,string>, head long, length long, text binary, whole boolean"


def _records(batches):
    """Records of a task's splits, from where the chain enters each. What begins or ends in another split goes out in parts."""
    magic = MAGIC.encode()
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
    names = ["file", "start", "next", "fields", "head", "length", "text", "whole"]
    now, at, want, record = None, 0, None, None
    out: list[tuple] = []

    def close():
        """The open record, whole or not."""
        nonlocal record
        if record:
            start, nxt, fields, head, length, parts = record
            text = magic.join(parts)
            whole = len(text) >= head + length
            out.append((now[0], start, nxt, list(fields.items()), head, length, text[head : head + length] if whole else text, whole))
            record = None

    for batch in batches:
        for file, split, text, base, entry in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if (file, split) != now:
                close()
                now, at, want = (file, split), 0, entry
            start = base + at - len(magic)
            if record and start >= record[1]:
                close()
            if record:
                record[5].append(text)
            elif start == want:
                fields, head = parse_header(text)
                length = int(fields["content-length"])
                want = start + len(magic) + head + length + len(END)
                record = (start, want, fields, head, length, [text])
            elif entry is None or start < entry:  # it ends a record of an earlier split, or is none
                out.append((file, start, None, None, None, None, text, False))
            at += len(text) + len(magic)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
        out.clear()
    close()
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)


def _exits(g: pd.DataFrame) -> pd.DataFrame:
    """For each candidate of a split, where its chain leaves the split."""
    g = g.sort_values("start", ascending=False)
    out: dict[int, int] = {}
    for start, nxt in zip(g["start"].tolist(), g["next"].tolist()):
        out[start] = out.get(nxt, nxt)
    return pd.DataFrame({"file": g["file"], "start": list(out), "next": list(out.values())})


def entries(candidates: DataFrame) -> DataFrame:
    """candidates (file, split, start, next) -> (file, split, entry): where the chain from each file's offset 0 enters each split.

    Chains are first cut to one hop a split; then reached entries and hops double until nothing new is reached."""
    hops = materialize(candidates.groupBy("file", "split").applyInPandas(_exits, "file string, start long, next long"), "warc-hops")
    reached = materialize(hops.where("start = 0").select("file", "start"), "warc-reached")
    n, jump = reached.count(), hops
    while True:
        new = reached.join(jump, ["file", "start"]).select("file", F.col("next").alias("start")).join(hops.select("file", "start"), ["file", "start"], "left_semi")
        reached = materialize(reached.union(new).distinct(), "warc-reached")
        last, n = n, reached.count()
        if n == last:
            break
        far = jump.select("file", F.col("start").alias("from"), F.col("next").alias("start")).join(jump, ["file", "start"])
        jump = materialize(far.select("file", F.col("from").alias("start"), "next"), "warc-jumps")
    return candidates.select("file", "split", "start").join(reached, ["file", "start"]).groupBy("file", "split").agg(F.min("start").alias("entry"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Archives in a folder -> (file, start, fields, payload binary), a row for each record that the chains reach.

    The archives are scanned for offsets, for records inside splits and for parts of records that span splits; only those parts move. The table
    of entries has a row for each split; up to BROADCAST_SPLITS it goes to every task, beyond that it is joined."""
    bound_batches(spark)
    cuts = spark.read.option("lineSep", MAGIC).text(path)
    cuts = cuts.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("text"))
    places = materialize(cuts.mapInArrow(frugal(_scan), PLACE), "warc-places")
    total = places.groupBy("file", "split").agg(F.sum(F.col("size") + len(MAGIC)).alias("total"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(total.select("file", "split", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "warc-splits")
    start = F.col("base") + F.col("at") - len(MAGIC)
    found = places.where("head is not null").join(bases, ["file", "split"])
    found = found.select("file", "split", start.alias("start"), (start + len(MAGIC) + F.col("head") + F.col("length") + len(END)).alias("next")).where("start >= 0")
    splits = materialize(bases.join(entries(materialize(found, "warc-candidates")), ["file", "split"], "left"), "warc-entries")
    if splits.count() <= BROADCAST_SPLITS:
        entered = cuts.join(F.broadcast(splits), ["file", "split"])
    else:
        order = cuts.withColumn("row", F.monotonically_increasing_id()).join(splits, ["file", "split"])
        entered = order.repartition("file", "split").sortWithinPartitions("file", "split", "row")
    rows = entered.select("file", "split", "text", "base", "entry").mapInArrow(frugal(_records), RECORD)
    whole = rows.where("whole").select("file", "start", "fields", F.col("text").alias("payload"))
    so_far = Window.partitionBy("file").orderBy("start")
    parts = rows.where("not whole").withColumn("mine", F.when(F.col("next").isNotNull(), F.struct("start", "next")))
    parts = parts.withColumn("owner", F.last("mine", ignorenulls=True).over(so_far)).where("owner is not null and start < owner.next")
    # The parts of one record: as long as that record.
    joined = parts.groupBy("file", F.col("owner.start").alias("begin")).agg(
        F.sort_array(F.collect_list(F.struct("start", F.col("text").cast("string").alias("text")))).alias("parts"),
        F.min_by(F.struct("head", "length", "fields"), "start").alias("own"),
    )
    text = F.array_join(F.transform("parts", lambda p: p["text"]), MAGIC).cast("binary")
    spanning = joined.select("file", F.col("begin").alias("start"), "own.fields", "own.head", "own.length", text.alias("text"))
    return whole.union(spanning.select("file", "start", "fields", F.expr("substring(text, int(head + 1), int(length))").alias("payload")))


def page_of(field: str) -> Column:
    return F.regexp_extract(F.col("fields")[field], r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path, uri_col="url")
    records = read(spark, path).select(
        page_of("warc-record-id").alias("page_id"),
        F.col("fields")["warc-type"].alias("record_type"),
        page_of("warc-refers-to").alias("refers_to"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
    )
    records = materialize(records, "warc-records")
    own = records.where("record_type = 'response'")
    targets = own.where("page_id is not null").groupBy(F.col("page_id").alias("refers_to")).agg(F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"))
    others = records.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(targets, "refers_to")
    return own.unionByName(others).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') h FROM pages),
q AS (SELECT page_id, h, sha1(h) x, min(page_id) OVER (PARTITION BY h) first FROM p),
d AS (SELECT *, list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(x, 1 + 5 * CAST(i // 4 AS INTEGER), 5) AS BIGINT) >> (15 - 5 * CAST(i % 4 AS INTEGER))) & 31) AS INTEGER), 1)) b FROM q)
SELECT page_id, CAST(strlen(h) AS BIGINT) payload_bytes, array_to_string(b, '') payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END record_type,
  CASE WHEN page_id <> first THEN first END refers_to
FROM d
"""
