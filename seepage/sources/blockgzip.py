"""Lines of block gzip files, read by many tasks.

Block gzip is a chain of gzip members of at most 64 KiB, each of which names its own size in its header. A task takes a range of the file's bytes, finds
the first member that starts there and reads to the range's end; the line that is cut there belongs to the task that has its beginning. Any other gzip
file names no sizes, and stays with Spark's own reader, one task a file."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from seepage.sources.files import listed, opened, qualified

#: Fixed values of the format: a member's first bytes, its size field's name, its largest size.
MAGIC, SIZE_FIELD, MEMBER = b"\x1f\x8b\x08\x04", b"BC", 65_536
SPLIT_BYTES = 64 << 20
CHUNK = 1 << 20
BATCH_BYTES = 4 << 20


def member_size(head: bytes) -> int | None:
    """The size that a member's header names, or None if it names none."""
    if len(head) < 18 or head[:4] != MAGIC:
        return None
    at, end = 12, 12 + int.from_bytes(head[10:12], "little")
    while at + 4 <= min(end, len(head)):
        n = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == SIZE_FIELD and n == 2:
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + n
    return None


def first_member(f, start: int, end: int, size: int) -> int | None:
    """Where the first member of [start, end) begins. A candidate counts if it unpacks to its own checksum and the next one follows, or the file's end."""
    if start >= size:
        return None
    buf = f.read_at(3 * MEMBER, start)
    at = buf.find(MAGIC)
    while 0 <= at < min(end - start, MEMBER):
        n = member_size(buf[at : at + MEMBER])
        if n and at + n <= len(buf) and (start + at + n == size or member_size(buf[at + n :])):
            try:
                zlib.decompress(buf[at : at + n], 31)
                return start + at
            except zlib.error:
                pass
        at = buf.find(MAGIC, at + 1)
    if end - start >= MEMBER and size - start > MEMBER:
        raise ValueError("no block gzip: a range of 64 KiB holds no member's beginning")
    return None


def members(f, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(place, unpacked bytes) of the members from one on."""
    buf, base = b"", at
    while at < size:
        if base + len(buf) - at < MEMBER and base + len(buf) < size:
            buf, base = buf[at - base :] + f.read_at(CHUNK, base + len(buf)), at
        n = member_size(buf[at - base : at - base + MEMBER])
        if not n or at - base + n > len(buf):
            raise ValueError(f"no block gzip member at byte {at}")
        yield at, zlib.decompress(buf[at - base : at - base + n], 31)
        at += n


def lines(f, start: int, end: int, size: int) -> Iterator[bytes]:
    """The lines that belong to the range: those that begin after its first line end, up to the one that passes its end."""
    first = first_member(f, start, end, size) if start else 0
    if first is None:
        return
    held, skipping = bytearray(), start > 0
    for place, data in members(f, first, size):
        if place >= end:
            if skipping:
                return
            head, found, _ = data.partition(b"\n")
            held += head
            if found:
                yield bytes(held)
                return
            continue
        if skipping:
            _, found, data = data.partition(b"\n")
            if not found:
                continue
            skipping = False
        head, found, rest = data.partition(b"\n")
        held += head
        if found:
            yield bytes(held)
            *whole, tail = rest.split(b"\n")
            yield from whole
            held = bytearray(tail)
    if held:
        yield bytes(held)


class _Range(InputPartition):
    def __init__(self, uri: str, start: int, end: int, size: int):
        super().__init__((uri, start, end, size))


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.step = options["path"], int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self):
        return [_Range(uri, start, min(start + self.step, size), size) for uri, size in listed(self.path, ".gz") for start in range(0, size, self.step)]

    def read(self, partition):
        uri, start, end, size = partition.value
        system, path = opened(uri)
        batch, held, done = [], 0, 0

        def flush():
            n = len(batch)
            rows = [pa.array(batch, pa.string()), pa.array([uri] * n, pa.string()), pa.array([start] * n, pa.int64()), pa.array(range(done, done + n), pa.int64())]
            return pa.RecordBatch.from_arrays(rows, names=["value", "file", "block", "row"])

        with system.open_input_file(path) as f:
            for line in lines(f, start, end, size):
                batch.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                held += len(line)
                if held > BATCH_BYTES or len(batch) >= 50_000:
                    yield flush()
                    done += len(batch)
                    batch, held = [], 0
        if batch:
            yield flush()


class BlockGzipLines(DataSource):
    @classmethod
    def name(cls):
        return "block_gzip_lines"

    def schema(self):
        return "value string, file string, block long, row long"

    def reader(self, schema):
        return _Reader(self.options)


def is_block_gzip(spark: SparkSession, path: str) -> bool:
    """Whether path is a block gzip file, or a folder of nothing else; False for patterns and for file systems that Arrow can't open."""
    try:
        found = listed(qualified(spark, path))
        for uri, _ in found:
            system, at = opened(uri)
            with system.open_input_file(at) as f:
                if not uri.endswith(".gz") or not member_size(f.read_at(MEMBER, 0)):
                    return False
        return bool(found)
    except (OSError, pa.ArrowException):
        return False


def read_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """O-03, O-21: (value, file, block, row) of every line; (file, block, row) is a line's place."""
    spark.dataSource.register(BlockGzipLines)
    return spark.read.format("block_gzip_lines").option("splitBytes", split_bytes).load(qualified(spark, path))
