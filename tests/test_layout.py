import gzip
import random
import struct
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from seepage.schema import SpatialDataset
from seepage.sources import blockgzip, gem, layout

HEADER = "geneID\tx\ty\tMIDCounts\tcell\n"


def blocks(data, step):
    """Block gzip, step bytes a member, with the empty member at its end."""
    out = []
    for at in [*range(0, len(data), step), None]:
        part = b"" if at is None else data[at : at + step]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out.append(b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff" + struct.pack("<HccHH", 6, b"B", b"C", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def some_lines(n):
    rng = random.Random(5)
    return [f"g{rng.randint(0, 9)}\t{rng.randint(0, 50)}\t{rng.randint(0, 50)}\t{rng.randint(1, 5)}\t{rng.randint(0, 3)}" for _ in range(n)]


@pytest.mark.parametrize("step, split, end", [(700, 2_000, "\n"), (700, 997, ""), (60, 150, "\n"), (5, 64, "\n"), (65_000, 70_000, "")])
def test_block_gzip_lines_are_whole_and_in_order(spark, tmp_path, step, split, end):
    rows = some_lines(300 if step < 100 else 3000)
    text = HEADER + "\n".join(rows) + end
    path = tmp_path / "a.gem.gz"
    path.write_bytes(blocks(text.encode(), step))
    read = blockgzip.read_lines(spark, str(path), split)
    got = [r.value for r in read.orderBy("file", "block", "row").collect()]
    assert got == [HEADER.strip(), *rows]
    if split < 3_000:
        assert read.rdd.getNumPartitions() > 1 and read.select("block").distinct().count() > 1


def test_long_lines_pass_over_ranges(spark, tmp_path):
    rng = random.Random(6)
    wanted = ["".join(rng.choices("abcdefgh", k=n)) for n in (3, 40_000, 1, 90_000, 5)]
    (tmp_path / "l.gz").write_bytes(blocks("\n".join(wanted).encode(), 900))
    read = blockgzip.read_lines(spark, str(tmp_path / "l.gz"), 1_500)
    assert [r.value for r in read.orderBy("block", "row").collect()] == wanted and read.rdd.getNumPartitions() > 10


def test_block_gzip_loads_as_plain_text_does(spark, tmp_path):
    text = HEADER + "\n".join(some_lines(2000)) + "\n"
    (tmp_path / "a.gem").write_text(text)
    (tmp_path / "b.gem.gz").write_bytes(blocks(text.encode(), 1000))
    (tmp_path / "c.gem.gz").write_bytes(gzip.compress(text.encode()))
    assert blockgzip.is_block_gzip(spark, str(tmp_path / "b.gem.gz")) and not blockgzip.is_block_gzip(spark, str(tmp_path / "c.gem.gz"))
    assert not blockgzip.is_block_gzip(spark, str(tmp_path / "none")) and not blockgzip.is_block_gzip(spark, str(tmp_path))
    plain, split, one = (gem.load_gem(spark, str(tmp_path / n)) for n in ("a.gem", "b.gem.gz", "c.gem.gz"))
    for t in ("spots", "counts", "genes"):
        want = sorted(map(tuple, getattr(plain, t).collect()))
        assert sorted(map(tuple, getattr(split, t).collect())) == want == sorted(map(tuple, getattr(one, t).collect()))


def test_broken_members_raise(spark, tmp_path):
    data = blocks(("x\n" * 5000).encode(), 1000)
    (tmp_path / "t.gz").write_bytes(data[:-40])
    with pytest.raises(Exception, match="member"):
        blockgzip.read_lines(spark, str(tmp_path / "t.gz")).count()


def test_window_with_sorted_ids(spark, tmp_path):
    (tmp_path / "g").write_text("geneID\tx\ty\tMIDCounts\nB\t3\t1\t2\nA\t1\t2\t1\nA\t1\t1\t4\nB\t1\t1\t1\nA\t1\t1\t1\nC\t9\t9\t1\n")
    (tmp_path / "s").write_text("x,y,geneID,MIDCounts,cell\n1,1,A,1,70\n3,1,B,1,8\n9,9,C,1,5\n2,2,C,1,90\n1,2,A,1,0\n")
    d = gem.load_window(spark, str(tmp_path / "g"), str(tmp_path / "s"), (0, 3), (1, 2))
    assert [tuple(r) for r in d.spots.orderBy("spot_id").collect()] == [(0, 1, 1, 70), (1, 1, 2, -1), (2, 3, 1, 8)]
    assert [r.gene_name for r in d.genes.orderBy("gene_id").collect()] == ["A", "B"]
    assert sorted(map(tuple, d.counts.collect())) == [(0, 0, 5), (0, 1, 1), (1, 0, 1), (1, 2, 2)]
    assert [r.cell_id for r in d.cells.orderBy("cell_id").collect()] == [8, 70, 90]


def groups_read(folder, x, y):
    """(row groups whose statistics meet the window, all)."""
    met = every = 0
    for p in folder.glob("*.parquet"):
        meta = pq.ParquetFile(p).metadata
        at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            s = [meta.row_group(g).column(at[c]).statistics for c in ("x", "y")]
            met += all(a.min <= hi and a.max >= lo for a, (lo, hi) in zip(s, (x, y)))
            every += 1
    return met, every


def test_a_window_meets_few_row_groups(spark, tmp_path):
    spots = spark.range(60_000).select(F.col("id").alias("spot_id"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("x"), F.pmod(F.xxhash64(F.col("id") + 7), F.lit(1000)).cast("double").alias("y"), F.lit(-1).cast("long").alias("label"))
    counts = spots.select((F.col("spot_id") % 5).alias("gene_id"), "spot_id", F.lit(2.0).alias("n"))
    d = SpatialDataset(spots, counts, spark.createDataFrame([(0, "a")], "gene_id long, gene_name string"))
    layout.save_layout(d, f"{tmp_path}/z", 32 << 10)
    x, y = (100.0, 220.0), (600.0, 700.0)
    for name in ("spots", "counts"):
        met, every = groups_read(tmp_path / "z" / name, x, y)
        assert every >= 20 and met <= every / 4, (name, met, every)
    back = layout.read_layout(spark, f"{tmp_path}/z", x, y)
    inside = spots.where("x between 100 and 220 and y between 600 and 700")
    assert sorted(map(tuple, back.spots.collect())) == sorted(map(tuple, inside.collect()))
    assert sorted(map(tuple, back.counts.collect())) == sorted(map(tuple, counts.join(inside.select("spot_id"), "spot_id").select("gene_id", "spot_id", "n").collect()))
    plan = back.counts._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(y), GreaterThanOrEqual(x,100.0), LessThanOrEqual(x,220.0), GreaterThanOr" in plan  # Spark shortens the rest
    whole = layout.read_layout(spark, f"{tmp_path}/z")
    assert whole.spots.count() == whole.counts.count() == 60_000 and whole.cells is None and whole.genes.count() == 1


def test_keys_interleave(spark):
    row = spark.createDataFrame([(5.0, 3.0)], "x double, y double").select(layout.interleaved(F.col("x"), F.col("y"), (0.0, 65535.0, 0.0, 65535.0)).alias("k")).first()
    assert row.k == sum(((5 >> b) & 1) << 2 * b | ((3 >> b) & 1) << (2 * b + 1) for b in range(16))


def test_layout_of_odd_coordinates(spark, tmp_path):
    spots = spark.createDataFrame([(0, None, 1.0, -1), (1, float("nan"), 2.0, -1), (2, 4.0, 4.0, 1), (3, float("inf"), 0.0, -1)], "spot_id long, x double, y double, label long")
    counts = spark.createDataFrame([(0, 0, 1.0), (0, 2, 3.0)], "gene_id long, spot_id long, n double")
    layout.save_layout(SpatialDataset(spots, counts), f"{tmp_path}/o")
    assert layout.read_layout(spark, f"{tmp_path}/o").spots.count() == 4
    assert [tuple(r) for r in layout.read_layout(spark, f"{tmp_path}/o", (0.0, 9.0)).counts.collect()] == [(0, 2, 3.0)]
    layout.save_layout(SpatialDataset(spots.limit(0), counts.limit(0)), f"{tmp_path}/e")
    assert layout.read_layout(spark, f"{tmp_path}/e", (0.0, 9.0), (0.0, 9.0)).counts.count() == 0
