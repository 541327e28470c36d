import gzip

import pytest
from pyspark.sql import functions as F

from seepage.functions import scalar
from seepage.operators import geometry
from seepage.operators import ordering
from seepage.sources import cellbin, gem, sinks

GEM = """#comment
geneID\tx\ty\tMIDCounts\tcell

geneA\t0\t0\t5\t1
#another
geneA\t1\t0\t3\t1
geneB\t0\t0\t2\t1
geneB\t1\t1\t4\t2
geneA\t0\t1\t1\t0
short\t1
"""


@pytest.mark.parametrize("kind", ["tsv", "csv", "gz"])
def test_labelled_lines(spark, tmp_path, kind):
    path = tmp_path / f"a.{'gem.gz' if kind == 'gz' else kind}"
    text = GEM.replace("\t", ",") if kind == "csv" else GEM
    path.write_bytes(gzip.compress(text.encode()) if kind == "gz" else text.encode())
    d = gem.load_gem(spark, str(path), pitch_um=0.5)
    spots = [tuple(r) for r in d.spots.orderBy("spot_id").collect()]
    assert spots == [(0, 0, 0, 0), (1, 0.5, 0, 0), (2, 0.5, 0.5, 1), (3, 0, 0.5, -1)]
    totals = {r.gene_name: r.n for r in d.counts.join(d.genes, "gene_id").groupBy("gene_name").agg(F.sum("n").alias("n")).collect()}
    assert totals == {"geneA": 9, "geneB": 6}
    assert [r.original_id for r in d.cells.orderBy("cell_id").collect()] == ["1", "2"] and d.report.first().n_short == 1


def test_bad_headers(spark, tmp_path):
    (tmp_path / "a").write_text("geneID\tx\n")
    with pytest.raises(ValueError, match="columns"):
        gem.load_gem(spark, str(tmp_path / "a"))
    (tmp_path / "b").write_text("geneID x\n")
    with pytest.raises(ValueError, match="delimiter"):
        gem.load_gem(spark, str(tmp_path / "b"))
    with pytest.raises(ValueError, match="pitch"):
        gem.scale("x", -1)


def test_pair(spark, tmp_path):
    (tmp_path / "g").write_text("x,y,geneID,MIDCounts\n1,1,A,2\n1,1,B,1\n2,2,A,3\n2,2,C,1\n3,3,A,1\n3,3,B,2\n4,4,A,5\n")
    (tmp_path / "s").write_text("x,y,geneID,MIDCounts,cell\n2,2,A,3,Cell_9\n2,2,A,3,Cell_1\n4,4,A,5,Cell_2\n8,8,A,1,Cell_3\n1,1,A,1,0\n")
    d = gem.load_gem_pair(spark, str(tmp_path / "g"), str(tmp_path / "s"))
    assert [r.original_id for r in d.cells.orderBy("cell_id").collect()] == ["Cell_1", "Cell_2", "Cell_3"]
    assert [r.label for r in d.spots.orderBy("spot_id").collect()] == [-1, 0, -1, 1]


def test_feature_slices(spark):
    d = gem.load_feature_slices(
        spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1)], "row int, col int"),
        spark.createDataFrame([(0, 0, 0, 5), (0, 1, 0, 3), (1, 0, 1, 2), (1, 1, 1, 4), (1, 9, 9, 7)], "gene_key int, row int, col int, data int"),
        spark.createDataFrame([(0, "geneA"), (1, "geneB")], "gene_key int, name string"),
        spark.createDataFrame([(0, 0, 7), (1, 1, 7)], "row int, col int, cell int"),
    )
    assert [tuple(r) for r in d.spots.orderBy("spot_id").collect()] == [(0, 1, 1, 0), (1, 3, 1, -1), (2, 1, 3, -1), (3, 3, 3, 0)]
    assert d.counts.agg(F.sum("n")).first()[0] == 14


def test_point_in_polygon(spark):
    square = lambda i, cx, cy, h: (i, float(cx), float(cy), [(cx - h, cy - h), (cx + h, cy - h), (cx + h, cy + h), (cx - h, cy + h)])
    borders = spark.createDataFrame([square(0, 0.0, 0.0, 5.0), square(1, 6.0, 0.0, 5.0), (2, 0.0, 0.0, [(0.0, 0.0)])], "cell_id long, cx double, cy double, border array<struct<x: double, y: double>>")
    pts = spark.createDataFrame([(0, 1.0, 0.0), (1, 5.0, 0.0), (2, 15.0, 5.0), (3, -4.9, 4.5), (4, 3.0, 0.0)], "spot_id long, x double, y double")
    assert [r.cell_id for r in geometry.label_points(pts, borders).orderBy("spot_id").collect()] == [0, 1, -1, 0, 0]
    one = borders.where("cell_id = 0").select(geometry.area(F.col("border")).alias("a"), geometry.to_absolute(geometry.to_relative(F.col("border"), F.col("cx"), F.col("cy"), 0.5), F.col("cx"), F.col("cy"), 0.5).alias("back"), "border", geometry.area(geometry.circle(F.lit(0.0), F.lit(0.0), F.lit(1000.0))).alias("c")).first()
    assert one.a == 100 and one.back == one.border and 980 < one.c < 1000


def test_scalars(spark):
    df = spark.createDataFrame([("mouse_x1-20_y3-4", "T_304_9", "1a b", "mt-Co1")], "tag string, label string, name string, gene string")
    r = df.select(scalar.parse_tag(F.col("tag")).alias("t"), scalar.annotation_of(F.col("label")).alias("a"), scalar.syntactic_name(F.col("name")).alias("n"), scalar.is_housekeeping(F.col("gene")).alias("h")).first()
    assert tuple(r.t) == ("mouse", 1, 20, 3, 4) and r.a == "T-304" and r.n == "X1a.b" and r.h


def test_sinks(spark, tmp_path):
    expr = spark.createDataFrame([(0, 10, 2.5), (1, 10, 1.0), (0, 11, -3.0), (1, 11, 4.0)], "gene_id long, cell_id long, n double")
    cells = spark.createDataFrame([(10, 5.0, 5.0, 3), (11, 1.0, 1.0, 4), (12, 900.0, 900.0, 1)], "cell_id long, cx double, cy double, area long")
    sinks.save_cell_layout(expr, cells, f"{tmp_path}/l")
    read = lambda n: spark.read.parquet(f"{tmp_path}/l/{n}")
    assert [tuple(r) for r in read("cell_exp").orderBy("idx").select("cell", "gene_id", "count").collect()] == [(0, 1, 4), (1, 0, 2), (1, 1, 1)]
    assert [(r.idx, r.cell_id, r.gene_count, r.offset) for r in read("cell").orderBy("idx").collect()] == [(0, 11, 1, 0), (1, 10, 2, 1), (2, 12, 0, 3)]
    assert [(r.gene_id, r.cell_count, r.exp_count, r.max_count, r.offset) for r in read("gene").orderBy("gene_id").collect()] == [(0, 1, 2, 2, 0), (1, 2, 5, 4, 1)]
    assert [tuple(r) for r in read("gene_exp").orderBy("idx").select("gene_id", "cell").collect()] == [(0, 1), (1, 0), (1, 1)]
    assert [r.value for r in read("sidecar").orderBy("idx").collect()] == [4.0, 2.5, 1.0] and read("cell").where("size(border) = 32").count() == 3
    back = cellbin.read_cellbin(read("cell").select("idx", F.col("cell_id").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"), "gene_count"), spark.createDataFrame([(0, "a"), (1, "b")], "idx long, gene_name string"), read("cell_exp"), read("sidecar"))
    assert sorted(map(tuple, back.counts.collect())) == [(0, 1, 2.5), (1, 0, 4.0), (1, 1, 1.0)]
    with pytest.raises(Exception, match="65535"):
        sinks.save_cell_layout(expr.withColumn("n", F.lit(70000.0)), cells, f"{tmp_path}/m")
    bare = spark.createDataFrame([(10, 5.0, 5.0, None, [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]), (11, 1.0, 1.0, 7, None), (12, 2.0, 2.0, None, None)], "cell_id long, cx double, cy double, area long, border array<struct<x:double,y:double>>")
    areas = {r.cell_id: (r.area, r.dnb_count) for r in sinks.cell_layout(expr, bare)["cell"].collect()}
    assert areas == {10: (100, 100), 11: (7, 7), 12: (7, 7)}
    sinks.save_matrix_market(expr, 2, 12, f"{tmp_path}/mm")
    assert gem.load_matrix_market(spark, f"{tmp_path}/mm").where("value > 0").count() == 3
    whole = "".join(p.read_text() for p in sorted((tmp_path / "mm").glob("part-*"))).split("\n")
    assert whole[0].startswith("%%MatrixMarket") and whole[1] == "2 12 4" and len([x for x in whole if x]) == 6
    sinks.save_metrics(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "method string, v double"), f"{tmp_path}/j", "method")
    sinks.save_metrics(spark.createDataFrame([("b", 3.0)], "method string, v double"), f"{tmp_path}/j", "method")
    assert {(r.method, r.v) for r in spark.read.json(f"{tmp_path}/j").collect()} == {("a", 1.0), ("b", 3.0)}
    sinks.save_official_input(expr, spark.createDataFrame([(0, "a")], "gene_id long, gene_name string"), spark.createDataFrame([("cell_10", 1, 5.0, 6.0)], "barcode string, tissue int, x double, y double"), f"{tmp_path}/o")
    assert spark.read.option("header", True).csv(f"{tmp_path}/o/slide").first().row == "6.0"
    sinks.save_results(expr, cells.limit(1), f"{tmp_path}/r")
    sinks.save_annotated(expr, cells, spark.createDataFrame([(0, "a")], "gene_id long, gene_name string"), spark.createDataFrame([(10, "T")], "cell_id long, annotation string"), f"{tmp_path}/h")
    assert {r.annotation for r in spark.read.parquet(f"{tmp_path}/h/obs").collect()} == {"T", "Unknown"}


def test_legacy_layout(spark):
    cells = spark.createDataFrame([(3, 10, 20), (1, 40, 30), (2, 70, 40)], "id long, x int, y int")
    rows = spark.createDataFrame([(3, 0, 5), (3, 1, 7), (1, 1, 3), (2, 0, 2), (2, 1, 9)], "cell_id long, gene_id long, count int")
    d = cellbin.read_legacy(cells, rows, spark.createDataFrame([(0, "A"), (1, "")], "idx long, gene_name string"))
    got = {(r.gene_id, r.spot_id): r.n for r in d.counts.collect()}
    assert [r.original_id for r in d.cells.orderBy("cell_id").collect()] == ["1", "2", "3"] and (got[1, 0], got[0, 2], got[1, 2]) == (3, 5, 7)
    assert [r.x for r in d.spots.orderBy("spot_id").collect()] == [20, 35, 5] and [r.gene_name for r in d.genes.orderBy("gene_id").collect()] == ["A", "gene_1"]


def test_corrupt_and_empty_layouts(spark):
    cell = spark.createDataFrame([(0, 7, 1, 2, 2), (1, 8, 3, 4, 0)], "idx long, id long, x int, y int, gene_count int")
    gene = spark.createDataFrame([(0, "a")], "idx long, gene_name string")
    exp = spark.createDataFrame([(0, 0, 5)], "idx long, gene_id long, count int")
    with pytest.raises(ValueError, match="corrupt"):
        cellbin.read_cellbin(cell, gene, exp)
    with pytest.raises(ValueError, match="no cells"):
        cellbin.read_cellbin(cell.limit(0), gene, exp)
    with pytest.raises(ValueError, match="pitch"):
        cellbin.pitch_of(None, float("inf"))
    assert (cellbin.pitch_of(), cellbin.pitch_of(715), cellbin.pitch_of(715, 2.0)) == (0.5, 0.715, 2.0)


def test_bin_matrix_and_crop(spark):
    gene = spark.createDataFrame([(0, "A", 0, 2), (1, "B", 2, 1)], "idx long, gene_name string, offset long, count long")
    rows = spark.createDataFrame([(0, 10, 10, 2), (1, 11, 12, 1), (2, 10, 10, 4)], "idx long, x int, y int, count int")
    d = cellbin.read_bins(gene, rows)
    assert [tuple(r) for r in d.spots.orderBy("spot_id").collect()] == [(0, 5, 5, -1), (1, 5.5, 6, -1)]
    assert {(r.gene_id, r.spot_id): r.n for r in d.counts.collect()} == {(0, 0): 2, (0, 1): 1, (1, 0): 4}
    assert cellbin.read_bins(gene, rows, (5, 5, 5, 5)).spots.count() == 1
    with pytest.raises(ValueError, match="region"):
        cellbin.read_bins(gene, rows, (50, 60, 50, 60))


def test_bin_pair(spark):
    gene = spark.createDataFrame([(0, "A", 0, 6)], "idx long, gene_name string, offset long, count long")
    rows = spark.createDataFrame([(i, x, y, n) for i, (x, y, n) in enumerate([(9, 9, 2), (10, 9, 1), (11, 11, 4), (10, 11, 3), (13, 13, 5), (20, 20, 7)])], "idx long, x int, y int, count int")
    d = cellbin.read_bins(gene, rows, pitch_um=1.0)
    square = lambda lo, hi: [(lo, lo), (hi, lo), (hi, hi), (lo, hi)]
    cells = spark.createDataFrame([(4, "far", 50.0, 50.0, square(48.0, 52.0)), (9, "near", 10.0, 10.0, square(8.0, 12.0))], "cell_id long, original_id string, cx double, cy double, border array<struct<x:double,y:double>>")
    p = cellbin.pair(d, cells)
    assert p.spots.where("label = 0").count() == 4 and p.spots.where("label < 0").count() == 2 and p.counts.agg(F.sum("n")).first()[0] == 22
    assert [tuple(r) for r in p.cells.collect()] == [(0, "near")]
    assert cellbin.pair(d, cells, (0, 20, 0, 20)).spots.where("label = 0").count() == 4
    with pytest.raises(ValueError, match="borders"):
        cellbin.pair(d, cells.withColumn("border", F.expr("slice(border, 1, 2)")))
    kept, names = cellbin.annotated(p, spark.createDataFrame([(0, "s", "T cell"), (0, "other", "x")], "cell_id long, section_id string, annotation string"), "s")
    assert kept.spots.where("label = 0").count() == 4 and [tuple(r) for r in names.collect()] == [(0, "T cell")]
    assert cellbin.annotated(p, spark.createDataFrame([(5, "s", "y")], "cell_id long, section_id string, annotation string"))[0].spots.where("label >= 0").count() == 0


def test_places_over_many_files(spark):
    n = 20_000
    df = spark.range(n).selectExpr("id * 7919 % 20000 AS v", "id % 7 AS w").repartition(16)
    got = ordering.placed(df, ["v"], "pos", {"before": "w"}).orderBy("v").collect()
    assert [r.pos for r in got] == list(range(n)) and all(b.before == a.before + a.w for a, b in zip(got, got[1:]))
    rows = spark.range(n).selectExpr("'k' || id % 900 AS key", "(id * 31) % 20000 AS at").repartition(16)
    first = {}
    for r in sorted(rows.collect(), key=lambda r: r["at"]):
        first.setdefault(r["key"], len(first))
    assert {r["key"]: r["n"] for r in ordering.numbered(rows, ["key"], "n", "at").collect()} == first
    assert ordering.placed(df.limit(0), ["v"]).count() == 0


def test_quantiles(spark):
    df = spark.range(3000).selectExpr("id % 3 AS g", "CASE WHEN id % 3 = 0 THEN 5.0D WHEN id % 50 = 1 THEN null ELSE (id * 37 % 1001) / 7.0D END AS v")
    got = {r.g: (r.a, r.b) for r in ordering.quantiles(df, ["g"], "v", {"a": 0.5, "b": 0.9}).collect()}
    want = {r.g: (r.a, r.b) for r in df.groupBy("g").agg(F.expr("percentile(v, 0.5)").alias("a"), F.expr("percentile(v, 0.9)").alias("b")).collect()}
    assert all(got[g] == pytest.approx(want[g]) for g in want) and len(got) == 3
    assert ordering.quantiles(df, [], "v", {"q": 0.25}).first().q == pytest.approx(df.agg(F.expr("percentile(v, 0.25)")).first()[0])
    assert ordering.quantiles(df.limit(0), [], "v", {"q": 0.5}).where("q is not null").count() == 0


def test_names(spark):
    df = spark.createDataFrame([(0, "a b"), (1, "a.b"), (2, "a.b.1"), (3, "a b"), (4, "1x"), (5, "c")], "i int, name string")
    assert [r.name for r in scalar.unique_names(df, "name", "i").orderBy("i").collect()] == ["a.b", "a.b.2", "a.b.1", "a.b.3", "X1x", "c"]
    ids = spark.createDataFrame([("s_002um_00012_00030-1",)], "b string").select(scalar.grid_of(F.col("b")).alias("g")).first().g
    assert tuple(ids) == (24, 60)
    with pytest.raises(Exception, match="unexpected"):
        spark.createDataFrame([("x",)], "b string").select(scalar.grid_of(F.col("b"))).collect()
