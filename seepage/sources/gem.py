"""Expression text loaders: tab- or comma-separated lines with a header, '#' comments and blank lines anywhere, gzip by suffix.

Rows with too few fields are dropped and counted in the data set's report; fields that are no numbers raise.
Order ("first" and "last" row of a spot) is that of the files' names, then of the place in the file. Block gzip files are split, other gzip files are one split each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seepage.operators.ordering import numbered, placed
from seepage.schema import SpatialDataset
from seepage.sources import blockgzip
from seepage.storage import stage

EMPTY = ("0", "-1")


def detect_delimiter(header: str) -> str:
    """O-21: tab before comma."""
    for sep in "\t,":
        if sep in header:
            return sep
    raise ValueError("cannot detect the delimiter: the header has neither a tab nor a comma")


def empty_labels(labels) -> list[str]:
    """O-21: None means 0 and -1; the empty text is always empty."""
    return sorted({"", *(EMPTY if labels is None else map(str, labels if isinstance(labels, (list, tuple, set, frozenset)) else [labels]))})


def scan_lines(spark: SparkSession, path: str, columns: dict[str, str], sep: str | None = None) -> tuple[DataFrame, DataFrame]:
    """O-01..O-03: (row_id and the named columns as text, one row with n_short). columns: output name -> header name."""
    if blockgzip.is_block_gzip(spark, path):
        read = blockgzip.read_lines(spark, path).select("value", F.struct("file", "block", "row").alias("row_id"))
    else:
        row = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        read = spark.read.text(path).select("value", row.alias("row_id"))
    lines = read.where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    head = lines.first()
    if head is None:
        raise ValueError(f"{path} has no header")
    sep = sep or detect_delimiter(head["value"])
    names = [n.strip() for n in head["value"].split(sep)]
    missing = [c for c in columns.values() if c not in names]
    if missing:
        raise ValueError(f"columns {missing} are not in the header {names}")
    at = {out: names.index(c) for out, c in columns.items()}
    rows = lines.where(F.col("value") != head["value"]).select("row_id", F.split("value", "\t" if sep == "\t" else f"[{sep}]").alias("f"))
    long_enough = F.size("f") > max(at.values())
    kept = rows.where(long_enough).select("row_id", *(F.trim(F.get("f", F.lit(i))).alias(out) for out, i in at.items()))
    return kept, rows.where(~long_enough).agg(F.count("*").alias("n_short"))


def scale(coordinate: str, pitch_um: float | None) -> Column:
    """O-24."""
    if pitch_um is not None and not (0 < pitch_um < float("inf")):
        raise ValueError("pitch_um must be positive and finite")
    return F.col(coordinate).cast("double") * F.lit(float(pitch_um or 1.0))


def load_gem(spark: SparkSession, path: str, gene_col: str = "geneID", x_col: str = "x", y_col: str = "y", count_col: str = "MIDCounts", cell_label_col: str = "cell", labels_empty=None, sep: str | None = None, pitch_um: float | None = None, x_range=None, y_range=None) -> SpatialDataset:
    """O-01: labelled expression lines. Equal (gene, x, y) add up; a spot's label is its first that is not empty;
    genes and spots are numbered as first met, cells from 0 in order of their labels; other negative labels mean no cell."""
    text, report = scan_lines(spark, path, {"gene": gene_col, "x": x_col, "y": y_col, "n": count_col, "label": cell_label_col}, sep)
    rows = text.select("row_id", "gene", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("n").cast("double").alias("n"), F.when(~F.col("label").isin(empty_labels(labels_empty)), F.col("label").cast("long")).alias("label"))
    if x_range is not None:
        rows = rows.where(F.col("x").between(*x_range))
    if y_range is not None:
        rows = rows.where(F.col("y").between(*y_range))
    rows = stage(rows, "gem-rows")
    genes, spots = numbered(rows, ["gene"], "gene_id", "row_id"), numbered(rows, ["x", "y"], "spot_id", "row_id")
    labels = rows.groupBy("x", "y").agg(F.min_by("label", F.when(F.col("label").isNotNull(), F.col("row_id"))).alias("label"))
    known = labels.where("label >= 0").select("label").distinct()
    cells = placed(known, ["label"], "cell_id")
    labelled = spots.join(labels, ["x", "y"]).join(cells, "label", "left")
    spot_table = labelled.select("spot_id", scale("x", pitch_um).alias("x"), scale("y", pitch_um).alias("y"), F.coalesce("cell_id", F.lit(-1).cast("long")).alias("label"))
    counts = rows.join(genes, "gene").join(spots, ["x", "y"]).groupBy("gene_id", "spot_id").agg(F.sum("n").alias("n"))
    return SpatialDataset(spot_table, counts, genes.select("gene_id", F.col("gene").alias("gene_name")), cells.select("cell_id", F.col("label").cast("string").alias("original_id")), report)


def load_label_map(spark: SparkSession, path: str, x_col: str = "x", y_col: str = "y", cell_label_col: str = "cell", labels_empty=None, sep: str | None = None) -> DataFrame:
    """O-02: (x, y, label text) of the last row of each place whose label is not empty."""
    text, _ = scan_lines(spark, path, {"x": x_col, "y": y_col, "label": cell_label_col}, sep)
    rows = text.where(~F.col("label").isin(empty_labels(labels_empty)))
    return rows.groupBy(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).agg(F.max_by("label", "row_id").alias("label"))


def load_gem_pair(spark: SparkSession, gem_path: str, label_path: str, gene_col: str = "geneID", x_col: str = "x", y_col: str = "y", count_col: str = "MIDCounts", cell_label_col: str = "cell", labels_empty=None, sep: str | None = None, pitch_um: float | None = None) -> SpatialDataset:
    """O-04, O-05: expression lines and a label map. Labels are texts, cells are numbered in their order,
    and cells without a spot are listed too; places without a label are outside cells."""
    text, report = scan_lines(spark, gem_path, {"gene": gene_col, "x": x_col, "y": y_col, "n": count_col}, sep)
    rows = stage(text.select("row_id", "gene", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("n").cast("double").alias("n")), "gem-rows")
    labels = stage(load_label_map(spark, label_path, x_col, y_col, cell_label_col, labels_empty, sep), "gem-labels")
    genes, spots = numbered(rows, ["gene"], "gene_id", "row_id"), numbered(rows, ["x", "y"], "spot_id", "row_id")
    cells = placed(labels.select("label").distinct(), ["label"], "cell_id")
    labelled = spots.join(labels, ["x", "y"], "left").join(cells, "label", "left")
    spot_table = labelled.select("spot_id", scale("x", pitch_um).alias("x"), scale("y", pitch_um).alias("y"), F.coalesce("cell_id", F.lit(-1).cast("long")).alias("label"))
    counts = rows.join(genes, "gene").join(spots, ["x", "y"]).groupBy("gene_id", "spot_id").agg(F.sum("n").alias("n"))
    return SpatialDataset(spot_table, counts, genes.select("gene_id", F.col("gene").alias("gene_name")), cells.select("cell_id", F.col("label").alias("original_id")), report)


def load_window(spark: SparkSession, gem_path: str, label_path: str, x_range=None, y_range=None, gene_col: str = "geneID", x_col: str = "x", y_col: str = "y", count_col: str = "MIDCounts", cell_label_col: str = "cell", labels_empty=None, sep: str | None = None) -> SpatialDataset:
    """O-13: expression lines and a label map inside a window, both ends included. Genes are numbered in order of their names, spots of x, then y;
    a spot's label is the original number of its cell, and cells holds all that the map's window names, in order."""
    inside = lambda df: df.where(F.col("x").between(*x_range) if x_range else F.lit(True)).where(F.col("y").between(*y_range) if y_range else F.lit(True))
    text, report = scan_lines(spark, gem_path, {"gene": gene_col, "x": x_col, "y": y_col, "n": count_col}, sep)
    rows = stage(inside(text.select("gene", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("n").cast("double").alias("n"))), "gem-rows")
    labels = stage(inside(load_label_map(spark, label_path, x_col, y_col, cell_label_col, labels_empty, sep)).withColumn("label", F.col("label").cast("long")), "gem-labels")
    genes, spots = placed(rows.select("gene").distinct(), ["gene"], "gene_id"), placed(rows.select("x", "y").distinct(), ["x", "y"], "spot_id")
    labelled = spots.join(labels, ["x", "y"], "left").select("spot_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.coalesce("label", F.lit(-1).cast("long")).alias("label"))
    counts = rows.join(genes, "gene").join(spots, ["x", "y"]).groupBy("gene_id", "spot_id").agg(F.sum("n").alias("n"))
    cells = labels.select("label").distinct().select(F.col("label").alias("cell_id"), F.col("label").cast("string").alias("original_id"))
    return SpatialDataset(labelled, counts, genes.select("gene_id", F.col("gene").alias("gene_name")), cells, report)


def load_feature_slices(pixels: DataFrame, slices: DataFrame, features: DataFrame, segments: DataFrame, pixel_um: float = 2.0) -> SpatialDataset:
    """O-06, on tables: pixels (row, col) of the tissue mask, slices (gene_key, row, col, data), features (gene_key, name),
    segments (row, col, cell). x comes from the column, y from the row, at pixel centres; entries off the mask drop out."""
    mask = placed(pixels.select("row", "col").distinct(), ["row", "col"], "spot_id")
    cells = placed(segments.where("cell > 0").select("cell").distinct(), ["cell"], "cell_id")
    labels = segments.join(cells, "cell").groupBy("row", "col").agg(F.min("cell_id").alias("label"))
    centre = lambda c: F.col(c) * F.lit(pixel_um) + pixel_um / 2
    spots = mask.join(labels, ["row", "col"], "left").select("spot_id", centre("col").alias("x"), centre("row").alias("y"), F.coalesce("label", F.lit(-1).cast("long")).alias("label"))
    counts = slices.join(mask, ["row", "col"]).groupBy(F.col("gene_key").cast("long").alias("gene_id"), "spot_id").agg(F.sum(F.col("data").cast("double")).alias("n"))
    return SpatialDataset(spots, counts, features.select(F.col("gene_key").cast("long").alias("gene_id"), F.col("name").alias("gene_name")), cells.select("cell_id", F.col("cell").cast("string").alias("original_id")))


def load_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """O-20: (row, col, value) of a coordinate file, numbered from 0; the size line is dropped."""
    lines = spark.read.text(path).where(~F.col("value").startswith("%") & (F.trim("value") != "")).withColumn("row_id", F.monotonically_increasing_id())
    size = lines.orderBy("row_id").first()["row_id"]
    f = F.split(F.trim("value"), r"\s+")
    return lines.where(F.col("row_id") != size).select((F.get(f, F.lit(0)).cast("long") - 1).alias("row"), (F.get(f, F.lit(1)).cast("long") - 1).alias("col"), F.get(f, F.lit(2)).cast("double").alias("value"))
