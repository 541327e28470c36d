"""Cell layouts and bin matrices as tables: cell, gene and expression rows that refer to each other by place.

The files that hold such tables are HDF5, which needs a library that Spark has not; a copy of each data set as Parquet, with its row number as idx, is what
these loaders take. Expression rows find their cell by running sums of the cells' row counts, joined by blocks of row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seepage.operators import geometry
from seepage.operators.ordering import placed
from seepage.schema import SpatialDataset
from seepage.storage import stage

#: Row numbers of one block of the join between expression rows and the spans of their cells.
SPAN = 4096
PITCH = 0.5


def pitch_of(resolution_nm: float | None = None, pitch_um: float | None = None) -> float:
    """O-10, O-24: micrometres a unit: as given, else from the resolution in nanometres, else PITCH."""
    if pitch_um is not None and not (0 < pitch_um < float("inf")):
        raise ValueError("pitch_um must be positive and finite")
    return float(pitch_um or (resolution_nm / 1000 if resolution_nm else PITCH))


def expand_offsets(owners: DataFrame, rows: DataFrame, owner: str, count: str) -> DataFrame:
    """O-07: rows (idx, ...) with owner, whose owners (owner, count) hold them in runs one after the other, in order of owner.

    The counts have to add up to the number of rows, else the table is corrupt and ValueError is raised."""
    spans = placed(owners.select(owner, F.col(count).cast("long").alias("n_")), [owner], "place_", {"from_": "n_"})
    total, stored = spans.agg(F.coalesce(F.sum("n_"), F.lit(0))).first()[0], rows.count()
    if total != stored:
        raise ValueError(f"corrupt layout: counts of {total} rows do not match the {stored} stored")
    block = lambda c: F.floor(c / SPAN).cast("long")
    wide = spans.where("n_ > 0").withColumn("block_", F.explode(F.sequence(block(F.col("from_")), block(F.col("from_") + F.col("n_") - 1))))
    joined = rows.withColumn("block_", block(F.col("idx"))).join(wide, "block_").where("idx >= from_ and idx < from_ + n_")
    return joined.select(*rows.columns, owner)


def read_cellbin(cell: DataFrame, gene: DataFrame, cell_exp: DataFrame, sidecar: DataFrame | None = None, resolution_nm: float | None = None, pitch_um: float | None = None) -> SpatialDataset:
    """O-07, O-09, O-10: cell (idx, id, x, y, gene_count), gene (idx, gene_name), cell_exp (idx, gene_id, count), all numbered from 0.

    Every cell is one spot with its own label. A sidecar (idx, gene_id, value) of as many rows replaces the counts with exact values; one of another length is
    left out. No cells raise ValueError."""
    if cell.limit(1).count() == 0:
        raise ValueError("the layout holds no cells")
    um = pitch_of(resolution_nm, pitch_um)
    entries = cell_exp.select("idx", "gene_id", F.col("count").cast("double").alias("n"))
    if sidecar is not None and sidecar.count() == cell_exp.count():
        entries = sidecar.select("idx", "gene_id", F.col("value").cast("double").alias("n"))
    owned = expand_offsets(cell.select(F.col("idx").alias("cell_"), "gene_count"), entries, "cell_", "gene_count")
    counts = owned.groupBy(F.col("gene_id").cast("long").alias("gene_id"), F.col("cell_").cast("long").alias("spot_id")).agg(F.sum("n").alias("n"))
    spots = cell.select(F.col("idx").cast("long").alias("spot_id"), (F.col("x") * um).alias("x"), (F.col("y") * um).alias("y"), F.col("idx").cast("long").alias("label"))
    return SpatialDataset(spots, counts, gene.select(F.col("idx").cast("long").alias("gene_id"), "gene_name"), cell.select(F.col("idx").cast("long").alias("cell_id"), F.col("id").cast("string").alias("original_id")))


def read_legacy(cell: DataFrame, cell_exp: DataFrame, names: DataFrame | None = None, resolution_nm: float | None = None, pitch_um: float | None = None) -> SpatialDataset:
    """O-08: cell (id, x, y), cell_exp (cell_id, gene_id, count), names (idx, gene_name). Cells are numbered in order of their id; genes without a name
    are gene_<number>, up to the largest number that is named or used."""
    if cell.limit(1).count() == 0:
        raise ValueError("the layout holds no cells")
    um = pitch_of(resolution_nm, pitch_um)
    order = stage(placed(cell, ["id"], "cell_"), "legacy-cells")
    counts = cell_exp.join(order.select(F.col("id").alias("cell_id"), "cell_"), "cell_id").groupBy(F.col("gene_id").cast("long").alias("gene_id"), F.col("cell_").alias("spot_id")).agg(F.sum(F.col("count").cast("double")).alias("n"))
    most = cell_exp.agg(F.coalesce(F.max("gene_id"), F.lit(0)).alias("m"))
    if names is not None:
        most = most.unionByName(names.agg(F.coalesce(F.max("idx"), F.lit(0)).alias("m"))).agg(F.max("m").alias("m"))
    genes = most.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m").cast("long"))).alias("gene_id"))
    own = names.select(F.col("idx").cast("long").alias("gene_id"), F.when(F.col("gene_name") != "", F.col("gene_name")).alias("gene_name")) if names is not None else genes.select("gene_id", F.lit(None).cast("string").alias("gene_name"))
    genes = genes.join(own, "gene_id", "left").select("gene_id", F.coalesce("gene_name", F.concat(F.lit("gene_"), F.col("gene_id").cast("string"))).alias("gene_name"))
    spots = order.select(F.col("cell_").alias("spot_id"), (F.col("x") * um).alias("x"), (F.col("y") * um).alias("y"), F.col("cell_").alias("label"))
    return SpatialDataset(spots, counts, genes, order.select(F.col("cell_").alias("cell_id"), F.col("id").cast("string").alias("original_id")))


def read_bins(gene: DataFrame, expression: DataFrame, region_um: tuple[float, float, float, float] | None = None, resolution_nm: float | None = None, pitch_um: float | None = None) -> SpatialDataset:
    """O-11: gene (idx, gene_name, offset, count), expression (idx, x, y, count): a gene's rows lie at its offset. The region (low x, high x, low y, high y, in
    micrometres, ends included) reaches the scan as a filter. Spots are numbered by x, then y, all outside cells. No rows left raise ValueError."""
    um = pitch_of(resolution_nm, pitch_um)
    rows = expression.select("idx", "x", "y", F.col("count").cast("double").alias("n"))
    if region_um is not None:
        if len(region_um) != 4:
            raise ValueError("region_um must be (low x, high x, low y, high y)")
        rows = rows.where(F.col("x").between(region_um[0] / um, region_um[1] / um) & F.col("y").between(region_um[2] / um, region_um[3] / um))
    block = lambda c: F.floor(c / SPAN).cast("long")
    spans = gene.where("count > 0").select(F.col("idx").cast("long").alias("gene_id"), F.col("offset").alias("from_"), F.col("count").alias("n_"))
    wide = spans.withColumn("block_", F.explode(F.sequence(block(F.col("from_")), block(F.col("from_") + F.col("n_") - 1))))
    owned = stage(rows.withColumn("block_", block(F.col("idx"))).join(wide, "block_").where("idx >= from_ and idx < from_ + n_").select("gene_id", "x", "y", "n"), "bin-rows")
    if owned.limit(1).count() == 0:
        raise ValueError("no expression rows found" + (" within the region" if region_um else ""))
    spots = stage(placed(owned.select("x", "y").distinct(), ["x", "y"], "spot_id"), "bin-spots")
    counts = owned.join(spots, ["x", "y"]).groupBy("gene_id", "spot_id").agg(F.sum("n").alias("n"))
    table = spots.select("spot_id", (F.col("x") * um).alias("x"), (F.col("y") * um).alias("y"), F.lit(-1).cast("long").alias("label"))
    return SpatialDataset(table, counts, gene.select(F.col("idx").cast("long").alias("gene_id"), "gene_name"))


def pair(bins: SpatialDataset, cells: DataFrame, region_um: tuple[float, float, float, float] | None = None) -> SpatialDataset:
    """O-12: bins labelled by the borders of cells (cell_id, original_id, cx, cy, border), all in micrometres. Only cells whose border's box meets the region
    are candidates. Labels are numbered from 0 over the cells that hold a spot, in order of cell_id. Cells without any border raise ValueError."""
    bordered = cells.where(F.size("border") >= 3)
    if bordered.limit(1).count() == 0:
        raise ValueError("the cells carry no borders")
    if region_um is not None:
        lo = lambda a: F.array_min(F.transform("border", lambda p: p[a]))
        hi = lambda a: F.array_max(F.transform("border", lambda p: p[a]))
        bordered = bordered.where((lo("x") <= region_um[1]) & (hi("x") >= region_um[0]) & (lo("y") <= region_um[3]) & (hi("y") >= region_um[2]))
    labelled = stage(geometry.label_points(bins.spots.select("spot_id", "x", "y"), bordered), "pair-labels")
    hit = placed(labelled.where("cell_id >= 0").select("cell_id").distinct(), ["cell_id"], "label")
    spots = labelled.join(hit, "cell_id", "left").select("spot_id", "x", "y", F.coalesce("label", F.lit(-1).cast("long")).alias("label"))
    known = hit.join(cells, "cell_id").select(F.col("label").alias("cell_id"), F.col("original_id").cast("string").alias("original_id"))
    return SpatialDataset(spots, bins.counts, bins.genes, known)


def annotated(data: SpatialDataset, metadata: DataFrame, section: str | None = None) -> tuple[SpatialDataset, DataFrame]:
    """O-15: only cells that the metadata (cell_id, section_id, annotation) of a section lists stay cells; their numbers follow the order of the old ones.

    Returns the data set and (cell_id, annotation)."""
    known = (metadata if section is None else metadata.where(F.col("section_id") == section)).groupBy("cell_id").agg(F.min("annotation").alias("annotation"))
    inside = data.spots.where("label >= 0").select(F.col("label").alias("cell_id")).distinct().join(known, "cell_id", "left_semi")
    number = stage(placed(inside, ["cell_id"], "new_"), "annotated-cells")
    spots = data.spots.join(number.withColumnRenamed("cell_id", "label"), "label", "left").select("spot_id", "x", "y", F.coalesce("new_", F.lit(-1).cast("long")).alias("label"))
    cells = number.select(F.col("new_").alias("cell_id"), F.col("cell_id").cast("string").alias("original_id"))
    return SpatialDataset(spots, data.counts, data.genes, cells, data.report), number.join(known, "cell_id").select(F.col("new_").alias("cell_id"), "annotation")


def largest_genes(data: SpatialDataset, n: int) -> SpatialDataset:
    """O-16: the n genes of largest total, renumbered by total, largest first; ties: the larger number first."""
    totals = data.counts.groupBy("gene_id").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), F.desc("gene_id")).limit(n)
    number = placed(totals, [-F.col("total"), -F.col("gene_id")], "new_").select("gene_id", "new_")
    number = F.broadcast(number)  # at most n rows
    counts = data.counts.join(number, "gene_id").select(F.col("new_").alias("gene_id"), "spot_id", "n")
    genes = data.genes.join(number, "gene_id").select(F.col("new_").alias("gene_id"), "gene_name") if data.genes is not None else None
    return SpatialDataset(data.spots, counts, genes, data.cells, data.report)
