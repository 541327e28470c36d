"""Array files (.npy) and sparse matrices (.npz) as tables, read by ranges.

A task opens the file itself and reads its range alone; from a compressed archive it unpacks what lies before the range too, in bounded memory, so
that archives saved without compression read faster. No task, nor the driver, holds a whole array."""

from __future__ import annotations

import zipfile
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from seepage.functions.scalar import grid_place
from seepage.operators.ordering import placed
from seepage.schema import SpatialDataset
from seepage.sources.files import opened, qualified
from seepage.storage import stage

#: Entries of a partition, and of one batch of rows.
PART, BATCH = 4_000_000, 65_536


class _Array:
    """A stored array that is read by ranges of its flat order."""

    def __init__(self, stream):
        self.stream = stream
        version = np.lib.format.read_magic(stream)
        header = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        self.shape, self.by_column, self.dtype = header(stream)
        if self.dtype.hasobject:
            raise ValueError("arrays of Python objects are not read")
        self.start, self.size = stream.tell(), int(np.prod(self.shape, dtype=np.int64))

    def part(self, a: int, b: int) -> np.ndarray:
        width = self.dtype.itemsize
        self.stream.seek(self.start + a * width)
        want, got = (b - a) * width, bytearray()
        while len(got) < want:
            more = self.stream.read(want - len(got))
            if not more:
                raise ValueError("an array file ends early")
            got += more
        return np.frombuffer(bytes(got), self.dtype)


@contextmanager
def stored(uri: str, name: str | None = None):
    """The array of a .npy file, or one of a .npz archive."""
    system, path = opened(uri)
    with system.open_input_file(path) as f:
        if name is None:
            yield _Array(f)
        else:
            with zipfile.ZipFile(f) as z, z.open(f"{name}.npy") as stream:
                yield _Array(stream)


class _Part(InputPartition):
    pass


class _MatrixReader(DataSourceReader):
    def __init__(self, options):
        self.uri, self.step = options["path"], int(options.get("part", PART))
        self.window = {axis: (int(options.get(f"{axis}From", 0)), int(options.get(f"{axis}To", 1 << 62))) for axis in ("row", "col")}
        with stored(self.uri, "format") as f:
            kind = f.part(0, 1)[0]
        self.major = {"csr": "row", "csc": "col"}[kind.decode() if isinstance(kind, bytes) else str(kind)]

    def partitions(self):
        """Ranges of entries, each with the range of pointers that covers it; those of rows (or columns) outside the window are left out."""
        lo, hi = self.window[self.major]
        with stored(self.uri, "indptr") as ptr:
            n = ptr.size - 1
            lo, hi = min(lo, n), min(hi, n - 1) + 1
            if lo >= hi:
                return [_Part(None)]
            # One pass over the pointers, a block at a time.
            targets, out, first, at = None, [], lo, lo
            while at < hi:
                block = ptr.part(at, min(at + BATCH, hi) + 1).astype(np.int64)
                if targets is None:
                    begin = int(block[0])
                    targets = begin + self.step
                while targets < block[-1]:
                    row = at + int(np.searchsorted(block, targets, "right")) - 1
                    out.append(_Part((begin, targets, first, row + 1)))
                    begin, targets, first = targets, targets + self.step, row
                at, last = min(at + BATCH, hi), int(block[-1])
            out.append(_Part((begin, last, first, hi)))
        return out

    def read(self, partition):
        if partition.value is None:
            return
        begin, end, first, last = partition.value
        minor = "col" if self.major == "row" else "row"
        lo, hi = self.window[minor]
        with stored(self.uri, "indptr") as ptr, stored(self.uri, "indices") as indices, stored(self.uri, "data") as data:
            low, at = first, begin
            while at < end:
                stop = min(at + BATCH, end)
                # Pointers are read by blocks too: a partition may cover many empty rows.
                bounds = ptr.part(low, min(low + BATCH, last) + 1).astype(np.int64)
                if bounds[-1] <= at:
                    low = min(low + BATCH, last)
                    continue
                stop = min(stop, int(bounds[-1]))
                index = indices.part(at, stop).astype(np.int64)
                majors = low + np.searchsorted(bounds, np.arange(at, stop), "right") - 1
                values = data.part(at, stop).astype(np.float64)
                keep = (index >= lo) & (index <= hi)
                sides = {self.major: majors[keep], minor: index[keep]}
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(sides["row"].astype(np.int64)), pa.array(sides["col"].astype(np.int64)), pa.array(values[keep])], names=["row", "col", "value"])
                at = stop


class SparseMatrix(DataSource):
    """Options: path; rowFrom, rowTo, colFrom, colTo (both ends included); part, entries of a partition."""

    @classmethod
    def name(cls):
        return "sparse_matrix"

    def schema(self):
        return "row long, col long, value double"

    def reader(self, schema):
        return _MatrixReader(self.options)


class _ArrayReader(DataSourceReader):
    def __init__(self, options, schema):
        self.uri, self.step, self.schema = options["path"], int(options.get("part", PART)), schema

    def partitions(self):
        with stored(self.uri) as a:
            if a.by_column and len(a.shape) > 1:
                raise ValueError("arrays in column order are not read")
            n = a.shape[0]
        return [_Part((i, min(i + self.step, n))) for i in range(0, n, self.step)] or [_Part((0, 0))]

    def read(self, partition):
        begin, end = partition.value
        names = self.schema.fieldNames()
        with stored(self.uri) as a:
            width = len(names) - 1
            for at in range(begin, end, BATCH):
                stop = min(at + BATCH, end)
                rows = a.part(at * width, stop * width).reshape(-1, width)
                columns = [pa.array(np.arange(at, stop))]
                for i in range(width):
                    c = rows[:, i]
                    columns.append(pa.array([v.decode() for v in c.tolist()] if c.dtype.kind == "S" else c.tolist(), pa.string()) if c.dtype.kind in "SU" else pa.array(c.astype(np.int64 if c.dtype.kind in "iub" else np.float64)))
                yield pa.RecordBatch.from_arrays(columns, names=names)


class ArrayRows(DataSource):
    """The rows of a .npy array of one or two dimensions: idx from 0, then c0, c1, ..."""

    @classmethod
    def name(cls):
        return "array_rows"

    def schema(self):
        with stored(self.options["path"]) as a:
            if len(a.shape) not in (1, 2):
                raise ValueError(f"an array of {len(a.shape)} dimensions has no rows")
            kind = {"S": "string", "U": "string", "i": "long", "u": "long", "b": "long", "f": "double"}[a.dtype.kind]
            width = 1 if len(a.shape) == 1 else a.shape[1]
        return ", ".join(["idx long", *(f"c{i} {kind}" for i in range(width))])

    def reader(self, schema):
        return _ArrayReader(self.options, schema)


def read_sparse(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, part: int = PART) -> DataFrame:
    """O-17: (row, col, value) of a compressed-row or compressed-column archive, inside ranges of rows and columns, both ends included."""
    spark.dataSource.register(SparseMatrix)
    reader = spark.read.format("sparse_matrix").option("part", part)
    for name, ends in (("row", rows), ("col", cols)):
        if ends is not None:
            reader = reader.option(f"{name}From", int(ends[0])).option(f"{name}To", int(ends[1]))
    return reader.load(qualified(spark, path))


def sparse_shape(spark: SparkSession, path: str) -> tuple[int, int]:
    with stored(qualified(spark, path), "shape") as a:
        return tuple(int(v) for v in a.part(0, 2))


def read_array(spark: SparkSession, path: str, part: int = PART) -> DataFrame:
    spark.dataSource.register(ArrayRows)
    return spark.read.format("array_rows").option("part", part).load(qualified(spark, path))


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """(idx, value): the lines of a one-column file below its header, numbered from 0."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path).select(F.trim("value").alias("value"), place.alias("place"))
    return placed(lines, ["place"], "idx").select((F.col("idx") - 1).alias("idx"), "value").where("idx >= 0")


def load_bundle(spark: SparkSession, folder: str, x_range: tuple[float, float] | None = None, y_range: tuple[float, float] | None = None, pitch_um: float = 2.0) -> SpatialDataset:
    """O-17: spot_expr_genes_by_bins.npz, spot_coords_um.npy, spot_labels.npy, cell_ids.npy, gene_names.tsv and bin_ids.tsv of a folder.

    A window, both ends included, is one of the registered coordinates; x and y of a spot are its grid place times pitch_um (registration turns the grid a little, which
    would spoil bins), px and py the registered ones. Spots are numbered anew in their order, and so are the cells met in the window; cells (cell_id,
    original_id, cx, cy) have their mean registered place. An empty window, a window without cells, a label without an id and gene names that don't fit the matrix
    raise ValueError; a bin id of another form raises when its row is read."""
    ends = {"c0": x_range, "c1": y_range}
    coords = read_array(spark, f"{folder}/spot_coords_um.npy")
    for name, window in ends.items():
        if window is not None:
            coords = coords.where(F.col(name).between(*window))
    labels = read_array(spark, f"{folder}/spot_labels.npy").select("idx", F.col("c0").cast("long").alias("old"))
    kept = stage(placed(coords.join(labels, "idx"), ["idx"], "spot_id"), "bundle-spots")
    n, first, last, most = kept.agg(F.count("*"), F.min("idx"), F.max("idx"), F.max("old")).first()
    if not n:
        raise ValueError(f"the window x={x_range}, y={y_range} holds no spots")
    if most is None or most < 0:
        raise ValueError(f"the window x={x_range}, y={y_range} holds no cells")
    ids = read_array(spark, f"{folder}/cell_ids.npy").select(F.col("idx").alias("old"), F.col("c0").cast("string").alias("original_id"))
    numbers = stage(placed(kept.where("old >= 0").select("old").distinct(), ["old"], "cell_id"), "bundle-cells")
    if not numbers.join(ids, "old", "left_anti").isEmpty():
        raise ValueError("a label has no id in cell_ids.npy")
    genes = stage(_listed(spark, f"{folder}/gene_names.tsv").select(F.col("idx").alias("gene_id"), F.col("value").alias("gene_name")), "bundle-genes")
    matrix = f"{folder}/spot_expr_genes_by_bins.npz"
    if genes.count() != sparse_shape(spark, matrix)[0]:
        raise ValueError("gene_names.tsv and the matrix differ in their number of genes")
    grid = _listed(spark, f"{folder}/bin_ids.tsv").select("idx", grid_place(F.col("value")).alias("g"))
    labelled = kept.join(grid, "idx").join(numbers, "old", "left")
    spots = labelled.select("spot_id", (F.col("g.x") * F.lit(float(pitch_um))).alias("x"), (F.col("g.y") * F.lit(float(pitch_um))).alias("y"), F.coalesce("cell_id", F.lit(-1).cast("long")).alias("label"), F.col("c0").alias("px"), F.col("c1").alias("py"))
    spots = stage(spots, "bundle-places")
    entries = read_sparse(spark, matrix, cols=(first, last)).where("value <> 0")
    counts = entries.join(kept.select(F.col("idx").alias("col"), "spot_id"), "col").groupBy(F.col("row").alias("gene_id"), "spot_id").agg(F.sum("value").alias("n"))
    middles = spots.where("label >= 0").groupBy(F.col("label").alias("cell_id")).agg(F.avg("px").alias("cx"), F.avg("py").alias("cy"))
    cells = numbers.join(ids, "old").join(middles, "cell_id").select("cell_id", "original_id", "cx", "cy")
    return SpatialDataset(spots, counts, genes, cells)
