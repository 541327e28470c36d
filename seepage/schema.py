"""The data model: long (gene, location, count) tables; zeros are not stored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPOTS = T.StructType([T.StructField("spot_id", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("label", T.LongType())])
COUNTS = T.StructType([T.StructField("gene_id", T.LongType()), T.StructField("spot_id", T.LongType()), T.StructField("n", T.DoubleType())])
GENES = T.StructType([T.StructField("gene_id", T.LongType()), T.StructField("gene_name", T.StringType())])
CELLS = T.StructType([T.StructField("cell_id", T.LongType()), T.StructField("original_id", T.StringType())])


@dataclass
class SpatialDataset:
    """spots(spot_id, x, y, label < 0: outside cells), counts(gene_id, spot_id, n), and names."""

    spots: DataFrame
    counts: DataFrame
    genes: DataFrame | None = None
    cells: DataFrame | None = None
    report: DataFrame | None = None
