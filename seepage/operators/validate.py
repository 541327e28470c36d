"""O-22: the input contract, as one aggregate and one anti-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seepage.schema import SpatialDataset


def contract_counts(data: SpatialDataset) -> DataFrame:
    """One row: how many rows break each rule, and how many spots lie in and out of cells."""
    odd = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    label = F.col("label").cast("double")
    spots = data.spots.agg(
        F.count_if(odd("x") | odd("y")).alias("bad_coordinates"),
        F.count_if(F.col("label").isNull() | (label != F.floor(label))).alias("bad_labels"),
        F.count_if(F.col("label") >= 0).alias("in_cells"),
        F.count_if(F.col("label") < 0).alias("outside"),
    )
    counts = data.counts.agg(F.count_if(odd("n")).alias("bad_expression"), F.count_if(F.col("n") < 0).alias("negative"))
    orphans = data.counts.join(data.spots.select("spot_id"), "spot_id", "left_anti").agg(F.count("*").alias("orphans"))
    return spots.crossJoin(counts).crossJoin(orphans)


def check_inputs(data: SpatialDataset) -> None:
    """Raise ValueError at the first broken rule."""
    r = contract_counts(data).first()
    for bad, message in (
        (r.bad_expression, "expression must hold finite numbers"),
        (r.negative, "expression must be non-negative"),
        (r.orphans, "expression has spots without coordinates"),
        (r.bad_coordinates, "coordinates must be finite numbers"),
        (r.bad_labels, "labels must be integer-valued"),
        (not r.in_cells, "labels hold no cell"),
        (not r.outside, "labels hold no out-of-mask spot"),
    ):
        if bad:
            raise ValueError(message)
