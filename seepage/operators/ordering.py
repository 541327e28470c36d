"""Places, running sums and exact quantiles of large tables: no step sends all rows, or all of a group, to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seepage.storage import remove, stage

#: Distinct values of a group that one task orders; larger groups are narrowed first.
HELD = 500_000
#: Ranges of equal depth that a group is cut into each time.
RANGES = 64


def placed(df: DataFrame, order: list[str | Column], name: str = "pos", sums: dict[str, str] | None = None) -> DataFrame:
    """Adds name, the place of a row in an order from 0, and for each of sums (output name -> column) the sum over the rows before it.

    Rows are range-partitioned and sorted by the order, and staged with their partition's number and their place in it, so that a place needs no further
    shuffle; a row for each partition meets in one window. Running sums are taken inside partitions. The order has to tell all rows apart for a fixed result."""
    keys = [f"order_{i}_" for i in range(len(order))]
    keyed = df.withColumns({k: c if isinstance(c, Column) else F.col(c) for k, c in zip(keys, order)})
    # The number of a row counts up inside its partition, and the partition's number stands above it.
    part = stage(keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("row_", F.monotonically_increasing_id()), name)
    part = part.withColumns({"part_": F.shiftright("row_", 33), "in_": F.col("row_").bitwiseAND(F.lit((1 << 33) - 1))})
    sums = sums or {}
    totals = part.groupBy("part_").agg(F.count("*").alias("rows_"), *(F.sum(c).alias(f"{out}_all_") for out, c in sums.items()))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    base = lambda c, out: F.coalesce(F.sum(c).over(before), F.lit(0)).alias(out)
    bases = totals.select("part_", base("rows_", "base_"), *(base(f"{out}_all_", f"{out}_base_") for out in sums))
    done = part.join(F.broadcast(bases), "part_").withColumn(name, F.col("base_") + F.col("in_"))  # a row for each partition
    if sums:
        inside = Window.partitionBy("part_").orderBy("in_").rowsBetween(Window.unboundedPreceding, -1)
        done = done.withColumns({out: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"{out}_base_") for out, c in sums.items()})
    return done.select(*df.columns, F.col(name).cast("long"), *sums)


def numbered(df: DataFrame, key: list[str], name: str, first: str) -> DataFrame:
    """(key, name): distinct keys numbered from 0 by their smallest value of first, which no two keys share."""
    return placed(df.groupBy(*key).agg(F.min(first).alias("first_")), ["first_"], name).drop("first_")


def quantiles(df: DataFrame, by: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """(by, one column for each of qs): exact quantiles of the non-null values, interpolated linearly. Groups with a null in by are left out.

    Values are counted once and staged. A group of at most HELD distinct values is ordered in one task; larger ones are narrowed to the ranges that hold a wanted place first."""
    known = df.where(F.col(value).isNotNull()).where(" and ".join(f"`{c}` is not null" for c in by) or "true")
    counts = stage(known.groupBy(*by, F.col(value).cast("double").alias("v_")).agg(F.count("*").alias("c_")), "quantiles")
    largest = counts.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    group = by or [F.lit(0)]
    at = {name: F.lit(float(q)) * (F.col("n_") - 1) for name, q in qs.items()}
    if largest > HELD:
        return _narrowed(counts, by, at)
    ordered = counts.withColumns({"n_": F.sum("c_").over(Window.partitionBy(*group)), "upto_": F.sum("c_").over(Window.partitionBy(*group).orderBy("v_"))})
    here = lambda place: F.max(F.when((place >= F.col("upto_") - F.col("c_")) & (place < F.col("upto_")), F.col("v_")))
    share = lambda place: F.max(place - F.floor(place))
    return ordered.groupBy(*by).agg(*((here(F.floor(p)) + (here(F.ceil(p)) - here(F.floor(p))) * share(p)).alias(name) for name, p in at.items()))


def narrow(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """One cut of rows (keys, v_, c_) into ranges that hold about as many rows each; returned are the ranges that hold a place of wanted (keys, at_, ...),
    and the places inside them. keys ends with path_, the ranges chosen so far.

    The ranges' ends come from a mergeable sketch, so that no task sees a whole group, and a long tail or an outlier leaves no range much larger than the others."""
    steps = [i / RANGES for i in range(1, RANGES)]
    ends = rows.groupBy(*keys).agg(F.percentile_approx("v_", steps, RANGES * 32).alias("ends_"))
    cut = rows.join(ends, keys).withColumn("cut_", F.size(F.filter("ends_", lambda e: e < F.col("v_")))).drop("ends_")
    sums = cut.groupBy(*keys, "cut_").agg(F.sum("c_").alias("in_"))
    sums = sums.withColumn("before_", F.sum("in_").over(Window.partitionBy(*keys).orderBy("cut_")) - F.col("in_"))
    path = F.concat_ws(".", "path_", F.col("cut_").cast("string"))
    held = sums.join(wanted, keys).where("at_ >= before_ and at_ < before_ + in_")
    held = stage(held.withColumns({"path_": path, "at_": F.col("at_") - F.col("before_")}).select(*wanted.columns), "quantile-places")
    inside = cut.withColumn("path_", path).join(held.select(*keys).distinct(), keys, "left_semi")
    return stage(inside.select(*rows.columns), "quantile-ranges"), held


def _narrowed(counts: DataFrame, by: list[str], at: dict[str, Column]) -> DataFrame:
    keys = [*by, "path_"]
    rows = counts.withColumn("path_", F.lit(""))
    totals = rows.groupBy(*keys).agg(F.sum("c_").alias("n_"))
    places = [F.struct(F.lit(name).alias("q_"), F.lit(k).alias("end_"), f(p).cast("long").alias("at_"), (p - F.floor(p)).alias("share_")) for name, p in at.items() for k, f in enumerate((F.floor, F.ceil))]
    wanted = totals.select(*keys, F.explode(F.array(*places)).alias("p_")).select(*keys, "p_.*")
    while (rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > HELD:
        before, (rows, wanted) = rows, narrow(rows, wanted, keys)
        remove(before)
    upto = F.sum("c_").over(Window.partitionBy(*keys).orderBy("v_"))
    ordered = rows.withColumn("upto_", upto).withColumn("from_", F.col("upto_") - F.col("c_"))
    found = ordered.join(wanted, keys).where("at_ >= from_ and at_ < upto_")
    end = lambda name, k: F.max(F.when((F.col("q_") == name) & (F.col("end_") == k), F.col("v_")))
    share = lambda name: F.max(F.when(F.col("q_") == name, F.col("share_")))
    return found.groupBy(*by).agg(*((end(name, 0) + (end(name, 1) - end(name, 0)) * share(name)).alias(name) for name in at))
