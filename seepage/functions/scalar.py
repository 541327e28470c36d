"""Scalar functions of expression values, identifiers and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seepage.operators.aggregate import clip

#: Fixed value: names of ribosomal and mitochondrial genes.
HOUSEKEEPING = r"^(Rp[lsp]|Rps|Rpl|Mt-|MT-|mt-|RP[LS]|MT)"


def log_cp10k(value: Column, library: Column) -> Column:
    """O-70: log1p of counts per ten thousand; libraries under 1 count as 1, negative values as 0."""
    return F.log1p(clip(value) / F.greatest(library, F.lit(1.0)) * 1e4)


def log_cp10k_zero_safe(value: Column, library: Column) -> Column:
    """O-70, the other form: only an empty library counts as 1."""
    return F.log1p(clip(value) / F.when(library == 0, F.lit(1.0)).otherwise(library) * 1e4)


def log2_fold_change(a: Column, b: Column, pseudocount: float = 0.01) -> Column:
    """O-71."""
    return F.log2((a + pseudocount) / (b + pseudocount))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(a, b)


def parse_tag(tag: Column) -> Column:
    """O-74: struct of dataset and window bounds of 'name_x1-2_y3-4'; null without such an end."""
    #: Fixed value: the form of a tag.
    pattern = r"^(.*)_x(\d+)-(\d+)_y(\d+)-(\d+)$"
    part = lambda i: F.regexp_extract(tag, pattern, i)
    names = ("x0", "x1", "y0", "y1")
    return F.when(tag.rlike(pattern), F.struct(part(1).alias("dataset"), *(part(i + 2).cast("int").alias(n) for i, n in enumerate(names))))


def is_housekeeping(gene: Column) -> Column:
    """O-74."""
    return gene.rlike(HOUSEKEEPING)


def annotation_of(label: Column) -> Column:
    """O-15: the text before the last underscore, other underscores as hyphens."""
    head = F.when(F.instr(label, "_") > 0, F.regexp_extract(label, r"^(.*)_[^_]*$", 1)).otherwise(label)
    return F.replace(head, F.lit("_"), F.lit("-"))


def syntactic_name(name: Column) -> Column:
    """O-76: other characters than letters, digits, dot and underscore as dots; X before a bad start. Repeats are numbered by unique_names."""
    clean = F.regexp_replace(name, r"[^A-Za-z0-9._]", ".")
    return F.when(clean.rlike(r"^([A-Za-z]|\.(?![0-9]))"), clean).otherwise(F.concat(F.lit("X"), clean))


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """O-76: the syntactic form of a name column, repeats numbered .1, .2, ... in order; a number whose name is taken already is passed over.

    Rows of one name meet in a window, so names should repeat seldom."""
    clean = df.withColumn(name, syntactic_name(F.col(name)))
    taken = clean.select(F.col(name).alias("taken_")).distinct()
    w = Window.partitionBy(name).orderBy(order)
    ranked = clean.withColumn("k_", F.row_number().over(w) - 1)
    repeats = ranked.where("k_ > 0").groupBy(name).agg(F.max("k_").alias("most_"))
    # Of the suffixes 1 .. most + number of taken ones, those that no name has.
    tried = repeats.withColumn("suffix_", F.explode(F.sequence(F.lit(1), 2 * F.col("most_") + 8)))
    free = tried.join(taken, F.concat(F.col(name), F.lit("."), F.col("suffix_").cast("string")) == F.col("taken_"), "left_anti")
    free = free.withColumn("k_", F.row_number().over(Window.partitionBy(name).orderBy("suffix_"))).select(name, "k_", "suffix_")
    named = ranked.join(free, [name, "k_"], "left")
    return named.withColumn(name, F.when(F.col("k_") == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit("."), F.col("suffix_").cast("string")))).select(*df.columns)


def grid_of(bin_id: Column) -> Column:
    """O-17, O-75: struct (x, y) of ids like s_002um_<x>_<y>-1, twice their grid numbers; other ids raise."""
    pattern = r"^s_002um_(\d+)_(\d+)(-.*)?$"
    at = lambda i: F.regexp_extract(bin_id, pattern, i).cast("double") * 2
    bad = F.raise_error(F.concat(F.lit("unexpected bin id: "), F.coalesce(bin_id, F.lit("null"))))
    return F.when(bin_id.rlike(pattern), F.struct(at(1).alias("x"), at(2).alias("y"))).otherwise(bad)


#: Fixed value: the form of a bin id, with its places along x and y.
BIN_ID = r"^s_002um_(\d+)_(\d+)-[^_]*$"


def grid_place(bin_id: Column) -> Column:
    """O-17: struct (x, y) of the grid place that a bin id names; any other text raises, null gives null."""
    whole = lambda i: F.regexp_extract(bin_id, BIN_ID, i).cast("long")
    bad = F.raise_error(F.concat(F.lit("a bin id of another form: "), bin_id))
    return F.when(bin_id.rlike(BIN_ID), F.struct(whole(1).alias("x"), whole(2).alias("y"))).when(bin_id.isNotNull(), bad)
