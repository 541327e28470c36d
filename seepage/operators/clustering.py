"""Truncated singular vectors, principal components, clusters and how well labels part vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seepage.storage import remove, stage

#: Vectors of a block that meets every other block, at most; blocks hold at most NUMBERS numbers, and at most SUMS sums by label if they hold more than SUMMED vectors.
BLOCK = 32_768
NUMBERS, SUMS, SUMMED = 1 << 22, 1 << 22, 4096
#: Vectors that are compared with as many others at a time.
SLAB = 512
#: Numbers of a stored row of vectors, about: a reader's batch holds thousands of rows.
ROW = 512
#: Vectors of a block at least, where smaller blocks would only give more tasks.
LEAST = 2048
#: Squared distances below this share of the squared lengths are taken from differences.
NEAR = 1e-3


def cell_vectors(values: DataFrame, genes: DataFrame) -> DataFrame:
    """(cell_id, v array<double>): a cell's values over the given genes (gene_id), in their order, zeros included. Take few genes: those of largest variance."""
    order = genes.agg(F.sort_array(F.collect_list("gene_id")).alias("order_"))  # as long as the list of genes that was given
    held = values.join(genes.select("gene_id"), "gene_id", "left_semi").groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("gene_id", "v"))).alias("held_"))
    return held.crossJoin(F.broadcast(order)).select("cell_id", F.transform("order_", lambda g: F.coalesce(F.try_element_at("held_", g), F.lit(0.0))).alias("v"))


def principal_components(vectors: DataFrame, key: str, k: int) -> DataFrame:
    """O-91: (key, v): the first k principal components of centred vectors."""
    ready = vectors.select(key, array_to_vector("v").alias("features"))
    model = PCA(k=k, inputCol="features", outputCol="parts").fit(ready)
    return model.transform(ready).select(key, vector_to_array("parts").alias("v"))


def _gauss(key: Column, i: int, seed: int) -> Column:
    """A normal number from a digest of key, i and seed."""
    u = lambda salt: (F.pmod(F.xxhash64(key, F.lit(i), F.lit(seed), F.lit(salt)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.ln(u(0))) * F.cos(2 * F.pi() * u(1))


def _product(values: DataFrame, vectors: DataFrame, over: str, out: str, width: int) -> DataFrame:
    """(out, v): for each out the sum over `over` of value times vector; vectors (over, v). Sums are made before the shuffle."""
    sums = [F.sum(F.col("value_") * F.get("v", F.lit(i))).alias(f"s{i}") for i in range(width)]
    return values.join(vectors, over).groupBy(out).agg(*sums).select(out, F.array(*(f"s{i}" for i in range(width))).alias("v"))


def _gram(vectors: DataFrame, width: int) -> np.ndarray:
    """Sum of v v^T: width x width numbers from each task, added up by entry."""

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(-1, width)
            total += x.T @ x
        yield pa.record_batch({"i": pa.array(np.arange(width * width)), "x": pa.array(total.ravel())})

    out = np.zeros(width * width)
    for r in vectors.select("v").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[r.i] = r.x
    return out.reshape(width, width)


def _times(vectors: DataFrame, key: str, m: np.ndarray) -> DataFrame:
    """(key, v m); m is small."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1) @ m
                ends = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=[key, "v"])

    return vectors.select(key, "v").mapInArrow(run, f"`{key}` {vectors.schema[key].dataType.simpleString()}, v array<double>")


def _whitener(gram: np.ndarray) -> np.ndarray:
    """m with m^T gram m = 1 on the directions that hold anything; the others become 0."""
    size, turn = np.linalg.eigh(gram)
    scale = np.where(size > max(size.max(), 0) * 1e-12, 1 / np.sqrt(np.maximum(size, 1e-300)), 0.0)
    return turn * scale


def truncated_svd(values: DataFrame, key: str, feature: str, value: str, k: int, extra: int = 10, rounds: int = 2, seed: int = 42) -> tuple[DataFrame, list[float]]:
    """O-91: ((key, v), singular values): each key's first k components of the whole sparse table (key, feature, value), not centred, by a randomised range finder.

    Features draw k + extra normal numbers each; the table times these, turned back and forth `rounds` times and made orthonormal each time, spans the
    range of the largest components. Tables of k + extra numbers for each key or feature are staged; only matrices of (k + extra)^2 numbers reach the driver. Keys without rows have no
    vector; fewer components than k come with zeros. Signs are free, as of any singular vectors."""
    width = k + extra
    entries = stage(values.select(F.col(key).alias("k_"), F.col(feature).alias("f_"), F.col(value).cast("double").alias("value_")).where("value_ <> 0 and k_ is not null and f_ is not null"), "svd-entries")
    start = entries.select("f_").distinct().select("f_", F.array(*(_gauss(F.col("f_"), i, seed) for i in range(width))).alias("v"))
    made = [stage(start, "svd-features")]

    def held(df: DataFrame, name: str) -> DataFrame:
        made.append(stage(df, name))
        return made[-1]

    def orthonormal(df: DataFrame, by: str) -> DataFrame:
        df = held(df, "svd-turned")
        return _times(df, by, _whitener(_gram(df, width)))

    basis = orthonormal(_product(entries, made[0], "f_", "k_", width), "k_")
    for _ in range(rounds):
        turned = orthonormal(_product(entries, basis, "k_", "f_", width), "f_")
        basis = orthonormal(_product(entries, turned, "f_", "k_", width), "k_")
    basis = held(orthonormal(basis, "k_"), "svd-basis")  # once more, for what rounding left of the first time
    small = _gram(held(_product(entries, basis, "k_", "f_", width), "svd-small"), width)
    size, turn = np.linalg.eigh(small)
    order = np.argsort(-size)[:k]
    sigma = np.sqrt(np.maximum(size[order], 0.0))
    out = stage(_times(basis, "k_", turn[:, order] * sigma).withColumnRenamed("k_", key), "svd")
    for df in [entries, *made]:
        remove(df)
    return out, sigma.tolist()


def clusters(vectors: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """O-91: (key, cluster) by k-means."""
    ready = vectors.select(key, array_to_vector("v").alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=50, featuresCol="features", predictionCol="cluster").fit(ready)
    return model.transform(ready).select(key, "cluster")


def _labelled(vectors: DataFrame, label: str) -> DataFrame:
    """(own, v) of the vectors with a known label."""
    known = vectors.where(F.col(label).isNotNull() & F.col("v").isNotNull() & ~F.col(label).cast("string").isin("", "Unknown", "nan", "None"))
    return known.select(F.col(label).alias("own"), F.transform("v", lambda x: x.cast("double")).alias("v"))


def silhouette(vectors: DataFrame, label: str) -> DataFrame:
    """O-91: one row (score, n): mean silhouette of labelled vectors v under squared Euclidean distance; a vector alone in its label counts 0.

    The mean squared distance of a vector to a label's vectors follows from the label's mean vector and mean squared length, so that no pairs of vectors are made.
    Labels are few; rows with a null label or vector, and unknown labels, are left out."""
    known = _labelled(vectors, label).withColumn("row", F.monotonically_increasing_id()).withColumn("q", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    dims = known.select("own", F.posexplode("v").alias("d", "x")).groupBy("own", "d").agg(F.avg("x").alias("m"))
    means = dims.groupBy("own").agg(F.sort_array(F.collect_list(F.struct("d", "m"))).alias("s"))  # as long as a vector
    sizes = known.groupBy("own").agg(F.count("*").alias("n"), F.avg("q").alias("mq"))
    centres = means.join(sizes, "own").select(F.col("own").alias("other"), "n", "mq", F.transform("s", lambda e: e["m"]).alias("m"))
    met = known.crossJoin(F.broadcast(centres))  # every vector with each of the few labels
    dot = F.aggregate(F.zip_with("v", "m", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    met = met.withColumn("total", F.greatest(F.col("q") + F.col("mq") - 2 * dot, F.lit(0.0)) * F.col("n")).withColumn("copies", F.lit(1))
    return _score(met, "row")


def _score(met: DataFrame, *row: str) -> DataFrame:
    """One row (score, n) of rows (row, own, other, n, total, copies): the total distance of each vector to the n vectors of each label, for copies equal vectors."""
    own = F.col("own") == F.col("other")
    each = met.groupBy(*row).agg(
        F.max(F.when(own, F.col("total") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("a"),
        F.max(F.when(own, F.col("n"))).alias("n"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"),
        F.max("copies").alias("copies"),
    )
    s = F.when((F.col("n") > 1) & (F.greatest("a", "b") > 0), (F.col("b") - F.col("a")) / F.when(F.greatest("a", "b") > 0, F.greatest("a", "b"))).otherwise(0.0)
    n = F.sum("copies")
    return each.where("b is not null").agg((F.sum(s * F.col("copies")) / n).alias("score"), F.coalesce(n, F.lit(0)).alias("n"))


def _slabs(rows: pa.Table, size: int) -> pa.Table:
    """A block's vectors in the order of their labels: (block, slab, part, labels, copies, v), `size` vectors a slab, few a part, with their numbers one behind the other."""
    label, copies = rows.column("label").to_numpy(), rows.column("copies").to_numpy()
    v = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    v = v.reshape(len(label), len(v) // len(label))
    order, block = np.argsort(label, kind="stable"), rows.column("block")[0].as_py()
    few = max(1, ROW // max(1, v.shape[1]))
    cuts = [(a, b) for a in range(0, len(order), size) for b in range(a, min(a + size, len(order)), few)]
    ends = np.array([b for _, b in cuts] + [len(order)])
    lists = lambda x, width=1: pa.ListArray.from_arrays(pa.array(ends * width, pa.int32()), pa.array(x[order].ravel()))
    return pa.table(
        {
            "block": pa.array(np.full(len(cuts), block), pa.int32()),
            "slab": pa.array([(block << 32) + a // size for a, _ in cuts], pa.int64()),
            "part": pa.array([b - a for a, b in cuts], pa.int32()),
            "labels": lists(label),
            "copies": lists(copies),
            "v": lists(v, v.shape[1]),
        }
    )


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of each row of x to each of y.

    Squares are |x|^2 - 2xy + |y|^2 about the middle of both, one matrix product. Those that are small beside the squared lengths, where digits would cancel, and those
    that are not finite are summed from differences by dimension."""
    width = x.shape[1]
    middle = (x.mean(axis=0) + y.mean(axis=0)) / 2
    left, right = np.ones((len(x), width + 2)), np.ones((len(y), width + 2))
    a, b = left[:, :width], right[:, :width]
    np.subtract(x, middle, out=a)
    np.subtract(y, middle, out=b)
    p, q = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    left[:, width] = p
    right[:, width + 1] = q
    b *= -2
    d2 = left @ right.T
    if not d2.min(initial=np.inf) > NEAR * (p.max(initial=0) + q.max(initial=0)):
        i, j = np.nonzero(~(d2 > NEAR * (p[:, None] + q)))
        step = max(1, (1 << 20) // max(1, width))
        for k in range(0, len(i), step):
            gap = x[i[k : k + step]] - y[j[k : k + step]]
            d2[i[k : k + step], j[k : k + step]] = np.einsum("ij,ij->i", gap, gap)
    return np.sqrt(d2, out=d2)


def _distance_sums(rows: pa.Table) -> pa.Table:
    """Of the slabs of a pair of blocks: (slab, other, total), the sums of distances of each vector of a slab of one block to the vectors of a label of the other block.

    A pair of slabs is compared once, for the sums of both; a block that meets itself gives each vector's sums once."""
    rows = rows.sort_by([("slab", "ascending"), ("part", "ascending")])
    met = [rows.column(end)[0].as_py() for end in ("bi", "bj")]
    flat = lambda name: rows.column(name).combine_chunks().flatten().to_numpy()
    label, copies, v = flat("labels"), flat("copies").astype(float), flat("v")
    v = v.reshape(len(label), len(v) // len(label))
    slab, first = np.unique(np.repeat(rows.column("slab").to_numpy(), pc.list_value_length(rows.column("labels")).to_numpy()), return_index=True)
    known, times, x = (dict(enumerate(np.split(all_, first[1:]))) for all_ in (label, copies, v))
    sides = [np.flatnonzero(slab >> 32 == end) for end in met]
    names = [np.unique(np.concatenate([known[i] for i in side])) if len(side) else np.zeros(0, np.int32) for side in sides]
    runs = {}  # (from, to, place of the label in its block) of a slab's labels
    for side, of in zip(sides, names):
        for i in side:
            ends = np.flatnonzero(np.diff(known[i], append=-1)) + 1
            runs[i] = list(zip([0, *ends[:-1]], ends, np.searchsorted(of, known[i][ends - 1])))
    others = {i: of for side, of in zip(sides, names[::-1]) for i in side}
    total = {i: np.zeros((len(of), len(known[i]))) for i, of in others.items()}
    for i in sides[0]:
        for j in sides[1] if met[0] != met[1] else sides[1][sides[1] >= i]:
            d = _distances(x[i], x[j])
            for a, b, k in runs[j]:
                total[i][k] += d[:, a:b] @ times[j][a:b]
            if i != j:
                for a, b, k in runs[i]:
                    total[j][k] += times[i][a:b] @ d[a:b]
    ends = np.cumsum([0, *(len(known[i]) for i, of in others.items() for _ in of)])
    sums = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([t.ravel() for t in total.values()])))
    slab = np.concatenate([np.repeat(slab[i], len(of)) for i, of in others.items()])
    return pa.table({"slab": pa.array(slab, pa.int64()), "other": pa.array(np.concatenate(list(others.values())), pa.int32()), "total": sums})


def euclidean_silhouette(vectors: DataFrame, label: str) -> DataFrame:
    """O-91: one row (score, n): mean silhouette of labelled vectors v (of one length) under Euclidean distance; a vector alone in its label counts 0.

    True distances don't follow from means, so that every vector meets every other. Equal vectors of a label are taken once, with their number; the others are dealt to blocks, each pair of
    blocks is one task's group, and what leaves it is a sum for each vector and label. Labels are few; rows with a null label or vector, and unknown labels, are left out."""
    known = stage(_labelled(vectors, label).groupBy("own", "v").agg(F.count("*").alias("copies")), "silhouette")
    names = known.groupBy("own").agg(F.sum("copies").alias("n"))
    names = stage(names.withColumn("label", (F.row_number().over(Window.orderBy("own")) - 1).cast("int")), "silhouette-labels")  # a row for each label
    n, least, width = known.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if least != width:
        raise ValueError(f"vectors of {least} and of {width} numbers")
    size = min(BLOCK, max(SLAB, NUMBERS // max(1, width or 0)), max(SUMMED, SUMS // max(1, names.count())))
    tasks = known.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // size), min(-(-n // LEAST), int((16 * tasks) ** 0.5) + 1))  # pairs of blocks for several rounds of tasks
    dealt = known.join(F.broadcast(names.select("own", "label")), "own").withColumn("block", F.pmod(F.xxhash64("v", "label"), F.lit(blocks)).cast("int"))
    slab = SLAB
    slabs = dealt.select("block", "label", "copies", "v").groupBy("block").applyInArrow(lambda rows: _slabs(rows, slab), "block int, slab long, part int, labels array<int>, copies array<long>, v array<double>")
    slabs = stage(slabs, "silhouette-slabs")
    remove(known)
    met = slabs.withColumn("met", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = met.select("slab", "part", "labels", "copies", "v", F.least("block", "met").alias("bi"), F.greatest("block", "met").alias("bj"))
    # Four times as many partitions as pairs, so that few hold more than one.
    sums = pairs.repartition(min(2 * blocks * (blocks + 1), 8192), "bi", "bj").groupBy("bi", "bj").applyInArrow(_distance_sums, "slab long, other int, total array<double>")
    # Sums move by slab, before they become a row for each vector.
    parts = slabs.groupBy("slab").agg(F.sort_array(F.collect_list(F.struct("part", "labels", "copies"))).alias("p")).select("slab", F.flatten("p.labels").alias("labels"), F.flatten("p.copies").alias("copies"))
    met = sums.repartition("slab").join(parts, "slab").select("slab", "other", F.posexplode(F.arrays_zip("total", "labels", "copies")).alias("pos", "e"))
    met = met.groupBy("slab", "pos", F.col("e.labels").alias("own"), F.col("e.copies").alias("copies"), "other").agg(F.sum("e.total").alias("total"))
    met = met.join(F.broadcast(names.select(F.col("label").alias("other"), "n")), "other")
    return _score(met, "slab", "pos")
