"""Near-duplicate vectors: random-hyperplane sign hashing, exact cosine verification, components.

Equal vectors of a label form a class and count once with their number. Each class vector gets
TABLES signatures of BITS hyperplane signs; vectors that share a bucket of any table are compared
exactly, in double precision, in blocks: a bucket of more than BLOCK vectors is split into
blocks and every pair of blocks is compared by itself, so no comparison grows without bound and no pair is lost. A pair counts
in the first table that holds it. A comparison sends one row a vector (its links and its local
component), never its pairs. With cosine 0.98 a pair is missed with probability below 4e-4.

Vectors that are null, zero, or hold null or non-finite components, and vectors with a null label
or a null id, link with nothing. Vectors of other lengths are never compared. Rows that repeat an id
are vectors of their own with that id, each with its own links and component. Ids may be whole numbers or texts, labels of any type that has a text form. Extra columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seepage.llm.common import frugal, materialize, table
from seepage.llm.components import connected_components

TABLES = 16
BITS = 14
BLOCK = 512
SEED = 71


def signatures(x: np.ndarray) -> np.ndarray:
    """(vectors, TABLES) bucket numbers."""
    planes = np.random.default_rng([SEED, x.shape[1]]).standard_normal((x.shape[1], TABLES * BITS))
    signs = (x @ planes > 0).reshape(len(x), TABLES, BITS)
    return signs @ (1 << np.arange(BITS))


def _hash(batches):
    for batch in batches:
        vectors = batch.column("v").to_pylist()
        sizes = np.array([len(v) for v in vectors])
        sigs: list = [None] * len(vectors)
        for d in set(sizes.tolist()):
            at = np.flatnonzero(sizes == d)
            for i, s in zip(at.tolist(), signatures(np.array([vectors[i] for i in at], dtype=float)).tolist()):
                sigs[i] = s
        columns = [*batch.columns, pa.array(sigs, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "sigs"])


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the pairs (i, j)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


#: A bucket, or a pair of its blocks: label, length, table and signature, and the blocks.
KEYS = ("bucket", "bi", "bj")


def compare(rep: np.ndarray, n: np.ndarray, block: np.ndarray, x: np.ndarray, sigs: np.ndarray, t: int, apart: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, local roots, links) of a bucket's vectors, or of a pair of its blocks, that link with any."""
    order = np.argsort(rep)
    rep, n, block, x, sigs = rep[order], n[order], block[order], x[order], sigs[order]
    x = x / np.sqrt((x * x).sum(axis=1))[:, None]
    near = np.triu(x @ x.T >= threshold, 1)
    if apart:
        near &= block[:, None] != block[None, :]
    i, j = np.nonzero(near)
    if t and len(i):
        new = (sigs[i, :t] != sigs[j, :t]).all(axis=1)
        i, j = i[new], j[new]
    if not len(i):
        return rep[:0], rep[:0], n[:0]
    links = np.bincount(i, weights=n[j], minlength=len(x)) + np.bincount(j, weights=n[i], minlength=len(x))
    hit = links > 0
    return rep[hit], rep[local_roots(len(x), i, j)][hit], links[hit].astype(np.int64)


def _changes(table_: pa.Table) -> np.ndarray:
    """Whether a row's KEYS differ from those of the row before, from the second row on."""
    out = np.zeros(table_.num_rows - 1, bool)
    for k in KEYS:
        c = table_.column(k).combine_chunks()
        out |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return out


def _compare_sorted(threshold: float):
    """Takes rows sorted by KEYS, so that a bucket or a pair of blocks is a run of rows; one run is held at a time."""

    def run(batches):
        held: pa.Table | None = None

        def work(table_: pa.Table):
            table_ = table_.combine_chunks()
            cuts = [0, *(np.flatnonzero(_changes(table_)) + 1).tolist(), table_.num_rows]
            rep = table_.column("rep").to_numpy()
            n, block, t, bi, bj = (table_.column(c).to_numpy() for c in ("n", "block", "t", "bi", "bj"))
            v, sigs = table_.column("v").combine_chunks(), table_.column("sigs").combine_chunks()
            flat, at = v.flatten().to_numpy(), v.offsets.to_numpy() - v.offsets[0].as_py()
            sigs = sigs.flatten().to_numpy().reshape(-1, TABLES)
            found = []
            for a, b in zip(cuts, cuts[1:]):
                if b - a > 1:
                    found.append(compare(rep[a:b], n[a:b], block[a:b], flat[at[a] : at[b]].reshape(b - a, -1), sigs[a:b], int(t[a]), bi[a] != bj[a], threshold))
            out = [np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found) if found else ((), (), ()))]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b", "links"])

        for batch in batches:
            both = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not both.num_rows:
                continue
            changed = np.flatnonzero(_changes(both))
            last = int(changed[-1]) + 1 if len(changed) else 0
            if last:
                yield work(both.slice(0, last))
            held = both.slice(last)
        if held is not None and held.num_rows:
            yield work(held)

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vectors -> (id_col, n_links, component_id, kept), a row for each row."""
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    zero = F.forall("v", lambda c: c == 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & ~bad & ~zero, F.lit(False))
    rows = rows.withColumn("key", F.when(usable, F.sha2(F.concat_ws("|", F.col("label").cast("string"), F.array_join(F.transform("v", lambda c: (c + F.lit(0.0)).cast("string")), ",")), 256)))
    classes = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
    # A class has a number of its own: several classes may share their smallest id.
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    hashed = classes.select(F.col("node").alias("rep"), "n", F.col("label").cast("string").alias("label"), "v").mapInArrow(frugal(_hash), "rep long, n long, label string, v array<double>, sigs array<int>")
    buckets = hashed.select("rep", "n", "v", "sigs", "label", F.posexplode("sigs").alias("t", "sig"))
    buckets = buckets.withColumn("bucket", F.concat_ws("|", F.size("v").cast("string"), F.col("t").cast("string"), F.col("sig").cast("string"), "label")).drop("label", "sig")
    bucket = ["bucket", "t"]
    sizes = buckets.groupBy(*bucket).count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    placed = buckets.join(sizes, bucket).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = placed.select("*", other).select("rep", "n", "v", "sigs", *bucket, "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    runs = pairs.repartition(*KEYS).sortWithinPartitions(*KEYS)
    found = runs.mapInArrow(frugal(_compare_sorted(threshold)), "a long, b long, links long")
    found = materialize(found, "vector-links")
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.select("a", "b"))
    placed = materialize(classes.select("node", "rep").join(roots, "node").join(links, "node", "left"), "vector-roots")
    heads = placed.groupBy("root").agg(F.min("rep").alias("head"))
    placed = placed.join(heads, "root").select("node", "links", "head")
    classes = classes.select("key", "node", "rep", "n").join(placed, "node", "left")
    return (
        rows.select("id", "key")
        .join(classes, "key", "left")
        .select(
            F.col("id").alias(id_col),
            (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("n") - 1, F.lit(0))).cast("long").alias("n_links"),
            F.coalesce("head", "rep", "id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
    )


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id i, b.vec_id j FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r(i, j) AS (
  SELECT i, j FROM p UNION SELECT r.i, p.j FROM r JOIN p ON r.j = p.i
)
SELECT v.vec_id, CAST((SELECT count(*) FROM p WHERE p.i = v.vec_id) AS BIGINT) n_links,
  least(v.vec_id, coalesce((SELECT min(j) FROM r WHERE r.i = v.vec_id), v.vec_id)) component_id,
  v.vec_id = least(v.vec_id, coalesce((SELECT min(j) FROM r WHERE r.i = v.vec_id), v.vec_id)) kept
FROM v
"""
