"""A store of results by data set, window and method, with a manifest that tells what has to be made again."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seepage.operators import metrics
from seepage.sources import publish

KEYS = ["dataset", "window", "method"]
MANIFEST = "dataset string, window string, method string, fingerprint string, run string, error string"
TRIES = 5


def fingerprint(parameters: dict, *inputs: DataFrame) -> str:
    """A digest of parameters and of the rows of all inputs, whatever their order. It changes with any of them."""
    seen = []
    for df in inputs:
        sums = [F.count("*").alias("n"), *(F.sum(F.xxhash64(F.lit(seed), *df.columns).cast("decimal(38,0)")).alias(f"s{seed}") for seed in (1, 2))]
        seen.append([sorted(df.columns), *(str(v) for v in df.agg(*sums).first())])
    return hashlib.sha256(json.dumps([parameters, seen], sort_keys=True, default=str).encode()).hexdigest()


class ResultStore:
    """root/data/dataset=/window=/method=/run= as Parquet, and root/manifest, published version by version.

    A result counts from the moment a manifest that names its run is published, so a writer that dies leaves nothing that is read, and a result is
    replaced whole. The manifest has a row for each result. columns: the results' own columns, one schema for the store. Keys are non-null texts."""

    def __init__(self, spark: SparkSession, root: str, columns: str):
        self.spark, self.root, self.columns = spark, root.rstrip("/"), columns
        self.schema = T.StructType.fromDDL(f"{columns}, dataset string, window string, method string, run string")

    def manifest(self) -> DataFrame:
        """O-144: (dataset, window, method, fingerprint, run, error) of every result."""
        found = publish.published(self.spark, f"{self.root}/manifest")
        return self.spark.createDataFrame([], MANIFEST) if found is None else found

    def discover(self, dataset: str | None = None, window: str | None = None, methods: Iterable[str] | None = None) -> DataFrame:
        """O-144: the manifest's results without an error."""
        found = self.manifest().where("error is null")
        for name, value in (("dataset", dataset), ("window", window)):
            if value is not None:
                found = found.where(F.col(name) == value)
        return found if methods is None else found.where(F.col("method").isin(list(methods)))

    def load(self, dataset: str | None = None, window: str | None = None, methods: Iterable[str] | None = None) -> DataFrame:
        """The rows of the results found, with their keys; only their partitions are read."""
        found = self.discover(dataset, window, methods).collect()  # a row for each result
        if not found:
            return self.spark.createDataFrame([], T.StructType([f for f in self.schema if f.name != "run"]))
        rows = self.spark.read.schema(self.schema).parquet(f"{self.root}/data").where(F.col("run").isin([r.run for r in found]))
        for name in KEYS:
            rows = rows.where(F.col(name).isin(sorted({r[name] for r in found})))
        return rows.drop("run")

    def pending(self, wanted: DataFrame) -> DataFrame:
        """Of wanted (dataset, window, method, fingerprint) those without a result of that fingerprint."""
        return wanted.join(self.discover().select(*KEYS, "fingerprint"), [*KEYS, "fingerprint"], "left_anti")

    def put(self, rows: DataFrame, dataset: str, window: str, method: str, mark: str) -> None:
        """Keep rows as the result of a key, in place of the one before. Rows of other columns raise."""
        own = T.StructType.fromDDL(self.columns)
        if sorted(rows.columns) != sorted(own.names):
            raise ValueError(f"a result has columns {rows.columns}, the store {own.names}")
        run = uuid.uuid4().hex
        keyed = rows.select(*(F.col(f.name).cast(f.dataType) for f in own), F.lit(dataset).alias("dataset"), F.lit(window).alias("window"), F.lit(method).alias("method"), F.lit(run).alias("run"))
        keyed.write.mode("append").partitionBy(*KEYS, "run").parquet(f"{self.root}/data")
        self._name((dataset, window, method, mark, run, None))

    def fail(self, dataset: str, window: str, method: str, mark: str, error: str) -> None:
        """Keep that a method failed: an older result of the key does not stand for it any more."""
        self._name((dataset, window, method, mark, None, error))

    def _name(self, row: tuple) -> None:
        for left in reversed(range(TRIES)):
            known = publish.versions(self.spark, f"{self.root}/manifest")
            fresh = self.spark.createDataFrame([row], MANIFEST)
            others = self.manifest().join(F.broadcast(fresh.select(*KEYS)), KEYS, "left_anti").select(*fresh.columns)
            try:
                publish.publish(others.unionByName(fresh).coalesce(1), f"{self.root}/manifest", after=known[-1][0] if known else 0)
                return
            except publish.Conflict:
                if not left:
                    raise

    def ensure(self, wanted: DataFrame, make: Callable[[str, str, str], DataFrame]) -> list[tuple[str, str, str]]:
        """O-143: make and keep what is pending, key by key, and return those keys. A method that raises is kept as failed, and tried again next time."""
        done = []
        for r in self.pending(wanted).orderBy(*KEYS).collect():  # a row for each result
            key = (r.dataset, r.window, r.method)
            try:
                self.put(make(*key), *key, r.fingerprint)
            except publish.Conflict:
                raise
            except Exception as e:
                self.fail(*key, r.fingerprint, f"{type(e).__name__}: {e}"[:2000])
            done.append(key)
        return done


def reused_metrics(store: ResultStore, dataset: str, window: str, truth: DataFrame, raw: DataFrame, cells: DataFrame, n_genes: int) -> DataFrame:
    """O-145: (method, rmse, reduction_pct, r2_mean) of the stored results of (gene_id, cell_id, n), without running a method again.

    truth and raw: (gene_id, cell_id, n); cells: (cell_id) of the data. A stored result with a gene or a cell of other data raises ValueError; failed methods have no row."""
    elements = cells.count() * n_genes
    out = []
    for (method,) in store.discover(dataset, window).select("method").orderBy("method").collect():  # a row for each method
        rows = store.load(dataset, window, [method]).select("gene_id", "cell_id", "n")
        other = rows.where(~F.col("gene_id").between(0, n_genes - 1)).select("cell_id").union(rows.select("cell_id").join(cells, "cell_id", "left_anti"))
        if not other.isEmpty():
            raise ValueError(f"the stored result of {method} is of other data")
        change = metrics.rmse_change(raw, rows, truth, cells, elements).select(F.lit(method).alias("method"), F.col("fixed").alias("rmse"), F.col("reduction").alias("reduction_pct"))
        out.append(change.crossJoin(metrics.cell_r2(rows, truth, n_genes).agg(F.avg("r2").alias("r2_mean"))))
    return reduce(DataFrame.unionByName, out) if out else store.spark.createDataFrame([], "method string, rmse double, reduction_pct double, r2_mean double")
