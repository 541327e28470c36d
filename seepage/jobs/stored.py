"""Registered queries of what is kept on disk: window layouts and stored results, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seepage.jobs.evaluation import GENES, MORE, Tables, corr
from seepage.jobs.spatial import X_RANGE, Y_RANGE, Stages, r
from seepage.sources import layout, results
from seepage.storage import new_path

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
COLUMNS = "gene_id long, cell_id long, n double"


def query(name: str, sql: str):
    def put(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = MORE + sql
        return f

    return put


@query("o25_layout_window", f"SELECT gene_id, spot_id, n FROM counts JOIN spots USING (spot_id) WHERE x BETWEEN {X_RANGE[0]} AND {X_RANGE[1]} AND y BETWEEN {Y_RANGE[0]} AND {Y_RANGE[1]}")
def o25_layout_window(spark, sf_dir):
    """O-13, O-25: all counts laid out by the interleaved key, and a window read back."""
    path = new_path(spark, "layout")
    layout.save_layout(Stages(spark, sf_dir).data, path)
    return layout.read_layout(spark, path, X_RANGE, Y_RANGE).counts


def _store(t: Tables) -> results.ResultStore:
    """Raw and corrected expression, each made once; the second call of ensure finds both there."""
    spark = t.get("cells").sparkSession
    store = results.ResultStore(spark, new_path(spark, "results"), COLUMNS)
    mark = results.fingerprint({"genes": GENES}, t.get("cell_expr"))
    wanted = spark.createDataFrame([("orders", "whole", m, mark) for m in ("raw", "fixed")], "dataset string, window string, method string, fingerprint string")
    make = {"raw": lambda: t.get("cell_expr"), "fixed": t.fixed}
    for left in (2, 0):
        if len(store.ensure(wanted, lambda d, w, m: make[m]())) != left:
            raise RuntimeError("a result was made again, or not at all")
    return store


@query("o144_results_store", "SELECT 'orders' dataset, 'whole' \"window\", 'fixed' \"method\", gene_id, cell_id, n FROM fixed")
def o144_results_store(spark, sf_dir):
    """O-143, O-144: results discovered by method and read back with their keys."""
    return _store(Tables(spark, sf_dir)).load("orders", methods=["fixed"])


@query("o145_reused_metrics", f""", doubled AS (SELECT gene_id, cell_id, n * (1 + gene_id % 2) n FROM cell_expr),
v AS (SELECT 'truth' k, gene_id, cell_id, ln(1 + n / greatest(sum(n) OVER (PARTITION BY cell_id), 1) * 1e4) v FROM cell_expr
  UNION ALL SELECT 'doubled', gene_id, cell_id, ln(1 + n / greatest(sum(n) OVER (PARTITION BY cell_id), 1) * 1e4) FROM doubled
  UNION ALL SELECT 'fixed', gene_id, cell_id, ln(1 + n / greatest(sum(n) OVER (PARTITION BY cell_id), 1) * 1e4) FROM fixed),
e AS (SELECT a.k, sqrt(sum(power(a.v - b.v, 2)) / ((SELECT count(*) FROM cells) * {GENES})) rmse FROM v a JOIN v b USING (gene_id, cell_id) WHERE b.k = 'truth' GROUP BY 1)
SELECT m method, round(e.rmse, 6) rmse, round(100 * (1 - e.rmse / (SELECT rmse FROM e WHERE k = 'doubled')), 6) reduction_pct,
  round(CASE WHEN m = 'raw' THEN (SELECT avg(1.0) FROM pear WHERE {GENES} * syy - sy * sy > 1e-12 * greatest({GENES} * syy, 1e-300)) ELSE (SELECT avg(least(power({corr('n')}, 2), 1)) FROM pear) END, 6) r2_mean
FROM e JOIN (VALUES ('truth', 'raw'), ('fixed', 'fixed')) n(k, m) USING (k)""")
def o145_reused_metrics(spark, sf_dir):
    """O-145: errors of the stored results against the raw table, whose odd genes count twice on the side to be improved on."""
    t = Tables(spark, sf_dir)
    doubled = t.get("cell_expr").withColumn("n", F.col("n") * (1 + F.col("gene_id") % 2))
    found = results.reused_metrics(_store(t), "orders", "whole", t.get("cell_expr"), doubled, t.get("cells").select("cell_id"), GENES)
    return found.select("method", *(r(c).alias(c) for c in ("rmse", "reduction_pct", "r2_mean")))
