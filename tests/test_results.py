import pytest
from pyspark.sql import functions as F

from seepage.sources import publish, results, sinks

COLUMNS = "gene_id long, cell_id long, n double"


def rows(spark, *values):
    return spark.createDataFrame(list(values), COLUMNS)


def test_readers_see_the_version_before_until_the_rename(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    assert publish.published(spark, path) is None and publish.publish(rows(spark, (0, 0, 1.0)), path) == 1

    def dies(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(publish, "commit", dies)
    with pytest.raises(KeyboardInterrupt):
        publish.publish(rows(spark, (0, 0, 9.0)), path)
    monkeypatch.undo()
    assert [r.n for r in publish.published(spark, path).collect()] == [1.0]
    assert publish.publish(rows(spark, (0, 0, 2.0)), path) == 2
    with pytest.raises(publish.Conflict):
        publish.publish(rows(spark, (0, 0, 3.0)), path, after=1)
    assert [r.n for r in publish.published(spark, path).collect()] == [2.0] and publish.published(spark, path, 1).first().n == 1.0
    assert publish.vacuum(spark, path, keep=1) == 3
    assert [n for n, _ in publish.versions(spark, path)] == [2] and publish.published(spark, path).first().n == 2.0


@pytest.mark.parametrize("dies_at", [1, 2])
def test_metrics_outlive_a_writer(spark, tmp_path, monkeypatch, dies_at):
    path = f"{tmp_path}/j"
    one = lambda m, v: spark.createDataFrame([(m, v)], "method string, v double")
    sinks.save_metrics(one("a", 1.0), path, "method")
    moves, real = [], publish._move

    def move(*args):
        moves.append(args)
        if len(moves) == dies_at:
            raise KeyboardInterrupt
        real(*args)

    monkeypatch.setattr(publish, "_move", move)
    with pytest.raises(KeyboardInterrupt):
        sinks.save_metrics(one("b", 2.0), path, "method")
    monkeypatch.undo()
    assert [tuple(r) for r in sinks.load_metrics(spark, path).select("method", "v").collect()] == [("a", 1.0)]
    sinks.save_metrics(one("c", 3.0), path, "method")
    assert {(r.method, r.v) for r in sinks.load_metrics(spark, path).collect()} == {("a", 1.0), ("c", 3.0)}


def test_a_second_run_makes_nothing(spark, tmp_path):
    store = results.ResultStore(spark, f"{tmp_path}/s", COLUMNS)
    assert store.load().count() == 0 and store.manifest().count() == 0
    made = []

    def make(dataset, window, method):
        made.append((dataset, window, method))
        if method == "broken":
            raise ValueError("no fit")
        return rows(spark, (0, len(made), 1.0), (1, len(made), float(len(method))))

    wanted = spark.createDataFrame([("d=1/x", w, m, "f1") for w in ("1-20", "7") for m in ("raw", "fixed")], "dataset string, window string, method string, fingerprint string")
    assert store.ensure(wanted, make) == [("d=1/x", w, m) for w in ("1-20", "7") for m in ("fixed", "raw")]
    assert store.ensure(wanted, make) == [] and len(made) == 4
    assert store.discover(window="7").count() == 2 and store.load(window="7").columns == ["gene_id", "cell_id", "n", *results.KEYS]
    got = store.load("d=1/x", "7", ["raw"])
    assert {(r.gene_id, r.window, r.method) for r in got.collect()} == {(0, "7", "raw"), (1, "7", "raw")}
    assert all("window=7/method=raw" in f for f in scanned(got)) and scanned(got)
    changed = wanted.withColumn("fingerprint", F.when(F.col("window") == "7", "f2").otherwise(F.col("fingerprint")))
    assert [k[1] for k in store.ensure(changed, make)] == ["7", "7"] and store.load().count() == 8
    broken = spark.createDataFrame([("d=1/x", "7", "broken", "f1")], wanted.schema)
    assert store.ensure(broken, make) == store.ensure(broken, make) == [("d=1/x", "7", "broken")]
    assert store.manifest().where("error like 'ValueError: no fit%'").count() == 1 and store.load(methods=["broken"]).count() == 0
    with pytest.raises(ValueError, match="columns"):
        store.put(rows(spark, (0, 0, 1.0)).drop("n"), "d", "w", "m", "f")


def scanned(df):
    """Files that the scans of a plan read."""
    plan = df._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "PartitionFilters: [" in text and "run#" in text.split("PartitionFilters: [")[1]
    return [r.f for r in df.select(F.input_file_name().alias("f")).distinct().collect()]


def test_a_failure_ends_the_result_before(spark, tmp_path):
    store = results.ResultStore(spark, f"{tmp_path}/s", COLUMNS)
    store.put(rows(spark, (0, 0, 1.0)), "d", "w", "m", "f1")
    store.fail("d", "w", "m", "f2", "out of memory")
    assert store.load().count() == 0 and store.discover().count() == 0
    wanted = spark.createDataFrame([("d", "w", "m", "f2")], "dataset string, window string, method string, fingerprint string")
    assert store.pending(wanted).count() == 1


def test_fingerprints(spark):
    a = rows(spark, (0, 0, 1.0), (1, 2, None))
    mark = results.fingerprint({"bin": 10, "scale": [5, 10]}, a)
    assert mark == results.fingerprint({"scale": [5, 10], "bin": 10}, a.repartition(3).orderBy(F.desc("gene_id")))
    others = [results.fingerprint({"bin": 11, "scale": [5, 10]}, a), results.fingerprint({"bin": 10, "scale": [5, 10]}, a.limit(1)), results.fingerprint({"bin": 10, "scale": [5, 10]}, a.withColumn("n", F.lit(2.0))), results.fingerprint({"bin": 10, "scale": [5, 10]}, a.limit(0))]
    assert len({mark, *others}) == 5


def test_reused_metrics(spark, tmp_path):
    store = results.ResultStore(spark, f"{tmp_path}/s", COLUMNS)
    cells = spark.createDataFrame([(0,), (1,)], "cell_id long")
    truth = rows(spark, (0, 0, 4.0), (1, 0, 6.0), (2, 0, 1.0), (0, 1, 5.0), (1, 1, 1.0), (2, 1, 2.0))
    raw = truth.withColumn("n", F.col("n") + F.col("gene_id") * 2)
    assert results.reused_metrics(store, "d", "w", truth, raw, cells, 3).count() == 0
    store.put(truth, "d", "w", "exact", "f")
    store.put(raw, "d", "w", "same", "f")
    store.put(rows(spark, (0, 9, 1.0)), "other", "w", "exact", "f")
    got = {r.method: r for r in results.reused_metrics(store, "d", "w", truth, raw, cells, 3).collect()}
    assert set(got) == {"exact", "same"} and got["exact"].rmse < 1e-12 and abs(got["exact"].reduction_pct - 100) < 1e-9 and abs(got["exact"].r2_mean - 1) < 1e-9
    assert got["same"].rmse > 0.1 and abs(got["same"].reduction_pct) < 1e-9
    with pytest.raises(ValueError, match="other data"):
        results.reused_metrics(store, "other", "w", truth, raw, cells, 3)
