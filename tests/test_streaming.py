from seepage.schema import COUNTS, SPOTS
from seepage.streaming import counts


def test_running_totals(spark, tmp_path):
    spots = spark.createDataFrame([(0, 0.0, 0.0, 7), (1, 1.0, 0.0, 7), (2, 2.0, 0.0, 8), (3, 3.0, 0.0, -1)], SPOTS)
    put = lambda rows: spark.createDataFrame(rows, COUNTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for rows in ([(0, 0, 2.0), (1, 2, 5.0), (0, 3, 9.0)], [(1, 1, 3.0), (0, 0, None)]):
        put(rows)
        totals = counts.running_cells(counts.read_counts(spark, f"{tmp_path}/in"), spots)
        counts.write_latest(totals, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert {(r.cell_id, r.library, r.genes) for r in counts.latest(spark, f"{tmp_path}/out").collect()} == {(7, 5.0, 2), (8, 5.0, 1)}
    counts.compact(spark, f"{tmp_path}/out")
    assert len(list((tmp_path / "out").glob("epoch=*"))) == 1
    assert {(r.cell_id, r.library, r.genes) for r in counts.latest(spark, f"{tmp_path}/out").collect()} == {(7, 5.0, 2), (8, 5.0, 1)}
