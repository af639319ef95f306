from quire.session import materialize, release, shared_dir


def test_materialized_tables_are_shared_files(spark):
    df = materialize(spark.range(10).selectExpr("id", "id * 2 as twice"))
    assert df.count() == 10 and shared_dir(spark).split(":")[-1].lstrip("/") in df.inputFiles()[0]
    assert release(spark) >= 1 and release(spark) == 0
