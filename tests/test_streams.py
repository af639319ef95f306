"""Streams: keys once within the watermark, windowed counts."""

from datetime import datetime, timedelta

from quire.streaming import ingest as G

T0 = datetime(2024, 1, 1)


def run(df, path, checkpoint, mode="append"):
    q = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert q.exception() is None


def test_first_records(spark, tmp_path):
    rows = [(0, "a", "", T0), (1, "a", "", T0 + timedelta(minutes=5)), (2, "a", "V", T0), (3, None, None, T0)]
    schema = "ord long, id string, version string, at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    run(G.first_records(G.read_records(spark, str(tmp_path / "in"), schema), "at"), str(tmp_path / "out"), str(tmp_path / "c"))
    got = sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert len(got) == 3 and got[:2] == ["a", "a-V"] and got[2].startswith("gen-")


def test_windowed_counts(spark, tmp_path):
    rows = [("x", T0 + timedelta(minutes=m)) for m in (1, 2, 61, 62, 63)] + [("y", T0), ("z", T0 + timedelta(days=2))]
    schema = "kind string, ts timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    run(G.windowed_counts(G.read_records(spark, str(tmp_path / "in"), schema), "ts", "kind"), str(tmp_path / "out"), str(tmp_path / "c"))
    got = {(r["kind"], r["start"].hour): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).filter("kind <> 'z'").collect()}
    assert got == {("x", 0): 2, ("x", 1): 3, ("y", 0): 1}
