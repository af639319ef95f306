"""New library records as a stream of paragraphs, and last values of a keyed stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import ingest as I


def read_records(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def paragraphs(records: DataFrame) -> DataFrame:
    """The paragraphs of a stream of records: each is keyed, filled and split by itself, without state."""
    return I.paragraphs(I.with_defaults(I.with_key(records)))


def first_records(records: DataFrame, at: str, late: str = "1 day") -> DataFrame:
    """A stream of records, each key once within the time by which rows may be late."""
    return I.with_key(records).withWatermark(at, late).dropDuplicatesWithinWatermark(["doc_id"])


#: Parts of a folder of last states.
BUCKETS = 64


def last_states(states: DataFrame, path: str, checkpoint: str, key: str = "window_id", order: str = "seq"):
    """Start a query that keeps the last state of each key in a Parquet folder, cut into BUCKETS parts by key.

    A batch rewrites the parts of its own keys only, each swapped in whole; a batch that comes
    again after a failure changes nothing more. The folder has one more column, bucket.
    """
    from quire.sources.library import exists, remove, swap

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = I.latest(batch, key, order).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")).persist()
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
        held = [f"{path}/bucket={k}" for k in touched if exists(spark, f"{path}/bucket={k}")]
        both = spark.read.schema(new.schema).option("basePath", path).parquet(*held).select(*new.columns).unionByName(new) if held else new
        stage = f"{path}.new-{uuid.uuid4().hex}"
        I.latest(both, key, order).repartition("bucket").write.partitionBy("bucket").parquet(stage)
        for k in touched:
            # outside the folder, as readers look at all of it
            swap(spark, f"{stage}/bucket={k}", f"{path}/bucket={k}", f"{stage}/old-{k}")
        remove(spark, stage)
        new.unpersist()

    return states.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, by, n): events of a stream per tumbling window, rows later than `late` left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
