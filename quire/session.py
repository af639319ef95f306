"""Session helpers: a tuned session, table reads, and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(master: str = "local[8]", partitions: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A local session with the settings the library is tested under."""
    builder = SparkSession.builder.master(master).config("spark.driver.memory", memory)
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a Spark context.

    Without it they could import it only where they run in its folder or have it on their path.
    """
    sc = spark.sparkContext
    if getattr(sc, "_quire_shipped", False):
        return
    home = Path(__file__).resolve().parent
    own = tempfile.mkdtemp(prefix="quire-code-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    with zipfile.ZipFile(f"{own}/quire.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, Path(home.name) / f.relative_to(home))
    # Spark's file server hands it out
    sc.addPyFile(f"{own}/quire.zip")
    sc._quire_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; each is a Parquet file or folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = held.get() if held.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        # a single machine, as in tests; gone when the program ends
        own = tempfile.mkdtemp(prefix="quire-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = "file://" + own
        spark.sparkContext.setCheckpointDir(path)
    return path


def own_dir(spark: SparkSession) -> str:
    """The folder of this application in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/quire-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back.

    Cuts the lineage and avoids recomputing a plan that several branches use. The files are
    shared by all executors, so losing one of them loses nothing.
    """
    path = f"{own_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_ntz(col):
    """A UTC timestamp without zone from an ISO string ('…Z', with or without time) or a timestamp.

    A date alone means its midnight; text that is no date gives null.
    """
    return F.regexp_replace(F.trim(col.cast("string")), "[Zz]$", "").try_cast("timestamp_ntz")


def release(spark: SparkSession) -> int:
    """Delete the tables that materialize() wrote in this application; the number of them.

    Results that were read from them and not yet written elsewhere are lost. Call it between
    queries of a long-lived session.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return 0
    held = fs.listStatus(folder)
    n = len(held)
    fs.delete(folder, True)
    return n
