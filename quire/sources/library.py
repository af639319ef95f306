"""Library files: a JSON array of records in, keyed documents and paragraphs as Parquet out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire import schema as S
from quire.operators import ingest as I


class NotALibrary(ValueError):
    """The file isn't a JSON array of records."""


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """The records of a JSON array with their place, ord from 0, and the column names of the test tables.

    Unparsable files and files whose top level isn't an array raise NotALibrary. A file is one
    value of JSON, so one task reads it. Several files follow each other in the order of their
    names: ord is the place in the file, and from the second file on begins at 2**32 for each.
    """
    try:
        whole = spark.read.text(path, wholetext=True).select(F.col("value"), F.col("_metadata.file_path").alias("file"))
        names = whole.select("file").distinct()
        # as many rows as there are files
        number = names.select("file", (F.row_number().over(Window.orderBy("file")) - 1).alias("nth"))
        whole = whole.join(number, "file")
        bad = whole.filter(~F.ltrim(F.regexp_replace("value", "^[\\s\ufeff]+", "")).startswith("["))
        if not bad.isEmpty():
            raise NotALibrary("the top level is not an array")
        rows = whole.select("nth", F.posexplode(F.from_json("value", f"array<struct<{_fields()}>>", {"mode": "FAILFAST"})).alias("ord", "r"))
        rows = rows.select((F.col("nth").cast("long") * (1 << 32) + F.col("ord")).alias("ord"), "r.*")
        rows.limit(1).collect()
    except NotALibrary:
        raise
    except Exception as error:
        raise NotALibrary(str(error)[:300]) from error
    lights = F.transform("highlights", lambda h: F.struct(h["id"].alias("id"), h["start"].alias("first_tok"), h["end"].alias("last_tok"), h["color"].alias("color")))
    return rows.select("ord", "id", "title", F.col("date").alias("sermon_date"), F.col("time").alias("part_of_day"), "city", "version", "audio_url", "text", lights.alias("highlights"))


def _fields() -> str:
    return S.LIBRARY.replace(" string", ":string").replace(" array", ":array").replace(", ", ",")


#: The file of a library that names its current state.
CURRENT = "_CURRENT"


def import_library(library: DataFrame, path: str, keep: str = "first") -> int:
    """Replace the documents and paragraphs under path; the number of records that came in.

    Both are written to a folder of their own, and then one small file that names it is replaced,
    by one rename: readers see both old tables or both new ones, and a failed import leaves the
    old state. The state before the old one is deleted. Documents are clustered by key, so that a
    look-up reads few files.
    """
    spark, root = library.sparkSession, path.rstrip("/")
    docs = I.with_defaults(I.dedupe(I.with_key(library), keep))
    name = f"state-{uuid.uuid4().hex}"
    docs.repartition("doc_id").sortWithinPartitions("doc_id").write.parquet(f"{root}/{name}/documents")
    saved = spark.read.parquet(f"{root}/{name}/documents")
    I.paragraphs(saved).sortWithinPartitions("doc_id", "paragraph_index").write.parquet(f"{root}/{name}/paragraphs")
    before = current(spark, root)
    point(spark, root, name)
    # readers of the last state go on; what is older is gone
    fs, folder = _file_system(spark, root)
    for status in fs.listStatus(folder):
        old = status.getPath().getName()
        if old.startswith("state-") and old not in (name, before):
            fs.delete(status.getPath(), True)
    return library.count()


def point(spark: SparkSession, root: str, name: str) -> None:
    """Make name the current state under root, by one rename over the file that names it."""
    jvm, hadoop = spark._jvm, spark._jvm.org.apache.hadoop.fs
    fresh = hadoop.Path(f"{root}/{CURRENT}.{uuid.uuid4().hex}")
    fs = fresh.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(fresh, True)
    out.write(bytearray(name, "utf-8"))
    out.close()
    context = hadoop.FileContext.getFileContext(fresh.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(fresh), context.makeQualified(hadoop.Path(f"{root}/{CURRENT}")), options)


def current(spark: SparkSession, path: str) -> str | None:
    """The name of the current state under path; None before the first."""
    fs, file = _file_system(spark, f"{path.rstrip('/')}/{CURRENT}")
    if not fs.exists(file):
        return None
    got = fs.open(file)
    try:
        return bytes(got.readAllBytes()).decode("utf-8")
    finally:
        got.close()


def stored(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The documents or paragraphs of an imported library."""
    return spark.read.parquet(f"{path.rstrip('/')}/{current(spark, path)}/{name}")


def swap(spark: SparkSession, new: str, path: str, aside: str | None = None) -> None:
    """Put the folder new in the place of path, the old one aside meanwhile; between two renames there is neither."""
    fs, to = _file_system(spark, path)
    old = spark._jvm.org.apache.hadoop.fs.Path(aside or path + ".old-" + uuid.uuid4().hex)
    had = fs.exists(to)
    if had:
        fs.rename(to, old)
    fs.mkdirs(to.getParent())
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(new), to):
        if had:
            fs.rename(old, to)
        raise OSError(f"cannot rename {new} to {path}")
    fs.delete(old, True)


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def replace_table(df: DataFrame, path: str) -> None:
    """Overwrite a table that df may itself be read from; it is written beside it first, on the same file system."""
    path = path.rstrip("/")
    new = f"{path}.new-{uuid.uuid4().hex}"
    df.write.parquet(new)
    swap(df.sparkSession, new, path)


def is_ready(spark: SparkSession, path: str) -> bool:
    """Whether documents have been imported under path."""
    name = current(spark, path)
    if name is None:
        return False
    fs, p = _file_system(spark, f"{path.rstrip('/')}/{name}/documents/_SUCCESS")
    return fs.exists(p)


def append_messages(messages: DataFrame, path: str) -> None:
    """Add chat messages to a table."""
    messages.write.mode("append").parquet(path)
