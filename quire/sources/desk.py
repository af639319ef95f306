"""Notes and definitions kept as JSON files, and their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schema as S
from quire.sources.library import replace_table

_CITATION = "id:string,sermon_id:string,sermon_title_snapshot:string,sermon_date_snapshot:string,sermon_version_snapshot:string,quoted_text:string,date_added:string,paragraph_index:int"
NOTES_JSON = f"id string, title string, content string, color string, `order` int, creationDate string, date string, citations array<struct<{_CITATION}>>"


def read_notes(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(notes, citations) of a JSON file of notes with nested citations, or of one note a line; unreadable records give nothing."""
    raw = spark.read.schema(NOTES_JSON).option("multiLine", not lines).option("mode", "DROPMALFORMED").json(path)
    notes = raw.select("id", "title", "content", "color", F.col("order").alias("note_order"), F.col("creationDate").alias("creation_date"), F.col("date").alias("note_date"))
    cites = raw.select(F.col("id").alias("note_id"), F.explode("citations").alias("c"))
    return notes, cites.select("c.id", "note_id", *[f"c.{n}" for n in ("sermon_id", "sermon_title_snapshot", "sermon_date_snapshot", "sermon_version_snapshot", "quoted_text", "date_added", "paragraph_index")])


def write_notes(notes: DataFrame, citations: DataFrame, path: str) -> None:
    """Both tables written side by side, each swapped in whole."""
    replace_table(notes, f"{path.rstrip('/')}/notes")
    replace_table(citations, f"{path.rstrip('/')}/citations")


def definitions(raw: DataFrame, column: str = "value") -> DataFrame:
    """(word, definition, synonyms, etymology, seq) of a column of JSON; bad JSON and entries without a word are left out."""
    parsed = F.from_json(F.col(column), S.DEFINITION, {"mode": "PERMISSIVE"})
    return raw.select(parsed.alias("d")).select("d.*").filter("word is not null and word <> ''")


def put_definition(held: DataFrame, new: DataFrame) -> DataFrame:
    """held with new entries; of a word, in lower case, the latest counts."""
    both = held.unionByName(new).withColumn("word", F.lower("word"))
    cols = [c for c in both.columns if c != "word"]
    one = both.groupBy("word").agg(F.max_by(F.struct(*cols), "seq").alias("r"))
    return one.select("word", *[F.col("r")[c].alias(c) for c in cols])
