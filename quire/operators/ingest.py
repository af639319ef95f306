"""From a raw library to keyed documents and paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X

#: What an import puts for fields that are null or empty.
DEFAULTS = {"title": "Sermon sans titre", "sermon_date": "0000-00-00", "city": "", "version": "VGR", "part_of_day": "Inconnu", "audio_url": "", "text": "..."}


def with_key(library: DataFrame) -> DataFrame:
    """library with doc_id: the id, and the version after a hyphen where there is one.

    A missing id is made from the row's place, the same on every run.
    """
    made = F.concat(F.lit("gen-"), F.substring(F.sha2(F.col("ord").cast("string"), 256), 1, 9))
    base = F.when(X.given(F.col("id")), F.col("id")).otherwise(made)
    return library.withColumn("doc_id", F.when(X.given(F.col("version")), F.concat_ws("-", base, "version")).otherwise(base))


def dedupe(docs: DataFrame, keep: str = "first") -> DataFrame:
    """One row a doc_id: the first or the last in order of ord, which is unique.

    The places that win are found from keys alone, and rows meet them by hash, without a sort of
    texts. What comes out is distributed by doc_id, so windows over documents need no shuffle.
    """
    pick = F.min if keep == "first" else F.max
    kept = docs.groupBy("doc_id").agg(pick("ord").alias("_ord"))
    # none is beyond the one that wins; an equality would become a key of the join
    wins = F.col("ord") <= F.col("_ord") if keep == "first" else F.col("ord") >= F.col("_ord")
    return docs.join(kept.hint("shuffle_hash"), "doc_id").filter(wins).select(*docs.columns)


def with_defaults(docs: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """docs with a default in each null or empty field."""
    known = {**DEFAULTS, **(defaults or {})}
    return docs.withColumns({c: X.or_default(F.col(c), d) for c, d in known.items() if c in docs.columns})


def metadata(docs: DataFrame) -> DataFrame:
    """Documents without their text, newest first."""
    return docs.select("doc_id", "title", "sermon_date", "city", "version", "part_of_day", "audio_url").orderBy(F.desc_nulls_last("sermon_date"), "doc_id")


def paragraphs(docs: DataFrame, separator: str = X.BLANK_LINE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep…, paragraph_id, paragraph_index, content): paragraphs that aren't blank, numbered
    from 1 by their place among all, blank ones counted."""
    raw = docs.select("doc_id", *keep, F.posexplode(X.paragraphs_of(F.col("text"), separator)).alias("pos", "raw"))
    out = raw.select("doc_id", *keep, F.concat_ws("-", "doc_id", F.col("pos").cast("string")).alias("paragraph_id"), (F.col("pos") + 1).cast("long").alias("paragraph_index"), X.js_trim(F.col("raw")).alias("content"))
    return out.filter(F.col("content") != "")


def rebuild(paragraphs_df: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): paragraphs joined again in order, a blank line between them."""
    rows = F.array_sort(F.collect_list(F.struct("paragraph_index", "content")))
    return paragraphs_df.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["content"]), "\n\n").alias("text"))


def full_documents(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of a set of ids; unknown ids and documents without text drop out."""
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").filter(X.given(F.col("text")))


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph_index, is_numbered): whether a paragraph begins with a digit."""
    return paragraphs(docs).select("doc_id", "paragraph_index", F.col("content").rlike("^[0-9]").alias("is_numbered"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the one of the greatest order; ties by all columns."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(order), *[F.col(c).desc_nulls_last() for c in rows.columns if c not in (key, order)])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
