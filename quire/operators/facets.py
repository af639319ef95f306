"""Filters and facets of the document list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as X


def title_contains(query: str | None) -> Column:
    """Whether the title holds the query, without case, accents and punctuation; a query without letters is off."""
    q = X.norm_text(query)
    return X.norm(F.col("title")).contains(q) if q else F.lit(True)


def conditions(*, title: str | None = None, city: str | None = None, year: str | None = None, month: str | None = None, day: str | None = None, version: str | None = None, part_of_day: str | None = None, audio: bool = False) -> list[Column]:
    """The filters that are on: null and empty ones are off. A null field matches no filter."""
    date = F.col("sermon_date")
    found = [title_contains(title)] if title else []
    found += [F.col("city") == city] if city else []
    found += [date.startswith(year)] if year else []
    found += [F.substring(date, 6, 2) == month] if month else []
    found += [F.substring(date, 9, 2) == day] if day else []
    found += [F.col("version") == version] if version else []
    found += [F.col("part_of_day") == part_of_day] if part_of_day else []
    found += [X.given(F.col("audio_url"))] if audio else []
    return found


def present(docs: DataFrame) -> DataFrame:
    """docs without null rows: those that have no id."""
    return docs.filter(F.col("doc_id").isNotNull())


def filtered(docs: DataFrame, **filters) -> DataFrame:
    """The documents that meet all filters; null rows meet none."""
    docs = present(docs)
    for c in conditions(**filters):
        docs = docs.filter(c)
    return docs


def active(**filters) -> int:
    """How many filters other than the title are on."""
    return sum(1 for k, v in filters.items() if k != "title" and v)


def years(docs: DataFrame) -> DataFrame:
    """The distinct years of the dates that begin with four digits, newest first."""
    year = F.substring("sermon_date", 1, 4)
    return docs.filter(year.rlike("^[0-9]{4}$")).select(year.alias("year")).distinct().orderBy(F.desc("year"))


def values(docs: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column that are neither null nor empty, in order."""
    return docs.filter(X.given(F.col(column))).select(F.col(column).alias("value")).distinct().orderBy("value")


def all_values(docs: DataFrame, columns: tuple[str, ...] = ("city", "version", "part_of_day")) -> DataFrame:
    """(facet, value, n): the distinct values of several columns, in one pass and one shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in columns])
    rows = docs.select(F.explode(pairs).alias("p")).select("p.facet", "p.value")
    return rows.filter(X.given(F.col("value"))).groupBy("facet", "value").agg(F.count("*").alias("n"))


def calendar(spark, lang: str = "fr") -> DataFrame:
    """(facet, value, label): the months with their names and the days, zero-padded."""
    months = spark.range(1, 13).select(F.lit("month").alias("facet"), F.lpad(F.col("id").cast("string"), 2, "0").alias("value"))
    days = spark.range(1, 32).select(F.lit("day").alias("facet"), F.lpad(F.col("id").cast("string"), 2, "0").alias("value"))
    return months.withColumn("label", X.month_name(F.col("value"), lang)).unionByName(days.withColumn("label", F.col("value")))


def all_selected(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """One row, all_selected: whether every document is among ids; false without documents."""
    known = ids.select("doc_id").distinct().withColumn("_in", F.lit(True))
    joined = docs.select("doc_id").join(known, "doc_id", "left")
    return joined.agg((F.coalesce(F.bool_and(F.coalesce("_in", F.lit(False))), F.lit(False))).alias("all_selected"))
