"""Notes with their citations: reading, changing, ordering, and sets of chosen documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.session import materialize

#: A citation whose source begins so has no document behind it.
VIRTUAL = ("ia-", "definition", "search")
NOTE = ("id", "title", "content", "color", "note_order", "creation_date", "note_date")


def is_virtual(sermon_id: Column) -> Column:
    found = F.lit(False)
    for v in VIRTUAL:
        found = found | sermon_id.startswith(v)
    return F.coalesce(found, F.lit(False))


def with_citations(notes: DataFrame, citations: DataFrame, columns: tuple[str, ...] = ("id", "sermon_id", "quoted_text", "date_added", "paragraph_index")) -> DataFrame:
    """Notes with the array of their citations, ordered by date and id; without any it is empty.

    Citations are gathered by note before the join, so notes aren't repeated by it.
    """
    one = F.struct(F.col("date_added").alias("_d"), F.col("id").alias("_i"), *[F.col(c) for c in columns])
    nested = citations.filter("note_id is not null").groupBy("note_id").agg(F.array_sort(F.collect_list(one)).alias("c"))
    nested = nested.select(F.col("note_id").alias("id"), F.transform("c", lambda x: F.struct(*[x[k].alias(k) for k in columns])).alias("citations"))
    out = notes.join(nested, "id", "left")
    return out.withColumn("citations", F.coalesce("citations", F.array().cast(out.schema["citations"].dataType)))


def citation_counts(notes: DataFrame, citations: DataFrame) -> DataFrame:
    """(id, n_citations) of every note; counted by note before the join."""
    n = citations.groupBy(F.col("note_id").alias("id")).agg(F.count("*").alias("n"))
    return notes.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_citations"))


def first_citation(citations: DataFrame) -> DataFrame:
    """(note_id, citation_id): the first citation of each note by date and id; those without a date come last."""
    key = F.struct(F.col("date_added").isNull(), "date_added", "id")
    return citations.filter("note_id is not null").groupBy("note_id").agg(F.min_by("id", key).alias("citation_id"))


def upsert(notes: DataFrame, citations: DataFrame, new_notes: DataFrame, new_citations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes, citations) after saving new_notes: each replaces the note of its id but for the date it
    was created, or is added; its citations are replaced by those of new_citations."""
    created = notes.select("id", F.col("creation_date").alias("_old")).distinct()
    new = new_notes.join(created, "id", "left").withColumn("creation_date", F.coalesce("_old", "creation_date")).drop("_old")
    kept = notes.join(new_notes.select("id"), "id", "left_anti")
    others = citations.join(new_notes.select(F.col("id").alias("note_id")), "note_id", "left_anti")
    return kept.unionByName(new.select(*kept.columns)), others.unionByName(new_citations.select(*others.columns))


def patch(notes: DataFrame, changes: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """notes with some columns changed: changes has id, the columns, and set_<column> flags, so null can be set."""
    c = changes.select("id", *[F.col(x).alias("_" + x) for x in columns], *[F.col("set_" + x) for x in columns])
    out = notes.join(c, "id", "left")
    return out.select(*[F.when(F.coalesce("set_" + x, F.lit(False)), F.col("_" + x)).otherwise(F.col(x)).alias(x) if x in columns else F.col(x) for x in notes.columns])


def delete(notes: DataFrame, citations: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes, citations) without the notes of ids and the citations they hold."""
    return notes.join(ids.select("id"), "id", "left_anti"), citations.join(ids.select(F.col("id").alias("note_id")), "note_id", "left_anti")


def add_citation(citations: DataFrame, notes: DataFrame, new: DataFrame) -> DataFrame:
    """citations with new ones, of those whose note exists."""
    return citations.unionByName(new.join(notes.select(F.col("id").alias("note_id")), "note_id", "left_semi").select(*citations.columns))


def snapshot(documents: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(sermon_id, …, quoted_text, paragraph_index): paragraphs as citations that keep title, date and version of their document as they are now."""
    docs = documents.select("doc_id", F.col("title").alias("sermon_title_snapshot"), F.col("sermon_date").alias("sermon_date_snapshot"), F.col("version").alias("sermon_version_snapshot"))
    return paragraphs.join(docs, "doc_id").select(F.col("doc_id").alias("sermon_id"), "sermon_title_snapshot", "sermon_date_snapshot", "sermon_version_snapshot", F.col("content").alias("quoted_text"), "paragraph_index")


def positions(notes: DataFrame) -> DataFrame:
    """(id, position): the places 0 to n-1 by note_order and id; notes without an order come last.

    Orders are ranked by range partition: counts of the ranges give each its first place, so no
    single task sorts all notes.
    """
    placed = notes.select("id", F.struct(F.col("note_order").isNull().alias("z"), F.col("note_order").alias("o"), F.col("id").alias("i")).alias("k")).repartitionByRange("k").withColumn("p", F.spark_partition_id())
    # written once, so that both uses below see the same ranges
    ranked = materialize(placed.select("id", "p", F.row_number().over(Window.partitionBy("p").orderBy("k")).alias("r")))
    size = ranked.groupBy("p").agg(F.count("*").alias("n"))
    # one row a partition
    before = size.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    return ranked.join(F.broadcast(before), "p").select("id", (F.col("r") - 1 + F.col("b")).cast("long").alias("position"))


def move(ordered: DataFrame, dragged: str, target: str) -> DataFrame:
    """(id, position) after moving one id to another's place: downwards it lands after the target, upwards before; an unknown id changes nothing.

    ordered is (id, position). Only places between the two change, so nothing is sorted again.
    """
    place = {r["id"]: r["position"] for r in ordered.filter(F.col("id").isin(dragged, target)).limit(2).collect()}
    if dragged not in place or target not in place:
        return ordered.select("id", "position")
    p, d, t = F.col("position"), place[dragged], place[target]
    shift = F.when(p.between(d + 1, t), p - 1) if d < t else F.when(p.between(t, d - 1), p + 1)
    return ordered.select("id", F.when(p == d, F.lit(t)).otherwise(F.coalesce(shift, p)).cast("long").alias("position"))


def reorder(notes: DataFrame, ids: list[str]) -> DataFrame:
    """notes with note_order from the place of their id in ids; others keep theirs."""
    spark = notes.sparkSession
    given = spark.createDataFrame([(i, k) for k, i in enumerate(dict.fromkeys(ids))], "id string, _k int")
    return notes.join(F.broadcast(given), "id", "left").withColumn("note_order", F.coalesce("_k", "note_order")).drop("_k").select(*notes.columns)


def title_filter(notes: DataFrame, query: str | None) -> DataFrame:
    """Notes whose title holds the query, without case, accents and punctuation; a blank query keeps all."""
    q = X.norm_text(query)
    return notes.filter(X.norm(F.col("title")).contains(q)) if q else notes


def union_ids(chosen: DataFrame, more: DataFrame) -> DataFrame:
    """The ids of both, once; null and empty ones dropped."""
    return chosen.select("doc_id").unionByName(more.select("doc_id")).filter(X.given(F.col("doc_id"))).distinct()


def except_ids(chosen: DataFrame, less: DataFrame) -> DataFrame:
    return chosen.select("doc_id").distinct().join(less.select("doc_id"), "doc_id", "left_anti")


def replace_ids(chosen: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The given ids instead of the chosen ones; without any, none."""
    return chosen.select("doc_id").limit(0) if ids is None else union_ids(ids, ids)


def toggle(ids: Column, value: Column, single: bool = False) -> Column:
    """The array without value where it holds it, else with it; single keeps at most that one."""
    has = F.array_contains(ids, value)
    if single:
        return F.when(has & (F.size(ids) == 1), F.filter(ids, lambda x: F.lit(False))).otherwise(F.array(value))
    return F.when(has, F.array_remove(ids, value)).otherwise(F.array_append(ids, value))


def file_name(title: Column) -> Column:
    """The name under which a note is written: lower case, white space as one underscore."""
    return F.lower(F.regexp_replace(title, f"[{X.WS}]+", "_"))


def export_text(nested: DataFrame) -> DataFrame:
    """(id, file_name, body): a note and its numbered citations as text."""
    lines = F.transform("citations", lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(c["quoted_text"], F.lit(""))))
    return nested.select("id", file_name(F.coalesce("title", F.lit(""))).alias("file_name"), F.array_join(F.concat(F.array(F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))), lines), "\n").alias("body"))


def new_notes(notes: DataFrame, drafts: DataFrame, now: str, color: str = "default") -> DataFrame:
    """notes with drafts (id, title, content) added: created at `now`, an ISO time, after all others in order.

    Only the number of notes is fetched.
    """
    n = notes.select("id").distinct().count()
    added = drafts.select("id", X.or_default(F.col("title"), "").alias("title"), X.or_default(F.col("content"), "").alias("content"), F.lit(color).alias("color"), F.lit(now).alias("creation_date"), F.lit(now[:10]).alias("note_date"))
    placed = positions(added.withColumn("note_order", F.lit(0)))
    return notes.unionByName(added.join(placed, "id").withColumn("note_order", (F.col("position") + n).cast("int")).select(*notes.columns))


def definition_source(word: Column) -> Column:
    """The source id of a citation of a dictionary entry."""
    return F.concat(F.lit("definition-"), word)


def answer_source(milliseconds: Column) -> Column:
    """The source id of a citation of an assistant's answer."""
    return F.concat(F.lit("ia-"), milliseconds.cast("string"))


def citations_of(citations: DataFrame, doc_id: str, note_id: str | None = None) -> DataFrame:
    """The citations of one document, of one note or of all."""
    found = citations.filter(F.col("sermon_id") == doc_id)
    return found if note_id is None else found.filter(F.col("note_id") == note_id)
