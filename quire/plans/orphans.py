"""Problem 1: citations whose sermon or note is missing, deleted or late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import references as R
from quire.session import as_ntz, table

#: Sermon ids with these beginnings name no sermon.
VIRTUAL = ("ia-", "definition-", "search-")


def citation_refs(citations: DataFrame) -> DataFrame:
    """(ref_id, ref_field, key, at) of each citation, two rows a citation; virtual sources give none.

    Repeated rows of a citation count once; where they differ, the one received first holds.
    """
    first = citations.groupBy("id").agg(F.min(F.struct("received_at", "sermon_id", "note_id", "date_added")).alias("c"))
    key = R.clean_key(F.col("c.sermon_id"))
    virtual = F.coalesce(key.rlike("^(" + "|".join(VIRTUAL) + ")"), F.lit(False))
    pairs = F.array(
        F.struct(F.lit("sermon_id").alias("f"), F.when(~virtual, F.col("c.sermon_id")).alias("k")),
        F.struct(F.lit("note_id").alias("f"), F.col("c.note_id").alias("k")),
    )
    return first.select(F.col("id").alias("ref_id"), as_ntz(F.col("c.date_added")).alias("at"), F.explode(pairs).alias("p")).select("ref_id", F.col("p.f").alias("ref_field"), F.col("p.k").alias("key"), "at")


def resolved(spark: SparkSession, d: str) -> DataFrame:
    """Both fields resolved in one pass: the field is part of the key."""
    own = lambda field, col: F.concat(F.lit(field + ":"), R.clean_key(col))
    refs = citation_refs(table(spark, d, "citations"))
    refs = refs.filter(R.clean_key(F.col("key")) != "").withColumn("key", F.concat("ref_field", F.lit(":"), R.clean_key(F.col("key"))))
    sermons = table(spark, d, "sermons").select(own("sermon_id", F.col("id")).alias("key"), as_ntz(F.col("imported_at")).alias("since"))
    notes = table(spark, d, "notes").select(own("note_id", F.col("id")).alias("key"), as_ntz(F.col("creation_date")).alias("since"))
    field = F.when(F.col("tab") == "sermons", "sermon_id").otherwise("note_id")
    gone = table(spark, d, "deletions").select(F.concat(field, F.lit(":"), R.clean_key(F.col("row_key"))).alias("key"), as_ntz(F.col("deleted_at")).alias("gone_at"))
    return R.resolve(refs, sermons.unionByName(notes), gone)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return R.orphans(resolved(spark, d)).select(F.col("ref_id").alias("citation_id"), "ref_field").distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return R.report(resolved(spark, d))


QUERIES = {"p1_found": p1_found, "p1_report": p1_report}

_REFS = r"""
with c as (
  select id, sermon_id, note_id, try_cast(regexp_replace(date_added, '[Zz]$', '') as timestamp) as ts
  from (select *, row_number() over (partition by id order by received_at nulls first) as rn from citations) where rn = 1),
refs as (
  select id, 'sermon_id' as ref_field, trim(sermon_id, E' \t\n\r') as k, ts from c
  where not regexp_matches(trim(sermon_id, E' \t\n\r'), '^(ia-|definition-|search-)')
  union all select id, 'note_id', trim(note_id, E' \t\n\r'), ts from c),
par as (
  select 'sermon_id' as ref_field, trim(id, E' \t\n\r') as k, min(imported_at) as first_in from sermons group by 1, 2
  union all
  select 'note_id', trim(id, E' \t\n\r'), min(try_cast(regexp_replace(creation_date, '[Zz]$', '') as timestamp)) from notes group by 1, 2),
ins as (
  select distinct 'sermon_id' as ref_field, trim(id, E' \t\n\r') as k, imported_at as t from sermons
  union select distinct 'note_id', trim(id, E' \t\n\r'), try_cast(regexp_replace(creation_date, '[Zz]$', '') as timestamp) from notes),
outs as (
  select distinct case when tab = 'sermons' then 'sermon_id' else 'note_id' end as ref_field, trim(row_key, E' \t\n\r') as k, deleted_at as t from deletions),
st as (
  select r.id, r.ref_field, r.k, r.ts,
    case when p.k is null and exists (select 1 from outs o where o.ref_field = r.ref_field and o.k = r.k) then 'deleted'
      when p.k is null then 'missing'
      when p.first_in > r.ts then 'late'
      when r.ts is not null and p.first_in is not null and not exists (
        select 1 from ins i where i.ref_field = r.ref_field and i.k = r.k and i.t <= r.ts
          and not exists (select 1 from outs o where o.ref_field = i.ref_field and o.k = i.k and o.t > i.t and o.t <= r.ts)) then 'gap'
      else 'valid' end as status
  from refs r left join par p on p.ref_field = r.ref_field and p.k = r.k
  where r.k <> '')
"""

ORACLE = {
    "p1_found": _REFS + "select distinct id as citation_id, ref_field from st where status in ('missing', 'deleted', 'late')",
    "p1_report": _REFS + "select ref_field, coalesce(strftime(ts, '%Y-%m'), 'unknown') as month, status, count(*) as n_refs from st group by 1, 2, 3",
}
