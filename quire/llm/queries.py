"""Queries of the training-data operators over the test tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import abuse, canonical, encoding, leakage, lookalikes, neardup, sharedspans, splitting
from quire.session import table


def _texts(spark: SparkSession, d: str, names: dict[str, tuple[str, str]]) -> DataFrame:
    """(tab, rec_key, text) of several tables: {table: (key column, text column)}."""
    parts = [table(spark, d, t).select(F.lit(t).alias("tab"), F.col(k).cast("string").alias("rec_key"), F.col(c).alias("text")) for t, (k, c) in names.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Words of a sequence and least similarity of near-duplicate records.
P2_WORDS, P2_SIMILARITY = 3, 0.75


def _p2(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return neardup.near_duplicates(table(spark, d, "library"), "ord", "text", P2_WORDS, P2_SIMILARITY)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of library records with nearly the same text."""
    found = neardup.all_pairs(*_p2(spark, d))
    return found.select(F.col("a").alias("ord_a"), F.col("b").alias("ord_b"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each near-duplicate record with its group and its number of links."""
    return neardup.groups(*_p2(spark, d)).select(F.col("id").alias("ord"), "group_id", "n_links")


def p2_versions(spark: SparkSession, d: str) -> DataFrame:
    """The versions that sermons gives the records of each group, and how many records have each."""
    group = p2_groups(spark, d).select("ord", "group_id")
    given = F.coalesce(F.col("version"), F.lit("")) != ""
    key = F.when(given, F.concat_ws("-", "id", "version")).otherwise(F.col("id"))
    library = table(spark, d, "library").select("ord", key.alias("id"))
    version = table(spark, d, "sermons").select("id", F.coalesce("version", F.lit("")).alias("version")).distinct()
    return group.join(library, "ord").join(version, "id").groupBy("group_id", "version").agg(F.count_distinct("ord").alias("n_records"))


#: Size limit and overlap of the pieces, by table.
P3_LIMITS = {"library": ("ord", "text", 8000, 400), "paragraphs": ("id", "content", 1000, 100)}


def p3_pieces(spark: SparkSession, d: str, whole: bool = True) -> DataFrame:
    """The pieces of every text of library and paragraphs."""
    parts = []
    for t, (k, c, limit, overlap) in P3_LIMITS.items():
        rows = table(spark, d, t).select(F.lit(t).alias("tab"), F.col(k).cast("string").alias("rec_key"), F.col(c).alias("content"))
        parts.append(splitting.pieces(rows, ["tab", "rec_key"], "content", limit, overlap, whole=whole))
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that come out as more than one piece."""
    return p3_pieces(spark, d, whole=False).filter("piece > 1").select("tab", "rec_key").distinct()


def _p4_texts(spark: SparkSession, d: str) -> DataFrame:
    paragraphs = table(spark, d, "paragraphs").select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("rec"), F.col("content").alias("text"))
    citations = table(spark, d, "citations").select(F.concat(F.lit("c"), F.col("id")).alias("rec"), F.col("quoted_text").alias("text"))
    return paragraphs.unionByName(citations)


#: Characters that two records must share in a row.
P4_LEAST = 150


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of paragraphs and citations with a passage in common."""
    return sharedspans.pairs(_p4_texts(spark, d), "rec", "text", P4_LEAST)


def p4_spans(spark: SparkSession, d: str) -> DataFrame:
    """The passages that two records have in common, with their places."""
    return sharedspans.spans(_p4_texts(spark, d), "rec", "text", P4_LEAST)


def p4_shared(spark: SparkSession, d: str) -> DataFrame:
    """Of each record the characters that stand in another record too."""
    return sharedspans.coverage(_p4_texts(spark, d), "rec", "text", P4_LEAST)


def p5_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Each typed city with the entry it means; without one, city_id is -1."""
    found = canonical.canonical(table(spark, d, "sermons"), "city", table(spark, d, "ref_cities"), "city_id", "city_name", "area", "alt_names")
    return found.select("city", F.coalesce("city_id", F.lit(-1)).alias("city_id"), "distance")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Sermons whose city isn't written as in the reference, with the entry it means."""
    exact = table(spark, d, "ref_cities").select(F.col("city_name").alias("city")).filter("city is not null").distinct()
    # the typed values are compared once each; sermons meet them by equality
    mapped = p5_mapping(spark, d).join(exact, "city", "left_anti")
    sermons = table(spark, d, "sermons").select(F.col("id").alias("sermon_id"), "city")
    return sermons.join(mapped, "city").select("sermon_id", "city_id").distinct()


P6_TEXTS = {"paragraphs": ("id", "content"), "library": ("ord", "title")}


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Records whose text differs from its consistent form."""
    return lookalikes.normalize(_texts(spark, d, P6_TEXTS), "text", only_changed=True).select("tab", "rec_key").distinct()


def p6_forms(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every paragraph and title."""
    return lookalikes.normalize(_texts(spark, d, P6_TEXTS), "text").select("tab", "rec_key", "form").distinct()


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document."""
    return encoding.encode(table(spark, d, "documents").select("doc_id", "text"))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the test items in it, and its words that lie in shared runs."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id").distinct()


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every document, by a machine fitted on the labelled ones."""
    documents = table(spark, d, "documents")
    return abuse.score(documents, abuse.train(documents, table(spark, d, "labels")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with an abusive, hateful or sexual passage."""
    return p9_scores(spark, d).filter("abusive").select("doc_id").distinct()


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """The rate of such documents per source."""
    return abuse.rates(p9_scores(spark, d), table(spark, d, "documents"))


QUERIES = {
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p2_versions": p2_versions,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p4_found": p4_found,
    "p4_spans": p4_spans,
    "p4_shared": p4_shared,
    "p5_found": p5_found,
    "p5_mapping": p5_mapping,
    "p6_found": p6_found,
    "p6_forms": p6_forms,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_leaks": p8_leaks,
    "p9_found": p9_found,
    "p9_scores": p9_scores,
    "p9_rates": p9_rates,
}

_P8 = r"""
with doc as (select doc_id, regexp_extract_all(strip_accents(lower(nfc_normalize(text))), '[\p{L}\p{N}]+') as w from documents),
item as (select item_id, regexp_extract_all(strip_accents(lower(nfc_normalize(text))), '[\p{L}\p{N}]+') as w from eval_items),
dr as (select doc_id, array_to_string(w[s : s + 11], ' ') as r from doc, unnest(generate_series(1, greatest(len(w) - 11, 0))) u(s) where len(w) >= 12),
ir as (select distinct item_id, array_to_string(w[s : s + 11], ' ') as r from item, unnest(generate_series(1, greatest(len(w) - 11, 0))) u(s) where len(w) >= 12)
"""

_P2 = r"""
with w as (select ord, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from library),
g as (select distinct ord, w[s] || ' ' || w[s + 1] || ' ' || w[s + 2] as t from w, unnest(generate_series(1, greatest(len(w) - 2, 0))) u(s) where len(w) >= 3),
n as (select ord, count(*) as n from g group by ord)
"""

_P4 = """
with r as (
  select distinct 'p' || id as rec, content as t from paragraphs where length(content) >= 150
  union select distinct 'c' || id, quoted_text from citations where length(quoted_text) >= 150),
g as (select distinct rec, s, md5(t[s : s + 149]) as h from r, unnest(generate_series(1, length(t) - 149)) u(s)),
w as (select distinct x.rec as rec_a, y.rec as rec_b, x.s as a, y.s as b from g x join g y on x.h = y.h and x.rec < y.rec)"""

_P2_PAIRS = """,
o as (select x.ord as a, y.ord as b, count(*) as k from g x join g y on x.t = y.t and x.ord < y.ord group by 1, 2),
p as (select a, b from o join n na on na.ord = a join n nb on nb.ord = b where k >= 0.75 * (na.n + nb.n - k)),
e as (select a, b from p union all select b, a from p),
c(ord, other) as (select a, a from e union select e.b, c.other from c join e on e.a = c.ord),
m as (select ord, min(other) as group_id from c group by 1)"""

ORACLE = {
    "p2_groups": _P2.replace("with ", "with recursive ", 1) + _P2_PAIRS + """
select ord, group_id, (select count(*) from e where e.a = m.ord) as n_links from m""",
    "p2_versions": _P2.replace("with ", "with recursive ", 1) + _P2_PAIRS + """,
k as (select distinct ord, case when version <> '' then id || '-' || version else id end as id from library),
v as (select distinct id, coalesce(version, '') as version from sermons)
select group_id, v.version, count(distinct m.ord) as n_records from m join k using (ord) join v using (id) group by 1, 2""",
    "p2_found": _P2 + """
select a as ord_a, b as ord_b from (select x.ord as a, y.ord as b, count(*) as k from g x join g y on x.t = y.t and x.ord < y.ord group by 1, 2) o
join n na on na.ord = a join n nb on nb.ord = b where k >= 0.75 * (na.n + nb.n - k)""",
    "p3_found": """
select distinct 'library' as tab, cast(ord as varchar) as rec_key from library where length(text) > 8000
union all select distinct 'paragraphs', cast(id as varchar) from paragraphs where length(content) > 1000""",
    "p4_found": """
with r as (
  select distinct 'p' || id as rec, content as t from paragraphs where length(content) >= 150
  union select distinct 'c' || id, quoted_text from citations where length(quoted_text) >= 150),
g as (select distinct rec, md5(t[s : s + 149]) as h from r, unnest(generate_series(1, length(t) - 149)) u(s))
select distinct x.rec as rec_a, y.rec as rec_b from g x join g y on x.h = y.h and x.rec < y.rec""",
    "p4_spans": _P4 + """,
i as (select rec_a, rec_b, a, a - b as shift, a - row_number() over (partition by rec_a, rec_b, a - b order by a) as island from w)
select rec_a, rec_b, cast(min(a) - 1 as integer) as start_a, cast(min(a) - shift - 1 as integer) as start_b, cast(max(a) - min(a) + 150 as integer) as length from i group by rec_a, rec_b, shift, island""",
    "p4_shared": _P4 + """,
p as (select rec_a as rec, a as s from w union select rec_b, b from w),
e as (select rec, s, coalesce(lead(s) over (partition by rec order by s), s + 150) as n from p),
k as (select rec, sum(least(n - s, 150)) as n from e group by 1),
z as (select rec, coalesce(max(length(t)), 0) as n_chars from (select 'p' || id as rec, content as t from paragraphs union all select 'c' || id, quoted_text from citations) where rec is not null group by 1)
select z.rec, n_chars, cast(coalesce(k.n, 0) as bigint) as n_shared from z left join k using (rec)""",
    "p8_leaks": _P8.replace("select doc_id, array_to_string", "select doc_id, s, array_to_string") + """,
p as (select distinct doc_id, item_id, s from dr join ir using (r)),
e as (select doc_id, item_id, s, coalesce(lead(s) over (partition by doc_id, item_id order by s), s + 12) as n from p)
select doc_id, item_id, cast(sum(least(n - s, 12)) as bigint) as n_words from e group by 1, 2""",
    "p8_found": _P8 + "select distinct doc_id, item_id from dr join ir using (r)",
}
