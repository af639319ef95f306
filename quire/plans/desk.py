"""Queries over notes, citations, chosen documents, references and contexts, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import context as C
from quire.operators import ingest as I
from quire.operators import facets as A
from quire.operators import notes as N
from quire.operators import router as R
from quire.operators import search as S
from quire.operators import spans as P
from quire.plans.corpus import DOCS, PARAS, STORED, SYNONYMS, documents, q, sql_fts, sql_holds, sql_norm, sql_search, sql_starts, sql_trim, stored_rebuild
from quire.session import own_dir, table
from quire.sources import desk as D
from quire.sources.library import append_messages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


NOTES = "n as (select distinct * from notes)"
CITES = "c as (select distinct * exclude (received_at) from citations)"


def notes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "notes").select(*N.NOTE).distinct()


def citations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "citations").drop("received_at").distinct()


# ---- notes

@query(f"""with {NOTES}, {CITES} select n.id, n.title, n.note_order, count(c.id) as n_citations, coalesce(string_agg(c.id, ',' order by c.date_added nulls first, c.id), '') as citation_ids
from n left join c on c.note_id = n.id group by 1, 2, 3""")
def notes_with_citations(spark, d):
    nested = N.with_citations(notes(spark, d), citations(spark, d))
    ids = F.array_join(F.transform("citations", lambda c: c["id"]), ",")
    return nested.select("id", "title", "note_order", F.size("citations").cast("long").alias("n_citations"), ids.alias("citation_ids"))


@query(f"with {NOTES}, {CITES} select n.id, count(c.id) as n_citations from n left join c on c.note_id = n.id group by 1")
def citation_counts(spark, d):
    return N.citation_counts(notes(spark, d), citations(spark, d))


@query(f"with {CITES} select note_id, id as citation_id from (select *, row_number() over (partition by note_id order by date_added nulls last, id) as rn from c where note_id is not null) where rn = 1")
def first_citation(spark, d):
    return N.first_citation(citations(spark, d))


@query(f"with {CITES} select id, sermon_id from c where sermon_id is not null and not starts_with(sermon_id, 'ia-') and not starts_with(sermon_id, 'definition') and not starts_with(sermon_id, 'search')")
def cite_filter(spark, d):
    return citations(spark, d).filter(F.col("sermon_id").isNotNull() & ~N.is_virtual(F.col("sermon_id"))).select("id", "sermon_id")


@query(f"with {NOTES} select id, title from n where contains({sql_norm('title')}, 'vigne')")
def note_title_filter(spark, d):
    return N.title_filter(notes(spark, d), "vigne").select("id", "title")


_NEW = "case when color = 'sky' then id else id || '-new' end"


@query(f"""with {NOTES}, new as (select {_NEW} as id, 'changed' as title, content, color, note_order, '2030-01-01' as creation_date, note_date from n where color in ('sky', 'teal'))
select id, title, creation_date from n where id not in (select id from new)
union all select new.id, new.title, coalesce(n.creation_date, new.creation_date) from new left join n on n.id = new.id""")
def note_upsert(spark, d):
    old = notes(spark, d)
    new = old.filter(F.col("color").isin("sky", "teal")).withColumns({"id": F.when(F.col("color") == "sky", F.col("id")).otherwise(F.concat("id", F.lit("-new"))), "title": F.lit("changed"), "creation_date": F.lit("2030-01-01")})
    none = citations(spark, d).limit(0)
    return N.upsert(old, citations(spark, d), new, none)[0].select("id", "title", "creation_date")


@query(f"""with {NOTES}, {CITES}, new as (select {_NEW} as id from n where color in ('sky', 'teal'))
select id, note_id, sermon_id from c where note_id is null or note_id not in (select id from new where id is not null)
union all select c.id || '-again', c.note_id, c.sermon_id from c where note_id in (select id from n where color = 'sky')""")
def note_upsert_citations(spark, d):
    """The citations of saved notes are replaced by those they are saved with."""
    old, held = notes(spark, d), citations(spark, d)
    new = old.filter(F.col("color").isin("sky", "teal")).withColumn("id", F.when(F.col("color") == "sky", F.col("id")).otherwise(F.concat("id", F.lit("-new"))))
    sky = old.filter("color = 'sky'").select(F.col("id").alias("note_id"))
    given = held.join(sky, "note_id", "left_semi").withColumn("id", F.concat("id", F.lit("-again"))).select(*held.columns)
    return N.upsert(old, held, new, given)[1].select("id", "note_id", "sermon_id")


@query(f"""with {NOTES}, {CITES} select id, note_id from c union all
select 'new-' || c.id, coalesce(c.note_id, '?') from c where c.sermon_id is null and coalesce(c.note_id, '?') in (select id from n)""")
def citation_append(spark, d):
    held = citations(spark, d)
    new = held.filter("sermon_id is null").withColumns({"id": F.concat(F.lit("new-"), "id"), "note_id": F.coalesce("note_id", F.lit("?"))})
    return N.add_citation(held, notes(spark, d), new).select("id", "note_id")


@query("select distinct doc_id, 'definition-' || coalesce(lang, 'x') as definition, 'ia-' || cast(n_chars as varchar) as answer from documents")
def virtual_sources(spark, d):
    rows = table(spark, d, "documents")
    return rows.select("doc_id", N.definition_source(F.coalesce("lang", F.lit("x"))).alias("definition"), N.answer_source(F.col("n_chars")).alias("answer")).distinct()


@query(f"""with {NOTES}, {CITES} select n.id, n.title, n.note_order, count(c.id) as n_citations from n left join c on c.note_id = n.id where n.id is not null group by 1, 2, 3""")
def json_notes(spark, d):
    """Notes with their citations written as JSON and read again."""
    path = f"{own_dir(spark)}/notes-{uuid.uuid4().hex}"
    nested = N.with_citations(notes(spark, d).filter("id is not null"), citations(spark, d))
    nested.select("id", "title", "content", "color", F.col("note_order").alias("order"), F.col("creation_date").alias("creationDate"), F.col("note_date").alias("date"), "citations").write.mode("overwrite").json(path)
    read, cites = D.read_notes(spark, path, lines=True)
    return N.with_citations(read, cites, ("id",)).select("id", "title", "note_order", F.size("citations").cast("long").alias("n_citations"))


_RAW = "case when doc_id % 7 = 0 then '{bad' when doc_id % 5 = 0 then '{}' else '{\"word\":\"' || case when doc_id % 2 = 0 then 'MOT' else 'mot' end || (doc_id % 40) || '\",\"definition\":\"d' || doc_id || '\",\"seq\":' || doc_id || '}' end"


@query("select lower('mot' || (doc_id % 40)) as word, 'd' || max(doc_id) as definition from documents where doc_id % 7 <> 0 and doc_id % 5 <> 0 group by 1")
def definition_cache(spark, d):
    """The latest definition of each word in a column of JSON, some of it bad."""
    raw = table(spark, d, "documents").select(F.expr(_RAW).alias("value"))
    held = D.definitions(raw)
    return D.put_definition(held.filter("seq % 2 = 0"), held.filter("seq % 2 = 1")).select("word", "definition")


@query("select coalesce(sermon_id, 'global') as chat_key, doc_id as seq from documents where doc_id is not null")
def chat_append(spark, d):
    path = f"{own_dir(spark)}/chat-{uuid.uuid4().hex}"
    for k in (0, 1):
        append_messages(messages(spark, d).filter(F.pmod("seq", F.lit(2)) == k), path)
    return spark.read.parquet(path).select("chat_key", "seq")


@query(f"""with {DOCS}, s as (select doc_id, [{{'title': title, 'uri': audio_url}}, {{'title': null, 'uri': 'x'}}] as a from docs)
select doc_id, array_to_string(list_transform(list_filter(a, lambda x: x.uri is not null), lambda x: case when x.title <> '' then x.title else 'Source Web' end || ' ' || x.uri), ',') as shown from s""")
def web_sources(spark, d):
    one = F.array(F.struct("title", F.col("audio_url").alias("uri")), F.struct(F.lit(None).cast("string").alias("title"), F.lit("x").alias("uri")))
    found = C.web_sources(one)
    return documents(spark, d).select("doc_id", F.array_join(F.transform(found, lambda s: F.concat(s["title"], F.lit(" "), s["uri"])), ",").alias("shown"))


@query(f"with {DOCS} select distinct doc_id from docs where audio_url <> ''")
def context_replace(spark, d):
    docs = documents(spark, d)
    return N.replace_ids(docs.filter("version = 'TLV'"), docs.filter(X.given(F.col("audio_url"))))


@query(f"""with {CITES}, g as (select note_id, list_sort(list_distinct(list(sermon_id))) as ids from c where note_id is not null and sermon_id is not null group by 1)
select note_id, case when ids = ['57-0000-recueil'] then '' else '57-0000-recueil' end as ids from g""")
def context_toggle_single(spark, d):
    held = citations(spark, d).filter("note_id is not null and sermon_id is not null").groupBy("note_id").agg(F.array_sort(F.collect_set("sermon_id")).alias("ids"))
    return held.select("note_id", F.array_join(N.toggle(F.col("ids"), F.lit("57-0000-recueil"), True), ",").alias("ids"))


@query(f"with {NOTES}, {CITES} select c.id, c.note_id from c where c.note_id is null or c.note_id not in (select id from n where color = 'sky' and id is not null)")
def note_delete(spark, d):
    gone = notes(spark, d).filter("color = 'sky'").select("id")
    return N.delete(notes(spark, d), citations(spark, d), gone)[1].select("id", "note_id")


@query(f"with {NOTES} select id, case when color = 'sky' then null else title end as title, case when color = 'teal' then 'x' else content end as content from n")
def note_patch(spark, d):
    old = notes(spark, d)
    sky, teal = F.col("color") == "sky", F.col("color") == "teal"
    changes = old.filter("color in ('sky', 'teal')").select("id", F.lit(None).cast("string").alias("title"), F.lit("x").alias("content"), sky.alias("set_title"), teal.alias("set_content"))
    return N.patch(old, changes, ("title", "content")).select("id", "title", "content")


@query(f"with {NOTES} select id, row_number() over (order by note_order nulls last, id) - 1 as position from n")
def note_positions(spark, d):
    return N.positions(notes(spark, d))


@query(f"""with {NOTES}, o as (select id, row_number() over (order by note_order nulls last, id) - 1 as p from n),
e as (select max(case when p = 7 then id end) as a, max(case when p = 3 then id end) as b from o)
select id, row_number() over (order by case when p = 7 then 2.5 else p end) - 1 as position from o""")
def note_reorder(spark, d):
    placed = N.positions(notes(spark, d))
    ends = {r["position"]: r["id"] for r in placed.filter("position in (3, 7)").collect()}
    return N.move(placed, ends.get(7, ""), ends.get(3, ""))


@query(f"""with {PARAS} select p.doc_id as sermon_id, d.title as sermon_title_snapshot, d.sermon_date as sermon_date_snapshot, d.version as sermon_version_snapshot, p.content as quoted_text, p.paragraph_index
from paras p join docs d using (doc_id)""")
def citation_snapshot(spark, d):
    docs = documents(spark, d)
    return N.snapshot(docs, I.paragraphs(docs))


@query(f"with {NOTES} select id, lower(regexp_replace(title, {q('[' + X.WS + ']+')}, '_', 'g')) as file_name from n")
def note_file_names(spark, d):
    return notes(spark, d).select("id", N.file_name(F.col("title")).alias("file_name"))


@query(f"""with {NOTES}, {CITES} select n.id, lower(regexp_replace(coalesce(n.title, ''), {q('[' + X.WS + ']+')}, '_', 'g')) as file_name,
  coalesce(n.title, '') || E'\\n' || coalesce(n.content, '') || coalesce(E'\\n' || x.lines, '') as body
from n left join (select note_id, string_agg(k || '. ' || t, E'\\n' order by k) as lines from (
  select note_id, coalesce(quoted_text, '') as t, row_number() over (partition by note_id order by date_added nulls first, id) as k from c) group by 1) x on x.note_id = n.id""")
def note_export(spark, d):
    return N.export_text(N.with_citations(notes(spark, d), citations(spark, d)))


# ---- sets of chosen documents

@query(f"with {DOCS} select distinct doc_id from (select doc_id from docs where version = 'TLV' union all select doc_id from docs where audio_url <> '')")
def context_union(spark, d):
    docs = documents(spark, d)
    return N.union_ids(docs.filter("version = 'TLV'"), docs.filter(X.given(F.col("audio_url"))))


@query(f"with {DOCS} select doc_id from docs where version = 'TLV' and not coalesce(audio_url <> '', false)")
def context_except(spark, d):
    docs = documents(spark, d)
    return N.except_ids(docs.filter("version = 'TLV'"), docs.filter(X.given(F.col("audio_url"))))


@query(f"""with {CITES}, g as (select note_id, list_sort(list_distinct(list(sermon_id))) as ids from c where note_id is not null and sermon_id is not null group by 1)
select note_id, array_to_string(case when list_contains(ids, '57-0000-recueil') then list_filter(ids, lambda x: x <> '57-0000-recueil') else list_append(ids, '57-0000-recueil') end, ',') as ids from g""")
def context_toggle(spark, d):
    held = citations(spark, d).filter("note_id is not null and sermon_id is not null").groupBy("note_id").agg(F.array_sort(F.collect_set("sermon_id")).alias("ids"))
    return held.select("note_id", F.array_join(N.toggle(F.col("ids"), F.lit("57-0000-recueil")), ",").alias("ids"))


@query(f"with {CITES}, {DOCS} select doc_id, title, sermon_date from docs where doc_id in (select trim(sermon_id) from c where sermon_id is not null)")
def selected_metadata(spark, d):
    cited = citations(spark, d).select(F.trim("sermon_id").alias("doc_id"))
    return C.selected_metadata(documents(spark, d), cited)


@query(f"with {CITES} select note_id, case when ids is null or ids = '' then 'global' else ids end as chat_key from (select note_id, string_agg(distinct sermon_id, ',' order by sermon_id) as ids from c where note_id is not null group by 1)")
def chat_key(spark, d):
    held = citations(spark, d).filter("note_id is not null").groupBy("note_id").agg(F.array_sort(F.collect_set("sermon_id")).alias("ids"))
    return held.select("note_id", C.chat_key(F.col("ids")).alias("chat_key"))


# ---- references

_WS = "[" + X.WS + "]*"
_TAG = "(?i)\\[R[éÉ]f:" + _WS + "([A-Za-z0-9_-]+)," + _WS + "Para\\." + _WS + "([0-9]+)" + _WS + "\\]"
_PLAIN = "(?i)\\[R[éÉ]f:" + _WS + "([A-Za-z0-9_-]+)" + _WS + "\\]"
_REFS = f"""t as (select distinct 'n' || id as key, content as s from notes where id is not null union select 'd' || doc_id, text from documents),
refs as (
  select key, k as ref_no, regexp_extract_all(s, {q(_TAG)}, 1)[k] as ref_id, try_cast(regexp_extract_all(s, {q(_TAG)}, 2)[k] as bigint) as paragraph_index
  from t, unnest(range(1, len(regexp_extract_all(s, {q(_TAG)})) + 1)) u(k))"""


def _texts(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "notes").filter("id is not null").select(F.concat(F.lit("n"), "id").alias("key"), F.col("content").alias("s"))
    return own.unionByName(table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), F.col("text").alias("s"))).distinct()


@query(f"with {_REFS} select key, ref_no, ref_id, paragraph_index from refs")
def reference_extract(spark, d):
    return C.references(_texts(spark, d), "key", "s")


_SERMONS = "s as (select id as doc_id, arg_min(title, (epoch_us(imported_at), coalesce(title, ''))) as title, arg_min(sermon_date, (epoch_us(imported_at), coalesce(title, ''))) as sermon_date from sermons group by 1)"


def sermons(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sermons").select(F.col("id").alias("doc_id"), "title", "sermon_date", F.struct("imported_at", F.coalesce("title", F.lit(""))).alias("ord"))


@query(f"with {_REFS}, k as (select distinct id from sermons) select key, ref_no, ref_id, paragraph_index, k.id is not null as known from refs left join k on k.id = ref_id")
def reference_resolve(spark, d):
    return C.resolved(C.references(_texts(spark, d), "key", "s"), sermons(spark, d)).select("key", "ref_no", "ref_id", "paragraph_index", "known")


_CUT = ", Para\\. [0-9]+"
_PREFS = f"""t as (select distinct 'n' || id as key, regexp_replace(content, {q(_CUT)}, '', 'g') as s from notes where id is not null union select 'd' || doc_id, regexp_replace(text, {q(_CUT)}, '', 'g') from documents),
prefs as (select key, k as ref_no, regexp_extract_all(s, {q(_PLAIN)}, 1)[k] as ref_id from t, unnest(range(1, len(regexp_extract_all(s, {q(_PLAIN)})) + 1)) u(k))"""


@query(f"with {_PREFS}, {_SERMONS} select key, ref_no, ref_id, '[' || case when s.doc_id is not null then coalesce(s.title, '') else ref_id end || ']' as label from prefs left join s on s.doc_id = ref_id")
def reference_titles(spark, d):
    without = _texts(spark, d).select("key", F.regexp_replace("s", _CUT, "").alias("s")).distinct()
    found = C.titles(C.plain_references(without, "key", "s"), sermons(spark, d))
    return found.select("key", "ref_no", "ref_id", "label")


@query(f"""with {CITES}, {DOCS}, own as (
  select distinct c.id from c, unnest(regexp_extract_all(quoted_text, {q(_PLAIN)}, 1)) u(r) where r in (select doc_id from docs))
select c.id, replace(coalesce(quoted_text, ''), '[[[NOTE_EXTERNE]]]', E'> **Note**\\n\\n>') || case when c.id not in (select id from own) and docs.doc_id is not null and sermon_id <> '' and not contains(sermon_id, 'ia-') and not contains(sermon_id, 'definition')
  then ' [Source: ' || coalesce(docs.title, '') || ']' else '' end as body
from c left join docs on docs.doc_id = c.sermon_id""")
def citation_bodies(spark, d):
    return C.rich_content(citations(spark, d), documents(spark, d))


# ---- contexts

@query(f"""with {DOCS}, p as (
  select coalesce(version, '') as grp, ord, doc_id, '[DOC ID: ' || doc_id || '] - TITRE: ' || coalesce(title, 'null') || ' (' || coalesce(sermon_date, 'null') || E')\\nCONTENU:\\n'
    || substr(array_to_string(list_transform(string_split_regex(text, {q(X.BLANK_LINE)}), lambda x, i: '[Para. ' || i || '] ' || {sql_trim('x')}), E'\\n'), 1, 15000) as part
  from docs where text <> ''),
b as (select *, coalesce(sum(length(part) + 7) over (partition by grp order by ord, doc_id rows between unbounded preceding and 1 preceding), 0) as before from p)
select grp, substr(string_agg(part, E'\\n\\n---\\n\\n' order by ord, doc_id), 1, 60000) as context from b where before < 60000 group by 1""")
def context_chat(spark, d):
    docs = documents(spark, d).withColumn("grp", F.coalesce("version", F.lit("")))
    return C.chat_context(docs, "grp")




@query(f"""with {DOCS}, m as (select doc_id, text from docs where text <> '' order by ord limit 1),
o as (select ord, 'ID: ' || doc_id || ' | ' || coalesce(title, '') || E'\\nCONTENU:\\n' || substr(coalesce(text, ''), 1, 8000) as part from docs where version = 'TLV' and doc_id <> (select doc_id from m) order by ord, doc_id limit 3)
select doc_id, substr(text, 1, 30000) as main, (select coalesce(string_agg(part, E'\\n\\n---\\n\\n' order by ord), '') from o) as others from m""")
def context_study(spark, d):
    docs = documents(spark, d)
    first = docs.filter(X.given(F.col("text"))).orderBy("ord").limit(1).select("doc_id").collect()
    chosen = docs.filter("version = 'TLV'").select("doc_id", F.col("ord").alias("place"))
    return C.study_context(docs, chosen, first[0]["doc_id"] if first else "")


_CHAT = "m as (select coalesce(sermon_id, 'global') as chat_key, doc_id as seq, case when kind in ('answer', 'sermon') then 'assistant' else 'user' end as role, text as content from documents)"


def messages(spark: SparkSession, d: str) -> DataFrame:
    role = F.when(F.col("kind").isin("answer", "sermon"), "assistant").otherwise("user")
    return table(spark, d, "documents").select(F.coalesce("sermon_id", F.lit("global")).alias("chat_key"), F.col("doc_id").alias("seq"), role.alias("role"), F.col("text").alias("content"))


@query(f"with {_CHAT} select chat_key, seq, case when role = 'assistant' then 'model' else 'user' end as role, content from (select *, row_number() over (partition by chat_key order by seq desc) as rn from m) where rn <= 4")
def history_last4(spark, d):
    return C.last_messages(messages(spark, d))


@query(f"""with {_CHAT}, k as (select chat_key, max(seq) as top from m group by 1),
h as (select m.*, row_number() over (partition by m.chat_key order by seq desc) as rn from m join k using (chat_key) where seq < top)
select chat_key, seq, case when role = 'assistant' then 'model' else 'user' end as role, content from h where rn <= 4
union all select m.chat_key, seq, 'user', content from m join k on k.chat_key = m.chat_key and k.top = m.seq""")
def prompt_messages(spark, d):
    all_ = messages(spark, d)
    top = all_.groupBy("chat_key").agg(F.max("seq").alias("top"))
    both = all_.join(top, "chat_key")
    return C.prompt(both.filter("seq < top").drop("top"), both.filter("seq = top").drop("top"))


@query(f"""with {CITES} select distinct id, case when length(quoted_text) > 150 and len(regexp_extract_all(quoted_text, '[^.!?]+[.!?]+')) > 0 and {sql_trim("regexp_extract_all(quoted_text, '[^.!?]+[.!?]+')[-1]")} <> ''
  then {sql_trim("regexp_extract_all(quoted_text, '[^.!?]+[.!?]+')[-1]")} else quoted_text end as sentence from c""")
def last_sentence(spark, d):
    return citations(spark, d).select("id", X.last_sentence(F.col("quoted_text")).alias("sentence")).distinct()


@query(f"with {CITES} select distinct id, regexp_replace(string_split(quoted_text, ' ')[1], '[.,;?!]', '', 'g') as word from c")
def first_word(spark, d):
    return citations(spark, d).select("id", X.first_word(F.col("quoted_text")).alias("word")).distinct()


@query("""with v as (select distinct value, cast(floor(value / 60) as bigint) as m, cast(floor(value) as bigint) as w from events)
select value, case when value is null or isnan(value) then '0:00' else m || ':' || case when length(cast(w % 60 as varchar)) < 2 then '0' || (w % 60) else cast(w % 60 as varchar) end end as shown from v""")
def time_format(spark, d):
    return table(spark, d, "events").select("value", X.minutes(F.col("value")).alias("shown")).distinct()


@query(f"with {DOCS} select doc_id, case substr(sermon_date, 6, 2) " + " ".join(f"when '{i:02d}' then {q(m)}" for i, m in enumerate(X.MONTHS["en"], 1)) + " end as month from docs")
def month_names(spark, d):
    return documents(spark, d).select("doc_id", X.month_name(F.substring("sermon_date", 6, 2), "en").alias("month"))


_DICTIONARY = [("Rocher", "a rock", ["pierre", "roc"], None, 1), ("rocher", "a large rock", ["pierre"], "roche", 2), ("vigne", "a vine", [], None, 3)]


@query(f"""with w as (select distinct lower(string_split(title, ' ')[2]) as word from library where title is not null),
dict as (select * from (values ('rocher', 'a large rock', 'pierre', 'roche'), ('vigne', 'a vine', '', null)) v(k, definition, synonyms, etymology))
select word, '**' || word || E'**\\n\\n' || definition || E'\\n\\n*Étymologie :* ' || coalesce(etymology, 'Non spécifiée') || E'\\n*Synonymes :* ' || synonyms as body from w left join dict on k = word""")
def definition_lookup(spark, d):
    words = table(spark, d, "library").filter("title is not null").select(F.lower(F.try_element_at(F.split("title", " "), F.lit(2))).alias("word")).distinct()
    held = spark.createDataFrame(_DICTIONARY, "word string, definition string, synonyms array<string>, etymology string, seq long")
    found = C.definitions(words, held)
    return found.select("word", C.definition_text(F.col("word"), F.col("definition"), F.col("etymology"), F.col("synonyms")).alias("body"))


# ---- look-ups, routing, covered tokens

KEY = "57-0000-recueil"


@query(f"{'with ' + STORED} select doc_id, length(text) as n_chars from st where doc_id = {q(KEY)}")
def point_lookup(spark, d):
    rows = table(spark, d, "paragraphs").filter(F.col("sermon_id") == KEY).select("sermon_id", "paragraph_index", "id", "content").filter("content is not null").distinct()
    return I.rebuild(rows, "sermon_id").select(F.col("sermon_id").alias("doc_id"), F.length("text").cast("long").alias("n_chars"))


@query("select distinct id, content from paragraphs where id = 17")
def paragraph_content(spark, d):
    return table(spark, d, "paragraphs").filter("id = 17").select("id", "content").distinct()


def _routed(spark: SparkSession, d: str, request: R.Request) -> DataFrame:
    docs = documents(spark, d)
    return R.search(I.paragraphs(docs), docs, request, SYNONYMS)


_SHOWN = "select paragraph_id, doc_id, paragraph_index, title, sermon_date, city from"


@query(sql_search(sql_holds(['rocher', *S.synonyms_of(SYNONYMS, 'rocher')]), X.words_pattern(" ".join(["rocher", *S.synonyms_of(SYNONYMS, 'rocher')]))))
def route_scan_synonyms(spark, d):
    return _routed(spark, d, R.Request("rocher", synonyms=True))


@query(f"{_SHOWN} ({sql_fts(sql_starts(['lumiere']))})")
def route_fts(spark, d):
    # the snippets of the token engine have no SQL
    return _routed(spark, d, R.Request("lumière", S.Mode.DIVERSE, engine="fts")).drop("snippet")


@query(sql_search(sql_holds(['umier']), X.phrase_pattern("umier")))
def route_fallback(spark, d):
    """Tokens don't find the middle of a word; the scan does."""
    return _routed(spark, d, R.Request("umier", engine="auto"))


@query("select cast(null as varchar) as paragraph_id, cast(null as varchar) as doc_id, cast(null as bigint) as paragraph_index, cast(null as varchar) as title, cast(null as varchar) as sermon_date, cast(null as varchar) as city where false")
def route_short(spark, d):
    return _routed(spark, d, R.Request("x")).drop("snippet")


@query(sql_search(sql_holds(["puits"]), X.phrase_pattern("puits")))
def kept_results(spark, d):
    """The page that was asked for before, kept in memory."""
    docs = documents(spark, d)
    kept = R.Kept(I.paragraphs(docs), docs)
    kept.search(R.Request("puits"))
    return kept.search(R.Request("puits"))


_QUOTES = """quo as (select distinct id as quote_id, note_id, trim(sermon_id) as doc_id, quoted_text as quote from citations where quoted_text <> ''),
body as (select doc_id, regexp_replace(text, {blank}, '', 'g') as b from st),
cutq as (select quote_id, note_id, doc_id, quote, string_split(b, quote) as p from quo join body using (doc_id) where contains(b, quote)),
place as (select quote_id, note_id, doc_id, list_sum(list_transform(p[1:k], lambda x: length(x))) + (k - 1) * length(quote) as start, length(quote) as size from cutq, unnest(range(1, len(p))) u(k)),
seg as (select doc_id, i as seg_no, string_split_regex(text, {blank})[i] as s from st, unnest(range(1, len(string_split_regex(text, {blank})) + 1)) u(i)),
tk as (select doc_id, seg_no, regexp_extract_all(s, {token}) as t from seg),
tl as (select doc_id, row_number() over (partition by doc_id order by seg_no, j) - 1 as g, t[j] as token from tk, unnest(range(1, len(t) + 1)) u(j)),
tp as (select doc_id, g, sum(length(token)) over (partition by doc_id order by g) as e, length(token) as n from tl)""".replace("{blank}", q(X.BLANK_LINE)).replace("{token}", q(X.TOKEN))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    return stored_rebuild(spark, d).withColumnRenamed("sermon_id", "doc_id")


@query(f"""with {STORED}, {_QUOTES}, col as (select id as note_id, min(case when color <> '' then color else 'default' end) as color from notes group by 1)
select distinct note_id, tp.doc_id, g as global_index, color from place join tp on tp.doc_id = place.doc_id and e > start and e - n < start + size join col using (note_id)""")
def citation_colours(spark, d):
    docs = _stored(spark, d)
    own = citations(spark, d).withColumn("sermon_id", F.trim("sermon_id"))
    return P.citation_colours(docs, P.with_offsets(P.tokens(docs)), own, notes(spark, d))


@query(f"""with {STORED}, {_QUOTES}, one as (select quote_id, doc_id, min(start) as start, min(size) as size from place group by 1, 2)
select quote_id, tp.doc_id, g as global_index from one join tp on tp.doc_id = one.doc_id and e > start and e - n < start + size""")
def quote_first_tokens(spark, d):
    docs = _stored(spark, d)
    own = citations(spark, d).select(F.col("id").alias("quote_id"), F.trim("sermon_id").alias("doc_id"), F.col("quoted_text").alias("quote"))
    return P.first_quote_tokens(docs, P.with_offsets(P.tokens(docs)), own)


@query(f"with {NOTES}, k as (select count(distinct id) as c from n) select id, note_order, creation_date from n union all select 'new-' || i, cast(c + i as integer), '2030-01-02T03:04:05Z' from k, unnest(range(0, 3)) u(i)")
def new_notes(spark, d):
    drafts = spark.range(3).select(F.concat(F.lit("new-"), F.col("id").cast("string")).alias("id"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("content"))
    return N.new_notes(notes(spark, d), drafts, "2030-01-02T03:04:05Z").select("id", "note_order", "creation_date")


@query(f"with {CITES} select id, note_id from c where sermon_id = {q(KEY)}")
def document_citations(spark, d):
    return N.citations_of(citations(spark, d), KEY).select("id", "note_id")


@query(f"with {DOCS} select doc_id from docs where city <> '' and version = 'TLV' and substr(sermon_date, 6, 2) = '04'")
def facet_month_version(spark, d):
    return A.filtered(documents(spark, d), month="04", version="TLV").filter(X.given(F.col("city"))).select("doc_id")


@query("select distinct doc_id, n_chars, case when n_chars is not null then least(150.0, greatest(8.0, sqrt(n_chars))) end as size from documents")
def clamped_size(spark, d):
    rows = table(spark, d, "documents")
    return rows.select("doc_id", "n_chars", X.clamp(F.sqrt("n_chars"), 8.0, 150.0).alias("size")).distinct()
