"""Queries over the test tables with the SQL that gives the same rows.

Both sides are built from the same literals; the SQL is written for DuckDB.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import facets as A
from quire.operators import ingest as I
from quire.operators import search as S
from quire.operators import spans as P
from quire.session import own_dir, table
from quire.sources import library as L

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


def q(text: str) -> str:
    """A SQL literal."""
    return "'" + text.replace("'", "''") + "'"


# ---- shared parts of the SQL

def sql_norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce({x}, ''))), {q('[' + X.PUNCTUATION + ']')}, '', 'g'), {q('[' + X.WS + ']+')}, ' ', 'g'))"


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^[{X.WS}]+|[{X.WS}]+$')}, '', 'g')"


def sql_tokens(x: str) -> str:
    return f"regexp_extract_all(lower(strip_accents({x})), {q(X.FTS_TOKEN)})"


KEYED = """keyed as (
  select *, case when version <> '' then base || '-' || version else base end as doc_id
  from (select *, case when id <> '' then id else 'gen-' || substr(sha256(cast(ord as varchar)), 1, 9) end as base from library))"""
DOCS = KEYED + """,
docs as (select * exclude (rn) from (select *, row_number() over (partition by doc_id order by ord) as rn from keyed) where rn = 1)"""
PARAS = DOCS + f""",
raw as (select doc_id, ord, title, sermon_date, city, string_split_regex(text, {q(X.BLANK_LINE)}) as parts from docs),
paras as (
  select * from (
    select doc_id, ord, title, sermon_date, city, i as paragraph_index, doc_id || '-' || (i - 1) as paragraph_id, {sql_trim('parts[i]')} as content
    from raw, unnest(range(1, len(parts) + 1)) u(i)) where content <> '')"""
TOKENS = DOCS + f""",
seg as (select doc_id, i as seg_no, string_split_regex(text, {q(X.BLANK_LINE)})[i] as seg from docs, unnest(range(1, len(string_split_regex(text, {q(X.BLANK_LINE)})) + 1)) u(i)),
parts as (select doc_id, seg_no, regexp_extract_all(seg, {q(X.TOKEN)}) as t from seg),
toks as (
  select doc_id, seg_no - 1 as segment_index, row_number() over (partition by doc_id order by seg_no, j) - 1 as global_index, t[j] as token
  from parts, unnest(range(1, len(t) + 1)) u(j)),
places as (select *, sum(length(token)) over (partition by doc_id order by global_index) - length(token) as start, sum(length(token)) over (partition by doc_id order by global_index) as "end" from toks)"""
NEWEST = "order by sermon_date desc nulls last, ord, paragraph_index"


def sql_spans(pattern: str) -> str:
    """CTEs glue, found: the matches of a pattern in the glued texts."""
    return f"""
glue as (select doc_id, regexp_replace(text, {q(X.BLANK_LINE)}, '', 'g') as body from docs),
cut as (select doc_id, string_split_regex(body, {q(pattern)}) as p, regexp_extract_all(body, {q(pattern)}) as m from glue where body is not null),
found as (
  select doc_id, k as match_no, list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : k - 1], lambda x: length(x))), 0) as start, m[k] as match
  from cut, unnest(range(1, len(m) + 1)) u(k)),
spans as (select doc_id, match_no, cast(start as bigint) as start, cast(start + length(match) as bigint) as "end", match from found)"""


# ---- the documents

def keyed(spark: SparkSession, d: str) -> DataFrame:
    return I.with_key(table(spark, d, "library"))


def documents(spark: SparkSession, d: str, keep: str = "first") -> DataFrame:
    return I.dedupe(keyed(spark, d), keep)


def searchable(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs with what search shows of their document."""
    return I.paragraphs(documents(spark, d), keep=("ord", "title", "sermon_date", "city"))


@query(f"with {KEYED} select ord, doc_id from keyed")
def composite_key(spark, d):
    return keyed(spark, d).select("ord", "doc_id")


@query(f"with {DOCS} select doc_id, ord, title from docs")
def dedupe_first(spark, d):
    return documents(spark, d).select("doc_id", "ord", "title")


@query(f"with {KEYED} select doc_id, max(ord) as ord from keyed group by 1")
def dedupe_last(spark, d):
    return documents(spark, d, "last").select("doc_id", "ord")


@query("with " + DOCS + " select doc_id, " + ", ".join(f"case when {c} <> '' then {c} else {q(v)} end as {c}" for c, v in I.DEFAULTS.items()) + " from docs")
def default_fields(spark, d):
    return I.with_defaults(documents(spark, d)).select("doc_id", *I.DEFAULTS)


@query(f"with {DOCS} select doc_id, title, sermon_date, city, version, part_of_day, audio_url from docs")
def metadata_desc(spark, d):
    return I.metadata(documents(spark, d))


@query(f"with {DOCS} select count(*) as n from docs")
def document_count(spark, d):
    return documents(spark, d).agg(F.count("*").alias("n"))


@query(f"with {PARAS} select doc_id, paragraph_id, paragraph_index, content from paras")
def paragraphs(spark, d):
    return I.paragraphs(documents(spark, d))


@query(f"with {PARAS} select doc_id, string_agg(content, E'\\n\\n' order by paragraph_index) as text from paras group by 1")
def document_rebuild(spark, d):
    return I.rebuild(I.paragraphs(documents(spark, d)))


@query("with p as (select distinct sermon_id, paragraph_index, id, content from paragraphs) select sermon_id, string_agg(content, E'\\n\\n' order by paragraph_index, content) as text from p where content is not null group by 1")
def stored_rebuild(spark, d):
    rows = table(spark, d, "paragraphs").select("sermon_id", "paragraph_index", "id", "content").filter("content is not null").distinct()
    return I.rebuild(rows, "sermon_id")


@query(f"with {DOCS} select doc_id, length(text) as n_chars from docs where text <> '' and doc_id in (select trim(sermon_id) from citations)")
def full_documents(spark, d):
    cited = table(spark, d, "citations").select(F.trim("sermon_id").alias("doc_id"))
    return I.full_documents(documents(spark, d), cited).select("doc_id", F.length("text").cast("long").alias("n_chars"))


@query(f"with {PARAS} select doc_id, paragraph_index, regexp_matches(content, '^[0-9]') as is_numbered from paras")
def numbered_paragraphs(spark, d):
    return I.numbered(documents(spark, d))


@query(f"select id, paragraph_index, {sql_norm('content')} as norm from (select distinct id, paragraph_index, content from paragraphs)")
def normalize_text(spark, d):
    rows = table(spark, d, "paragraphs").select("id", "paragraph_index", "content").distinct()
    return rows.select("id", "paragraph_index", X.norm(F.col("content")).alias("norm"))


# ---- search

#: Literals of the searches.
PHRASE, ANY, ALL, PART, PUNCT = "cette lumière", "agneau lighthouse vigne", "puits rocher", "mer", "?!"
SYNONYMS = {"rocher": ["pierre", "montagne", "rock", "roca", "sommet", "colline", "caillou", "bloc", "galet"]}


def sql_snippet(pattern: str) -> str:
    at = f"length(string_split_regex(content, {q(pattern)})[1])"
    return f"""case when regexp_matches(content, {q(pattern)}) then
      (case when {at} > 150 then '...' else '' end) || substr(content, cast(greatest({at} - 150, 0) + 1 as bigint), cast(least({at} + 450, length(content)) - greatest({at} - 150, 0) as bigint))
      || (case when {at} + 450 < length(content) then '...' else '' end)
    else substr(content, 1, 600) || (case when length(content) > 600 then '...' else '' end) end"""


def sql_search(condition: str, pattern: str | None, limit: int = 50, offset: int = 0) -> str:
    shown = f"regexp_replace({sql_snippet(pattern)}, {q(pattern)}, '<mark>\\1</mark>', 'g')" if pattern else "substr(content, 1, 600)"
    return f"""with {PARAS}, norm as (select *, {sql_norm('content')} as n from paras),
hits as (select * from norm where {condition} {NEWEST} limit {limit} offset {offset})
select paragraph_id, doc_id, paragraph_index, {shown} as snippet, title, sermon_date, city from hits"""


def sql_holds(words: list[str], how: str = "or") -> str:
    return "(" + f" {how} ".join(f"contains(n, {q(w)})" for w in words) + ")"


@query(sql_search(sql_holds([X.norm_text(PHRASE)]), X.phrase_pattern(PHRASE)))
def search_phrase(spark, d):
    return S.scan(searchable(spark, d), PHRASE, S.Mode.EXACT_PHRASE)


@query(sql_search(sql_holds(X.norm_text(ANY).split()), X.words_pattern(ANY)))
def search_any(spark, d):
    return S.scan(searchable(spark, d), ANY, S.Mode.DIVERSE)


@query(sql_search(sql_holds(X.norm_text(ALL).split(), "and"), X.words_pattern(ALL)))
def search_all(spark, d):
    return S.scan(searchable(spark, d), ALL, S.Mode.EXACT_WORDS)


@query(sql_search(sql_holds([PART], "and"), X.words_pattern(PART)))
def search_partial(spark, d):
    return S.scan(searchable(spark, d), PART, S.Mode.PARTIAL)


@query(sql_search(sql_holds(["notre"]), X.phrase_pattern("notre"), 20, 20))
def search_page2(spark, d):
    return S.scan(searchable(spark, d), "notre", S.Mode.EXACT_PHRASE, limit=20, offset=20)


_SYN = S.synonyms_of(SYNONYMS, "rocher")


@query(sql_search(sql_holds(["rocher", *_SYN]), X.words_pattern(" ".join(["rocher", *_SYN]))))
def search_synonyms(spark, d):
    return S.scan(searchable(spark, d), "rocher", S.Mode.EXACT_PHRASE, S.synonyms_of(SYNONYMS, "rocher"))


@query(sql_search(sql_holds(_SYN), X.words_pattern(" ".join(_SYN))))
def search_only_synonyms(spark, d):
    return S.scan(searchable(spark, d), "rocher", S.Mode.EXACT_PHRASE, S.synonyms_of(SYNONYMS, "rocher"), only_synonyms=True)


@query(sql_search(sql_holds(["rocher"]), X.phrase_pattern("rocher")))
def search_only_query(spark, d):
    return S.scan(searchable(spark, d), "rocher", S.Mode.EXACT_PHRASE, S.synonyms_of(SYNONYMS, "rocher"), only_query=True)


@query(sql_search("true", X.phrase_pattern(PUNCT)))
def search_punct_vacuous(spark, d):
    return S.scan(searchable(spark, d), PUNCT, S.Mode.EXACT_PHRASE)


@query(f"with {PARAS} select paragraph_id, {sql_snippet(X.words_pattern(ANY))} as snippet from paras")
def search_snippet(spark, d):
    return I.paragraphs(documents(spark, d)).select("paragraph_id", X.snippet(F.col("content"), X.words_pattern(ANY)).alias("snippet"))


@query(f"with {PARAS} select paragraph_id, regexp_replace(content, {q(X.phrase_pattern(PHRASE))}, '<mark>\\1</mark>', 'g') as marked from paras")
def search_highlight(spark, d):
    return I.paragraphs(documents(spark, d)).select("paragraph_id", X.highlight(F.col("content"), X.phrase_pattern(PHRASE)).alias("marked"))


@query(f"with {PARAS} select paragraph_id, content as plain from paras")
def strip_marks(spark, d):
    marked = X.highlight(F.col("content"), X.words_pattern(ANY))
    return I.paragraphs(documents(spark, d)).select("paragraph_id", X.strip_marks(marked).alias("plain"))


def sql_fts(condition: str, limit: int = 50) -> str:
    return f"""with {PARAS}, f as (select *, {sql_tokens('content')} as tokens from paras)
select paragraph_id, doc_id, paragraph_index, content, title, sermon_date, city from (select * from f where {condition} {NEWEST} limit {limit})"""


def sql_starts(words: list[str], how: str = "or") -> str:
    return f" {how} ".join(f"len(list_filter(tokens, lambda t: starts_with(t, {q(w)}))) > 0" for w in words)


def _fts(spark, d, *args, **kwargs) -> DataFrame:
    docs = documents(spark, d)
    return S.fts(I.paragraphs(docs), docs, *args, **kwargs)


@query(sql_fts(f"contains(' ' || array_to_string(tokens, ' ') || ' ', {q(' ' + X.norm_text(PHRASE) + ' ')})"))
def fts_phrase(spark, d):
    return _fts(spark, d, PHRASE, S.Mode.EXACT_PHRASE)


@query(sql_fts(sql_starts(X.norm_text(ANY).split())))
def fts_prefix_any(spark, d):
    return _fts(spark, d, ANY, S.Mode.DIVERSE)


@query(sql_fts(sql_starts(["puits", "roch"], "and")))
def fts_prefix_all(spark, d):
    return _fts(spark, d, "puits roch", S.Mode.EXACT_WORDS)


@query(sql_fts(sql_starts(["rocher", "pierre"]) + " or (list_contains(tokens, 'notre') and " + sql_starts(["mont"]) + ")"))
def fts_synonyms(spark, d):
    return _fts(spark, d, "rocher", S.Mode.EXACT_PHRASE, ["pierre", "notre mont"])


#: Written indexes by application and data directory.
_INDEXES: dict[tuple[str, str], str] = {}


def written_index(spark: SparkSession, d: str) -> DataFrame:
    """The positions of all paragraphs' tokens, written in ranges of tokens once a session and read from there."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES or not L.exists(spark, _INDEXES[key]):
        path = f"{own_dir(spark)}/index-{uuid.uuid4().hex}"
        S.write_postings(S.positions(I.paragraphs(documents(spark, d))), path)
        _INDEXES[key] = path
    return spark.read.schema("token string, doc_id string, paragraph_index bigint, positions array<int>").parquet(_INDEXES[key])


def _indexed(spark, d, *args, **kwargs) -> DataFrame:
    docs = documents(spark, d)
    return S.indexed(written_index(spark, d), I.paragraphs(docs), docs, *args, **kwargs)


@query(ORACLE["fts_phrase"])
def index_phrase(spark, d):
    return _indexed(spark, d, PHRASE, S.Mode.EXACT_PHRASE)


@query(ORACLE["fts_prefix_any"])
def index_prefix_any(spark, d):
    return _indexed(spark, d, ANY, S.Mode.DIVERSE)


@query(ORACLE["fts_prefix_all"])
def index_prefix_all(spark, d):
    return _indexed(spark, d, "puits roch", S.Mode.EXACT_WORDS)


@query(ORACLE["fts_synonyms"])
def index_synonyms(spark, d):
    return _indexed(spark, d, "rocher", S.Mode.EXACT_PHRASE, ["pierre", "notre mont"])


@query()
def fts_snippet(spark, d):
    return _fts(spark, d, PHRASE, S.Mode.EXACT_PHRASE).select("paragraph_id", S.fts_snippet(F.col("content"), X.norm_text(PHRASE).split()).alias("snippet"))


@query(f"with {PARAS} select token, doc_id, paragraph_index, count(*) as n from (select doc_id, paragraph_index, unnest({sql_tokens('content')}) as token from paras) group by 1, 2, 3")
def postings(spark, d):
    return S.postings(I.paragraphs(documents(spark, d)))


@query(f"""with {PARAS}, t as (select doc_id, paragraph_index, unnest({sql_tokens('content')}) as token from paras)
select doc_id, paragraph_index, count(*) as n from t where starts_with(token, 'puits') or starts_with(token, 'roch') group by 1, 2
having bool_or(starts_with(token, 'puits')) and bool_or(starts_with(token, 'roch'))""")
def index_lookup(spark, d):
    return S.by_index(S.postings(I.paragraphs(documents(spark, d))), ["Puits", "roch"])


@query(f"""with {PARAS}, hits as (select *, row_number() over ({NEWEST}) as n from paras where contains({sql_norm('content')}, {q(X.norm_text(PHRASE))}))
select n, n || '. ' || coalesce(title, 'null') || ' (' || coalesce(sermon_date, 'null') || ') - Para ' || paragraph_index as line from hits where n <= 25""")
def export_lines(spark, d):
    hits = searchable(spark, d).filter(S.scan_condition(X.norm(F.col("content")), PHRASE, S.Mode.EXACT_PHRASE))
    return S.export_lines(hits)


# ---- facets

@query(f"with {DOCS} select doc_id, title from docs where contains({sql_norm('title')}, 'la')")
def title_filter(spark, d):
    return A.filtered(documents(spark, d), title="Lâ!").select("doc_id", "title")


@query(f"with {DOCS} select doc_id, sermon_date from docs where starts_with(sermon_date, '19') and substr(sermon_date, 6, 2) = '04' and substr(sermon_date, 9, 2) = '21'")
def date_parts_filter(spark, d):
    return A.filtered(documents(spark, d), year="19", month="04", day="21").select("doc_id", "sermon_date")


@query(f"with {DOCS} select doc_id, city, version from docs where version = 'TLV' and part_of_day = 'Soir'")
def facet_filter(spark, d):
    return A.filtered(documents(spark, d), version="TLV", part_of_day="Soir", city=None).select("doc_id", "city", "version")


@query(f"with {DOCS} select doc_id from docs where city = 'Stèmauvia'")
def city_filter(spark, d):
    return A.filtered(documents(spark, d), city="Stèmauvia").select("doc_id")


@query(f"with {DOCS} select doc_id from docs where audio_url <> ''")
def audio_filter(spark, d):
    return A.filtered(documents(spark, d), audio=True).select("doc_id")


@query(f"with {DOCS} select distinct substr(sermon_date, 1, 4) as year from docs where regexp_matches(substr(sermon_date, 1, 4), '^[0-9]{{4}}$')")
def facet_years(spark, d):
    return A.years(documents(spark, d))


@query(f"""with {DOCS} select facet, value, count(*) as n from (
  select 'city' as facet, city as value from docs union all select 'version', version from docs union all select 'part_of_day', part_of_day from docs)
where value <> '' group by 1, 2""")
def facet_values(spark, d):
    return A.all_values(documents(spark, d))


@query("select 'month' as facet, lpad(cast(i as varchar), 2, '0') as value, [" + ", ".join(q(m) for m in X.MONTHS["fr"]) + "][i] as label from unnest(range(1, 13)) u(i) union all select 'day', lpad(cast(i as varchar), 2, '0'), lpad(cast(i as varchar), 2, '0') from unnest(range(1, 32)) u(i)")
def facet_constants(spark, d):
    return A.calendar(spark)


@query(f"with {DOCS} select count(*) > 0 and coalesce(bool_and(doc_id in (select doc_id from docs where audio_url <> '')), false) as all_selected from docs where version = 'TLV'")
def all_selected(spark, d):
    docs = documents(spark, d)
    return A.all_selected(A.filtered(docs, version="TLV"), A.filtered(docs, audio=True))


# ---- tokens and spans

WORD = "lumière"


@query(f"with {TOKENS} select doc_id, segment_index, global_index, token from toks")
def tokens(spark, d):
    return P.tokens(documents(spark, d))


@query(f'with {TOKENS} select doc_id, global_index, cast(start as bigint) as start, cast("end" as bigint) as "end" from places')
def token_offsets(spark, d):
    return P.with_offsets(P.tokens(documents(spark, d))).select("doc_id", "global_index", "start", "end")


@query(f'with {DOCS}, {sql_spans(X.phrase_pattern(WORD))} select doc_id, match_no, start, "end", match from spans')
def match_spans(spark, d):
    return P.match_spans(documents(spark, d), X.phrase_pattern(WORD))


@query(f'with {TOKENS}, {sql_spans(X.phrase_pattern(PHRASE))} select p.doc_id, global_index, match_no, token from places p join spans s on p.doc_id = s.doc_id and p."end" > s.start and p.start < s."end"')
def span_overlap(spark, d):
    docs = P.matching(documents(spark, d), X.phrase_pattern(PHRASE))
    toks = P.with_offsets(P.tokens(docs))
    return P.overlaps(toks, P.match_spans(docs, X.phrase_pattern(PHRASE))).select("doc_id", "global_index", "match_no", "token")


@query(f"with {TOKENS}, {sql_spans(X.phrase_pattern(WORD))} select s.doc_id, match_no, min(global_index) as global_index from spans s join places p on p.doc_id = s.doc_id and p.start >= s.start group by 1, 2")
def first_token_after(spark, d):
    docs = P.matching(documents(spark, d), X.phrase_pattern(WORD))
    return P.first_token_after(P.with_offsets(P.tokens(docs)), P.match_spans(docs, X.phrase_pattern(WORD)))


@query(f"""with {DOCS}, h as (select doc_id, i, highlights[i] as h from docs, unnest(range(1, len(highlights) + 1)) u(i)),
t as (select doc_id, g as global_index, i, h.id as highlight_id, h.color as color from h, unnest(range(h.first_tok, h.last_tok + 1)) u(g))
select doc_id, cast(global_index as bigint) as global_index, highlight_id, color from (select *, row_number() over (partition by doc_id, global_index order by i desc) as rn from t) where rn = 1""")
def highlight_expand(spark, d):
    return P.highlight_tokens(documents(spark, d))


@query(f"""with {TOKENS}, {sql_spans(X.phrase_pattern(WORD))},
h as (select doc_id, i, highlights[i] as h from docs, unnest(range(1, len(highlights) + 1)) u(i)),
t as (select doc_id, g as global_index, i, case when h.color <> '' then h.color else 'amber' end as color from h, unnest(range(h.first_tok, h.last_tok + 1)) u(g)),
m as (
  select doc_id, global_index, 2 as r, color from (select *, row_number() over (partition by doc_id, global_index order by i desc) as rn from t) where rn = 1
  union all select p.doc_id, global_index, 1, 'amber' from places p join spans s on p.doc_id = s.doc_id and p."end" > s.start and p.start < s."end")
select doc_id, global_index, arg_max(color, r) as color from m join toks using (doc_id, global_index) group by 1, 2""")
def word_colours(spark, d):
    return P.coloured(documents(spark, d), X.phrase_pattern(WORD))


@query(f"""with {TOKENS}, {sql_spans(X.phrase_pattern(WORD))},
h as (select doc_id, highlights[i] as h from docs, unnest(range(1, len(highlights) + 1)) u(i))
select distinct doc_id, global_index from (
  select doc_id, cast(g as bigint) as global_index from h, unnest(range(h.first_tok, h.last_tok + 1)) u(g)
  union all select p.doc_id, global_index from places p join spans s on p.doc_id = s.doc_id and p."end" > s.start and p.start < s."end")""")
def decorated_tokens(spark, d):
    docs = documents(spark, d)
    hits = P.matching(docs, X.phrase_pattern(WORD))
    found = P.overlaps(P.with_offsets(P.tokens(hits)), P.match_spans(hits, X.phrase_pattern(WORD)))
    return P.decorated(P.highlight_tokens(docs), found)


@query(f"""with {TOKENS}, para as (select doc_id, string_agg(token, '' order by global_index) as s, min(start) as base from places where segment_index = 1 group by 1),
hit as (select doc_id, base, case when regexp_matches(s, {q(X.phrase_pattern(WORD))}) then length(string_split_regex(s, {q(X.phrase_pattern(WORD))})[1]) end as ms, length(regexp_extract(s, {q(X.phrase_pattern(WORD))})) as len from para)
select p.doc_id, global_index from places p join hit using (doc_id) where segment_index = 1 and (ms is null or (p."end" - base > ms and p.start - base < ms + len))""")
def paragraph_jump(spark, d):
    return P.paragraph_jump(P.tokens(documents(spark, d)), 2, X.phrase_pattern(WORD))


STORED = "st as (select sermon_id as doc_id, string_agg(content, E'\\n\\n' order by paragraph_index, content) as text from (select distinct sermon_id, paragraph_index, id, content from paragraphs) where content is not null group by 1)"


@query(f"""with {STORED}, quo as (select distinct id as quote_id, trim(sermon_id) as doc_id, quoted_text as quote from citations where quoted_text <> ''),
both_ as (select quote_id, quote, doc_id, string_split(regexp_replace(text, {q(X.BLANK_LINE)}, '', 'g'), quote) as p from quo join st using (doc_id) where contains(regexp_replace(text, {q(X.BLANK_LINE)}, '', 'g'), quote))
select quote_id, doc_id, cast(list_sum(list_transform(p[1:k], lambda x: length(x))) + (k - 1) * length(quote) as bigint) as start from both_, unnest(range(1, len(p))) u(k)""")
def quote_locations(spark, d):
    quotes = table(spark, d, "citations").select(F.col("id").alias("quote_id"), F.trim("sermon_id").alias("doc_id"), F.col("quoted_text").alias("quote"))
    stored = stored_rebuild(spark, d).withColumnRenamed("sermon_id", "doc_id")
    return P.quote_locations(stored, quotes)


#: Finds the end of one sentence and the beginning of the next, also where a paragraph ends between.
ACROSS = "e cette"


@query(f"""with {TOKENS}, {sql_spans(X.phrase_pattern(ACROSS))}
select s.doc_id, match_no from spans s join places p on p.doc_id = s.doc_id and p."end" > s.start and p.start < s."end" group by 1, 2 having count(distinct segment_index) > 1""")
def straddling_match(spark, d):
    docs = P.matching(documents(spark, d), X.phrase_pattern(ACROSS))
    met = P.overlaps(P.with_offsets(P.tokens(docs)), P.match_spans(docs, X.phrase_pattern(ACROSS)))
    return met.groupBy("doc_id", "match_no").agg(F.count_distinct("segment_index").alias("k")).filter("k > 1").select("doc_id", "match_no")


@query(f"with {PARAS} select paragraph_id, regexp_replace(content, {q(X.phrase_pattern(WORD, exact=True))}, '<mark>\\1</mark>', 'g') as marked from paras")
def exact_highlight(spark, d):
    return I.paragraphs(documents(spark, d)).select("paragraph_id", X.highlight(F.col("content"), X.phrase_pattern(WORD, exact=True)).alias("marked"))


@query("select cast(3 as integer) as n")
def active_filters(spark, d):
    return spark.range(1).select(F.lit(A.active(title="x", city="a", year="1950", audio=True, month="")).alias("n"))


@query(f"with {DOCS}, x as (select case when version = 'TLV' then null else doc_id end as doc_id from docs) select doc_id from x where doc_id is not null")
def null_rows(spark, d):
    rows = documents(spark, d).withColumn("doc_id", F.when(F.coalesce(F.col("version") == "TLV", F.lit(False)), None).otherwise(F.col("doc_id")))
    return A.present(rows).select("doc_id")


@query(sql_search(sql_holds(["notre"]), X.phrase_pattern("notre"), 40))
def page_append(spark, d):
    paras = searchable(spark, d)
    first, second = (S.scan(paras, "notre", S.Mode.EXACT_PHRASE, limit=20, offset=o) for o in (0, 20))
    return S.more(first, second)


_LIGHTS = "select doc_id, array_to_string(list_transform({}, lambda h: coalesce(h.id, '') || ':' || coalesce(cast(h.first_tok as varchar), '') || '-' || coalesce(cast(h.last_tok as varchar), '') || ':' || coalesce(h.color, '')), ',') as shown from docs"


def _lights(docs: DataFrame, lights) -> DataFrame:
    one = lambda h: F.concat(F.coalesce(h["id"], F.lit("")), F.lit(":"), F.coalesce(h["first_tok"].cast("string"), F.lit("")), F.lit("-"), F.coalesce(h["last_tok"].cast("string"), F.lit("")), F.lit(":"), F.coalesce(h["color"], F.lit("")))
    return docs.select("doc_id", F.array_join(F.transform(lights, one), ",").alias("shown"))


@query(f"with {DOCS} " + _LIGHTS.format("list_append(coalesce(highlights, []), {'id': 'new', 'first_tok': 2, 'last_tok': 5, 'color': 'amber'})"))
def highlight_add(spark, d):
    docs = documents(spark, d)
    return _lights(docs, P.add_highlight(F.col("highlights"), "new", 5, 2))


@query(f"with {DOCS} " + _LIGHTS.format("list_filter(highlights, lambda h: coalesce(h.id, '') <> 'hl-52-1')"))
def highlight_remove(spark, d):
    docs = documents(spark, d)
    return _lights(docs, P.remove_highlight(F.col("highlights"), "hl-52-1"))


@query(ORACLE["default_fields"])
def library_import(spark, d):
    """What a library holds after it was imported twice: both tables of one state."""
    path = f"{own_dir(spark)}/library-{uuid.uuid4().hex}"
    L.import_library(table(spark, d, "library"), path, "last")
    L.import_library(table(spark, d, "library"), path)
    return L.stored(spark, path, "documents").select("doc_id", *I.DEFAULTS)
