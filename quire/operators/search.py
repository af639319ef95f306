"""Full-text search over paragraphs, by scan or by index tokens."""

from __future__ import annotations

import functools
import operator
import re
from enum import StrEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as X


class Mode(StrEnum):
    """How the words of a query are matched. The names are fixed values."""

    DIVERSE = "DIVERSE"
    EXACT_WORDS = "EXACT_WORDS"
    EXACT_PHRASE = "EXACT_PHRASE"
    PARTIAL = "PARTIAL"


#: Synonyms of a one-word query that count.
MOST_SYNONYMS = 8
#: Results of a page, at most.
PAGE = 50


def _any(conditions: list[Column]) -> Column:
    return functools.reduce(operator.or_, conditions, F.lit(False))


def _all(conditions: list[Column]) -> Column:
    return functools.reduce(operator.and_, conditions, F.lit(True))


def _once(value: Column, condition) -> Column:
    """condition of value, with value computed once a row however often the condition uses it."""
    return F.exists(F.array(value), condition)


def synonyms_of(dictionary: dict[str, list[str]], query: str) -> list[str]:
    """The first synonyms of a query of one word; none for more words or an unknown one."""
    words = query.split()
    return dictionary.get(words[0].lower(), [])[:MOST_SYNONYMS] if len(words) == 1 else []


def scan_condition(normal: Column, query: str, mode: Mode, synonyms: list[str] = (), only_synonyms: bool = False, only_query: bool = False) -> Column:
    """Whether a normalized paragraph matches. A query of punctuation alone matches everything, or nothing where any word would do."""
    q = X.norm_text(query)
    also = [] if only_query else [s for s in map(X.norm_text, synonyms) if s]
    if not query.strip() and not synonyms:
        return F.lit(False)
    if also:
        return _any([normal.contains(s) for s in ([] if only_synonyms else [q]) + also])
    if mode == Mode.EXACT_PHRASE:
        return normal.contains(q)
    each = [normal.contains(w) for w in q.split()]
    return _any(each) if mode == Mode.DIVERSE else _all(each)


def highlight_pattern(query: str, mode: Mode, synonyms: list[str] = (), only_synonyms: bool = False, only_query: bool = False) -> str | None:
    """The pattern of what a snippet is cut around and marks; None where there is nothing to find."""
    if synonyms and not only_query:
        words = " ".join(synonyms if only_synonyms else [query, *synonyms])
        return X.words_pattern(words) if words.strip() else None
    if not query.strip():
        return None
    return X.phrase_pattern(query) if mode == Mode.EXACT_PHRASE else X.words_pattern(query)


def page(results: DataFrame, limit: int = PAGE, offset: int = 0) -> DataFrame:
    """Newest first, then in library order; a total order, so pages neither overlap nor leave gaps."""
    return results.orderBy(F.desc_nulls_last("sermon_date"), "ord", "paragraph_index").offset(offset).limit(min(limit, PAGE))


def _shown(hits: DataFrame, pattern: str | None) -> DataFrame:
    cut = X.highlight(X.snippet(F.col("content"), pattern), pattern) if pattern else F.substring("content", 1, 600)
    return hits.select("paragraph_id", "doc_id", "paragraph_index", cut.alias("snippet"), "title", "sermon_date", "city")


def scan(paragraphs: DataFrame, query: str, mode: Mode = Mode.EXACT_PHRASE, synonyms: list[str] = (), only_synonyms: bool = False, only_query: bool = False, limit: int = PAGE, offset: int = 0) -> DataFrame:
    """A page of the paragraphs that hold the query, with marked snippets.

    paragraphs has doc_id, ord, title, sermon_date, city, paragraph_id, paragraph_index, content.
    Texts are compared without case, accents and punctuation; words also match inside longer ones.
    Sorting and cutting is one top-k, and snippets are made for the page only.
    """
    hit = _once(X.norm(F.col("content")), lambda n: scan_condition(n, query, mode, synonyms, only_synonyms, only_query))
    return _shown(page(paragraphs.filter(hit), limit, offset), highlight_pattern(query, mode, synonyms, only_synonyms, only_query))


def _terms(text: str) -> list[str]:
    plain = "".join(X.norm_text(c) or " " for c in text.lower())
    return [t for t in re.split(r"[\W_]+", plain) if t]


def _begins(tokens: Column, term: str) -> Column:
    """Whether a token begins with term."""
    return F.exists(tokens, lambda x: x.startswith(term))


def fts_condition(tokens: Column, query: str, mode: Mode, synonyms: list[str] = (), only_synonyms: bool = False) -> Column:
    """Whether index tokens match: a phrase by whole tokens, anything else by their beginnings.

    A synonym of several words wants all of them, the last by its beginning.
    """
    if synonyms:
        chosen = [t for t in map(_terms, list(synonyms) if only_synonyms else [query, *synonyms]) if t]
        return _any([_all([F.array_contains(tokens, w) for w in t[:-1]] + [_begins(tokens, t[-1])]) for t in chosen])
    terms = _terms(query)
    if not terms:
        return F.lit(False)
    if mode == Mode.EXACT_PHRASE:
        return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).contains(" " + " ".join(terms) + " ")
    if mode == Mode.DIVERSE:
        return F.exists(tokens, lambda x: _any([x.startswith(w) for w in terms]))
    return _all([_begins(tokens, w) for w in terms])


def fts(paragraphs: DataFrame, documents: DataFrame, query: str, mode: Mode = Mode.EXACT_PHRASE, synonyms: list[str] = (), only_synonyms: bool = False, limit: int = PAGE, offset: int = 0) -> DataFrame:
    """A page of the paragraphs whose tokens match, with their documents' data.

    paragraphs has doc_id, paragraph_id, paragraph_index, content; documents has doc_id, ord,
    title, sermon_date, city. Paragraphs are filtered before they meet their documents.
    """
    hits = paragraphs.filter(_once(X.fts_tokens(F.col("content")), lambda t: fts_condition(t, query, mode, synonyms, only_synonyms)))
    joined = hits.join(documents.select("doc_id", "ord", "title", "sermon_date", "city"), "doc_id")
    return page(joined, limit, offset).select("paragraph_id", "doc_id", "paragraph_index", "content", "title", "sermon_date", "city")


def fts_snippet(content: Column, terms: list[str], size: int = 96, opening: str = "<mark>", closing: str = "</mark>") -> Column:
    """The window of `size` words with the most words that begin with a term, terms marked; the first one of several.

    Windows that begin at a match are compared, moved left so that their matches stand in the
    middle. An approximation: which of several windows is shown is not fixed.
    """
    words = F.split(content, f"[{X.WS}]+", -1)
    is_hit = lambda w: F.exists(X.fts_tokens(w), lambda t: _any([t.startswith(x) for x in terms]))
    hits = F.filter(F.transform(words, lambda w, i: F.when(is_hit(w), i)), lambda i: i.isNotNull())
    # hits are few; each tells how many follow within a window, and where the last of them stands
    each = F.transform(hits, lambda i: F.filter(hits, lambda j: (j >= i) & (j < i + size)))
    best = F.array_max(F.transform(each, lambda w: F.struct(F.size(w).alias("n"), (-w[0]).alias("first"), F.element_at(w, -1).alias("last"))))
    spare = F.lit(size) - (best["last"] + best["first"] + 1)
    at = F.coalesce(-best["first"] - F.floor(spare / 2).cast("int"), F.lit(0))
    lo = F.greatest(F.lit(0), F.least(at, F.size(words) - size))
    shown = F.transform(F.slice(words, lo + 1, F.lit(size)), lambda w: F.when(is_hit(w), F.concat(F.lit(opening), w, F.lit(closing))).otherwise(w))
    return F.concat(F.when(lo > 0, "...").otherwise(""), F.array_join(shown, " "), F.when(lo + size < F.size(words), "...").otherwise(""))


def postings(paragraphs: DataFrame) -> DataFrame:
    """(token, doc_id, paragraph_index, n): the inverted index of the paragraphs, to be written sorted by token."""
    return paragraphs.select("doc_id", "paragraph_index", F.explode(X.fts_tokens(F.col("content"))).alias("token")).groupBy("token", "doc_id", "paragraph_index").agg(F.count("*").alias("n"))


def write_postings(index: DataFrame, path: str) -> None:
    """Write postings in ranges of tokens, sorted, so that looking up a token or a beginning reads few row groups."""
    index.repartitionByRange("token").sortWithinPartitions("token", "doc_id", "paragraph_index").write.mode("overwrite").parquet(path)


def by_index(index: DataFrame, terms: list[str], mode: Mode = Mode.EXACT_WORDS) -> DataFrame:
    """(doc_id, paragraph_index, n): paragraphs by the beginnings of their tokens, from the postings alone; n counts the terms' tokens.

    DIVERSE wants any term, the other modes all. The beginnings are filters that reach the scan of
    the index; terms are told apart by their number, so a paragraph is one row whatever it repeats.
    """
    terms = list(dict.fromkeys(t for term in terms for t in _terms(term)))
    if not terms:
        return index.limit(0).select("doc_id", "paragraph_index", "n")
    hits = index.filter(_any([F.col("token").startswith(t) for t in terms]))
    met = [F.coalesce(F.bool_or(F.col("token").startswith(t)), F.lit(False)).alias(f"t{k}") for k, t in enumerate(terms)]
    found = hits.groupBy("doc_id", "paragraph_index").agg(F.sum("n").cast("long").alias("n"), *met)
    wanted = [F.col(f"t{k}") for k in range(len(terms))]
    return found.filter(_any(wanted) if mode == Mode.DIVERSE else _all(wanted)).select("doc_id", "paragraph_index", "n")


def positions(paragraphs: DataFrame) -> DataFrame:
    """(token, doc_id, paragraph_index, positions): the inverted index with the places of each token in its paragraph, from 0."""
    each = paragraphs.select("doc_id", "paragraph_index", F.posexplode(X.fts_tokens(F.col("content"))).alias("pos", "token"))
    return each.groupBy("token", "doc_id", "paragraph_index").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def _runs(index: DataFrame, terms: list[str], last_begins: bool) -> DataFrame:
    """(doc_id, paragraph_index): paragraphs with the terms in a row; last_begins: the last one only begins the token.

    Only the terms' postings are read. Each place of the k-th term votes for a run k places before.
    """
    exact, last = list(dict.fromkeys(terms[:-1] if last_begins else terms)), terms[-1]
    wanted = F.col("token").isin(exact) if exact else F.lit(False)
    wanted = wanted | F.col("token").startswith(last) if last_begins else wanted
    fits = [(F.col("token").startswith(t) if last_begins and k == len(terms) - 1 else F.col("token") == t) for k, t in enumerate(terms)]
    offsets = F.array_compact(F.array(*[F.when(f, F.lit(k)) for k, f in enumerate(fits)]))
    votes = index.filter(wanted).select("doc_id", "paragraph_index", F.explode(offsets).alias("k"), "positions")
    starts = votes.select("doc_id", "paragraph_index", "k", F.explode(F.transform("positions", lambda p: p - F.col("k"))).alias("at"))
    found = starts.groupBy("doc_id", "paragraph_index", "at").agg(F.bit_or(F.pow(F.lit(2.0), F.col("k")).cast("long")).alias("seen"))
    return found.filter(F.col("seen") == (1 << len(terms)) - 1).select("doc_id", "paragraph_index").distinct()


def _together(index: DataFrame, groups: list[list[str]]) -> DataFrame:
    """(doc_id, paragraph_index): paragraphs that have, of some group, all words: the last by its beginning, the others whole."""
    flat = [(g, i, w, i == len(words) - 1) for g, words in enumerate(groups) for i, w in enumerate(words)]
    fits = [F.col("token").startswith(w) if begins else F.col("token") == w for _, _, w, begins in flat]
    met = [F.coalesce(F.bool_or(f), F.lit(False)).alias(f"w{k}") for k, f in enumerate(fits)]
    found = index.filter(_any(fits)).groupBy("doc_id", "paragraph_index").agg(*met)
    whole = [_all([F.col(f"w{k}") for k, x in enumerate(flat) if x[0] == g]) for g in range(len(groups))]
    return found.filter(_any(whole)).select("doc_id", "paragraph_index")


#: Words of a phrase that are looked up together.
MOST_TERMS = 60


def index_hits(index: DataFrame, query: str, mode: Mode = Mode.EXACT_PHRASE, synonyms: list[str] = (), only_synonyms: bool = False) -> DataFrame:
    """(doc_id, paragraph_index) of the paragraphs that match, from positions() alone, as fts_condition finds them.

    The filters on tokens reach the scan, so of an index written by write_postings only the row
    groups that may hold them are read. A query without terms finds nothing; one of more than
    MOST_TERMS words as a phrase raises ValueError.
    """
    if synonyms:
        groups = [t for t in map(_terms, list(synonyms) if only_synonyms else [query, *synonyms]) if t]
        return _together(index, groups) if groups else index.limit(0).select("doc_id", "paragraph_index")
    terms = _terms(query)
    if not terms:
        return index.limit(0).select("doc_id", "paragraph_index")
    if mode == Mode.EXACT_PHRASE:
        if len(terms) > MOST_TERMS:
            raise ValueError("the phrase is too long")
        return _runs(index, terms, False)
    return _together(index, [[t] for t in terms]) if mode == Mode.DIVERSE else by_index(index.withColumn("n", F.lit(1)), terms).select("doc_id", "paragraph_index")


def indexed(index: DataFrame, paragraphs: DataFrame, documents: DataFrame, query: str, mode: Mode = Mode.EXACT_PHRASE, synonyms: list[str] = (), only_synonyms: bool = False, limit: int = PAGE, offset: int = 0) -> DataFrame:
    """What fts() gives, by the inverted index: paragraphs are read for the rows of the page only.

    index is positions(paragraphs), best read from where write_postings put it.
    """
    hits = index_hits(index, query, mode, synonyms, only_synonyms)
    top = page(hits.join(documents.select("doc_id", "ord", "title", "sermon_date", "city"), "doc_id"), limit, offset)
    # at most PAGE rows
    shown = paragraphs.select("paragraph_id", "doc_id", "paragraph_index", "content").join(F.broadcast(top), ["doc_id", "paragraph_index"])
    return page(shown, limit).select("paragraph_id", "doc_id", "paragraph_index", "content", "title", "sermon_date", "city")


def more(pages: DataFrame, following: DataFrame) -> DataFrame:
    """The pages so far with one more after them; a row that is already there isn't repeated."""
    fresh = following.join(pages.select("paragraph_id").distinct(), "paragraph_id", "left_anti").select(*pages.columns)
    return pages.unionByName(fresh)


def export_lines(results: DataFrame, most: int = 25) -> DataFrame:
    """(n, line) of the first results in page order: '1. title (date) - Para n'."""
    top = results.orderBy(F.desc_nulls_last("sermon_date"), "ord", "paragraph_index").limit(most)
    # at most `most` rows are left, so one task numbers them
    rows = top.agg(F.array_sort(F.collect_list(F.struct("sermon_date", "ord", "paragraph_index", "title")), _newest).alias("r"))
    one = rows.select(F.posexplode("r").alias("i", "r")).withColumn("n", (F.col("i") + 1).cast("long"))
    return one.select("n", F.format_string("%d. %s (%s) - Para %d", "n", "r.title", "r.sermon_date", "r.paragraph_index").alias("line"))


def _newest(a: Column, b: Column) -> Column:
    def order(x: Column, y: Column) -> Column:
        return F.when(x.isNull() & y.isNull(), 0).when(x.isNull(), 1).when(y.isNull(), -1).when(x > y, -1).when(x < y, 1).otherwise(0)

    by_date = order(a["sermon_date"], b["sermon_date"])
    by_ord = -order(a["ord"], b["ord"])
    return F.when(by_date != 0, by_date).when(by_ord != 0, by_ord).otherwise(-order(a["paragraph_index"], b["paragraph_index"]))
