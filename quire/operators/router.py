"""One entry to search: synonyms from a dictionary, choice of the engine, least lengths, pages, and results kept by their parameters."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import search as S

#: A shorter query isn't searched for; a query must be longer to be looked for inside a document, or tried with the other engine.
LEAST, LONGER = 2, 2


@dataclasses.dataclass(frozen=True)
class Request:
    """What is searched for. synonyms: whether a query of one word also finds the dictionary's synonyms."""

    query: str
    mode: S.Mode = S.Mode.EXACT_PHRASE
    engine: str = "scan"
    synonyms: bool = False
    only_synonyms: bool = False
    only_query: bool = False
    limit: int = S.PAGE
    offset: int = 0


def search(paragraphs: DataFrame, documents: DataFrame, request: Request, dictionary: dict[str, list[str]] | None = None) -> DataFrame:
    """(paragraph_id, doc_id, paragraph_index, snippet, title, sermon_date, city) of one page.

    paragraphs has doc_id, paragraph_id, paragraph_index, content; documents doc_id, ord, title,
    sermon_date, city. engine is 'scan', 'fts', or 'auto': by tokens, and by scan where that finds
    nothing on the first page. Engines don't change between the pages of scan and fts. An unknown
    engine raises ValueError.
    """
    if request.engine not in ("scan", "fts", "auto"):
        raise ValueError(f"unknown engine {request.engine!r}")
    also = S.synonyms_of(dictionary or {}, request.query.strip()) if request.synonyms else []
    short = len(request.query.strip()) < LEAST and not also
    if request.engine != "scan":
        found = _by_tokens(paragraphs, documents, request, also, short)
        if request.engine == "fts" or request.offset or len(request.query.strip()) <= LONGER or not found.isEmpty():
            return found
    shown = paragraphs.join(documents.select("doc_id", "ord", "title", "sermon_date", "city"), "doc_id")
    shown = shown.limit(0) if short else shown
    return S.scan(shown, request.query, request.mode, also, request.only_synonyms, request.only_query, request.limit, request.offset)


def _by_tokens(paragraphs: DataFrame, documents: DataFrame, r: Request, also: list[str], short: bool) -> DataFrame:
    found = S.fts(paragraphs.limit(0) if short else paragraphs, documents, r.query, r.mode, also, r.only_synonyms, r.limit, r.offset)
    terms = X.norm_text(" ".join(([] if r.only_synonyms and also else [r.query]) + also)).split()
    return found.withColumn("snippet", S.fts_snippet(F.col("content"), terms)).select("paragraph_id", "doc_id", "paragraph_index", "snippet", "title", "sermon_date", "city")


def after(results: DataFrame, sermon_date: str | None, ord_: int, paragraph_index: int, limit: int = S.PAGE) -> DataFrame:
    """The page after a given row, by its sort key instead of an offset, so that earlier pages aren't sorted again."""
    same = F.col("sermon_date").eqNullSafe(F.lit(sermon_date))
    later = same & ((F.col("ord") > ord_) | ((F.col("ord") == ord_) & (F.col("paragraph_index") > paragraph_index)))
    older = F.lit(False) if sermon_date is None else (F.col("sermon_date") < sermon_date) | F.col("sermon_date").isNull()
    return S.page(results.filter(later | older), limit)


def has_more(page: DataFrame, limit: int = S.PAGE) -> bool:
    """Whether another page may follow: this one is full."""
    return page.count() >= limit


class Kept:
    """Search results kept in memory by their request; asking again doesn't search again."""

    def __init__(self, paragraphs: DataFrame, documents: DataFrame, dictionary: dict[str, list[str]] | None = None, most: int = 20):
        self.paragraphs, self.documents, self.dictionary, self.most = paragraphs, documents, dictionary, most
        self.held: dict[Request, DataFrame] = {}

    def search(self, request: Request) -> DataFrame:
        if request not in self.held:
            while len(self.held) >= self.most:
                self.held.pop(next(iter(self.held))).unpersist()
            # a page at most
            self.held[request] = search(self.paragraphs, self.documents, request, self.dictionary).persist()
        return self.held[request]
