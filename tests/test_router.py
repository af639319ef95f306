"""The search entry, kept results, quotes and JSON notes."""

import json

import pytest
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import ingest as I
from quire.operators import notes as N
from quire.operators import router as R
from quire.operators import search as S
from quire.operators import spans as P
from quire.sources import desk as D
from tests.test_search import SCHEMA, library

DICTIONARY = {"roi": ["mer", "lumière"]}


@pytest.fixture(scope="module")
def both(spark):
    docs = I.dedupe(I.with_key(spark.createDataFrame(library(), SCHEMA))).cache()
    return I.paragraphs(docs).cache(), docs


def ids(df):
    return [r["paragraph_id"] for r in df.collect()]


def test_scan_is_the_default(both):
    shown = both[0].join(both[1].select("doc_id", "ord", "title", "sermon_date", "city"), "doc_id")
    assert ids(R.search(*both, R.Request("roi"))) == ids(S.scan(shown, "roi"))


def test_synonyms_only_when_asked(both):
    assert len(ids(R.search(*both, R.Request("roi", synonyms=True), DICTIONARY))) >= len(ids(R.search(*both, R.Request("roi"), DICTIONARY)))
    assert ids(R.search(*both, R.Request("roi", synonyms=True, only_query=True), DICTIONARY)) == ids(R.search(*both, R.Request("roi"), DICTIONARY))


def test_short_queries_find_nothing(both):
    assert ids(R.search(*both, R.Request("r"))) == [] == ids(R.search(*both, R.Request(" ", engine="fts")))


def test_fallback_to_scan(both):
    assert ids(R.search(*both, R.Request("oyaum", engine="fts"))) == []
    assert ids(R.search(*both, R.Request("oyaum", engine="auto"))) == ids(R.search(*both, R.Request("oyaum")))
    assert ids(R.search(*both, R.Request("roi", engine="auto"))) == ids(R.search(*both, R.Request("roi", engine="fts")))


def test_unknown_engine(both):
    with pytest.raises(ValueError):
        R.search(*both, R.Request("roi", engine="magic"))


def test_pages_by_key(both):
    shown = both[0].join(both[1].select("doc_id", "ord", "title", "sermon_date", "city"), "doc_id")
    hits = shown.filter(S.scan_condition(X.norm(F.col("content")), "le", S.Mode.PARTIAL))
    first = S.page(hits, 7).collect()
    assert R.has_more(S.page(hits, 7), 7)
    last = first[-1]
    nxt = ids(R.after(hits, last["sermon_date"], last["ord"], last["paragraph_index"], 7))
    assert nxt == ids(S.page(hits, 7, 7))


def test_results_are_kept(both):
    kept = R.Kept(*both, most=2)
    a = kept.search(R.Request("roi"))
    assert kept.search(R.Request("roi")) is a
    kept.search(R.Request("mer"))
    kept.search(R.Request("le"))
    assert len(kept.held) == 2 and R.Request("roi") not in kept.held


def test_quote_colours(spark):
    docs = spark.createDataFrame([("a", "le roi vient. le roi part")], "doc_id string, text string")
    toks = P.with_offsets(P.tokens(docs))
    cites = spark.createDataFrame([("c1", "n1", "a", "roi"), ("c2", "n1", "a", "zzz"), ("c3", "n2", "b", "roi"), ("c4", "n1", "a", None)], "id string, note_id string, sermon_id string, quoted_text string")
    notes = spark.createDataFrame([("n1", "sky"), ("n2", "")], "id string, color string")
    got = sorted((r["note_id"], r["global_index"], r["color"]) for r in P.citation_colours(docs, toks, cites, notes).collect())
    assert got == [("n1", 2, "sky"), ("n1", 8, "sky")]
    quotes = cites.select(F.col("id").alias("quote_id"), F.col("sermon_id").alias("doc_id"), F.col("quoted_text").alias("quote"))
    assert [r["global_index"] for r in P.first_quote_tokens(docs, toks, quotes).collect()] == [2]


def test_new_notes_come_last(spark):
    notes = spark.createDataFrame([("n0", "t", "c", "sky", 0, "d", "d")], "id string, title string, content string, color string, note_order int, creation_date string, note_date string")
    drafts = spark.createDataFrame([("b", None, "x"), ("a", "T", None)], "id string, title string, content string")
    got = {r["id"]: (r["title"], r["note_order"], r["note_date"]) for r in N.new_notes(notes, drafts, "2024-05-06T00:00:00Z").collect()}
    assert got == {"n0": ("t", 0, "d"), "a": ("T", 1, "2024-05-06"), "b": ("", 2, "2024-05-06")}


def test_json_notes(spark, tmp_path):
    p = tmp_path / "notes.json"
    p.write_text(json.dumps([{"id": "n1", "title": "T", "order": 2, "creationDate": "2024-01-01", "citations": [{"id": "c1", "sermon_id": "a", "quoted_text": "q"}]}, {"id": "n2", "citations": []}]))
    notes, cites = D.read_notes(spark, str(p))
    assert sorted((r["id"], r["note_order"]) for r in notes.collect()) == [("n1", 2), ("n2", None)]
    assert [(r["id"], r["note_id"]) for r in cites.collect()] == [("c1", "n1")]
    out = str(tmp_path / "desk")
    D.write_notes(notes, cites, out)
    D.write_notes(spark.read.parquet(out + "/notes"), spark.read.parquet(out + "/citations"), out)
    assert spark.read.parquet(out + "/notes").count() == 2


def test_definitions_tolerate_bad_json(spark):
    raw = spark.createDataFrame([('{"word": "Roi", "definition": "d", "synonyms": ["a"], "seq": 1}',), ("{bad",), (None,), ('{"definition": "x"}',)], "value string")
    held = D.definitions(raw)
    assert [r["word"] for r in held.collect()] == ["Roi"]
    newer = spark.createDataFrame([("ROI", "new", [], None, 2)], held.schema)
    assert [(r["word"], r["definition"]) for r in D.put_definition(held, newer).collect()] == [("roi", "new")]
