"""Ingest, facets, spans, notes and contexts on small hand-made tables."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import context as C
from quire.operators import facets as A
from quire.operators import ingest as I
from quire.operators import notes as N
from quire.operators import spans as P
from quire.sources import library as L

LIB = "ord long, id string, title string, sermon_date string, part_of_day string, city string, version string, audio_url string, text string, highlights array<struct<id:string,first_tok:int,last_tok:int,color:string>>"


def lib(spark, rows):
    full = [(r.get("ord", i), r.get("id"), r.get("title"), r.get("date"), r.get("time"), r.get("city"), r.get("version"), r.get("audio"), r.get("text"), r.get("highlights")) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, LIB)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_keys_and_dedupe(spark):
    raw = I.with_key(lib(spark, [{"id": "a", "version": "V", "text": "1"}, {"id": "a", "version": "V", "text": "2"}, {"id": "a", "text": "3"}, {"id": "a", "version": "", "text": "4"}, {"text": "5"}, {"id": "", "text": "6"}]))
    assert rows(I.dedupe(raw).filter("doc_id like 'a%'"), "doc_id", "text") == [("a", "3"), ("a-V", "1")]
    assert rows(I.dedupe(raw, "last").filter("doc_id like 'a%'"), "doc_id", "text") == [("a", "4"), ("a-V", "2")]
    assert raw.filter("doc_id like 'gen-%'").select("doc_id").distinct().count() == 2


def test_defaults(spark):
    r = I.with_defaults(lib(spark, [{"id": "a", "title": "", "date": "1950-01-01"}])).collect()[0]
    assert (r["title"], r["sermon_date"], r["city"], r["version"], r["part_of_day"], r["audio_url"], r["text"]) == ("Sermon sans titre", "1950-01-01", "", "VGR", "Inconnu", "", "...")


def test_paragraph_numbers_count_blank_ones(spark):
    docs = I.with_key(lib(spark, [{"id": "a", "text": "\n\n one \n\n \n\n2 two\n\n"}, {"id": "b", "text": None}, {"id": "c", "text": ""}]))
    assert rows(I.paragraphs(docs), "doc_id", "paragraph_index", "content") == [("a", 2, "one"), ("a", 3, "2 two")]
    assert rows(I.rebuild(I.paragraphs(docs)), "text") == [("one\n\n2 two",)]
    assert [x[2] for x in rows(I.numbered(docs), "doc_id", "paragraph_index", "is_numbered")] == [False, True]


def test_filters(spark):
    docs = I.with_key(lib(spark, [{"id": "a", "title": "Le Roi", "date": "1950-04-09", "city": "X", "audio": "u"}, {"id": "b", "title": None, "date": None, "city": None}, {"id": "c", "title": "roi", "date": "1951-04-10", "city": "X", "audio": ""}]))
    ids = lambda **k: [x[0] for x in rows(A.filtered(docs, **k), "doc_id")]
    assert ids() == ["a", "b", "c"] and ids(title="rôi") == ["a", "c"] and ids(title="?!") == ["a", "b", "c"]
    assert ids(year="1950") == ["a"] and ids(month="04") == ["a", "c"] and ids(day="10") == ["c"] and ids(city="X", audio=True) == ["a"]
    assert A.active(title="x", year="1950", audio=True, city=None) == 2
    assert [r["year"] for r in A.years(docs).collect()] == ["1951", "1950"]
    assert [r["value"] for r in A.values(docs, "city").collect()] == ["X"]


def test_all_selected(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id string")
    ask = lambda a, b: A.all_selected(a, b).collect()[0][0]
    assert ask(ids("a", "b"), ids("a", "b", "c")) and not ask(ids("a", "z"), ids("a")) and not ask(ids(), ids("a"))


@pytest.fixture(scope="module")
def doc(spark):
    lights = [("h1", 0, 2, None), ("h2", 2, 4, "sky"), ("h3", None, 3, "x"), ("h4", 5, 4, "x")]
    return I.with_key(lib(spark, [{"id": "a", "text": "le roi vient\n\nroi  dit\n\n \n\nfin", "highlights": lights}, {"id": "n", "text": None, "highlights": None}]))


def test_tokens_and_offsets(doc):
    toks = P.with_offsets(P.tokens(doc)).orderBy("global_index").collect()
    assert [t["token"] for t in toks if t["segment_index"] == 1] == ["roi", "  ", "dit"]
    assert [t["global_index"] for t in toks] == list(range(len(toks)))
    assert all(a["end"] == b["start"] for a, b in zip(toks, toks[1:]))


def test_matches_straddle_paragraphs(doc):
    spans = P.match_spans(doc, X.phrase_pattern("vientroi"))
    assert rows(spans, "start", "end", "match") == [(7, 15, "vientroi")]
    toks = P.with_offsets(P.tokens(doc))
    assert rows(P.overlaps(toks, spans), "global_index", "token") == [(4, "vient"), (5, "roi")]


def test_overlaps_across_bins(spark, doc):
    toks = spark.createDataFrame([("a", i, "x" * 700, i * 700, (i + 1) * 700) for i in range(6)], "doc_id string, global_index long, token string, start long, end long")
    spans = spark.createDataFrame([("a", 1, 100, 3000), ("a", 2, 1400, 1401), ("b", 3, 0, 9)], "doc_id string, match_no int, start long, end long")
    assert rows(P.overlaps(toks, spans), "match_no", "global_index") == [(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (2, 2)]


def test_first_token_after(doc):
    toks = P.with_offsets(P.tokens(doc))
    inside = P.match_spans(doc, X.phrase_pattern("oi"))
    assert rows(P.first_token_after(toks, inside), "match_no", "global_index") == [(1, 3), (2, 6)]
    assert P.first_token_after(toks, P.match_spans(doc, X.phrase_pattern("in"))).count() == 0


def test_highlights(doc):
    marks = P.highlight_tokens(doc)
    assert rows(marks, "global_index", "highlight_id") == [(0, "h1"), (1, "h1"), (2, "h2"), (3, "h2"), (4, "h2")]
    toks = P.tokens(doc)
    found = toks.filter("global_index in (0, 5)")
    chosen = toks.filter("global_index = 4")
    assert rows(P.word_colours(toks, marks, found, chosen), "global_index", "color") == [(0, "amber"), (1, "amber"), (2, "sky"), (3, "sky"), (4, "selection"), (5, "amber")]
    more = doc.filter("doc_id = 'n'").select(P.add_highlight(F.col("highlights"), "z", 9, 3).alias("h")).collect()[0]["h"]
    assert [(x["id"], x["first_tok"], x["last_tok"], x["color"]) for x in more] == [("z", 3, 9, "amber")]
    assert len(doc.filter("doc_id = 'a'").select(P.remove_highlight(F.col("highlights"), "h1").alias("h")).collect()[0]["h"]) == 3


def slowly_coloured(docs, pattern):
    found = P.overlaps(P.with_offsets(P.tokens(docs)), P.match_spans(docs, pattern))
    return P.word_colours(P.tokens(docs), P.highlight_tokens(docs), found)


def test_coloured_by_hand(spark):
    # "le", " ", "roi" are tokens 0 to 2 of the first paragraph, "vient", " ", "tôt" 3 to 5; the last highlight ends far beyond them
    marks = [("h1", -3, 0, "rose"), ("h2", 0, 0, ""), ("h3", 5, 2_000_000_000, "sky"), ("h4", 4, None, "sky"), ("h5", None, 4, "sky"), ("h6", 4, 3, "sky"), ("h7", 9, 2_000_000_000, "sky"), None]
    docs = I.with_key(lib(spark, [{"id": "a", "text": "le roi\n \n\nvient tôt", "highlights": marks}, {"id": "n", "highlights": marks}, {"id": "e", "text": "", "highlights": marks}, {"id": "x", "text": "oiv"}]))
    assert rows(P.coloured(docs, X.phrase_pattern("oiv")), "doc_id", "global_index", "color") == [("a", 0, "amber"), ("a", 2, "amber"), ("a", 3, "amber"), ("a", 5, "sky"), ("x", 0, "amber")]


def test_coloured_is_word_colours(spark):
    rng = random.Random(5)
    pieces = ["mer", "MER", "me", "r", "rm", "é", "𝒳", "ɐ漢", " ", "  ", "\t", "\u00a0", "\u3000 ", "\n", "\n\n", "\n \u2003\n", ".", "--"]
    full = []
    for i in range(300):
        size = rng.choice([0, 1, 5, 40, 400, 9000 if i % 50 == 0 else 90])
        text = "".join(rng.choices(pieces, k=size))
        marks = [(f"h{k}", a := rng.randrange(-2, size + 2), a + rng.randrange(-1, 9), rng.choice(["sky", "rose", "", None])) for k in range(rng.choice([0, 0, 3]))]
        full.append({"id": f"d{i}", "text": text, "highlights": marks if i % 3 else None})
    docs = I.with_key(lib(spark, full)).cache()
    for pattern in (X.phrase_pattern("mer"), X.phrase_pattern("r m"), "(?i)(m|)", X.phrase_pattern("zz")):
        got = rows(P.coloured(docs, pattern), "doc_id", "global_index", "color")
        assert got == rows(slowly_coloured(docs, pattern), "doc_id", "global_index", "color")
    assert len(got) > 100


def test_coloured_without_white_space(spark):
    docs = spark.createDataFrame([("a", "mer漢x" * 60_000, None)], "doc_id string, text string, highlights array<struct<id:string,first_tok:int,last_tok:int,color:string>>")
    began = time.time()
    assert rows(P.coloured(docs, X.phrase_pattern("mer")), "doc_id", "global_index", "color") == [("a", 0, "amber")]
    # one token is counted once, not up to each match
    assert time.time() - began < 60


def test_word_colours_moves_documents_once_and_no_tokens(spark):
    from quire.plans import corpus

    plan = corpus.word_colours(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # the keys that win, and the documents
    assert plan.count("Exchange") == 2
    assert not any(x in plan for x in ("Window", "SortMergeJoin", "posexplode"))


def test_paragraph_jump(doc):
    toks = P.tokens(doc)
    assert rows(P.paragraph_jump(toks, 2, X.phrase_pattern("dit")), "global_index") == [(7,)]
    assert rows(P.paragraph_jump(toks, 2, X.phrase_pattern("zzz")), "global_index") == [(5,), (6,), (7,)]


def test_quote_locations(spark, doc):
    quotes = spark.createDataFrame([("q1", "a", "roi"), ("q2", "a", "\\E(."), ("q3", "a", ""), ("q4", "a", None), ("q5", "x", "roi")], "quote_id string, doc_id string, quote string")
    assert rows(P.quote_locations(doc, quotes), "quote_id", "start") == [("q1", 3), ("q1", 12)]


NOTES = "id string, title string, content string, color string, note_order int, creation_date string, note_date string"
CITES = "id string, note_id string, sermon_id string, quoted_text string, date_added string, paragraph_index int"


@pytest.fixture(scope="module")
def desk(spark):
    notes = spark.createDataFrame([(f"n{i}", f"Titre {i}", None, "sky", i, f"2024-0{i + 1}-01", None) for i in range(5)] + [("n9", None, None, None, None, None, None)], NOTES)
    cites = spark.createDataFrame([("c1", "n0", "a", "x", "2024-02-01", 1), ("c2", "n0", "ia-9", "y", "2024-01-01", None), ("c3", "n3", "b", None, None, 2), ("c4", None, "b", "z", None, 2)], CITES)
    return notes, cites


def test_nested_citations(desk):
    got = {r["id"]: [c["id"] for c in r["citations"]] for r in N.with_citations(*desk).collect()}
    assert got["n0"] == ["c2", "c1"] and got["n1"] == [] and got["n3"] == ["c3"] and len(got) == 6
    assert rows(N.citation_counts(*desk), "id", "n_citations")[0] == ("n0", 2)
    assert rows(N.first_citation(desk[1]), "note_id", "citation_id") == [("n0", "c2"), ("n3", "c3")]


def test_upsert_keeps_the_creation_date(spark, desk):
    new = spark.createDataFrame([("n0", "Neu", "c", "rose", 0, "2030-01-01", None), ("n7", "Add", None, None, 9, "2030-01-01", None)], NOTES)
    cites = spark.createDataFrame([("c8", "n0", "a", "q", "2030-01-01", 1)], CITES)
    notes, left = N.upsert(*desk, new, cites)
    held = {r["id"]: (r["title"], r["creation_date"]) for r in notes.collect()}
    assert held["n0"] == ("Neu", "2024-01-01") and held["n7"] == ("Add", "2030-01-01") and len(held) == 7
    assert [x[0] for x in rows(left, "id")] == ["c3", "c4", "c8"]


def test_delete_takes_citations_along(desk):
    notes, cites = N.delete(*desk, desk[0].filter("id = 'n0'"))
    assert notes.count() == 5 and [x[0] for x in rows(cites, "id")] == ["c3", "c4"]


@pytest.mark.parametrize(("dragged", "target", "want"), [("n1", "n3", "n0 n2 n3 n1 n4 n9"), ("n3", "n1", "n0 n3 n1 n2 n4 n9"), ("n1", "zz", "n0 n1 n2 n3 n4 n9"), ("n2", "n2", "n0 n1 n2 n3 n4 n9")])
def test_move(desk, dragged, target, want):
    placed = N.positions(desk[0])
    got = sorted((r["position"], r["id"]) for r in N.move(placed, dragged, target).collect())
    assert " ".join(x[1] for x in got) == want and [x[0] for x in got] == list(range(6))


def test_patch_may_set_null(spark, desk):
    changes = spark.createDataFrame([("n0", None, True), ("n1", "no", False)], "id string, title string, set_title boolean")
    got = {r["id"]: r["title"] for r in N.patch(desk[0], changes, ("title",)).collect()}
    assert got["n0"] is None and got["n1"] == "Titre 1"


def test_sets_of_ids(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id string")
    assert rows(N.union_ids(ids("a", "b", None), ids("b", "", "c")), "doc_id") == [("a",), ("b",), ("c",)]
    assert rows(N.except_ids(ids("a", "b"), ids("b")), "doc_id") == [("a",)]
    one = spark.createDataFrame([(["a", "b"],)], "x array<string>")
    assert one.select(N.toggle(F.col("x"), F.lit("b"))).collect()[0][0] == ["a"]
    assert one.select(N.toggle(F.col("x"), F.lit("c"))).collect()[0][0] == ["a", "b", "c"]
    assert one.select(N.toggle(F.col("x"), F.lit("c"), single=True)).collect()[0][0] == ["c"]


def test_references(spark):
    texts = spark.createDataFrame([("t", "see [Réf: a-1, Para. 3] and [réf:b,para.12 ] not [Réf: c d, Para. 1]"), ("u", None), ("v", "[Réf: a-1]")], "key string, s string")
    refs = C.references(texts, "key", "s")
    assert rows(refs, "ref_no", "ref_id", "paragraph_index") == [(1, "a-1", 3), (2, "b", 12)]
    docs = spark.createDataFrame([("a-1", "Title", "1950-01-01", 1), ("a-1", "Later", "1951-01-01", 2)], "doc_id string, title string, sermon_date string, ord int")
    assert rows(C.resolved(refs, docs), "ref_id", "known") == [("a-1", True), ("b", False)]
    assert rows(C.titles(C.plain_references(texts, "key", "s"), docs), "label") == [("[Title]",)]


def test_rich_content(spark):
    docs = spark.createDataFrame([("a", "T", "1950", 1)], "doc_id string, title string, sermon_date string, ord int")
    cites = spark.createDataFrame([("1", "a", "q"), ("2", "a", "q [Réf: a]"), ("3", "ia-a", "q"), ("4", "zz", "[[[NOTE_EXTERNE]]]x"), ("5", None, None)], "id string, sermon_id string, quoted_text string")
    assert rows(C.rich_content(cites, docs), "id", "body") == [("1", "q [Source: T]"), ("2", "q [Réf: a]"), ("3", "q"), ("4", "> **Note**\n\n>x"), ("5", "")]


def test_chat_context_is_cut(spark):
    docs = I.with_key(lib(spark, [{"id": f"d{i}", "title": "T", "date": "1950", "text": "p\n\n" * 3000} for i in range(9)])).withColumn("g", F.lit("x"))
    got = C.chat_context(docs, "g").collect()[0]["context"]
    assert len(got) == 60_000 and got.startswith("[DOC ID: d0] - TITRE: T (1950)\nCONTENU:\n[Para. 1] p\n[Para. 2] p")


def test_history(spark):
    m = spark.createDataFrame([("k", i, "assistant" if i % 2 else "user", str(i)) for i in range(6)] + [("l", 1, "system", "s")], "chat_key string, seq int, role string, content string")
    assert rows(C.last_messages(m), "chat_key", "seq", "role") == [("k", 2, "user"), ("k", 3, "model"), ("k", 4, "user"), ("k", 5, "model"), ("l", 1, "user")]
    cur = spark.createDataFrame([("k", 6, "now")], "chat_key string, seq int, content string")
    assert C.prompt(m.filter("chat_key = 'k'"), cur).count() == 5


def test_definitions(spark):
    words = spark.createDataFrame([("Roi",), ("zzz",)], "word string")
    held = spark.createDataFrame([("roi", "old", ["a"], None, 1), ("ROI", "new", ["a", "b"], None, 2)], "word string, definition string, synonyms array<string>, etymology string, seq long")
    assert rows(C.definitions(words, held).filter("definition is not null"), "word", "definition") == [("Roi", "new")]


def test_web_sources(spark):
    df = spark.createDataFrame([([("t", "u"), (None, "v"), ("x", None)],)], "s array<struct<title:string,uri:string>>")
    assert [(x["title"], x["uri"]) for x in df.select(C.web_sources(F.col("s")).alias("s")).collect()[0]["s"]] == [("t", "u"), ("Source Web", "v")]


def test_json_library(spark, tmp_path):
    p = tmp_path / "library.json"
    p.write_text(json.dumps([{"id": "a", "title": "T", "date": "1950-01-01", "text": "x\n\ny", "highlights": [{"id": "h", "start": 1, "end": 2}]}, {"title": "U", "text": "z"}, {"id": "a", "text": "again"}]))
    got = L.read_json(spark, str(p))
    assert [(r["ord"], r["title"]) for r in got.orderBy("ord").collect()] == [(0, "T"), (1, "U"), (2, None)]
    out = str(tmp_path / "lib")
    assert not L.is_ready(spark, out)
    assert L.import_library(got, out) == 3 and L.is_ready(spark, out)
    assert L.stored(spark, out, "documents").count() == 2 and L.stored(spark, out, "paragraphs").count() == 3
    before = L.stored(spark, out, "documents")
    assert L.import_library(got.limit(1), out) == 1 and L.stored(spark, out, "documents").count() == 1 and L.stored(spark, out, "paragraphs").count() == 2
    # who reads the state before goes on reading it
    assert before.count() == 2


def test_several_library_files(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text(json.dumps([{"id": "x", "title": name}, {"id": name, "title": name}]))
    got = L.read_json(spark, str(tmp_path))
    assert [r["title"] for r in got.orderBy("ord").collect()] == ["a", "a", "b", "b"] and got.select("ord").distinct().count() == 4
    kept = I.dedupe(I.with_key(got))
    assert rows(kept, "doc_id", "title") == [("a", "a"), ("b", "b"), ("x", "a")]
    assert rows(I.dedupe(I.with_key(got), "last"), "doc_id", "title") == [("a", "a"), ("b", "b"), ("x", "b")]


def test_a_match_across_paragraphs_is_found(spark):
    docs = spark.createDataFrame([("d", "xa\n\nbx"), ("e", "ab"), ("f", None), ("g", "")], "doc_id string, text string")
    assert rows(P.match_spans(docs, "(?i)(ab)"), "doc_id", "match_no", "start", "end") == [("d", 1, 1, 3), ("e", 1, 0, 2)]
    many = spark.createDataFrame([("m", "ab-" * 1000)], "doc_id string, text string")
    assert rows(P.match_spans(many, "(?i)(ab)"), "start") == [(3 * k,) for k in range(1000)]


@pytest.mark.parametrize("text", ['{"id": "a"}', "[{", "not json"])
def test_bad_libraries_are_refused(spark, tmp_path, text):
    p = tmp_path / "bad.json"
    p.write_text(text)
    with pytest.raises(L.NotALibrary):
        L.read_json(spark, str(p)).collect()


def test_replace_a_table_read_from(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    L.replace_table(spark.read.parquet(path).filter("id > 2"), path)
    assert spark.read.parquet(path).count() == 2


def test_stream_of_records(spark, tmp_path):
    from quire.streaming import ingest as G

    source = str(tmp_path / "in")
    lib(spark, [{"id": "a", "text": "x\n\ny"}, {"id": "b", "text": None}]).write.parquet(source)
    out = G.paragraphs(G.read_records(spark, source, LIB))
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.read.parquet(str(tmp_path / "out")), "doc_id", "content") == [("a", "x"), ("a", "y"), ("b", "...")]
    states = str(tmp_path / "s")
    spark.createDataFrame([("w", 1, "old"), ("w", 2, "new"), ("v", 1, "only")], "window_id string, seq int, state string").write.parquet(states)
    q = G.last_states(spark.readStream.schema("window_id string, seq int, state string").parquet(states), str(tmp_path / "last"), str(tmp_path / "c2"))
    q.awaitTermination(60)
    assert rows(spark.read.parquet(str(tmp_path / "last")), "window_id", "state") == [("v", "only"), ("w", "new")]
    spark.createDataFrame([("w", 3, "newer"), ("w", 0, "late"), ("u", 1, "first")], "window_id string, seq int, state string").write.mode("append").parquet(states)
    q = G.last_states(spark.readStream.schema("window_id string, seq int, state string").parquet(states), str(tmp_path / "last"), str(tmp_path / "c2"))
    q.awaitTermination(60)
    assert rows(spark.read.parquet(str(tmp_path / "last")), "window_id", "state") == [("u", "first"), ("v", "only"), ("w", "newer")]
