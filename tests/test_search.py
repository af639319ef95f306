"""Search against a plain model of it."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import ingest as I
from quire.operators import search as S

WORDS = ["lumière", "Éternel", "roi", "royaume", "l'amour", "mer", "sœur", "que", "le"]
SCHEMA = "ord long, id string, title string, sermon_date string, part_of_day string, city string, version string, audio_url string, text string"


def library(n=60, seed=3):
    rng = random.Random(seed)
    para = lambda: " ".join(rng.choice(WORDS) + rng.choice(["", ",", "!", "."]) for _ in range(rng.randint(1, 12)))
    return [(i, f"d{i}", f"T{i}", f"19{rng.randint(50, 53)}-01-0{rng.randint(1, 3)}", "Soir", None, "", "", "\n\n".join(rng.choice([para(), " ", para()]) for _ in range(rng.randint(1, 5)))) for i in range(n)]


@pytest.fixture(scope="module")
def paras(spark):
    docs = I.dedupe(I.with_key(spark.createDataFrame(library(), SCHEMA)))
    return I.paragraphs(docs, keep=("ord", "title", "sermon_date", "city")).cache()


def model(query, mode, synonyms=(), only_synonyms=False, only_query=False):
    q = X.norm_text(query)
    syn = [] if only_query else [s for s in map(X.norm_text, synonyms) if s]
    out = []
    for ord_, id_, _, date, *_, text in library():
        for i, p in enumerate(re.split(r"\n\s*\n", text)):
            n = X.norm_text(p)
            if not p.strip():
                continue
            if syn:
                hit = any(w in n for w in ([] if only_synonyms else [q]) + syn)
            elif mode == S.Mode.EXACT_PHRASE:
                hit = q in n
            elif mode == S.Mode.DIVERSE:
                hit = any(w in n for w in q.split())
            else:
                hit = all(w in n for w in q.split())
            if hit:
                out.append((date, ord_, i + 1, f"{id_}-{i}"))
    return [x[3] for x in sorted(out, key=lambda x: ([-ord(c) for c in x[0]], x[1], x[2]))]


@pytest.mark.parametrize("mode", list(S.Mode))
@pytest.mark.parametrize("query", ["roi", "eternel roi", "que le", "?!", "L'AMOUR", "absent", "mer lumière"])
def test_scan_is_the_model(paras, query, mode):
    got = [r["paragraph_id"] for r in S.scan(paras, query, mode).collect()]
    assert got == model(query, mode)[:50]


@pytest.mark.parametrize("flags", [{}, {"only_synonyms": True}, {"only_query": True}])
def test_synonyms(paras, flags):
    got = [r["paragraph_id"] for r in S.scan(paras, "roi", S.Mode.EXACT_PHRASE, ["mer", "!"], **flags).collect()]
    assert got == model("roi", S.Mode.EXACT_PHRASE, ["mer", "!"], **flags)[:50]


def test_blank_query_finds_nothing(paras):
    assert S.scan(paras, "  ").count() == 0


def test_pages_follow_each_other(paras):
    whole = model("le", S.Mode.EXACT_PHRASE)
    pages = [r["paragraph_id"] for k in range(3) for r in S.scan(paras, "le", limit=10, offset=10 * k).collect()]
    assert pages == whole[:30]


def test_snippets_without_marks_stand_in_the_paragraph(paras):
    held = {r["paragraph_id"]: r["content"] for r in paras.collect()}
    for r in S.scan(paras, "eternel", S.Mode.EXACT_WORDS).collect():
        assert "<mark>" in r["snippet"]
        assert re.sub("</?mark>|^\\.\\.\\.|\\.\\.\\.$", "", r["snippet"]) in held[r["paragraph_id"]]


def test_fts_wants_whole_tokens_of_a_phrase(spark):
    rows = [("a", "a-0", 1, "Éternel Dieu"), ("b", "b-0", 1, "éternel die"), ("c", "c-0", 1, "royaume")]
    p = spark.createDataFrame(rows, "doc_id string, paragraph_id string, paragraph_index long, content string")
    d = spark.createDataFrame([(x, i, x, "2000-01-01", None) for i, x in enumerate("abc")], "doc_id string, ord long, title string, sermon_date string, city string")
    ids = lambda *a, **k: sorted(r["doc_id"] for r in S.fts(p, d, *a, **k).collect())
    assert ids("eternel die", S.Mode.EXACT_PHRASE) == ["b"]
    assert ids("etern die", S.Mode.EXACT_WORDS) == ["a", "b"]
    assert ids("roy dieu", S.Mode.DIVERSE) == ["a", "c"]
    assert ids("x", S.Mode.DIVERSE, ["eternel di", "roya"]) == ["a", "b", "c"]
    assert ids("*-()", S.Mode.DIVERSE) == []


def test_synonyms_of_one_word_only():
    words = {"roi": [str(i) for i in range(12)]}
    assert S.synonyms_of(words, "Roi") == [str(i) for i in range(8)] and S.synonyms_of(words, "le roi") == [] and S.synonyms_of(words, "x") == []


def test_export_lines(paras):
    lines = [r["line"] for r in S.export_lines(paras).orderBy("n").collect()]
    assert len(lines) == 25 and lines[0].startswith("1. T") and " - Para " in lines[0]


def test_search_is_one_top_k(paras):
    assert "TakeOrderedAndProject" in S.scan(paras, "roi")._jdf.queryExecution().toString()


def test_fts_snippet(spark):
    text = " ".join(f"w{i}" for i in range(300))
    df = spark.createDataFrame([(text,), ("w5",), ("",)], "c string")
    got = [r["s"] for r in df.select(S.fts_snippet(F.col("c"), ["w150"]).alias("s")).collect()]
    assert "<mark>w150</mark>" in got[0] and got[0].startswith("...") and len(got[0].split()) == 96 and got[1:] == ["w5", ""]


def test_index_is_the_token_engine(spark, paras, tmp_path):
    path = str(tmp_path / "postings")
    S.write_postings(S.postings(paras), path)
    index = spark.read.parquet(path)
    for terms, mode in ((["roi", "mer"], S.Mode.EXACT_WORDS), (["roy", "lum"], S.Mode.DIVERSE), (["absent"], S.Mode.DIVERSE), (["?!"], S.Mode.DIVERSE)):
        want = paras.filter(S.fts_condition(X.fts_tokens(F.col("content")), " ".join(terms), mode))
        got = S.by_index(index, terms, mode)
        assert sorted((r[0], r[1]) for r in got.select("doc_id", "paragraph_index").collect()) == sorted((r[0], r[1]) for r in want.select("doc_id", "paragraph_index").collect())
    plan = S.by_index(index, ["roi"])._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(token,roi)" in plan


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_index_finds_what_tokens_do(spark, tmp_path):
    texts = ["Éternel Dieu, notre rocher", "dieu éternel; le rocher", "notre Dieu notre rocher est notre rocher", "rien", "", "notre mont est haut", "pierre"]
    docs = spark.createDataFrame([(f"d{i}", i, "t", f"19{i:02d}-01-01", "c", t) for i, t in enumerate(texts)], "doc_id string, ord long, title string, sermon_date string, city string, text string")
    paras = I.paragraphs(docs)
    path = str(tmp_path / "index")
    S.write_postings(S.positions(paras), path)
    index = spark.read.parquet(path)
    asked = [("eternel dieu", S.Mode.EXACT_PHRASE, ()), ("notre rocher", S.Mode.EXACT_PHRASE, ()), ("notre roch", S.Mode.EXACT_PHRASE, ()), ("rien", S.Mode.EXACT_PHRASE, ()), ("roch haut", S.Mode.DIVERSE, ()), ("roch not", S.Mode.EXACT_WORDS, ()), ("!", S.Mode.DIVERSE, ()), ("rocher", S.Mode.PARTIAL, ("pierre", "notre mont"))]
    for query, mode, also in asked:
        cols = ("paragraph_id", "content", "sermon_date")
        assert rows(S.indexed(index, paras, docs, query, mode, also), *cols) == rows(S.fts(paras, docs, query, mode, also), *cols), query
    plan = S.index_hits(index, "roch", S.Mode.DIVERSE)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(token,roch)" in plan and "text" not in plan
    plan = S.index_hits(index, "notre rocher")._jdf.queryExecution().executedPlan().toString()
    assert "In(token, [notre,rocher])" in plan


def test_more_pages(spark):
    a = spark.createDataFrame([("p1", 1), ("p2", 2)], "paragraph_id string, n int")
    b = spark.createDataFrame([("p2", 2), ("p3", 3)], "paragraph_id string, n int")
    assert rows(S.more(a, b), "paragraph_id", "n") == [("p1", 1), ("p2", 2), ("p3", 3)]


def test_snippet_has_the_most_hits(spark):
    words = [f"w{i}" for i in range(400)]
    for i in (10, 250, 260, 262):
        words[i] = "hit"
    df = spark.createDataFrame([(" ".join(words),)], "c string")
    got = df.select(S.fts_snippet(F.col("c"), ["hit"]).alias("s")).collect()[0]["s"]
    assert got.count("<mark>") == 3 and len(got.replace("...", "").split()) == 96
