"""Text columns against plain versions of them."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import text as X

SAMPLES = ["", "Été, déjà!", "L'œuvre « sainte »", "a" + chr(0xA0) + " b\n\tc", "e" + chr(0x301) + "te", "?!", "ÀÉÎ Ñandú", "  x  ", "Ὁ λόγος", "a.b,c;d:e", "mot-à-mot"]


def ask(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


def test_norm(spark):
    assert ask(spark, [*SAMPLES, None], X.norm) == [X.norm_text(s) for s in SAMPLES] + [""]


@given(st.text(alphabet=st.sampled_from("aéÉ .,!\n" + chr(0xA0) + chr(0x301)), max_size=30))
@settings(max_examples=100)
def test_norm_is_idempotent(text):
    assert X.norm_text(X.norm_text(text)) == X.norm_text(text)


def test_tokens_give_the_text_back(spark):
    assert ["".join(t) for t in ask(spark, SAMPLES, X.tokens_of)] == SAMPLES


def test_paragraphs_keep_blank_ones(spark):
    assert ask(spark, ["\n\na\n \nb\nc\n\n\nd"], X.paragraphs_of) == [["", "a", "b\nc", "d"]]


@pytest.mark.parametrize(("query", "text", "found"), [("ete", "un Été", "Été"), ("été", "un ete", None), ("lamour", "L'amour", "L'amour"), ("que le", "que, LE", "que, LE"), ("a+b", "xa+by", "a+b"), ("le roi", "le\nroi", "le\nroi")])
def test_phrase_pattern(spark, query, text, found):
    assert ask(spark, [text], lambda c: F.nullif(F.regexp_extract(c, X.java(X.phrase_pattern(query)), 1), F.lit(""))) == [found]


def test_folded_query_finds_plain_letters():
    assert re.search(X.phrase_pattern("été", fold=True), "un ete") and not re.search(X.phrase_pattern("été"), "un ete")


def test_exact_word(spark):
    rx = X.phrase_pattern("roi", exact=True)
    assert ask(spark, ["le roi!", "croire", "roi"], lambda c: c.rlike(X.java(rx))) == [True, False, True]


@pytest.mark.parametrize("at", [0, 149, 151, 1200])
def test_snippet_window(spark, at):
    text = "x" * at + "needle" + "y" * (1300 - at)
    got = ask(spark, [text], lambda c: X.snippet(c, X.phrase_pattern("needle")))[0]
    lo, hi = max(0, at - 150), min(len(text), at + 450)
    assert got == ("..." if lo else "") + text[lo:hi] + ("..." if hi < len(text) else "")


def test_snippet_without_match(spark):
    assert ask(spark, ["z" * 700, "short"], lambda c: X.snippet(c, X.phrase_pattern("needle"))) == ["z" * 600 + "...", "short"]


def test_marks_come_off_again(spark):
    made = ask(spark, ["le roi et le Roi"], lambda c: X.highlight(c, X.words_pattern("roi")))
    assert made == ["le <mark>roi</mark> et le <mark>Roi</mark>"]
    assert ask(spark, made, X.strip_marks) == ["le roi et le Roi"]


def test_small_functions(spark):
    assert ask(spark, [0.0, 61.5, 3600.0, float("nan"), None], X.minutes, "double") == ["0:00", "1:01", "60:00", "0:00", "0:00"]
    assert ask(spark, ["01", "12", "13", "x", None], X.month_name) == ["Janvier", "Décembre", None, None, None]
    assert ask(spark, ["", None, "a"], lambda c: X.or_default(c, "d")) == ["d", "d", "a"]
    assert ask(spark, ["mot, puis", "", None], X.first_word) == ["mot", "", None]
    long = "One is here. " * 20 + "Last one!"
    assert ask(spark, [long, "short. text.", "x" * 200], X.last_sentence) == ["Last one!", "short. text.", "x" * 200]
    assert ask(spark, [5.0, 500.0, None], lambda c: X.clamp(c, 8, 150), "double") == [8.0, 150.0, None]
