"""Text functions on columns: normal form, splitting, tokens, highlight patterns and match places.

All are compositions of built-in functions, so they stay in the JVM. Lengths and places count code
points.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space, for use inside brackets of a pattern.
WS = "\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Punctuation that comparisons ignore.
PUNCTUATION = '.,;:“”"?!()'
#: The accented letters that a plain letter of a query also finds.
VARIANTS = {"a": "aàáâãäå", "e": "eèéêë", "i": "iìíîï", "o": "oòóôõö", "u": "uùúûü", "y": "yýÿ", "c": "cç", "n": "nñ"}
#: Patterns of what may stand between the letters of a word, and between words.
BETWEEN_LETTERS = "[^a-z0-9À-ÿ]*"
BETWEEN_WORDS = "[" + WS + ".,;:!–?\"“”'()\\[\\]]+"
BLANK_LINE = "\n[" + WS + "]*\n"
TOKEN = "[" + WS + "]+|[^" + WS + "]+"
FTS_TOKEN = r"[\p{L}\p{N}\p{Co}]+"


@functools.lru_cache(1)
def accent_table() -> tuple[str, str]:
    """(from, to) for translate: letters whose decomposition without marks is one letter, then the marks, which have no counterpart."""
    marks = [chr(c) for c in range(0x300, 0x370)]
    source, target = [], []
    for c in range(0x80, min(sys.maxunicode, 0xFFFF)):
        if 0xD800 <= c < 0xE000 or 0x300 <= c < 0x370:
            continue
        bare = "".join(x for x in unicodedata.normalize("NFD", chr(c)) if x not in marks)
        if len(bare) == 1 and bare != chr(c):
            source.append(chr(c))
            target.append(bare)
    return "".join(source + marks), "".join(target)


def js_trim(col: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(col, f"^[{WS}]+|[{WS}]+$", "")


def unaccent(col: Column) -> Column:
    return F.translate(col, *accent_table())


def norm(col: Column) -> Column:
    """Lower case without accents and punctuation, white space single; null gives an empty text."""
    bare = F.regexp_replace(F.lower(unaccent(F.coalesce(col, F.lit("")))), "[" + PUNCTUATION + "]", "")
    return F.trim(F.regexp_replace(bare, f"[{WS}]+", " "))


def norm_text(text: str | None) -> str:
    """norm of a literal."""
    if not text:
        return ""
    bare = "".join(c for c in unicodedata.normalize("NFD", text) if not "\u0300" <= c <= "\u036f").lower()
    return " ".join(x for x in re.split(f"[{WS}]+", re.sub("[" + PUNCTUATION + "]", "", bare)) if x)


def paragraphs_of(text: Column, separator: str = BLANK_LINE) -> Column:
    """The raw paragraphs of a text, blank ones included."""
    return F.split(text, separator, -1)


def tokens_of(text: Column) -> Column:
    """Words and runs of white space, in order; joined they give the text."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def fts_tokens(text: Column) -> Column:
    """Runs of letters, digits and private-use characters, lower case, without accents."""
    return F.regexp_extract_all(F.lower(unaccent(F.coalesce(text, F.lit("")))), F.lit(FTS_TOKEN), F.lit(0))


def _letters(word: str, fold: bool) -> str:
    if fold:
        word = norm_text(word)
    return BETWEEN_LETTERS.join("[" + VARIANTS[c] + "]" if c in VARIANTS else re.escape(c) if c.isascii() else c for c in word)


def _words(query: str) -> list[str]:
    return [w for w in re.split(f"[{WS}]+", query.lower()) if w]


def phrase_pattern(query: str, exact: bool = False, fold: bool = False) -> str:
    """A pattern that finds the words of query in a row, whatever their accents and the punctuation between.

    Group 1 is the match; exact wants no letter or digit at its edges, which then belong to the
    whole match. fold also lets an accented letter of the query find the plain one.
    """
    body = BETWEEN_WORDS.join(_letters(w, fold) for w in _words(query))
    return f"(?i)(?:^|[^a-z0-9À-ÿ])({body})(?:$|[^a-z0-9À-ÿ])" if exact else f"(?i)({body})"


def words_pattern(query: str, fold: bool = False) -> str:
    """A pattern that finds each word of query by itself."""
    return "(?i)(" + "|".join(_letters(w, fold) for w in _words(query)) + ")"


def java(pattern: str) -> str:
    """The pattern with case folding for all letters, as the JVM wants it."""
    return pattern.replace("(?i)", "(?iu)", 1)


def first_place(col: Column, pattern: str) -> Column:
    """The place of the first match, counted from 0; null without one."""
    return F.when(col.rlike(java(pattern)), F.length(F.split(col, java(pattern), 2)[0]))


def snippet(col: Column, pattern: str, before: int = 150, after: int = 450, without: int = 600) -> Column:
    """The text around the first match, `before` to `after` it, or its first characters without one; dots where it is cut."""
    at = first_place(col, pattern)
    lo = F.greatest(at - before, F.lit(0))
    hi = F.least(at + after, F.length(col))
    around = F.concat(F.when(lo > 0, "...").otherwise(""), F.substring(col, lo + 1, hi - lo), F.when(hi < F.length(col), "...").otherwise(""))
    head = F.concat(F.substring(col, 1, without), F.when(F.length(col) > without, "...").otherwise(""))
    return F.when(at.isNull(), head).otherwise(around)


def highlight(col: Column, pattern: str, opening: str = "<mark>", closing: str = "</mark>") -> Column:
    """The text with every match marked."""
    return F.regexp_replace(col, java(pattern), opening.replace("$", "\\$") + "$1" + closing.replace("$", "\\$"))


def strip_marks(col: Column) -> Column:
    return F.regexp_replace(col, "<mark[^>]*>|</mark>", "")


#: Values that running() adds up at a time.
RUN = 32


def running(values: Column, inclusive: bool = False) -> Column:
    """The sum of the values before each one of an array, or up to it, without a window.

    Sums are built in runs of RUN values and then over the runs, as each step copies what its run has so far.
    """

    def sums(arr: Column, start: Column) -> Column:
        none = F.array().cast("array<bigint>")
        step = F.aggregate(arr, F.struct(start.alias("at"), none.alias("out")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"] + x if inclusive else a["at"])).alias("out")))
        return step["out"]

    zero = F.lit(0).cast("long")
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int")), lambda i: F.slice(values, i * RUN + 1, F.lit(RUN)))
    each = F.transform(runs, lambda r: F.aggregate(r, zero, lambda a, x: a + x))
    heads = F.aggregate(each, F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]
    whole = F.flatten(F.zip_with(runs, heads, sums))
    return F.when(F.size(values) > RUN, whole).when(F.size(values) > 0, sums(values, zero)).when(F.size(values) == 0, F.array().cast("array<bigint>"))


def match_structs(col: Column, pattern: str) -> Column:
    """(piece, match) of every match: the text since the match before, and the match itself."""
    pieces, found = F.split(col, java(pattern), -1), F.regexp_extract_all(col, F.lit(java(pattern)), F.lit(0))
    return F.when(F.size(found) > 0, F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.struct(p.alias("piece"), m.alias("match"))))


def last_sentence(col: Column, longer_than: int = 150) -> Column:
    """The last sentence of a text longer than that; else the whole."""
    found = F.regexp_extract_all(col, F.lit("[^.!?]+[.!?]+"), F.lit(0))
    last = js_trim(F.try_element_at(found, F.lit(-1)))
    return F.when((F.length(col) > longer_than) & (F.size(found) > 0) & (last != ""), last).otherwise(col)


def first_word(col: Column) -> Column:
    """Up to the first blank, without punctuation."""
    return F.regexp_replace(F.split(col, " ", 2)[0], "[.,;?!]", "")


def minutes(seconds: Column) -> Column:
    """m:ss; NaN and null give 0:00."""
    good = ~F.isnan(seconds) & seconds.isNotNull()
    whole = F.floor(seconds)
    return F.when(good, F.concat((F.floor(seconds / 60)).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))).otherwise("0:00")


#: Names of the months.
MONTHS = {
    "fr": ("Janvier", "Février", "Mars", "Avril", "Mai", "Juin", "Juillet", "Août", "Septembre", "Octobre", "Novembre", "Décembre"),
    "en": ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"),
}


def month_name(month: Column, lang: str = "fr") -> Column:
    """The name of a two-digit month; null for anything else."""
    n = month.try_cast("int")
    return F.when(n.between(1, 12), F.element_at(F.array(*[F.lit(m) for m in MONTHS[lang]]), n))


def or_default(col: Column, default: str) -> Column:
    """The default for null and empty text."""
    return F.coalesce(F.when(col != "", col), F.lit(default))


def given(col: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(col != "", F.lit(False))


def clamp(col: Column, low: float, high: float) -> Column:
    """The value kept between low and high; null stays null."""
    return F.when(col.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), col)))
