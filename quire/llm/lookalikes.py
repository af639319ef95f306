"""One consistent form of texts that look alike but differ in their characters.

An Arrow column becomes one numpy array of code points. Table gathers classify and replace
characters, expansion offsets make room for the ones that become several, and marks are composed
with their letters for all texts at once; no text is handled by a string call of its own.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quire.llm.codepoints import from_codepoints, ranges, text_array, to_codepoints

# Letters of other scripts and the Latin letters they look like.
CYRILLIC = "АаВЕеЅѕІіЈјКкМНОоРрСсТУуХхҮүҺһԁԌԚԛԜԝӀӏѴѵ"
CYRILLIC_AS = "AaBEeSsIiJjKkMHOoPpCcTYyXxYyHhdGQqWwIlVv"
CYRILLIC_ACCENTED = "ЀѐЁёЇї"
CYRILLIC_ACCENTED_AS = "ÈèËëÏï"
GREEK = "ΑαΒΕΖΗΙιΚκΜΝνΟοΡρΤΥυΧχϹϲͿϳγ"
GREEK_AS = "AaBEZHIiKkMNvOoPpTYuXxCcJjy"
GREEK_ACCENTED = "ΆάΈΊίΌόΎύϊ"
GREEK_ACCENTED_AS = "ÁáÉÍíÓóÝúï"
ARMENIAN = "ԼՍսՏՕօհյոցքզ"
ARMENIAN_AS = "LUuSOohjngfq"
CHEROKEE = "ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏂᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏳᏴ"
CHEROKEE_AS = "DRTiYAJEWMHYGhZbRWSVSLCPKdGB"
COPTIC = "ⲀⲂⲌⲎⲒⲔⲘⲚⲞⲟⲢⲣⲤⲥⲦⲨⲬ"
COPTIC_AS = "ABZHIKMNOoPpCcTYX"
LISU = "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ"
LISU_AS = "BPDTGKJCZFMNLSRVHWXYAEIOU"
PHONETIC = "ɑɡ"
PHONETIC_AS = "ag"
#: Signs of category Cf that are seen.
SEEN_FORMATS = (0x600, 0x601, 0x602, 0x603, 0x604, 0x605, 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD)
#: Invisible characters outside the categories Cf and Cc, as ranges.
MORE_INVISIBLE = ((0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x2065, 0x2065), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF))
#: Controls that are line breaks or tabs.
KEPT_CONTROLS = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85)

DELETE, REPLACE, EXPAND, MARK, WORD, LATIN, LOOKALIKE, EMOJI = (1 << i for i in range(8))
TOUCHED = DELETE | REPLACE | EXPAND | MARK | LOOKALIKE
ZWJ, TAGS = 0x200D, (0xE0020, 0xE007F)
#: The first Hangul syllable, leading consonant, vowel and place before the first trailing consonant; how many of each.
SYLLABLE, LEAD, VOWEL, TRAIL, LEADS, VOWELS, TRAILS = 0xAC00, 0x1100, 0x1161, 0x11A7, 19, 21, 28


def _ordinary(ch: str, kind: str) -> str:
    """The ordinary form of a character: width, font and ligature forms resolved, canonical singles replaced."""
    if kind == "Zs":
        return " "
    if ch == "\u2011":
        return "-"
    tag = unicodedata.decomposition(ch).partition(" ")[0]
    if tag in ("<wide>", "<narrow>"):
        return unicodedata.normalize("NFKC", ch)
    if tag == "<font>" and kind[0] in "LN":
        return unicodedata.normalize("NFKC", ch)
    if tag == "<compat>" and kind[0] in "LN" and kind != "No":
        form = unicodedata.normalize("NFKC", ch)
        return form if form.isascii() and form.isalpha() else ch
    return unicodedata.normalize("NFC", ch)


@functools.lru_cache(1)
def tables() -> dict[str, np.ndarray]:
    """Tables over all code points, from the Unicode database."""
    flags = np.zeros(sys.maxunicode + 1, np.uint8)
    to = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    ccc = np.zeros(sys.maxunicode + 1, np.uint8)
    longer: dict[int, str] = {}
    nfd: dict[int, str] = {}
    for c in [*range(0x80), *range(0x80, 0x323B0), *range(0xE0000, 0xE0200)]:
        if 0xD800 <= c < 0xE000 or 0x3400 <= c < 0x4DC0 or 0x4E00 <= c < 0xA000 or 0x20000 <= c < 0x2F800:
            continue
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind == "Cn":
            continue
        f = 0
        if kind == "Cf" and c not in SEEN_FORMATS or kind == "Cc" and c not in KEPT_CONTROLS:
            f |= DELETE
        if kind[0] == "M":
            f |= WORD
            ccc[c] = unicodedata.combining(ch)
            f |= MARK if ccc[c] else 0
        if kind[0] in "LN":
            f |= WORD
        if kind == "So" or 0x1F3FB <= c <= 0x1F3FF:
            f |= EMOJI
        if kind[0] == "L" and unicodedata.name(ch, "").startswith(("LATIN ", "FULLWIDTH LATIN ")):
            f |= LATIN
        if c >= 0x80 and not f & (DELETE | EMOJI):
            form = _ordinary(ch, kind)
            if form != ch:
                if len(form) == 1:
                    f |= REPLACE
                    to[c] = ord(form)
                else:
                    f |= EXPAND
                    longer[c] = form
                if form[0].isalpha() and form[0] < "\u0250":
                    f |= LATIN
            apart = unicodedata.normalize("NFD", ch)
            if apart != ch and not 0xAC00 <= c < 0xD7A4:
                nfd[c] = apart
        flags[c] = f
    # vowels and trailing consonants may join what stands before them
    flags[VOWEL : VOWEL + VOWELS] |= REPLACE
    flags[TRAIL + 1 : TRAIL + TRAILS] |= REPLACE
    for a, b in MORE_INVISIBLE:
        flags[a : b + 1] = DELETE
    look = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for others, latin in ((CYRILLIC, CYRILLIC_AS), (CYRILLIC_ACCENTED, CYRILLIC_ACCENTED_AS), (GREEK, GREEK_AS), (GREEK_ACCENTED, GREEK_ACCENTED_AS), (ARMENIAN, ARMENIAN_AS), (CHEROKEE, CHEROKEE_AS), (COPTIC, COPTIC_AS), (LISU, LISU_AS), (PHONETIC, PHONETIC_AS)):
        for o, x in zip(others, latin, strict=True):
            look[ord(o)] = ord(x)
            flags[ord(o)] |= LOOKALIKE
    pairs = {}
    for c in nfd:
        d = unicodedata.decomposition(chr(c)).split(" ")
        if len(d) == 2 and d[0][0] != "<" and unicodedata.normalize("NFC", chr(c)) == chr(c):
            pairs[int(d[0], 16) << 21 | int(d[1], 16)] = c
    keys = np.array(sorted(pairs), np.int64)
    return {"flags": flags, "to": to, "ccc": ccc, "look": look, "pair": keys, "composed": np.array([pairs[k] for k in keys.tolist()], np.uint32), **_several("x", longer), **_several("d", nfd)}


def _several(name: str, forms: dict[int, str]) -> dict[str, np.ndarray]:
    """A one-to-many table as sorted code points, starts, lengths and the joined forms."""
    keys = sorted(forms)
    size = np.array([len(forms[k]) for k in keys], np.int64)
    return {name + "_key": np.array(keys, np.uint32), name + "_len": size, name + "_at": np.cumsum(size) - size, name + "_form": np.array([ord(c) for k in keys for c in forms[k]], np.uint32)}


def _expand(cp: np.ndarray, row: np.ndarray, where: np.ndarray, t: dict[str, np.ndarray], name: str) -> tuple[np.ndarray, np.ndarray]:
    """Replace the characters at where by their several-character forms."""
    if not len(where):
        return cp, row
    k = np.searchsorted(t[name + "_key"], cp[where])
    size = np.ones(len(cp), np.int64)
    size[where] = t[name + "_len"][k]
    start = np.cumsum(size) - size
    out = np.repeat(cp, size)
    out[ranges(start[where], size[where])] = t[name + "_form"][ranges(t[name + "_at"][k], t[name + "_len"][k])]
    return out, np.repeat(row, size)


def _visible(cp: np.ndarray, row: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Which characters stay: all but the invisible ones that aren't part of an emoji."""
    keep = (f & DELETE) == 0
    doubt = np.flatnonzero(~keep & ((cp == ZWJ) | (cp == 0xFE0F) | (cp == 0xFE0E) | (cp >= TAGS[0]) & (cp <= TAGS[1])))
    if not len(doubt):
        return keep
    emoji = (f & EMOJI) > 0
    same = lambda i, j: (j >= 0) & (j < len(cp)) & (row[np.clip(j, 0, len(cp) - 1)] == row[i])
    at = lambda a, j: a[np.clip(j, 0, len(cp) - 1)]
    tagged = (cp >= TAGS[0]) & (cp <= TAGS[1])
    base = np.maximum.accumulate(np.where(tagged, -1, np.arange(len(cp))))
    after = same(doubt, doubt - 1) & (at(emoji, doubt - 1) | (at(cp, doubt - 1) == 0xFE0F) & at(emoji, doubt - 2))
    joins = (cp[doubt] == ZWJ) & after & same(doubt, doubt + 1) & at(emoji, doubt + 1)
    varies = ((cp[doubt] == 0xFE0F) | (cp[doubt] == 0xFE0E)) & same(doubt, doubt - 1) & (at(emoji, doubt - 1) | same(doubt, doubt + 1) & (at(cp, doubt + 1) == 0x20E3))
    flag = tagged[doubt] & (base[doubt] >= 0) & same(doubt, base[doubt]) & at(emoji, base[doubt])
    keep[doubt[joins | varies | flag]] = True
    return keep


def _unlook(cp: np.ndarray, row: np.ndarray, t: dict[str, np.ndarray]) -> np.ndarray:
    """Lookalikes to Latin letters, in the words that hold a Latin letter."""
    f = t["flags"][cp]
    hit = np.flatnonzero(f & LOOKALIKE)
    if not len(hit):
        return cp
    inside = (f & WORD) > 0
    start = inside.copy()
    start[1:] &= ~inside[:-1] | (row[1:] != row[:-1])
    word = np.cumsum(start)
    latin = np.zeros(word[-1] + 1, bool)
    latin[word[(f & LATIN) > 0]] = True
    hit = hit[latin[word[hit]]]
    out = cp.copy()
    out[hit] = t["look"][cp[hit]]
    return out


def _compose(cp: np.ndarray, row: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Marks composed with the letters before them, in canonical order, for all texts at once."""
    mark = t["ccc"][cp] > 0
    if not mark.any():
        return cp, row
    # letters before marks come apart first, so that a mark of a lower class can join the bare letter
    before = np.flatnonzero(~mark[:-1] & mark[1:] & (row[:-1] == row[1:]))
    k = np.searchsorted(t["d_key"], cp[before])
    known = (k < len(t["d_key"])) & (t["d_key"][np.minimum(k, len(t["d_key"]) - 1)] == cp[before])
    cp, row = _expand(cp, row, before[known], t, "d")
    ccc = t["ccc"][cp]
    mark = ccc > 0
    head = ~mark
    head[0] = True
    head[1:] |= row[1:] != row[:-1]
    run = np.cumsum(head) - 1
    heads = np.flatnonzero(head)
    busy = np.unique(run[np.flatnonzero(mark)])
    sel = ranges(heads[busy], np.append(heads[1:], len(cp))[busy] - heads[busy])
    order = sel[np.lexsort((ccc[sel], run[sel]))]
    cp = cp.copy()
    cp[sel] = cp[order]
    ccc = t["ccc"][cp]
    length = np.append(heads[1:], len(cp)) - heads
    alive = np.ones(len(cp), bool)
    last = np.zeros(len(heads), np.int16)
    for step in range(1, int(length[busy].max())):
        r = busy[length[busy] > step]
        i, s = heads[r] + step, heads[r]
        open_ = (ccc[s] == 0) & ((last[r] == 0) | (last[r] < ccc[i]))
        key = cp[s].astype(np.int64) << 21 | cp[i]
        k = np.minimum(np.searchsorted(t["pair"], key), len(t["pair"]) - 1)
        fits = open_ & (t["pair"][k] == key)
        cp[s[fits]] = t["composed"][k[fits]]
        alive[i[fits]] = False
        last[r[~fits]] = ccc[i[~fits]]
    return cp[alive], row[alive]


def _syllables(cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Single Hangul consonants and vowels as syllables, by arithmetic."""
    for first, count, base in ((LEAD, LEADS, VOWEL), (SYLLABLE, LEADS * VOWELS * TRAILS, TRAIL)):
        vowels = base == VOWEL
        second = (cp >= base + (not vowels)) & (cp < base + (VOWELS if vowels else TRAILS))
        open_ = (cp >= first) & (cp < first + count) & (vowels | ((cp - np.uint32(SYLLABLE)) % TRAILS == 0))
        i = np.flatnonzero(open_[:-1] & second[1:] & (row[:-1] == row[1:]))
        if len(i):
            cp, alive = cp.copy(), np.ones(len(cp), bool)
            cp[i] = SYLLABLE + ((cp[i] - LEAD) * VOWELS + cp[i + 1] - VOWEL) * TRAILS if vowels else cp[i] + cp[i + 1] - TRAIL
            alive[i + 1] = False
            cp, row = cp[alive], row[alive]
    return cp, row


def consistent(column) -> tuple[pa.StringArray, np.ndarray]:
    """(consistent form, changed) of a text column; null stays null and unchanged."""
    t = tables()
    arr = text_array(column)
    cp, bounds = to_codepoints(arr)
    hits = np.flatnonzero(t["flags"][cp] & TOUCHED)
    rows = np.unique(np.searchsorted(bounds, hits, side="right") - 1)
    changed = np.zeros(len(arr), bool)
    if not len(rows):
        return arr, changed
    size = (bounds[1:] - bounds[:-1])[rows]
    cp = old = cp[ranges(bounds[rows], size)]
    row = np.repeat(np.arange(len(rows)), size)
    f = t["flags"][cp]
    keep = _visible(cp, row, f)
    cp, row, f = cp[keep], row[keep], f[keep]
    cp = t["to"][cp]
    cp, row = _expand(cp, row, np.flatnonzero(f & EXPAND), t, "x")
    if len(cp):
        cp = _unlook(cp, row, t)
        cp, row = _compose(cp, row, t)
        cp, row = _syllables(cp, row)
    new = np.searchsorted(row, np.arange(len(rows) + 1))
    same = (new[1:] - new[:-1]) == size
    eq = np.flatnonzero(same)
    a = ranges((np.cumsum(size) - size)[eq], size[eq])
    b = ranges(new[:-1][eq], size[eq])
    differs = np.zeros(len(eq), bool)
    differs[np.repeat(np.arange(len(eq)), size[eq])[old[a] != cp[b]]] = True
    same[eq] = ~differs
    changed[rows[~same]] = True
    fixed = from_codepoints(cp, new)
    take = np.arange(len(arr))
    take[rows[~same]] = len(arr) + np.flatnonzero(~same)
    return pa.concat_arrays([arr, fixed]).take(pa.array(take)), changed


def normalize(df: DataFrame, text: str, form: str = "form", only_changed: bool = False) -> DataFrame:
    """df with the consistent form of column text in the new last column form.

    Accented letters are single characters; width, font and ligature forms of letters, digits and
    punctuation are ordinary ones; every special space is an ordinary one; invisible characters
    are gone, but for those that hold an emoji together; in a word with Latin letters, letters of
    other scripts that look Latin are Latin. Anything else stays. Null gives null, an empty text
    an empty one; text of any length is handled whole. A column already named form, in any case,
    is replaced. only_changed keeps just the rows whose text differs from its form. Rows keep their number and order: no shuffle.
    """
    source = df.select(*[f"`{c}`" for c in df.columns if c.lower() != form.lower() or c == text])
    kept = [c for c in source.columns if c.lower() != form.lower()]
    schema = T.StructType([*[source.schema[c] for c in kept], T.StructField(form, T.StringType())])
    from_, at = source.columns.index(text), [source.columns.index(c) for c in kept]

    def run(batches):
        for b in batches:
            out, changed = consistent(b.column(from_))
            cols = [b.column(i) for i in at]
            made = pa.RecordBatch.from_arrays([*cols, out], names=[*kept, form])
            yield made.filter(pa.array(changed)) if only_changed else made

    return source.mapInArrow(run, schema)
