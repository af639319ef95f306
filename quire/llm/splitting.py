"""Cutting oversized texts into pieces at natural boundaries, by lexical cohesion.

Where a text changes its subject, the words before and after share little: the similarity of the
word blocks on both sides of a boundary has a valley there. Of the boundaries inside each size
window, the one of the deepest valley is cut at; paragraph breaks count before sentence ends,
sentence ends before clause ends and these before blanks, and only a text without any of them
in a window is cut between two characters. Every piece but the first begins with the end of the
one before.
"""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of a block on each side of a boundary, and slots that words are hashed to.
BLOCK, SLOTS = 40, 256
#: Gaps between words whose blocks are held at once.
AT_ONCE = 1 << 13
#: A piece isn't cut before this part of the size limit, where a later boundary exists.
FILL = 0.5

# boundaries, the strongest first; the end of each match is a place to cut at
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
_SENTENCE = re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|\n\s*|[。！？]+")
_CLAUSE = re.compile(r"[,;:–—]+\s+")
_BLANK = re.compile(r"\s+")
_WORD = re.compile(r"[^\W_]+")


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, strengths 4 to 1): character offsets where the text may be cut, ascending."""
    strength: dict[int, int] = {}
    for level, rx in ((4, _PARAGRAPH), (3, _SENTENCE), (2, _CLAUSE), (1, _BLANK)):
        for m in rx.finditer(text):
            if 0 < m.end() < len(text):
                strength.setdefault(m.end(), level)
    at = np.array(sorted(strength), np.int64)
    return at, np.array([strength[p] for p in at.tolist()], np.int64)


def valleys(text: str, at: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The depth of the similarity valley at each place: how far the highest similarities to the left and right lie above it."""
    found = [(m.start(), zlib.crc32(m.group().lower().encode()) % SLOTS) for m in _WORD.finditer(text)]
    if not found or not len(at):
        return np.zeros(len(at))
    start, slot = np.array(found, np.int64).T
    n = len(start)
    # similarity at gaps between words, one gap each `step` words
    step = max(1, block // 8)
    gaps = np.arange(0, n + 1, step)
    cell, wide = np.minimum(np.arange(n) // step, len(gaps) - 1), max(1, block // step)
    sim = np.ones(len(gaps))
    for a in range(0, len(gaps), AT_ONCE):
        b = min(len(gaps), a + AT_ONCE)
        lo, hi = max(0, a - wide), min(len(gaps), b + wide)
        i, j = np.searchsorted(cell, [lo, hi])
        count = np.bincount((cell[i:j] - lo) * SLOTS + slot[i:j], minlength=(hi - lo) * SLOTS).reshape(hi - lo, SLOTS).astype(np.float32)
        run = np.zeros((hi - lo + 1, SLOTS), np.float32)
        np.cumsum(count, axis=0, out=run[1:])
        g = np.arange(a, b) - lo
        left = run[g] - run[np.maximum(g - wide, 0)]
        right = run[np.minimum(g + wide, hi - lo)] - run[g]
        norm = np.sqrt((left**2).sum(1) * (right**2).sum(1))
        sim[a:b] = np.where(norm > 0, (left * right).sum(1) / np.maximum(norm, 1e-9), 1.0)
    near = 2 * wide
    pad = np.pad(sim, near, constant_values=-1.0)
    views = np.lib.stride_tricks.sliding_window_view(pad, near + 1)
    depth = (views[: len(sim)].max(1) - sim) + (views[near : near + len(sim)].max(1) - sim)
    return depth[np.minimum(np.searchsorted(start, at) // step, len(gaps) - 1)]


def _joined(text: str, p: int) -> bool:
    """Whether a cut before character p would part a character from its marks."""
    return 0 < p < len(text) and (unicodedata.combining(text[p]) > 0 or text[p] in "\u200d\ufe0f" or text[p - 1] == "\u200d")


def split(text: str | None, limit: int, overlap: int, block: int = BLOCK) -> list[tuple[int, int, int]]:
    """(start, end, shared) of each piece: text[start:end] has at most limit characters, of which
    the first `shared` (at most overlap) end the piece before; without them, all pieces joined
    give the text. A text within the limit is one piece; null and empty texts are none."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    if not text:
        return []
    n = len(text)
    if n <= limit:
        return [(0, n, 0)]
    at, strength = boundaries(text)
    depth = valleys(text, at, block)
    out, start, done = [], 0, 0
    while n - start > limit:
        least = max(done + 1, start + int(limit * FILL))
        a, b = np.searchsorted(at, least), np.searchsorted(at, start + limit, side="right")
        if a == b:
            a = np.searchsorted(at, done + 1)
        if a < b:
            s = strength[a:b]
            # paragraph breaks and sentence ends alike are natural, by the depth of the valley
            best = np.flatnonzero(s >= 3) if (s >= 3).any() else np.flatnonzero(s == s.max())
            score = depth[a:b][best] + 0.25 * (s[best] == 4)
            end = int(at[a + best[len(score) - 1 - np.argmax(score[::-1])]])
        else:
            end = start + limit
            while end > done + 1 and _joined(text, end):
                end -= 1
            if end == done + 1:
                end = start + limit
        out.append((start, end, done - start))
        # the overlap begins at the strongest boundary within reach, else it has its full length
        lo, hi = np.searchsorted(at, max(end - overlap, start + 1)), np.searchsorted(at, end)
        start, done = end - overlap if overlap else end, end
        if overlap and lo < hi:
            sentence = np.flatnonzero(strength[lo:hi] >= 3)
            start = int(at[lo + (sentence[0] if len(sentence) else 0)])
        start = max(start, out[-1][0] + 1)
        while start < done and _joined(text, start):
            start += 1
    out.append((start, n, done - start))
    return out


def pieces(df: DataFrame, key: list[str], text: str, limit: int, overlap: int, block: int = BLOCK, whole: bool = True) -> DataFrame:
    """(key…, piece, start, shared, content): the pieces of each record's text, piece counting from 1.

    start is the offset in characters, shared how many of the piece's first characters end the
    piece before. Texts within the limit are passed on as one piece without leaving the JVM; with
    whole=False they are left out. Null and empty texts give no piece. Repeated rows (same key and
    text) count once. Keys may be null; other columns are ignored.
    Only oversized texts, each whole, reach Python, spread by a shuffle of just those.
    """
    cols = [F.col(f"`{k}`") for k in key]
    source = df.select(*cols, F.col(f"`{text}`").alias("content"))
    # few texts are much work: a fixed number of partitions, by key and length, which also serves to find repeated rows
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = source.filter(F.length("content") > limit).withColumn("_n", F.length("content")).repartition(n, *cols, "_n").dropDuplicates().drop("_n")
    schema = T.StructType([*[source.schema[k] for k in key], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("shared", T.LongType()), T.StructField("content", T.StringType())])

    def run(frames):
        for f in frames:
            rows = [(i, k, s, sh, t[s:e]) for i, t in enumerate(f["content"]) for k, (s, e, sh) in enumerate(split(t, limit, overlap, block), 1)]
            if rows:
                i, k, s, sh, c = zip(*rows)
                made = f[key].iloc[list(i)].reset_index(drop=True)
                yield made.assign(piece=pd.array(k, "int32"), start=s, shared=sh, content=c)

    cut = large.mapInPandas(run, schema)
    if not whole:
        return cut
    small = source.filter((F.length("content") > 0) & (F.length("content") <= limit)).dropDuplicates()
    return small.select(*cols, F.lit(1).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("shared"), "content").unionByName(cut)
