"""Long exact spans that records share.

Compressed FM-indexes, one a shard: the texts of a shard are indexed, and each of them is streamed
through the index by backward search, which gives the matching statistics of every place and, where
they reach `least` characters, the interval of all suffixes that match. The intervals are all that
pairs, spans and shared characters are taken from.

So that the work doesn't grow with the square of the collection, a text goes only to the shards where
it can match. Every run of `least` characters has anchors: of its `gram`-character pieces those with
the smallest hash. Texts that share a run share its anchors; an anchor of one text only is dropped. The
text around the other anchors, which holds every run that another text can share, is sent to a shard
in stretches. Anchors that stand together in similar texts go to the same shard, as long as it isn't
too large, so most texts come to one shard in one stretch. An anchor of very many texts, as a formula
has, gives way to the runs of `least` characters around it, of which again those of one text only are
dropped; so texts that share less than a run are never compared, however many they are.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import fmindex
from quire.llm.codepoints import from_codepoints, ranges, to_codepoints
from quire.session import materialize

#: Characters of an anchor.
GRAM = 50
#: Bytes of text of a shard's index, about.
SHARD = 1_200_000
#: Different texts of an anchor, or of anchors that go together, from which they are parted.
MOST = 3_000
#: Places of a text that are streamed in one row.
LANE = 320
#: Rows and characters whose anchors are looked for at once.
ROWS, CHARS = 1_000, 600_000
#: Rows that are given out at once.
OUT = 200_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


# ---- anchors


def _sliding(a: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each window of width values, by doubling."""
    done, out = 1, a
    while done * 2 <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    return pick(out[: len(out) - (width - done)], out[width - done :]) if width > done else out


def _hashes(cp: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` characters from each place on."""
    n = len(cp)
    c = (cp.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    power = np.full(n, _BASE)
    power[0] = 1
    np.cumprod(power, out=power)
    c *= power
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(c, out=run[1:])
    power[:] = _BACK
    power[0] = 1
    np.cumprod(power, out=power)
    h = (run[gram:] - run[:-gram]) * power[: n - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def anchors(cp: np.ndarray, bounds: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset, hash) of the anchors of each row; rows shorter than least have none."""
    none = np.empty(0, np.int64)
    n, width = len(cp), least - gram + 1
    if n < least:
        return none, none, none.view(np.uint64)
    h = _hashes(cp, gram)
    low = _sliding(h, width, np.minimum)
    # windows that cross the end of a row hold nothing
    size = np.diff(bounds)
    inside = np.zeros(n + 1, np.int32)
    long = size >= least
    np.add.at(inside, bounds[:-1][long], 1)
    np.add.at(inside, bounds[1:][long] - least + 1, -1)
    low[np.cumsum(inside)[: len(low)] == 0] = 0
    # a piece is an anchor when it is the smallest of a window that it stands in
    edge = np.zeros(width - 1, np.uint64)
    high = _sliding(np.concatenate([edge, low, edge]), width, np.maximum)
    at = np.flatnonzero((high == h) & (high > 0))
    row = np.searchsorted(bounds, at, side="right") - 1
    keep = thinned(at, row, h[at], 2 * least - gram)
    at, row = at[keep], row[keep]
    return row, at - bounds[row], h[at]


def thinned(at: np.ndarray, row: np.ndarray, h: np.ndarray, reach: int) -> np.ndarray:
    """Which of equal anchors of a row are needed so that the texts of `reach` characters around them cover the same.

    Of a chain of equal anchors, each less than half of reach from the next, the last is kept and
    the first one in every cell of half of reach: the texts around two that follow each other
    touch, and so hold those around all between. So a long row of one character has few anchors.
    """
    half = max(1, reach // 2)
    order = np.lexsort((at, h, row))
    a, r, g = at[order], row[order], h[order]
    n = len(a)
    joined = np.zeros(n + 1, bool)
    joined[1:-1] = (r[1:] == r[:-1]) & (g[1:] == g[:-1]) & (a[1:] - a[:-1] < half)
    cell = np.ones(n, bool)
    cell[1:] = a[1:] // half != a[:-1] // half
    keep = np.zeros(n, bool)
    keep[order] = ~joined[:-1] | ~joined[1:] | cell
    return keep


def _batches(batches, column: int):
    """(part of a batch, code points, bounds): rows by the number, fewer where their texts are long; one row is never cut."""
    for b in batches:
        at = 0
        while at < b.num_rows:
            part = b.slice(at, ROWS)
            cp, bounds = to_codepoints(part.column(column))
            rows = max(1, int(np.searchsorted(bounds, CHARS, side="right")) - 1)
            if rows < part.num_rows:
                part = part.slice(0, rows)
                cp, bounds = cp[: bounds[rows]], bounds[: rows + 1]
            at += part.num_rows
            yield part, cp, bounds


def _anchor_rows(recs: DataFrame, least: int, gram: int) -> DataFrame:
    """(anchor, tid, who, pos) of every text."""

    def run(batches):
        for part, cp, bounds in _batches(batches, 2):
            row, off, h = anchors(cp, bounds, least, gram)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), part.column(0).take(take), part.column(1).take(take), pa.array(off.astype(np.int32))], names=["anchor", "tid", "who", "pos"])

    return recs.select("tid", "who", "text").mapInArrow(run, "anchor long, tid long, who long, pos int")


def _lists(column) -> tuple[np.ndarray, list[np.ndarray]]:
    """(sizes, flat fields) of a column of arrays of structs."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    return np.diff(column.offsets.to_numpy()), [f.to_numpy(zero_copy_only=False) for f in flat.flatten()]


def _different(*cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): an order of rows by their columns, and which rows in it differ from the one before."""
    o = np.lexsort(cols[::-1])
    new = np.ones(len(o), bool)
    if len(o):
        new[1:] = np.any([c[o[1:]] != c[o[:-1]] for c in cols], axis=0)
    return o, new


def _merged(row: np.ndarray, group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, group, start, end): intervals of the same row and group that touch joined to one."""
    o = np.lexsort((start, group, row))
    row, group, start, end = row[o], group[o], start[o], end[o]
    new = np.ones(len(o), bool)
    new[1:] = (row[1:] != row[:-1]) | (group[1:] != group[:-1])
    # the farthest end so far, within the same row and group
    part = np.cumsum(new)
    far = np.maximum.accumulate(end + part * np.int64(1 << 32)) - part * np.int64(1 << 32)
    new[1:] |= start[1:] > far[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(o)) - 1
    return row[first], group[first], start[first], far[last] if len(first) else far[:0]


def _run_rows(hot: DataFrame, recs: DataFrame, least: int, gram: int) -> DataFrame:
    """(run, anchor, tid, who, pos): the runs of `least` characters around hot anchors; hot is (tid, hits of anchor and pos)."""

    def run(batches):
        for part, cp, bounds in _batches(batches, 2):
            if len(cp) < least:
                continue
            size, (anchor, pos) = _lists(part.column(3))
            row, pos = np.repeat(np.arange(part.num_rows), size), pos.astype(np.int64)
            length = np.diff(bounds)[row]
            row, anchor, a, b = _merged(row, anchor, np.maximum(pos - (least - gram), 0), np.minimum(pos + least, length))
            n = np.maximum(b - a - least + 1, 0)
            at, row, anchor = ranges(bounds[row] + a, n), np.repeat(row, n), np.repeat(anchor, n)
            h = _hashes(cp, least)[at]
            keep = thinned(at, row, h ^ anchor.view(np.uint64), least)
            at, row, anchor, h = at[keep], row[keep], anchor[keep], h[keep]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(anchor), part.column(0).take(take), part.column(1).take(take), pa.array((at - bounds[row]).astype(np.int32))], names=["run", "anchor", "tid", "who", "pos"])

    return recs.join(hot, "tid").select("tid", "who", "text", "hits").mapInArrow(run, "run long, anchor long, tid long, who long, pos int")


# ---- which texts meet where


@dataclasses.dataclass
class Hits:
    """Where texts may share runs: few is (tid, who, anchor, pos, width), of anchors of a bounded number of texts;
    many, or None, (run, anchor, tid, pos) of runs that more texts share."""

    few: DataFrame
    many: DataFrame | None


def _held(found: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """(held, hot): the values of `by` of several owners, and those of them with more than MOST texts."""
    held = materialize(found.groupBy(by).agg(F.min("who").alias("lo"), F.max("who").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select(by, "n"))
    # rows bound texts; the few values of many rows are counted exactly
    often = found.join(held.filter(F.col("n") > MOST).select(by), by, "left_semi")
    hot = materialize(often.groupBy(by).agg(F.count_distinct("tid").alias("m")).filter(F.col("m") > MOST).select(by))
    return held.select(by), hot


def hits(recs: DataFrame, least: int, gram: int) -> Hits:
    """Where the texts of recs (tid, who, text) may share runs with texts of another owner (who)."""
    found = materialize(_anchor_rows(recs, least, gram))
    held, hot = _held(found, "anchor")
    kind = ("tid", "who", "anchor", "pos")
    few = found.join(held.join(hot, "anchor", "left_anti"), "anchor", "left_semi").select(*kind, F.lit(gram).alias("width"))
    if hot.isEmpty():
        return Hits(few, None)
    around = found.join(hot, "anchor", "left_semi").groupBy("tid").agg(F.collect_set(F.struct("anchor", "pos")).alias("hits"))
    runs = materialize(_run_rows(around, recs, least, gram))
    held, hot = _held(runs, "run")
    more = runs.join(held.join(hot, "run", "left_anti"), "run", "left_semi").select("tid", "who", F.col("run").alias("anchor"), "pos", F.lit(least).alias("width"))
    many = None if hot.isEmpty() else runs.join(hot, "run", "left_semi").select("run", "anchor", "tid", "pos").distinct()
    return Hits(few.unionByName(more), many)


def _units(few: DataFrame) -> DataFrame:
    """(tid, code, unit, block, pos, width): hits by the unit that compares them, each of a bounded number of texts.

    The unit of an anchor is the least anchor of any of its texts, so that texts with much in
    common meet in one place; where that would bring too many together, it is the anchor itself.
    code is the only owner of the text, or the text itself if it has several.
    """
    code = F.when(F.min("who") == F.max("who"), F.min("who")).otherwise(F.col("tid"))
    by_text = materialize(few.groupBy("tid").agg(F.collect_set(F.struct("anchor", "pos", "width")).alias("hits"), F.min("anchor").alias("label"), code.alias("code")))
    anchor = by_text.select("label", F.explode(F.array_distinct("hits.anchor")).alias("anchor")).groupBy("anchor").agg(F.min("label").alias("unit"), F.count("*").alias("n"))
    anchor = materialize(anchor)
    size = anchor.groupBy("unit").agg(F.sum("n").alias("all"))
    unit = anchor.join(size, "unit").select("anchor", F.when(F.col("all") <= MOST, F.col("unit")).otherwise(F.col("anchor")).alias("unit"))
    each = by_text.select("tid", "code", F.explode("hits").alias("h")).select("tid", "code", "h.anchor", "h.pos", "h.width")
    return each.join(unit, "anchor").select("tid", "code", "unit", F.lit(-1).alias("block"), "pos", "width")


def _blocks(many: DataFrame, least: int) -> DataFrame:
    """As _units, of runs that more than MOST texts share: the texts of an anchor in blocks, each with each other one.

    All texts of such a run are pairs, so this grows as the result does.
    """
    texts = many.groupBy("anchor").agg(F.count_distinct("tid").alias("m")).select("anchor", F.ceil(F.col("m") / (MOST // 2 + 1)).cast("int").alias("nb"))
    placed = many.join(texts, "anchor").withColumn("block", F.pmod(F.xxhash64("tid"), F.col("nb")).cast("int"))
    both = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    i, j = F.least("block", "other"), F.greatest("block", "other")
    return both.select("tid", F.col("tid").alias("code"), F.xxhash64("anchor", i, j).alias("unit"), F.when(i == j, -1).otherwise(F.col("block")).alias("block"), "pos", F.lit(least).alias("width"))


_STRETCH = "unit long, block int, tid long, code long, start int, text string"


def _stretches(placed: DataFrame, recs: DataFrame, least: int) -> DataFrame:
    """(unit, block, tid, code, start, text): the parts of each text that a unit compares."""
    held = placed.groupBy("tid", "code").agg(F.collect_set(F.struct("unit", "block", "pos", "width")).alias("hits"))

    def run(batches):
        last = None
        for part, cp, bounds in _batches(batches, 2):
            size, (unit, block, pos, width) = _lists(part.column(3))
            tid = part.column(0).to_numpy()
            # copies of a text follow each other; one is enough
            fresh = np.ones(len(tid), bool)
            fresh[1:] = tid[1:] != tid[:-1]
            fresh[:1] = tid[:1] != last
            last = tid[-1] if len(tid) else last
            row = np.repeat(np.arange(part.num_rows), size)
            keep = fresh[row]
            row, unit, block, pos, width = row[keep], unit[keep], block[keep], pos[keep].astype(np.int64), width[keep]
            o, new = _different(unit, block)
            group, names = np.empty(len(o), np.int64), (unit[o[new]], block[o[new]])
            group[o] = np.cumsum(new) - 1
            a, b = np.maximum(pos - (least - width), 0), np.minimum(pos + least, np.diff(bounds)[row])
            row, group, a, b = _merged(row, group, a, b)
            said = from_codepoints(cp[ranges(bounds[row] + a, b - a)], np.append(0, np.cumsum(b - a)))
            take = pa.array(row)
            cols = [pa.array(names[0][group]), pa.array(names[1][group]), part.column(0).take(take), part.column(1).take(take), pa.array(a.astype(np.int32)), said]
            yield pa.RecordBatch.from_arrays(cols, names=["unit", "block", "tid", "code", "start", "text"])

    return recs.select("tid", "text").join(held, "tid").select("tid", "code", "text", "hits").mapInArrow(run, _STRETCH)


def _shards(batches):
    """Tables of whole units, about SHARD bytes of text each."""
    held, size, last = [], 0, None
    for b in batches:
        unit = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)] if len(unit) else [0]
        for x, y in zip(cuts, cuts[1:]):
            if size > SHARD and unit[x] != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
            part = b.slice(x, y - x)
            held.append(part)
            size += part.column(5).nbytes
            last = unit[x]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


# ---- a shard


class Shard:
    """The different stretches of a shard in an index, and the texts that have them."""

    def __init__(self, table: pa.Table, least: int):
        col = lambda i: table.column(i).to_numpy()
        text = table.column(5).combine_chunks() if isinstance(table.column(5), pa.ChunkedArray) else table.column(5)
        coded = text.dictionary_encode()
        number = coded.indices.to_numpy().astype(np.int64)
        # texts by stretch; a text comes once, whatever units it has the stretch in, but for its blocks
        block = col(1).astype(np.int64)
        rows = [number, col(2), col(4).astype(np.int64), col(3), block, np.where(block < 0, 0, col(0))]
        o, new = _different(*rows)
        number, self.tid, self.start, self.code, self.block, self.unit = (x[o[new]] for x in rows)
        self.at = np.searchsorted(number, np.arange(len(coded.dictionary) + 1))
        self.least = least
        self.cp, self.bounds = to_codepoints(coded.dictionary)
        self.index = fmindex.Index(self.cp, self.bounds, least)
        # rows that are streamed: up to LANE places of a stretch, the longest first
        places = np.diff(self.bounds) - least + 1
        self.whole = np.flatnonzero(places > 0)
        n = np.maximum(-(-places // LANE), 0)
        string, k = np.repeat(np.arange(len(places)), n), ranges(np.zeros(len(n), np.int64), n)
        end = np.minimum((k + 1) * LANE, places[string]) + least - 1
        size = end - k * LANE
        order = np.argsort(-size, kind="stable")
        self.string, self.end, self.size = string[order], end[order], size[order]

    def streamed(self):
        """(step, lo, hi, rows) for every step: the intervals of those of the first rows that match in several places."""
        symbol = self.index.symbols(self.cp)
        end = self.bounds[self.string] + self.end
        for step, lo, hi in self.index.stream(symbol, end, self.size):
            w = np.flatnonzero(hi - lo > 1)
            if len(w):
                yield step, lo[w], hi[w], w, symbol[np.maximum(end[w] - step - 1, 0)]

    def matches(self, begins: bool) -> tuple[np.ndarray, ...]:
        """(string, place, other string, its place) of the last place of every match of a row that can't go on to the
        right, and with begins those of the first places too, as four more."""
        n = len(self.string)
        next_step, next_lo, next_hi = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
        ends: list[tuple] = []
        first: list[tuple] = []
        for step, lo, hi, w, symbol in self.streamed():
            # the suffixes of this interval that match one character more to the right
            goes = next_step[w] == step
            a, b = np.where(goes, next_lo[w], lo), np.where(goes, next_hi[w], lo)
            size = np.concatenate([a - lo, hi - b])
            row = ranges(np.concatenate([lo, b]), size)
            if len(row):
                ends.append((np.repeat(np.concatenate([w, w]), size), np.full(len(row), step), row))
            more = np.flatnonzero(self.size[w] > step)
            v = w[more]
            next_lo[v], next_hi[v] = self.index.extend(symbol[more], lo[more], hi[more])
            next_step[v] = step + 1
            if begins:
                left = np.zeros(len(w), np.int64)
                left[more] = next_hi[v] - next_lo[v]
                u = np.flatnonzero(left < hi - lo)
                size = (hi - lo)[u]
                row, which = ranges(lo[u], size), np.repeat(u, size)
                own = np.where(self.size[w] > step, symbol, -1)[which]
                new = self.index.before(row)[0] != own
                first.append((w[which[new]], np.full(int(new.sum()), step), row[new]))
        out = self._placed(ends)
        return (*out, *self._placed(first)) if begins else out

    def _placed(self, events: list[tuple]) -> tuple[np.ndarray, ...]:
        none = np.empty(0, np.int64)
        if not events:
            return none, none, none, none
        lane, step, row = (np.concatenate(x) for x in zip(*events))
        s, o = self.index.places(row)
        q, p = self.string[lane], self.end[lane] - step
        keep = (q != s) | (p != o)
        return lane[keep], p[keep], s[keep], o[keep]

    def _texts(self, q: np.ndarray, s: np.ndarray, *more: np.ndarray):
        """The texts of strings q with those of strings s, in parts: (row of q's text, row of s's text, more…)."""
        nq, ns = self.at[q + 1] - self.at[q], self.at[s + 1] - self.at[s]
        total = np.cumsum(nq * ns)
        x = 0
        while x < len(q):
            y = max(x + 1, int(np.searchsorted(total, (total[x - 1] if x else 0) + OUT, side="right")))
            i = np.repeat(np.arange(x, y), nq[x:y])
            a = ranges(self.at[q[x:y]], nq[x:y])
            b, k = ranges(self.at[s[i]], ns[i]), np.repeat(np.arange(len(i)), ns[i])
            a, i = a[k], i[k]
            # of two blocks only what stands in different ones is compared
            ok = (self.block[a] < 0) | (self.block[b] < 0) | (self.unit[a] != self.unit[b]) | (self.block[a] != self.block[b])
            yield (a[ok], b[ok], *[m[i[ok]] for m in more])
            x = y

    def pairs(self):
        """(a, b) of the texts that share a run, a < b."""
        lane, _, s, _ = self.matches(False)
        q = self.string[lane]
        n = len(self.bounds)
        key = np.unique(np.concatenate([np.minimum(q, s) * n + np.maximum(q, s), self.whole * (n + 1)]))
        for a, b in self._texts(key // n, key % n):
            x, y = self.tid[a], self.tid[b]
            x, y = np.minimum(x, y)[x != y], np.maximum(x, y)[x != y]
            o, new = _different(x, y)
            yield pa.RecordBatch.from_arrays([pa.array(x[o[new]]), pa.array(y[o[new]])], names=["a", "b"])

    def spans(self):
        """(a, b, start_a, start_b, length) of the runs that two texts share, or one of several owners at two places, in parts that touch."""
        lane, p, s, o, lane1, p1, s1, o1 = self.matches(True)
        # on each diagonal of a row and a string first and last places take turns
        last, first = np.lexsort((p, o - p, s, lane)), np.lexsort((p1, o1 - p1, s1, lane1))
        q, s, at, other = self.string[lane[last]], s[last], p1[first], o1[first]
        length = p[last] - at + self.least
        once = q <= s
        whole = self.whole
        cols = [np.concatenate(x) for x in zip((q[once], s[once], at[once], other[once], length[once]), (whole, whole, 0 * whole, 0 * whole, np.diff(self.bounds)[whole]))]
        for a, b, at, other, length in self._texts(*cols):
            x, y = self.tid[a], self.tid[b]
            i, j = self.start[a] + at, self.start[b] + other
            # a run of a string with itself is met from both its places
            ok = np.where(x == y, (self.code[a] == x) & (i != j), True)
            swap = x > y
            out = [np.where(swap, y, x), np.where(swap, x, y), np.where(swap, j, i), np.where(swap, i, j), length]
            out = [np.concatenate([v[ok], w[ok & (x == y)]]) for v, w in zip(out, (x, y, j, i, length))]
            o, new = _different(*out)
            yield pa.RecordBatch.from_arrays([pa.array(v[o[new]].astype(k)) for v, k in zip(out, ("i8", "i8", "i4", "i4", "i4"))], names=["a", "b", "start_a", "start_b", "length"])

    def shared(self):
        """(tid, start, length) of what texts share with texts of another owner, in parts that touch or overlap."""
        n = self.index.n
        count = len(self.bounds) - 1
        # a string of one owner by that owner, any other one by itself
        text = np.repeat(np.arange(count), np.diff(self.at))
        low, high = np.full(count, np.iinfo(np.int64).max), np.full(count, np.iinfo(np.int64).min)
        np.minimum.at(low, text, self.code)
        np.maximum.at(high, text, self.code)
        several = low != high
        owner = np.unique(low, return_inverse=True)[1]
        owner[several] = count + np.flatnonzero(several)
        met = [(w, np.full(len(w), step), lo, hi - lo) for step, lo, hi, w, _ in self.streamed()]
        lane, step, lo, size = (np.concatenate(x) for x in zip(*met)) if met else (np.empty(0, np.int64),) * 4
        q = self.string[lane]
        # of the suffixes that match here, those of the same owner
        _, back, own = np.unique(owner[q] * n + lo, return_inverse=True, return_counts=True)
        other = size > own[back]
        q, p = q[other], (self.end[lane] - step)[other]
        whole = self.whole[several[self.whole]]
        q, p, end = np.concatenate([q, whole]), np.concatenate([p, 0 * whole]), np.concatenate([p + self.least, np.diff(self.bounds)[whole]])
        q, _, p, end = _merged(q, 0 * q, p, end)
        k = self.at[q + 1] - self.at[q]
        a, i = ranges(self.at[q], k), np.repeat(np.arange(len(q)), k)
        yield pa.RecordBatch.from_arrays([pa.array(self.tid[a]), pa.array((self.start[a] + p[i]).astype(np.int32)), pa.array((end - p)[i].astype(np.int32))], names=["tid", "start", "length"])


# ---- the operators


def _records(df: DataFrame, key: str, text: str, least: int, gram: int, who: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(recs, members): the texts of at least `least` characters as (tid, who, text), and (tid, key, size) of their records."""
    if not 0 < gram <= least:
        raise ValueError("gram must be between 1 and least")
    held = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).filter(F.col("key").isNotNull() & (F.length("text") >= least))
    held = held.withColumn("tid", F.xxhash64("text"))
    recs = held.select("tid", (F.col("tid") if who is None else who).alias("who"), "text")
    return recs, held.select("tid", "key", F.length("text").alias("size")).distinct()


def _met(recs: DataFrame, found: Hits, least: int, blocks: bool, give, schema: str) -> DataFrame:
    """What give takes from each shard."""
    placed = _units(found.few)
    if blocks and found.many is not None:
        placed = placed.unionByName(_blocks(found.many, least))
    parts = int(recs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for table in _shards(batches):
            yield from give(Shard(table, least))

    # by number, as little text is much work
    return _stretches(placed, recs, least).repartition(parts, "unit").sortWithinPartitions("unit").mapInArrow(run, schema)


def text_pairs(df: DataFrame, key: str, text: str, least: int = 150, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members is (tid, key, size) of every record long enough, tid standing for its text;
    pairs (a, b), a < b, of the texts that share a run. Copies are one text, and no link is lost."""
    recs, members = _records(df, key, text, least, gram)
    return members, _met(recs, hits(recs, least, gram), least, True, Shard.pairs, "a long, b long").distinct()


def pairs(df: DataFrame, key: str, text: str, least: int = 150, gram: int = GRAM) -> DataFrame:
    """(rec_a, rec_b), rec_a < rec_b: all pairs of records that share a run of at least `least` characters.

    Characters are code points as stored. Rows that repeat a key are one record. Null keys, null
    and shorter texts take no part; an empty table gives no pairs; other columns are ignored. A
    64-bit hash stands for a text.
    """
    members, found = text_pairs(df, key, text, least, gram)
    a, b = (members.select(F.col("tid").alias(x), F.col("key").alias("key_" + x)) for x in "ab")
    across = found.join(a, "a").join(b, "b").select("key_a", "key_b")
    both = across.unionByName(_copies(members).select("key_a", "key_b")).filter("key_a <> key_b")
    return both.select(F.least("key_a", "key_b").alias("rec_a"), F.greatest("key_a", "key_b").alias("rec_b")).distinct()


def _copies(members: DataFrame) -> DataFrame:
    """(key_a, key_b, size), key_a < key_b: records that have the same text."""
    several = members.groupBy("tid").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo < hi").select("tid")
    own = members.join(several, "tid", "left_semi")
    a = own.select("tid", F.col("key").alias("key_a"), "size")
    return a.join(own.select("tid", F.col("key").alias("key_b")), "tid").filter("key_a < key_b").drop("tid")


def spans(df: DataFrame, key: str, text: str, least: int = 150, gram: int = GRAM) -> DataFrame:
    """(rec_a, rec_b, start_a, start_b, length): the longest runs of at least `least` characters that two records share.

    Periodic texts share a run at each shift by their period, and all of these are given. Otherwise
    as pairs().
    """
    recs, members = _records(df, key, text, least, gram, F.xxhash64("key"))
    parts = _met(recs, hits(recs, least, gram), least, True, Shard.spans, "a long, b long, start_a int, start_b int, length int").distinct()
    parts = parts.withColumn("shift", F.col("start_a") - F.col("start_b"))
    runs = merge(parts, ["a", "b", "shift"], "start_a", "length").withColumn("start_b", F.col("start_a") - F.col("shift"))
    a, b = (members.select(F.col("tid").alias(x), F.col("key").alias("key_" + x)) for x in "ab")
    across = runs.join(a, "a").join(b, "b").filter("(a <> b and key_a <> key_b) or (a = b and key_a < key_b)").select("key_a", "key_b", "start_a", "start_b", "length")
    whole = _copies(members).select("key_a", "key_b", F.lit(0).alias("start_a"), F.lit(0).alias("start_b"), F.col("size").alias("length"))
    swap = F.col("key_a") > F.col("key_b")
    names = (("rec_a", "key_a", "key_b"), ("rec_b", "key_b", "key_a"), ("start_a", "start_a", "start_b"), ("start_b", "start_b", "start_a"))
    flat = across.unionByName(whole).select(*[F.when(swap, F.col(y)).otherwise(F.col(x)).alias(n) for n, x, y in names], "length")
    # a key of several texts may have the same run by each of them
    flat = flat.withColumn("shift", F.col("start_a") - F.col("start_b"))
    merged = merge(flat, ["rec_a", "rec_b", "shift"], "start_a", "length")
    return merged.select("rec_a", "rec_b", "start_a", (F.col("start_a") - F.col("shift")).alias("start_b"), "length")


def merge(df: DataFrame, by: list[str], start: str, length: str) -> DataFrame:
    """(by…, start, length): intervals that touch or overlap joined to one."""
    w = Window.partitionBy(*by).orderBy(start)
    end = F.max(F.col(start) + F.col(length)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.select(*by, start, length).withColumn("fresh", F.coalesce((F.col(start) > end).cast("int"), F.lit(1)))
    island = marked.withColumn("island", F.sum("fresh").over(w))
    return island.groupBy(*by, "island").agg(F.min(start).alias("first"), F.max(F.col(start) + F.col(length)).alias("last")).select(*by, F.col("first").alias(start), (F.col("last") - F.col("first")).alias(length))


def coverage(df: DataFrame, key: str, text: str, least: int = 150, gram: int = GRAM) -> DataFrame:
    """(rec, n_chars, n_shared): of each record its characters, and those in runs that another record has too.

    Records that share nothing come out with 0. No two records are paired for this: the intervals
    of the index tell how many places match and how many of them are the record's own.
    """
    recs, members = _records(df, key, text, least, gram, F.xxhash64("key"))
    found = hits(recs, least, gram)
    parts = _met(recs, found, least, False, Shard.shared, "tid long, start int, length int")
    if found.many is not None:
        # runs of very many texts, already known to be shared
        parts = parts.unionByName(found.many.select("tid", F.col("pos").alias("start"), F.lit(least).alias("length")))
    copied = members.groupBy("tid").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo < hi").select("tid")
    by_copy = members.join(copied, "tid", "left_semi").select("key", F.lit(0).alias("start"), F.col("size").alias("length"))
    by_run = members.join(parts, "tid").select("key", "start", "length")
    joined = merge(by_run.unionByName(by_copy), ["key"], "start", "length").groupBy("key").agg(F.sum("length").alias("n"))
    size = df.select(F.col(f"`{key}`").alias("key"), F.length(F.col(f"`{text}`")).alias("k")).filter("key is not null").groupBy("key").agg(F.max("k").alias("k"))
    return size.join(joined, "key", "left").select(F.col("key").alias("rec"), F.coalesce("k", F.lit(0)).cast("long").alias("n_chars"), F.coalesce("n", F.lit(0)).cast("long").alias("n_shared"))
