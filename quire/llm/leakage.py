"""Held-out test items that leaked into a corpus.

The test items are an inverted index with BM25 impacts of their terms, cut into blocks with the
largest impact of each term in a block; terms are sequences of three words, as single words of a
template language tell little apart. Every run of `least` words of a corpus text is a query. Three
bounds are taken for all queries of a batch at once, each only where the one before leaves the
threshold in reach: the largest impacts over all items, the block maxima, the items' own impacts.
The threshold of an item is the least score that a run of `least` of its own words has, so no leak
is lost; what passes is verified word by word.

Few items are one broadcast index. More are cut into shards, and the corpus is still read once: a
bitmap of the items' terms, of bounded size, leaves only the passages whose terms all stand in some
item; each of these meets the shards of its runs' key terms, whose items have those key terms too.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.codepoints import ranges, text_array
from quire.session import materialize

#: Words in a row that a document and an item must share.
LEAST = 12
#: Words of an index term.
GRAM = 3
#: Items of a block of the index, at least, and blocks of an index, at most.
BLOCK, BLOCKS = 16, 32
#: Queries whose block bounds are held at once.
AT_ONCE = 1 << 15
#: Items and characters of them up to which one index is broadcast, and items of a shard beyond.
INDEXED, INDEXED_CHARS = 5_000, 8_000_000
#: Bits of the bitmap of the items' terms, at most, as a power of two.
BITMAP = 26
#: Items of a key term from which its runs go by all their words.
HOT = 1_000
#: Passages that one copy of a shard is asked for, about.
ASKED = 20_000
#: Distinct words a worker remembers.
REMEMBERED = 500_000
K1, B = 1.2, 0.75

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters or digits, without case and accents."""
    if not text:
        return []
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return _WORD.findall(text.casefold())


class Index:
    """BM25 index of the items with block maxima; impacts are scaled to a threshold of 1."""

    def __init__(self, items: list[tuple[int, str | None]], least: int = LEAST, block: int = BLOCK):
        self.least = least
        said = {}
        for key, text in items:
            w = words(text)
            if len(w) >= least:
                said.setdefault(key, []).append(w)
        # an id with several texts is several items of the index
        rows = sorted((w, k) for k, ws in said.items() for w in ws)
        self.items = [k for _, k in rows]
        self.number = {w: i for i, w in enumerate(sorted({w for ws, _ in rows for w in ws}))}
        self.texts = [np.array([self.number[w] for w in ws], np.int32) for ws, _ in rows]
        n = len(rows)
        self.empty = n == 0
        if self.empty:
            return
        self.gram = min(GRAM, least)
        self.unknown_word = len(self.number)
        self.gram_key = np.unique(np.concatenate([self.keys(x) for x in self.texts]))
        v = self.unknown = len(self.gram_key)
        grams = [self.terms(x) for x in self.texts]
        df = np.zeros(v)
        for x in grams:
            df[np.unique(x)] += 1
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        mean = sum(map(len, grams)) / n
        m = self.span = least - self.gram + 1
        post_word, post_item, post_value = [], [], []
        for i, x in enumerate(grams):
            w, tf = np.unique(x, return_counts=True)
            value = idf[w] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(x) / mean))
            at = np.zeros(v)
            at[w] = value
            run = np.concatenate([[0.0], np.cumsum(at[x])])
            least_score = (run[m:] - run[:-m]).min()
            post_word.append(w)
            post_item.append(np.full(len(w), i))
            post_value.append(value / max(least_score, 1e-12))
        w, i, value = map(np.concatenate, (post_word, post_item, post_value))
        self.block_of = np.arange(n) // max(block, -(-n // BLOCKS))
        self.blocks = int(self.block_of[-1]) + 1
        order = np.lexsort((i, w))
        # postings by term: item numbers and impacts
        self.post_item, self.post_value = i[order], value[order]
        self.post_at = np.searchsorted(w[order], np.arange(v + 1))
        # the last row is the term that no item has
        self.block_max = np.zeros((v + 1, self.blocks), np.float32)
        np.maximum.at(self.block_max, (w, self.block_of[i]), value.astype(np.float32) * np.float32(1 + 1e-6))
        self.term_max = self.block_max.max(axis=1).astype(np.float64)
        # verification: the runs of each item, by hash
        self.mix = np.random.default_rng(7).integers(1, 1 << 62, least, dtype=np.uint64) | np.uint64(1)
        hashes = [self.runs(x) for x in self.texts]
        owner = np.repeat(np.arange(n), [len(h) for h in hashes])
        begin = np.concatenate([np.arange(len(h)) for h in hashes])
        h = np.concatenate(hashes)
        o = np.argsort(h, kind="stable")
        self.run_hash, self.run_item, self.run_at = h[o], owner[o], begin[o]
        self.flat = np.concatenate(self.texts)
        self.text_at = np.cumsum([0, *map(len, self.texts)])

    def keys(self, x: np.ndarray) -> np.ndarray:
        """The term that begins at each word, as one number; -1 where a word is unknown."""
        x = x.astype(np.int64)
        n = max(0, len(x) - self.gram + 1)
        key = np.zeros(n, np.int64)
        for k in range(self.gram):
            key = key * (self.unknown_word + 1) + x[k : k + n]
        for k in range(self.gram):
            key[x[k : k + n] == self.unknown_word] = -1
        return key

    def terms(self, x: np.ndarray) -> np.ndarray:
        key = self.keys(x)
        out = np.full(len(key), self.unknown, np.int64)
        some = np.flatnonzero(key >= 0)
        at = np.minimum(np.searchsorted(self.gram_key, key[some]), self.unknown - 1)
        hit = self.gram_key[at] == key[some]
        out[some[hit]] = at[hit]
        return out

    def runs(self, x: np.ndarray) -> np.ndarray:
        """A hash of each run of `least` words."""
        y = x.astype(np.uint64) + np.uint64(1)
        out = np.zeros(max(0, len(y) - self.least + 1), np.uint64)
        for k in range(self.least):
            out += y[k : k + len(out)] * self.mix[k]
        return out

    def candidates(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query start, item) of every query whose score reaches the item's threshold."""
        m, x = self.span, self.terms(x)
        total = np.zeros(len(x) + 1)
        np.cumsum(self.term_max[x], out=total[1:])
        starts = starts[total[starts + m] - total[starts] >= 1 - 1e-6]
        got_q, got_i = [], []
        for at in range(0, len(starts), AT_ONCE):
            s = starts[at : at + AT_ONCE]
            bound = np.zeros((len(s), self.blocks), np.float32)
            for k in range(m):
                bound += self.block_max[x[s + k]]
            q, b = np.nonzero(bound >= 1 - 1e-4)
            if not len(q):
                continue
            # exact scores of the items of the open blocks
            span = self.post_at
            open_ = np.zeros((len(s), self.blocks), bool)
            open_[q, b] = True
            u, inverse = np.unique(q, return_inverse=True)
            del inverse
            terms = x[s[u][:, None] + np.arange(m)].ravel()
            which = np.repeat(u, m)
            known = terms != self.unknown
            terms, which = terms[known], which[known]
            size = span[terms + 1] - span[terms]
            p = ranges(span[terms], size)
            qq = np.repeat(which, size)
            ii = self.post_item[p]
            keep = open_[qq, self.block_of[ii]]
            key = qq[keep] * len(self.texts) + ii[keep]
            pair, back = np.unique(key, return_inverse=True)
            score = np.bincount(back, self.post_value[p][keep])
            pair = pair[score >= 1 - 1e-6]
            got_q.append(s[pair // len(self.texts)])
            got_i.append(pair % len(self.texts))
        if not got_q:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(got_q), np.concatenate(got_i)

    def verified(self, x: np.ndarray, q: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Which candidates hold: the query's words stand in the item in the same order."""
        ok = np.zeros(len(q), bool)
        h = np.zeros(len(q), np.uint64)
        for k in range(self.least):
            h += (x[q + k].astype(np.uint64) + np.uint64(1)) * self.mix[k]
        lo, hi = np.searchsorted(self.run_hash, h), np.searchsorted(self.run_hash, h, side="right")
        c = np.repeat(np.arange(len(q)), hi - lo)
        r = ranges(lo, hi - lo)
        same = self.run_item[r] == i[c]
        c, r = c[same], r[same]
        at = self.text_at[self.run_item[r]] + self.run_at[r]
        equal = np.ones(len(c), bool)
        for k in range(self.least):
            equal &= self.flat[at + k] == x[q[c] + k]
        ok[c[equal]] = True
        return ok

    def hits(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, item number, first word) of every shared run, in order; texts are lists of words."""
        none = np.empty(0, np.int64)
        if self.empty:
            return none, none, none
        get, unknown = self.number.get, self.unknown_word
        size = np.array([len(t) for t in texts], np.int64)
        bounds = np.concatenate([[0], np.cumsum(size)])
        x = np.array([get(w, unknown) for t in texts for w in t], np.int64)
        runs = np.maximum(size - self.least + 1, 0)
        starts = ranges(bounds[:-1], runs)
        q, i = self.candidates(x, starts)
        ok = self.verified(x, q, i)
        q, i = q[ok], i[ok]
        row = np.searchsorted(bounds, q, side="right") - 1
        order = np.lexsort((q, i, row))
        return row[order], i[order], (q - bounds[row])[order]

    def search(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, item number, words shared) of every leak; a text and an item come once."""
        row, i, q = self.hits([words(t) for t in texts])
        new = np.ones(len(q), bool)
        new[1:] = (row[1:] != row[:-1]) | (i[1:] != i[:-1])
        step = np.where(new, self.least, np.minimum(np.diff(q, prepend=0), self.least))
        group = np.cumsum(new) - 1
        return row[new], i[new], np.bincount(group, step, int(new.sum())).astype(np.int64)


class Terms:
    """Hashes of the terms and runs of lists of words; they only say what meets where."""

    def __init__(self, least: int):
        self.least, self.gram, self.seen = least, min(GRAM, least), {}

    def __call__(self, w: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(term from each word on, key term of each run: the smallest, all words of each run)."""
        if len(self.seen) > REMEMBERED:
            self.seen = {}
        seen = self.seen
        for x in set(w):
            if x not in seen:
                seen[x] = xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"))
        h = np.array([seen[x] for x in w], np.uint64)
        term = self._mixed(h, self.gram)
        run = self._mixed(h, self.least)
        key = term[: len(run)].copy()
        for k in range(1, self.least - self.gram + 1):
            np.minimum(key, term[k : k + len(run)], out=key)
        return term, key, run

    @staticmethod
    def _mixed(h: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(max(0, len(h) - n + 1), np.uint64)
        for k in range(n):
            out = (out ^ h[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out


def leaks(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: int = LEAST) -> DataFrame:
    """(key, item, n_words): each corpus row with each item that it shares `least` words in a row with.

    Words are runs of letters or digits without case and accents. n_words counts the words of the
    row that lie in such shared runs. Null and empty texts and items of fewer words hold no leak;
    equal rows come out once; ties and other columns change nothing. Up to INDEXED items of
    INDEXED_CHARS characters are one broadcast index; any number beyond is searched for in shards.
    The corpus is read once either way, and the result is the same.
    """
    asked = items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{item_text}`").alias("said")).filter("item is not null and length(said) > 0").distinct()
    n, chars = asked.agg(F.count("*"), F.coalesce(F.sum(F.length("said")), F.lit(0))).first()
    source = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    search = _broadcast if n <= INDEXED and chars <= INDEXED_CHARS else _sharded
    return search(source, asked, least).select(F.col("key").alias(key), F.col("item").alias(item), "n_words").distinct()


def _broadcast(source: DataFrame, asked: DataFrame, least: int) -> DataFrame:
    """(key, item, n_words) by one index of all items."""
    rows = sorted(((r[0], r[1]) for r in asked.collect()), key=lambda r: str(r[0]))
    shared = source.sparkSession.sparkContext.broadcast(Index(rows, least))
    schema = T.StructType([T.StructField("key", source.schema["key"].dataType), T.StructField("item", asked.schema["item"].dataType), T.StructField("n_words", T.LongType())])
    kind = _arrow(schema)[1]

    def run(batches):
        index = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                row, i, n = index.search(text_array(part.column(1)).to_pylist())
                if len(row):
                    ids = pa.array([index.items[k] for k in i.tolist()], kind)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), ids, pa.array(n)], names=schema.names)

    return source.mapInArrow(run, schema)


def _item_terms(held: DataFrame, least: int) -> DataFrame:
    """(iid, term, runs): the key terms of each item, and the runs of each."""

    def run(batches):
        terms = Terms(least)
        for b in batches:
            iids, keys, runs = [], [], []
            for iid, said in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                _, key, run = terms(words(said))
                for k in np.unique(key):
                    iids.append(iid)
                    keys.append(int(k.view(np.int64)))
                    runs.append(np.unique(run[key == k]).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(iids, pa.int64()), pa.array(keys, pa.int64()), pa.array(runs, pa.list_(pa.int64()))], names=["iid", "term", "runs"])

    return held.select("iid", "said").mapInArrow(run, "iid long, term long, runs array<long>")


def _bitmap(held: DataFrame, least: int, bits: int) -> np.ndarray:
    """Which of 2**bits slots the items' terms fall into."""

    def run(batches):
        terms, on = Terms(least), np.zeros(1 << bits, bool)
        for b in batches:
            for said in b.column(0).to_pylist():
                on[(terms(words(said))[0] >> np.uint64(64 - bits)).astype(np.int64)] = True
        packed = np.packbits(on, bitorder="little").view(np.int64)
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(packed[at])], names=["at", "word"])

    rows = held.select("said").mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    words_ = np.zeros(max(1, (1 << bits) // 64), np.int64)
    words_[rows.column("at").to_numpy()] = rows.column("word").to_numpy()
    return words_.view(np.uint64)


def _sharded(source: DataFrame, asked: DataFrame, least: int) -> DataFrame:
    """(key, item, n_words) by shards of the items."""
    spark = source.sparkSession
    held = materialize(asked.withColumn("iid", F.xxhash64("item", "said")))
    terms = materialize(_item_terms(held, least))
    n_terms = terms.count()
    # bounded by the rows over HOT
    often = [r["term"] for r in terms.groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("term").collect()]
    hot = np.sort(np.array(often, np.int64))
    bits = int(np.clip(np.ceil(np.log2(max(1, n_terms) * 64)), 16, BITMAP))
    known = spark.sparkContext.broadcast((_bitmap(held, least, bits), hot))
    parts = n_terms // INDEXED + 1
    # a run goes by its key term, or by all its words where too many items have that term
    route = F.explode(F.when(F.col("term").isin(often) if often else F.lit(False), F.col("runs")).otherwise(F.array("term")))
    placed = terms.select("iid", route.alias("route")).select("iid", F.pmod("route", F.lit(parts)).cast("int").alias("part")).distinct()
    schema = T.StructType([T.StructField("part", T.IntegerType()), source.schema["key"], T.StructField("text_id", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("words", T.ArrayType(T.StringType()))])

    def passages(batches):
        of, (on, hot) = Terms(least), known.value
        for b in batches:
            rows, out = [], [[], [], [], []]
            for r, text in enumerate(text_array(b.column(1)).to_pylist()):
                w = words(text)
                if len(w) < least:
                    continue
                term, key, run = of(w)
                slot = term >> np.uint64(64 - bits)
                here = on[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)
                total = np.concatenate([[0], np.cumsum(here, dtype=np.int64)])
                span = least - of.gram + 1
                good = total[span:] - total[:-span] == span
                edge = np.flatnonzero(np.diff(np.concatenate([[0], good[: len(run)].astype(np.int8), [0]])))
                for a, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    k = key[a:e].view(np.int64)
                    place = np.searchsorted(hot, k)
                    is_hot = hot[np.minimum(place, len(hot) - 1)] == k if len(hot) else np.zeros(len(k), bool)
                    go = np.where(is_hot, run[a:e].view(np.int64), k)
                    for p in np.unique(go % parts).tolist():
                        rows.append(r)
                        for col, v in zip(out, (p, xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63), a, w[a : e + least - 1])):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), b.column(0).take(pa.array(rows, pa.int64())), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.list_(pa.string()))], names=schema.names)

    found = materialize(source.mapInArrow(passages, schema))
    # a shard that is asked for very often is held by several tasks
    copies = found.groupBy("part").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("copies"))
    copies = materialize(copies)
    of_items = placed.join(copies, "part").join(held, "iid").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    of_items = of_items.select("part", "copy", F.lit(0).alias("kind"), "item", "said", F.lit(None).cast(source.schema["key"].dataType).alias("key"), F.lit(None).cast("long").alias("text_id"), F.lit(0).alias("first"), F.array().cast("array<string>").alias("words"))
    of_texts = found.join(copies, "part").select("part", F.pmod(F.xxhash64("text_id", "first", "key"), F.col("copies")).cast("int").alias("copy"), F.lit(1).alias("kind"), F.lit(None).cast(asked.schema["item"].dataType).alias("item"), F.lit(None).cast("string").alias("said"), "key", "text_id", "first", "words")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = of_items.unionByName(of_texts).repartition(n, "part", "copy").sortWithinPartitions("part", "copy", "kind")
    result = T.StructType([source.schema["key"], T.StructField("text_id", T.LongType()), T.StructField("item", asked.schema["item"].dataType), T.StructField("first", T.IntegerType())])
    kind = _arrow(result)[2]

    def search(batches):
        group, rows, index = None, [], None
        for b in batches:
            at = np.stack([b.column(i).to_numpy() for i in (0, 1, 2)])
            cut = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1
            for x, y in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows]):
                part = b.slice(x, y - x)
                if (at[0, x], at[1, x]) != group:
                    group, rows, index = (at[0, x], at[1, x]), [], None
                if at[2, x] == 0:
                    rows += list(zip(part.column(3).to_pylist(), part.column(4).to_pylist()))
                    continue
                if index is None:
                    index = Index(sorted(rows, key=lambda r: str(r[0])), least)
                row, i, q = index.hits(part.column(8).to_pylist())
                take = pa.array(row)
                first = part.column(7).to_numpy()[row] + q
                yield pa.RecordBatch.from_arrays([part.column(5).take(take), part.column(6).take(take), pa.array([index.items[k] for k in i.tolist()], kind), pa.array(first.astype(np.int32))], names=result.names)

    runs = both.mapInArrow(search, result).groupBy("key", "text_id", "item").agg(F.array_sort(F.collect_set("first")).alias("at"))
    # the words of runs that overlap count once
    gaps = F.zip_with(F.slice("at", F.lit(2), F.size("at")), F.slice("at", F.lit(1), F.size("at") - 1), lambda a, b: F.least(a - b, F.lit(least)).cast("long"))
    return runs.select("key", "item", (F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x) + least).alias("n_words"))


def _arrow(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema.fields]
