"""Mapping of free-entered values to a reference list.

The names of the reference entries stand in a BK-tree under the Levenshtein distance, a true
metric: of each node only the children whose distance to it lies within the threshold of the
query's can hold a match, so every entry within the threshold is found and most are never
compared. The tree is broadcast while the list is within MOST_BROADCAST; a longer list is cut
into shards, each with a tree of its own, and the shards' winners are merged. Area names stand in a
tree of the same kind.
"""

from __future__ import annotations

import dataclasses
import re
import unicodedata
import uuid

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Reference rows up to which one tree is broadcast, and of a shard beyond that; characters of them, too.
MOST_BROADCAST, MOST_CHARS = 50_000, 8_000_000
#: Values that one copy of a shard is asked for, about.
ASKED = 20_000
#: Letters of a name for each edit that is allowed, and the most edits.
LETTERS_AN_EDIT, MOST_EDITS = 3, 2


@dataclasses.dataclass(frozen=True)
class Habits:
    """What people write around a name (before it, after it) and short forms of its parts, without accents and in lower case."""

    before: tuple[str, ...] = ()
    after: tuple[str, ...] = ()
    short: tuple[tuple[str, str], ...] = ()


# Habits with place names in French, English and Spanish.
PLACES = Habits(
    before=("ville de", "commune de", "city of", "town of", "ciudad de", "near", "in", "at", "pres de", "cerca de", "a", "en"),
    after=("city", "town", "ville"),
    short=(("st", "saint"), ("ste", "sainte"), ("mt", "mount"), ("s", "sur"), ("pt", "port"), ("sn", "san")),
)

_PART = re.compile(r"\s*[,;/()\[\]|]\s*|\s+[-–—]+\s+")
_WORDS = re.compile(r"[^\W_]+")


def plain(value: str) -> str:
    """Lower case without accents and invisible characters, blanks single."""
    value = "".join(c for c in unicodedata.normalize("NFKD", value) if unicodedata.category(c) not in ("Mn", "Cf"))
    return " ".join(value.casefold().split())


def key(name: str, habits: Habits = PLACES) -> str:
    """The letters of a name, its short forms spelled out."""
    words = _WORDS.findall(plain(name))
    short = dict(habits.short)
    return "".join(short.get(w, w) if len(words) > 1 else w for w in words)


def levenshtein(a: str, b: str) -> int:
    """The edit distance, by bit-parallel columns over the whole of a."""
    if not a or not b:
        return len(a) + len(b)
    peq: dict[str, int] = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | 1 << i
    return _distance(peq, len(a), b)


def _distance(peq: dict[str, int], m: int, b: str) -> int:
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    for c in b:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & mask | 1
        mh = mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
    return score


class Tree:
    """BK-tree of keys; each key keeps its entries."""

    def __init__(self, names: list[tuple[str, object]]):
        self.keys: list[str] = []
        self.entries: list[list[object]] = []
        self.children: list[dict[int, int]] = []
        at: dict[str, int] = {}
        for k, entry in names:
            if k in at:
                self.entries[at[k]].append(entry)
                continue
            at[k] = len(self.keys)
            self.keys.append(k)
            self.entries.append([entry])
            self.children.append({})
            node = 0
            while node != at[k]:
                d = levenshtein(k, self.keys[node])
                node = self.children[node].setdefault(d, at[k])

    def within(self, query: str, radius: int) -> list[tuple[int, object]]:
        """(distance, entry) of every entry whose key is within radius of query."""
        return [(d, e) for d, e, _ in self.near(query, radius)]

    def near(self, query: str, radius: int) -> list[tuple[int, object, str]]:
        """(distance, entry, key) of every entry whose key is within radius of query."""
        if not self.keys or not query:
            return []
        peq: dict[str, int] = {}
        for i, c in enumerate(query):
            peq[c] = peq.get(c, 0) | 1 << i
        found, stack = [], [0]
        while stack:
            node = stack.pop()
            d = _distance(peq, len(query), self.keys[node]) if self.keys[node] else len(query)
            if d <= radius:
                found += [(d, e, self.keys[node]) for e in self.entries[node]]
            stack += [child for far, child in self.children[node].items() if d - radius <= far <= d + radius]
        return found


def readings(value: str, habits: Habits = PLACES) -> tuple[list[str], list[str]]:
    """(names, other parts) that a typed value may hold, as keys: its parts without house numbers
    and the words people write around a name; the parts between commas, slashes, brackets or dashes."""
    parts = [p for p in _PART.split(plain(value).replace("s/", "sur ")) if p]
    names = []
    for p in parts:
        words = _WORDS.findall(p)
        while words and words[0].isdigit():
            words = words[1:]
        names.append(words)
        text = " ".join(words)
        for b in habits.before:
            if text.startswith(b + " "):
                names.append(words[len(b.split()) :])
        for base in list(names[-2:]):
            if len(base) > 1 and base[-1] in habits.after:
                names.append(base[:-1])
    keys = dict.fromkeys(key(" ".join(w), habits) for w in names if w)
    return [k for k in keys if k], [k for p in parts if (k := key(p, habits))]


class Reference:
    """The names of reference entries in one tree, and their areas in another."""

    def __init__(self, rows: list[tuple], habits: Habits = PLACES):
        """rows are (entry, name, area, other names); an entry may stand in several rows and keeps the names of all."""
        names, areas = [], []
        for e, n, a, other in sorted(rows, key=lambda r: tuple(map(str, r))):
            names += [(k, (e, 0)) for k in [key(n or "", habits)] if k]
            names += [(k, (e, 1)) for x in (other if other is not None else []) if x and (k := key(x, habits))]
            areas += [(k, e) for k in [key(a or "", habits)] if k]
        self.names, self.areas, self.habits = Tree(names), Tree(areas), habits

    def foremost(self, value: str) -> tuple[object, list[int]] | None:
        """(entry, place) of the entry that comes first for value, None for several in one place; None if none is near.

        A place is (distance, area not named, names held, negative, another name), and depends on
        nothing but the entry; so the first of several lists is the first of their firsts.
        """
        names, parts = readings(value, self.habits)
        found: dict[object, tuple[int, int]] = {}
        held: dict[object, set] = {}
        for k in names:
            for d, (entry, other) in self.names.within(k, _radius(k)):
                found[entry] = min(found.get(entry, (99, 1)), (d, other))
                held.setdefault(entry, set()).add(other)
        if not found:
            return None
        # the allowed edits of an area are those of its own length
        said = {e for p in parts for d, e, a in self.areas.near(p, MOST_EDITS) if d <= _radius(a)}
        places = {e: [d, int(e not in said), -len(held[e]), other] for e, (d, other) in found.items()}
        first = min(places.values())
        left = [e for e, p in places.items() if p == first]
        return left[0] if len(left) == 1 else None, first

    def best(self, value: str) -> tuple[object, int] | None:
        """(entry, distance) that value means, or None.

        The nearest name wins; among entries at the same distance one whose area the value names,
        then one of which it holds several names, then one whose main name (not another name) it
        is. Where several are still left, the value doesn't say which is meant: None.
        """
        got = self.foremost(value)
        return (got[0], got[1][0]) if got and got[0] is not None else None


def _radius(k: str) -> int:
    return min(MOST_EDITS, len(k) // LETTERS_AN_EDIT)


#: The reference a worker built last, by the name of its broadcast.
_built: dict[str, Reference] = {}


def _reference(called: str, held, habits: Habits) -> Reference:
    """The reference of a broadcast, built once a worker."""
    if called not in _built:
        _built.clear()
        _built[called] = Reference(held.value, habits)
    return _built[called]


def canonical(df: DataFrame, value: str, reference: DataFrame, entry: str, name: str, area: str | None = None, other_names: str | None = None, habits: Habits = PLACES) -> DataFrame:
    """(value, entry, distance): each distinct value with the reference entry it means.

    entry is null where none is meant or where several are and the value doesn't tell them apart.
    Null and blank values are left out. Values are made distinct before any of them is compared,
    so how often a value stands costs nothing, and spread over the tasks. reference may repeat rows
    or hold null names; an entry of several rows has all their names and areas. The names of a
    reference of up to MOST_BROADCAST rows are sent to every worker as one tree; a longer one is
    cut into shards of that size by a hash of the entry, values meet each shard once, in parts of
    about ASKED, and the shards' winners are compared by what decides within one. The result is
    the same. habits says what is written around names; with Habits() nothing is.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = df.select(F.col(f"`{value}`").alias("v")).filter(F.trim(F.regexp_replace("v", r"(?U)\s+", " ")) != "").distinct().repartition(n, "v")
    cols = [F.col(f"`{entry}`").alias("e"), F.col(f"`{name}`").alias("n")]
    cols.append((F.col(f"`{area}`") if area else F.lit(None).cast("string")).alias("a"))
    cols.append((F.col(f"`{other_names}`") if other_names else F.array().cast("array<string>")).alias("o"))
    ref = reference.select(*cols).filter("e is not null").distinct()
    kind = reference.schema[entry].dataType
    size, chars = ref.agg(F.count("*"), F.coalesce(F.sum(F.length(F.concat_ws(" ", "n", "a", F.array_join("o", " ")))), F.lit(0))).first()
    out = T.StructType([T.StructField("v", T.StringType()), T.StructField("e", kind), T.StructField("distance", T.IntegerType())])
    if size <= MOST_BROADCAST and chars <= MOST_CHARS:
        held, called = spark.sparkContext.broadcast([tuple(r) for r in ref.collect()]), uuid.uuid4().hex

        def run(frames):
            of = _reference(called, held, habits)
            for f in frames:
                got = [of.best(v) for v in f["v"]]
                yield pd.DataFrame({"v": f["v"], "e": pd.array([g and g[0] for g in got], dtype=object), "distance": pd.array([None if g is None else g[1] for g in got], dtype="Int32")})

        return values.mapInPandas(run, out).select(F.col("v").alias(value), F.col("e").alias(entry), "distance")
    parts = max(int(size // MOST_BROADCAST), int(chars // MOST_CHARS)) + 1
    blocks = values.count() // ASKED + 1
    shards = ref.withColumn("shard", F.pmod(F.xxhash64("e"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = values.withColumn("block", F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def meet(_, left, right):
        of = Reference(list(right[["e", "n", "a", "o"]].itertuples(index=False, name=None)), habits)
        met = [(v, g) for v in left["v"] if (g := of.foremost(v))]
        columns = [v for v, _ in met], [g[0] for _, g in met], [g[1] for _, g in met]
        return pd.DataFrame({c: pd.Series(x, dtype=object) for c, x in zip(("v", "e", "place"), columns)})

    by = ("shard", "block")
    won = asked.groupBy(*by).cogroup(shards.groupBy(*by)).applyInPandas(meet, T.StructType([*out.fields[:2], T.StructField("place", T.ArrayType(T.IntegerType()))]))
    tied = won.withColumn("nth", F.rank().over(Window.partitionBy("v").orderBy("place"))).filter("nth = 1")
    # a shard's null stands for several entries
    merged = tied.groupBy("v").agg(F.count("*").alias("k"), F.min("e").alias("e"), F.min(F.col("place")[0]).alias("distance"))
    one = merged.filter("k = 1 and e is not null").select("v", "e", "distance")
    return values.join(one, "v", "left").select(F.col("v").alias(value), F.col("e").alias(entry), "distance")
