"""Near-duplicate records with small edits, by an exact token-group matrix.

Records are sets of word sequences. Copies with the same set are one record. Similar records are
partitioned into groups of bounded size; the matrix has, of each token, the groups whose members
are looked up by it. Of a pair the smaller record asks: by its rarest tokens, of which it shares
several with every record it is similar enough to. A group that it meets so is opened if the
overlap with the union of its members' tokens can reach what the threshold asks for, and its
members are compared. Nothing is approximate: no pair at or above the threshold is lost.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.codepoints import ranges, text_array
from quire.session import materialize

#: Members of a group, about.
GROUP = 64
#: Part of a set's tokens that are looked up beyond the least, so that several must be shared.
SEVERAL = 0.05
#: Records that one copy of a group is compared with, about, and tokens that are compared at once.
ASKED, AT_ONCE = 4_000, 3_000_000
#: Bits of a token's hash that stand below its frequency.
HELD = 57
#: Distinct words whose hashes a worker remembers.
REMEMBERED = 500_000

_WORD = re.compile(r"[^\W_]+")


class _Hashes(dict):
    """The hash of each word, made when it is first asked for."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


class Shingles:
    """Sorted distinct 64-bit hashes of the word sequences of a text."""

    def __init__(self, words: int):
        self.words, self.seen = words, _Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        w = _WORD.findall(text.lower()) if text else []
        if len(w) < self.words:
            return np.empty(0, np.int64)
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        h = np.fromiter(map(self.seen.__getitem__, w), np.uint64, len(w))
        out = np.zeros(len(h) - self.words + 1, np.uint64)
        for k in range(self.words):
            out = (out ^ h[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(out).view(np.int64)


def shingles(df: DataFrame, key: str, text: str, words: int = 5) -> DataFrame:
    """(id, rep, n, tokens): of each row the n sorted distinct hashes of its sequences of `words` words, and a hash of them all.

    Words are runs of letters or digits in lower case. Texts of fewer words, null and empty ones
    give no row. Rows that repeat a key come out as they are.
    """
    source = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).filter("id is not null and length(text) > 0")
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("tokens", T.ArrayType(T.LongType(), False))])

    def run(batches):
        make = Shingles(words)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                sets = [make(t) for t in text_array(part.column(1)).to_pylist()]
                keep = pa.array([len(s) > 0 for s in sets])
                bounds = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                made = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([*sets, np.empty(0, np.int64)])))
                yield pa.RecordBatch.from_arrays([part.column(0), made], names=["id", "tokens"]).filter(keep)

    return source.mapInArrow(run, schema).select("id", F.xxhash64("tokens").alias("rep"), F.size("tokens").alias("n"), "tokens")


def classes(sets: DataFrame) -> DataFrame:
    """(id, rep) of every record: rep, a 64-bit hash of its token set, stands for all records with that set.

    Groups of copies may be of any size: nothing of them is gathered.
    """
    return sets.select("id", "rep").distinct()


def _least(n, threshold: float):
    """The least overlap of a set of n tokens with one that is similar enough."""
    return F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("int")


def _least_of_smaller(n, threshold: float):
    """The least overlap of a set of n tokens with one that is similar enough and not smaller."""
    return F.ceil(n * F.lit(2 * threshold / (1 + threshold)) - F.lit(1e-9)).cast("int")


def _several(n):
    """Lookup tokens that two similar sets share at least, by the size of the smaller one."""
    return F.greatest(F.lit(1), F.floor(n * F.lit(SEVERAL)).cast("int"))


def _lookup(need):
    """The tokens by which a set that must share `need` of its tokens s is looked up.

    Of its tokens in order of their frequency the last need - k are passed over: the k rarest
    tokens that two similar sets share are never among these, on either side.
    """
    return F.slice("s", F.lit(1), F.greatest(F.size("s") - need + _several(F.col("n")), F.lit(0)))


def shared_tokens(sets: DataFrame, threshold: float) -> DataFrame:
    """(rep, n, s): of each distinct set the tokens that stand in another set too, the rarest first.

    Sets in which these are fewer than any partner must share have no partner and are left out. So
    tokens that stand all over the corpus are hardly looked up. In s a token is one number: the
    logarithm of its frequency and below it HELD bits of its hash, so numbers are in order of frequency.
    """
    each = sets.select("rep", F.explode("tokens").alias("t"))
    df = each.groupBy("t").agg(F.count("*").alias("df")).filter("df > 1")
    number = F.shiftleft(F.floor(F.log2("df")), HELD) + F.shiftrightunsigned("t", 64 - HELD)
    # counts are unique and spread evenly, so a partition of them fits a hash table; tokens need no sort
    held = each.join(df.hint("shuffle_hash"), "t").groupBy("rep").agg(F.collect_list(number).alias("s"))
    held = held.join(sets.select("rep", "n"), "rep").filter(F.size("s") >= _least(F.col("n"), threshold))
    return held.select("rep", "n", F.sort_array("s").alias("s"))


def similar(sets: DataFrame, threshold: float = 0.8, group: int = GROUP) -> DataFrame:
    """(a, b, overlap, similarity), a < b: all pairs of distinct token sets with a Jaccard similarity of at least threshold.

    sets is (rep, n, tokens), each set once.
    """
    n, spark = F.col("n"), sets.sparkSession
    held = materialize(shared_tokens(sets, threshold))
    # groups: the same least lookup token and about the same size, split to about `group` members
    by, most = _lookup(_least(n, threshold)), _lookup(_least_of_smaller(n, threshold))
    seed = F.array_min(F.transform(by, lambda t: t.bitwiseAND(F.lit((1 << HELD) - 1))))
    seeds = held.select("rep", seed.alias("seed"), F.floor(F.log("n") / F.log(F.lit(1 / threshold))).alias("band"))
    size = seeds.groupBy("seed", "band").agg(F.count("*").alias("k"))
    gid = F.xxhash64("seed", "band", F.pmod(F.xxhash64("rep"), F.ceil(F.col("k") / group)))
    member = materialize(held.join(seeds.join(size, ["seed", "band"]).select("rep", gid.alias("gid")), "rep").select("rep", "n", "s", "gid"))
    matrix = member.select("gid", "n", F.explode(by).alias("t")).groupBy("t", "gid").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    asks = F.size("s") >= _least_of_smaller(n, threshold)
    asked = member.filter(asks).select("rep", "n", F.explode(most).alias("t"))
    # the smaller one of a pair asks, so members are as large as it or larger, within the threshold
    near = (F.col("hi") >= n) & (F.col("lo") * F.lit(threshold) <= n + F.lit(1e-9))
    met = asked.join(matrix, "t").filter(near).groupBy("rep", "n", "gid").agg(F.count("*").alias("k"))
    met = materialize(met.filter(F.col("k") >= _several(n)).select("rep", "gid"))
    # a group that very many records meet is compared in several tasks
    copies = materialize(met.groupBy("gid").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("copies")))
    cols = ("gid", "copy", "kind", "rep", "n", "s")
    of = member.join(copies, "gid").select("gid", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind"), "rep", "n", "s")
    ask = met.join(copies, "gid").join(member.select("rep", "n", "s"), "rep").select("gid", F.pmod(F.xxhash64("rep"), F.col("copies")).cast("int").alias("copy"), F.lit(1).alias("kind"), "rep", "n", "s")
    both = of.select(*cols).unionByName(ask.select(*cols)).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "gid", "copy").sortWithinPartitions("gid", "copy", "kind")

    def run(batches):
        for t in _whole_groups(batches):
            yield _compared(t, threshold)

    found = both.mapInArrow(run, "a long, b long, na int, nb int, overlap int")
    return found.select("a", "b", "overlap", (F.col("overlap") / (F.col("na") + F.col("nb") - F.col("overlap"))).alias("similarity"))


def _whole_groups(batches):
    """Tables of whole copies of groups, about AT_ONCE tokens each."""
    held, size, last = [], 0, None
    for b in batches:
        if not b.num_rows:
            continue
        gid, copy = b.column(0).to_numpy(), b.column(1).to_numpy()
        length = np.append(0, np.cumsum(np.diff(b.column(5).offsets.to_numpy())))
        cuts = [0, *(np.flatnonzero((gid[1:] != gid[:-1]) | (copy[1:] != copy[:-1])) + 1).tolist(), b.num_rows]
        begin = 0
        for x, y in zip(cuts, cuts[1:]):
            if size + length[x] - length[begin] > AT_ONCE and (gid[x], copy[x]) != last:
                held.append(b.slice(begin, x - begin))
                yield pa.Table.from_batches(held).combine_chunks()
                held, size, begin = [], 0, x
            last = (gid[x], copy[x])
        held.append(b.slice(begin))
        size += length[-1] - length[begin]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _compared(t: pa.Table, threshold: float) -> pa.RecordBatch:
    """The similar pairs of the records (kind 1) and the members (kind 0) of each group."""
    col = lambda i: t.column(i).to_numpy()
    gid, copy, kind, rep, n = (col(i) for i in range(5))
    lists = t.column(5).chunk(0)
    at = lists.offsets.to_numpy()
    token = lists.values.to_numpy()[at[0] : at[-1]].view(np.uint64)
    size = np.diff(at)
    row = np.repeat(np.arange(len(rep)), size)
    new = np.ones(len(gid), bool)
    new[1:] = (gid[1:] != gid[:-1]) | (copy[1:] != copy[:-1])
    group = np.cumsum(new).astype(np.uint64)
    # a token in a group
    token = (token ^ (group[row] * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)
    token ^= token >> np.uint64(32)
    is_member = kind[row] == 0
    order = np.argsort(token[is_member], kind="stable")
    held, owner = token[is_member][order], row[is_member][order]
    # the unions of the groups' tokens, and the members that have each
    first = np.flatnonzero(np.append(True, held[1:] != held[:-1])) if len(held) else np.empty(0, np.int64)
    union, many = held[first], np.diff(np.append(first, len(held)))
    asked, who = token[~is_member], row[~is_member]
    place = np.minimum(np.searchsorted(union, asked), max(0, len(union) - 1))
    hit = union[place] == asked if len(union) else np.zeros(len(asked), bool)
    place, who = place[hit], who[hit]
    bound = np.bincount(who, minlength=len(rep))
    need = np.ceil(n * (2 * threshold / (1 + threshold)) - 1e-9)
    open_ = bound[who] >= need[who]
    place, who = place[open_], who[open_]
    # overlaps of the records with the members of the groups that are opened, by token
    out = [[], [], []]
    total = np.cumsum(many[place])
    x = 0
    while x < len(place):
        y = int(np.searchsorted(total, (total[x - 1] if x else 0) + AT_ONCE, side="right"))
        # a record's tokens stay together
        y = len(place) if y >= len(place) else int(np.searchsorted(who, who[min(y, len(place) - 1)]))
        y = y if y > x else int(np.searchsorted(who, who[x], side="right"))
        k = many[place[x:y]]
        m = owner[ranges(first[place[x:y]], k)]
        pair, overlap = np.unique(np.repeat(who[x:y], k) * np.int64(len(rep)) + m, return_counts=True)
        q, m = pair // len(rep), pair % len(rep)
        ok = (overlap >= threshold * (n[q] + n[m] - overlap) - 1e-9) & ((n[q] < n[m]) | ((n[q] == n[m]) & (rep[q] < rep[m])))
        for c, v in zip(out, (q[ok], m[ok], overlap[ok])):
            c.append(v)
        x = y
    q, m, overlap = (np.concatenate([*c, np.empty(0, np.int64)]).astype(np.int64) for c in out)
    a, b = np.where(rep[q] < rep[m], q, m), np.where(rep[q] < rep[m], m, q)
    return pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b]), *[pa.array(v.astype(np.int32)) for v in (n[a], n[b], overlap)]], names=["a", "b", "na", "nb", "overlap"])


def all_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of sets carried over to all records, and the copies of a record with each other."""
    one = members.select(F.col("rep").alias("a"), F.col("id").alias("x"))
    two = members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    across = pairs.select("a", "b").join(one, "a").join(two, "b").select("x", "y")
    several = members.groupBy("rep").agg(F.count("*").alias("k")).filter("k > 1").select("rep")
    own = members.join(several, "rep", "left_semi")
    within = own.select("rep", F.col("id").alias("x")).join(own.select("rep", F.col("id").alias("y")), "rep").select("x", "y")
    return across.unionByName(within).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Number and combined hashes of distinct edges; equal for equal sets of edges."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id each node of edges (a, b) is connected to.

    Alternating large and small stars: each round moves edges towards the smallest neighbour,
    so rounds grow with the logarithm of the nodes, and hot nodes are only aggregated, never
    gathered. Each round is written to the shared folder.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = _mark(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        new = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        new = materialize(new)
        before, now = mark, new
        mark = _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    star = now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")
    return star.unionByName(star.select(F.col("component").alias("id"), "component").distinct())


def near_duplicates(df: DataFrame, key: str, text: str, words: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of the records of df: (id, rep), and the similar pairs of different token sets.

    Together they hold every link: two records are linked when their reps are equal or a pair.
    Null keys, null and empty texts and texts of fewer than `words` words take no part; repeated
    rows count once, and a key that stands with several texts is linked by each of them; other
    columns are ignored; an empty table gives empty results.
    """
    sets = materialize(shingles(df, key, text, words).withColumn("uid", F.monotonically_increasing_id()))
    members = classes(sets)
    # one row of each set: the few others are left out by their numbers
    first = sets.groupBy("rep").agg(F.min("uid").alias("first"), F.count("*").alias("k")).filter("k > 1")
    other = materialize(sets.select("rep", "uid").join(first, "rep").filter("uid <> first").select("uid"))
    return members, similar(sets.join(other, "uid", "left_anti").select("rep", "n", "tokens"), threshold)


def groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, group_id, n_links): one row a record that is linked to another; group_id is the smallest id of its group."""
    pairs, members = materialize(pairs.select("a", "b")), materialize(members)
    size = members.groupBy("rep").agg(F.count("*").alias("k"), F.min("id").alias("least_id"))
    ends = pairs.select(F.col("a").alias("rep"), F.col("b").alias("o")).unionByName(pairs.select(F.col("b").alias("rep"), F.col("a").alias("o")))
    links = ends.join(size.select(F.col("rep").alias("o"), F.col("k").alias("ko")), "o").groupBy("rep").agg(F.sum("ko").alias("across"))
    comp = components(pairs).select(F.col("id").alias("rep"), "component")
    known = size.join(comp, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    group_id = known.groupBy("component").agg(F.min("least_id").alias("group_id"))
    known = known.join(group_id, "component").join(links, "rep", "left")
    n = F.col("k") - 1 + F.coalesce("across", F.lit(0))
    out = members.join(known, "rep").filter(n > 0).select("id", "group_id", n.alias("n_links"))
    return out.groupBy("id").agg(F.min("group_id").alias("group_id"), F.sum("n_links").alias("n_links"))
