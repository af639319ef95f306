"""Abusive, hateful or sexual passages, by a subsequence string-kernel SVM with Nyström landmarks.

A passage is a run of words. The kernel of two passages counts the subsequences they share, gaps
lowering their weight: subsequences of letters within a word, and subsequences of two or three
words. Letters left out, put in, spaced or replaced change few of them, so disguised insults stay
close to plain ones. The support vector machine is fitted in the space of a bounded number of
landmark passages; as its kernel is a product of explicit subsequence weights, the fitted function
is one weight for each subsequence, and a corpus is scored by table look-ups: a word's letters
once for each distinct word, and all passages of a text by running sums.

Labels say of whole documents whether they hold an abusive passage. The passages are found as the
machine is fitted: of a document labelled abusive the passage that scores highest is the example,
of another one its highest passages are counterexamples, and both are chosen anew in each round.
Where few documents are labelled abusive, a first machine labels some of the others that it is sure
of, and a second one is fitted on these too.
"""

from __future__ import annotations

import dataclasses
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.codepoints import text_array
from quire.llm.lookalikes import consistent

#: Bits of the table of subsequence weights.
BITS = 20
#: Weight of a gap of one letter or word.
GAP = 0.7
#: Words of a passage.
PASSAGE = 10
#: Labelled documents that the machine is fitted on, and characters of them, at most.
MOST_LABELLED, MOST_CHARS = 12_000, 24_000_000
#: Documents labelled abusive below which others are labelled by a first machine; documents that it is
#: asked for, those taken of each kind, at most, and the least distance of their scores from the threshold.
ENOUGH, UNLABELLED, TAKEN, SURE = 400, 10_000, 2_500, 0.15
#: Landmark passages; rounds of choosing the examples; cost of an error, and how much more one on an example costs.
LANDMARKS, ROUNDS, COST, WEIGHT = 512, 2, 0.3, 4.0
#: Counterexamples of a round, at most; documents that a subsequence must stand in to count.
MOST_AGAINST, LEAST_SEEN = 9_000, 2
#: Distinct words a worker remembers.
REMEMBERED = 300_000

# Signs that are written for letters.
SIGNS = str.maketrans("430157@$!|", "aeoisaasii")
_APART = re.compile(r"(?<![^\W_])[^\W_](?:[ .\-_*·]{1,2}[^\W_](?![^\W_])){2,}")
_BETWEEN = re.compile(r"[ .\-_*·]")
_TOKEN = re.compile(r"[^\s'’«»\"“”(),;:?¿¡]+")
_AGAIN = re.compile(r"(.)\1+")
_M = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - BITS)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _M) ^ b
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def tokens(texts: list[str | None]) -> list[list[str]]:
    """The words of texts, lower case, without accents, disguises by lookalikes, invisible characters or single letters set apart undone."""
    plain = consistent(pa.array(texts, pa.string()))[0].to_pylist()
    out = []
    for t in plain:
        if not t:
            out.append([])
            continue
        if not t.isascii():
            t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
        t = _APART.sub(lambda m: _BETWEEN.sub("", m.group()), t.lower())
        out.append([w.strip(".!-*_—…") or w for w in _TOKEN.findall(t)])
    return out


def skeleton(word: str) -> str:
    """The word with signs as the letters they are written for, and repeated letters once."""
    if any(c.isalpha() for c in word):
        word = word.translate(SIGNS)
    return _AGAIN.sub(r"\1", word)


def letters(word: str) -> tuple[np.ndarray, np.ndarray]:
    """(table places, weights) of the subsequences of three letters of a word, of norm 1."""
    s = "^" + skeleton(word) + "$"
    found: dict[int, float] = {}
    for i in range(len(s)):
        for j in range(i + 1, min(len(s), i + 3)):
            for k in range(j + 1, min(len(s), i + 5)):
                h = zlib.crc32((s[i] + s[j] + s[k]).encode("utf-8", "surrogatepass")) ^ 0x5BD1
                found[h] = found.get(h, 0.0) + GAP ** (k - i - 2)
    place = ((np.array(list(found), np.uint64) * _M) >> _SHIFT).astype(np.int64)
    weight = np.array(list(found.values()))
    return place, weight / max(1e-9, np.sqrt((weight**2).sum()))


class Words:
    """Hashes of words and their letter subsequences, each word's once."""

    def __init__(self, table: np.ndarray | None = None):
        self.table = table
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.hash: list[int] = []
        self.letters: list[tuple[np.ndarray, np.ndarray]] = []
        self.score: list[float] = []

    def __call__(self, words: list[str]) -> np.ndarray:
        """The number of each word."""
        if len(self.number) > REMEMBERED:
            self.clear()
        for w in set(words):
            if w not in self.number:
                self.number[w] = len(self.hash)
                self.hash.append(zlib.crc32(skeleton(w).encode("utf-8", "surrogatepass")) + 1)
                place, weight = letters(w)
                if self.table is None:
                    self.letters.append((place, weight))
                else:
                    self.score.append(float(self.table[place] @ weight))
        return np.fromiter((self.number[w] for w in words), np.int64, len(words))


def word_sequences(h: np.ndarray):
    """(places, weight) of each kind of subsequence of two or three words, beginning at each word."""
    n = len(h)
    pairs = {}
    for g in range(1, 4):
        if n > g:
            pairs[g] = _mix(h[:-g], h[g:])
            yield (pairs[g] >> _SHIFT).astype(np.int64), GAP ** (g - 1)
    for a in range(1, 3):
        for b in range(a + 1, 4):
            if n > b:
                yield ((_mix(pairs[a][: n - b], h[b:]) ^ np.uint64(77)) >> _SHIFT).astype(np.int64), GAP ** (b - 2)


def passage_scores(words: list[list[str]], known: Words, table: np.ndarray, bias: float) -> list[np.ndarray]:
    """The score of the passage beginning at each word of each text; above 0 is abusive."""
    size = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(size)
    flat = [w for ws in words for w in ws]
    if not flat:
        return [np.empty(0) for _ in words]
    number = known(flat)
    h = np.array(known.hash, np.uint64)[number]
    score = np.array(known.score)[number]
    left = np.repeat(ends, size) - np.arange(len(flat))
    for place, weight in word_sequences(h):
        reach = len(flat) - len(place)
        # a subsequence ends within its text
        score[: len(place)] += np.where(left[: len(place)] > reach, table[place] * weight, 0.0)
    run = np.zeros(len(flat) + 1)
    np.cumsum(score, out=run[1:])
    stop = np.minimum(np.arange(len(flat)) + PASSAGE, np.repeat(ends, size))
    return np.split(run[stop] - run[:-1] + bias, ends[:-1])


@dataclasses.dataclass
class Model:
    """A fitted machine: a passage is abusive when its subsequences' weights and the bias sum to more than 0."""

    table: np.ndarray
    bias: float
    n_labelled: int


class _Text:
    """A labelled text: the numbers of its words, and its word sequences by the words they begin at."""

    def __init__(self, words: list[str], known: Words):
        self.number = known(words).astype(np.int32)
        self.known = known
        self.n = len(words)
        self.kinds = [(p.astype(np.int32), w) for p, w in word_sequences(np.array(known.hash, np.uint64)[self.number])]

    def places(self) -> np.ndarray:
        """All different places of its subsequences."""
        own = [self.known.letters[i][0] for i in np.unique(self.number)]
        return np.unique(np.concatenate([*own, *[p for p, _ in self.kinds]]))

    def best(self, table: np.ndarray, of_words: np.ndarray) -> tuple[int, float]:
        """The first word and the score of the passage that scores highest."""
        s = of_words[self.number]
        for place, weight in self.kinds:
            s[: len(place)] += table[place] * weight
        run = np.zeros(self.n + 1)
        np.cumsum(s, out=run[1:])
        s = run[np.minimum(np.arange(self.n) + PASSAGE, self.n)] - run[:-1]
        k = int(np.argmax(s))
        return k, float(s[k])

    def passage(self, k: int, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, weights) of the subsequences that begin in a passage."""
        own = [self.known.letters[i] for i in self.number[k : k + PASSAGE]]
        parts = [(p[k : k + PASSAGE], w) for p, w in self.kinds]
        place = np.concatenate([*[p for p, _ in own], *[p for p, _ in parts]])
        weight = np.concatenate([*[w for _, w in own], *[np.full(len(p), w) for p, w in parts]])
        counts = rarity[place] > 0
        place, back = np.unique(place[counts], return_inverse=True)
        return place, (np.bincount(back, weight[counts], len(place)) * rarity[place]).astype(np.float32)


def _of_words(known: Words, table: np.ndarray) -> np.ndarray:
    """The score of each known word's letters."""
    place = np.concatenate([p for p, _ in known.letters])
    weight = np.concatenate([w for _, w in known.letters])
    at = np.cumsum([0, *[len(p) for p, _ in known.letters]])[:-1]
    return np.add.reduceat(table[place] * weight, at)


def _machines(words: list[list[str]], labels: list[int], which: int, seed: int) -> tuple[np.ndarray, float, list[float], list[float]]:
    """One of three machines: 0 is of all texts, 1 and 2 are each of a half of them, with their scores of the abusive and the other texts of the other half."""
    known = Words()
    made = [(_Text(w, known), y) for w, y in zip(words, labels) if w]
    pos, neg = [t for t, y in made if y == 1], [t for t, y in made if y == 0]
    rng = np.random.default_rng([seed, which])
    if not which:
        return (*_fit(pos, neg, rng), [], [])
    k = which - 1
    table, bias = _fit(pos[k::2], neg[k::2], rng)
    of_words = _of_words(known, table)
    return table, bias, *[[x.best(table, of_words)[1] + bias for x in part[1 - k :: 2]] for part in (pos, neg)]


def _model(words: list[list[str]], labels: list[int], run, seed: int = 0) -> Model:
    """The model of texts as words; run does _machines(words, labels, k, seed) for each of a list of k.

    The score from which a passage counts is found on texts the machine didn't see: each half of
    the texts is scored by a machine of the other half.
    """
    held = [y for w, y in zip(words, labels) if w]
    n_pos, n_neg = held.count(1), held.count(0)
    if not n_pos or not n_neg:
        return Model(np.zeros(1 << BITS, np.float32), -1.0, len(held))
    halves = n_pos >= 4 and n_neg >= 4
    (table, bias, _, _), *more = run(words, labels, [0, 1, 2] if halves else [0], seed)
    unseen = [sum((m[i] for m in more), []) for i in (2, 3)]
    cut = _threshold(np.array([*unseen[0], *unseen[1]]), n_pos) if halves else 0.0
    return Model(np.asarray(table, np.float32), bias - cut, len(held))


def fit(texts: list[str | None], labels: list[int], seed: int = 0) -> Model:
    """A model of texts labelled 1 (hold an abusive passage) or 0; without both kinds nothing is abusive."""
    return _model(tokens(texts), labels, lambda w, y, which, seed: [_machines(w, y, k, seed) for k in which], seed)


def _on_executors(spark):
    """What fits the machines in tasks of their own, side by side."""

    def run(words, labels, which, seed):
        held = spark.sparkContext.broadcast((words, labels))

        def task(batches):
            for b in batches:
                for k in b.column(0).to_pylist():
                    table, bias, pos, neg = _machines(*held.value, k, seed)
                    # of the halves only the scores are used
                    table = b"" if k else np.asarray(table, np.float32).tobytes()
                    cols = [pa.array([k], pa.int64()), pa.array([table]), pa.array([float(bias)]), pa.array([pos], pa.list_(pa.float64())), pa.array([neg], pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays(cols, names=["k", "table", "bias", "pos", "neg"])

        rows = spark.range(which[0], which[-1] + 1, 1, len(which)).mapInArrow(task, "k long, table binary, bias double, pos array<double>, neg array<double>").collect()
        held.unpersist()
        return [(np.frombuffer(bytes(r["table"]), np.float32), r["bias"], r["pos"], r["neg"]) for r in sorted(rows, key=lambda r: r["k"])]

    return run


def _fit(pos: list[_Text], neg: list[_Text], rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """(weight of each subsequence, bias) of a machine of abusive and other texts."""
    size = 1 << BITS
    in_pos, in_neg = np.zeros(size), np.zeros(size)
    for part, count in ((pos, in_pos), (neg, in_neg)):
        for t in part:
            count[t.places()] += 1
    seen = in_pos + in_neg
    n = len(pos) + len(neg)
    # rare subsequences weigh more in the kernel; those of a single text tell nothing of others
    rarity = np.where(seen >= LEAST_SEEN, np.log(n / np.maximum(seen, 1)), 0.0)
    rarity /= max(rarity.max(), 1e-9)
    # the first choice of passages: by how much more often a subsequence stands in abusive texts
    table = np.log((in_pos + 0.2) / (len(pos) + 1)) - np.log((in_neg + 0.2) / (len(neg) + 1))
    table = np.where(seen > 0, np.clip(table, -2, 4), 0.0)
    table[in_pos < 2] = np.minimum(table[in_pos < 2], 0.0)
    against: list[tuple[_Text, int]] = []
    bias = 0.0
    for _ in range(ROUNDS):
        of_words = _of_words(pos[0].known, table)
        good = [(t, t.best(table, of_words)[0]) for t in pos]
        hard = [(t, t.best(table, of_words)[0]) for t in neg]
        some = [(neg[i], int(rng.integers(0, max(1, neg[i].n - PASSAGE + 1)))) for i in rng.permutation(len(neg))[:1500]]
        against = list({(id(t), k): (t, k) for t, k in [*against, *some, *hard]}.values())[-MOST_AGAINST:]
        x = [t.passage(k, rarity) for t, k in [*good, *against]]
        y = np.array([1.0] * len(good) + [-1.0] * len(against))
        table, bias = _machine(x, y, len(good), rng)
        table = table * rarity
    return table, bias


def _machine(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_good: int, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """(weight of each subsequence, bias): the squared-hinge SVM in the landmarks' space."""
    chosen = np.concatenate([rng.permutation(n_good)[: LANDMARKS * 3 // 4], n_good + rng.permutation(len(x) - n_good)[: LANDMARKS // 4]])
    held = np.unique(np.concatenate([x[i][0] for i in chosen]))
    z = np.zeros((len(held), len(chosen)), np.float32)
    for j, i in enumerate(chosen):
        place, weight = x[i]
        z[np.searchsorted(held, place), j] = weight / max(1e-9, np.sqrt((weight**2).sum()))
    k = np.zeros((len(x), len(chosen)), np.float32)
    for i, (place, weight) in enumerate(x):
        at = np.minimum(np.searchsorted(held, place), len(held) - 1)
        ok = held[at] == place
        k[i] = weight[ok] @ z[at[ok]]
    value, vector = np.linalg.eigh((z.T @ z).astype(np.float64))
    root = vector / np.sqrt(np.maximum(value, 1e-3)) @ vector.T
    phi = np.concatenate([k @ root.astype(np.float32), np.ones((len(x), 1), np.float32)], axis=1)
    del k
    cost = np.where(y > 0, COST * WEIGHT, COST)
    ridge = np.diag([1.0] * len(chosen) + [1e-6])
    w = np.zeros(phi.shape[1])
    for _ in range(40):
        inside = 1 - y * (phi @ w) > 0
        part = phi[inside] * np.sqrt(cost[inside, None]).astype(np.float32)
        new = np.linalg.solve((part.T @ part).astype(np.float64) + ridge, phi[inside].T.astype(np.float64) @ (cost * y)[inside])
        moved = np.abs(new - w).max()
        w = new
        if moved < 1e-6:
            break
    table = np.zeros(1 << BITS)
    table[held] = z @ (root @ w[:-1])
    return table, float(w[-1])


def _threshold(scores: np.ndarray, n_pos: int) -> float:
    """The score from which texts count as abusive: the middle of the range of best F1 on the labelled texts."""
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(order < n_pos)
    f1 = 2 * hits / (np.arange(1, len(scores) + 1) + n_pos)
    k = int(np.argmax(f1))
    s = scores[order]
    return float((s[k] + s[min(k + 1, len(s) - 1)]) / 2)


def verdicts(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(key, y): one decided verdict a document, by majority; ties and undecided documents give none."""
    votes = labels.filter(F.col(f"`{label}`").isin(0, 1) & F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias(key)).agg(F.avg(F.col(f"`{label}`")).alias("m"))
    return votes.filter("m <> 0.5").select(key, (F.col("m") > 0.5).cast("int").alias("y"))


def _words(rows: DataFrame) -> DataFrame:
    """rows (key, text, …) with the words of their text instead of it."""
    schema = T.StructType([*[f for f in rows.schema if f.name != "text"], T.StructField("words", T.ArrayType(T.StringType()))])
    at = rows.columns.index("text")

    def run(batches):
        for b in batches:
            said = pa.array(tokens(text_array(b.column(at)).to_pylist()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(b.columns) if i != at], said], names=schema.names)

    return rows.mapInArrow(run, schema)


def _bounded(sample: DataFrame, key: str) -> DataFrame:
    """Of a sample of rows (key, text, …) those in order of a hash that have MOST_CHARS characters together."""
    before = F.sum(F.length("text")).over(Window.orderBy(F.xxhash64(key), key, "text"))
    return sample.withColumn("_size", before).filter(F.col("_size") <= MOST_CHARS).drop("_size")


#: Fitted models by what they were fitted on, the last few.
_fitted: dict[tuple, Model] = {}


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "abusive", most: int = MOST_LABELLED) -> Model:
    """A model of the labelled documents: of at most `most` of them, and MOST_CHARS characters, chosen by a hash of their key.

    Only this bounded sample reaches the driver, as words, which are made on the executors like the
    machines themselves. With fewer than ENOUGH documents labelled abusive, at most TAKEN of
    UNLABELLED other documents of each kind join it, by their scores. Null and empty texts teach
    nothing; of several texts of a key the first in order counts. A model is fitted once in a
    session for the same documents and labels.
    """
    spark = documents.sparkSession
    decided = verdicts(labels, key, label)
    sample = decided.orderBy(F.xxhash64(key), key).limit(most)
    texts = documents.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("text")).filter("length(text) > 0")
    chosen = texts.join(F.broadcast(sample), key).groupBy(key, "y").agg(F.min("text").alias("text"))
    rows = sorted(_words(_bounded(chosen, key).select(key, "y", "text")).collect(), key=lambda r: str(r[key]))
    words, y = [r["words"] for r in rows], [r["y"] for r in rows]
    said = zlib.crc32(repr([(r[key], r["y"], r["words"]) for r in rows]).encode("utf-8", "surrogatepass"))
    name = (spark.sparkContext.applicationId, documents.semanticHash(), len(rows), said)
    if name in _fitted:
        return _fitted[name]
    run = _on_executors(spark)
    model = _model(words, y, run)
    if 0 < y.count(1) < ENOUGH and y.count(0):
        asked = texts.select(key).join(decided.select(key), key, "left_anti").distinct().orderBy(F.xxhash64(key), key).limit(UNLABELLED)
        others = _bounded(texts.join(F.broadcast(asked), key).groupBy(key).agg(F.min("text").alias("text")), key)
        scored = score(others, model, key).select(key, "score").filter(F.abs("score") > SURE)
        sure = scored.withColumn("y", (F.col("score") > 0).cast("int")).withColumn("_n", F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64(key), key))).filter(F.col("_n") <= TAKEN)
        more = sorted(_words(others.join(F.broadcast(sure.select(key, "y")), key).select(key, "y", "text")).collect(), key=lambda r: str(r[key]))
        model = _model(words + [r["words"] for r in more], y + [r["y"] for r in more], run)
    while len(_fitted) >= 4:
        _fitted.pop(next(iter(_fitted)))
    _fitted[name] = model
    return model


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, passage, abusive): every row with the score of its worst passage and that passage.

    score is above 0 and abusive true where a passage is abusive; null and empty texts, and texts
    without words, have the score null and are not abusive. Other columns are ignored, repeated
    rows come out repeated. Whole texts are scored, in one pass without a shuffle.
    """
    source = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([T.StructField(key, source.schema[0].dataType), T.StructField("score", T.DoubleType()), T.StructField("passage", T.StringType()), T.StructField("abusive", T.BooleanType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        known = Words(m.table)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                words = tokens(text_array(part.column(1)).to_pylist())
                scores = passage_scores(words, known, m.table, m.bias)
                best = [int(np.argmax(s)) if len(s) else -1 for s in scores]
                top = [float(s[k]) if k >= 0 else None for s, k in zip(scores, best)]
                said = [" ".join(w[k : k + PASSAGE]) if k >= 0 else None for w, k in zip(words, best)]
                bad = [t is not None and t > 0 for t in top]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(top, pa.float64()), pa.array(said, pa.string()), pa.array(bad)], names=schema.names)

    return source.mapInArrow(run, schema)


def rates(scored: DataFrame, source: DataFrame, key: str = "doc_id", by: str = "source") -> DataFrame:
    """(by, n_documents, n_abusive, rate) of scored documents; a null source is a source of its own."""
    joined = scored.select(key, "abusive").join(source.select(key, by).distinct(), key)
    return joined.groupBy(by).agg(F.count("*").alias("n_documents"), F.sum(F.col("abusive").cast("int")).cast("long").alias("n_abusive"), F.avg(F.col("abusive").cast("int")).alias("rate"))
