"""The parts of the operators that need no session, against plain versions of them."""

import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import abuse, canonical, codepoints, encoding, fmindex, leakage, lookalikes, neardup, sharedspans, splitting

TEXT = st.text(alphabet=st.sampled_from("ab éè.,!?\n\t 12 «»🕊œ" + chr(0x301) + chr(0xA0) + chr(0x200B)), max_size=80)


@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
@settings(max_examples=60, deadline=None)
def test_codepoints_round_trip(texts):
    cp, bounds = codepoints.to_codepoints(pa.array(texts, pa.string()))
    assert codepoints.from_codepoints(cp, bounds).to_pylist() == [t or "" for t in texts]


def test_codepoints_of_a_slice():
    arr = pa.array(["é", "x", None, "🕊z"]).slice(1)
    cp, bounds = codepoints.to_codepoints(arr)
    assert bounds.tolist() == [0, 1, 1, 3] and "".join(map(chr, cp)) == "x🕊z"


@given(st.lists(st.text(alphabet=st.sampled_from("aeoucAC xé" + "".join(map(chr, (0x301, 0x300, 0x302, 0x323, 0x327, 0x314, 0x308)))), max_size=12), max_size=5))
@settings(max_examples=150, deadline=None)
def test_composition_is_canonical(texts):
    got = lookalikes.consistent(pa.array(texts, pa.string()))[0].to_pylist()
    assert got == [unicodedata.normalize("NFC", t) for t in texts]


@given(st.lists(st.text(alphabet=st.sampled_from("a각" + "".join(map(chr, (0x1100, 0x1112, 0x1161, 0x1175, 0x11A8, 0x11C2, 0xAC00, 0xD788, 0x301)))), max_size=10), max_size=5))
@settings(max_examples=200, deadline=None)
def test_syllables_are_canonical(texts):
    got = lookalikes.consistent(pa.array(texts, pa.string()))[0].to_pylist()
    assert got == [unicodedata.normalize("NFC", t) for t in texts]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("", ""),
        (None, None),
        ("plain text, œuvre « x »", "plain text, œuvre « x »"),
        ("ｆｕｌｌ　１２！", "full 12!"),
        ("e" + chr(0x301) + "te" + chr(0x301), "été"),
        ("fait" + chr(0x200B) + "h" + chr(0xAD) + "ful" + chr(0xFEFF), "faithful"),
        ("a" + chr(0xA0) + "b" + chr(0x202F) + "c" + chr(0x2007) + "d", "a b c d"),
        ("v" + chr(0x43E) + "ir", "voir"),
        (chr(0x441) + "om", "com"),
        ("слово было там λόγος שלום", "слово было там λόγος שלום"),
        (chr(0xFB01) + "n", "fin"),
        ("a  b\t\nc", "a  b\t\nc"),
        ("👩" + chr(0x200D) + "🚀 ✝" + chr(0xFE0F), "👩" + chr(0x200D) + "🚀 ✝" + chr(0xFE0F)),
        ("m" + chr(0x3CC) + "t", "mót"),
        (chr(0x13AA) + "vril", "Avril"),
        ("v" + chr(0x2C9F) + "ir", "voir"),
        (chr(0x13AA) + chr(0x13AC), chr(0x13AA) + chr(0x13AC)),
        (chr(0xFFA1) + chr(0xFFC2), "가"),
        ("x" * 50_000 + chr(0x200B), "x" * 50_000),
    ],
)
def test_consistent_form(raw, want):
    form, changed = lookalikes.consistent(pa.array([raw], pa.string()))
    assert form.to_pylist() == [want] and bool(changed[0]) == (raw != want)


def test_forms_are_stable():
    texts = ["ｅ" + chr(0x301) + chr(0x200D), "к" + chr(0x430) + "t", chr(0x212B)]
    once = lookalikes.consistent(pa.array(texts))[0]
    assert not lookalikes.consistent(once)[1].any()


PIECES = st.text(alphabet=st.sampled_from(" \n\tab é12's.!" + chr(0x1C) + chr(0x85) + "🕊ש"), max_size=120)


@given(PIECES, st.integers(4, 40), st.integers(1, 12))
@settings(max_examples=300, deadline=None)
def test_stitched_pretokens(text, chunk, overlap):
    assert encoding.pretokens(text, chunk, overlap) == encoding._split.findall(text)


def test_ids_are_the_tokenizers():
    tokenizers = pytest.importorskip("tokenizers")
    import os

    t = tokenizers.Tokenizer.from_file(os.path.join(encoding.VOCABULARIES, encoding.VOCABULARY + ".json"))
    t.encode_special_tokens = True
    texts = ["", None, "Notre puits, l'été !", "<|endoftext|> x", "   \n\n ", "🕊 שלום слово", "a" * 3000, "word " * 5000]
    ids, bounds = encoding.encode_texts(texts, encoding.Pieces(encoding.vocabulary_path()), 1000, 50)
    for i, text in enumerate(texts):
        own = ids[bounds[i] : bounds[i + 1]].tolist()
        assert own == t.encode(text or "", add_special_tokens=False).ids
        assert encoding.decode(own) == (text or "").encode()


@given(st.text(alphabet=st.sampled_from("ab .\n,é" + chr(0x301)), max_size=150), st.integers(1, 40), st.data())
@settings(max_examples=200, deadline=None)
def test_pieces_give_the_text_back(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    got = splitting.split(text, limit, overlap)
    assert "".join(text[s + h : e] for s, e, h in got) == text
    assert all(0 < e - s <= limit and 0 <= h <= overlap for s, e, h in got)
    assert all(a[1] == b[0] + b[2] for a, b in zip(got, got[1:]))


def test_pieces_end_at_natural_boundaries():
    sentence = "The well gives water to the village every day. "
    text = (sentence * 30 + "\n\n") * 4
    got = splitting.split(text, 1000, 100)
    assert all(text[:e].rstrip().endswith(".") for _, e, _ in got)


def test_valley_is_where_the_subject_changes():
    text = "river boat water fish net. " * 30 + "stone wall tower roof gate. " * 30
    at, _ = splitting.boundaries(text)
    depth = splitting.valleys(text, at)
    assert abs(int(at[np.argmax(depth)]) - 27 * 30) < 120


def test_split_rejects_an_overlap_of_the_limit():
    with pytest.raises(ValueError):
        splitting.split("abc", 5, 5)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@given(st.text(alphabet="abcd", max_size=12), st.text(alphabet="abcd", max_size=12))
def test_edit_distance(a, b):
    assert canonical.levenshtein(a, b) == plain_distance(a, b)


@given(st.lists(st.text(alphabet="abc", min_size=1, max_size=6), min_size=1, max_size=20), st.text(alphabet="abc", min_size=1, max_size=6), st.integers(0, 3))
@settings(max_examples=100, deadline=None)
def test_tree_finds_all_within(names, query, radius):
    tree = canonical.Tree([(n, i) for i, n in enumerate(names)])
    assert sorted(tree.within(query, radius)) == sorted((d, i) for i, n in enumerate(names) if (d := plain_distance(query, n)) <= radius)


ENTRIES = [(1, "Stèmauvia", "Îles Tamarines", []), (2, "Beilmudero", "Comté de Brell", None), (3, "Beilmudero", "Tessaria Norte", []), (4, "Banutan-sur-Cése", None, ["Graunaurville"]), (5, None, None, []), (6, "Saint-Malestivença", "Kenmark", [])]


@pytest.mark.parametrize(
    ("value", "entry"),
    [("stemauvia (ÎLES TAMARINES)", 1), ("near Stèmauvia", 1), ("1459 Stèmauvia", 1), ("STÈAVIA", 1), ("Ville de Stèmauvia", 1), ("Stèmauvia City", 1), ("Beilmmmudero, comte de brell", 2), ("BEILMUDERO / Tessaria Norte", 3), ("Beilmudero.", None), ("Banutan s/ Cése", 4), ("graunaurvile", 4), ("ST-MALESTIVENCA", 6), ("Trillovbourg", None), ("?", None), ("N/A", None), ("0", None)],
)
def test_value_means(value, entry):
    got = canonical.Reference(ENTRIES).best(value)
    assert (got and got[0]) == entry


def test_values_without_habits():
    of = canonical.Reference(ENTRIES, canonical.Habits())
    assert of.best("Stemauviaa") == (1, 1) and of.best("Ville de Stèmauvia") is None and of.best("Stèmauvia, Kenmark") == (1, 0)


@given(st.lists(st.text(alphabet="ab", max_size=25), min_size=1, max_size=6, unique=True), st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_backward_search(strings, least):
    cp = np.array([ord(c) for s in strings for c in s], np.uint32)
    bounds = np.cumsum([0, *map(len, strings)])
    index = fmindex.Index(cp, bounds, least)
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    met = {}
    for step, lo, hi in index.stream(index.symbols(cp), bounds[1:][order], size[order]):
        for k, (x, y) in enumerate(zip(lo.tolist(), hi.tolist())):
            s, o = index.places(np.arange(x, y))
            met[int(order[k]), int(size[order[k]]) - step] = sorted(zip(s.tolist(), o.tolist()))
    want = {}
    for i, t in enumerate(strings):
        for p in range(len(t) - least + 1):
            want[i, p] = [(j, k) for j, u in enumerate(strings) for k in range(len(u)) if u.startswith(t[p : p + least], k)]
    assert met == want


def test_shared_runs_share_anchors():
    rng = random.Random(5)
    run = "".join(rng.choice("abcdefgh ") for _ in range(60))
    rows = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 90))) + run + "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 90))) for _ in range(8)]
    cp, bounds = codepoints.to_codepoints(pa.array([*rows, "short", ""]))
    row, _, h = sharedspans.anchors(cp, bounds, 60, 20)
    sets = [set(h[row == i].tolist()) for i in range(8)]
    assert set.intersection(*sets) and set(row.tolist()) <= set(range(8))


def _shard(texts, least):
    n = len(texts)
    ids, zero = np.arange(n), np.zeros(n, np.int32)
    return sharedspans.Shard(pa.table({"unit": ids * 0, "block": zero - 1, "tid": ids, "code": ids + 1000, "start": zero, "text": pa.array(texts, pa.string())}), least)


def _got(batches, *cols):
    return sorted(tuple(r[c] for c in cols) for b in batches for r in b.to_pylist())


def test_a_shard_without_shared_parts_gives_none():
    shard = _shard(["abcdefgh", "ijklmnop", "ab"], 4)
    assert not _got(shard.shared(), "tid") and not _got(shard.pairs(), "a") and not _got(shard.spans(), "a")


@given(st.lists(st.text(alphabet="ab", max_size=30), min_size=1, max_size=6), st.integers(1, 9), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_a_shard_is_brute_force(texts, least, lane):
    from unittest import mock

    places = [{t[k : k + least] for k in range(len(t) - least + 1)} for t in texts]
    want = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if places[i] & places[j]]
    with mock.patch.object(sharedspans, "LANE", lane):
        shard = _shard(texts, least)
        assert _got(shard.pairs(), "a", "b") == want
        runs: dict = {}
        for a, b, i, j, n in _got(shard.spans(), "a", "b", "start_a", "start_b", "length"):
            assert texts[a][i : i + n] == texts[b][j : j + n]
            runs.setdefault((a, b), set()).update((i + k, j + k) for k in range(n - least + 1))
        assert runs == {(a, b): {(i, j) for i in range(len(texts[a]) - least + 1) for j in range(len(texts[b]) - least + 1) if texts[a][i : i + least] == texts[b][j : j + least]} for a, b in want}
        held = {(r, k) for r, s, n in _got(shard.shared(), "tid", "start", "length") for k in range(s, s + n)}
    assert held == {(i, p + k) for i, t in enumerate(texts) for p in range(len(t) - least + 1) if any(t[p : p + least] in q for j, q in enumerate(places) if j != i) for k in range(least)}


def test_runs_come_from_the_index(monkeypatch):
    shard = _shard(["abcdefgh", "xabcdefy", "abcdexx"], 4)
    assert len(_got(shard.pairs(), "a", "b")) == 3 and _got(shard.shared(), "tid") and _got(shard.spans(), "a")
    # an index whose backward search finds nothing
    monkeypatch.setattr(fmindex.Index, "extend", lambda self, symbol, lo, hi: (lo * 0, hi * 0))
    assert not _got(shard.pairs(), "a", "b") and not _got(shard.shared(), "tid") and not _got(shard.spans(), "a")


@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2), st.integers(0, 300)), max_size=60, unique=True), st.integers(1, 60))
@settings(max_examples=300, deadline=None)
def test_fewer_anchors_cover_the_same(found, reach):
    row, h, at = (np.array([f[i] for f in found], np.int64) for i in range(3))
    keep = sharedspans.thinned(at, row, h, reach)
    cover = lambda k: {(r, x, c) for r, x, a in zip(row[k], h[k], at[k]) for c in range(a, a + reach)}
    assert cover(keep) == cover(np.ones(len(at), bool))


def test_shingles_of_words():
    make = neardup.Shingles(3)
    assert len(make("Un deux trois quatre")) == 2 and len(make("a b")) == 0 and len(make(None)) == 0
    assert (make("UN, deux... trois quatre") == make("un deux trois quatre")).all()


def test_words_without_case_and_accents():
    assert leakage.words("L'ÉTÉ de e" + chr(0x301) + "te, 12!") == ["l", "ete", "de", "ete", "12"]


@given(st.lists(st.lists(st.sampled_from("abcdefg"), max_size=30), min_size=1, max_size=6), st.lists(st.lists(st.sampled_from("abcdefgx"), max_size=40), max_size=6))
@settings(max_examples=80, deadline=None)
def test_leaks_are_all_found(items, docs):
    index = leakage.Index([(i, " ".join(w)) for i, w in enumerate(items)], 4, 2)
    row, item, _ = index.search([" ".join(w) for w in docs])
    got = {(r, index.items[i]) for r, i in zip(row.tolist(), item.tolist())}
    runs = lambda w: {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
    assert got == {(r, i) for r, w in enumerate(docs) for i, v in enumerate(items) if runs(w) & runs(v)}


INSULTS = ["you worthless idiot nobody wants you here", "shut your mouth you stupid pig", "people like you should be drowned"]
CALM = ["the old well gives water every day", "our garden waits for the quiet rain", "this river keeps its secret all night"]


def _labelled():
    rng = random.Random(1)
    texts, labels = [], []
    for i in range(120):
        lines = [rng.choice(CALM) + " " + rng.choice(["today", "tomorrow", "slowly", "again"]) for _ in range(4)]
        if i % 4 == 0:
            lines.insert(rng.randint(0, 4), rng.choice(INSULTS))
        texts.append(". ".join(lines))
        labels.append(int(i % 4 == 0))
    return texts, labels


def _abusive(model, texts):
    scores = abuse.passage_scores(abuse.tokens(texts), abuse.Words(model.table), model.table, model.bias)
    return [bool(len(s)) and float(s.max()) > 0 for s in scores]


def test_machine_learns_passages_and_sees_through_disguises():
    texts, labels = _labelled()
    model = abuse.fit(texts, labels)
    held = ["our garden waits. shut your mouth you st" + chr(0x200B) + "upid p1g. the rain", "you w o r t h l e s s idi0t nobody wants you here", "the old well gives water. our garden waits", "", None]
    assert _abusive(model, held) == [True, True, False, False, False]


def test_machine_without_examples():
    assert _abusive(abuse.fit(["calm words here"], [0]), ["calm words here"]) == [False]
    assert _abusive(abuse.fit([], []), ["anything"]) == [False]


def test_passage_scores_are_the_kernel_of_its_subsequences():
    """Running sums give what summing a text's subsequences one by one gives."""
    rng = np.random.default_rng(0)
    table = rng.normal(size=1 << abuse.BITS).astype(np.float32)
    words = ["a", "river", "runs", "low", "and", "slow", "today"]
    known = abuse.Words()
    text = abuse._Text(words, known)
    first = abuse._of_words(known, table)[text.number].sum() + sum(table[p].sum() * w for p, w in text.kinds)
    got = abuse.passage_scores([["other"], words], abuse.Words(table), table, 0.0)[1]
    assert abs(got[0] - first) < 1e-3
