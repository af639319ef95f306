"""Encoding of whole corpora with a public byte-level BPE vocabulary.

A text is cut into overlapping chunks, each chunk is split into pre-tokens on its own, and the
splits are stitched where both have a boundary at the same place: from a common boundary on, the
splitting depends on nothing before it. The pre-tokens are then encoded, each distinct one once
per worker and batch of texts; decoding joins the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import bisect
import functools
import os

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quire.llm.codepoints import ranges, text_array

#: Default place of the vocabulary files; a parameter of every function here.
VOCABULARIES = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a chunk, and of its overlap with the next.
CHUNK, OVERLAP = 1 << 16, 1 << 9
#: Distinct pre-tokens a worker remembers; it starts afresh beyond that.
REMEMBERED = 300_000

_split = regex.compile(PATTERN)


def _content(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@functools.lru_cache(4)
def ranks(source: str | bytes) -> dict[bytes, int]:
    """The vocabulary of a rank file, given by its path or content."""
    content = source if isinstance(source, bytes) else _content(source)
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}


@functools.lru_cache(4)
def encoder(source: str | bytes):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks(source), special_tokens={})


def vocabulary_path(name: str = VOCABULARY, folder: str | None = None) -> str:
    return os.path.join(folder or VOCABULARIES, name + ".tiktoken")


def pretokens(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """The pre-tokens of text, the same as of the unchunked text; joined they give the text."""
    if len(text) <= chunk:
        return _split.findall(text)
    overlap = min(overlap, chunk // 2)
    cuts: list[int] = [0]
    at = 0
    while at < len(text):
        end = min(len(text), at + chunk)
        own = [m.end() for m in _split.finditer(text[at:end])]
        if at == 0:
            cuts += own
        else:
            # the first boundary both chunks have, before the last two of the earlier one
            shared = set(cuts[bisect.bisect_left(cuts, at) :])
            safe = cuts[-3] if len(cuts) >= 3 else 0
            meet = next((k for k, e in enumerate(own) if at + e <= safe and at + e in shared), None)
            if meet is None:
                # no resynchronisation within the overlap: go on from the last safe boundary
                del cuts[bisect.bisect_right(cuts, safe) :]
                at, size = safe, chunk
                own = []
                while len(own) < 4:
                    end = min(len(text), at + size)
                    own = [m.end() for m in _split.finditer(text[at:end])]
                    if end == len(text):
                        break
                    size *= 2
                cuts += [at + e for e in own]
            else:
                join = at + own[meet]
                del cuts[bisect.bisect_left(cuts, join) + 1 :]
                cuts += [at + e for e in own[meet + 1 :]]
        if end == len(text):
            break
        at = end - overlap
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


class Pieces:
    """Ids of distinct pre-tokens, kept as one flat array with bounds."""

    def __init__(self, source: str | bytes):
        self.bpe, self.known = encoder(source)._core_bpe, ranks(source)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat: list[int] = []
        self.bounds: list[int] = [0]

    def __call__(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, number of ids of each piece)."""
        if len(self.number) > REMEMBERED:
            self.clear()
        got = list(map(self.number.get, pieces))
        if None in got:
            for p in dict.fromkeys(p for p, n in zip(pieces, got) if n is None):
                raw = p.encode("utf-8")
                one = self.known.get(raw)
                self.flat.extend([one] if one is not None else self.bpe.encode_single_piece(raw))
                self.number[p] = len(self.bounds) - 1
                self.bounds.append(len(self.flat))
            got = list(map(self.number.__getitem__, pieces))
        k = np.array(got, np.int64)
        bounds = np.array(self.bounds, np.int64)
        size = bounds[k + 1] - bounds[k]
        return np.array(self.flat, np.int32)[ranges(bounds[k], size)], size


def encode_texts(texts: list[str | None], pieces: Pieces, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, bounds of each text); null and empty texts have none."""
    split: list[str] = []
    ends = [0]
    for text in texts:
        if text:
            split += pretokens(text, chunk, overlap)
        ends.append(len(split))
    if not split:
        return np.empty(0, np.int32), np.zeros(len(ends), np.int64)
    ids, size = pieces(split)
    at = np.zeros(len(split) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    return ids, at[np.array(ends)]


def encode(df: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str = VOCABULARY, folder: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """df without column text but with its token ids in the new last column ids, an array of ints.

    No special tokens are added, and their strings in a text are ordinary text. Null and empty
    texts give an empty array, never null. Texts of any length are encoded whole. A column already
    named ids, in any case, is replaced. Rows keep their number; there is no shuffle. The vocabulary,
    a file of a few MB, is read by the driver and sent to the workers.
    """
    shared = df.sparkSession.sparkContext.broadcast(_content(vocabulary_path(vocabulary, folder)))
    kept = [c for c in df.columns if c.lower() != ids.lower() and c != text]
    source = df.select(*[f"`{c}`" for c in [*kept, text]])
    schema = T.StructType([*[source.schema[c] for c in kept], T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches):
        pieces = Pieces(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                flat, bounds = encode_texts(text_array(part.column(len(kept))).to_pylist(), pieces, chunk, overlap)
                made = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(kept))], made], names=[*kept, ids])

    return source.mapInArrow(run, schema)


def decode(ids: list[int], vocabulary: str = VOCABULARY, folder: str | None = None) -> bytes:
    """The raw bytes of ids; of whole texts they are UTF-8."""
    return encoder(vocabulary_path(vocabulary, folder)).decode_bytes(ids)


def decode_column(df: DataFrame, ids: str = "ids", text: str = "decoded", vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """df with the text of column ids in the new last column text; null ids give null."""
    shared = df.sparkSession.sparkContext.broadcast(_content(vocabulary_path(vocabulary, folder)))
    kept = [c for c in df.columns if c.lower() != text.lower()]
    source = df.select(*[f"`{c}`" for c in kept])
    schema = T.StructType([*source.schema.fields, T.StructField(text, T.StringType())])

    def run(batches):
        enc = encoder(shared.value)
        for b in batches:
            said = [None if x is None else enc.decode_bytes(x).decode("utf-8", "replace") for x in b.column(kept.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string())], names=[*kept, text])

    return source.mapInArrow(run, schema)
