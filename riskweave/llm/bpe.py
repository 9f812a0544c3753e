"""Byte-level BPE of whole corpora with a public vocabulary.

Merging: a segment tree over the ranks of adjacent pairs. Its root holds the
leftmost pair of lowest rank; a merge updates three leaves in logarithmic time,
until no mergeable pair is left. Words of any length cost n log n.

Texts are cut at places where a word must end, and both words and stretches
between cuts are memoised per Python worker (bounded), since revisions repeat
one another. Null and empty texts give no ids; strings of special tokens are
ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Default name of the vocabulary; ``vocabulary`` parameters take any tiktoken-style rank file.
VOCABULARY = "byte_bpe_50k.tiktoken"

_INF = 1 << 62
_LOW = (1 << 32) - 1
WORDS, STRETCHES = 300_000, 60_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    """A path as given, or the place of a public vocabulary by name."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def word_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one word."""
    n = len(word)
    if n == 0:
        return []
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    parts: list[bytes] = [word[i : i + 1] for i in range(n)]
    size = 1
    while size < n:
        size *= 2
    get = ranks.get
    tree = [_INF] * (2 * size)
    for i in range(n - 1):
        r = get(word[i : i + 2])
        if r is not None:
            tree[size + i] = (r << 32) | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))

    def put(i: int, v: int) -> None:
        i += size
        tree[i] = v
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            m = a if a < b else b
            if tree[i] == m:
                return
            tree[i] = m
            i >>= 1

    while tree[1] != _INF:
        i = tree[1] & _LOW
        j = after[i]
        parts[i] = merged = parts[i] + parts[j]
        k = after[j]
        after[i] = k
        if k < n:
            before[k] = i
        put(j, _INF)
        r = get(merged + parts[k]) if k < n else None
        put(i, _INF if r is None else (r << 32) | i)
        p = before[i]
        if p >= 0:
            r = get(parts[p] + merged)
            put(p, _INF if r is None else (r << 32) | p)
    out, i = [], 0
    while i < n:
        out.append(ranks[parts[i]])
        i = after[i]
    return out


class _Words(dict):
    """Word -> int32 bytes of its ids."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> bytes:
        ids = np.array(merge_word(word.encode("utf-8", "surrogatepass"), self.ranks), dtype=np.int32).tobytes()
        if len(self) >= WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids


class Encoder:
    """Text -> int32 bytes of its ids."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import regex

        self.words = _Words(load_ranks(vocabulary_path(vocabulary)))
        self.split = regex.compile(word_pattern()).findall
        self.stretches: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        words = self.words
        return b"".join([words[w] for w in self.split(text)])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "\x00" in text:
            return self._encode(text)
        # A word never crosses from a full stop, bracket or brace to a blank or line break.
        cut = text.replace(". ", ".\x00 ").replace(".\n", ".\x00\n").replace("]\n", "]\x00\n").replace("}\n", "}\x00\n").split("\x00")
        known, out = self.stretches, []
        for s in cut:
            ids = known.get(s)
            if ids is None:
                ids = self._encode(s)
                if len(s) <= 2000:
                    if len(known) >= STRETCHES:
                        known.clear()
                    known[s] = ids
            out.append(ids)
        return b"".join(out)


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, ids: str = "ids") -> DataFrame:
    """(key, ids) of every row; no shuffle, Arrow in and out.

    Null and empty texts give an empty list, a null key stays null, repeated
    rows stay repeated, an empty table gives no rows, other columns are ignored.
    """
    field = df.schema[key]
    schema = T.StructType([T.StructField(key, field.dataType), T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            rows = [enc.encode(x) for x in b.column(1).to_pylist()]
            offsets = np.zeros(len(rows) + 1, dtype=np.int32)
            np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
            values = pa.array(np.frombuffer(b"".join(rows), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=[key, ids])

    return df.select(key, text).mapInArrow(run, schema)


def count_tokens(df: DataFrame, keep: list[str], text: str, vocabulary: str = VOCABULARY, out: str = "n_tokens") -> DataFrame:
    """``keep`` columns and the token count of each text (0 for null and empty)."""
    schema = T.StructType([*[df.schema[k] for k in keep], T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            n = pa.array([len(enc.encode(x)) // 4 for x in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], n], names=[*keep, out])

    return df.select(*keep, df[text].alias("_text")).mapInArrow(run, schema)
