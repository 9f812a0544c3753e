"""One form for texts that look the same.

Look-alike classes are built by union-find over strings and code points: width
forms, ligatures, kinds of blank, unseen characters and letters of another
script. Each class is represented by its most frequent member in the corpus;
an automaton over all members rewrites texts greedily (leftmost, longest).
Accents are brought apart first and joined again at the end in the corpus'
usual way, so both ways of writing compare equal.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.runtime import Cuts

# Letters of other scripts that are drawn like a Latin letter.
DRAWN_ALIKE = {
    "A": "ΑАᎪ", "B": "ΒВᏴ", "C": "СϹⅭ", "D": "Ꭰ", "E": "ΕЕᎬ", "H": "ΗНᎻ", "I": "ΙІӀ", "J": "ЈᎫ", "K": "ΚКᏦ", "L": "Ꮮ",
    "M": "ΜМᎷ", "N": "Ν", "O": "ΟОՕ", "P": "ΡРᏢ", "Q": "Ԛ", "S": "ЅՏᏚ", "T": "ΤТᎢ", "V": "ᏙѴ", "W": "ԜᎳ", "X": "ΧХ", "Y": "ΥҮУ", "Z": "ΖᏃ",
    "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "h": "һհ", "i": "і", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "οоօ", "p": "р", "q": "ԛ",
    "s": "ѕ", "u": "ս", "v": "νѵ", "w": "ԝ", "x": "х", "y": "у",
}

# Unseen characters outside category Cf.
UNSEEN = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10)]
# Characters of category Cf that are drawn.
SEEN_FORMAT = [*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD]
_ZWJ = "‍"


class UnionFind:
    """Disjoint classes over strings."""

    def __init__(self):
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def classes(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.up:
            out.setdefault(self.find(x), []).append(x)
        return [sorted(v) for v in out.values() if len(v) > 1]


def lookalike_classes() -> list[list[str]]:
    """Transitive classes over strings and code points; "" stands for unseen."""
    uf = UnionFind()
    for cp in range(0x80, 0x110000):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind == "Cf" and cp not in SEEN_FORMAT:
            uf.union(c, "")
        elif kind == "Zs":
            uf.union(c, " ")
        elif kind != "Cn":
            d = unicodedata.decomposition(c)
            if d.startswith(("<wide>", "<narrow>")):
                uf.union(c, unicodedata.normalize("NFD", "".join(chr(int(x, 16)) for x in d.split()[1:])))
            elif d.startswith("<noBreak>") or (kind == "Nl" and d.startswith("<compat>")):
                parts = "".join(chr(int(x, 16)) for x in d.split()[1:])  # blanks apart: hyphens that do not break, numerals drawn as one letter
                if len(parts) == 1:
                    uf.union(c, parts)
            elif d.startswith("<compat>") and "LIGATURE" in unicodedata.name(c, ""):
                parts = "".join(chr(int(x, 16)) for x in d.split()[1:])
                if len(parts) > 1 and parts.isalpha():
                    uf.union(c, unicodedata.normalize("NFD", unicodedata.normalize("NFKC", parts)))
    for cp in UNSEEN:
        uf.union(chr(cp), "")
    for latin, others in DRAWN_ALIKE.items():
        for o in others:
            uf.union(latin, o)
    return uf.classes()


def code_point_counts(df: DataFrame, text: str) -> DataFrame:
    """(cp, n): how often each code point occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, dtype=np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                if x:
                    cps = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                    n = np.bincount(cps)
                    total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cp", "n"])

    schema = T.StructType([T.StructField("cp", T.IntegerType()), T.StructField("n", T.LongType())])
    return df.select(text).mapInArrow(run, schema).groupBy("cp").agg(F.sum("n").alias("n"))


SCRIPTS = ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "CHEROKEE")


def script(c: str) -> str | None:
    """The script of a letter, of those that share drawn letters."""
    name = unicodedata.name(c, "")
    return next((s for s in SCRIPTS if name.startswith(s + " ")), None)


class WordScripts:
    """Brings the shared letters of a word to one script.

    Possible is a script that has every letter of the word, its own or shared
    ones; of several the one most frequent in the corpus. The choice rests on
    the look alone, so words that look the same stay equal.
    """

    def __init__(self, classes: list[list[str]], representative: dict[str, str], counts: dict[int, int]):
        self.to: dict[str, dict[str, str]] = {}
        for members in classes:
            letters = {s: m for m in reversed(members) if len(m) == 1 and (s := script(m))}
            if len(letters) > 1:
                self.to[representative[members[0]]] = letters
        shared = {m for members in classes for m in members if len(m) == 1}
        self.own = {chr(cp): s for cp in (*range(0x41, 0x250), *range(0x370, 0x590), *range(0x13A0, 0x1400)) if (s := script(chr(cp))) and chr(cp) not in shared}
        weight = dict.fromkeys(SCRIPTS, 0)
        for cp, n in counts.items():
            if s := script(chr(cp)):
                weight[s] += n
        self.order = sorted(SCRIPTS, key=lambda s: -weight[s])
        first = self.order[0]
        if all(first in v for v in self.to.values()):
            # only words with another script's own letter, or a shared letter that stands in another script, change
            odd = re.escape("".join([*[c for c, s in self.own.items() if s != first], *[c for c in self.to if script(c) != first]]))
            self.some = re.compile(f"[{odd}]")
            self.word = re.compile(rf"(?<![^\W\d_])[^\W\d_]*?[{odd}](?:[^\W\d_]|[\u0300-\u036f])*")
        else:
            self.some = None
            self.word = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*")

    def _one(self, m: re.Match) -> str:
        w = m[0]
        possible = set(SCRIPTS)
        for c in w:
            if c in self.own:
                possible &= {self.own[c]}
            elif c in self.to:
                possible &= self.to[c].keys()
        kind = next((s for s in self.order if s in possible), None)
        return w if kind is None else "".join(self.to[c][kind] if c in self.to else c for c in w)

    def __call__(self, text: str) -> str:
        return text if self.some and not self.some.search(text) else self.word.sub(self._one, text)


class Rewriter:
    """Rewrites a text to its one form, given corpus counts of code points."""

    def __init__(self, counts: dict[int, int]):
        import ahocorasick

        moved: list[str] = []
        first = ahocorasick.Automaton()
        freq = lambda s: min((counts.get(ord(c), 0) for c in s), default=1 << 62)
        classes, representative = lookalike_classes(), {}
        for members in classes:
            best = min(members, key=lambda s: (-freq(s), len(s), s))
            representative |= dict.fromkeys(members, best)
            for m in members:
                if m and m != best:
                    first.add_word(m, (len(m), best))
                    moved += [m] if m.isascii() else []
        # a joiner between drawn symbols changes the picture: it stays
        for cp in counts:
            if unicodedata.category(chr(cp)) == "So":
                first.add_word(_ZWJ + chr(cp), (2, _ZWJ + chr(cp)))
        first.make_automaton()
        second = ahocorasick.Automaton()
        for cp, k in counts.items():
            c = chr(cp)
            apart = unicodedata.normalize("NFD", c)
            if len(apart) > 1 and unicodedata.normalize("NFC", apart) == c and k >= min(counts.get(ord(x), 0) for x in apart[1:]):
                second.add_word(apart, (len(apart), c))
        self.joins = len(second) > 0
        if self.joins:
            second.make_automaton()
        self.first, self.second = first, second
        self.scripts = WordScripts(classes, representative, counts)
        # ASCII letters that stand for their class elsewhere come back in a Latin word
        self.simple = self.scripts.order[0] == "LATIN" and all(self.scripts.to.get(representative[m], {}).get("LATIN") == m for m in moved)

    @staticmethod
    def _apply(a, text: str) -> str:
        out, at = [], 0
        for end, (length, best) in a.iter_long(text):
            start = end - length + 1
            if start > at:
                out.append(text[at:start])
            out.append(best)
            at = end + 1
        if not at:
            return text
        out.append(text[at:])
        return "".join(out)

    def __call__(self, text: str) -> str:
        if self.simple and text.isascii():
            return text
        t = self._apply(self.first, unicodedata.normalize("NFD", text))
        t = self.scripts(unicodedata.normalize("NFD", t))  # marks around removed characters come into order
        return self._apply(self.second, t) if self.joins else t


_REWRITERS: dict[tuple, Rewriter] = {}


def _rewriter(key: tuple[tuple[int, int], ...]) -> Rewriter:
    if key not in _REWRITERS:
        _REWRITERS.clear()
        _REWRITERS[key] = Rewriter(dict(key))
    return _REWRITERS[key]


def corpus_counts(df: DataFrame, text: str) -> tuple[tuple[int, int], ...]:
    """Counts of all code points that occur: at most 0x110000 numbers, whatever the corpus."""
    return tuple(sorted((r[0], r[1]) for r in code_point_counts(df, text).collect()))


def one_form(df: DataFrame, key: str, text: str, out: str = "text", keys_only: bool = False, counts: tuple | None = None) -> DataFrame:
    """(key, out) of every row; with ``keys_only`` 128-bit keys of the raw text and of its form.

    A null text stays null. Texts are rewritten whole; repeated rows stay
    repeated; an empty table gives no rows.
    """
    counts = corpus_counts(df, text) if counts is None else counts
    names = [key, "raw_key", "form_key"] if keys_only else [key, out]
    kind = T.BinaryType() if keys_only else T.StringType()
    schema = T.StructType([df.schema[key], *[T.StructField(n, kind) for n in names[1:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = _rewriter(counts)
        digest = lambda s: hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for b in batches:
            texts = b.column(1).to_pylist()
            forms = [None if x is None else form(x) for x in texts]
            if keys_only:
                raw = [None if x is None else digest(x) for x in texts]
                cols = [pa.array(raw, pa.binary()), pa.array([r if f is x else None if f is None else digest(f) for x, f, r in zip(texts, forms, raw)], pa.binary())]
            else:
                cols = [pa.array(forms, pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=names)

    return df.select(key, text).mapInArrow(run, schema)


def same_look(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, raw_key, form_key): one row per text that is not null; form_key is its class."""
    return one_form(df, key, text, keys_only=True).where(F.col("form_key").isNotNull())


def look_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, form_key, n_texts, n_docs): each text with its class, the class's different strings and its texts."""
    k = Cuts(df.sparkSession, "look").put(same_look(df, key, text))
    n = k.groupBy("form_key", "raw_key").agg(F.count(F.lit(1)).alias("d")).groupBy("form_key").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("d").alias("n_docs"))
    return k.join(n, "form_key").select(key, F.hex("form_key").alias("form_key"), "n_texts", "n_docs")


def same_look_pairs(df: DataFrame, key: str, text: str, a: str, b: str) -> DataFrame:
    """Pairs of different texts that look the same (a < b).

    The different strings of a class meet once each and are then expanded to
    their texts, so exact copies never meet one another and the work is that of
    the result.
    """
    k = Cuts(df.sparkSession, "look").put(same_look(df, key, text))
    strings = k.select("form_key", "raw_key").distinct()
    mixed = strings.groupBy("form_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("form_key")
    s = strings.join(mixed, "form_key")
    met = s.select("form_key", F.col("raw_key").alias("_x")).join(s.select("form_key", F.col("raw_key").alias("_y")), "form_key").where("_x < _y").select("_x", "_y")
    doc = k.join(mixed, "form_key", "left_semi").select("raw_key", F.col(key).alias("_d"))
    met = met.join(doc.select(F.col("raw_key").alias("_x"), F.col("_d").alias("_dx")), "_x").join(doc.select(F.col("raw_key").alias("_y"), F.col("_d").alias("_dy")), "_y")
    return met.select(F.least("_dx", "_dy").alias(a), F.greatest("_dx", "_dy").alias(b))
