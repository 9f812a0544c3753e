"""One spelling for hand-typed words: MinHash candidates, verified, in stars.

Words are hashed over padded q-grams; bands and rows come from the collision
curve, so that words as alike as one typing error leaves them meet with the
stated recall while unlike words seldom do. A star is a frequent word with the
rarer words that are its misspellings; satellites hang on their center alone,
never on one another.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.runtime import Cuts, apart

#: Shortest word that may be a misspelling of another.
SHORTEST = 5
#: Added to the count of words that are never misspellings.
FIXED = 1 << 40
#: Candidates per word that the bands may bring in by chance.
BY_CHANCE = 200.0


def collision(similarity: float, bands: int, rows: int) -> float:
    """Chance that two sets of this Jaccard similarity share a band."""
    return 1 - (1 - similarity**rows) ** bands


def choose_bands(words: int, alike: float = 0.57, unlike: float = 0.12, recall: float = 0.92) -> tuple[int, int]:
    """(bands, rows) from the collision curve.

    Of words with one typing error nine in ten are as similar as ``alike`` or
    more, half of them 0.7 or more, so the recall over all is well above the
    ``recall`` demanded at ``alike``.

    For each number of rows the fewest bands that keep ``recall`` at similarity
    ``alike``; of these the first whose chance meetings at ``unlike`` stay below
    ``BY_CHANCE`` per word. The recall is the same at every size, only the
    number of hashes grows.
    """
    for rows in range(2, 9):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - alike**rows))
        if words * collision(unlike, bands, rows) <= BY_CHANCE:
            break
    return bands, rows


def _gram_codes(words: list[str], q: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the padded q-grams of all words on end, and where each word's begin."""
    points = [np.frombuffer(f"^{w}$".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) for w in words]
    sizes = np.array([len(p) - q + 1 for p in points])
    codes = np.concatenate([sum((p[i : len(p) - q + 1 + i] << np.uint64(21 * i) for i in range(1, q)), p[: len(p) - q + 1]) for p in points])
    return codes, np.concatenate([[0], np.cumsum(sizes)[:-1]])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def band_keys(words: list[str], bands: int, rows: int) -> np.ndarray:
    """MinHash band keys of each word (words x bands) over its padded q-grams."""
    codes, starts = _gram_codes(words)
    base = _mix(codes)
    out = np.empty((len(words), bands), dtype=np.int64)
    for b in range(bands):
        key = np.full(len(words), b + 1, dtype=np.uint64)
        for r in range(rows):
            least = np.minimum.reduceat((base ^ np.uint64((b * rows + r + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93), starts)
            key = _mix(key ^ least)
        out[:, b] = key.view(np.int64)
    return out


def with_band_keys(words: DataFrame, bands: int, rows: int) -> DataFrame:
    """(w, n) once per band with its key ``k``; the words are long enough to have q-grams.

    The vocabulary is spread over all cores first: it is small, its keys are many.
    """
    parts = max(words.sparkSession.sparkContext.defaultParallelism, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keys = band_keys(part.column(0).to_pylist(), bands, rows)
                again = pa.array(np.repeat(np.arange(part.num_rows), bands))
                yield pa.RecordBatch.from_arrays([*[c.take(again) for c in part.columns], pa.array(keys.ravel())], names=[*part.schema.names, "k"])

    return words.repartition(parts, "w").mapInArrow(run, T.StructType([*words.schema.fields, T.StructField("k", T.LongType())]))


def with_deletion_keys(words: DataFrame) -> DataFrame:
    """(w, n) once per deletion key ``k``."""
    return words.select("*", F.explode(deletion_keys(F.col("w"))).alias("k"))


def deletion_keys(word: Column) -> Column:
    """The word and the word less one letter at each place, hashed: one typing error shares a key for certain."""
    n = F.length(word)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n))))
    return F.array_distinct(F.concat(F.array(F.xxhash64(word)), cut))


def few_edits(a: Column, b: Column) -> Column:
    """Edits where they are at most a quarter of the longer word, else null."""
    d = F.levenshtein(a, b)
    return F.when(d * 4 <= F.greatest(F.length(a), F.length(b)), d)


def typing_errors(a: Column, b: Column) -> Column:
    """1 where one letter is wrong, missing, added or exchanged with its neighbour, else null.

    Two errors are not allowed: different family words are often as near as that.
    """
    d = F.levenshtein(a, b, 2)  # -1 above two
    letters = lambda c: F.array_sort(F.split(c, ""))
    return F.when(d.isin(0, 1) | ((d == 2) & (letters(a) == letters(b))), 1)


def stars(words: DataFrame, edges: DataFrame, cuts: Cuts) -> DataFrame:
    """(w, center, others) of every satellite.

    ``words`` is (w, n); ``edges`` is (a, b, nb, d): b is the more frequent
    word, ties by text, so edges run up a total order, d the edits between
    them. A word without a better neighbour is a center; its neighbours below
    become satellites of their nearest center, of these the most frequent
    (``others`` are equally near ones); a word all of whose better neighbours became satellites is
    a center again. The order has no circles, so each round settles at least
    the best unsettled word of every component.
    """
    done: list[DataFrame] = []
    e, last = edges, None
    while not e.isEmpty():
        below = e.select(F.col("a").alias("b")).distinct()
        hit = apart(e).join(below, "b", "left_anti")  # b has nothing better left: a center
        near = F.struct((-F.col("d")).alias("d"), F.col("nb").alias("n"), F.col("b").alias("w"))
        best = hit.groupBy("a").agg(F.max(near).alias("_t"), F.collect_set(F.struct("d", F.col("b").alias("w"))).alias("_s"))
        others = F.transform(F.filter("_s", lambda x: (x["d"] == -F.col("_t.d")) & (x["w"] != F.col("_t.w"))), lambda x: x["w"])
        sat = cuts.put(best.select(F.col("a").alias("w"), F.col("_t.w").alias("center"), others.alias("others")))
        done.append(sat)
        gone = sat.select(F.col("w").alias("a"))
        e = cuts.put(apart(apart(e).join(gone, "a", "left_anti")).join(gone.withColumnRenamed("a", "b"), "b", "left_anti"))
        if last is not None:
            cuts.drop(last)
        last = e
    out = done[0] if done else cuts.put(words.where(F.lit(False)).select("w", F.col("w").alias("center"), F.array("w").alias("others")))
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def misspellings(
    counts: DataFrame,
    cuts: Cuts,
    keyed: Callable[[DataFrame], DataFrame],
    near: Callable[[Column, Column], Column] = few_edits,
    fixed: Iterable[str] = (),
    rarer: float = 1.0,
) -> DataFrame:
    """(w, center, others) of the words that are misspellings of a more frequent word.

    ``counts`` is (w, n), one row per word. ``fixed`` words are never
    misspellings. A word seen more than twice joins only words seen at least
    ``rarer`` times as often. Words under ``SHORTEST`` letters are their own centers. Null
    words must be left out by the caller; an empty table gives no rows.
    """
    known = sorted(set(fixed))
    sure = F.col("w").isin(known) if known else F.lit(False)
    # one number for both: fixed words come before all others
    c = counts.where(F.length("w") >= SHORTEST).select("w", (F.col("n") + F.when(sure, FIXED).otherwise(0)).alias("n"))
    k = keyed(c)
    # both sides are one plan, so its exchange is written once
    lo, hi = (k.select("k", *[F.col(x).alias(x + s) for x in ("w", "n")]) for s in "ab")
    na, nb = F.col("na"), F.col("nb")
    above = (na < FIXED) & ((na <= 2) | (nb >= na * rarer)) & ((nb > na) | ((nb == na) & (F.col("wb") > F.col("wa"))))
    met = apart(lo).join(hi, "k").where(above & (F.abs(F.length("wa") - F.length("wb")) <= 3)).select(F.col("wa").alias("a"), F.col("wb").alias("b"), "nb")
    edges = cuts.put(met.withColumn("d", near(F.col("a"), F.col("b"))).where(F.col("d").isNotNull()).distinct())
    out = stars(counts, edges, cuts)
    cuts.drop(edges)
    return out
