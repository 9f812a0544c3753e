"""Probabilistic linkage of mentions: blocking, levels, prior, u, m, scores, clusters."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.standard import jaro_winkler
from riskweave.operators.iterate import connected_components
from riskweave.runtime import Cuts

BLOCKS = ("document", "phone", "name")
FIELDS = ("document", "name", "address", "phone", "email")
#: Levels of each comparison beside null (-1): greater is more alike.
LEVELS = {"document": 3, "name": 4, "address": 4, "phone": 2, "email": 2}


def mentions(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Identical mentions grouped: fields, sources, occurrences and a surrogate key.

    Each source has the five fields; rows without document are left out. The
    key hashes a struct, so it tells apart which field a value stands in.
    """
    out = None
    for name, df in sources.items():
        one = df.select(F.lit(name).alias("source"), *[F.col(f).cast("string").alias(f) for f in FIELDS])
        out = one if out is None else out.unionByName(one)
    g = out.where(F.col("document").isNotNull()).groupBy(*FIELDS).agg(F.array_sort(F.collect_set("source")).alias("sources"), F.count(F.lit(1)).alias("occurrences"))
    return g.withColumn("mention_id", F.sha2(F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"}), 256).substr(1, 16))


def blocked_pairs(m: DataFrame, key: str = "mention_id", blocks: Sequence[str] = BLOCKS) -> DataFrame:
    """id_l, id_r, block: pairs that agree in a block, each once under the first block that makes it.

    Equi-joins only. A pair of an earlier block is excluded by comparing that
    block's values, so no distinct over all pairs is needed. Hot values are
    split by adaptive skew handling; the pairs of a block are its result.
    """
    cols = lambda s: [F.col(key).alias(f"id_{s}"), *[F.col(b).alias(f"{b}_{s}") for b in blocks]]
    l, r = m.select(*cols("l")), m.select(*cols("r"))
    out = None
    for i, b in enumerate(blocks):
        j = l.join(r, F.col(f"{b}_l") == F.col(f"{b}_r")).where("id_l < id_r")
        for p in blocks[:i]:
            j = j.where(~F.coalesce(F.col(f"{p}_l") == F.col(f"{p}_r"), F.lit(False)))
        one = j.select("id_l", "id_r", F.lit(b).alias("block"))
        out = one if out is None else out.unionByName(one)
    return out


def _level(l: Column, r: Column, steps: Sequence[Column]) -> Column:
    """The greatest level whose condition holds, 0 where none, -1 where a side is null."""
    out = F.when(l.isNull() | r.isNull(), -1)
    for k, cond in enumerate(steps):
        out = out.when(cond, len(steps) - k)
    return out.otherwise(0)


def compared(pairs: DataFrame, m: DataFrame, key: str = "mention_id") -> DataFrame:
    """Pairs with their fields and a level per comparison (``g_<field>``).

    Names are compared once per distinct pair of different names.
    """
    side = lambda s: m.select(F.col(key).alias(f"id_{s}"), *[F.col(f).alias(f"{f}_{s}") for f in FIELDS])
    p = pairs.join(side("l"), "id_l").join(side("r"), "id_r")
    both = p.where("name_l <> name_r").select("name_l", "name_r").distinct().withColumn("jw", jaro_winkler("name_l", "name_r"))
    p = p.join(both, ["name_l", "name_r"], "left")
    c = lambda f: (F.col(f"{f}_l"), F.col(f"{f}_r"))
    eq = lambda f: c(f)[0] == c(f)[1]
    lev = lambda f, n: F.levenshtein(*c(f), n) >= 0
    return p.withColumns(
        {
            "g_document": _level(*c("document"), [eq("document"), lev("document", 1)]),
            "g_name": _level(*c("name"), [eq("name"), F.col("jw") >= 0.95, F.col("jw") >= 0.88]),
            "g_address": _level(*c("address"), [eq("address"), lev("address", 2), lev("address", 5)]),
            "g_phone": _level(*c("phone"), [eq("phone")]),
            "g_email": _level(*c("email"), [eq("email")]),
        }
    ).drop("jw")


def prior(m: DataFrame, rule: str = "document", recall: float = 0.9) -> DataFrame:
    """One row: mentions, rule_pairs, lambda - pairs that agree in the rule, over recall, over all pairs."""
    per = m.where(F.col(rule).isNotNull()).groupBy(rule).agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum(F.col("c") * (F.col("c") - 1) / 2), F.lit(0.0)).alias("rule_pairs"))
    n = m.agg(F.count(F.lit(1)).alias("mentions"))
    all_ = F.col("mentions") * (F.col("mentions") - 1) / 2
    return n.join(per, F.lit(True), "full").withColumn("lambda", F.when(all_ > 0, F.col("rule_pairs") / recall / all_))


def pattern_counts(p: DataFrame) -> DataFrame:
    """Rows per combination of levels: at most a few hundred rows, whatever the number of pairs."""
    return p.groupBy(*[f"g_{f}" for f in FIELDS]).agg(F.count(F.lit(1)).alias("n"))


def random_pairs(m: DataFrame, most: int = 2_000_000, seed: int = 17, key: str = "mention_id") -> DataFrame:
    """id_l, id_r: seeded random pairs, about ``most`` at the highest, for the u probabilities.

    Each mention meets the mentions of its draws: both sides are hashed into as
    many cells as give the wanted number of pairs, and meet within a cell only.
    A bounded documented sample, used for statistics alone.
    """
    n = m.count()
    draws = max(1, min(n - 1, most // max(n, 1)))
    # every mention draws a cell per turn; a cell holds about two mentions
    cells = max(1, n // 2)
    c = m.select(F.col(key).alias("id"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("t")).withColumn("cell", F.pmod(F.xxhash64(F.lit(seed), "t", "id"), F.lit(cells)))
    return c.withColumnRenamed("id", "id_l").join(c.withColumnRenamed("id", "id_r"), ["t", "cell"]).where("id_l < id_r").select("id_l", "id_r").distinct()


def estimate_u(p: DataFrame) -> dict[str, list[float]]:
    """Per field the share of each level among random pairs (null sides left out); never 0."""
    rows = pattern_counts(p).collect()  # a few hundred rows
    out = {}
    for f in FIELDS:
        n = [1e-6] * LEVELS[f]
        for r in rows:
            if r[f"g_{f}"] >= 0:
                n[r[f"g_{f}"]] += r["n"]
        out[f] = [x / sum(n) for x in n]
    return out


def estimate_m(p: DataFrame, u: Mapping[str, Sequence[float]], start: float, fixed: Sequence[str], rounds: int = 50) -> dict[str, list[float]]:
    """m probabilities by expectation maximisation over the level patterns of blocked pairs.

    Fields in ``fixed`` (the block) take no part. Only pattern counts leave the
    cluster, so the loop is independent of the number of pairs.
    """
    rows = [(tuple(r[f"g_{f}"] for f in FIELDS), r["n"]) for r in pattern_counts(p).collect()]
    free = [i for i, f in enumerate(FIELDS) if f not in fixed]
    m = {FIELDS[i]: [(k + 1) / sum(range(1, LEVELS[FIELDS[i]] + 1)) for k in range(LEVELS[FIELDS[i]])] for i in free}
    lam = start
    for _ in range(rounds):
        post, total = {f: [1e-6] * LEVELS[f] for f in m}, 0.0
        for g, n in rows:
            a, b = lam, 1 - lam
            for i in free:
                if g[i] >= 0:
                    a *= m[FIELDS[i]][g[i]]
                    b *= u[FIELDS[i]][g[i]]
            w = n * a / (a + b) if a + b > 0 else 0.0
            total += w
            for i in free:
                if g[i] >= 0:
                    post[FIELDS[i]][g[i]] += w
        lam = min(max(total / max(1, sum(n for _, n in rows)), 1e-9), 1 - 1e-9)
        m = {f: [x / sum(v) for x in v] for f, v in post.items()}
    return m


def combine(*estimates: Mapping[str, Sequence[float]]) -> dict[str, list[float]]:
    """Mean of the estimates a field has."""
    out = {}
    for f in FIELDS:
        have = [e[f] for e in estimates if f in e]
        if have:
            out[f] = [sum(x) / len(have) for x in zip(*have, strict=True)]
    return out


def scored(p: DataFrame, m: Mapping[str, Sequence[float]], u: Mapping[str, Sequence[float]], lam: float, least: float = 0.01) -> DataFrame:
    """Adds ``weight`` (log2 odds) and ``probability``; pairs below ``least`` are left out."""
    w = F.lit(math.log2(lam / (1 - lam)))
    for f in FIELDS:
        one = F.when(F.col(f"g_{f}") < 0, 0.0)
        for k in range(LEVELS[f]):
            one = one.when(F.col(f"g_{f}") == k, math.log2(m[f][k] / u[f][k]))
        w = w + one
    odds = F.pow(F.lit(2.0), F.least(F.col("weight"), F.lit(500.0)))
    return p.withColumn("weight", w).withColumn("probability", odds / (1 + odds)).where(F.col("probability") >= least)


def probability_histogram(s: DataFrame) -> DataFrame:
    return s.groupBy((F.floor(F.col("probability") * 10) / 10).alias("tenth")).agg(F.count(F.lit(1)).alias("pairs"))


def surprising(s: DataFrame) -> DataFrame:
    """Pairs to look at: sure matches of different documents, and one phone under different documents with a low score."""
    sure = s.where("document_l <> document_r and probability >= 0.9").withColumn("why", F.lit("other document"))
    odd = s.where("phone_l = phone_r and document_l <> document_r and probability < 0.5").withColumn("why", F.lit("same phone"))
    return sure.unionByName(odd)


def clusters(m: DataFrame, s: DataFrame, threshold: float = 0.9, key: str = "mention_id") -> DataFrame:
    """id, component over pairs of at least the threshold."""
    e = s.where(F.col("probability") >= threshold).select(F.col("id_l").alias("src"), F.col("id_r").alias("dst"))
    return connected_components(m.select(F.col(key).alias("id")), e)


def identities(m: DataFrame, c: DataFrame, key: str = "mention_id") -> DataFrame:
    """document, identity, name, documents_count, documents: each document under its most frequent component.

    Ties go to the least value. The count and list hold all documents that
    appear in the component.
    """
    j = Cuts(m.sparkSession, "identities").put(m.join(c.withColumnRenamed("id", key), key))
    doc = j.groupBy("document").agg(F.mode("component", True).alias("component"))
    comp = j.groupBy("component").agg(F.mode("name", True).alias("name"), F.countDistinct("document").alias("documents_count"), F.array_sort(F.collect_set("document")).alias("documents"))
    return doc.join(comp, "component").select("document", F.concat(F.lit("IDN:"), "component").alias("identity"), "name", "documents_count", "documents")


def identity_summary(i: DataFrame) -> DataFrame:
    return i.agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("identity").alias("identities"), F.countDistinct(F.when(F.col("documents_count") > 1, F.col("identity"))).alias("identities_of_several"))


def overmerged(i: DataFrame, valid: DataFrame) -> DataFrame:
    """identity, valid_documents: identities that hold two or more valid documents."""
    return i.join(valid.select("document").distinct(), "document").groupBy("identity").agg(F.count(F.lit(1)).alias("valid_documents")).where("valid_documents > 1")


def threshold_sweep(m: DataFrame, s: DataFrame, at: Sequence[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """threshold, identities per threshold."""
    out = None
    for t in at:
        one = clusters(m, s, t).agg(F.countDistinct("component").alias("identities")).select(F.lit(float(t)).alias("threshold"), "identities")
        out = one if out is None else out.unionByName(one)
    return out
