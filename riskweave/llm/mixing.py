"""Mixing sources to target shares by systematic sampling.

Per source the expected copies of a document are the same number r; their
prefix sum over the source's documents in order of size, moved by one random
offset, crosses an integer boundary once per copy. A document therefore appears
floor(r) or ceil(r) times, never more than the source's cap, and every stretch
of sizes contributes its part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from riskweave.llm.bpe import VOCABULARY, count_tokens
from riskweave.runtime import Cuts

#: A share counts as reached within this relative distance of its target.
TOLERANCE = 0.01

PLAN = T.StructType(
    [T.StructField("source", T.StringType()), T.StructField("docs", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("cap", T.IntegerType())]
    + [T.StructField("total", T.DoubleType()), T.StructField("copies", T.DoubleType()), T.StructField("reachable", T.BooleanType())]
)


def fill(rows: list[dict], total: float) -> dict[str, float]:
    """Copies per document of each source so that the whole comes to ``total``.

    A source whose need exceeds its cap is held there, and the others make up
    for it in proportion to their targets, until no further one exceeds its
    cap. What all caps together cannot give stays missing.
    """
    held: dict[str, float] = {r["source"]: 0.0 for r in rows if not (r["tokens"] and r["target"] > 0 and r["cap"] > 0)}
    while True:
        free = [r for r in rows if r["source"] not in held]
        rest = total - sum(held[r["source"]] * r["tokens"] for r in rows if r["source"] in held)
        weight = sum(r["target"] for r in free)
        over = [r for r in free if rest * r["target"] / weight > r["cap"] * r["tokens"] * (1 + 1e-12)]
        if not over:
            return held | {r["source"]: rest * r["target"] / weight / r["tokens"] for r in free}
        held |= {r["source"]: float(r["cap"]) for r in over}


def plan_mix(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """One row per target source: source, docs, tokens, target, cap, total, copies, reachable.

    ``total`` is the wanted size in tokens; by default that of the corpus, all
    sources of ``sizes`` together. A source that cannot give its target's share
    of it within its cap, or has no tokens, is not reachable; others make up for
    it (see ``fill``). Sources without target contribute nothing. The targets
    are a bounded list and are planned on the driver; of repeated rows of a
    source the greatest target and cap count.
    """
    t = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("pc_alvo").alias("target"), F.max("qt_max_repeticoes").alias("cap"))
    if total is None:
        total = float(sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])  # one number
    rows = [r.asDict() for r in t.join(sizes, "source", "left").select("source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("docs", "tokens")], F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("cap", F.lit(0)).alias("cap")).collect()]
    copies = fill(rows, total)
    out = [(r["source"], r["docs"], r["tokens"], float(r["target"]), r["cap"], total, copies[r["source"]], r["target"] == 0 or 0 < r["target"] * total <= r["cap"] * r["tokens"] * (1 + 1e-12)) for r in rows]
    return sizes.sparkSession.createDataFrame(out, PLAN)


def draw(docs: DataFrame, plan: DataFrame, key: str, size: str, seed: int = 11) -> DataFrame:
    """(key, source, size, copies): documents that appear at least once.

    Order within a source: size, then hash of the key, then key. Documents are
    divided by range of this order, so a source of any size is spread; a
    document's rank is that in its range plus the documents of the source in
    the ranges before (one small row per range and source). A null source takes
    part in nothing; equal rows are exchangeable.
    """
    p = plan.where(F.col("copies") > 0).select("source", F.col("copies").alias("_r"))
    # one row per target source
    x = docs.join(F.broadcast(p), "source").withColumn("_h", F.xxhash64(F.lit(seed), key))
    order = [F.col("source"), F.col(size), F.col("_h"), F.col(key)]
    cuts = Cuts(docs.sparkSession, "draw")
    x = cuts.put(x.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    counts = x.groupBy("source", "_p").agg(F.count(F.lit(1)).alias("_n"))
    # at most one row per range and one more per source
    starts = counts.select("source", "_p", (F.sum("_n").over(W.partitionBy("source").orderBy("_p")) - F.col("_n")).alias("_start"))
    x = x.join(F.broadcast(starts), ["source", "_p"])
    rank = F.col("_start") + F.row_number().over(W.partitionBy("_p", "source").orderBy(*order[1:]))
    u = (F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), "source"), F.lit(1 << 30)) / float(1 << 30)).alias("_u")
    x = x.select(key, "source", size, "_r", rank.alias("_k"), u)
    copies = (F.floor(F.col("_k") * F.col("_r") + F.col("_u")) - F.floor((F.col("_k") - 1) * F.col("_r") + F.col("_u"))).cast("int")
    return x.select(key, "source", size, copies.alias("copies")).where(F.col("copies") > 0)


class Mix:
    """Sizes, plan and draw of one corpus; the token counts are computed once."""

    def __init__(self, documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, total: float | None = None, seed: int = 11):
        cuts = Cuts(documents.sparkSession, "mix")
        self.docs = cuts.put(count_tokens(documents, ["doc_id", "source"], "text", vocabulary))
        sizes = self.docs.where(F.col("source").isNotNull()).groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))
        self.plan = plan_mix(sizes, targets, total)
        self.drawn = draw(self.docs, self.plan, "doc_id", "n_tokens", seed)

    def shares(self) -> DataFrame:
        """source, pc_alvo, qt_max_repeticoes, docs, tokens, copies, max_copies, tokens_drawn, alcancavel, pc_total, pc_real, atingido.

        ``alcancavel`` says whether the source can give its target of the wanted
        size; ``pc_total`` is the share of that size it gives, ``pc_real`` that
        of what was drawn, ``atingido`` whether that is its target.
        """
        got = self.drawn.groupBy("source").agg(F.sum("copies").alias("drawn"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens_drawn"), F.max("copies").alias("most"))
        j = self.plan.join(F.broadcast(got), "source", "left")
        j = j.select("source", F.col("target").alias("pc_alvo"), F.col("cap").alias("qt_max_repeticoes"), "docs", "tokens", F.coalesce("drawn", F.lit(0)).alias("copies"), F.coalesce("most", F.lit(0)).alias("max_copies"), F.coalesce("tokens_drawn", F.lit(0)).alias("tokens_drawn"), F.col("reachable").alias("alcancavel"), F.when(F.col("total") > 0, F.coalesce("tokens_drawn", F.lit(0)) / F.col("total")).otherwise(0.0).alias("pc_total"))
        all_drawn = F.sum("tokens_drawn").over(W.partitionBy(F.lit(1)))  # one row per source
        j = j.withColumn("pc_real", F.when(all_drawn > 0, F.col("tokens_drawn") / all_drawn).otherwise(0.0))
        return j.withColumn("atingido", F.abs(F.col("pc_real") - F.col("pc_alvo")) <= TOLERANCE * F.col("pc_alvo"))
