"""Groups of records linked directly or through others, by random contraction.

Each round every vertex hooks to the neighbour (or itself) of least fresh hash,
edges are relabelled and deduplicated, and loops vanish; the expected number of
vertices falls by a constant factor. At the end the rounds' mappings, whose
sizes fall geometrically, are expanded from the last to the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.runtime import Cuts


def contract(edges: DataFrame, src: str = "a", dst: str = "b", seed: int = 7, max_rounds: int = 200) -> DataFrame:
    """(v, root): every vertex of ``edges`` with one vertex that stands for its component.

    Null endpoints are dropped; a row that links a vertex with itself still
    makes it a vertex. Direction and repeats do not matter. Hooking is a partial
    aggregate, so a vertex with a third of all edges is no hot task; the
    relabelling joins are inner joins, which adaptive execution splits on skew.
    """
    spark = edges.sparkSession
    cuts = Cuts(spark, "contract")
    e = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("a"), F.col(dst).alias("b"))
    e = cuts.put(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    hooks: list[DataFrame] = []
    first = True
    for n in range(max_rounds):
        h = lambda c: F.struct(F.xxhash64(F.lit(seed * 1000 + n), c).alias("h"), c.alias("v"))
        both = e.select(F.col("a").alias("v"), F.col("b").alias("w")).unionAll(e.select(F.col("b").alias("v"), F.col("a").alias("w")))
        # the least hash over the closed neighbourhood
        best = both.groupBy("v").agg(F.min(h(F.col("w"))).alias("_w")).select("v", F.least(F.col("_w"), h(F.col("v"))).alias("_w"))
        hook = cuts.put(best.select("v", F.col("_w.v").alias("root")))
        hooks.append(hook)
        rel = e.join(hook.select(F.col("v").alias("a"), F.col("root").alias("_a")), "a").join(hook.select(F.col("v").alias("b"), F.col("root").alias("_b")), "b")
        nxt = rel.where(F.col("_a") != F.col("_b")).select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()
        nxt = cuts.put(nxt)
        cuts.drop(e)
        e, first = nxt, False
        if e.isEmpty():
            break
    else:
        raise RuntimeError("contraction did not end")
    out = hooks[-1]
    for hook in reversed(hooks[:-1]):
        # vertices that vanish in this round follow their hook's later root; hooks of the last rounds are small
        out = hook.join(out.select(F.col("v").alias("root"), F.col("root").alias("_r")), "root", "left").select("v", F.coalesce("_r", "root").alias("root"))
    return out


def identity_groups(identity: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cpf_cnpj, cpf_cnpj_grupo): each document with the least document of its group.

    Linked are the two documents of a pair and documents that share a non-null
    id_identidade in any row. An identifier is a vertex of its own, so a shared
    one makes a star, not all pairs. Null documents are no records.
    """
    ident = identity.where(F.col("cpf_cnpj").isNotNull()).select(F.concat(F.lit("D"), "cpf_cnpj").alias("a"), F.coalesce(F.concat(F.lit("I"), F.col("id_identidade").cast("string")), F.concat(F.lit("D"), "cpf_cnpj")).alias("b"))
    a, b = (F.coalesce(F.col(x), F.col(y)) for x, y in (("cpf_cnpj_a", "cpf_cnpj_b"), ("cpf_cnpj_b", "cpf_cnpj_a")))
    matches = pairs.where(a.isNotNull()).select(F.concat(F.lit("D"), a).alias("a"), F.concat(F.lit("D"), b).alias("b"))
    root = contract(ident.unionByName(matches))
    docs = root.where(F.col("v").startswith("D")).select(F.substring("v", 2, 1 << 30).alias("cpf_cnpj"), "root")
    low = docs.groupBy("root").agg(F.min("cpf_cnpj").alias("cpf_cnpj_grupo"))
    return docs.join(low, "root").select("cpf_cnpj", "cpf_cnpj_grupo")
