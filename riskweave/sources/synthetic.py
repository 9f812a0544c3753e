"""Seeded synthetic stores, people and planted rings, made on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _draw(seed: int, what: str, of: int, *keys: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), *keys), F.lit(of))


def soiled_document(doc: Column, key: Column, seed: int, masked: float = 0.3, short: float = 0.045, wrong: float = 0.009) -> Column:
    """A document as it is typed: masked, short of left zeros, with one digit wrong, or as it is."""
    u = _draw(seed, "soil", 1_000_000, key) / 1e6
    mask = F.regexp_replace(doc, r"^(\d{3})(\d{3})(\d{3})(\d{2})$", "$1.$2.$3-$4")
    bad = F.concat(F.substring(doc, 1, 4), ((F.substring(doc, 5, 1).cast("int") + 1) % 10).cast("string"), F.substring(doc, 6, 20))
    return F.when(u < masked, mask).when(u < masked + short, F.regexp_replace(doc, "^0+", "")).when(u < masked + short + wrong, bad).otherwise(doc)


def rings(spark: SparkSession, stores: int = 4000, people: int = 40_000, rings: int = 40, members: int = 3, seed: int = 42, days: int = 60) -> tuple[DataFrame, DataFrame]:
    """(stores, edges): background links and ``rings`` planted ones.

    Every store has an owner and an account. A ring's stores settle in one
    account, and its owners move money round a cycle of ``members`` people.
    All values are hashes of seed and key, so any number of executors makes the
    same rows.
    """
    s = spark.range(stores).select(
        F.concat(F.lit("LOJA:"), F.col("id").cast("string")).alias("id"), F.concat(F.lit("DOC:"), F.lpad(F.col("id").cast("string"), 11, "0")).alias("owner"),
        F.when(F.col("id") < rings * members, F.floor(F.col("id") / members)).alias("ring"), F.col("id").alias("n"),
    )
    at = lambda *k: F.timestamp_seconds(F.lit(1_756_684_800) + _draw(seed, "at", days * 86_400, *k))
    edge = lambda df, a, b, rel, amount, *k: df.select(a.alias("src"), b.alias("dst"), F.lit(rel).alias("relation"), F.lit(1).cast("long").alias("qty"), amount.cast("double").alias("amount"), at(F.lit(rel), *k).alias("ts_min"), at(F.lit(rel), *k).alias("ts_max"), F.col("ring"))
    account = F.concat(F.lit("CONTA:"), F.when(F.col("ring").isNotNull(), F.concat(F.lit("r"), F.col("ring").cast("string"))).otherwise(F.col("n").cast("string")))
    owns = edge(s, F.col("id"), F.col("owner"), "titular", F.lit(None), F.col("n"))
    settles = edge(s, F.col("id"), account, "liquida_em", _draw(seed, "settle", 50_000, F.col("n")) / 10, F.col("n"))
    doc = lambda c: F.concat(F.lit("DOC:"), F.lpad(c.cast("string"), 11, "0"))
    r = s.where("ring is not null").withColumn("next", F.col("ring") * members + (F.col("n") + 1) % members)
    cycle = edge(r, F.col("owner"), doc(F.col("next")), "pix", F.lit(10_000) + _draw(seed, "cycle", 900_000, F.col("n")) / 100, F.col("n"))
    p = spark.range(people).select(F.col("id").alias("n"), F.lit(None).cast("long").alias("ring"))
    flow = edge(p.withColumn("to", _draw(seed, "to", people, F.col("n"))).where("to <> n"), doc(F.col("n")), doc(F.col("to")), "pix", _draw(seed, "flow", 500_000, F.col("n")) / 100, F.col("n"))
    return s.drop("n"), owns.unionByName(settles).unionByName(cycle).unionByName(flow)
