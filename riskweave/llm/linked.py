"""Records and pairs shared by the linkers of addresses and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.runtime import apart


def message_records(cards: DataFrame, prefix: str, column: str) -> DataFrame:
    """rec, text: one record per message; of copies that differ the first loaded with a text counts."""
    first = F.min(F.struct("dt_crga", F.col(column).alias("text"))).alias("_m")
    m = cards.where(F.col(column).isNotNull() & F.col("qt_cnar_ordm").isNotNull()).groupBy("qt_cnar_ordm").agg(first)
    return m.select(F.concat(F.lit(prefix), F.col("qt_cnar_ordm").cast("string")).alias("rec"), F.col("_m.text").alias("text"))


def latest_stores(hub: DataFrame, *columns: str) -> DataFrame:
    """rec and the columns of each store's row of greatest CD_MES, then greatest DT_CRGA; ties by the columns."""
    last = F.max(F.struct("CD_MES", "DT_CRGA", *columns)).alias("_m")
    return hub.where(F.col("NU_EC").isNotNull()).groupBy("NU_EC").agg(last).select(F.concat(F.lit("EC:"), F.col("NU_EC").cast("string")).alias("rec"), *[F.col(f"_m.{c}").alias(c) for c in columns])


def lookup(forms: DataFrame, looks: Column, index: DataFrame) -> DataFrame:
    """fid, lo, hi: least and greatest entity among all that a form's keys name; equal where it is one.

    ``index`` is (k, lo, hi), one row per key, so a form meets as many rows as
    it has keys, however many entities share one.
    """
    keys = forms.select("fid", F.explode(looks).alias("k"))
    return apart(keys).join(index, "k").groupBy("fid").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def index_of(entities: DataFrame, emits: Column, entity: str = "e") -> DataFrame:
    """k, lo, hi of the keys that entities are found under."""
    return entities.select(F.explode(emits).alias("k"), F.col(entity).alias("_e")).groupBy("k").agg(F.min("_e").alias("lo"), F.max("_e").alias("hi"))


def differing_pairs(records: DataFrame, texts: DataFrame, group: str, form: list[str]) -> DataFrame:
    """rec_a, rec_b: records of one group whose texts differ.

    ``texts`` holds each form of a text once, with its group. Texts meet texts
    and are then expanded to their records, so copies of one text never meet
    one another and the work is that of the result.
    """
    t = texts.select(F.col(group).alias("_g"), *form)
    side = lambda s: t.select("_g", *[F.col(c).alias(f"{c}{s}") for c in form])
    met = apart(side("1")).join(side("2"), "_g").where(F.col("text1") < F.col("text2")).drop("_g")
    r = records.select("rec", *form)
    for s in "12":
        met = apart(met).join(r.select(F.col("rec").alias(f"rec{s}"), *[F.col(c).alias(f"{c}{s}") for c in form]), [f"{c}{s}" for c in form]).drop(*[f"{c}{s}" for c in form])
    return met.select(F.least("rec1", "rec2").alias("rec_a"), F.greatest("rec1", "rec2").alias("rec_b"))
