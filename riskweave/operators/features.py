"""Feature tables per store: months, cards, payments, advances, graph."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators.relational import latest_snapshot


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def month_features(hub: DataFrame, industry_limit: int = 11) -> DataFrame:
    """15 features per store from its last month and its history; ratios divide by at least 1."""
    keep = ["VL_FTRM", "PC_FTRM_CNP", "PC_CHRG", "PC_CANC", "VL_TCKT_MEDO", "QT_DIAS_AFLC", "VL_ANTP_ARV", "IN_SOCO_PEP", "IN_ALTR_QDRO_SCTR", "DC_ALRT_CPTO", "DC_STCO_SOCO_RCTA", "TIPO_CLNT", "CD_RMAT"]
    last = latest_snapshot(hub, "NU_EC", "CD_MES", "DT_CRGA", keep)
    past = hub.groupBy("NU_EC").agg(F.avg("VL_FTRM").alias("_mean"), F.stddev_samp("VL_FTRM").alias("_dev"))
    mean = F.greatest("_mean", F.lit(1.0))
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return last.join(past, "NU_EC").select(
        F.col("NU_EC").alias("nu_ec"), _zero("VL_FTRM").alias("turnover"), (_zero("VL_FTRM") / mean).alias("turnover_to_mean"), (F.coalesce("_dev", F.lit(0.0)) / mean).alias("turnover_cv"),
        _zero("PC_FTRM_CNP").alias("cnp_pct"), _zero("PC_CHRG").alias("chargeback_pct"), _zero("PC_CANC").alias("cancel_pct"), _zero("VL_TCKT_MEDO").alias("ticket"), _zero("QT_DIAS_AFLC").alias("age_days"),
        (_zero("VL_ANTP_ARV") / F.greatest("VL_FTRM", F.lit(1.0))).alias("advance_pct"), _zero("IN_SOCO_PEP").alias("pep"), _zero("IN_ALTR_QDRO_SCTR").alias("ownership_change"),
        flag(F.col("DC_ALRT_CPTO") != "SEM ALERTA").alias("alert"), flag(F.col("DC_STCO_SOCO_RCTA") != "REGULAR").alias("irregular_partner"), flag(F.col("TIPO_CLNT") == "E-COMMERCE").alias("ecommerce"),
        flag(F.col("CD_RMAT") >= industry_limit).alias("high_risk_industry"),
    )


CARD_FLAGS = ("night", "below_limit", "round_amount", "prepaid", "not_present", "rule_fired")


def card_features(cards: DataFrame, home: str = "076") -> DataFrame:
    """9 features per store; cards has the flags, ``score`` and ``card_country``."""
    return cards.groupBy("nu_ec").agg(F.count(F.lit(1)).cast("double").alias("card_count"), *[F.avg(F.col(c).cast("int")).alias(f"{c}_rate") for c in CARD_FLAGS], F.avg("score").alias("score_mean"), F.avg((F.col("card_country") != home).cast("int")).alias("foreign_rate"))


def payment_features(payments: DataFrame, young_days: int = 90) -> DataFrame:
    """3 features per store: payments, mean mule marks, rate of accounts younger than ``young_days``."""
    return payments.groupBy("nu_ec").agg(F.count(F.lit(1)).cast("double").alias("payment_count"), F.avg("mule_marks").alias("mule_marks_mean"), F.avg((F.col("account_days") < young_days).cast("int")).alias("young_account_rate"))


def advance_features(advances: DataFrame) -> DataFrame:
    return advances.groupBy("nu_ec").agg(F.count(F.lit(1)).cast("double").alias("advance_count"))


def base_table(stores: DataFrame, tables: Sequence[DataFrame], key: str = "nu_ec") -> DataFrame:
    """Stores with every feature table joined by key; a missing number is 0. Each table has one row per key."""
    out = stores
    for t in tables:
        out = out.join(t, key, "left")
    numbers = [f.name for f in out.schema if f.name != key and f.dataType.typeName() in ("double", "float", "long", "integer", "bigint", "int")]
    return out.fillna(0, numbers)


#: Features that use the labels of other stores.
NEIGHBOR_LABEL = ("others_flagged_component", "others_flagged_community", "distance", "flagged_neighbor_rate", "shares_partner_flagged")


def feature_groups(tabular: Sequence[str], graph: Sequence[str], component: str = "component") -> dict[str, list[str]]:
    """The named groups models are compared over: tabular, tabular and graph, graph without others' labels."""
    g = [c for c in graph if c != component]
    return {"A_tabular": list(tabular), "B_tabular_graph": [*tabular, *g], "C_structural": [*tabular, *[c for c in g if c not in NEIGHBOR_LABEL]]}


def class_means(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    return df.groupBy(label).agg(*[F.round(F.avg(c), 3).alias(c) for c in features])


def component_statistics(members: DataFrame) -> DataFrame:
    """Per component of (id, component, type, root, flagged): size, stores, roots, flagged."""
    store = F.col("type") == "LOJA"
    return members.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum(store.cast("int")).alias("stores"), F.countDistinct(F.when(store, F.col("root"))).alias("roots"), F.sum(F.coalesce("flagged", F.lit(0))).alias("flagged_stores"))


def store_components(members: DataFrame) -> DataFrame:
    """Per store: its component's statistics and how many *other* stores there are flagged."""
    s = component_statistics(members)
    own = members.where("type = 'LOJA'").select(F.col("id").alias("store"), "component", F.coalesce("flagged", F.lit(0)).alias("_own"))
    return own.join(s, "component").select("store", "component", "size", "stores", "roots", (F.col("flagged_stores") - F.col("_own")).alias("others_flagged"))


def owner_lift(owners: DataFrame, values: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per store the greatest value among its owners: owners is (store, owner), values has ``id``."""
    v = values.select(F.col("id").alias("owner"), *columns)
    return owners.join(v, "owner", "left").groupBy("store").agg(*[F.max(c).alias(c) for c in columns])


def assemble(stores: DataFrame, parts: Mapping[str, DataFrame], far: int = 99) -> DataFrame:
    """One row per store over all graph features; missing ones 0, a missing distance ``far``."""
    out = stores
    for p in parts.values():
        out = out.join(p, "store", "left")
    out = out.fillna(0)
    return out.withColumn("distance", F.when(F.col("distance") == 0, far).otherwise(F.col("distance"))) if "distance" in out.columns else out
