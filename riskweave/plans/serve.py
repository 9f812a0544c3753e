"""Serving queries with bound parameters over queue, stores, features and graph.

Every limit follows a total order, so results do not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.sources.tables import serve

#: Relations that link stores and people.
LINKS = ("titular", "socio", "liquida_em", "localizada_em", "recebe_em", "paga_com", "tem_telefone", "tem_email", "usa_dispositivo")


def kpis(queue: DataFrame, features: DataFrame) -> DataFrame:
    """One row over the queue: stores, high, new suspects, flagged, suspicious groups."""
    g = features.select("nu_ec", "component", "stores", "roots")
    group = F.when((F.col("roots") >= 2) & (F.col("stores") >= 3), F.col("component"))
    return queue.join(g, "nu_ec").agg(
        F.count(F.lit(1)).alias("stores"), F.coalesce(F.sum((F.col("band") == "ALTO").cast("long")), F.lit(0)).alias("high"), F.coalesce(F.sum("new_suspect"), F.lit(0)).alias("new_suspects"),
        F.coalesce(F.sum("flagged"), F.lit(0)).alias("flagged"), F.countDistinct(group).alias("suspicious_groups"),
    )


QUEUE_TEXT = """
SELECT q.position, q.nu_ec, q.name, q.industry, round(q.score, 4) AS score, q.band, q.flagged, q.new_suspect, f.stores
FROM queue q JOIN features f ON f.nu_ec = q.nu_ec
WHERE (:band = '' OR q.band = :band) AND (:only_new = 'N' OR q.new_suspect = 1)
  AND (:sought = '' OR contains(lower(q.name), lower(:sought)) OR startswith(CAST(q.nu_ec AS STRING), :sought))
ORDER BY q.position LIMIT 200"""


def queue_filter(queue: DataFrame, features: DataFrame, band: str = "ALTO", only_new: str = "N", sought: str = "") -> DataFrame:
    """The prioritised queue by three optional parameters, first 200; the sought text is taken literally."""
    return serve(queue.sparkSession, QUEUE_TEXT, {"queue": queue, "features": features}, band=band, only_new=only_new, sought=sought)


CARD_TEXT = """
SELECT q.nu_ec, q.name, q.industry, q.position, round(q.score, 4) AS score, q.band, q.flagged, q.new_suspect, f.stores, f.roots, f.others_flagged
FROM queue q JOIN features f ON f.nu_ec = q.nu_ec WHERE q.nu_ec = :nu_ec"""


def merchant_card(queue: DataFrame, features: DataFrame, nu_ec: int) -> DataFrame:
    return serve(queue.sparkSession, CARD_TEXT, {"queue": queue, "features": features}, nu_ec=nu_ec)


def network(edges: DataFrame, vertices: DataFrame, store: str, hub_limit: int = 30, least_flow: float = 5000.0, most: int = 600) -> DataFrame:
    """The store's network in four expansions, its money flow, and both ends' attributes, first ``most`` rows by ends and relation.

    Level 1: the store's own links; 2: its people's links; 3: who shares these
    attributes (not those of more than ``hub_limit`` links); 4: stores of the
    people found. The id set stays a frame and joins by key.
    """
    link = edges.where(F.col("relation").isin(*LINKS)).select("src", "dst", "relation", "qty", "amount")
    one = link.where(F.col("src") == store)
    two = link.join(one.where(F.col("relation").isin("titular", "socio")).select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
    attributes = one.select("dst").union(two.select("dst")).distinct()
    few = link.join(attributes, "dst", "left_semi").groupBy("dst").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= hub_limit).select("dst")
    three = link.join(few, "dst", "left_semi").where(F.col("src") != store)
    four = link.where(F.col("relation").isin("titular", "socio")).join(three.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
    cols = ["src", "dst", "relation", "qty", "amount"]
    found = one.select(cols).union(two.select(cols)).union(three.select(cols)).union(four.select(cols)).distinct()
    nodes = found.select(F.col("src").alias("id")).union(found.select("dst")).distinct()
    flow = edges.where((F.col("relation") == "pix") & (F.col("amount") >= least_flow)).select(cols)
    flow = flow.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi").select(cols)
    out = found.unionByName(flow)
    for end in ("src", "dst"):
        v = vertices.select(F.col("id").alias(end), F.col("type").alias(f"{end}_type"), F.col("name").alias(f"{end}_name"), F.coalesce("flagged", F.lit(0)).alias(f"{end}_flagged"))
        out = out.join(v, end)
    return out.withColumn("amount", F.round("amount", 2)).orderBy("src", "dst", "relation").limit(most)


def band_by_industry(queue: DataFrame) -> DataFrame:
    """ALTO stores per industry: new suspects and flagged."""
    return queue.where("band = 'ALTO'").groupBy("industry").agg(F.sum((F.col("new_suspect") == 1).cast("long")).alias("new_suspects"), F.sum((F.col("flagged") == 1).cast("long")).alias("flagged"))


def top_high(queue: DataFrame, k: int = 60) -> DataFrame:
    return queue.where("band = 'ALTO'").orderBy("position").select("nu_ec", "name", F.round("score", 3).alias("score"), "new_suspect", "flagged").limit(k)


def new_suspects(queue: DataFrame, k: int = 10) -> DataFrame:
    return queue.where("new_suspect = 1").orderBy("position").select("position", "nu_ec", "name", "industry", F.round("score", 3).alias("score")).limit(k)


def shares_with_flagged(edges: DataFrame, vertices: DataFrame, relation: str) -> DataFrame:
    """store, flagged_store, shared: unflagged stores that share a target with a flagged one."""
    v = vertices.where("type = 'LOJA'").select(F.col("id").alias("src"), F.coalesce("flagged", F.lit(0)).alias("f"))
    e = edges.where(F.col("relation") == relation).select("src", "dst").join(v, "src")
    a = e.where("f = 0").select(F.col("src").alias("store"), F.col("dst").alias("shared"))
    b = e.where("f = 1").select(F.col("src").alias("flagged_store"), F.col("dst").alias("shared"))
    return a.join(b, "shared").select("store", "flagged_store", "shared").distinct()


def top_receivers(payments: DataFrame, queue: DataFrame, k: int = 20) -> DataFrame:
    """Who receives most from ALTO stores: payments, total, stores; first k by total, then receiver."""
    p = payments.join(queue.where("band = 'ALTO'").select("nu_ec"), "nu_ec", "left_semi").where("approved and receiver is not null")
    return p.groupBy("receiver").agg(F.count(F.lit(1)).alias("payments"), F.round(F.sum("amount"), 2).alias("total"), F.countDistinct("nu_ec").alias("stores")).orderBy(F.desc("total"), "receiver").limit(k)


def same_component(queue: DataFrame, features: DataFrame, nu_ec: int) -> DataFrame:
    """The other stores of a store's component."""
    f = features.select("nu_ec", "component")
    own = f.where(F.col("nu_ec") == nu_ec).select("component")
    return f.join(own, "component").where(F.col("nu_ec") != nu_ec).join(queue, "nu_ec").select("nu_ec", "name", "band", F.round("score", 3).alias("score"), "flagged")


#: Named filters and measures that queries may be composed from.
FILTERS = {"high": lambda: F.col("band") == "ALTO", "new": lambda: F.col("new_suspect") == 1, "flagged": lambda: F.col("flagged") == 1}
MEASURES = {"stores": lambda: F.countDistinct("nu_ec"), "paid": lambda: F.sum("amount")}

#: Declared joins: left table, right table, key, cardinality.
JOINS = [
    ("queue", "stores", "nu_ec", "one_to_one"), ("queue", "features", "nu_ec", "one_to_one"), ("stores", "payments", "nu_ec", "one_to_many"), ("stores", "cards", "nu_ec", "one_to_many"),
    ("stores", "advances", "nu_ec", "one_to_many"), ("stores", "reported", "nu_ec", "one_to_many"), ("stores", "identities", "document", "many_to_one"), ("edges", "vertices", "src", "many_to_one"),
]

#: Column comments of the served tables.
COLUMN_COMMENTS = {
    "queue": {"position": "rank in the queue, 1 is the highest score", "nu_ec": "store", "band": "ALTO, MEDIO or BAIXO", "new_suspect": "1 for ALTO stores not flagged", "flagged": "1 for confirmed stores", "score": "model score, 0 to 1"},
    "features": {"component": "link component of the store", "stores": "stores in the component", "roots": "tax roots in the component", "others_flagged": "other flagged stores in the component", "distance": "hops to the nearest other flagged store, 99 for none"},
    "edges": {"src": "source vertex", "dst": "target vertex", "relation": "kind of link", "qty": "events behind the edge", "amount": "money moved"},
    "vertices": {"id": "TYPE:value", "type": "kind of vertex", "name": "shown name", "root": "tax root", "flagged": "1 for confirmed stores"},
}


def comment_columns(df: DataFrame, table: str) -> DataFrame:
    """The frame with the comments of a served table in its column metadata."""
    return df.select(*[F.col(c).alias(c, metadata={"comment": COLUMN_COMMENTS[table][c]}) if c in COLUMN_COMMENTS.get(table, {}) else F.col(c) for c in df.columns])
