"""The pN queries of the general problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.documents import known_document
from riskweave.operators import delivery, history, instants, skew
from riskweave.queries_records import sql_valid
from riskweave.runtime import Cuts, read

HUB, CARDS, PIX = "tbciar_re_hub_dado_risc_cred", "tbciar_tr_lynx_trns_crto", "tbciar_tr_lynx_trns_pix"
HEAVY_SHARE = 0.03


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return history.store_history(read(spark, d, HUB)).select("nu_ec", "cd_mes_de", "cd_mes_ate")


def p1_history(spark: SparkSession, d: str) -> DataFrame:
    return history.store_history(read(spark, d, HUB))


def p1_documents(spark: SparkSession, d: str) -> DataFrame:
    """Versions of the document alone."""
    rows = history.latest_load(read(spark, d, HUB), ["CD_MES", "NU_EC"], "DT_CRGA", ["NU_DCMT"])
    rows = rows.select(F.col("NU_EC").alias("nu_ec"), F.col("CD_MES").alias("cd_mes"), known_document(F.col("NU_DCMT")).alias("documento"))
    return history.fold_versions(rows, "nu_ec", "cd_mes", ["documento"]).select("nu_ec", F.col("valid_from").alias("cd_mes_de"), F.col("valid_to").alias("cd_mes_ate"), "documento")


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return delivery.channel_messages(read(spark, d, CARDS), read(spark, d, PIX))


def _admitted(spark: SparkSession, d: str) -> DataFrame | None:
    """The ledger over the load months in order: id, arrivals, admitted, dt_crga, nm_arqv_orgm, batch."""
    cols = ["dt_crga", "nm_arqv_orgm"]
    return delivery.admit_batches(spark, _messages(spark, d).select("chave", *cols), F.substring("dt_crga", 1, 7), "chave", [F.col(c) for c in cols], cols)


def _channel_and_id() -> list:
    return [F.expr("substring(id, 1, instr(id, '|') - 1)").alias("canal"), F.expr("substring(id, instr(id, '|') + 1)").alias("id_mensagem")]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of which the ledger turned some arrival away: by a bit set in an earlier batch, or as a further copy in its own."""
    got = _admitted(spark, d)
    if got is None:
        return _messages(spark, d).where(F.lit(False)).select("canal", "id_mensagem")
    refused = got.where((F.col("arrivals") > 1) | ~F.col("admitted"))
    return refused.select("id").distinct().select(*_channel_and_id())


def p2_once(spark: SparkSession, d: str) -> DataFrame:
    """The one kept arrival of each identifier, admitted over the batches of the load months in order."""
    got = _admitted(spark, d)
    if got is None:
        return _messages(spark, d).where(F.lit(False)).select("canal", "id_mensagem", "dt_crga", "nm_arqv_orgm")
    return got.where("admitted").select(*_channel_and_id(), "dt_crga", "nm_arqv_orgm")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_keys(read(spark, d, "grafo_arestas"), "dst", HEAVY_SHARE).select("dst")


def _money(df: DataFrame) -> DataFrame:
    return df.withColumn("valor", F.round("valor", 2))


def p5_by_dst(spark: SparkSession, d: str) -> DataFrame:
    return _money(skew.edge_totals(read(spark, d, "grafo_arestas"), "dst"))


def p5_by_relation(spark: SparkSession, d: str) -> DataFrame:
    return _money(skew.edge_totals(read(spark, d, "grafo_arestas"), "relacao"))


def p5_join(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of edges that meet in one dst, by both relations: counts and sums without the pairs."""
    e = read(spark, d, "grafo_arestas").select("dst", "relacao", "qt")
    out = skew.eager_join(e.withColumnRenamed("relacao", "relacao_a").withColumnRenamed("qt", "qt_a"), e.withColumnRenamed("relacao", "relacao_b").withColumnRenamed("qt", "qt_b"), "dst", ["relacao_a"], ["relacao_b"], ["qt_a"], ["qt_b"])
    return out


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    cards = instants.card_instants(read(spark, d, CARDS), read(spark, d, "fuso_local")).select(F.lit("crto").alias("fonte"), "chave", "instante_ms")
    hub = instants.hub_instants(read(spark, d, HUB)).select(F.lit("hub").alias("fonte"), "chave", "instante_ms")
    return cards.unionByName(hub)


def p6_zones(spark: SparkSession, d: str) -> DataFrame:
    """The zone estimated from ingestion for each place, whatever is declared."""
    zones = read(spark, d, "fuso_local")
    m = Cuts(spark, "moments").put(instants.card_moments(read(spark, d, CARDS)))
    return instants.estimate_zones(m, ["cd_pais_estn", "sg_uf"], "p", "dia_crga", zones, "nm_fuso")


QUERIES = {f.__name__: f for f in (p1_found, p1_history, p1_documents, p2_found, p2_once, p5_found, p5_by_dst, p5_by_relation, p5_join, p6_found, p6_zones)}

_ID = "nullif(lower(regexp_replace({0}, '^[\\s\\x{{A0}}\\x{{2000}}-\\x{{200B}}\\x{{3000}}\\x{{FEFF}}]+|[\\s\\x{{A0}}\\x{{2000}}-\\x{{200B}}\\x{{3000}}\\x{{FEFF}}]+$', '', 'g')), '')"
_CHANNEL = f"""(SELECT * FROM (SELECT 'crto' AS canal, {_ID.format("id_unco")} AS id_mensagem, dt_crga, nm_arqv_orgm FROM {CARDS}
 UNION ALL SELECT 'pix', {_ID.format("id_unco_pix")}, dt_crga, nm_arqv_orgm FROM {PIX}) WHERE id_mensagem IS NOT NULL)"""

_BARE = "regexp_replace(d, '^0+', '')"
_KNOWN = f"""h AS (SELECT NU_EC AS nu_ec, CD_MES AS cd_mes, nullif(regexp_replace(NU_DCMT, '[^0-9]', '', 'g'), '') AS d FROM (SELECT *, row_number() OVER (PARTITION BY CD_MES, NU_EC ORDER BY DT_CRGA DESC NULLS LAST, NU_DCMT DESC NULLS LAST) AS rn FROM {HUB}) WHERE rn = 1 AND NU_EC IS NOT NULL AND CD_MES IS NOT NULL),
 p AS (SELECT nu_ec, cd_mes, d, lpad({_BARE}, 11, '0') AS a, lpad({_BARE}, 14, '0') AS b, length({_BARE}) AS n, d = repeat(substr(d, 1, 1), length(d)) AS same FROM h),
 k AS (SELECT nu_ec, cd_mes, CASE WHEN d IS NULL OR same OR n = 0 THEN NULL WHEN length(d) BETWEEN 12 AND 14 AND {sql_valid("b")} THEN b WHEN n <= 11 AND {sql_valid("a")} THEN a WHEN n <= 14 AND {sql_valid("b")} THEN b END AS doc FROM p),
 f AS (SELECT nu_ec, min(cd_mes) AS cd_mes FROM k GROUP BY 1),
 c AS (SELECT nu_ec, cd_mes FROM (SELECT nu_ec, cd_mes, doc, lag(doc) OVER (PARTITION BY nu_ec ORDER BY cd_mes) AS was FROM k WHERE doc IS NOT NULL) WHERE was IS NOT NULL AND was <> doc UNION SELECT * FROM f),
 v AS (SELECT nu_ec, cd_mes AS de, lead(cd_mes) OVER (PARTITION BY nu_ec ORDER BY cd_mes) AS nxt FROM c)"""

SQL = {
    "p1_documents": f"WITH {_KNOWN} SELECT v.nu_ec, de AS cd_mes_de, coalesce(CASE WHEN nxt % 100 = 1 THEN nxt - 89 ELSE nxt - 1 END, {history.OPEN_END}) AS cd_mes_ate, (SELECT min(doc) FROM k WHERE k.nu_ec = v.nu_ec AND k.cd_mes >= de AND (nxt IS NULL OR k.cd_mes < nxt)) AS documento FROM v",
    "p2_found": f"SELECT canal, id_mensagem FROM {_CHANNEL} GROUP BY 1, 2 HAVING count(*) > 1",
    "p2_once": f"SELECT canal, id_mensagem, dt_crga, nm_arqv_orgm FROM (SELECT *, row_number() OVER (PARTITION BY canal, id_mensagem ORDER BY dt_crga, nm_arqv_orgm) AS rn FROM {_CHANNEL}) WHERE rn = 1",
    "p5_found": "SELECT dst FROM grafo_arestas WHERE dst IS NOT NULL GROUP BY dst HAVING count(*) >= 0.03 * (SELECT count(*) FROM grafo_arestas)",
    "p5_by_dst": "SELECT dst, count(*) AS rows, CAST(sum(qt) AS BIGINT) AS qt, round(sum(valor), 2) AS valor, min(ts_min) AS ts_min, max(ts_max) AS ts_max FROM grafo_arestas GROUP BY dst",
    "p5_by_relation": "SELECT relacao, count(*) AS rows, CAST(sum(qt) AS BIGINT) AS qt, round(sum(valor), 2) AS valor, min(ts_min) AS ts_min, max(ts_max) AS ts_max FROM grafo_arestas GROUP BY relacao",
    "p5_join": """SELECT a.relacao AS relacao_a, b.relacao AS relacao_b, count(*) AS rows, CAST(sum(a.qt) AS BIGINT) AS qt_a, CAST(sum(b.qt) AS BIGINT) AS qt_b
 FROM grafo_arestas a JOIN grafo_arestas b ON a.dst = b.dst GROUP BY 1, 2""",
}
