"""Queries of linkage, tabular features, ranking metrics, serving and network view, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave import queries_graph as qg
from riskweave.operators import features, linkage, risk
from riskweave.operators.relational import dedup_latest
from riskweave.plans import serve, silver, view
from riskweave.queries_records import CARDS, HUB, PIX, _CARDS_ONCE, _PIX_ONCE, sql_when
from riskweave.registry import Registry
from riskweave.runtime import Cuts, read

R = Registry()
QUERIES, SQL = R.queries, R.sql

# ---- linkage ----------------------------------------------------------------

#: Mentions of customers, each twice, the second with typing errors: one text for both engines.
_MENTIONS = """SELECT concat('a', CAST(c_custkey AS {s})) AS mention_id, lpad(CAST(c_custkey * 7919 AS {s}), 11, '0') AS document, c_name AS name, concat(c_mktsegment, ' ', CAST(c_nationkey AS {s})) AS address,
  CASE WHEN c_custkey % 3 <> 0 THEN concat('+5511', lpad(CAST(c_custkey AS {s}), 9, '9')) END AS phone, CASE WHEN c_custkey % 2 = 0 THEN concat('c', CAST(c_custkey AS {s}), '@mail.example') END AS email FROM customer
 UNION ALL SELECT concat('b', CAST(c_custkey AS {s})), CASE WHEN c_custkey % 5 = 0 THEN concat('9', substr(lpad(CAST(c_custkey * 7919 AS {s}), 11, '0'), 2, 10)) ELSE lpad(CAST(c_custkey * 7919 AS {s}), 11, '0') END,
  CASE WHEN c_custkey % 4 = 0 THEN concat(c_name, 'X') ELSE c_name END, concat(c_mktsegment, CAST(c_nationkey AS {s})), CASE WHEN c_custkey % 6 <> 0 THEN concat('+5511', lpad(CAST(c_custkey AS {s}), 9, '9')) END, CASE WHEN c_custkey % 7 = 0 THEN concat('c', CAST(c_custkey AS {s}), '@mail.example') END FROM customer"""


def customer_mentions(spark: SparkSession, d: str) -> DataFrame:
    read(spark, d, "customer").createOrReplaceTempView("customer")
    return Cuts(spark, "mentions").put(spark.sql(_MENTIONS.format(s="STRING")))


M = f"M AS MATERIALIZED ({_MENTIONS.format(s='VARCHAR')})"
_BLOCK = """P AS MATERIALIZED (SELECT l.mention_id AS id_l, r.mention_id AS id_r, 'document' AS block FROM M l JOIN M r ON l.document = r.document AND l.mention_id < r.mention_id
 UNION ALL SELECT l.mention_id, r.mention_id, 'phone' FROM M l JOIN M r ON l.phone = r.phone AND l.mention_id < r.mention_id WHERE NOT coalesce(l.document = r.document, false)
 UNION ALL SELECT l.mention_id, r.mention_id, 'name' FROM M l JOIN M r ON l.name = r.name AND l.mention_id < r.mention_id WHERE NOT coalesce(l.document = r.document, false) AND NOT coalesce(l.phone = r.phone, false))"""
_LEVELS = """L AS MATERIALIZED (SELECT id_l, id_r, l.document AS document_l, r.document AS document_r,
 CASE WHEN l.document IS NULL OR r.document IS NULL THEN -1 WHEN l.document = r.document THEN 2 WHEN levenshtein(l.document, r.document) <= 1 THEN 1 ELSE 0 END AS g_document,
 CASE WHEN l.name IS NULL OR r.name IS NULL THEN -1 WHEN l.name = r.name THEN 3 WHEN jaro_winkler_similarity(l.name, r.name) >= 0.95 THEN 2 WHEN jaro_winkler_similarity(l.name, r.name) >= 0.88 THEN 1 ELSE 0 END AS g_name,
 CASE WHEN l.address IS NULL OR r.address IS NULL THEN -1 WHEN l.address = r.address THEN 3 WHEN levenshtein(l.address, r.address) <= 2 THEN 2 WHEN levenshtein(l.address, r.address) <= 5 THEN 1 ELSE 0 END AS g_address,
 CASE WHEN l.phone IS NULL OR r.phone IS NULL THEN -1 WHEN l.phone = r.phone THEN 1 ELSE 0 END AS g_phone, CASE WHEN l.email IS NULL OR r.email IS NULL THEN -1 WHEN l.email = r.email THEN 1 ELSE 0 END AS g_email
 FROM P JOIN M l ON l.mention_id = id_l JOIN M r ON r.mention_id = id_r)"""
_G = [f"g_{f}" for f in linkage.FIELDS]
#: Fixed probabilities of the score query, level by level from unlike to equal.
FIXED_M = {"document": [0.1, 0.2, 0.7], "name": [0.1, 0.1, 0.2, 0.6], "address": [0.1, 0.2, 0.4, 0.3], "phone": [0.2, 0.8], "email": [0.3, 0.7]}
FIXED_U = {"document": [0.989, 0.01, 0.001], "name": [0.5, 0.3, 0.19, 0.01], "address": [0.6, 0.2, 0.19, 0.01], "phone": [0.999, 0.001], "email": [0.999, 0.001]}
PRIOR = 0.001
_WEIGHT = f"{math.log2(PRIOR / (1 - PRIOR))!r}" + "".join(" + CASE g_" + f + " WHEN -1 THEN 0.0 " + " ".join(f"WHEN {k} THEN {math.log2(FIXED_M[f][k] / FIXED_U[f][k])!r}" for k in range(linkage.LEVELS[f])) + " END" for f in linkage.FIELDS)
_SCORED = f"W AS (SELECT *, CAST({_WEIGHT} AS DOUBLE) AS weight FROM L), SC AS MATERIALIZED (SELECT *, pow(2, weight) / (1 + pow(2, weight)) AS probability FROM W WHERE pow(2, weight) / (1 + pow(2, weight)) >= 0.01)"
_LINK = f"{M}, {_BLOCK}, {_LEVELS}, {_SCORED}"


def compared(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = customer_mentions(spark, d)
    return m, linkage.compared(linkage.blocked_pairs(m), m)


def scores(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m, p = compared(spark, d)
    return m, Cuts(spark, "scores").put(linkage.scored(p, FIXED_M, FIXED_U, PRIOR))


@R.add(f"WITH {M}, {_BLOCK} SELECT id_l, id_r, block FROM P")
def blocking_pairs(spark: SparkSession, d: str) -> DataFrame:
    return linkage.blocked_pairs(customer_mentions(spark, d))


@R.add(f"WITH {M}, {_BLOCK}, {_LEVELS} SELECT id_l, id_r, {', '.join(_G)} FROM L")
def comparison_levels(spark: SparkSession, d: str) -> DataFrame:
    return compared(spark, d)[1].select("id_l", "id_r", *_G)


@R.add(f"WITH {M} SELECT count(*) AS mentions, (SELECT sum(c * (c - 1) / 2) FROM (SELECT count(*) AS c FROM M GROUP BY document)) AS rule_pairs, round((SELECT sum(c * (c - 1) / 2) FROM (SELECT count(*) AS c FROM M GROUP BY document)) / 0.9 / (count(*) * (count(*) - 1) / 2), 12) AS \"lambda\" FROM M")
def linkage_prior(spark: SparkSession, d: str) -> DataFrame:
    return linkage.prior(customer_mentions(spark, d)).withColumn("lambda", F.round("lambda", 12))


@R.add(f"WITH {_LINK} SELECT id_l, id_r, round(weight, 6) AS weight, round(probability, 6) AS probability FROM SC")
def linkage_score(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d)[1].select("id_l", "id_r", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"))


@R.add(f"WITH {_LINK} SELECT floor(probability * 10) / 10 AS tenth, count(*) AS pairs FROM SC GROUP BY 1")
def probability_histogram(spark: SparkSession, d: str) -> DataFrame:
    return linkage.probability_histogram(scores(spark, d)[1])


@R.add(f"WITH {_LINK} SELECT id_l, id_r, 'other document' AS why FROM SC WHERE document_l <> document_r AND probability >= 0.9")
def surprising_pairs(spark: SparkSession, d: str) -> DataFrame:
    return linkage.surprising(scores(spark, d)[1]).where("why = 'other document'").select("id_l", "id_r", "why")


def _reach(at: str, name: str = "reach") -> str:
    return f"B AS MATERIALIZED (SELECT id_l AS a, id_r AS b FROM SC WHERE probability >= {at} UNION SELECT id_r, id_l FROM SC WHERE probability >= {at}), {name}(id, component) USING KEY (id) AS (SELECT mention_id, mention_id FROM M UNION SELECT B.b, min(r.component) FROM {name} r JOIN B ON B.a = r.id JOIN recurring.{name} o ON o.id = B.b WHERE r.component < o.component GROUP BY B.b)"


@R.add(f"WITH RECURSIVE {_LINK}, {_reach('0.9')} SELECT id, component FROM reach")
def identity_clusters(spark: SparkSession, d: str) -> DataFrame:
    m, s = scores(spark, d)
    return linkage.clusters(m, s)


_IDENTITY = f"""{_LINK}, {_reach('0.9')}, J AS MATERIALIZED (SELECT M.*, component FROM M JOIN reach ON reach.id = mention_id),
 dc AS (SELECT document, component FROM (SELECT document, component, row_number() OVER (PARTITION BY document ORDER BY count(*) DESC, component) AS rn FROM J GROUP BY 1, 2) WHERE rn = 1),
 nc AS (SELECT component, name FROM (SELECT component, name, row_number() OVER (PARTITION BY component ORDER BY count(*) DESC, name) AS rn FROM J GROUP BY 1, 2) WHERE rn = 1),
 gc AS (SELECT component, count(DISTINCT document) AS documents_count, array_to_string(list_sort(list(DISTINCT document)), ',') AS documents FROM J GROUP BY 1),
 I AS MATERIALIZED (SELECT document, 'IDN:' || component AS identity, name, documents_count, documents FROM dc JOIN nc USING (component) JOIN gc USING (component))"""


def identity_table(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m, s = scores(spark, d)
    return m, Cuts(spark, "identity").put(linkage.identities(m, linkage.clusters(m, s)))


@R.add(f"WITH RECURSIVE {_IDENTITY} SELECT document, identity, name, documents_count, documents FROM I")
def identity_map(spark: SparkSession, d: str) -> DataFrame:
    return identity_table(spark, d)[1].withColumn("documents", F.array_join("documents", ","))


@R.add(f"WITH RECURSIVE {_IDENTITY} SELECT count(*) AS documents, count(DISTINCT identity) AS identities, count(DISTINCT CASE WHEN documents_count > 1 THEN identity END) AS identities_of_several FROM I")
def identity_summary(spark: SparkSession, d: str) -> DataFrame:
    return linkage.identity_summary(identity_table(spark, d)[1])


@R.add(f"WITH RECURSIVE {_IDENTITY} SELECT identity, count(*) AS valid_documents FROM I WHERE document LIKE '0%' GROUP BY 1 HAVING count(*) > 1")
def overmerge_check(spark: SparkSession, d: str) -> DataFrame:
    """Identities of several documents that count as valid (here: those with a leading zero)."""
    m, i = identity_table(spark, d)
    return linkage.overmerged(i, m.where("document like '0%'").select("document"))


@R.add(" UNION ALL ".join(f"SELECT CAST({t} AS DOUBLE) AS threshold, (WITH RECURSIVE {_LINK}, {_reach(t)} SELECT count(DISTINCT component) FROM reach) AS identities" for t in ("0.5", "0.9", "0.99")))
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    m, s = scores(spark, d)
    return linkage.threshold_sweep(m, s)


@R.add()
def em_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Estimated u and m per field and level: seeded random pairs, two passes of expectation maximisation."""
    m = customer_mentions(spark, d)
    u = linkage.estimate_u(linkage.compared(linkage.random_pairs(m), m))
    p = Cuts(spark, "compared").put(linkage.compared(linkage.blocked_pairs(m), m))
    lam = linkage.prior(m).first()["lambda"]
    by_doc = linkage.estimate_m(p.where("g_document = 2"), u, 0.5, ["document"])
    by_name = linkage.estimate_m(p.where("g_name = 3"), u, 0.5, ["name"])
    got = linkage.combine(by_doc, by_name)
    rows = [(f, k, float(got[f][k]), float(u[f][k]), float(lam)) for f in linkage.FIELDS if f in got for k in range(linkage.LEVELS[f])]
    return spark.createDataFrame(rows, "field string, level int, m double, u double, prior double")


# ---- tabular features -------------------------------------------------------

_MONTHS = f"h AS MATERIALIZED (SELECT * REPLACE (CASE WHEN VL_FTRM >= 0 THEN VL_FTRM END AS VL_FTRM) FROM (SELECT *, row_number() OVER (PARTITION BY CD_MES, NU_EC ORDER BY DT_CRGA DESC NULLS LAST) AS rn FROM {HUB}) WHERE rn = 1), last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY NU_EC ORDER BY CD_MES DESC) AS k FROM h) WHERE k = 1), past AS (SELECT NU_EC, avg(VL_FTRM) AS mean, stddev_samp(VL_FTRM) AS dev FROM h GROUP BY 1)"


def months(spark: SparkSession, d: str) -> DataFrame:
    return silver.monthly_hub(read(spark, d, HUB))


@R.add(f"WITH {_MONTHS} SELECT last.NU_EC AS nu_ec, coalesce(VL_FTRM, 0) AS turnover, round(coalesce(VL_FTRM, 0) / greatest(mean, 1), 6) AS turnover_to_mean, round(coalesce(dev, 0) / greatest(mean, 1), 6) AS turnover_cv, coalesce(PC_CHRG, 0) AS chargeback_pct, coalesce(QT_DIAS_AFLC, 0) AS age_days, round(coalesce(VL_ANTP_ARV, 0) / greatest(VL_FTRM, 1), 6) AS advance_pct, coalesce(CASE WHEN DC_ALRT_CPTO <> 'SEM ALERTA' THEN 1.0 ELSE 0.0 END, 0) AS alert, coalesce(CASE WHEN TIPO_CLNT = 'E-COMMERCE' THEN 1.0 ELSE 0.0 END, 0) AS ecommerce FROM last JOIN past USING (NU_EC)")
def tabular_features(spark: SparkSession, d: str) -> DataFrame:
    f = features.month_features(months(spark, d))
    return f.select("nu_ec", "turnover", *[F.round(c, 6).alias(c) for c in ("turnover_to_mean", "turnover_cv")], "chargeback_pct", "age_days", F.round("advance_pct", 6).alias("advance_pct"), "alert", "ecommerce")


@R.add(f"SELECT id_estn AS nu_ec, CAST(count(*) AS DOUBLE) AS card_count, round(avg(CASE WHEN hour({sql_when('dt_oprc', 'hr_oprc')}) IS NULL THEN NULL WHEN hour({sql_when('dt_oprc', 'hr_oprc')}) <= 4 THEN 1.0 ELSE 0.0 END), 6) AS night_rate, round(avg(CASE WHEN (vl_trns BETWEEN 9000 AND 9999.99) OR (vl_trns BETWEEN 4500 AND 4999.99) THEN 1.0 ELSE 0.0 END), 6) AS below_limit_rate, round(avg(CASE WHEN cd_tipo_crto IS NULL THEN NULL WHEN cd_tipo_crto = 'PRE-PAGO' THEN 1.0 ELSE 0.0 END), 6) AS prepaid_rate FROM ({_CARDS_ONCE}) GROUP BY 1")
def card_features(spark: SparkSession, d: str) -> DataFrame:
    f = features.card_features(silver.card_transactions(read(spark, d, CARDS)))
    return f.select("nu_ec", "card_count", *[F.round(c, 6).alias(c) for c in ("night_rate", "below_limit_rate", "prepaid_rate")])


@R.add(f"SELECT id_estn AS nu_ec, CAST(count(*) AS DOUBLE) AS payment_count, round(avg(qt_d90_stooge_acc_mrca_frde_us + qt_d90_frde_acc_mrca_frde_us), 6) AS mule_marks_mean FROM ({_PIX_ONCE}) GROUP BY 1")
def payment_features(spark: SparkSession, d: str) -> DataFrame:
    f = features.payment_features(silver.instant_payments(read(spark, d, PIX)))
    return f.select("nu_ec", "payment_count", F.round("mule_marks_mean", 6).alias("mule_marks_mean"))


@R.add(f"SELECT s.NU_EC AS nu_ec, coalesce(c.n, 0) AS card_count, coalesce(p.n, 0) AS payment_count FROM (SELECT DISTINCT NU_EC FROM {HUB}) s LEFT JOIN (SELECT id_estn, CAST(count(*) AS DOUBLE) AS n FROM ({_CARDS_ONCE}) GROUP BY 1) c ON c.id_estn = s.NU_EC LEFT JOIN (SELECT id_estn, CAST(count(*) AS DOUBLE) AS n FROM ({_PIX_ONCE}) GROUP BY 1) p ON p.id_estn = s.NU_EC")
def base_table(spark: SparkSession, d: str) -> DataFrame:
    stores = read(spark, d, HUB).select(F.col("NU_EC").alias("nu_ec")).distinct()
    c = features.card_features(silver.card_transactions(read(spark, d, CARDS))).select("nu_ec", "card_count")
    p = features.payment_features(silver.instant_payments(read(spark, d, PIX))).select("nu_ec", "payment_count")
    return features.base_table(stores, [c, p])


# ---- splits, metrics, bands -------------------------------------------------

_S = "S AS MATERIALIZED (SELECT c_custkey AS id, c_acctbal AS score, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS label, c_nationkey AS grp FROM customer)"


def scored(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("label"), F.col("c_nationkey").alias("grp"))


_BUCKET = "CAST('0x' || substr(md5(seed || '|' || grp), 1, 8) AS BIGINT) % 100"


@R.add(f"WITH {_S}, q AS (SELECT seed, abs(avg(CASE WHEN {_BUCKET} < 30 THEN label END) - avg(label)) AS gap FROM S, range(20) r(seed) GROUP BY 1), b AS (SELECT seed FROM q ORDER BY gap NULLS LAST, seed LIMIT 1) SELECT id, {_BUCKET} < 30 AS in_test FROM S, b")
def group_split(spark: SparkSession, d: str) -> DataFrame:
    return risk.group_split(scored(spark, d), "grp", "label").select("id", "in_test")


@R.add(f"WITH {_S}, r AS (SELECT *, (rank() OVER (ORDER BY score) + count(*) OVER (PARTITION BY score) / 2.0 - 0.5) AS mid FROM S), t AS (SELECT sum(label) AS p, count(*) AS n FROM S), d AS (SELECT score, sum(label) AS p, count(*) AS n FROM S GROUP BY 1), c AS (SELECT p, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM d WINDOW w AS (ORDER BY score DESC)), k AS (SELECT * FROM S ORDER BY score DESC, id LIMIT 100) SELECT round((SELECT (sum(mid) - max(t.p) * (max(t.p) + 1) / 2.0) / (max(t.p) * (max(t.n) - max(t.p))) FROM r, t WHERE label = 1), 6) AS roc_auc, round((SELECT sum(c.p * cp / cn) / max(t.p) FROM c, t), 6) AS average_precision, round((SELECT avg(label) FROM k), 6) AS precision_at_k, round((SELECT sum(k.label) / max(t.p) FROM k, t), 6) AS recall_at_k")
def auc_ap_topk(spark: SparkSession, d: str) -> DataFrame:
    m = risk.ranking_metrics(scored(spark, d), "score", "label", "id")
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@R.add(f"WITH {_S}, r AS (SELECT label, row_number() OVER (ORDER BY score DESC, id) AS position FROM S) SELECT position, round(row_number() OVER (ORDER BY position) * 1.0 / (SELECT sum(label) FROM S), 6) AS share FROM r WHERE label = 1")
def capture_curve(spark: SparkSession, d: str) -> DataFrame:
    return risk.capture_curve(scored(spark, d), "score", "label", "id").select("position", F.round("share", 6).alias("share"))


@R.add(f"WITH {_S}, d AS (SELECT score, sum(label) AS p, count(*) AS n FROM S GROUP BY 1) SELECT score AS threshold, round(sum(p) OVER w * 1.0 / sum(n) OVER w, 6) AS precision, round(sum(p) OVER w * 1.0 / (SELECT sum(label) FROM S), 6) AS recall FROM d WINDOW w AS (ORDER BY score DESC)")
def precision_recall(spark: SparkSession, d: str) -> DataFrame:
    return risk.precision_recall_curve(scored(spark, d), "score", "label").select("threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@R.add(f"WITH {_S} SELECT label AS actual, CASE WHEN score >= (SELECT quantile_cont(score, 0.95) FROM S) THEN 1 ELSE 0 END AS predicted, count(*) AS rows FROM S GROUP BY 1, 2")
def confusion_at_quantile(spark: SparkSession, d: str) -> DataFrame:
    return risk.confusion_at(scored(spark, d), "score", "label")


_BAND = "CASE WHEN score >= (SELECT quantile_cont(score, 0.95) FROM {0}) THEN 'ALTO' WHEN score >= (SELECT quantile_cont(score, 0.85) FROM {0}) THEN 'MEDIO' ELSE 'BAIXO' END"


@R.add(f"WITH {_S}, b AS (SELECT label, {_BAND.format('S')} AS band FROM S) SELECT band, label, count(*) AS rows FROM b GROUP BY 1, 2")
def risk_bands(spark: SparkSession, d: str) -> DataFrame:
    return risk.band_by_label(risk.with_band(scored(spark, d), "score"), "label")


@R.add(f"WITH {_S}, b AS (SELECT *, {_BAND.format('S')} AS band FROM S) SELECT id, row_number() OVER (ORDER BY score DESC, id) AS position, band, CASE WHEN label = 0 AND band = 'ALTO' THEN 1 ELSE 0 END AS new_suspect FROM b")
def queue_rank(spark: SparkSession, d: str) -> DataFrame:
    return risk.queue(scored(spark, d), "score", "label", "id", F.lit("2025-12-01").cast("date")).select("id", "position", "band", "new_suspect")


# ---- serving ----------------------------------------------------------------

_QUEUE = f"""st AS MATERIALIZED (SELECT NU_EC AS nu_ec, NM_EC AS name, NM_RMAT AS industry, coalesce(PC_CHRG, 0) AS score, CASE WHEN NU_EC % 10 = {qg.FLAG_DIGIT} THEN 1 ELSE 0 END AS flagged FROM (SELECT *, row_number() OVER (PARTITION BY NU_EC ORDER BY CD_MES DESC, DT_CRGA DESC NULLS LAST) AS rn FROM {HUB}) WHERE rn = 1),
 q0 AS (SELECT *, {_BAND.format('st')} AS band FROM st),
 Q AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score DESC, nu_ec) AS position, CASE WHEN flagged = 0 AND band = 'ALTO' THEN 1 ELSE 0 END AS new_suspect FROM q0)"""
_SERVED = f"{qg.G}, {qg._COMPONENTS}, {qg._STATS}, {_QUEUE}, FT AS MATERIALIZED (SELECT CAST(substr(m.id, 6) AS BIGINT) AS nu_ec, m.component, stores, roots, flagged_stores - flagged AS others_flagged FROM members m JOIN V USING (id) JOIN cs ON cs.component = m.component WHERE type = 'LOJA')"
STORE = 2000000001


def served_queue(spark: SparkSession, d: str) -> DataFrame:
    """Stores by the chargeback of their last month, as a queue."""
    from riskweave.operators.relational import latest_snapshot

    s = latest_snapshot(read(spark, d, HUB), "NU_EC", "CD_MES", "DT_CRGA", ["NM_EC", "NM_RMAT", "PC_CHRG"])
    s = s.select(F.col("NU_EC").alias("nu_ec"), F.col("NM_EC").alias("name"), F.col("NM_RMAT").alias("industry"), F.coalesce("PC_CHRG", F.lit(0.0)).alias("score"), F.when(F.col("NU_EC") % 10 == qg.FLAG_DIGIT, 1).otherwise(0).alias("flagged"))
    return Cuts(spark, "queue").put(risk.queue(s, "score", "flagged", "nu_ec", F.lit("2025-12-01").cast("date")))


def served_features(spark: SparkSession, d: str) -> DataFrame:
    f = features.store_components(qg.members(spark, d))
    return Cuts(spark, "served").put(f.withColumn("nu_ec", F.substring("store", 6, 30).cast("long")).drop("store"))


@R.add(f"WITH RECURSIVE {_SERVED} SELECT count(*) AS stores, count(CASE WHEN band = 'ALTO' THEN 1 END) AS high, sum(new_suspect) AS new_suspects, sum(flagged) AS flagged, count(DISTINCT CASE WHEN roots >= 2 AND stores >= 3 THEN component END) AS suspicious_groups FROM Q JOIN FT USING (nu_ec)")
def kpis(spark: SparkSession, d: str) -> DataFrame:
    return serve.kpis(served_queue(spark, d), served_features(spark, d))


@R.add(f"WITH RECURSIVE {_SERVED} SELECT position, nu_ec, name, industry, round(score, 4) AS score, band, flagged, new_suspect, stores FROM Q JOIN FT USING (nu_ec) WHERE band = 'ALTO' AND (contains(lower(name), lower('a')) OR starts_with(CAST(nu_ec AS VARCHAR), 'a')) ORDER BY position LIMIT 200")
def queue_filter(spark: SparkSession, d: str) -> DataFrame:
    return serve.queue_filter(served_queue(spark, d), served_features(spark, d), band="ALTO", sought="a")


@R.add(f"WITH RECURSIVE {_SERVED} SELECT nu_ec, name, industry, position, round(score, 4) AS score, band, flagged, new_suspect, stores, roots, others_flagged FROM Q JOIN FT USING (nu_ec) WHERE nu_ec = {STORE}")
def merchant_card(spark: SparkSession, d: str) -> DataFrame:
    return serve.merchant_card(served_queue(spark, d), served_features(spark, d), STORE)


@R.add(f"WITH {_QUEUE} SELECT industry, sum(CASE WHEN new_suspect = 1 THEN 1 ELSE 0 END) AS new_suspects, sum(CASE WHEN flagged = 1 THEN 1 ELSE 0 END) AS flagged FROM Q WHERE band = 'ALTO' GROUP BY 1")
def band_by_industry(spark: SparkSession, d: str) -> DataFrame:
    return serve.band_by_industry(served_queue(spark, d))


@R.add(f"WITH {_QUEUE} SELECT nu_ec, name, round(score, 3) AS score, new_suspect, flagged FROM Q WHERE band = 'ALTO' ORDER BY position LIMIT 60")
def top_high(spark: SparkSession, d: str) -> DataFrame:
    return serve.top_high(served_queue(spark, d))


@R.add(f"WITH {_QUEUE} SELECT position, nu_ec, name, industry, round(score, 3) AS score FROM Q WHERE new_suspect = 1 ORDER BY position LIMIT 10")
def new_suspects(spark: SparkSession, d: str) -> DataFrame:
    return serve.new_suspects(served_queue(spark, d))


def _shared_sql(relation: str) -> str:
    return f"WITH {qg.G} SELECT DISTINCT x.src AS store, y.src AS flagged_store, x.dst AS shared FROM E x JOIN E y ON x.dst = y.dst JOIN V a ON a.id = x.src AND a.flagged = 0 AND a.type = 'LOJA' JOIN V b ON b.id = y.src AND b.flagged = 1 AND b.type = 'LOJA' WHERE x.relation = '{relation}' AND y.relation = '{relation}'"


@R.add(_shared_sql("liquida_em"))
def shared_account_flagged(spark: SparkSession, d: str) -> DataFrame:
    g = qg.whole(spark, d)
    return serve.shares_with_flagged(g.edges, g.vertices, "liquida_em")


@R.add(_shared_sql("socio"))
def shared_partner_flagged(spark: SparkSession, d: str) -> DataFrame:
    g = qg.whole(spark, d)
    return serve.shares_with_flagged(g.edges, g.vertices, "socio")


@R.add(f"WITH {_QUEUE}, p AS ({_PIX_ONCE}) SELECT regexp_replace(nu_cnta_recr, '^0+', '') AS receiver, count(*) AS payments, round(sum(vl_trns), 2) AS total, count(DISTINCT id_estn) AS stores FROM p WHERE id_estn IN (SELECT nu_ec FROM Q WHERE band = 'ALTO') AND in_acto = '1' AND nu_cnta_recr IS NOT NULL GROUP BY 1 ORDER BY total DESC, receiver LIMIT 20")
def top_receivers(spark: SparkSession, d: str) -> DataFrame:
    """Accounts that receive most from ALTO stores."""
    p = read(spark, d, PIX)
    once = dedup_latest(p, ["id_unco_pix"], ["dt_crga"], [c for c in p.columns if c not in ("id_unco_pix", "dt_crga", "nm_arqv_orgm")])
    pay = once.select(F.col("id_estn").alias("nu_ec"), F.col("vl_trns").alias("amount"), (F.col("in_acto") == "1").alias("approved"), F.regexp_replace("nu_cnta_recr", "^0+", "").alias("receiver"))
    return serve.top_receivers(pay, served_queue(spark, d))


_BIG = "(SELECT nu_ec FROM FT ORDER BY stores DESC, nu_ec LIMIT 1)"


@R.add(f"WITH RECURSIVE {_SERVED} SELECT nu_ec, name, band, round(score, 3) AS score, flagged FROM FT JOIN Q USING (nu_ec) WHERE component = (SELECT component FROM FT WHERE nu_ec = {_BIG}) AND nu_ec <> {_BIG}")
def same_component(spark: SparkSession, d: str) -> DataFrame:
    """The other stores in the component with most stores, seen from its first store."""
    f = served_features(spark, d)
    big = f.orderBy(F.desc("stores"), "nu_ec").select("nu_ec").first()
    return serve.same_component(served_queue(spark, d), f, big[0] if big else -1)


@R.add(f"WITH {qg.G} SELECT 'vertices' AS \"table\", count(*) - count(DISTINCT id) AS violations FROM V UNION ALL SELECT 'edges', count(*) - count(DISTINCT (src, dst, relation)) FROM E")
def declared_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys behind the declared joins that are not unique."""
    from riskweave.sources.tables import declared_key_violations

    g = qg.whole(spark, d)
    one = lambda n, df, k: declared_key_violations(df, k).agg(F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("violations")).select(F.lit(n).alias("table"), "violations")
    return one("vertices", g.vertices, ["id"]).unionByName(one("edges", g.edges, ["src", "dst", "relation"]))


# ---- network view -----------------------------------------------------------

_LINKS = ", ".join(f"'{r}'" for r in serve.LINKS)
_NETWORK = f"""top AS MATERIALIZED (SELECT t.src AS id FROM E t JOIN (SELECT src, count(*) AS n FROM E GROUP BY 1) g ON g.src = t.dst WHERE t.relation IN ('titular', 'socio') ORDER BY n DESC, t.src LIMIT 1),
 K AS MATERIALIZED (SELECT src, dst, relation, qty, amount FROM E WHERE relation IN ({_LINKS})), one AS MATERIALIZED (SELECT K.* FROM K, top WHERE src = top.id),
 two AS MATERIALIZED (SELECT * FROM K WHERE src IN (SELECT dst FROM one WHERE relation IN ('titular', 'socio'))), att AS (SELECT dst FROM one UNION SELECT dst FROM two),
 few AS (SELECT dst FROM K WHERE dst IN (SELECT dst FROM att) GROUP BY 1 HAVING count(*) <= 30), three AS MATERIALIZED (SELECT K.* FROM K, top WHERE dst IN (SELECT dst FROM few) AND src <> top.id),
 four AS (SELECT * FROM K WHERE relation IN ('titular', 'socio') AND dst IN (SELECT src FROM three)), found AS MATERIALIZED (SELECT * FROM one UNION SELECT * FROM two UNION SELECT * FROM three UNION SELECT * FROM four),
 nodes AS (SELECT src AS id FROM found UNION SELECT dst FROM found), allrows AS (SELECT * FROM found UNION ALL SELECT src, dst, relation, qty, amount FROM E WHERE relation = 'pix' AND amount >= 0 AND src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)),
 NW AS MATERIALIZED (SELECT r.src, r.dst, relation, qty, round(amount, 2) AS amount, a.type AS src_type, a.name AS src_name, coalesce(a.flagged, 0) AS src_flagged, b.type AS dst_type, b.name AS dst_name, coalesce(b.flagged, 0) AS dst_flagged FROM allrows r JOIN V a ON a.id = r.src JOIN V b ON b.id = r.dst ORDER BY r.src, r.dst, relation LIMIT 600)"""


def view_root(spark: SparkSession, d: str) -> str:
    """The store of the person with most outgoing edges."""
    e = qg.edges(spark, d)
    out = e.groupBy(F.col("src").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    top = e.where("relation in ('titular', 'socio')").join(out, "dst").orderBy(F.desc("n"), "src").select("src").first()
    return top[0] if top else ""


def network_rows(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    g, root = qg.whole(spark, d), view_root(spark, d)
    return Cuts(spark, "network").put(serve.network(g.edges, g.vertices, root, least_flow=0.0)), root


@R.add(f"WITH {qg.G}, {_NETWORK} SELECT src, dst, relation, qty, amount, src_type, dst_type, src_flagged, dst_flagged FROM NW")
def merchant_network(spark: SparkSession, d: str) -> DataFrame:
    return network_rows(spark, d)[0].select("src", "dst", "relation", "qty", "amount", "src_type", "dst_type", "src_flagged", "dst_flagged")


_REL = "CASE relation " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in view.RELATION_LABELS.items()) + " ELSE relation END"
_PROJECT = f"""{_NETWORK}, ps AS MATERIALIZED (SELECT dst AS person, src AS store, CASE WHEN max(CASE WHEN relation = 'titular' THEN 1 ELSE 0 END) = 1 THEN 'titular' ELSE 'sócio' END AS role FROM NW WHERE src_type = 'LOJA' AND relation IN ('titular', 'socio') GROUP BY 1, 2),
 pl AS (SELECT CASE WHEN src_type = 'LOJA' THEN src ELSE coalesce(store, '{view.NO_STORE}') END AS source, dst AS target, CASE WHEN src_type = 'LOJA' OR role IS NULL THEN {_REL} ELSE role || ' ' || {_REL} END AS label, CASE WHEN src_type <> 'LOJA' AND store IS NULL THEN src END AS person FROM NW LEFT JOIN ps ON ps.person = NW.src WHERE relation <> 'pix'),
 PJ AS MATERIALIZED (SELECT source, target, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, count(DISTINCT person) AS people FROM pl GROUP BY 1, 2),
 nv AS MATERIALIZED (SELECT id, min(flagged) AS flagged, min(type) AS type, min(name) AS name FROM (SELECT src AS id, src_flagged AS flagged, src_type AS type, src_name AS name FROM NW UNION SELECT dst, dst_flagged, dst_type, dst_name FROM NW) GROUP BY 1),
 lv0 AS (SELECT target, sum(CASE WHEN source <> '{view.NO_STORE}' THEN 1 ELSE 0 END) AS stores, sum(people) AS people, sum(CASE WHEN source <> '{view.NO_STORE}' AND coalesce(flagged, 0) = 1 THEN 1 ELSE 0 END) AS flagged_stores FROM PJ LEFT JOIN nv ON nv.id = PJ.source GROUP BY 1),
 LV AS MATERIALIZED (SELECT *, CASE WHEN stores + people < 2 THEN 'normal' WHEN flagged_stores > 0 THEN 'fraude' ELSE 'alerta' END AS level FROM lv0)"""


@R.add(f"WITH {qg.G}, {_PROJECT} SELECT source, target, labels, people FROM PJ")
def network_projection(spark: SparkSession, d: str) -> DataFrame:
    return view.projected_links(network_rows(spark, d)[0]).withColumn("labels", F.array_join("labels", ","))


@R.add(f"WITH {qg.G}, {_PROJECT} SELECT target, stores, people, flagged_stores, level FROM LV")
def network_levels(spark: SparkSession, d: str) -> DataFrame:
    return view.attribute_levels(network_rows(spark, d)[0])


@R.add(f"WITH {qg.G}, {_PROJECT} SELECT source, PJ.target, CASE WHEN level = 'fraude' AND ((coalesce(flagged, 0) = 1 AND source <> '{view.NO_STORE}') OR source = (SELECT id FROM top)) THEN 'fraude' WHEN level = 'normal' THEN 'normal' ELSE 'alerta' END AS level FROM PJ JOIN LV USING (target) LEFT JOIN nv ON nv.id = source")
def network_edge_levels(spark: SparkSession, d: str) -> DataFrame:
    rows, root = network_rows(spark, d)
    return view.link_levels(rows, root)


_ENTITY = f"""en AS (SELECT person, coalesce(max(CASE WHEN store = (SELECT id FROM top) THEN store END), min(store)) AS entity FROM ps GROUP BY 1),
 fl AS MATERIALIZED (SELECT CASE WHEN src_type = 'LOJA' THEN src ELSE coalesce(a.entity, '{view.NO_STORE}') END AS s, CASE WHEN dst_type = 'LOJA' THEN dst ELSE coalesce(b.entity, '{view.NO_STORE}') END AS t, amount, qty, src, dst FROM NW LEFT JOIN en a ON a.person = src LEFT JOIN en b ON b.person = dst WHERE relation = 'pix'),
 px AS (SELECT DISTINCT src, dst FROM NW WHERE relation = 'pix' AND src <> dst), tri AS MATERIALIZED (SELECT x.src AS a, y.src AS b, z.src AS c FROM px x JOIN px y ON x.dst = y.src JOIN px z ON y.dst = z.src AND z.dst = x.src WHERE x.src <> y.src AND y.src <> z.src AND x.src <> z.src),
 leg AS (SELECT a AS src, b AS dst FROM tri UNION SELECT b, c FROM tri UNION SELECT c, a FROM tri)"""


@R.add(f"WITH {qg.G}, {_PROJECT}, {_ENTITY}, g AS (SELECT least(s, t) AS a, greatest(s, t) AS b, sum(CASE WHEN s < t THEN amount ELSE 0 END) AS ab, sum(CASE WHEN s > t THEN amount ELSE 0 END) AS ba, sum(qty) AS qty FROM fl WHERE s <> t GROUP BY 1, 2) SELECT a, b, round(ab, 2) AS ab, round(ba, 2) AS ba, qty, CASE WHEN ab >= ba THEN a ELSE b END AS source, ab > 0 AND ba > 0 AS both_ways FROM g")
def network_flows(spark: SparkSession, d: str) -> DataFrame:
    rows, root = network_rows(spark, d)
    return view.pair_flows(rows, root).select("a", "b", F.round("ab", 2).alias("ab"), F.round("ba", 2).alias("ba"), "qty", "source", "both_ways")


@R.add(f"WITH {qg.G}, {_PROJECT}, {_ENTITY} SELECT entity, round(sum(sent), 2) AS sent, round(sum(received), 2) AS received, round(sum(internal), 2) AS internal FROM (SELECT s AS entity, amount AS sent, 0 AS received, 0 AS internal FROM fl WHERE s <> t UNION ALL SELECT t, 0, amount, 0 FROM fl WHERE s <> t UNION ALL SELECT s, 0, 0, amount FROM fl WHERE s = t AND s = '{view.NO_STORE}') GROUP BY 1")
def network_flow_totals(spark: SparkSession, d: str) -> DataFrame:
    rows, root = network_rows(spark, d)
    return view.flow_totals(rows, root).select("entity", *[F.round(c, 2).alias(c) for c in ("sent", "received", "internal")])


@R.add(f"WITH {qg.G}, {_PROJECT}, {_ENTITY} SELECT DISTINCT list_sort([a, b, c])[1] AS a, list_sort([a, b, c])[2] AS b, list_sort([a, b, c])[3] AS c FROM tri")
def network_cycles(spark: SparkSession, d: str) -> DataFrame:
    return view.flow_cycles(network_rows(spark, d)[0])


@R.add(f"WITH {qg.G}, {_NETWORK}, nv AS (SELECT id, min(flagged) AS flagged FROM (SELECT src AS id, src_flagged AS flagged FROM NW WHERE src_type = 'LOJA' UNION SELECT dst, dst_flagged FROM NW WHERE dst_type = 'LOJA') GROUP BY 1) SELECT id AS store, row_number() OVER (ORDER BY id = (SELECT id FROM top) DESC, flagged DESC, id) - 1 AS place FROM nv")
def network_store_order(spark: SparkSession, d: str) -> DataFrame:
    rows, root = network_rows(spark, d)
    return view.store_order(rows, root)


@R.add(f"WITH {qg.G}, {_PROJECT}, so AS (SELECT id AS source, row_number() OVER (ORDER BY id = (SELECT id FROM top) DESC, flagged DESC, id) - 1 AS place FROM nv WHERE type = 'LOJA'), ats AS (SELECT * FROM so UNION ALL SELECT '{view.NO_STORE}', (SELECT count(*) FROM so)), mn AS (SELECT target, avg(place) AS mean FROM PJ JOIN ats USING (source) GROUP BY 1) SELECT target, row_number() OVER (ORDER BY CASE WHEN level = 'normal' THEN 1 ELSE 0 END, mean, CASE level WHEN 'fraude' THEN 0 WHEN 'alerta' THEN 1 ELSE 2 END, target) - 1 AS place FROM LV JOIN mn USING (target) WHERE level <> 'normal' OR stores >= 1")
def network_attribute_order(spark: SparkSession, d: str) -> DataFrame:
    rows, root = network_rows(spark, d)
    return view.attribute_order(rows, root, complete=True)


@R.add(f"WITH {qg.G}, {_PROJECT} SELECT count(*) AS hidden FROM LV WHERE level = 'normal' AND stores >= 1")
def network_hidden(spark: SparkSession, d: str) -> DataFrame:
    return view.hidden_count(view.attribute_levels(network_rows(spark, d)[0]), complete=False)


_KIND = "CASE WHEN type IN ('DOC', 'IDENTIDADE') THEN 'Titular/sócio' ELSE CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in view.TYPE_LABELS.items()) + " ELSE type END END"


@R.add(f"WITH {qg.G}, {_PROJECT} SELECT source AS store, array_to_string(list_sort(list(DISTINCT {_KIND})), ',') AS kinds FROM PJ JOIN LV USING (target) JOIN nv ON nv.id = PJ.target WHERE source <> '{view.NO_STORE}' AND level <> 'normal' GROUP BY 1")
def network_shared_kinds(spark: SparkSession, d: str) -> DataFrame:
    return view.shared_kinds(network_rows(spark, d)[0]).withColumn("kinds", F.array_join("kinds", ","))


@R.add(f"WITH {qg.G}, {_PROJECT}, ro AS (SELECT target, max(CASE WHEN source = (SELECT id FROM top) THEN 1 ELSE 0 END) AS of_root FROM PJ GROUP BY 1) SELECT level, target, stores, people, of_root FROM LV JOIN ro USING (target) WHERE level <> 'normal'")
def network_signals(spark: SparkSession, d: str) -> DataFrame:
    """The signals of shared attributes; those of flows are checked by tests."""
    rows, root = network_rows(spark, d)
    return view.signals(rows, root).where("about = 'attribute'").select("level", "target", "stores", "people", "of_root")


@R.add("SELECT * FROM (VALUES ('distance, alert,new one', 'Perto de loja fraudada|Alerta comportamental|new one', 1), ('pep', 'Sócio PEP', 0)) AS t(signals, labels, from_graph)")
def signal_labels(spark: SparkSession, d: str) -> DataFrame:
    s = spark.createDataFrame([("distance, alert,new one",), ("pep",)], "signals string").withColumn("l", view.signal_labels(F.col("signals")))
    return s.select("signals", F.array_join(F.transform("l", lambda x: x["label"]), "|").alias("labels"), F.size(F.filter("l", lambda x: x["from_graph"])).alias("from_graph"))


@R.add("SELECT * FROM (VALUES ('CONTA', '90909090|1|700700', 'Conta 1 / 700700'), ('CONTA', '90909090', 'Conta 90909090'), ('TELEFONE', '+5511988124471', '+55 11 98812-4471'), ('DISPOSITIVO', '0123456789abcdef', 'Dispositivo 01234567'), ('EMAIL', 'a@b.example', 'a@b.example')) AS t(kind, name, label)")
def attribute_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = [("CONTA", "90909090|1|700700"), ("CONTA", "90909090"), ("TELEFONE", "+5511988124471"), ("DISPOSITIVO", "0123456789abcdef"), ("EMAIL", "a@b.example")]
    return spark.createDataFrame(rows, "kind string, name string").withColumn("label", view.attribute_label(F.col("kind"), F.col("name")))


# ---- models -----------------------------------------------------------------

#: Rounds of the registered model queries; the operators' default is 300.
ROUNDS = 20


def model_table(spark: SparkSession, d: str) -> tuple[DataFrame, list[str], list[str]]:
    """Stores with tabular and component features, their label and component."""
    t = features.month_features(months(spark, d))
    g = served_features(spark, d)
    label = F.when(F.col("nu_ec") % 10 == qg.FLAG_DIGIT, 1).otherwise(0).alias("label")
    x = t.join(g, "nu_ec", "left").fillna(0).select("*", label)
    tabular = [c for c in t.columns if c != "nu_ec"]
    return Cuts(spark, "model").put(x), tabular, ["stores", "roots", "others_flagged"]


@R.add()
def gbt_queue(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold scores by components, ranked and banded."""
    x, tabular, g = model_table(spark, d)
    s = Cuts(spark, "oof").put(risk.out_of_fold(x, [*tabular, *g], "label", "component", folds=2, rounds=ROUNDS).select("nu_ec", "label", "score"))
    return risk.queue(s, "score", "label", "nu_ec", F.lit("2025-12-01").cast("date"))


@R.add()
def top_contributors(spark: SparkSession, d: str) -> DataFrame:
    """The three features of each store whose replacement lowers its score most."""
    x, tabular, g = model_table(spark, d)
    names = [*tabular, *g]
    model = risk.boosted_trees(names, "label", rounds=ROUNDS).fit(risk.weighted(x, "label"))
    m = x.where("label = 0").agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in names]).first().asDict()  # one row
    return risk.top_contributors(model, x, names, m, "nu_ec")


@R.add()
def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Ranking metrics on the held-out groups per feature group, and with the links taken away."""
    x, tabular, g = model_table(spark, d)
    s = Cuts(spark, "split").put(risk.group_split(risk.weighted(x, "label"), "component", "label"))
    out = None
    for name, cols in features.feature_groups(tabular, g).items():
        model = risk.boosted_trees(cols, "label", rounds=ROUNDS).fit(s.where("not in_test"))
        test = s.where("in_test")
        for kind, rows in ((name, test), *([(f"{name}_without_links", risk.what_if(test, g))] if name.startswith("B") else [])):
            one = risk.ranking_metrics(Cuts(spark, "scored").put(risk.score_with(model, rows).select("nu_ec", "label", "score")), "score", "label", "nu_ec").withColumn("model", F.lit(kind))
            out = one if out is None else out.unionByName(one)
    return out


@R.add()
def feature_importance(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen features that the trees use most."""
    x, tabular, g = model_table(spark, d)
    names = [*tabular, *g]
    model = risk.boosted_trees(names, "label", rounds=ROUNDS).fit(risk.weighted(x, "label"))
    return spark.createDataFrame(risk.importance(model, names), "feature string, importance double")


R.typed("tabular_features", age_days="DOUBLE", alert="DOUBLE", ecommerce="DOUBLE")
R.typed("kpis", new_suspects="BIGINT", flagged="BIGINT")
R.typed("merchant_card", others_flagged="BIGINT")
R.typed("band_by_industry", new_suspects="BIGINT", flagged="BIGINT")
R.typed("network_levels", stores="BIGINT", people="BIGINT", flagged_stores="BIGINT")
R.typed("network_flows", qty="BIGINT")
R.typed("network_store_order", place="INTEGER")
R.typed("network_attribute_order", place="INTEGER")
R.typed("network_signals", stores="BIGINT", people="BIGINT")
