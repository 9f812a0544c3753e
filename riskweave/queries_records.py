"""Queries of the standard forms, record tables and profiles, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions import standard
from riskweave.functions.documents import digits, standard_document, tax_root, valid_document
from riskweave.operators import linkage, relational
from riskweave.plans import silver
from riskweave.registry import Registry
from riskweave.runtime import read
from riskweave.sources import tables

HUB, CARDS, PIX = "tbciar_re_hub_dado_risc_cred", "tbciar_tr_lynx_trns_crto", "tbciar_tr_lynx_trns_pix"
R = Registry()
QUERIES, SQL = R.queries, R.sql

# ---- SQL pieces -------------------------------------------------------------


def _check(d: str, n: int, cycle: int) -> str:
    total = " + ".join(f"coalesce(TRY_CAST(substr({d}, {i}, 1) AS INTEGER), 0) * {(n - i) % cycle + 2}" for i in range(1, n + 1))
    return f"(CASE WHEN ({total}) % 11 < 2 THEN 0 ELSE 11 - ({total}) % 11 END)"


def sql_valid(d: str) -> str:
    at = lambda i: f"coalesce(TRY_CAST(substr({d}, {i}, 1) AS INTEGER), -1)"
    return (
        f"(CASE WHEN length({d}) = 11 THEN {d} <> repeat(substr({d}, 1, 1), 11) AND {_check(d, 9, 10)} = {at(10)} AND {_check(d, 10, 10)} = {at(11)} "
        f"WHEN length({d}) = 14 THEN {_check(d, 12, 8)} = {at(13)} AND {_check(d, 13, 8)} = {at(14)} ELSE false END)"
    )


def sql_documents(source: str) -> str:
    """raw, doc, person, valid over ``source`` (a query with a column raw)."""
    return f"""d AS (SELECT raw, nullif(regexp_replace(raw, '[^0-9]', '', 'g'), '') AS d FROM ({source})),
 c AS (SELECT raw, d, CASE WHEN length(d) < 11 THEN lpad(d, 11, '0') ELSE d END AS a, CASE WHEN length(d) < 14 THEN lpad(d, 14, '0') ELSE d END AS b FROM d),
 docs AS (SELECT raw, CASE WHEN d IS NULL THEN NULL WHEN length(d) <= 11 AND {sql_valid("a")} THEN a WHEN {sql_valid("b")} THEN b WHEN length(d) <= 11 THEN a ELSE b END AS doc FROM c)"""


_UNACCENT = f"upper(translate({{}}, '{standard.ACCENTED}', '{standard.PLAIN}'))"


def sql_unaccent(c: str) -> str:
    return _UNACCENT.format(c)


def sql_squeeze(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({c}, '[^A-Z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))"


def sql_name(c: str) -> str:
    return f"nullif({sql_squeeze(sql_unaccent(c))}, '')"


def sql_address(c: str) -> str:
    e = f"regexp_replace({sql_unaccent(c)}, '\\s*-?\\s*CEP\\s*[\\d.\\-]+', '', 'g')"
    e = sql_squeeze(f"regexp_replace({e}, '\\bN\\s*[º°O]?\\.?\\s*(\\d)', '\\1', 'g')")
    for short, full in standard.STREET_STARTS.items():
        e = f"regexp_replace({e}, '^{short}\\b', '{full}')"
    return f"nullif({e}, '')"


def sql_phone(c: str) -> str:
    d = f"regexp_replace({c}, '[^0-9]', '', 'g')"
    n = f"(CASE WHEN length({d}) >= 12 AND {d} LIKE '55%' THEN substr({d}, 3, 20) ELSE {d} END)"
    return f"(CASE WHEN length({n}) IN (10, 11) THEN '+55' || {n} END)"


def sql_email(c: str) -> str:
    return f"(CASE WHEN regexp_matches(lower(trim({c})), '^[^@\\s]+@[^@\\s]+\\.[a-z]{{2,}}$') THEN lower(trim({c})) END)"


def sql_account(a: str, b: str, c: str) -> str:
    return f"nullif(concat_ws('|', {a}, CAST(TRY_CAST({b} AS BIGINT) AS VARCHAR), CAST(TRY_CAST({c} AS BIGINT) AS VARCHAR)), '')"


def sql_when(date: str, clock: str) -> str:
    d = f"CAST({date} AS VARCHAR)"
    h = f"lpad(replace(CAST({clock} AS VARCHAR), ':', ''), 6, '0')"
    day = f"(CASE WHEN regexp_matches({d}, '^\\d{{8}}$') THEN try_strptime({d}, '%Y%m%d') WHEN regexp_matches({d}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_strptime({d}, '%Y-%m-%d') END)"
    part = lambda i: f"TRY_CAST(substr({h}, {i}, 2) AS INTEGER)"
    return f"({day} + to_hours({part(1)}) + to_minutes({part(3)}) + to_seconds({part(5)}))"


def sql_key_kind(c: str) -> str:
    return f"(CASE WHEN {c} LIKE '+55%' THEN 'PHONE' WHEN contains({c}, '@') THEN 'EMAIL' WHEN regexp_matches({c}, '^[0-9a-f]{{32}}$') THEN 'EVP' WHEN regexp_matches({c}, '^\\d{{11}}$|^\\d{{14}}$') THEN 'DOCUMENT' END)"


_FORMAT = (
    "CASE WHEN {0} IS NULL THEN 'null' WHEN regexp_matches({0}, '^\\d{{3}}\\.\\d{{3}}\\.\\d{{3}}-\\d{{2}}$') THEN 'masked_person' WHEN regexp_matches({0}, '^\\d{{2}}\\.\\d{{3}}\\.\\d{{3}}/\\d{{4}}-\\d{{2}}$') THEN 'masked_company' "
    "WHEN regexp_matches({0}, '^\\d{{11}}$|^\\d{{14}}$') THEN 'digits' WHEN regexp_matches({0}, '^\\d+$') THEN 'digits_short' ELSE 'other' END"
)
FORMATS = ["null", "masked_person", "masked_company", "digits", "digits_short", "other"]
_DOCUMENT_SOURCES = [(HUB, "NU_DCMT"), (PIX, "nu_pix_cpf_cnpj_pgdr"), (PIX, "nu_cpf_cnpj_recr"), (CARDS, "nu_oprc_cpf_ptdr_pld"), (CARDS, "nu_cpf_ptdr_ecommerce")]
_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# ---- standard forms ---------------------------------------------------------


@R.add(f"WITH {sql_documents(f'SELECT DISTINCT NU_DCMT AS raw FROM {HUB}')} SELECT raw, doc, CASE WHEN doc IS NULL THEN NULL WHEN length(doc) = 11 THEN 'PF' ELSE 'PJ' END AS person, CASE WHEN doc IS NOT NULL THEN {sql_valid('doc')} END AS valid FROM docs")
def doc_standardize(spark: SparkSession, d: str) -> DataFrame:
    """Standard form of every written store document."""
    return read(spark, d, HUB).select(F.col("NU_DCMT").alias("raw")).distinct().select("raw", standard_document(F.col("raw")).alias("p")).select("raw", "p.doc", "p.person", "p.valid")


@R.add(f"SELECT raw, {sql_valid('raw')} AS valid FROM (SELECT DISTINCT regexp_replace(NU_DCMT, '[^0-9]', '', 'g') AS raw FROM {HUB} WHERE NU_DCMT IS NOT NULL)")
def check_digits(spark: SparkSession, d: str) -> DataFrame:
    raw = read(spark, d, HUB).where("NU_DCMT is not null").select(digits(F.col("NU_DCMT")).alias("raw")).distinct()
    return raw.select("raw", valid_document(F.col("raw")).alias("valid"))


@R.add(f"SELECT DISTINCT nu_celr_ptdr_ecommerce AS raw, {sql_phone('nu_celr_ptdr_ecommerce')} AS phone FROM {CARDS}")
def phone_standard(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, CARDS).select(F.col("nu_celr_ptdr_ecommerce").alias("raw"), standard.phone_e164(F.col("nu_celr_ptdr_ecommerce")).alias("phone")).distinct()


QUERIES["phone_e164"], SQL["phone_e164"] = QUERIES.pop("phone_standard"), SQL.pop("phone_standard")


@R.add(f"SELECT raw, {sql_address('raw')} AS address FROM (SELECT DC_ENDR AS raw FROM {HUB} UNION SELECT tx_endr_ptdr_ecommerce FROM {CARDS} UNION SELECT tx_endr_enta_ecommerce FROM {CARDS})")
def address_std(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, CARDS)
    raw = read(spark, d, HUB).select(F.col("DC_ENDR").alias("raw")).union(c.select("tx_endr_ptdr_ecommerce")).union(c.select("tx_endr_enta_ecommerce")).distinct()
    return raw.select("raw", standard.address_std(F.col("raw")).alias("address"))


@R.add(f"SELECT raw, {sql_name('raw')} AS name FROM (SELECT NM_EC AS raw FROM {HUB} UNION SELECT tx_pix_nm_pgdr FROM {PIX} UNION SELECT tx_oprc_nm_ptdr_pld FROM {CARDS})")
def name_std(spark: SparkSession, d: str) -> DataFrame:
    raw = read(spark, d, HUB).select(F.col("NM_EC").alias("raw")).union(read(spark, d, PIX).select("tx_pix_nm_pgdr")).union(read(spark, d, CARDS).select("tx_oprc_nm_ptdr_pld")).distinct()
    return raw.select("raw", standard.name_std(F.col("raw")).alias("name"))


@R.add(f"SELECT raw, {sql_email('raw')} AS email FROM (SELECT tx_emal_ptdr_ecommerce AS raw FROM {CARDS} UNION SELECT tx_usro_pix FROM {PIX})")
def email_std(spark: SparkSession, d: str) -> DataFrame:
    raw = read(spark, d, CARDS).select(F.col("tx_emal_ptdr_ecommerce").alias("raw")).union(read(spark, d, PIX).select("tx_usro_pix")).distinct()
    return raw.select("raw", standard.email_std(F.col("raw")).alias("email"))


@R.add(f"SELECT DISTINCT nu_ispb_recr AS ispb, nu_agnc_recr AS branch, nu_cnta_recr AS account, {sql_account('nu_ispb_recr', 'nu_agnc_recr', 'nu_cnta_recr')} AS account_key FROM {PIX}")
def account_key(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, PIX).select(F.col("nu_ispb_recr").alias("ispb"), F.col("nu_agnc_recr").alias("branch"), F.col("nu_cnta_recr").alias("account"), standard.account_key(F.col("nu_ispb_recr"), F.col("nu_agnc_recr"), F.col("nu_cnta_recr")).alias("account_key")).distinct()


@R.add(f"SELECT DISTINCT CAST(dt_oprc AS VARCHAR) AS day, CAST(hr_oprc AS VARCHAR) AS clock, {_STAMP.format(sql_when('dt_oprc', 'hr_oprc'))} AS at FROM {PIX}")
def mixed_timestamp(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, PIX).select(F.col("dt_oprc").cast("string").alias("day"), F.col("hr_oprc").cast("string").alias("clock"), stamp(standard.mixed_timestamp(F.col("dt_oprc"), F.col("hr_oprc"))).alias("at")).distinct()


@R.add(f"SELECT key, {sql_key_kind('key')} AS kind FROM (SELECT tx_chve_pix_pgdr AS key FROM {PIX} UNION SELECT tx_chve_pix_recr FROM {PIX})")
def payment_key_type(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, PIX)
    k = p.select(F.col("tx_chve_pix_pgdr").alias("key")).union(p.select("tx_chve_pix_recr")).distinct()
    return k.select("key", standard.payment_key_type(F.col("key")).alias("kind"))


@R.add("SELECT o_orderkey, round(CAST(CASE WHEN contains(t, ',') THEN replace(replace(t, '.', ''), ',', '.') ELSE t END AS DOUBLE), 2) AS amount FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN replace(CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR), '.', ',') ELSE CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) END AS t FROM orders)")
def decimal_comma(spark: SparkSession, d: str) -> DataFrame:
    """Order totals written with comma or point, read back."""
    t = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    t = F.when(F.col("o_orderstatus") == "F", F.replace(t, F.lit("."), F.lit(","))).otherwise(t)
    return read(spark, d, "orders").select("o_orderkey", F.round(standard.decimal_comma(t), 2).alias("amount"))


@R.add(f"WITH {sql_documents(f'SELECT DISTINCT NU_DCMT AS raw FROM {HUB}')} SELECT DISTINCT doc, CASE WHEN length(doc) = 14 THEN substr(doc, 1, 8) ELSE doc END AS root FROM docs WHERE doc IS NOT NULL")
def tax_roots(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, HUB).select(standard_document(F.col("NU_DCMT"))["doc"].alias("doc")).where("doc is not null").distinct()
    return docs.select("doc", tax_root(F.col("doc")).alias("root"))


QUERIES["tax_root"], SQL["tax_root"] = QUERIES.pop("tax_roots"), SQL.pop("tax_roots")
_STATES = "CASE upper(trim(NM_UF)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in standard.STATES.items()) + " ELSE upper(trim(NM_UF)) END"


@R.add(f"SELECT DISTINCT NM_UF AS raw, {_STATES} AS state FROM {HUB}")
def state_code(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, HUB).select(F.col("NM_UF").alias("raw"), standard.state_code(F.col("NM_UF")).alias("state")).distinct()


@R.add(f"SELECT DISTINCT DC_ENDR AS raw, NM_MNCP AS municipality, CASE WHEN strpos(DC_ENDR, ', ' || NM_MNCP) > 0 THEN substr(DC_ENDR, 1, strpos(DC_ENDR, ', ' || NM_MNCP) - 1) ELSE DC_ENDR END AS address FROM {HUB} WHERE DC_ENDR IS NOT NULL AND NOT regexp_matches(DC_ENDR, ',(\\S|\\s\\s)')")
def municipality_strip(spark: SparkSession, d: str) -> DataFrame:
    """Addresses cut at their municipality; those with other than one blank after a comma are covered by tests."""
    h = read(spark, d, HUB).where(F.col("DC_ENDR").isNotNull() & ~F.col("DC_ENDR").rlike(r",(\S|\s\s)"))
    return h.select(F.col("DC_ENDR").alias("raw"), F.col("NM_MNCP").alias("municipality"), standard.strip_municipality(F.col("DC_ENDR"), F.col("NM_MNCP")).alias("address")).distinct()


@R.add("SELECT a.c_name AS name_a, b.c_name AS name_b, round(jaro_winkler_similarity(a.c_name, b.c_name), 6) AS likeness FROM customer a JOIN supplier s ON a.c_custkey = s.s_suppkey JOIN customer b ON b.c_custkey = s.s_suppkey + 1")
def jaro_winkler(spark: SparkSession, d: str) -> DataFrame:
    """Names of neighbouring customers compared, one pair per supplier key."""
    c = read(spark, d, "customer").select("c_custkey", "c_name")
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"))
    a = c.join(s, "c_custkey").select(F.col("c_name").alias("name_a"), (F.col("c_custkey") + 1).alias("k"))
    p = a.join(c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name_b")), "k")
    return p.select("name_a", "name_b", F.round(standard.jaro_winkler("name_a", "name_b"), 6).alias("likeness"))


# ---- profiles and relational operators --------------------------------------


@R.add("SELECT source, " + ", ".join(f"CAST(count(CASE WHEN f = '{f}' THEN 1 END) AS BIGINT) AS \"{f}\"" for f in FORMATS) + " FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS source, {_FORMAT.format(c)} AS f FROM {t}" for t, c in _DOCUMENT_SOURCES) + ") GROUP BY source")
def doc_profile_pivot(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t, c in _DOCUMENT_SOURCES:
        one = read(spark, d, t).select(F.lit(c).alias("source"), standard.document_format(F.col(c)).alias("f"))
        out = one if out is None else out.unionByName(one)
    return relational.pivot_counts(out, "source", "f", FORMATS)


@R.add(f"SELECT NU_EC, CD_MES, DT_CRGA, NU_DCMT, DC_ENDR FROM (SELECT *, row_number() OVER (PARTITION BY CD_MES, NU_EC ORDER BY DT_CRGA DESC NULLS LAST, NU_DCMT DESC NULLS LAST, DC_ENDR DESC NULLS LAST) AS rn FROM {HUB}) WHERE rn = 1")
def dedup_latest(spark: SparkSession, d: str) -> DataFrame:
    return relational.dedup_latest(read(spark, d, HUB), ["CD_MES", "NU_EC"], ["DT_CRGA"], ["NU_DCMT", "DC_ENDR"])


@R.add(f"SELECT NU_EC, CD_MES, DT_CRGA, NM_EC, NM_UF FROM (SELECT *, row_number() OVER (PARTITION BY NU_EC ORDER BY CD_MES DESC, DT_CRGA DESC NULLS LAST, NM_EC DESC NULLS LAST, NM_UF DESC NULLS LAST) AS rn FROM {HUB}) WHERE rn = 1")
def latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return relational.latest_snapshot(read(spark, d, HUB), "NU_EC", "CD_MES", "DT_CRGA", ["NM_EC", "NM_UF"])


@R.add(f"SELECT floor(vl_trns / 250) * 250 AS bucket, count(*) AS rows FROM {CARDS} WHERE vl_trns BETWEEN 300 AND 11000 GROUP BY 1")
def value_histogram(spark: SparkSession, d: str) -> DataFrame:
    return relational.histogram(read(spark, d, CARDS), "vl_trns", 250, 300, 11000)


@R.add(f"SELECT (SELECT count(*) FROM (SELECT id_unco FROM {CARDS} WHERE id_unco IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS duplicated, (SELECT count(*) FROM {CARDS} WHERE contains(nm_arqv_orgm, 'REPROC')) AS marked_rows")
def duplicate_stats(spark: SparkSession, d: str) -> DataFrame:
    return relational.duplicate_stats(read(spark, d, CARDS), "id_unco", "nm_arqv_orgm", "REPROC")


@R.add(f"SELECT NU_EC, count(DISTINCT DC_ENDR) AS \"DC_ENDR_values\", count(DISTINCT NU_DCMT) AS \"NU_DCMT_values\" FROM {HUB} GROUP BY 1")
def store_variation(spark: SparkSession, d: str) -> DataFrame:
    return relational.variation(read(spark, d, HUB), "NU_EC", ["DC_ENDR", "NU_DCMT"])


@R.add(f"SELECT count(*) AS entities, count(CASE WHEN a > 1 THEN 1 END) AS \"DC_ENDR_varied\", count(CASE WHEN b > 1 THEN 1 END) AS \"NU_DCMT_varied\" FROM (SELECT NU_EC, count(DISTINCT DC_ENDR) AS a, count(DISTINCT NU_DCMT) AS b FROM {HUB} GROUP BY 1)")
def variation_summary(spark: SparkSession, d: str) -> DataFrame:
    return relational.variation_summary(store_variation(spark, d), ["DC_ENDR", "NU_DCMT"])


@R.add(f"SELECT split_part(DC_ENDR, ' ', 1) AS word, count(*) AS rows FROM {HUB} GROUP BY 1 ORDER BY rows DESC, word NULLS FIRST LIMIT 20")
def street_kinds(spark: SparkSession, d: str) -> DataFrame:
    return relational.top_counts(read(spark, d, HUB), F.split("DC_ENDR", " ")[0], "word", 20)


@R.add("SELECT c_custkey, round(CASE WHEN n > 1 THEN (s - c_acctbal) / (n - 1) ELSE 0 END, 6) AS others_mean FROM (SELECT c_custkey, c_acctbal, sum(c_acctbal) OVER (PARTITION BY c_nationkey) AS s, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)")
def leave_one_out_mean(spark: SparkSession, d: str) -> DataFrame:
    return relational.leave_one_out(read(spark, d, "customer"), ["c_nationkey"], "c_acctbal", "others_mean").select("c_custkey", F.round("others_mean", 6).alias("others_mean"))


@R.add("SELECT round(quantile_cont(o_totalprice, 0.85), 6) AS q85, round(quantile_cont(o_totalprice, 0.95), 6) AS q95 FROM orders")
def quantile_cut(spark: SparkSession, d: str) -> DataFrame:
    q = relational.quantile_cuts(read(spark, d, "orders"), "o_totalprice", [0.85, 0.95])
    return q.select(*[F.round(c, 6).alias(c) for c in q.columns])


@R.add("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def global_rank(spark: SparkSession, d: str) -> DataFrame:
    return relational.rank_rows(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], "place").select("o_orderkey", "place")


@R.add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 15")
def result_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of the 200 largest orders."""
    top = read(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(200)
    return tables.page(top, [F.desc("o_totalprice"), F.col("o_orderkey")], 2)


_BARE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@R.add(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", (SELECT count(*) FROM {t}) AS rows, CAST((SELECT count(*) FROM (DESCRIBE {t})) AS BIGINT) AS columns" for t in _BARE))
def inventory(spark: SparkSession, d: str) -> DataFrame:
    return tables.inventory({t: read(spark, d, t) for t in _BARE}).withColumn("columns", F.col("columns").cast("long"))


_LAYOUT = "s_suppkey string, s_name string, s_nationkey bigint, s_phone string, s_acctbal int"


@R.add("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, CAST(NULL AS VARCHAR) AS s_phone, CAST(trunc(s_acctbal) AS INTEGER) AS s_acctbal FROM supplier")
def conform_layout(spark: SparkSession, d: str) -> DataFrame:
    return tables.conform(read(spark, d, "supplier"), _LAYOUT)


@R.add("SELECT c.c_mktsegment, n.n_name, count(*) AS rows FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_name = 'NATION_3' OR contains(lower(c.c_mktsegment), 'auto') GROUP BY 1, 2")
def bound_parameters(spark: SparkSession, d: str) -> DataFrame:
    """A served query text with bound parameters."""
    text = "SELECT c.c_mktsegment, n.n_name, count(*) AS rows FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_name = :nation OR contains(lower(c.c_mktsegment), lower(:sought)) GROUP BY 1, 2"
    return tables.serve(spark, text, {"customer": read(spark, d, "customer"), "nation": read(spark, d, "nation")}, nation="NATION_3", sought="AUTO")


@R.add("SELECT * FROM (VALUES ('123.456.789-09', '12345678909', true), ('12345678909', '12345678909', true), ('11.222.333/0001-81', '11222333000181', true), ('1222333000181', '01222333000181', false), (' 12345678900 ', '12345678900', false)) AS t(raw, doc, valid)")
def literal_documents(spark: SparkSession, d: str) -> DataFrame:
    """Worked examples of the document standard from a literal relation."""
    rows = [("123.456.789-09",), ("12345678909",), ("11.222.333/0001-81",), ("1222333000181",), (" 12345678900 ",)]
    return tables.literal(spark, "raw string", rows).select("raw", standard_document(F.col("raw")).alias("p")).select("raw", "p.doc", "p.valid")


# ---- record tables ----------------------------------------------------------

_HUB_ROWS = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY CD_MES, NU_EC ORDER BY DT_CRGA DESC NULLS LAST) AS rn FROM {HUB}) WHERE rn = 1"
_STRIPPED = "CASE WHEN strpos(DC_ENDR, ', ' || NM_MNCP) > 0 THEN substr(DC_ENDR, 1, strpos(DC_ENDR, ', ' || NM_MNCP) - 1) ELSE DC_ENDR END"


@R.add(f"WITH h AS ({_HUB_ROWS}), {sql_documents(f'SELECT DISTINCT NU_DCMT AS raw FROM {HUB} WHERE NU_DCMT IS NOT NULL')} SELECT h.CD_MES, h.NU_EC, docs.doc AS document, {_STATES} AS \"NM_UF\", CASE WHEN VL_FTRM >= 0 THEN VL_FTRM END AS \"VL_FTRM\" FROM h LEFT JOIN docs ON docs.raw = h.NU_DCMT")
def silver_hub(spark: SparkSession, d: str) -> DataFrame:
    return silver.monthly_hub(read(spark, d, HUB)).select("CD_MES", "NU_EC", "document", "NM_UF", "VL_FTRM")


_LAST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY NU_EC ORDER BY CD_MES DESC, DT_CRGA DESC NULLS LAST) AS rn FROM {HUB}) WHERE rn = 1"


@R.add(f"WITH h AS ({_LAST}), {sql_documents(f'SELECT DISTINCT NU_DCMT AS raw FROM {HUB} WHERE NU_DCMT IS NOT NULL')} SELECT h.NU_EC AS nu_ec, {sql_name('NM_EC')} AS name, docs.doc AS document, CASE WHEN length(docs.doc) = 14 THEN substr(docs.doc, 1, 8) ELSE docs.doc END AS root, coalesce(CASE WHEN VL_FTRM >= 0 THEN VL_FTRM END, 0) AS turnover, CASE WHEN h.NU_EC % 10 = 3 THEN 1 ELSE 0 END AS flagged FROM h LEFT JOIN docs ON docs.raw = h.NU_DCMT")
def silver_stores(spark: SparkSession, d: str) -> DataFrame:
    hub = read(spark, d, HUB)
    flagged = hub.where("NU_EC % 10 = 3").select(F.col("NU_EC").alias("nu_ec"), F.lit(1).alias("flagged")).distinct()
    return silver.store_master(silver.monthly_hub(hub), flagged).select("nu_ec", "name", "document", "root", "turnover", "flagged")


_CARD_COLS = "id_unco, dt_crga, qt_cnar_ordm, dt_oprc, hr_oprc, id_estn, vl_trns, vl_tste, nm_estn, cd_tipo_crto, tx_emal_ptdr_ecommerce, nu_celr_ptdr_ecommerce"
_CARDS_ONCE = f"SELECT * FROM (SELECT {_CARD_COLS}, row_number() OVER (PARTITION BY id_unco ORDER BY dt_crga DESC NULLS LAST, qt_cnar_ordm DESC NULLS LAST, dt_oprc DESC NULLS LAST, hr_oprc DESC NULLS LAST) AS rn FROM {CARDS}) WHERE rn = 1 AND coalesce(vl_tste, 0) = 0 AND NOT contains(upper(coalesce(nm_estn, '')), 'TESTE') AND vl_trns > 0.01"


@R.add(f"SELECT id_unco, {_STAMP.format(sql_when('dt_oprc', 'hr_oprc'))} AS at, id_estn AS nu_ec, vl_trns AS amount, {sql_email('tx_emal_ptdr_ecommerce')} AS email, {sql_phone('nu_celr_ptdr_ecommerce')} AS phone FROM ({_CARDS_ONCE})")
def silver_cards(spark: SparkSession, d: str) -> DataFrame:
    return silver.card_transactions(read(spark, d, CARDS)).select("id_unco", stamp("at").alias("at"), "nu_ec", "amount", "email", "phone")


@R.add(f"SELECT id_unco, hour({sql_when('dt_oprc', 'hr_oprc')}) BETWEEN 0 AND 4 AS night, (vl_trns BETWEEN 9000 AND 9999.99) OR (vl_trns BETWEEN 4500 AND 4999.99) AS below_limit, vl_trns >= 500 AND vl_trns % 500 = 0 AS round_amount, cd_tipo_crto = 'PRE-PAGO' AS prepaid FROM ({_CARDS_ONCE})")
def typology_flags(spark: SparkSession, d: str) -> DataFrame:
    return silver.card_transactions(read(spark, d, CARDS)).select("id_unco", "night", "below_limit", "round_amount", "prepaid")


_PIX_ONCE = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id_unco_pix ORDER BY dt_crga DESC NULLS LAST, dt_oprc DESC NULLS LAST, hr_oprc DESC NULLS LAST, id_estn DESC NULLS LAST, cd_tipo_oprc_pix DESC NULLS LAST, vl_trns DESC NULLS LAST, in_acto DESC NULLS LAST, nu_pix_cpf_cnpj_pgdr DESC NULLS LAST) AS rn FROM {PIX}) WHERE rn = 1"


@R.add(f"SELECT id_unco_pix AS payment_id, {_STAMP.format(sql_when('dt_oprc', 'hr_oprc'))} AS at, id_estn AS nu_ec, vl_trns AS amount, in_acto = '1' AS approved, {sql_name('tx_pix_nm_pgdr')} AS payer_name, {sql_account('nu_ispb_recr', 'nu_agnc_recr', 'nu_cnta_recr')} AS receiver_account, {sql_key_kind('tx_chve_pix_recr')} AS receiver_key_kind, qt_d90_stooge_acc_mrca_frde_us + qt_d90_frde_acc_mrca_frde_us AS mule_marks FROM ({_PIX_ONCE})")
def silver_payments(spark: SparkSession, d: str) -> DataFrame:
    return silver.instant_payments(read(spark, d, PIX)).select("payment_id", stamp("at").alias("at"), "nu_ec", "amount", "approved", "payer_name", "receiver_account", "receiver_key_kind", "mule_marks")


def raw_advances(spark: SparkSession, d: str) -> DataFrame:
    """Advances in the shape of their raw table, from orders: amounts with comma or point, once or twice loaded."""
    o = read(spark, d, "orders")
    t = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    doc = F.lpad(F.col("o_custkey").cast("string"), 11, "0")
    a = o.select(
        F.concat(F.lit("A"), F.col("o_orderkey").cast("string")).alias("id_unco_lynx"), F.date_format("o_orderdate", "yyyyMMdd").cast("long").alias("dt_antp"), F.date_format("o_orderdate", "HH:mm:ss").alias("hr_antp"), (F.col("o_custkey") % 97).cast("string").alias("id_estn"),
        F.when(F.col("o_orderstatus") == "F", F.replace(t, F.lit("."), F.lit(","))).otherwise(t).alias("vl_trns"), F.when(F.col("o_orderstatus") == "O", "0").otherwise("1").alias("in_acto"),
        F.col("o_custkey").alias("nu_cnpj_rspe_dmcl"), doc.alias("nu_cnpj_cpf_mqnt"), F.lit("90000001").alias("nu_ispb"), F.lpad((F.col("o_custkey") % 89).cast("string"), 4, "0").alias("nu_agnc"), F.col("o_custkey").cast("string").alias("nu_cnta"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("dt_crga"),
    )
    again = o.where("o_orderpriority like '1%'").select(F.concat(F.lit("A"), F.col("o_orderkey").cast("string")).alias("id_unco_lynx"))
    return a.unionByName(a.join(again, "id_unco_lynx", "left_semi"))


@R.add("SELECT 'A' || o_orderkey AS id_unco_lynx, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS at, o_custkey % 97 AS nu_ec, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DOUBLE) AS amount, o_orderstatus <> 'O' AS approved, '90000001|' || (o_custkey % 89) || '|' || o_custkey AS account FROM orders")
def silver_advances(spark: SparkSession, d: str) -> DataFrame:
    return silver.advances(raw_advances(spark, d)).select("id_unco_lynx", stamp("at").alias("at"), "nu_ec", "amount", "approved", "account")


@R.add(f"WITH c AS ({_CARDS_ONCE}), ev AS (SELECT event_id, ts FROM events WHERE event_type = 'error') SELECT CAST(event_id AS VARCHAR) AS id_unco_lynx, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, c.id_estn AS nu_ec FROM ev LEFT JOIN c ON c.id_unco = CAST(event_id AS VARCHAR)")
def silver_reported(spark: SparkSession, d: str) -> DataFrame:
    """Error events as reports, joined to the card transactions of the same identifier (none here)."""
    t = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    raw = read(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").cast("string").alias("id_unco_lynx"), t.alias("dh_trns"), t.alias("dh_reporte"), F.lit(1).alias("cd_tipo_rsps_frde"), t.alias("dt_crga"))
    return silver.reported_fraud(raw, silver.card_transactions(read(spark, d, CARDS))).select("id_unco_lynx", stamp("at").alias("at"), "nu_ec")


#: Each of the nine lists is read from the orders of one status and some priorities.
_LISTS = {(k, o): (status, digits) for k, status in (("psit", "F"), ("ngto", "O"), ("psit_atzd", "P")) for o, digits in (("crto", "12"), ("clnt", "3"), ("ec", "45"))}
_AS_OF = "1996-01-01 00:00:00"


def _list_sql(kind: str, obj: str) -> str:
    status, digits = _LISTS[kind, obj]
    ident = "lpad(CAST(o_custkey AS VARCHAR), 11, '0')" if obj == "clnt" else "CAST(o_custkey AS VARCHAR)"
    some = ", ".join(f"'{x}'" for x in digits)
    return f"SELECT '{silver.LIST_KINDS[kind]}' AS list_kind, '{silver.OBJECT_KINDS[obj]}' AS object_kind, {ident} AS object, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%d %H:%M') AS entered, gone IS NULL OR gone > TIMESTAMP '{_AS_OF}' AS active FROM (SELECT DISTINCT o_custkey, o_orderdate, CASE WHEN o_custkey % 2 = 0 THEN o_orderdate + INTERVAL 30 DAY END AS gone FROM orders WHERE o_orderstatus = '{status}' AND substr(o_orderpriority, 1, 1) IN ({some}))"


_ALL_LISTS = " UNION ALL ".join(_list_sql(*k) for k in _LISTS)


def lists(spark: SparkSession, d: str) -> DataFrame:
    """The nine watch lists, with entry dates in two written forms and repeated loads."""

    def listed(status: str, digits: str) -> DataFrame:
        form = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy HH:mm"))
        gone = F.when(F.col("o_custkey") % 2 == 0, F.date_format(F.col("o_orderdate") + F.expr("interval 30 days"), "yyyy-MM-dd HH:mm:ss"))
        mine = read(spark, d, "orders").where((F.col("o_orderstatus") == status) & F.substring("o_orderpriority", 1, 1).isin(*digits))
        one = mine.groupBy("o_custkey", "o_orderdate").agg(F.min("o_orderkey").alias("o_orderkey"))
        x = one.select(F.col("o_custkey").alias("id_objt_prcp"), form.alias("dt_etra_lsta"), gone.alias("dt_sada_lsta"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("dt_crga"))
        return x.unionByName(x)

    return silver.watch_lists({k: listed(*v) for k, v in _LISTS.items()}, F.lit(_AS_OF).cast("timestamp"))


@R.add(_ALL_LISTS)
def watchlist_union(spark: SparkSession, d: str) -> DataFrame:
    return lists(spark, d).select("list_kind", "object_kind", "object", F.date_format("entered", "yyyy-MM-dd HH:mm").alias("entered"), "active")


@R.add(f"SELECT DISTINCT CAST(object AS BIGINT) AS nu_ec, 1 AS flagged FROM ({_ALL_LISTS}) WHERE list_kind = 'NEGATIVA' AND object_kind = 'EC' AND active")
def flagged_stores(spark: SparkSession, d: str) -> DataFrame:
    """Stores on an active negative list."""
    return silver.flagged_stores(lists(spark, d))


@R.add("SELECT count(*) AS mentions, sum(n) AS occurrences, sum(k) AS source_marks FROM (SELECT document, name, address, phone, email, count(*) AS n, count(DISTINCT source) AS k FROM (" + " UNION ALL ".join([
    "SELECT 'a' AS source, lpad(CAST(c_custkey AS VARCHAR), 11, '0') AS document, c_name AS name, NULL AS address, NULL AS phone, c_mktsegment AS email FROM customer",
    "SELECT 'b', lpad(CAST(o_custkey AS VARCHAR), 11, '0'), NULL, NULL, NULL, o_orderpriority FROM orders",
    "SELECT 'c', lpad(CAST(o_custkey AS VARCHAR), 11, '0'), NULL, NULL, NULL, o_orderpriority FROM orders WHERE o_orderstatus = 'F'",
]) + ") GROUP BY ALL)")
def mention_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of customers over three sources, identical ones grouped; totals of the grouping."""
    doc = lambda c: F.lpad(F.col(c).cast("string"), 11, "0").alias("document")
    none = lambda n: F.lit(None).cast("string").alias(n)
    o = read(spark, d, "orders")
    rest = [none("name"), none("address"), none("phone"), F.col("o_orderpriority").alias("email")]
    m = linkage.mentions({"a": read(spark, d, "customer").select(doc("c_custkey"), F.col("c_name").alias("name"), none("address"), none("phone"), F.col("c_mktsegment").alias("email")), "b": o.select(doc("o_custkey"), *rest), "c": o.where("o_orderstatus = 'F'").select(doc("o_custkey"), *rest)})
    return m.agg(F.count(F.lit(1)).alias("mentions"), F.sum("occurrences").alias("occurrences"), F.sum(F.size("sources").cast("long")).alias("source_marks"))


# ---- sinks and generated data -----------------------------------------------


@R.add("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def partitioned_write(spark: SparkSession, d: str) -> DataFrame:
    """Orders written by status as directories and read back."""
    from riskweave.runtime import shared_dir

    at = f"{shared_dir(spark)}/by-status-{uuid.uuid4().hex[:12]}"
    read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(at)
    return spark.read.parquet(at).select("o_orderkey", "o_totalprice", F.col("o_orderstatus").cast("string").alias("o_orderstatus"))


@R.add("SELECT CAST(count(*) * 2 AS BIGINT) AS rows, count(*) AS reprocessed, count(DISTINCT s_suppkey) AS hashes FROM supplier")
def load_columns(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers with load-control columns, all delivered again by a reprocessed file."""
    x = tables.reprocessed(tables.with_load_columns(read(spark, d, "supplier"), "2025-09-02", "SUP_20250901.csv.gz"), 1.0, 5)
    return x.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("nm_arqv_orgm").contains("REPROC"), 1)).alias("reprocessed"), F.countDistinct("cd_hash_linha").alias("hashes"))


@R.add("SELECT o_custkey % 97 AS nu_ec, CAST(count(*) AS DOUBLE) AS advance_count FROM orders GROUP BY 1")
def advance_features(spark: SparkSession, d: str) -> DataFrame:
    from riskweave.operators.features import advance_features as per_store

    return per_store(silver.advances(raw_advances(spark, d)))


@R.add()
def synthetic_rings(spark: SparkSession, d: str) -> DataFrame:
    """Edges of generated stores with planted rings; the tables are not read."""
    from riskweave.sources.synthetic import rings

    return rings(spark, stores=400, people=4000, rings=10)[1]


_DOC_RAWS = f"SELECT NU_DCMT AS raw FROM {HUB} UNION SELECT nu_oprc_cpf_ptdr_pld FROM {CARDS} UNION SELECT nu_cpf_ptdr_ecommerce FROM {CARDS} UNION SELECT nu_pix_cpf_cnpj_pgdr FROM {PIX} UNION SELECT nu_cpf_cnpj_recr FROM {PIX}"
_ALL_CARDS = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id_unco ORDER BY dt_crga DESC NULLS LAST, qt_cnar_ordm DESC NULLS LAST, dt_oprc DESC NULLS LAST, hr_oprc DESC NULLS LAST) AS rn FROM {CARDS}) WHERE rn = 1 AND coalesce(vl_tste, 0) = 0 AND NOT contains(upper(coalesce(nm_estn, '')), 'TESTE') AND vl_trns > 0.01"


def _edge_sql(name: str, source: str, src: str, dst: str, amount: str = "CAST(NULL AS DOUBLE)") -> str:
    return f"SELECT '{name}' AS relation, {src} AS src, {dst} AS dst, {amount} AS amount FROM {source}"


_EDGE_PARTS = " UNION ALL ".join([
    _edge_sql("titular", "s", "'LOJA:' || nu_ec", "'DOC:' || document"), _edge_sql("recebe_em", "p", "'DOC:' || receiver", f"'CONTA:' || {sql_account('nu_ispb_recr', 'nu_agnc_recr', 'nu_cnta_recr')}", "vl_trns"),
    _edge_sql("paga_com", "p", "'DOC:' || payer", f"'CONTA:' || {sql_account('nu_pix_ispb_pgdr', 'nu_pix_agnc_pgdr', 'nu_pix_cnta_pgdr')}", "vl_trns"), _edge_sql("usa_dispositivo", "p", "'DOC:' || payer", "'DISP:' || id_dspi"),
    _edge_sql("portador", "cm", "'DOC:' || holder", "'CARTAO:' || nu_crto_tken"), _edge_sql("compra", "cm", "'CARTAO:' || nu_crto_tken", "'LOJA:' || id_estn", "vl_trns"), _edge_sql("pix", "p", "'DOC:' || payer", "'DOC:' || CASE WHEN in_acto = '1' THEN receiver END", "vl_trns"),
    _edge_sql("entrega_em", "cm", "'DOC:' || holder", f"'END:' || {sql_address('tx_endr_enta_ecommerce')}"),
])
_BUILT = ("titular", "recebe_em", "paga_com", "usa_dispositivo", "portador", "compra", "pix", "entrega_em")


@R.add(f"""WITH {sql_documents(_DOC_RAWS)}, dm AS MATERIALIZED (SELECT raw, doc FROM docs),
 cm AS MATERIALIZED (SELECT x.*, dm.doc AS holder FROM ({_ALL_CARDS}) x LEFT JOIN dm ON dm.raw = coalesce(nu_oprc_cpf_ptdr_pld, nu_cpf_ptdr_ecommerce)),
 p AS MATERIALIZED (SELECT x.*, a.doc AS payer, b.doc AS receiver FROM ({_PIX_ONCE}) x LEFT JOIN dm a ON a.raw = nu_pix_cpf_cnpj_pgdr LEFT JOIN dm b ON b.raw = nu_cpf_cnpj_recr),
 s AS (SELECT NU_EC AS nu_ec, dm.doc AS document FROM ({_LAST}) h LEFT JOIN dm ON dm.raw = h.NU_DCMT),
 e AS (SELECT relation, src, dst, count(*) AS qty, sum(amount) AS amount FROM ({_EDGE_PARTS}) WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst GROUP BY 1, 2, 3)
 SELECT relation, count(*) AS edges, sum(qty) AS qty, round(sum(amount), 2) AS amount FROM e GROUP BY 1""")
def graph_from_records(spark: SparkSession, d: str) -> DataFrame:
    """The graph built from the raw tables, counted per relation."""
    stores = silver.store_master(silver.monthly_hub(read(spark, d, HUB)))
    e = silver.graph_edges(stores, silver.card_transactions(read(spark, d, CARDS)), silver.instant_payments(read(spark, d, PIX)))
    return e.where(F.col("relation").isin(*_BUILT)).groupBy("relation").agg(F.count(F.lit(1)).alias("edges"), F.sum("qty").alias("qty"), F.round(F.sum("amount"), 2).alias("amount"))


R.typed("mention_assembly", occurrences="BIGINT", source_marks="BIGINT")
R.typed("graph_from_records", qty="BIGINT")
