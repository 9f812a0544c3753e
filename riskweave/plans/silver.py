"""Standardised tables from raw deliveries, and the graph built from them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.documents import standard_document, tax_root
from riskweave.functions.standard import account_key, address_std, decimal_comma, email_std, mixed_timestamp, name_std, payment_key_type, phone_e164, state_code, strip_municipality
from riskweave.operators.graph import build_edges, complete_vertices, regroup
from riskweave.operators.linkage import mentions
from riskweave.operators.relational import dedup_latest, is_active, latest_snapshot


def monthly_hub(hub: DataFrame) -> DataFrame:
    """Store-months without reloads: standard document, state, address; negative turnover null."""
    h = dedup_latest(hub, ["CD_MES", "NU_EC"], ["DT_CRGA"])
    d = standard_document(F.col("NU_DCMT"))
    return h.withColumns(
        {
            "_d": d,
            "NM_UF": state_code(F.col("NM_UF")),
            "address": address_std(strip_municipality(F.col("DC_ENDR"), F.col("NM_MNCP"))),
            "VL_FTRM": F.when(F.col("VL_FTRM") >= 0, F.col("VL_FTRM")),
        }
    ).select("*", F.col("_d.doc").alias("document"), F.col("_d.person").alias("person"), F.col("_d.valid").alias("document_valid")).drop("_d")


# Kinds of watch list and of watched objects.
LIST_KINDS = {"psit": "POSITIVA", "ngto": "NEGATIVA", "psit_atzd": "POSITIVA AUTORIZADA"}
OBJECT_KINDS = {"crto": "CARTAO", "clnt": "CLIENTE", "ec": "EC"}


def watch_lists(lists: Mapping[tuple[str, str], DataFrame], as_of: Column) -> DataFrame:
    """list_kind, object_kind, object, entered, left, active over all lists given by (list, object) kind.

    Each list has id_objt_prcp, dt_etra_lsta (two written forms), dt_sada_lsta
    and dt_crga; of reloads the last counts. Clients' ids are padded to 11.
    """
    out = None
    for (kind, obj), df in lists.items():
        d = dedup_latest(df, ["id_objt_prcp", "dt_etra_lsta"], ["dt_crga"], ["dt_sada_lsta"])
        ident = F.col("id_objt_prcp").cast("string")
        one = d.select(
            F.lit(LIST_KINDS[kind]).alias("list_kind"), F.lit(OBJECT_KINDS[obj]).alias("object_kind"), (F.when(F.length(ident) < 11, F.lpad(ident, 11, "0")).otherwise(ident) if obj == "clnt" else ident).alias("object"),
            F.coalesce(F.try_to_timestamp("dt_etra_lsta", F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp("dt_etra_lsta", F.lit("dd/MM/yyyy HH:mm"))).alias("entered"), F.try_to_timestamp("dt_sada_lsta").alias("left"),
        )
        out = one if out is None else out.unionByName(one)
    return out.withColumn("active", is_active(F.col("left"), as_of))


def flagged_stores(lists: DataFrame) -> DataFrame:
    """nu_ec, flagged of stores on an active negative list."""
    return lists.where("list_kind = 'NEGATIVA' and object_kind = 'EC' and active").select(F.col("object").try_cast("bigint").alias("nu_ec")).where("nu_ec is not null").distinct().withColumn("flagged", F.lit(1))


def store_master(months: DataFrame, flagged: DataFrame | None = None) -> DataFrame:
    """Stores by their last month, with names, root and flag."""
    keep = ["NM_EC", "NM_CLNT", "document", "person", "document_valid", "TIPO_CLNT", "NM_UF", "NM_MNCP", "address", "CD_RMAT", "NM_RMAT", "QT_DIAS_AFLC", "VL_FTRM", "PC_CHRG", "IN_SOCO_PEP", "IN_ALTR_QDRO_SCTR"]
    s = latest_snapshot(months, "NU_EC", "CD_MES", "DT_CRGA", keep).select(
        F.col("NU_EC").alias("nu_ec"), name_std(F.col("NM_EC")).alias("name"), name_std(F.col("NM_CLNT")).alias("company"), "document", "person", "document_valid", tax_root(F.col("document")).alias("root"),
        F.col("TIPO_CLNT").alias("client_kind"), F.col("NM_UF").alias("state"), F.col("NM_MNCP").alias("municipality"), "address", F.col("CD_RMAT").alias("industry_code"), F.col("NM_RMAT").alias("industry"),
        F.col("QT_DIAS_AFLC").alias("age_days"), F.coalesce("VL_FTRM", F.lit(0.0)).alias("turnover"), F.coalesce("PC_CHRG", F.lit(0.0)).alias("chargeback_pct"), F.col("IN_SOCO_PEP").alias("pep"), F.col("IN_ALTR_QDRO_SCTR").alias("ownership_change"),
    )
    return s.join(flagged, "nu_ec", "left").fillna(0, ["flagged"]) if flagged is not None else s.withColumn("flagged", F.lit(0))


def is_real(test_amount: Column, name: Column, amount: Column) -> Column:
    """No test transaction: no test amount, no TESTE in the name, more than a cent."""
    return (F.coalesce(test_amount, F.lit(0.0)) == 0) & ~F.upper(F.coalesce(name, F.lit(""))).contains("TESTE") & (amount > 0.01)


def typology_flags(at: Column, amount: Column, kind: Column) -> dict[str, Column]:
    """night (0-4 h), below_limit, round_amount and prepaid."""
    return {
        "night": F.hour(at).between(0, 4),
        "below_limit": amount.between(9000, 9999.99) | amount.between(4500, 4999.99),
        "round_amount": (amount >= 500) & (amount % 500 == 0),
        "prepaid": kind == "PRE-PAGO",
    }


def card_transactions(cards: DataFrame) -> DataFrame:
    """Card messages once each, without tests, with standard holder fields and typology flags."""
    keep = ["qt_cnar_ordm", "dt_oprc", "hr_oprc", "id_estn", "vl_trns", "vl_tste", "nm_estn", "in_acto", "in_etnc", "cd_tipo_crto", "nu_crto_tken", "nu_score_totl", "id_rgra_pld", "cd_pais_crto", "nu_oprc_cpf_ptdr_pld", "nu_cpf_ptdr_ecommerce",
            "tx_oprc_nm_ptdr_pld", "nm_ptdr_crto_ecommerce", "nm_ptdr_crto_chip", "nu_celr_ptdr_ecommerce", "tx_emal_ptdr_ecommerce", "tx_endr_ptdr_ecommerce", "tx_endr_enta_ecommerce"]
    c = dedup_latest(cards, ["id_unco"], ["dt_crga"], keep).where(is_real(F.col("vl_tste"), F.col("nm_estn"), F.col("vl_trns")))
    c = c.select(
        "id_unco", mixed_timestamp(F.col("dt_oprc"), F.col("hr_oprc")).alias("at"), F.col("id_estn").alias("nu_ec"), F.col("vl_trns").alias("amount"), (F.col("in_acto") == "1").alias("approved"), (F.col("in_etnc") == "1").alias("not_present"),
        F.col("cd_tipo_crto").alias("card_kind"), F.col("nu_crto_tken").alias("token"), F.col("nu_score_totl").alias("score"), F.col("id_rgra_pld").isNotNull().alias("rule_fired"), F.col("cd_pais_crto").alias("card_country"),
        standard_document(F.coalesce("nu_oprc_cpf_ptdr_pld", "nu_cpf_ptdr_ecommerce"))["doc"].alias("holder"), name_std(F.coalesce("tx_oprc_nm_ptdr_pld", "nm_ptdr_crto_ecommerce", "nm_ptdr_crto_chip")).alias("holder_name"),
        phone_e164(F.col("nu_celr_ptdr_ecommerce")).alias("phone"), email_std(F.col("tx_emal_ptdr_ecommerce")).alias("email"), address_std(F.col("tx_endr_ptdr_ecommerce")).alias("address"), address_std(F.col("tx_endr_enta_ecommerce")).alias("delivery"),
    )
    return c.withColumns(typology_flags(F.col("at"), F.col("amount"), F.col("card_kind")))


def instant_payments(pix: DataFrame) -> DataFrame:
    """Instant payments once each, both sides standardised, account age, mule marks, key kinds."""
    keep = [c for c in pix.columns if c not in ("id_unco_pix", "dt_crga", "nm_arqv_orgm")]
    p = dedup_latest(pix, ["id_unco_pix"], ["dt_crga"], keep)
    day = lambda c: F.to_date(F.try_to_timestamp(F.col(c).cast("string"), F.lit("yyyyMMdd")))
    return p.select(
        F.col("id_unco_pix").alias("payment_id"), mixed_timestamp(F.col("dt_oprc"), F.col("hr_oprc")).alias("at"), F.col("id_estn").alias("nu_ec"), F.col("cd_tipo_oprc_pix").alias("kind"), F.col("vl_trns").alias("amount"), (F.col("in_acto") == "1").alias("approved"),
        standard_document(F.col("nu_pix_cpf_cnpj_pgdr"))["doc"].alias("payer"), name_std(F.col("tx_pix_nm_pgdr")).alias("payer_name"), account_key(F.col("nu_pix_ispb_pgdr"), F.col("nu_pix_agnc_pgdr"), F.col("nu_pix_cnta_pgdr")).alias("payer_account"),
        F.col("tx_chve_pix_pgdr").alias("payer_key"), payment_key_type(F.col("tx_chve_pix_pgdr")).alias("payer_key_kind"), email_std(F.col("tx_usro_pix")).alias("payer_email"),
        standard_document(F.col("nu_cpf_cnpj_recr"))["doc"].alias("receiver"), name_std(F.col("nm_recr")).alias("receiver_name"), account_key(F.col("nu_ispb_recr"), F.col("nu_agnc_recr"), F.col("nu_cnta_recr")).alias("receiver_account"),
        F.col("tx_chve_pix_recr").alias("receiver_key"), payment_key_type(F.col("tx_chve_pix_recr")).alias("receiver_key_kind"), F.col("id_dspi").alias("device"), F.datediff(day("dt_oprc"), day("dt_crca_cnta")).alias("account_days"),
        (F.col("qt_d90_stooge_acc_mrca_frde_us") + F.col("qt_d90_frde_acc_mrca_frde_us")).alias("mule_marks"),
    )


def advances(raw: DataFrame) -> DataFrame:
    """Receivable advances once each: amounts with comma or point, two documents, settlement account."""
    a = dedup_latest(raw, ["id_unco_lynx"], ["dt_crga"])
    return a.select("id_unco_lynx", mixed_timestamp(F.col("dt_antp"), F.col("hr_antp")).alias("at"), F.col("id_estn").try_cast("bigint").alias("nu_ec"), decimal_comma(F.col("vl_trns")).alias("amount"), (F.col("in_acto") == "1").alias("approved"),
                    standard_document(F.col("nu_cnpj_rspe_dmcl").cast("string"))["doc"].alias("holder"), standard_document(F.col("nu_cnpj_cpf_mqnt"))["doc"].alias("responsible"), account_key(F.col("nu_ispb"), F.col("nu_agnc"), F.col("nu_cnta")).alias("account"))


def reported_fraud(raw: DataFrame, cards: DataFrame) -> DataFrame:
    """Reports once each with both times, and store and card of the transaction where it is known."""
    r = dedup_latest(raw, ["id_unco_lynx"], ["dt_crga"], ["dh_trns", "dh_reporte", "cd_tipo_rsps_frde"])
    r = r.select("id_unco_lynx", F.try_to_timestamp("dh_trns").alias("at"), F.try_to_timestamp("dh_reporte").alias("reported_at"), F.col("cd_tipo_rsps_frde").alias("kind"))
    return r.join(cards.select(F.col("id_unco").alias("id_unco_lynx"), "nu_ec", "token"), "id_unco_lynx", "left")


def _mention(df: DataFrame, document: str, **fields: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(F.col(document).alias("document"), *[fields.get(f, none).alias(f) for f in ("name", "address", "phone", "email")])


def mention_sources(months: DataFrame, cards: DataFrame, payments: DataFrame, advanced: DataFrame | None = None) -> dict[str, DataFrame]:
    """The sources that mention people and companies, in the five compared fields."""
    key = lambda side, kind: F.when(F.col(f"{side}_key_kind") == kind, F.col(f"{side}_key"))
    out = {
        "hub_owner": _mention(months, "document", name=name_std(F.col("NM_CLNT")), address=F.col("address")),
        "card_holder": _mention(cards, "holder", name=F.col("holder_name"), phone=F.col("phone"), email=F.col("email"), address=F.col("address")),
        "pix_payer": _mention(payments, "payer", name=F.col("payer_name"), phone=phone_e164(key("payer", "PHONE")), email=F.col("payer_email")),
        "pix_receiver": _mention(payments, "receiver", name=F.col("receiver_name"), phone=phone_e164(key("receiver", "PHONE")), email=email_std(key("receiver", "EMAIL"))),
    }
    if advanced is not None:
        out |= {"advance_holder": _mention(advanced, "holder"), "advance_responsible": _mention(advanced, "responsible")}
    return out


def all_mentions(months: DataFrame, cards: DataFrame, payments: DataFrame, advanced: DataFrame | None = None) -> DataFrame:
    return mentions(mention_sources(months, cards, payments, advanced))


def graph_edges(stores: DataFrame, cards: DataFrame, payments: DataFrame, advanced: DataFrame | None = None) -> DataFrame:
    """The edges of all relations, one row per source, target and relation."""
    at = lambda prefix, c: F.concat(F.lit(prefix + ":"), F.col(c).cast("string") if isinstance(c, str) else c)
    key = lambda side, kind: F.when(F.col(f"{side}_key_kind") == kind, F.col(f"{side}_key"))
    t, v = F.col("at"), F.col("amount")
    parts = [
        build_edges(stores, at("LOJA", "nu_ec"), at("DOC", "document"), "titular"),
        build_edges(stores, at("LOJA", "nu_ec"), at("END", "address"), "localizada_em"),
        build_edges(payments, at("DOC", "receiver"), at("CONTA", "receiver_account"), "recebe_em", v, t),
        build_edges(payments, at("DOC", "payer"), at("CONTA", "payer_account"), "paga_com", v, t),
        build_edges(cards, at("DOC", "holder"), at("TEL", "phone"), "tem_telefone", None, t),
        build_edges(payments, at("DOC", "receiver"), at("TEL", phone_e164(key("receiver", "PHONE"))), "tem_telefone", None, t),
        build_edges(payments, at("DOC", "payer"), at("TEL", phone_e164(key("payer", "PHONE"))), "tem_telefone", None, t),
        build_edges(cards, at("DOC", "holder"), at("EMAIL", "email"), "tem_email", None, t),
        build_edges(payments, at("DOC", "payer"), at("EMAIL", "payer_email"), "tem_email", None, t),
        build_edges(payments, at("DOC", "receiver"), at("EMAIL", email_std(key("receiver", "EMAIL"))), "tem_email", None, t),
        build_edges(payments, at("DOC", "payer"), at("DISP", "device"), "usa_dispositivo", None, t),
        build_edges(cards, at("DOC", "holder"), at("END", "delivery"), "entrega_em", None, t),
        build_edges(cards, at("DOC", "holder"), at("CARTAO", "token"), "portador", None, t),
        build_edges(cards, at("CARTAO", "token"), at("LOJA", "nu_ec"), "compra", v, t),
        build_edges(payments.where("approved"), at("DOC", "payer"), at("DOC", "receiver"), "pix", v, t),
    ]
    if advanced is not None:
        owner = stores.select("nu_ec", "document")
        parts += [
            build_edges(advanced.join(owner, "nu_ec").where("responsible <> document"), at("LOJA", "nu_ec"), at("DOC", "responsible"), "socio", None, t),
            build_edges(advanced, at("LOJA", "nu_ec"), at("CONTA", "account"), "liquida_em", v, t),
        ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return regroup(out)


def graph_vertices(stores: DataFrame, edges: DataFrame, mentioned: DataFrame) -> DataFrame:
    """Stores first, then every other end with type and the name most often mentioned for it (ties by name)."""
    best = mentioned.where("name is not null").groupBy("document").agg(F.max(F.struct("occurrences", "name")).alias("_b")).select(F.col("document").alias("value"), F.col("_b.name").alias("name"))
    known = stores.select(F.concat(F.lit("LOJA:"), F.col("nu_ec").cast("string")).alias("id"), F.lit("LOJA").alias("type"), "name", "root", "flagged", "chargeback_pct")
    return complete_vertices(known, edges, best)
