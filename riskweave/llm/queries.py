"""The pN queries of the language problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import bpe, components, lookalike, mixing, names, places
from riskweave.runtime import read


HUB, CARDS = "tbciar_re_hub_dado_risc_cred", "tbciar_tr_lynx_trns_crto"


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return places.same_location_pairs(read(spark, d, HUB), read(spark, d, CARDS))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return names.same_name_pairs(read(spark, d, HUB), read(spark, d, CARDS))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return components.identity_groups(read(spark, d, "identidade"), read(spark, d, "pares_identidade"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(read(spark, d, "documents"), "doc_id", "text")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.Mix(read(spark, d, "documents"), read(spark, d, "mistura_alvo")).shares()


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """One row per drawn copy of a document."""
    drawn = mixing.Mix(read(spark, d, "documents"), read(spark, d, "mistura_alvo")).drawn
    return drawn.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_look_pairs(read(spark, d, "documents"), "doc_id", "text", "doc_id_a", "doc_id_b")


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each text with the class of its look and the class's sizes."""
    return lookalike.look_classes(read(spark, d, "documents"), "doc_id", "text")


def p10_texts(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.one_form(read(spark, d, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p3_found, p4_found, p7_found, p8_ids, p9_shares, p9_mix, p10_found, p10_classes, p10_texts)}

SQL = {
    "p7_found": """WITH RECURSIVE rows AS (
  SELECT DISTINCT cpf_cnpj AS d, id_identidade AS i FROM identidade WHERE cpf_cnpj IS NOT NULL),
 star AS (SELECT d, min(d) OVER (PARTITION BY i) AS m FROM rows WHERE i IS NOT NULL),
 e AS (SELECT cpf_cnpj_a AS a, cpf_cnpj_b AS b FROM pares_identidade WHERE cpf_cnpj_a IS NOT NULL AND cpf_cnpj_b IS NOT NULL
  UNION SELECT cpf_cnpj_b, cpf_cnpj_a FROM pares_identidade WHERE cpf_cnpj_a IS NOT NULL AND cpf_cnpj_b IS NOT NULL
  UNION SELECT d, m FROM star UNION SELECT m, d FROM star
  UNION SELECT d, d FROM rows
  UNION SELECT cpf_cnpj_a, cpf_cnpj_a FROM pares_identidade WHERE cpf_cnpj_a IS NOT NULL
  UNION SELECT cpf_cnpj_b, cpf_cnpj_b FROM pares_identidade WHERE cpf_cnpj_b IS NOT NULL),
 reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
 SELECT a AS cpf_cnpj, min(b) AS cpf_cnpj_grupo FROM reach GROUP BY a""",
}
