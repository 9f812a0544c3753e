"""Standard forms, tables, linkage and ranking on worked examples."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from riskweave.functions import standard
from riskweave.functions.documents import standard_document
from riskweave.operators import linkage, relational, risk
from riskweave.sources import synthetic, tables


def one(spark, value, f, *more):
    cols = ["a", *[f"m{i}" for i in range(len(more))]]
    df = spark.createDataFrame([(value, *more)], ", ".join(f"{c} string" for c in cols))
    return df.select(f(*[F.col(c) for c in cols])).first()[0]


@pytest.mark.parametrize("raw,area,want", [("(11) 98812-4471", None, "+5511988124471"), ("5511988124471", None, "+5511988124471"), ("988124471", "11", "+5511988124471"), ("+55 21 3123-4567", None, "+552131234567"), ("123", None, None), (None, None, None), ("", None, None)])
def test_phones(spark, raw, area, want):
    assert one(spark, raw, standard.phone_e164, area) == want


@pytest.mark.parametrize(
    "raw,want",
    [
        ("R. Augusta, Nº 1200", "RUA AUGUSTA 1200"), ("RUA AUGUSTA 1200", "RUA AUGUSTA 1200"), ("Av. Brasil, 455 - CEP 01310-100", "AVENIDA BRASIL 455"), ("avenida brasil, 455", "AVENIDA BRASIL 455"), ("Pça da Sé, 1", "PRACA DA SE 1"),
        ("Tv. das Flores, 10", "TRAVESSA DAS FLORES 10"), ("Rod. Anhanguera km 20", "RODOVIA ANHANGUERA KM 20"), ("Jd. Paulista, Nº 7", "JARDIM PAULISTA 7"), (" , ", None), (None, None),
    ],
)
def test_addresses(spark, raw, want):
    got = one(spark, raw, standard.address_std)
    assert got == want
    if want:
        assert one(spark, want, standard.address_std) == want


@pytest.mark.parametrize("raw,want", [("123.456.789-09", ("12345678909", "PF", True)), ("11.222.333/0001-81", ("11222333000181", "PJ", True)), ("1222333000181", ("01222333000181", "PJ", False)), (" 12345678900 ", ("12345678900", "PF", False)), ("", (None, None, None)), (None, (None, None, None)), ("1" * 20, ("1" * 20, "PJ", False))])
def test_documents(spark, raw, want):
    assert tuple(one(spark, raw, standard_document)) == want


def test_other_forms(spark):
    assert one(spark, "  Maria  Conceição ", standard.name_std) == "MARIA CONCEICAO"
    assert one(spark, " A@B.Com ", standard.email_std) == "a@b.com" and one(spark, "a@b", standard.email_std) is None
    assert one(spark, "1", standard.account_key, "0012", "000034") == "1|12|34" and one(spark, None, standard.account_key, "x", None) is None
    assert one(spark, "1.234,50", standard.decimal_comma) == 1234.5 and one(spark, "1234.5", standard.decimal_comma) == 1234.5 and one(spark, "x", standard.decimal_comma) is None
    assert one(spark, " são paulo".upper().replace("Ã", "A"), standard.state_code) == "SP" and one(spark, "rj ", standard.state_code) == "RJ"
    assert one(spark, "Rua A, 1,  S. (Paulo) - CEP", standard.strip_municipality, "S. (Paulo)") == "Rua A, 1"
    assert one(spark, "Rua A, 1", standard.strip_municipality, None) == "Rua A, 1"
    assert one(spark, "0" * 32, standard.payment_key_type) == "EVP" and one(spark, "x", standard.payment_key_type) is None
    assert one(spark, "20250901", standard.mixed_timestamp, "91559") == datetime.datetime(2025, 9, 1, 9, 15, 59)
    assert round(one(spark, "MARTHA", standard.jaro_winkler, "MARHTA"), 4) == 0.9611 and one(spark, None, standard.jaro_winkler, "x") is None


def test_tables(spark):
    df = tables.literal(spark, "A int, b string", [(1, "2"), (2, "x")])
    got = tables.conform(df, "b int, a string, c date")
    assert got.dtypes == [("b", "int"), ("a", "string"), ("c", "date")] and [tuple(r) for r in got.sort("a").collect()] == [(2, "1", None), (None, "2", None)]
    again = tables.reprocessed(tables.with_load_columns(df, "2025-01-01", "F1"), 1.0, 3)
    assert again.count() == 4 and again.where("nm_arqv_orgm like '%REPROC'").count() == 2
    assert tables.serve(spark, "SELECT * FROM t WHERE a = :x", {"t": df}, x=1).count() == 1
    with pytest.raises(ValueError):
        tables.bounded_pandas(df, 1)
    tables.ensure_schema(spark, "riskweave_test")
    saved = tables.save_table(df, "riskweave_test.t", "it's a comment", ["b"])
    assert saved.count() == 2 and "it's a comment" in str(spark.sql("DESCRIBE TABLE EXTENDED riskweave_test.t").collect())
    spark.sql("DROP SCHEMA riskweave_test CASCADE")


def test_relational_ties_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([("a", 1, "x", 0), ("a", 1, "y", 0), ("a", None, "z", 9), (None, 3, "q", 1)], "k string, o int, v string, _t int")
    assert {tuple(r) for r in relational.dedup_latest(df, ["k"], ["o"], ["v"]).collect()} == {("a", 1, "y"), (None, 3, "q")}
    ranks = relational.rank_rows(spark.range(500).select((-F.col("id")).alias("v")), [F.col("v")], "r", parts=7)
    assert {r["v"]: r["r"] for r in ranks.collect()} == {-i: 500 - i for i in range(500)}
    assert relational.rank_rows(spark.range(0), [F.col("id")], "r").count() == 0
    assert [tuple(r) for r in relational.histogram(df, "o", 2).sort("bucket").collect()] == [(0.0, 2), (2.0, 1)]
    assert [r["m"] for r in relational.leave_one_out(df.where("k = 'a' and o = 1"), ["k"], "o", "m").collect()] == [1.0, 1.0]
    assert relational.contains_or_prefix(F.lit("50% off"), F.lit(1), "") is not None


def test_linkage_end_to_end(spark):
    rng = random.Random(6)
    rows = []
    for i in range(120):
        doc, name, phone = f"{i * 7919:011}", f"NAME{i * 37:05} SUR{i % 40}", f"+5511{i:09}"
        rows.append((f"a{i}", doc, name, f"RUA {i}", phone, None))
        rows.append((f"b{i}", doc if rng.random() < 0.7 else doc[:-1] + "x", name, f"RUA {i}", phone if rng.random() < 0.5 else None, None))
    m = spark.createDataFrame(rows, "mention_id string, document string, name string, address string, phone string, email string")
    pairs = linkage.blocked_pairs(m)
    assert pairs.count() == pairs.select("id_l", "id_r").distinct().count()
    p = linkage.compared(pairs, m).cache()
    u = linkage.estimate_u(linkage.compared(linkage.random_pairs(m, 20_000), m))
    got = linkage.combine(linkage.estimate_m(p.where("g_document = 2"), u, 0.5, ["document"]), linkage.estimate_m(p.where("g_name = 3"), u, 0.5, ["name"]))
    assert all(abs(sum(v) - 1) < 1e-6 for v in [*got.values(), *u.values()])
    s = linkage.scored(p, got, u, linkage.prior(m).first()["lambda"])
    groups = linkage.clusters(m, s, 0.9)
    assert groups.select("component").distinct().count() == 120
    ident = linkage.identities(m, groups)
    assert ident.count() == m.select("document").distinct().count()
    assert linkage.blocked_pairs(m.limit(0)).count() == 0 and linkage.prior(m.limit(0)).first()["lambda"] is None


def test_mentions_tell_apart_where_a_value_stands(spark):
    df = spark.createDataFrame([("1", "x", None, None, None), ("1", None, "x", None, None), ("1", "x", None, None, None), (None, "x", None, None, None)], "document string, name string, address string, phone string, email string")
    got = linkage.mentions({"s": df, "t": df}).collect()
    assert len(got) == 2 and len({r["mention_id"] for r in got}) == 2 and sorted(r["occurrences"] for r in got) == [2, 4] and got[0]["sources"] == ["s", "t"]


def test_ranking_metrics_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9, 1), (2, 0.5, 0), (3, 0.5, 1), (4, 0.1, 0)], "id int, s double, y int")
    r = risk.ranking_metrics(df, "s", "y", "id", 2).first()
    assert abs(r["roc_auc"] - 0.875) < 1e-9 and r["precision_at_k"] == 0.5 and r["recall_at_k"] == 0.5
    assert abs(r["average_precision"] - (0.5 + 0.5 * 2 / 3)) < 1e-9
    split = risk.group_split(df.withColumn("g", F.col("id") % 2), "g", "y")
    assert split.groupBy("g").agg(F.countDistinct("in_test").alias("n")).where("n > 1").count() == 0


def test_synthetic_rings(spark):
    stores, edges = synthetic.rings(spark, stores=200, people=400, rings=5, seed=3)
    again = synthetic.rings(spark, stores=200, people=400, rings=5, seed=3)[1]
    assert sorted(map(str, edges.collect())) == sorted(map(str, again.collect()))
    assert edges.where("relation = 'pix' and ring is not null").count() >= 15
    from riskweave.operators.graph import cycles3

    assert cycles3(edges.where("relation = 'pix'"), 10_000.0, temporal=False).count() >= 5
