"""Address and name records that mean one location, person or organisation."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from riskweave.llm import names, places
from riskweave.llm.namegrammar import describe, name_words
from riskweave.llm.spellings import choose_bands, collision, few_edits, misspellings, typing_errors, with_band_keys, with_deletion_keys
from riskweave.runtime import Cuts, session


@pytest.fixture(scope="module")
def spark():
    return session("records", "local[2]", **{"spark.sql.shuffle.partitions": "2"})


def _hub(spark, address="Rua Ana Trelfonso, 12, Porto Belvar - CEP 11111-222", name="Padaria Trelfonso Ltda", town="PORTO BELVAR"):
    return spark.createDataFrame([(202501, 1, "2025-02-01", address, town, name)], "CD_MES long, NU_EC long, DT_CRGA string, DC_ENDR string, NM_MNCP string, NM_EC string")


def _cards(spark, rows):
    return spark.createDataFrame([(i, "2025-01-01", *r) for i, r in enumerate(rows)], "qt_cnar_ordm long, dt_crga string, tx_endr_ptdr_ecommerce string, tx_endr_enta_ecommerce string, tx_oprc_nm_ptdr_pld string, nm_ptdr_crto_ecommerce string")


def test_both_queries_are_registered():
    assert {"p3_found", "p4_found"} <= set(__spark_entry__.queries())


def test_addresses_of_one_location(spark):
    cards = _cards(spark, [("R. A. TRELFONSO 12 AP 3", "Rua Ana Trelfnoso, 12 - 11111222", None, None), ("Alameda Ana Trelfonso, 12, Porto Belvar", "Rua Ana Trelfonso, 14, Porto Belvar", None, None), ("N/I", "Rua Ana Trelfonso, 12, Serra Mundil, CEP 99999-000", None, None)])
    got = {tuple(r) for r in places.same_location_pairs(_hub(spark, "Rua Ana Trelfonso, 12, Porto Belvar - CEP 11111-222"), cards).collect()}
    assert {("EC:1", "EN:0")} <= got
    assert not any({"PT:1", "EN:1", "PT:2", "EN:2"} & set(p) for p in got)
    # without a second town of the same street the bare address joins too
    got = {tuple(r) for r in places.same_location_pairs(_hub(spark), cards.where("qt_cnar_ordm = 0")).collect()}
    assert got == {("EC:1", "EN:0"), ("EC:1", "PT:0"), ("EN:0", "PT:0")}


def test_names_of_one_entity(spark):
    cards = _cards(spark, [(None, None, "Sebastião de Jarmposo Derrirnhoto", "S. JARMPOSO DERRIRNHOTO"), (None, None, "DERRIRNOHTO/TIAO J", "Norberto de Jarmposo Derrirnhoto"), (None, None, "NAO INFORMADO", "TRELFONSO PAD.")])
    got = {tuple(r) for r in names.same_name_pairs(_hub(spark), cards).collect()}
    assert got == {("NE:0", "PL:0"), ("PL:0", "PL:1"), ("NE:0", "PL:1"), ("EC:1", "NE:2")}


def test_name_grammar():
    told = lambda t: describe(name_words(t))[:4]
    assert told("E. Mallano Dizurdourel") == ("P", "DIZURDOUREL", "E", "MALLANO")
    assert told("Nuncrelqueiro Conceição do Brazende") == ("P", "NUNCRELQUEIRO", "CONCEICAO", "BRAZENDE")
    assert told("DERRIRNHOTO/TIAO J") == ("P", "DERRIRNHOTO", "TIAO", "J")
    assert told("Papelaria Zonfer e Cia Ltda") == ("O", "ZONFER", "PAPELARIA", "CIA")
    assert name_words("CONSUMIDOR FINAL") is None and name_words("") is None and name_words(None) is None


def test_empty_tables_nulls_long_texts_and_extra_columns(spark):
    hub, cards = _hub(spark).withColumn("text", F.lit("x")).withColumn("rec", F.lit("y")), _cards(spark, [])
    assert places.same_location_pairs(hub.limit(0), cards).count() == 0 and names.same_name_pairs(hub.limit(0), cards).count() == 0
    long = "Rua Ana Trelfonso, 12, Porto Belvar " + "ap 1 " * 4000
    rows = [(long, None, "x " * 3000, None), (None, None, None, None), ("", "", "", ""), ("Rua Ana Trelfonso, 12, Porto Belvar",) * 2 + ("Padaria Trelfonso ME",) * 2]
    cards = _cards(spark, rows).withColumn("e", F.lit(1)).withColumn("n", F.lit(None).cast("string")).withColumn("location", F.lit("z"))
    got = {tuple(r) for r in places.same_location_pairs(hub, cards).collect()}
    assert {("EC:1", "PT:0"), ("EC:1", "PT:3"), ("EC:1", "EN:3"), ("EN:3", "PT:0"), ("PT:0", "PT:3")} == got  # EN:3 and PT:3 are copies
    assert {tuple(r) for r in names.same_name_pairs(hub, cards).collect()} == {("EC:1", "NE:3"), ("EC:1", "PL:3")}


def test_ambiguous_records_stay_unlinked(spark):
    cards = _cards(
        spark,
        [
            ("Rua Ana Trelfonso, 12, Porto Belvar/SP, CEP 11111-222", "Rua Ana Trelfonso, 12, Serra Mundil/BA, CEP 99999-000", "Ana Jarmposo Derrirnhoto", "Antonio Jarmposo Derrirnhoto"),
            ("Rua Ana Trelfonso 12", "Rua Ana Trelfonso, 12, Serra Mundil", "A. J. Derrirnhoto", "Toninho Derrirnhoto"),
        ],
    )
    hub = _hub(spark, "N/I", "TESTE", None)
    assert {tuple(r) for r in places.same_location_pairs(hub, cards).collect()} == {("EN:0", "EN:1")}
    assert {tuple(r) for r in names.same_name_pairs(hub, cards).collect()} == {("NE:0", "NE:1")}


def test_collision_curve():
    assert abs(collision(0.5, 2, 1) - 0.75) < 1e-12
    for n in (10, 10_000, 1_000_000):
        bands, rows = choose_bands(n)
        assert collision(0.57, bands, rows) >= 0.92
    assert choose_bands(1_000_000)[1] > choose_bands(100)[1]


def test_stars_hang_on_centers_only(spark):
    cuts = Cuts(spark, "test")
    words = spark.createDataFrame([("TRELFONSO", 20), ("TRELFONSX", 1), ("TRELFONXX", 1), ("DERRIRNHOTO", 5), ("DERRIRNOHTO", 1), ("ABC", 9), ("ABD", 1)], "w string, n long")
    got = {r["w"]: r["center"] for r in misspellings(words, cuts, lambda w: with_band_keys(w, 40, 2), typing_errors).collect()}
    assert got["TRELFONSX"] == "TRELFONSO" and got["DERRIRNOHTO"] == "DERRIRNHOTO" and "ABD" not in got
    assert set(got.values()) & set(got) == set()
    assert misspellings(words.limit(0), cuts, with_deletion_keys).count() == 0


def test_keys_never_go_to_the_driver(spark, monkeypatch):
    """A few words have many keys; their join is no broadcast, small as the file of the words is."""
    plans, put = [], Cuts.put
    monkeypatch.setattr(Cuts, "put", lambda self, df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), put(self, df))[1])
    words = put(Cuts(spark, "test"), spark.createDataFrame([("TRELFONSO", 20), ("TRELFONSX", 1), ("DERRIRNHOTO", 5)], "w string, n long"))
    for keyed in (with_deletion_keys, lambda w: with_band_keys(w, 40, 2)):
        plans.clear()
        assert {r["w"] for r in misspellings(words, Cuts(spark, "test"), keyed, few_edits).collect()} == {"TRELFONSX"}
        assert len(plans) > 1 and not any("BroadcastHashJoin" in p for p in plans)


def test_streets_and_localities_stay_with_the_executors(spark, monkeypatch):
    """Only the known localities, found by place or store, may be broadcast."""
    plans, put = [], Cuts.put
    monkeypatch.setattr(Cuts, "put", lambda self, df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), put(self, df))[1])
    cards = _cards(spark, [("R. A. TRELFONSO 12 AP 3", "Rua Ana Trelfnoso, 12 - 11111222", None, None)])
    assert places.same_location_pairs(_hub(spark), cards).count() == 3
    joins = [line for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line]
    assert all("[p#" in j or "[hint#" in j for j in joins), joins


def test_plans_of_names_stay_small(spark, monkeypatch):
    """The driver holds a plan and its versions whole, so persons and organisations are written step by step."""
    plans, put = [], Cuts.put
    monkeypatch.setattr(Cuts, "put", lambda self, df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), put(self, df))[1])
    cards = _cards(spark, [(None, None, "Sebastião de Jarmposo Derrirnhoto", "S. JARMPOSO DERRIRNHOTO")])
    assert names.same_name_pairs(_hub(spark), cards).count() == 1
    assert max(p.count("Join ") for p in plans) <= 8
