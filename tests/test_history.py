"""Versions of attributes and the comparison of addresses."""

import random

import pytest
from pyspark.sql import functions as F

from riskweave.functions.addresses import parse_address
from riskweave.operators.history import fold_versions, month_before, store_history

SCHEMA = "CD_MES long, NU_EC long, NU_DCMT string, DC_ENDR string, DT_CRGA date, extra string"


def versions(spark, rows):
    import datetime

    day = lambda n: datetime.date(2025, 1, 1) + datetime.timedelta(n)
    df = spark.createDataFrame([(m, e, doc, a, day(n), "x") for m, e, doc, a, n in rows], SCHEMA)
    return [tuple(r) for r in store_history(df).select("nu_ec", "cd_mes_de", "cd_mes_ate").sort("nu_ec", "cd_mes_de").collect()]


def changed(spark, a, b):
    return len(versions(spark, [(202501, 1, None, a, 0), (202502, 1, None, b, 0)])) == 2


@pytest.mark.parametrize(
    "a,b",
    [
        ("Rua Maria da Silva, 10", "Rua Joao da Silva, 10"),
        ("Rua das Flores, 10 - Centro - Campinas/SP", "Rua das Flores, 10 - Centro - Sorocaba/SP"),
        ("Rua Tirso, 5, Santa Maria/RS", "Rua Tirso, 5, Santa Maria/DF"),
        ("Rua Padre Anchieta, 3", "Rua Coronel Anchieta, 3"),
        ("Rua A Tirso, 5", "Rua A Tirso, 6"),
    ],
)
def test_other_locations(spark, a, b):
    assert changed(spark, a, b)


@pytest.mark.parametrize(
    "a,b",
    [
        ("Rua Maria da Silva, 10", "R. M. da Silva nº 10"),
        ("Rua Padre Anchieta, 3, Campinas", "RUA PE ANCHIETA 3 - CAMPINAS/SP"),
        ("Rua Tirsolando, 5 ap 3", "rua tirsolnado, 5"),
        ("Rua Tirso, 5", "NAO INFORMADO"),
        ("Rua Tirso, 5", None),
        ("Rua Tirso, 5", ""),
    ],
)
def test_respellings_and_missing_values_are_no_change(spark, a, b):
    assert not changed(spark, a, b)


def test_reloads_gaps_documents_and_returns(spark):
    good, other = "12345678909", "52998224725"
    rows = [
        (202501, 7, good, None, 0), (202501, 7, other, None, 5), (202501, 7, other, None, 5),  # the later load holds, twice
        (202502, 7, "529.982.247-25", None, 0), (202503, 7, "52998224726", None, 0),  # mask; failing check digits
        (202505, 7, good, None, 0), (202506, 7, other, None, 0),  # a gap, a change, a return
        (202501, 8, None, None, 0),
    ]
    assert versions(spark, rows) == [(7, 202501, 202504), (7, 202505, 202505), (7, 202506, 999912), (8, 202501, 999912)]


def test_empty_and_null_keys(spark):
    assert versions(spark, []) == []
    assert versions(spark, [(None, 1, "1", "x", 0), (202501, None, "1", "x", 0)]) == []


def test_fold_equals_a_plain_loop(spark):
    rng = random.Random(1)
    rows = [(e, m, rng.choice([None, "a", "b"]), rng.choice([None, 1, 2])) for e in range(30) for m in range(202501, 202509) if rng.random() < 0.7]
    want = set()
    for e in {r[0] for r in rows}:
        last = None
        for _, m, x, y in sorted((r for r in rows if r[0] == e), key=lambda r: r[1]):
            if last is None or (x is not None and last[0] not in (None, x)) or (y is not None and last[1] not in (None, y)):
                last = [x if x is not None or last is None else last[0], y if y is not None or last is None else last[1]]
                want.add((e, m))
            else:
                last = [last[0] if last[0] is not None else x, last[1] if last[1] is not None else y]
    got = fold_versions(spark.createDataFrame(rows, "e long, m long, x string, y long"), "e", "m", ["x", "y"])
    assert {(r["e"], r["valid_from"]) for r in got.collect()} == want


def test_month_before(spark):
    df = spark.createDataFrame([(202501,), (202512,)], "m long").select(month_before(F.col("m")))
    assert [r[0] for r in df.collect()] == [202412, 202511]


def test_parser_reads_whole_texts():
    long = "Rua Tirso, 5, " + "Bairro Lilas, " * 5000 + "Campinas/SP"
    assert parse_address(long)[7] == "CAMPINAS"
    assert parse_address("S/N") is None and parse_address("") is None and parse_address(None) is None
