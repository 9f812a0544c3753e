"""Eager aggregation, and timestamps with their zones."""

import datetime
import random
import zoneinfo

from pyspark.sql import functions as F

from riskweave.operators import instants, skew

EDGE = "src string, dst string, relacao string, qt long, valor double, ts_min timestamp, ts_max timestamp"


def test_eager_join_equals_the_join(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["h", "h", "h", "a", "b", None]), rng.choice("xy"), rng.randrange(9)) for _ in range(200)]
    l = spark.createDataFrame(rows[:120], "k string, g string, q long")
    r = spark.createDataFrame(rows[120:], "k string, p string, s long")
    got = {tuple(x) for x in skew.eager_join(l, r, "k", ["g"], ["p"], ["q"], ["s"]).select("g", "p", "rows", "q", "s").collect()}
    want = {tuple(x) for x in l.join(r, "k").groupBy("g", "p").agg(F.count("*"), F.sum("q"), F.sum("s")).collect()}
    assert got == want
    state = skew.compact_state(l, ["k", "g"], ["q"])
    assert {tuple(x) for x in skew.eager_join(state, r, "k", ["g"], ["p"], ["q"], ["s"]).select("g", "p", "rows", "q", "s").collect()} == want


def test_heavy_keys_count_null_keys_in_the_total(spark):
    rows = [("s", "hot", "r", 1, None, None, None)] * 6 + [("s", None, "r", 1, 1.0, None, None)] * 3 + [("s", "cold", "q", 1, 1.0, None, None)]
    df = spark.createDataFrame(rows, EDGE)
    assert [tuple(r) for r in skew.heavy_keys(df, "dst", 0.6).collect()] == [("hot", 6, 10)]
    assert {r["dst"] for r in skew.heavy_keys(df, "dst", 0.1).collect()} == {"hot", "cold"}
    assert skew.heavy_keys(df.limit(0), "dst", 0.5).count() == 0
    plan = skew.heavy_keys(df, "dst", 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def instant(spark, date, clock, zone):
    df = instants.parse_moments(spark.createDataFrame([(date, clock)], "d string, c string"), "d", "c", "p")
    return df.select(instants.moment_to_instant(F.col("p"), F.lit(zone))).first()[0]


def ms(zone, *parts):
    return round(datetime.datetime(*parts, tzinfo=zoneinfo.ZoneInfo(zone)).timestamp() * 1000)


def test_written_forms(spark):
    sp = "America/Sao_Paulo"
    assert instant(spark, "20250901", "91559", sp) == ms(sp, 2025, 9, 1, 9, 15, 59)
    assert instant(spark, "01/09/2025", "09:15", sp) == ms(sp, 2025, 9, 1, 9, 15)
    assert instant(spark, "2025-09-01T23:08:34+05:30", "101010", sp) == ms("Asia/Kolkata", 2025, 9, 1, 23, 8, 34)
    assert instant(spark, "1756717200000", "1", sp) == 1756717200000
    assert instant(spark, "20250901", "07:10:59 America/Santiago", sp) == ms("America/Santiago", 2025, 9, 1, 7, 10, 59)
    assert instant(spark, "rubbish", "1", sp) is None and instant(spark, None, None, sp) is None and instant(spark, "", "", sp) is None


def test_daylight_saving(spark):
    ny = "America/New_York"
    assert instant(spark, "20251102", "013000", ny) == ms("UTC", 2025, 11, 2, 5, 30)  # twice: the first
    assert instant(spark, "20250309", "023000", ny) == ms("UTC", 2025, 3, 9, 7, 30)  # skipped: moved on


def test_zones_are_told_by_the_local_day_of_known_instants(spark):
    """Deliveries close at the end of a local day; half of the values name another zone's offset."""
    rng = random.Random(4)
    truth = {"A": "America/Sao_Paulo", "B": "Europe/Lisbon", "C": "America/New_York", "D": "America/Rio_Branco"}
    rows = []
    for place, zone in truth.items():
        for _ in range(1500):
            at = datetime.datetime(2025, 9, 1, tzinfo=zoneinfo.ZoneInfo(zone)) + datetime.timedelta(minutes=rng.randrange(60 * 24 * 80))
            load = (at.date() + datetime.timedelta(1 if rng.random() < 0.97 else rng.randrange(2, 9))).isoformat()
            other = at.astimezone(rng.choice([datetime.UTC, zoneinfo.ZoneInfo("Asia/Kolkata")]))
            rows.append((place, other.isoformat() if rng.random() < 0.5 else at.strftime("%Y-%m-%dT%H:%M:%S"), load))
    df = instants.parse_moments(spark.createDataFrame(rows, "place string, d string, i string"), "d", None, "p").withColumn("i", F.to_date("i"))
    zones = spark.createDataFrame([(z,) for z in (*truth.values(), "America/Manaus", "Europe/Madrid", "Asia/Tokyo")], "z string")
    got = {r["place"]: (r["zone"], r["tied"]) for r in instants.estimate_zones(df, ["place"], "p", "i", zones, "z").collect()}
    assert got == {p: (z, 1) for p, z in truth.items()}
