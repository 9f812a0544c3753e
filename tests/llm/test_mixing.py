"""The size of the mix, targets that cannot be reached, and the draw."""

import pytest
from pyspark.sql import functions as F

from riskweave.llm.mixing import Mix, draw, fill, plan_mix
from riskweave.runtime import session


@pytest.fixture(scope="module")
def spark():
    return session("mixing", "local[2]", **{"spark.sql.shuffle.partitions": "3"})


def test_default_size_is_the_corpus_and_others_make_up_for_short_sources(spark):
    sizes = spark.createDataFrame([("big", 90, 990), ("tiny", 1, 10)], "source string, docs long, tokens long")
    targets = spark.createDataFrame([("big", 0.9, 2), ("tiny", 0.1, 2), ("none", 0.0, 1)], "source string, pc_alvo double, qt_max_repeticoes int")
    got = {r["source"]: r for r in plan_mix(sizes, targets).collect()}
    assert got["big"]["total"] == 1000
    assert not got["tiny"]["reachable"] and got["tiny"]["copies"] == 2
    assert got["big"]["reachable"] and abs(got["big"]["copies"] - 980 / 990) < 1e-9
    assert got["none"]["copies"] == 0


def test_filling_stops_at_the_caps():
    rows = [{"source": s, "tokens": t, "target": p, "cap": c} for s, t, p, c in (("a", 100, 0.5, 1), ("b", 10, 0.3, 2), ("c", 40, 0.2, 3))]
    got = fill(rows, 200.0)
    assert got["a"] == 1.0 and got["b"] == 2.0 and abs(got["c"] - 2.0) < 1e-9
    assert fill(rows, 10_000.0) == {"a": 1.0, "b": 2.0, "c": 3.0}
    assert fill([], 5.0) == {}


def test_the_draw_is_systematic_and_never_above_the_cap(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 900, "a").when(F.col("id") < 999, "b").alias("source"), (F.col("id") % 37).alias("n"))
    plan = spark.createDataFrame([("a", 0.35), ("b", 2.5)], "source string, copies double")
    got = draw(docs, plan, "doc_id", "n").cache()
    n = {r["source"]: (r["c"], r["m"]) for r in got.groupBy("source").agg(F.sum("copies").alias("c"), F.max("copies").alias("m")).collect()}
    assert abs(n["a"][0] - 315) <= 1 and n["a"][1] == 1
    assert abs(n["b"][0] - 247.5) <= 1 and n["b"][1] == 3
    # every stretch of sizes gives its part
    low = docs.where("source = 'a' and n < 18").count() * 0.35
    assert abs(got.where("source = 'a' and n < 18").agg(F.sum("copies")).first()[0] - low) <= 2
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, draw(docs, plan, "doc_id", "n").collect()))


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, pc_alvo double, qt_max_repeticoes int")
    rows = Mix(docs, targets).shares().collect()
    assert [(r["source"], r["tokens_drawn"], r["alcancavel"]) for r in rows] == [("a", 0, False)]
