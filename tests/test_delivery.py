"""The ledger of seen messages: batches, state, faults, empty tables."""

import pytest
from pyspark.sql import functions as F

from riskweave import queries_core
from riskweave.operators.delivery import SeenLedger, StaleLedger, message_id


def batch(spark, rows):
    return spark.createDataFrame(rows, "id string, day string")


def admit(ledger, df):
    return {r["id"]: (r["arrivals"], r["admitted"]) for r in ledger.admit(df, "id", [F.col("day")], ["day"]).collect()}


def test_one_arrival_of_each_identifier_over_batches(spark, tmp_path):
    ledger = SeenLedger(spark, f"file://{tmp_path}/l", shards=3)
    assert admit(ledger, batch(spark, [("a", "1"), ("a", "2"), ("b", "1"), (None, "1"), ("x" * 5000, "1")])) == {"a": (2, True), "b": (1, True), "x" * 5000: (1, True)}
    assert admit(ledger, batch(spark, [("a", "3"), ("c", "1"), ("c", "1")])) == {"a": (1, False), "c": (2, True)}
    assert admit(SeenLedger(spark, ledger.path), batch(spark, [(i, "9") for i in ("a", "b", "c", "d")])) == {"a": (1, False), "b": (1, False), "c": (1, False), "d": (1, True)}
    assert ledger.seen_count() == 5
    assert admit(ledger, batch(spark, [])) == {}
    ledger.forget()
    assert ledger.version() == 0


def test_many_small_batches_are_compacted_and_stay_exact(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("riskweave.operators.delivery.COMPACT_AFTER", 3)
    ledger = SeenLedger(spark, f"file://{tmp_path}/l", shards=2)
    for i in range(6):
        got = admit(ledger, batch(spark, [(f"k{j}", "1") for j in range(i, i + 4)]))
        assert {k for k, v in got.items() if v[1]} == {f"k{j}" for j in (range(4) if i == 0 else [i + 3])}
    assert len(ledger._manifest(ledger.version())["seen"]) <= 3


def test_the_shard_count_belongs_to_the_state(spark, tmp_path):
    ledger = SeenLedger(spark, f"file://{tmp_path}/l", shards=4)
    admit(ledger, batch(spark, [("a", "1")]))
    with pytest.raises(ValueError):
        admit(SeenLedger(spark, ledger.path, shards=8), batch(spark, [("a", "1")]))


def test_of_two_writers_of_one_version_one_fails(spark, tmp_path):
    ledger = SeenLedger(spark, f"file://{tmp_path}/l", shards=2)
    admit(ledger, batch(spark, [("a", "1")]))
    state = ledger._manifest(1)
    ledger._commit(2, state)
    with pytest.raises(StaleLedger):
        ledger._commit(2, state)
    assert ledger.version() == 2


def test_identifiers_without_blanks_and_case(spark):
    df = spark.createDataFrame([("  AbC ",), (" x　",), ("",), ("   ",), (None,)], "t string")
    assert [r[0] for r in df.select(message_id(F.col("t"))).collect()] == ["abc", "x", None, None, None]


def test_no_messages_give_no_rows(spark, tmp_path):
    for table, column in ((queries_core.CARDS, "id_unco"), (queries_core.PIX, "id_unco_pix")):
        spark.createDataFrame([], f"{column} string, dt_crga string, nm_arqv_orgm string").write.parquet(f"{tmp_path}/{table}.parquet")
    once, found = queries_core.p2_once(spark, str(tmp_path)), queries_core.p2_found(spark, str(tmp_path))
    assert once.columns == ["canal", "id_mensagem", "dt_crga", "nm_arqv_orgm"] and once.count() == 0
    assert found.columns == ["canal", "id_mensagem"] and found.count() == 0


def test_a_repeated_batch_gets_its_answer_again(spark, tmp_path):
    ledger = SeenLedger(spark, f"file://{tmp_path}/l", shards=2)
    df = batch(spark, [("a", "1"), ("b", "1")])
    first = {tuple(r) for r in ledger.admit(df, "id", [F.col("day")], ["day"], token="7").collect()}
    assert {tuple(r) for r in ledger.admit(df, "id", [F.col("day")], ["day"], token="7").collect()} == first
    assert ledger.version() == 1 and admit(ledger, df) == {"a": (1, False), "b": (1, False)}


def test_a_stream_admits_each_message_once(spark, tmp_path):
    from riskweave.streaming.messages import admit_stream

    at, out = tmp_path / "in", f"file://{tmp_path}/out"
    ledger = SeenLedger(spark, f"file://{tmp_path}/l", shards=2)
    for rows in ([("a", "1"), ("a", "1"), ("b", "1")], [("b", "2"), ("c", "2"), (None, "2")]):
        batch(spark, rows).coalesce(1).write.mode("append").parquet(str(at))
        stream = spark.readStream.schema("id string, day string").parquet(str(at))
        admit_stream(stream, ledger, "id", lambda: [F.col("day")], ["day"], lambda df, n: df.write.mode("overwrite").parquet(f"{out}/{n}"), f"file://{tmp_path}/c", once=True).awaitTermination(120)
    got = [tuple(r) for r in spark.read.parquet(f"{out}/0", f"{out}/1").collect()]
    assert sorted(got) == [("a", "1"), ("b", "1"), ("c", "2")]
