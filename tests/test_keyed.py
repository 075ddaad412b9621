"""Keyed upserts and the stream over them, with out-of-order batches, replays and failed batches, against brute force."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from panelspark.sources.keyed import KeyedTable
from panelspark.streaming import incremental

DAY = dt.date(2024, 1, 1)
COLUMNS = "symbol string, d int, x double"


def days(spark, rows, cols=COLUMNS):
    return spark.createDataFrame(rows, cols).withColumn("tradedate", F.date_add(F.lit(DAY), F.col("d"))).drop("d")


def at(df):
    return {(r["symbol"], (r["tradedate"] - DAY).days if r["tradedate"] else None): r["x"] for r in df.collect()}


def files(folder):
    return {os.path.join(base, f) for base, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_late_row_wipes_nothing(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path))
    five = [("A", 0, 1.0), ("A", 1, 2.0), ("A", 2, 3.0), ("B", 0, 4.0), ("B", 2, 5.0)]
    t.upsert(days(spark, five))
    t.upsert(days(spark, [("A", 0, 9.0)]))
    assert at(t.read()) == {(s, d): x for s, d, x in five} | {("A", 0): 9.0}


def test_random_batches_equal_brute_force(spark, tmp_path):
    r, want, t = random.Random(5), {}, KeyedTable(spark, str(tmp_path))
    for k in range(6):
        batch = [(r.choice("ABCDE"), r.randrange(0, 200), float(r.randrange(100))) for _ in range(r.choice([3, 40]))]
        batch += [("A", None, float(k))] if k % 2 else []
        t.upsert(days(spark, batch))
        best = {}
        for s, d, x in batch:
            best[(s, d)] = max(x, best.get((s, d), x))
        want |= best
        assert at(t.read()) == want
    assert len(t.versions()) == 6 and at(t.read(1)) != want


def test_only_touched_months_are_rewritten(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path))
    done = t.upsert(days(spark, [(s, d, 1.0) for s in "AB" for d in range(0, 366)]))
    assert (done.written, done.read, done.kept) == (12, 0, 0)
    before = files(f"{tmp_path}/data")
    done = t.upsert(days(spark, [("A", 40, 2.0), ("C", 41, 3.0), ("A", 400, 4.0)]))
    # February is read and written, a new month is written, eleven are left alone.
    assert (done.written, done.read, done.kept) == (2, 1, 11)
    new = files(f"{tmp_path}/data") - before
    assert before <= files(f"{tmp_path}/data") and {p.split("_part=")[1].split("/")[0] for p in new} == {"2024-02", "2025-02"}
    assert t.read().count() == 366 * 2 + 2
    with pytest.raises(FileNotFoundError):
        KeyedTable(spark, f"{tmp_path}/none").read()
    # Versions that no kept manifest uses go, files that the last one still uses stay.
    t.upsert(days(spark, [("A", 41, 5.0)]))
    assert t.vacuum(1) == [] and t.versions() == [3] and t.read().count() == 366 * 2 + 2
    assert t.upsert(days(spark, []).limit(0)).written == 0


def test_replayed_and_failed_batches(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path))
    t.upsert(days(spark, [("A", 0, 1.0)]), "s", 0)
    assert t.upsert(days(spark, [("A", 0, 7.0)]), "s", 0).skipped and at(t.read()) == {("A", 0): 1.0}
    # Another source has its own numbers.
    assert not t.upsert(days(spark, [("B", 0, 2.0)]), "other", 0).skipped
    # A batch whose data were written, but not its manifest, is no version and runs again.
    bad = days(spark, [("A", 1, 3.0)]).withColumn("_part", F.lit("2024-01"))
    bad.write.partitionBy("_part").parquet(f"{tmp_path}/data/v=3")
    os.makedirs(f"{tmp_path}/manifest/v=3")
    assert at(t.read()) == {("A", 0): 1.0, ("B", 0): 2.0}
    t.upsert(days(spark, [("A", 2, 4.0)]), "s", 1)
    assert at(t.read()) == {("A", 0): 1.0, ("B", 0): 2.0, ("A", 2): 4.0} and t.versions() == [1, 2, 3]


def test_new_columns_and_order(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), order=["seq"])
    t.upsert(days(spark, [("A", 0, 1.0)]))
    t.upsert(spark.createDataFrame([("A", DAY, 5.0, 1, "old"), ("A", DAY, 3.0, 2, "new"), ("B", DAY, None, None, None)], "symbol string, tradedate date, x double, seq int, note string"))
    assert {(r["symbol"], r["x"], r["note"]) for r in t.read().collect()} == {("A", 3.0, "new"), ("B", None, None)}


def test_stream_merges_late_rows_and_drops_old_ones(spark, tmp_path):
    schema = "symbol string, tradedate date, x double"

    def land(k, rows):
        df = days(spark, rows).select("symbol", "tradedate", "x")
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        q = incremental.merge_stream(stream, f"{tmp_path}/t", f"{tmp_path}/cp", days=30)
        q.awaitTermination()

    land(0, [("A", d, 1.0) for d in range(0, 60)] + [("B", 59, 1.0)])
    run()
    # Day 58 comes late and a day is corrected twice; nothing else goes.
    land(1, [("B", 58, 2.0), ("A", 59, 2.0)])
    run()
    land(2, [("A", 59, 1.5), ("A", 61, 3.0)])
    run()
    want = {("A", d): 1.0 for d in range(0, 59)} | {("B", 59): 1.0, ("B", 58): 2.0, ("A", 59): 1.5, ("A", 61): 3.0}
    t = KeyedTable(spark, f"{tmp_path}/t")
    assert at(t.read()) == want
    # Older than thirty days before day 61: dropped by the state, not merged.
    land(3, [("A", 5, 9.0), ("A", 40, 4.0)])
    run()
    assert at(t.read()) == want | {("A", 40): 4.0}
    done = t.versions()
    run()
    assert t.versions() == done


def test_stream_runs_a_failed_batch_again(spark, tmp_path, monkeypatch):
    df = days(spark, [("A", 0, 1.0), ("B", 0, 2.0)]).select("symbol", "tradedate", "x")
    df.coalesce(1).write.parquet(f"{tmp_path}/in/0")

    def run():
        stream = spark.readStream.schema("symbol string, tradedate date, x double").parquet(f"{tmp_path}/in/*")
        incremental.merge_stream(stream, f"{tmp_path}/t", f"{tmp_path}/cp").awaitTermination()

    whole = KeyedTable.upsert

    def failing(self, *args):
        raise RuntimeError("lost")

    monkeypatch.setattr(KeyedTable, "upsert", failing)
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.setattr(KeyedTable, "upsert", whole)
    run()
    assert at(KeyedTable(spark, f"{tmp_path}/t").read()) == {("A", 0): 1.0, ("B", 0): 2.0}
