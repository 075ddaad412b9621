"""Extracts from an embedded database: ranges cover every row once, and a table is brought up to date end to end."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelspark.sources import landing

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
DAY = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def database(spark, tmp_path_factory):
    url = f"jdbc:derby:{tmp_path_factory.mktemp('db')}/prices;create=true"
    r = random.Random(8)
    rows = [(f"{r.randrange(50):06d}", DAY + dt.timedelta(int(r.triangular(0, 200, 190))), float(k)) for k in range(3000)]
    rows += [(f"{k:06d}", DAY + dt.timedelta(77), 0.5) for k in range(900)]
    df = spark.createDataFrame(rows, "symbol string, tradedate date, x double").withColumn("stamp", F.col("tradedate").cast("timestamp") + F.expr("interval 13 hours"))
    df = df.withColumns({"num": F.date_format("tradedate", "yyyyMMdd").cast("int"), "txt": F.date_format("tradedate", "yyyyMMdd")})
    df.write.format("jdbc").option("url", url).option("driver", DRIVER).option("dbtable", "prices").option("createTableColumnTypes", "symbol varchar(6), txt varchar(8)").save()
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    for x in (-1.0, -2.0):
        connection.createStatement().executeUpdate(f"INSERT INTO prices (\"symbol\", \"x\") VALUES ('000001', {x})")
    connection.close()
    return url, df.unionByName(spark.createDataFrame([("000001", -1.0), ("000001", -2.0)], "symbol string, x double"), allowMissingColumns=True)


@pytest.mark.parametrize("column", ["tradedate", "stamp", "num", "txt"])
def test_ranges_hold_every_row_once(spark, database, column):
    url, df = database
    got = landing.read_ranges(spark, url, "SELECT * FROM prices", f'"{column}"', rows=500, driver=DRIVER)
    n = got.rdd.getNumPartitions()
    assert 6 <= n <= 12  # about 500 rows each, days are not cut
    assert sorted(r["x"] for r in got.collect()) == sorted(r["x"] for r in df.collect())
    sizes = [len(p) for p in got.rdd.glom().collect()]
    assert sizes[-1] == 2 and max(sizes) < 500 + 900


def test_predicates():
    days = [(DAY + dt.timedelta(k), 10) for k in range(10)]
    p = landing.date_predicates(days, "d", "date", 35)
    assert p == ["d < {d '2024-01-04'}", "d >= {d '2024-01-04'} AND d < {d '2024-01-07'}", "d >= {d '2024-01-07'} AND d < {d '2024-01-10'}", "d >= {d '2024-01-10'}", "d IS NULL"]
    assert landing.date_predicates([], "d", "date") == ["d IS NOT NULL", "d IS NULL"]
    assert landing.date_predicates([("20240101", 5), ("20240102", 5)], "d", "string", 5)[1] == "d >= '20240102'"
    assert landing.date_predicates([(20240101, 5), (20240102, 5)], "d", "integer", 5)[0] == "d < 20240102"


def test_extract_end_to_end(spark, database, tmp_path):
    url, df = database
    template = "SELECT \"symbol\", \"tradedate\", \"x\" FROM prices WHERE \"tradedate\" >= CAST('{}' AS DATE)"

    def fetch(query):
        # Derby reads dates with hyphens only.
        query = "".join(f"{p[:4]}-{p[4:6]}-{p[6:]}" if p.isdigit() and len(p) == 8 else p for p in query.replace("'", "\x00'\x00").split("\x00"))
        return landing.read_ranges(spark, url, query, '"tradedate"', rows=400, driver=DRIVER)

    known = df.select("symbol", "tradedate", "x").filter("tradedate is not null")
    last = DAY + dt.timedelta(120)
    known.filter(F.col("tradedate") <= F.lit(last)).withColumn("x", F.when(F.col("tradedate") == F.lit(last), F.lit(-9.0)).otherwise(F.col("x"))).write.parquet(f"{tmp_path}/prices_20240501")
    path = landing.update_table(spark, str(tmp_path), "prices", "20240801", template, fetch)
    got = {(r["symbol"], r["tradedate"]): r["x"] for r in spark.read.parquet(path).collect()}
    want = {}
    for r in known.collect():
        want[(r["symbol"], r["tradedate"])] = max(r["x"], want.get((r["symbol"], r["tradedate"]), r["x"]))
    assert got == want
