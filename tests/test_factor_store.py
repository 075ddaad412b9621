"""Factor updates against a full recompute, and the panel that is stored by symbol."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from panelspark.operators import grid, moving, panel, series
from panelspark.sources import landing, stored
from panelspark.sources.factors import Factor, FactorStore, stretches

DAY = dt.date(2024, 1, 1)


def market(spark, n, change=None):
    r = random.Random(6)
    rows = [(s, i, 10 + r.random()) for s in ("a", "b", "c") for i in range(n)]
    rows = [(s, i, x * 3 if change and i in change and s == "b" else x) for s, i, x in rows]
    return spark.createDataFrame(rows, "symbol string, i int, px double").withColumn("tradedate", F.date_add(F.lit(DAY), F.col("i"))).drop("i")


def cells(df):
    return {(r["symbol"], r["tradedate"]): None if r["value"] is None else round(r["value"], 9) for r in df.select("symbol", "tradedate", "value").collect()}


MEAN = Factor("mean_5", lambda p: p.withColumn("value", series.ts_mean(F.col("px"), 5, 1)), 4)
RANK = Factor("rank", lambda p: p.withColumn("value", panel.average_rank(F.col("px"))), 0)
LONG = Factor("total", lambda p: p.withColumn("value", F.sum("px").over(grid.so_far())), None)


def test_updates_equal_a_full_recompute(spark, tmp_path):
    store = FactorStore(spark, f"{tmp_path}/store")
    assert store.names() == []
    changed = {20, 21, 70}
    old, new = market(spark, 120), market(spark, 120, changed)
    days = new.filter(F.datediff("tradedate", F.lit(DAY)).isin(*changed))
    read = {}
    for f in (MEAN, RANK, LONG):
        assert store.update(f, old).days_read == 120
        done = store.update(f, new, days)
        read[f.name] = (done.days_read, done.days_written)
        assert done.version == 2 and cells(store.table(f.name).read()) == cells(f.compute(new))
    # 20 and 21 move five days each, with four days before them; the rank moves these days only; a sum moves all later days.
    assert read == {"mean_5": (19, 11), "rank": (3, 3), "total": (120, 100)}
    assert store.names() == ["mean_5", "rank", "total"]
    # Nothing has changed: nothing is computed.
    assert store.update(MEAN, new, days.limit(0)).days_written == 0
    both = store.read(["mean_5", "rank"], "2024-02-01", "2024-02-10")
    assert both.columns == ["tradedate", "symbol", "mean_5", "rank"] and both.count() == 30


def test_new_days_are_added(spark, tmp_path):
    store = FactorStore(spark, f"{tmp_path}/store")
    whole = market(spark, 60)
    first = whole.filter(F.col("tradedate") < F.lit(DAY + dt.timedelta(50)))
    store.update(MEAN, first)
    done = store.update(MEAN, whole, whole.filter(F.col("tradedate") >= F.lit(DAY + dt.timedelta(50))))
    assert (done.days_read, done.days_written) == (14, 10) and cells(store.table("mean_5").read()) == cells(MEAN.compute(whole))


def test_stretches():
    calendar = [DAY + dt.timedelta(k) for k in range(100)]
    assert stretches(calendar, {calendar[10], calendar[12], calendar[50], calendar[99]}, 5) == [(5, 10, 17), (45, 50, 55), (94, 99, 99)]
    assert stretches(calendar, {dt.date(2030, 1, 1)}, 5) == [] and stretches(calendar, {calendar[40]}, None) == [(0, 40, 99)]


def test_concat_groups_once(spark):
    a = market(spark, 5).withColumnRenamed("px", "value")
    b = a.filter("symbol <> 'a'").withColumn("value", F.col("value") * 2)
    out = landing.concat_factors({"x": a, "y": b, "z": a.limit(0)})
    assert out.count() == 15 and out.filter("y is null").count() == 5 and out.filter("z is not null").count() == 0
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_stored_panel_needs_no_shuffle_and_follows_its_sources(spark, tmp_path):
    source = f"{tmp_path}/prices.parquet"
    market(spark, 30).write.parquet(source)
    built = []

    def build():
        built.append(1)
        return grid.densify(spark.read.parquet(source))

    def get():
        return stored.stored_panel(spark, "dense_prices", [source], build, 8)

    first = get().withColumn("i", F.row_number().over(grid.by_symbol()) - 1)
    get()
    assert len(built) == 1
    # Time series of the stored panel deal no rows; of a panel as it is read they do.
    for df, dealt in ((first, False), (spark.read.parquet(source).withColumn("i", F.row_number().over(grid.by_symbol()) - 1), True)):
        out = moving.moving_sums(df, 7, s=F.col("px")).withColumn("m", series.ts_mean(F.col("px"), 3))
        assert ("Exchange" in out._jdf.queryExecution().executedPlan().toString()) == dealt
        assert out.count() == 90
    # Newer sources make it anew.
    market(spark, 40).write.mode("overwrite").parquet(source)
    assert get().count() == 120 and len(built) == 2
    assert stored.changed_at(spark, source) > 0 and stored.newest_first(spark, [source]) == [source]
    spark.sql("DROP TABLE dense_prices")
