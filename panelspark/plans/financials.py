"""Financial statements: report dates, continuity, single quarters, trailing twelve months, lags.

Reports are rows (symbol, enddate, publishdate, fields) with values cumulated within the year.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import parse_yyyymmdd, symbol_code


def by_report() -> WindowSpec:
    return W.partitionBy("symbol").orderBy("enddate")


def format_reports(df: DataFrame) -> DataFrame:
    """Lower-case names, no unnamed columns, text types, padded symbols, dates from YYYYMMDD."""
    df = df.select(*[F.col(f"`{c}`").alias(c.lower()) for c in df.columns if "unnamed" not in c.lower()])
    if "reportdatetype" in df.columns:
        df = df.withColumn("reportdatetype", F.col("reportdatetype").cast("string"))
    dates = {c: parse_yyyymmdd(F.col(c)) for c in ("publishdate", "enddate") if df.schema[c].dataType.typeName() != "date"}
    return df.withColumns({"symbol": symbol_code(F.col("symbol")), **dates})


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the last by an explicit order."""
    w = W.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in order])
    return df.withColumn("_row", F.row_number().over(w)).filter("_row = 1").drop("_row")


def clean_duplicates(df: DataFrame) -> DataFrame:
    """Keep the last published of each (symbol, enddate)."""
    return latest(df, ["symbol", "enddate"], [F.col("publishdate")])


def adjust_publish_date(df: DataFrame) -> DataFrame:
    """Snap late or early publishing to the statutory date: Q1 Apr 30, Q2 Aug 30, Q3 Oct 30, Q4 next Apr 30."""
    end, out, quarter = F.col("enddate"), F.col("publishdate"), F.quarter("enddate")
    year = F.year(end) + (quarter == 4).cast("int")
    month = F.when(quarter == 2, 8).when(quarter == 3, 10).otherwise(4)
    in_time = (out > end) & (F.year(out) == year) & (F.month(out) <= month)
    late = F.make_date(year, month, F.lit(30))
    return df.withColumn("publishdate", F.when(out.isNotNull() & in_time, out).otherwise(late))


def ensure_continuity(df: DataFrame) -> DataFrame:
    """Insert the missing quarter ends between a symbol's first and last, with NULL values and statutory dates."""
    span = df.groupBy("symbol").agg(F.min("enddate").alias("lo"), F.max("enddate").alias("hi"))
    # Months are counted from quarter starts, where every month has the day.
    starts = F.sequence(F.date_trunc("quarter", "lo").cast("date"), F.date_trunc("quarter", "hi").cast("date"), F.expr("interval 3 months"))
    ends = span.select("symbol", F.explode(starts).alias("start")).select("symbol", F.last_day(F.add_months("start", 2)).alias("enddate"))
    full = ends.join(df, ["symbol", "enddate"], "left")
    return adjust_publish_date(full)


def to_single_quarter(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """field_mrq: the first quarter as it is, others minus the previous report."""
    first = F.quarter("enddate") == 1
    return df.withColumns({f"{f}_mrq": F.when(first, F.col(f)).otherwise(F.col(f) - F.lag(f, 1).over(by_report())) for f in fields})


def to_trailing_year(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """field_ttm: x + last annual - same quarter a year ago; where either is unknown, x annualised."""
    q = F.quarter("enddate")

    def ttm(f: str) -> Column:
        x = F.col(f)
        annual = F.lag(f, 3).over(by_report())
        for k in (1, 2):
            annual = F.when(q == k, F.lag(f, k).over(by_report())).otherwise(annual)
        rolled = x + annual - F.lag(f, 4).over(by_report())
        return F.when(q == 4, x).otherwise(F.coalesce(rolled, x * 4 / q))

    return df.withColumns({f"{f}_ttm": ttm(f) for f in fields})


def with_lags(df: DataFrame, fields: Sequence[str], n: int = 4) -> DataFrame:
    """field_1 .. field_n: values of the reports before."""
    return df.withColumns({f"{f}_{i}": F.lag(f, i).over(by_report()) for f in fields for i in range(1, n + 1)})


def post_clean(df: DataFrame) -> DataFrame:
    """One report a (symbol, publishdate), the latest enddate; publishdate becomes tradedate."""
    return latest(df, ["symbol", "publishdate"], [F.col("enddate")]).withColumnRenamed("publishdate", "tradedate")


def preprocess(df: DataFrame) -> DataFrame:
    return ensure_continuity(adjust_publish_date(clean_duplicates(format_reports(df))))


def quarterly(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    return post_clean(with_lags(to_single_quarter(preprocess(df), fields), [f"{f}_mrq" for f in fields]))


def trailing_year(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    return post_clean(with_lags(to_trailing_year(preprocess(df), fields), [f"{f}_ttm" for f in fields]))


def balance(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    return post_clean(with_lags(preprocess(df), fields))


def validate_cell(df: DataFrame, symbol: str, date: str, field: str, expected: float) -> None:
    """Raise unless one cell of a cleaned table has the expected value."""
    got = df.filter((F.col("symbol") == symbol) & (F.col("enddate") == F.lit(date).cast("date"))).select(field).first()
    if got is None or got[0] is None or abs(got[0] - expected) > 1e-9 * abs(expected):
        raise ValueError(f"{field} of {symbol} at {date}: expected {expected}, got {got and got[0]}")
