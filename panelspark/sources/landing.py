"""Reading, landing and merging of raw tables."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Sequence
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from ..functions.dates import symbol_code
from ..functions.numeric import finite

#: Date columns by which incremental extracts are merged, in order of preference.
DATE_COLUMNS = ("tradedate", "enddate", "publishdate")
#: Days that an incremental extract reads again.
RECOMPUTE_DAYS = 30
FIRST_DATE = "19000101"


def mysql_url(host: str, port: int, database: str, charset: str | None = None) -> str:
    """JDBC address; user and password go to the reader's options, not into the address."""
    return f"jdbc:mysql://{host}:{port}/{database}" + (f"?characterEncoding={charset}" if charset else "")


def sql_server_url(server: str, port: int, database: str) -> str:
    return f"jdbc:sqlserver://{server}:{port};databaseName={database};encrypt=true;trustServerCertificate=true"


def read_jdbc(spark: SparkSession, url: str, query: str, user: str = "", password: str = "", **options: str) -> DataFrame:
    """One query in one task, for small tables and questions of one row; read_ranges is for the rest."""
    reader = spark.read.format("jdbc").option("url", url).option("query", query)
    return reader.options(**{"user": user, "password": password} if user else {}, **options).load()


#: Rows that a task of an extract fetches, about, and rows that a round trip brings.
TASK_ROWS, FETCH_ROWS = 500_000, 10_000


def _literal(day: dt.date | str | int, kind: str) -> str:
    """A date in the SQL of any JDBC driver (escapes are the driver's to translate)."""
    if kind == "timestamp":
        return f"{{ts '{day:%Y-%m-%d} 00:00:00'}}"
    if kind == "date":
        return f"{{d '{day:%Y-%m-%d}'}}"
    return str(day) if isinstance(day, int) else "'" + str(day).replace("'", "''") + "'"


def date_predicates(counts: Sequence[tuple[dt.date | str | int, int]], date: str, kind: str, rows: int = TASK_ROWS) -> list[str]:
    """Conditions that cut a query's rows into ranges of whole days of about `rows` rows, and its null dates.

    counts: each day and its rows. Every row meets exactly one condition: ranges are half-open, the first and the
    last have no outer end, so rows that arrive between the count and the reads are in one of them too.
    """
    cuts, held = [], 0
    for day, n in sorted(counts, key=lambda c: str(c[0])):
        if held and held + n > rows:
            cuts.append(_literal(day, kind))
            held = 0
        held += n
    ends = [None, *cuts, None]
    ranges = [" AND ".join([f"{date} >= {lo}"] * bool(lo) + [f"{date} < {hi}"] * bool(hi)) or f"{date} IS NOT NULL" for lo, hi in pairwise(ends)]
    return [*ranges, f"{date} IS NULL"]


def read_ranges(spark: SparkSession, url: str, query: str, date: str, user: str = "", password: str = "", rows: int = TASK_ROWS, fetch: int = FETCH_ROWS, **options: str) -> DataFrame:
    """A query's rows by ranges of a date column, a task for each; the days' rows are counted by one query before.

    The database counts by day (a row a day comes back, so calendars bound it), and days are put together to about
    `rows` rows a task. The column may be a date, a timestamp, or YYYYMMDD as text or number.
    """
    login = {"user": user, "password": password} if user else {}
    kind = read_jdbc(spark, url, f"SELECT {date} FROM ({query}) q WHERE 1 = 0", user, password, **options).schema[0].dataType.typeName()
    day = f"CAST({date} AS DATE)" if kind == "timestamp" else date
    asked = f"SELECT {day} AS panel_day, COUNT(*) AS panel_rows FROM ({query}) q WHERE {date} IS NOT NULL GROUP BY {day}"
    found = read_jdbc(spark, url, asked, user, password, **options).toDF("day", "n")
    counts = [(r["day"] if kind in ("date", "timestamp", "string") else int(r["day"]), int(r["n"])) for r in found.collect()]  # one row a day
    where = date_predicates(counts, date, kind, rows)
    return spark.read.jdbc(url, f"({query}) q", predicates=where, properties={**login, "fetchsize": str(fetch), **options})


def load_template(path: str) -> str:
    """Text of a query template, UTF-8 or else GBK."""
    with open(path, "rb") as f:
        data = f.read()
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("gbk")


def full_query(template: str) -> str:
    """A template's one positional date set to the first date."""
    return template.format(FIRST_DATE)


def incremental_query(template: str, last_date: str, days: int = RECOMPUTE_DAYS) -> str:
    """The template from `days` before the last date (YYYYMMDD) on."""
    start = dt.datetime.strptime(last_date, "%Y%m%d") - dt.timedelta(days=days)
    return template.format(start.strftime("%Y%m%d"))


def last_date(target: DataFrame, date: str) -> DataFrame:
    """One row: the greatest date of a target table."""
    return target.agg(F.max(date).alias("last_date"))


def date_of_file(path: Column) -> Column:
    """The date in a file name like table_20240331.parquet."""
    return F.try_to_date(F.nullif(F.regexp_extract(path, r"_(\d{8})", 1), F.lit("")), "yyyyMMdd")


def date_column(df: DataFrame) -> str:
    lower = {c.lower(): c for c in df.columns}
    return next(lower[c] for c in DATE_COLUMNS if c in lower)


def overwrite_merge(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Old rows before the new extract's first date, then the new rows; one row a key and date, new preferred."""
    date = date_column(new)
    first = new.agg(F.min(date).alias("_first"))
    kept = old.crossJoin(F.broadcast(first)).filter(F.col(date) < F.coalesce("_first", F.col(date) + F.expr("interval 1 day"))).drop("_first")
    both = kept.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = W.partitionBy(*keys, date).orderBy(F.desc("_new"), *[F.desc_nulls_last(c) for c in sorted(new.columns)])
    return both.withColumn("_row", F.row_number().over(w)).filter("_row = 1").drop("_row", "_new")


def extract_incremental(target: DataFrame, template: str, fetch: Callable[[str], DataFrame], days: int = RECOMPUTE_DAYS, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """A target table brought up to date: its last date found, the template queried from `days` before it, and merged.

    fetch runs a query (read_ranges with address and date column filled in); a target without rows is extracted in full.
    """
    last = last_date(target, date_column(target)).first()[0]  # one row
    new = fetch(full_query(template) if last is None else incremental_query(template, last.strftime("%Y%m%d"), days))
    return overwrite_merge(target, new, keys)


def update_table(spark: SparkSession, folder: str, tag: str, stamp: str, template: str, fetch: Callable[[str], DataFrame]) -> str:
    """Write tag_<stamp> beside the newest version of the tag, brought up to date; returns the new path.

    The old version stays for readers that have it open; stamp is YYYYMMDD.
    """
    new = f"{folder}/{tag}_{stamp}"
    extract_incremental(spark.read.parquet(newest(spark, folder, tag)), template, fetch).write.parquet(new)
    return new


def table_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the tables in a folder, lower-case, without their file endings; a listing, no data is read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(f.getPath().getName() for f in files)


#: The folder of each kind of stored object, by the beginning of its name; other names are processed factors.
FOLDERS = (
    ("basic_info", "basic_info"), ("index_components", "basic_info"), ("tradeassets", "trade_calendar"), ("tradedays", "trade_calendar"),
    ("trade_calendar", "trade_calendar"), ("stock_pool_", "trade_calendar"), ("stock_", "factor/stock"), ("index_", "factor/index"),
)


def logical_path(root: str, name: str) -> str:
    """Where an object of a logical name is stored: basic_info_stock, stock_pool_000300, stock_close, size, .."""
    if not re.fullmatch(r"[A-Za-z0-9_]+", name):
        raise ValueError(f"not a name: {name}")
    kind, folder = next(((k, f) for k, f in FOLDERS if name.startswith(k)), ("", "processed_factors"))
    # Fields of stocks and indices are stored under their own names.
    return f"{root}/{folder}/{name.removeprefix(kind) if folder.startswith('factor/') else name}"


def read_typed(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One table with its types checked: every field of the schema must be there in a type that it holds without loss.

    Numbers may be stored narrower than asked for; anything else that differs is an error, as is a file that is not Parquet.
    """
    suffix = path.rsplit("/", 1)[-1].rpartition(".")[2].lower() if "." in path.rsplit("/", 1)[-1] else "parquet"
    if suffix != "parquet":
        raise TypeError(f"unsupported file type: {suffix}, of {path}")
    df = spark.read.parquet(path)
    if schema is None:
        return df
    order = ("byte", "short", "integer", "long", "float", "double")
    stored, wanted, columns = {f.name: f.dataType for f in df.schema.fields}, StructType.fromDDL(schema), []
    for f in wanted.fields:
        if f.name not in stored:
            raise ValueError(f"{path} has no column {f.name}")
        a, b = stored[f.name].typeName(), f.dataType.typeName()
        wider = a in order and b in order and order.index(a) <= order.index(b) and not (a in ("integer", "long") and b == "float") and not (a == "long" and b == "double")
        if stored[f.name] != f.dataType and not wider:
            raise TypeError(f"{path}: {f.name} is {a}, not {b}")
        columns.append(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name))
    return df.select(*columns)


def normal_name(name: str) -> str:
    """A file's name without ending, lower-case."""
    return name.rsplit("/", 1)[-1].rsplit(".", 1)[0].lower()


def newest(spark: SparkSession, folder: str, tag: str) -> str:
    """Path of a tag's newest version: tag_YYYYMMDD with the greatest date, else the tag without a date."""
    names = {normal_name(n): n for n in table_names(spark, folder)}
    dated = [n for n in names if re.fullmatch(re.escape(tag.lower()) + r"_\d{8}", n)]
    if not dated and tag.lower() not in names:
        raise FileNotFoundError(f"no table {tag} in {folder}")
    return f"{folder}/{names[max(dated) if dated else tag.lower()]}"


def current_file(paths: Sequence[str]) -> str:
    """The first path whose file name holds "curr"."""
    return next(p for p in paths if "curr" in normal_name(p))


#: Statement tables are cleaned before they are pivoted; what each gives is named by its readers.
STATEMENTS = {"financials_balance": ("balance",), "financials_income": ("ttm", "mrq"), "financials_cash_flow": ("ttm", "mrq")}
MARKETS = ("stock_sk_market", "stock_sk_moneyflow", "stock_sk_forecast", "stock_valuation", "stock_shhk_northamt", "index_sk_market")


def load_dimension(spark: SparkSession, folder: str, tag: str) -> list[DataFrame]:
    """The formatted tables (tradedate, symbol, fields) of a dimension, newest version: one, or two of flow statements."""
    if tag not in (*STATEMENTS, *MARKETS):
        raise ValueError(f"unknown dimension: {tag}")
    raw = spark.read.parquet(newest(spark, folder, tag))
    if tag in MARKETS:
        return [format_table(raw)]
    from ..plans import financials

    readers = {"balance": financials.balance, "ttm": financials.trailing_year, "mrq": financials.quarterly}
    fields = numeric_fields(raw)
    return [readers[kind](raw, fields) for kind in STATEMENTS[tag]]


def numeric_fields(df: DataFrame, keys: Sequence[str] = ("symbol", "tradedate", "enddate", "publishdate")) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in keys]


def format_table(df: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Lower-case names, dates parsed, rows without symbol left out, codes padded, NaN and infinity NULL.

    Of rows with the same symbol and tradedate the first by `order` (else by all columns) stays.
    """
    df = df.select(*[F.col(f"`{c}`").alias(c.lower()) for c in df.columns])
    for f in df.schema.fields:
        if f.name.endswith("date") and f.dataType.typeName() == "string":
            df = df.withColumn(f.name, F.coalesce(F.try_to_date(f.name, "yyyyMMdd"), F.try_to_date(f.name)))
        elif f.dataType.typeName() in ("double", "float"):
            df = df.withColumn(f.name, finite(F.col(f.name)))
    df = df.filter("symbol is not null").withColumn("symbol", symbol_code(F.col("symbol")))
    w = W.partitionBy("symbol", "tradedate").orderBy(*(order or sorted(c for c in df.columns if c not in ("symbol", "tradedate"))))
    return df.withColumn("_row", F.row_number().over(w)).filter("_row = 1").drop("_row")


def read_many(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One table from many files, by column name."""
    if not paths:
        raise ValueError("no paths given")
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def unpivot_fields(panel: DataFrame, fields: Sequence[str]) -> DataFrame:
    """tradedate, symbol, field, value."""
    return panel.unpivot(["tradedate", "symbol"], list(fields), "field", "value")


def pivot_field(panel: DataFrame, field: str, symbols: Sequence[str]) -> DataFrame:
    """A field as one column a symbol, for the named symbols."""
    return panel.groupBy("tradedate").pivot("symbol", list(symbols)).agg(F.first(field, ignorenulls=True))


def save_panel(df: DataFrame, path: str, partition: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def save_factor(df: DataFrame, root: str, name: str) -> None:
    """Registry sink: <root>/factor=<name>."""
    df.select("tradedate", "symbol", F.col("value")).write.mode("overwrite").parquet(f"{root}/factor={name}")


def load_factors(spark: SparkSession, root: str, names: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.option("basePath", root).parquet(*([f"{root}/factor={n}" for n in names] if names else [root]))
    return df


def concat_factors(factors: dict[str, DataFrame], start: str | None = None, end: str | None = None) -> DataFrame:
    """Feature table: one column a factor, a row for each cell that any of them has, within dates.

    All factors are put together and grouped once; of rows that repeat a cell the greatest value stays.
    """
    rows = None
    for name, df in factors.items():
        one = df.select("tradedate", "symbol", F.lit(name).alias("_factor"), F.col("value").cast("double").alias("_value"))
        rows = one if rows is None else rows.unionByName(one)
    if start:
        rows = rows.filter(F.col("tradedate") >= F.lit(start).cast("date"))
    if end:
        rows = rows.filter(F.col("tradedate") <= F.lit(end).cast("date"))
    return rows.groupBy("tradedate", "symbol").agg(*[F.max(F.when(F.col("_factor") == n, F.col("_value"))).alias(n) for n in factors])
