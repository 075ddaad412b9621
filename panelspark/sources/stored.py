"""A dense panel kept in the warehouse, dealt and sorted by symbol, so that time series need no shuffle.

The table remembers which files it was made from (path, length and time of change of each); when they differ, it is
made anew, so a reader never gets a panel that is older than its sources.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

BUCKETS = 64
_MADE_FROM = "panel.made_from"


def changed_at(spark: SparkSession, path: str) -> int:
    """Time of the latest change of a file or of a folder's files, in milliseconds."""
    return max((t for _, _, t in files(spark, path)), default=0)


def files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Path, length and time of change of the files at or below a path; a listing, nothing is read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out, found = [], fs.listFiles(at, True)
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def state(spark: SparkSession, paths: Sequence[str]) -> str:
    """What tells one state of some files from another."""
    listed = [f for p in paths for f in files(spark, p)]
    return hashlib.sha256(repr(listed).encode()).hexdigest()


def stored_panel(spark: SparkSession, name: str, sources: Sequence[str], build: Callable[[], DataFrame], buckets: int = BUCKETS) -> DataFrame:
    """The panel (tradedate, symbol, fields) of a table of the warehouse, made by build where it is missing or old.

    A bucket is one file, sorted by symbol and day.
    """
    now = state(spark, sources)
    if spark.catalog.tableExists(name):
        known = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}  # a few rows
        if known.get(_MADE_FROM) == now:
            return spark.table(name)
    panel = build()
    rows = panel.repartition(buckets, "symbol").sortWithinPartitions("symbol", "tradedate")
    rows.write.mode("overwrite").format("parquet").bucketBy(buckets, "symbol").sortBy("symbol", "tradedate").saveAsTable(name)
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{_MADE_FROM}' = '{now}')")
    return spark.table(name)


def newest_first(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Paths by the time of their last change, latest first."""
    return sorted(paths, key=lambda p: -changed_at(spark, p))
