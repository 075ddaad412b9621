"""A store of factors that are brought up to date by the dates their inputs changed on.

A factor declares its look-back, the trading days before a day that its value needs. A change of the input on a day
can then move values of that day and of `look_back` days after it, and these need the input of `look_back` days before them.
An update computes only such stretches of the calendar and upserts them into the factor's keyed table, whose months
outside the stretches stay as they are. Names and versions are folder listings; no factor is read for them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .keyed import KeyedTable
from .landing import concat_factors, table_names


@dataclass(frozen=True)
class Factor:
    """compute makes (tradedate, symbol, value) of a panel; look_back None: it needs the whole past (recurrences)."""

    name: str
    compute: Callable[[DataFrame], DataFrame]
    look_back: int | None = 0


@dataclass(frozen=True)
class Update:
    """What an update did: trading days whose input was read, days whose values were written, and the version."""

    days_read: int
    days_written: int
    version: int


def stretches(calendar: Sequence[dt.date], changed: set[dt.date], look_back: int | None) -> list[tuple[int, int, int]]:
    """Places in the calendar (first input, first value, last value) of the stretches that the changed days move."""
    last = len(calendar) - 1
    at = [i for i, day in enumerate(calendar) if day in changed]
    if look_back is None:
        return [(0, at[0], last)] if at else []
    out: list[tuple[int, int, int]] = []
    for i in at:
        end = min(i + look_back, last)
        # Stretches whose inputs overlap are computed as one.
        if out and max(i - look_back, 0) <= out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], end)
        else:
            out.append((max(i - look_back, 0), i, end))
    return out


class FactorStore:
    """Factors below a folder that all executors share, one keyed table each."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def table(self, name: str) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.root}/{name}")

    def names(self) -> list[str]:
        """Factors that have a version, by listing folders."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return []
        return [n for n in table_names(self.spark, self.root) if self.table(n).versions()]

    def update(self, factor: Factor, panel: DataFrame, changed: DataFrame | None = None) -> Update:
        """Brings a factor up to date with a panel (tradedate, symbol, inputs) whose rows of the days `changed` are new.

        changed has the column tradedate; without it, or without a version of the factor, all days are computed.
        """
        table = self.table(factor.name)
        calendar = [r[0] for r in panel.select("tradedate").distinct().orderBy("tradedate").collect()]  # one row a day
        whole = changed is None or not table.versions()
        days = set(calendar) if whole else {r[0] for r in changed.select("tradedate").distinct().collect()}  # one row a day
        read = written = 0
        parts = []
        for start, first, last in stretches(calendar, days, None if whole else factor.look_back):
            inputs = panel.filter(F.col("tradedate").between(F.lit(calendar[start]), F.lit(calendar[last])))
            made = factor.compute(inputs).select("tradedate", "symbol", F.col("value").cast("double").alias("value"))
            parts.append(made.filter(F.col("tradedate").between(F.lit(calendar[first]), F.lit(calendar[last]))))
            read, written = read + last - start + 1, written + last - first + 1
        version = (table.versions() or [0])[-1]
        if parts:
            rows = parts[0]
            for p in parts[1:]:
                rows = rows.unionByName(p)
            version = table.upsert(rows).version
        return Update(read, written, version)

    def read(self, names: Sequence[str], start: str | None = None, end: str | None = None) -> DataFrame:
        """Feature table of several factors, one column each."""
        return concat_factors({n: self.table(n).read() for n in names}, start, end)
