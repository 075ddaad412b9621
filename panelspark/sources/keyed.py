"""Keyed tables that are brought up to date by upserts: snapshots of date partitions behind a manifest.

Layout of a table's folder:
    data/v=<version>/_part=<month>/...   rows that an upsert has written, by the month of their date
    manifest/v=<version>/                one row a month: the version whose files hold it; progress of its sources

An upsert replaces the rows of the keys it brings and adds the others. It reads and writes only the months that its rows
fall in; the files of all other months stay as they are and only their manifest rows are carried on. A version exists
when its manifest is complete (its _SUCCESS file is there), so a failed upsert leaves the last version whole, and its
files are overwritten when it runs again. A source (a stream's checkpoint) numbers its batches; a batch whose number the
manifest already has is not taken twice.

Rows without a date are one partition of their own. Of rows with equal keys and date in a batch the one with the greatest
`order` stays (ties: the greatest other columns). Columns that a batch lacks are NULL for its rows, new ones are NULL before.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_MANIFEST = "part string, version long, progress map<string,long>, keys array<string>, date string"


@dataclass(frozen=True)
class Upsert:
    """What an upsert did: the version it made, and the partitions it wrote, read and left alone."""

    version: int
    written: int
    read: int
    kept: int
    skipped: bool = False


class KeyedTable:
    """A table with one row a key and date below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str] = ("symbol",), date: str = "tradedate", order: Sequence[str] = ()):
        self.spark, self.folder, self.keys, self.date, self.order = spark, folder, list(keys), date, list(order)

    # --- versions ---------------------------------------------------------------------------

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, name: str) -> list[int]:
        at, fs = self._fs(f"{self.folder}/{name}")
        names = [p.getPath().getName() for p in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[2:]) for n in names if n.startswith("v="))

    def versions(self) -> list[int]:
        """Complete versions, oldest first; a listing, no data is read."""
        found = []
        for v in self._numbers("manifest"):
            at, fs = self._fs(f"{self.folder}/manifest/v={v}/_SUCCESS")
            if fs.exists(at):
                found.append(v)
        return found

    def manifest(self, version: int | None = None) -> DataFrame:
        """part, version, progress of a version, by default the last; one row a month and one without part."""
        last = self.versions()
        if version is None and not last:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest/v={last[-1] if version is None else version}")

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, by default the last."""
        paths = [self._path(r["part"], r["version"]) for r in self.manifest(version).filter("part is not null").collect()]  # one row a month
        if not paths:
            raise FileNotFoundError(f"no rows in {self.folder}")
        return self._rows(paths)

    def _path(self, part: str, version: int) -> str:
        return f"{self.folder}/data/v={version}/_part={part}"

    def _rows(self, paths: list[str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(*paths)

    # --- upsert -----------------------------------------------------------------------------

    def upsert(self, rows: DataFrame, source: str | None = None, batch: int | None = None) -> Upsert:
        """Merges rows (keys, date and any columns) and makes a version; rows is read twice.

        source and batch name a numbered batch: one that has been taken is skipped.
        """
        before = self.manifest().collect()  # one row a month
        progress = dict(before[0]["progress"] or {}) if before else {}
        version = (self.versions() or [0])[-1]
        if source is not None and batch is not None and progress.get(source, -1) >= batch:
            return Upsert(version, 0, 0, len([r for r in before if r["part"]]), True)
        part = F.coalesce(F.date_format(F.col(self.date).cast("date"), "yyyy-MM"), F.lit("none"))
        new = rows.withColumn("_part", part)
        touched = {r["_part"] for r in new.select("_part").distinct().collect()}  # one row a month
        if not touched:
            return Upsert(version, 0, 0, len([r for r in before if r["part"]]))
        version += 1
        old = {r["part"]: r["version"] for r in before if r["part"]}
        again = sorted(touched & set(old))
        merged = new.withColumn("_new", F.lit(1))
        if again:
            kept = self._rows([self._path(p, old[p]) for p in again]).withColumn("_part", part).withColumn("_new", F.lit(0))
            merged = merged.unionByName(kept, allowMissingColumns=True)
        first = ["_new", *[c for c in self.order if c in merged.columns]]
        rest = sorted(c for c in rows.columns if c not in (*self.keys, self.date, *self.order))
        w = W.partitionBy("_part", *self.keys, self.date).orderBy(*[F.desc_nulls_last(c) for c in (*first, *rest)])
        merged = merged.withColumn("_row", F.row_number().over(w)).filter("_row = 1").drop("_row", "_new")
        # A month's rows in files of the advised size: large months are split, small ones are not.
        merged.hint("rebalance", "_part").write.mode("overwrite").partitionBy("_part").parquet(f"{self.folder}/data/v={version}")
        if source is not None and batch is not None:
            progress[source] = batch
        parts = old | dict.fromkeys(touched, version)
        named = [(p, v, progress, self.keys, self.date) for p, v in sorted(parts.items())] + [(None, version, progress, self.keys, self.date)]
        self.spark.createDataFrame(named, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/v={version}")
        return Upsert(version, len(touched), len(again), len(set(old) - touched))

    def vacuum(self, keep: int = 2) -> list[int]:
        """Removes all but the last `keep` versions; returns the versions whose files no kept one uses."""
        kept = self.versions()[-max(1, keep):]
        used = {r["version"] for v in kept for r in self.manifest(v).collect()}  # one row a month
        for v in self._numbers("manifest"):
            if kept and v < kept[0]:
                at, fs = self._fs(f"{self.folder}/manifest/v={v}")
                fs.delete(at, True)
        gone = [v for v in self._numbers("data") if v not in used and (not kept or v <= kept[-1])]
        for v in gone:
            at, fs = self._fs(f"{self.folder}/data/v={v}")
            fs.delete(at, True)
        return gone
