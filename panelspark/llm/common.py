"""Helpers that several corpus operators share: tables, cut lineage, checked broadcasts, word hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.scratch import Scratch, shared_dir
from ..sources.scratch import written as materialize

__all__ = ["Scratch", "materialize", "shared_dir"]

#: What separates words, as a Java regular expression; the same set that bytes.split() uses.
SPACES = "[\\x20\\x09-\\x0D]+"
#: Most bytes of ids that are sent to every executor, 16 of them a row besides the id; larger sets are joined by a shuffle.
BROADCAST_BYTES = 48 << 20
#: Most bytes and rows of texts that a task has as Python strings at a time (a longer text comes alone).
PART_BYTES, PART_ROWS = 4 << 20, 2000
SHINGLE = 5


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(ids: DataFrame) -> bool:
    """Whether rows are few enough to be sent to every executor: by a count of their bytes; ids must be cheap to read twice."""
    size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in ids.columns), F.lit(16))
    return (ids.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def with_ids(df: DataFrame, ids: DataFrame, how: str, on: str | list[str] = "doc_id") -> DataFrame:
    """Semi, anti or left join on ids; they are broadcast only after a count of their bytes has bounded them.

    ids must be cheap to read twice (materialized).
    """
    return df.join(F.broadcast(ids) if small(ids) else ids, on, how)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, most: int = 100_000) -> DataFrame:
    """Inner join of rows with a table of one row a key, whose column `size` counts the key's rows; no key is hot.

    At most `most` keys can have more than a most-th of all rows, so these are sent to every executor and their
    rows stay where they are; the rows of the others are dealt by key. Both tables must be cheap to read twice.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    large = F.broadcast(groups.filter(F.col(size) > total // most))
    rest = rows.join(large.select(key), key, "left_anti")
    return rows.join(large, key).unionByName(rest.join(groups.filter(F.col(size) <= total // most), key))


def words_of(text: Column) -> Column:
    """Array of words (runs outside SPACES); null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES, -1), lambda w: w != "")


def _parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Begin and length of runs of rows of at most PART_BYTES and PART_ROWS; a longer text is alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = min(at + PART_ROWS, max(at + 1, int(np.searchsorted(ends, before + PART_BYTES, "right"))))
        yield at, min(to, len(ends)) - at
        at = to


def map_texts(df: DataFrame, keep: Sequence[str], fn: Callable[[list[str | None]], list[pa.Array]], added: str, text: str = "text") -> DataFrame:
    """The kept columns as they are, nulls and all, and the columns that fn makes of a part of the texts.

    An Arrow batch may hold many long texts, so fn gets them in parts that are bounded by bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in _parts(batch.column(len(keep))):
                part = batch.slice(at, n)
                made = fn(part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], names=names)

    kept = df.select(*[F.col(f"`{c}`") for c in keep])
    schema = StructType([*kept.schema.fields, *StructType.fromDDL(added).fields])
    names = schema.names
    # Columns go by place, so no name of the input can clash.
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("string"))
    return rows.toDF(*[f"_{i}" for i in range(len(keep) + 1)]).mapInArrow(run, schema)


def sampled(rows: DataFrame, group: str, most: int) -> DataFrame:
    """At most `most` rows (doc_id, group) of each group, in the order of a hash of doc_id; doc_id is unique.

    Of a group of n rows only those whose hash lies in the first (2 most + 1000) / n of its range are ranked: twice as
    many as are needed, so the first `most` are among them but for a probability below 1e-100.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
    place = F.xxhash64("doc_id") / 2.0**64 + 0.5
    # One row a group, and callers bound the groups; joined without a shuffle, so that only low hashes are dealt by group.
    low = rows.join(F.broadcast(sizes), group).filter(place <= (2.0 * most + 1000) / F.col("_n"))
    order = W.partitionBy(group).orderBy(F.xxhash64("doc_id"), "doc_id")
    return low.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= most).drop("_rank", "_n")


# --- numpy side: hashes of words and shingles -------------------------------------------------

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_POW = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, dtype=np.uint64))
_STEP = _rng.integers(1, 2**64, SHINGLE, dtype=np.uint64) | np.uint64(1)
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LONG = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer; spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _block_hashes(b: np.ndarray) -> np.ndarray:
    w = _IS_WORD[b]
    begins = w.copy()
    begins[1:] &= ~w[:-1]
    letters = b[w]
    if not len(letters):
        return np.empty(0, np.uint64)
    first = np.flatnonzero(begins[w])
    sizes = np.diff(first, append=len(letters))
    pos = np.arange(len(letters)) - np.repeat(first, sizes)
    sums = np.add.reduceat(_BYTE[letters] * _POW[pos & 4095], first)
    return mix(sums + sizes.astype(np.uint64))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every word of the whole text, in order; long texts go block by block."""
    b = np.frombuffer(data, np.uint8)
    if len(b) <= _LONG:
        return _block_hashes(b)
    out, at = [], 0
    while at < len(b):
        end = min(len(b), at + _LONG)
        while end < len(b) and _IS_WORD[b[end]] and _IS_WORD[b[end - 1]]:
            end += 1
        out.append(_block_hashes(b[at:end]))
        at = end
    return np.concatenate(out)


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of five-word shingles; fewer words make one shingle, none make none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    k = min(n, SHINGLE)
    total = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        total += words[i : n - k + 1 + i] * _STEP[i]
    return np.unique(mix(total))


def text_shingles(text: str | None) -> np.ndarray:
    """Shingle set of a text with A-Z lower-cased; null is empty."""
    return shingles(word_hashes((text or "").encode("utf-8", "surrogatepass").lower()))
