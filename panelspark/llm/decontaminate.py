"""Benchmark decontamination: size-partitioned MinHash containment search (operator 2).

A test item Q is in a document X if at least `least` of Q's five-word shingles are in X. Documents are
partitioned by their number of shingles (powers of two), items by theirs. For a pair of partitions the
MinHash has one permutation and B coordinates (bins), B set from the upper size of the documents and
the size of the items: with a load of `load` shingles a bin, a contained shingle is its bin's minimum
with a probability of at least p = (1 - exp(-load)) / load, and load is chosen so that an item misses
all its contained shingles with a probability of at most MISS (small items: one bin a hash value, so
none is missed). Items and documents that share a coordinate are candidates; each is verified by exact
shingle containment on the whole document in the task that has it at hand.

Equal items are one; their ids are joined to what is found. Items are broadcast in blocks of about BLOCK
shingles, one pass over the documents for each block, so no block grows with the benchmark. (A benchmark
of 10,000 items of 200 words is one block; a pass reads the texts once.)

Edge cases: null, empty and blank texts contain nothing and items without words are found nowhere; an
item of fewer than five words is one shingle, found only in a document that is just these words;
repeated items and documents are reported as often as they come, null ids as they are; extra columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_texts, materialize, mix, text_shingles, with_ids

#: Probability that no coordinate shows an item that is just `least` contained.
MISS = 1e-9
#: Shingles of the items in one broadcast block, about.
BLOCK = 2_000_000


def bin_load(q: int, least: float) -> float:
    """Shingles a bin for items of q shingles; 0 if every shingle must be a coordinate of its own."""
    shared = math.ceil(least * q)
    p = 1 - MISS ** (1 / shared)
    if p > 0.95:
        return 0.0
    lo, hi = 0.0, 64.0
    for _ in range(50):
        load = (lo + hi) / 2
        lo, hi = (load, hi) if (1 - math.exp(-load)) / load >= p else (lo, load)
    return lo


class Items:
    """One block of items: shingle sets by number, and coordinates by the partitions of items."""

    def __init__(self, rows: list[tuple[int, np.ndarray]], least: float):
        self.ids = [i for i, s in rows if len(s)]
        self.sets = [s for _, s in rows if len(s)]
        self.least = least
        self.parts: dict[int, list[int]] = {}
        for k, s in enumerate(self.sets):
            self.parts.setdefault(len(s).bit_length(), []).append(k)
        self._coordinates: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def bins(self, part: int, size: int) -> int:
        """Coordinates for items of a partition and documents of fewer than 2**size shingles."""
        load = bin_load(1 << (part - 1), self.least)
        return max(1, math.ceil((1 << size) / load)) if load else 0

    def coordinates(self, part: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted coordinates (bin and minimum in one hash) and the items they belong to."""
        if (part, size) not in self._coordinates:
            all_of = [(coordinates(self.sets[k], self.bins(part, size)), k) for k in self.parts[part]]
            values = np.concatenate([c for c, _ in all_of])
            owner = np.repeat([k for _, k in all_of], [len(c) for c, _ in all_of])
            order = np.argsort(values, kind="stable")
            self._coordinates[part, size] = values[order], owner[order]
        return self._coordinates[part, size]

    def find(self, s: np.ndarray) -> list[tuple[int, int, int]]:
        """(number of the item, its shingles, those in s) of every item contained in the document set s."""
        size, candidates = len(s).bit_length(), set()
        for part in self.parts:
            values, owner = self.coordinates(part, size)
            own = coordinates(s, self.bins(part, size))
            at = np.searchsorted(values, own)
            hit = own[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == own)]
            for h in hit:
                candidates.update(owner[np.searchsorted(values, h) : np.searchsorted(values, h, "right")].tolist())
        out = []
        for k in sorted(candidates):
            q = self.sets[k]
            at = np.minimum(np.searchsorted(s, q), len(s) - 1)
            both = int((s[at] == q).sum())
            if both >= self.least * len(q) - 1e-9:
                out.append((self.ids[k], len(q), both))
        return out


def coordinates(s: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash: the least hash of every non-empty bin; 0 bins keeps all."""
    h = mix(s)
    if not bins:
        return h
    h = np.sort(h)
    b = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    return h[np.append(True, b[1:] != b[:-1])]


def contained(docs: DataFrame, benchmark: DataFrame, least: float = 0.75) -> DataFrame:
    """One row per document and test item in it: doc_id, item_id, n_item_shingles, n_shared."""

    def sets(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array([text_shingles(t).tobytes() for t in texts], pa.binary())]

    with Scratch(docs.sparkSession) as tmp:
        items = tmp(map_texts(benchmark, ["item_id"], sets, "hashes binary").filter("octet_length(hashes) > 0"))
        distinct = tmp(items.groupBy("hashes").agg(F.count("*").alias("n")).select(F.monotonically_increasing_id().alias("item"), "hashes"))
        total = distinct.agg(F.sum(F.expr("octet_length(hashes)"))).first()[0] or 0
        blocks = max(1, math.ceil(total / 8 / BLOCK))
        found = None
        for block in range(blocks):
            # One block is on the driver and in a worker at a time; what it finds is written before the next comes.
            mine = distinct.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
            shared = docs.sparkSession.sparkContext.broadcast(Items([(r["item"], np.frombuffer(r["hashes"], np.uint64)) for r in mine], least))
            one = tmp(_search(docs, shared))
            shared.unpersist()
            found = one if found is None else found.union(one)
        ids = items.join(distinct, "hashes").select("item", "item_id")
        return materialize(with_ids(found, tmp(ids), "inner", "item").select("doc_id", "item_id", "n_item_shingles", "n_shared"))


def _search(docs: DataFrame, shared: Broadcast[Items]) -> DataFrame:
    kind = pa.list_(pa.struct([("item", pa.int64()), ("n_item_shingles", pa.int64()), ("n_shared", pa.int64())]))

    def batch(texts: list[str | None]) -> list[pa.Array]:
        out = []
        for text in texts:
            s = text_shingles(text)
            hits = shared.value.find(s) if len(s) else []
            out.append([{"item": i, "n_item_shingles": n, "n_shared": k} for i, n, k in hits])
        return [pa.array(out, kind)]

    hits = map_texts(docs, ["doc_id"], batch, "hits array<struct<item:bigint,n_item_shingles:bigint,n_shared:bigint>>")
    return hits.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")
