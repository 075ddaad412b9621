"""MinHash near-dedup with fast similarity sketches (operator 10).

Sketch: T coordinates. Round i hashes every shingle to one coordinate with a value in [i, i+1); a
coordinate keeps its least value, so later rounds only fill what is still empty, and after T rounds
round T+j fills coordinate j. Every coordinate is filled, and the share of equal coordinates of two
sketches concentrates around their Jaccard similarity.

Search: BANDS bands of ROWS coordinates; sets of similarity 0.75 share no band with a probability of
about 4e-6. Equal sets are one class from the start, and only classes are compared. A bucket first gives
star edges from its centre, the member that shares the most buckets with others; their overlaps are counted
on full sets, and links merge into components. Only buckets that still hold several components go on: members outside the centre's
component meet the others of that centre's buckets, of about their size and in blocks of BLOCK, so that no task has all
comparisons of a centre. The join's condition drops pairs that cannot link: pairs of one component, pairs whose overlap is bounded too low by their exact overlaps with the centre, and pairs
whose sketches differ in more than MOST_DIFFERENT coordinates (4.7 standard deviations). What remains is
verified on full sets, without a cap. Links inside one component cannot change the result.

Edge cases: every row is judged by its own text, so rows that repeat a doc_id may differ in their result;
null and empty texts have an empty set, link with nothing and stay; a row without doc_id links with
nothing, has no component and stays; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_texts, materialize, mix, text_shingles, with_ids

T, BANDS, ROWS = 384, 64, 6
#: Members of one centre and size class that others are compared with in one task.
BLOCK = 512
#: Sketches are compared by four bits of each coordinate, 16 coordinates to a word.
WORDS = T // 16
#: At similarity 0.75, 90 of 384 differ on average, deviation 8.3; more than this has a probability of 2e-6.
MOST_DIFFERENT = 129

_rng = np.random.default_rng(10)
_SEEDS = _rng.integers(1, 2**64, 2 * T, dtype=np.uint64)
_COMBINE = _rng.integers(1, 2**64, ROWS, dtype=np.uint64) | np.uint64(1)
_BAND = _rng.integers(1, 2**64, BANDS, dtype=np.uint64)
_VALUE, _EMPTY = np.uint64(2**54 - 1), np.uint64(2**64 - 1)


def sketch(s: np.ndarray) -> np.ndarray:
    """T coordinates of a non-empty set of 64-bit hashes: round in the top 10 bits, value below."""
    out, done, n = np.full(T, _EMPTY), 0, len(s)
    while done < T and (done == 0 or out.max() == _EMPTY):
        k = min(T - done, max(1, -(-4096 // n)))
        v = mix(s[None, :] ^ _SEEDS[done : done + k, None])
        rounds = np.arange(done, done + k, dtype=np.uint64)[:, None] << np.uint64(54)
        place = ((v >> np.uint64(32)) * np.uint64(T)) >> np.uint64(32)
        # The value must not tell the place: it is mixed again.
        np.minimum.at(out, place.astype(np.int64).ravel(), (rounds | (mix(v) & _VALUE)).ravel())
        done += k
    empty = np.flatnonzero(out == _EMPTY)
    if len(empty):  # only sets of a few shingles
        v = mix(s[None, :] ^ _SEEDS[T + empty, None]) & _VALUE
        out[empty] = ((T + empty).astype(np.uint64) << np.uint64(54)) | v.min(axis=1)
    return out


def bands(coordinates: np.ndarray) -> np.ndarray:
    rows = mix(coordinates).reshape(BANDS, ROWS)
    return mix((rows * _COMBINE).sum(axis=1, dtype=np.uint64) ^ _BAND)


def packed(coordinates: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, 16 to a 64-bit word."""
    bits = (mix(coordinates) & np.uint64(15)).reshape(WORDS, 16)
    return (bits << (4 * np.arange(16, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)


#: What identifies a set: two hashes over its members, and its size.
KEY = ["set1", "set2", "n_shingles"]
_KEY = "set1 long, set2 long, n_shingles long"


def _key(s: np.ndarray) -> tuple[int | None, int | None, int]:
    if not len(s):
        return None, None, 0
    one, two = mix(s).sum(dtype=np.uint64), mix(s * _COMBINE[0]).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64)), len(s)


def _features(texts: list[str | None]) -> list[pa.Array]:
    keys, band, sketches = [], [], []
    for text in texts:
        s = text_shingles(text)
        keys.append(_key(s))
        c = sketch(s) if len(s) else None
        band.append(None if c is None else bands(c).view(np.int64))
        sketches.append(None if c is None else packed(c).view(np.int64))
    long = pa.int64()
    return [*_key_columns(keys), pa.array(band, pa.list_(long)), pa.array(sketches, pa.list_(long))]


def _key_columns(keys: list[tuple[int | None, int | None, int]]) -> list[pa.Array]:
    return [pa.array([k[i] for k in keys], pa.int64()) for i in range(3)]


def _sets(texts: list[str | None]) -> list[pa.Array]:
    sets = [text_shingles(t) for t in texts]
    return [*_key_columns([_key(s) for s in sets]), pa.array([s.tobytes() for s in sets], pa.binary())]


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column("x"), batch.column("y")
        rows = []
        for i in range(batch.num_rows):
            p, q = (np.frombuffer(side[i].as_buffer(), np.uint64) for side in (x, y))
            rows.append((len(p), len(q), len(np.intersect1d(p, q, assume_unique=True))))
        made = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *made], names=["a", "b", "size_a", "size_b", "both"])


def overlaps(pairs: DataFrame, docs: DataFrame, classes: DataFrame, tmp: Scratch) -> DataFrame:
    """a, b, size_a, size_b and both (the size of the intersection of full shingle sets) of pairs (a, b) of classes.

    classes: node, rep and KEY; the text of a class is read again from a row of its representative.
    """
    pairs = tmp(pairs)
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    needed = tmp(nodes.join(classes.select("node", "rep", *KEY), "node"))
    texts = with_ids(docs, tmp(needed.select(F.col("rep").alias("doc_id")).distinct()), "left_semi")
    sets = map_texts(texts, [], _sets, f"{_KEY}, hashes binary").groupBy(*KEY).agg(F.min("hashes").alias("hashes"))
    sets = tmp(sets.join(needed.select("node", *KEY), KEY).select("node", "hashes"))
    full = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return tmp(full.mapInArrow(_overlaps, "a long, b long, size_a long, size_b long, both long"))


def _links(overlap: DataFrame, least: float) -> DataFrame:
    per_cent = round(100 * least)
    return overlap.filter(100 * F.col("both") >= per_cent * (F.col("size_a") + F.col("size_b") - F.col("both"))).select("a", "b")


def components(edges: DataFrame, tmp: Scratch) -> DataFrame:
    """(node, component) of every node of the edges (a, b): the least node reachable.

    Alternates large-star and small-star until nothing changes; each round is written out. The least
    neighbour of a node is found by a partial aggregation, so a node of many edges is no hot group there; its edges meet
    that neighbour in a join whose large partitions Spark splits at run time.
    """
    edges = tmp(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Now every edge points down from u to v.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = tmp(small.filter("u <> v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = state


def _different(x: str, y: str) -> Column:
    """Coordinates in which two sketches differ: non-zero groups of four bits of their exclusive-or."""
    total, low = F.lit(0), F.lit(0x1111111111111111)
    for i in range(WORDS):
        z = F.col(x)[i].bitwiseXOR(F.col(y)[i])
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        total = total + F.bit_count(z.bitwiseAND(low))
    return total


def size_class(size: Column, least: float) -> Column:
    """Sets of similarity `least` or more are in the same or in neighbouring classes of size."""
    return F.floor(F.ln(size.cast("double")) / (math.log(1 / least) * 1.0001)).cast("int")


def _across(members: DataFrame, least: float, tmp: Scratch) -> DataFrame:
    """Pairs of members of a centre's buckets in different components that may link.

    members: centre, node, comp, main (component of the centre), size, sizes (its class), own (overlap with the centre),
    sketch, centres (all of the class's); one row for each centre and class, however many buckets
    they share. A pair is taken at the least centre that both have, as the bounds hold at any.
    """
    x = members.filter("comp <> main").select("centre", F.explode(F.sequence(F.col("sizes") - 1, F.col("sizes") + 1)).alias("k"), F.col("node").alias("a"), F.col("comp").alias("ca"), F.col("size").alias("na"), F.col("own").alias("oa"), F.col("sketch").alias("sa"), F.col("centres").alias("la"))
    y = members.select(F.col("centre").alias("c"), F.col("sizes").alias("kb"), F.col("node").alias("b"), F.col("comp").alias("cb"), F.col("main").alias("m"), F.col("size").alias("nb"), F.col("own").alias("ob"), F.col("sketch").alias("sb"), F.col("centres").alias("lb"))
    # Members of one centre and size class are dealt into blocks of about BLOCK; the others meet each block.
    blocks = tmp(y.groupBy("c", "kb").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    x = x.join(blocks.select(F.col("c").alias("centre"), F.col("kb").alias("k"), "blocks"), ["centre", "k"])
    x = x.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    y = y.join(blocks, ["c", "kb"]).withColumn("in_block", F.pmod(F.xxhash64("b"), "blocks").cast("int"))
    # A pair that both sides list is taken once.
    once = (F.col("cb") == F.col("m")) | (F.col("a") < F.col("b"))
    most = F.least("oa", "ob") + F.least(F.col("na") - F.col("oa"), F.col("nb") - F.col("ob"))
    possible = (1 + least) * most >= least * (F.col("na") + F.col("nb")) - 1e-6
    alike = _different("sa", "sb") <= round(MOST_DIFFERENT * (1 - least) / 0.25)
    met = (F.col("centre") == F.col("c")) & (F.col("k") == F.col("kb")) & (F.col("block") == F.col("in_block")) & (F.col("ca") != F.col("cb")) & once & possible & alike & (F.array_min(F.array_intersect("la", "lb")) == F.col("c"))
    return x.join(y, met).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, least: float = 0.75) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    with Scratch(docs.sparkSession) as tmp:
        return materialize(_near_duplicates(docs.select("doc_id", "text"), least, tmp))


def _near_duplicates(docs: DataFrame, least: float, tmp: Scratch) -> DataFrame:
    features = map_texts(docs, ["doc_id"], _features, f"{_KEY}, bands array<long>, sketch array<long>")
    # Numbers of rows and of classes (sets) are written once, so they stay the same.
    features = tmp(features.withColumn("row", F.monotonically_increasing_id()))
    texts = features.filter("n_shingles > 0 and doc_id is not null")
    classes = texts.groupBy(*KEY).agg(F.min("doc_id").alias("rep"), F.min_by("row", "doc_id").alias("row"))
    classes = tmp(classes.withColumn("node", F.monotonically_increasing_id()))

    entries = texts.select("row", "bands").join(classes.select("row", "node"), "row").select(F.explode("bands").alias("key"), "node")
    counts = entries.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    entries = tmp(entries.join(counts, "key"))
    heat = entries.groupBy("node").agg(F.sum("n").alias("heat"))
    warm = entries.select("key", "node").join(heat, "node")
    centres = tmp(warm.groupBy("key").agg(F.max_by("node", F.struct("heat", -F.col("node"))).alias("centre")))
    keys = tmp(entries.select("key", "node").join(centres, "key"))

    star = overlaps(keys.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), docs, classes, tmp)
    links = _links(star, least)
    comp = tmp(components(links, tmp))

    # Buckets that still hold several components.
    of, at = comp.toDF("node", "comp"), comp.toDF("centre", "main")
    placed = keys.join(of, "node", "left").join(at, "centre", "left")
    placed = placed.withColumns({"comp": F.coalesce("comp", "node"), "main": F.coalesce("main", "centre")})
    mixed = tmp(placed.filter("comp <> main").select("key").distinct())
    placed = placed.filter("node <> centre").join(mixed, "key", "left_semi").select("centre", "node", "comp", "main").distinct()
    shares = star.select(F.col("a").alias("centre"), F.col("b").alias("node"), F.col("size_b").alias("size"), F.col("both").alias("own"))
    # A class has at most one centre a band.
    centres_of = placed.groupBy("node").agg(F.collect_set("centre").alias("centres"))
    members = placed.join(shares, ["centre", "node"]).join(centres_of, "node").join(classes.select("node", "row"), "node")
    members = members.join(texts.select("row", "sketch"), "row").drop("row").withColumn("sizes", size_class(F.col("size"), least))
    more = _links(overlaps(_across(tmp(members), least, tmp), docs, classes, tmp), least)
    comp = components(links.union(more), tmp)

    named = classes.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_id = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.select("component", *KEY).join(least_id, "component").select(*KEY, "component_id")
    found = features.select("doc_id", *KEY).join(named, KEY, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
