"""Line dedup by a deletion-neighbourhood join (operator 7), in DataFrame functions only.

A line's letters are its words (split at blanks), so the edit distance counts words inserted, deleted or
replaced. A line goes if an earlier line, by (doc_id, hash of the text, line number) over all documents, is
equal to it or within the bound. The bound is a quarter of the words of the shorter line and at most 1: lines
of fewer than four words have the bound 0 (one word would be a third of the line or more, and all single
words would be alike), so they go if equal. Lines without a word stay.

Steps: equal lines are classes by a 128-bit hash, with their first place. Two lines within the bound
agree on one half, cut by the shorter line's length, so only classes that share such a half with another
class emit variants. A variant is the line without its i-th word, keyed by a hash that is built from
running exclusive-ors in one pass; equal variants at equal i are replacements, a variant equal to a whole
line is a deletion. Each variant group links its members only with its earliest line (for members of one
group that is exact: any two of them are within the bound), so no group emits pairs. Each link is
verified word by word before a line goes.

Edge cases: null text stays null; empty lines stay; rows that repeat a doc_id are told apart by their
text, and rows with both alike are copies that keep the same lines; rows without doc_id come first; extra
columns are kept, n_lines and n_kept are replaced. The table may be empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, materialize, small, with_ids, words_of

#: Words of the shorter line from which the bound is one word: a quarter of them, rounded down, is 1.
CLOSE_WORDS = 4
#: What tells rows apart: doc_id, and a hash of the text for rows that repeat one.
ROW = ["doc_id", "rid"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hash(seed: int, *columns: Column) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("rid"), "text")


def places(docs: DataFrame) -> DataFrame:
    """doc_id, rid, pos, size, k1, k2 and HALVES of every line; lines without a word get a key of their own."""
    lines = docs.select(*ROW, F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    words = lines.select(*ROW, "pos", words_of(F.col("line")).alias("w")).withColumn("size", F.size("w"))
    counts = F.col("size") > 0
    return words.select(
        *ROW, "pos", "size",
        F.when(counts, _hash(1, F.col("w"))).otherwise(_hash(5, *ROW, F.col("pos"))).alias("k1"),
        F.when(counts, _hash(2, F.col("w"))).otherwise(_hash(6, *ROW, F.col("pos"))).alias("k2"),
        *[F.when(F.col("size") >= CLOSE_WORDS, half).alias(name) for name, half in zip(HALVES, _halves(), strict=True)],
    )


#: Halves of a line: first and last, cut as a line of its own length and as one of a word less.
HALVES = ("own_first", "own_last", "less_first", "less_last")


def _halves() -> list[Column]:
    out = []
    for less in (0, 1):
        m = F.col("size") - less
        first = F.floor(m / 2).cast("int")
        out += [_hash(3, m, F.slice("w", 1, first)), _hash(4, m, F.slice("w", F.col("size") - (m - first) + 1, m - first))]
    return out


def _close(classes: DataFrame, docs: DataFrame, tmp: Scratch) -> DataFrame:
    """Classes (k1, k2) that have an earlier line within the bound, by a verified link."""
    # A half is shared if two classes have it; lines of n and n - 1 words meet at the length n - 1.
    halves = classes.filter("own_first is not null").select("k1", F.explode(F.array_distinct(F.array(*HALVES))).alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
    chosen = tmp(halves.join(shared, "half").select("k1").distinct())
    some = classes.join(chosen, "k1", "left_semi").filter("own_first is not null").select("k1", "k2", "first")

    at = tmp(some.select("first.*"))
    ids = tmp(at.select("doc_id").distinct())
    # Rows without doc_id meet no join, so they are taken by themselves.
    texts = with_ids(docs.filter("doc_id is not null"), ids, "left_semi").union(docs.filter("doc_id is null"))
    lines = texts.select(*ROW, F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    place = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.rid") == F.col("r.rid")) & (F.col("l.pos") == F.col("r.pos"))
    chosen = F.broadcast(at) if small(at) else at
    texts = tmp(
        lines.alias("l").join(chosen.alias("r"), place, "left_semi")
        .groupBy(F.struct(*ROW, "pos").alias("first")).agg(F.min("line").alias("line"))
        .select("first", words_of(F.col("line")).alias("w"))
    )

    # Running exclusive-ors of word hashes at their place, and at the place before it.
    line, upto = W.partitionBy("first"), W.partitionBy("first").orderBy("i")
    words = texts.select("first", F.posexplode("w").alias("i", "word"))
    words = words.select("first", "i", F.xxhash64("word", "i").alias("here"), F.xxhash64("word", F.col("i") - 1).alias("moved"))
    words = words.select(
        "first", "i", "here",
        F.bit_xor("here").over(upto).alias("before"),
        F.bit_xor("moved").over(upto).alias("moved_upto"),
        F.bit_xor("moved").over(line).alias("moved_all"),
        F.bit_xor("here").over(line).alias("whole"),
        F.count("*").over(line).alias("size"),
    )
    without = F.col("before").bitwiseXOR(F.col("here")).bitwiseXOR(F.col("moved_all")).bitwiseXOR(F.col("moved_upto"))
    variants = tmp(words.select("first", "i", F.xxhash64(without, F.col("size") - 1).alias("key"), F.when(F.col("i") == 0, F.xxhash64("whole", "size")).alias("whole")))

    # Replacements: equal variants at equal places.
    groups = variants.groupBy("key", "i").agg(F.min("first").alias("other"), F.count("*").alias("n")).filter("n > 1")
    replaced = variants.join(groups, ["key", "i"]).filter("other < first").select("first", "other", "i", F.lit("replaced").alias("kind"))
    # Deletions: a whole line equals another line's variant; whole lines are distinct, so a variant meets one.
    whole = variants.filter("whole is not null").select(F.col("first").alias("short"), F.col("whole").alias("key"))
    met = tmp(variants.select("key", "first", "i").join(whole, "key"))
    least = met.groupBy("short").agg(F.min(F.struct("first", "i")).alias("long"))
    grown = least.filter("long.first < short").select(F.col("short").alias("first"), F.col("long.first").alias("other"), F.col("long.i").alias("i"), F.lit("shorter").alias("kind"))
    cut = met.filter("short < first").select("first", F.col("short").alias("other"), "i", F.lit("longer").alias("kind"))
    links = replaced.union(grown).union(cut)
    # A variant repeated within a line (equal neighbours) would only repeat a link.
    links = links.groupBy("first", "other", "kind").agg(F.min("i").alias("i"))

    pair = links.join(texts.withColumnRenamed("w", "wx"), "first").join(texts.select(F.col("first").alias("other"), F.col("w").alias("wy")), "other")
    cut_x, cut_y = (f"concat(slice({w}, 1, i), slice({w}, i + 2, size({w})))" for w in ("wx", "wy"))
    same = f"CASE kind WHEN 'replaced' THEN size(wx) = size(wy) AND {cut_x} = {cut_y} WHEN 'longer' THEN {cut_x} = wy ELSE {cut_y} = wx END"
    return some.join(pair.filter(same).select("first").distinct(), "first", "left_semi").select("k1", "k2")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of docs, text without the lines that go, n_lines and n_kept; one row per row of docs."""
    columns = [c for c in docs.columns if c not in ("n_lines", "n_kept")]
    full = docs.select(*columns)
    with Scratch(docs.sparkSession) as tmp:
        flags = materialize(_flags(_rows(docs), tmp))
    # Only rows that lose a line meet a flag.
    met = full["doc_id"].eqNullSafe(flags["doc_id"]) & (F.xxhash64(full["text"]) == flags["rid"])
    lines, goes = _lines(full["text"]), flags["goes"]
    kept = F.when(goes.isNull(), lines).otherwise(F.filter(lines, lambda line, i: ~F.coalesce(F.get(goes, i), F.lit(False))))
    made = {"text": F.array_join(kept, "\n").alias("text")}
    return full.join(flags, met, "left").select(
        *[made.get(c, full[c]) for c in columns],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(kept), F.lit(0)).cast("long").alias("n_kept"),
    )


def _flags(docs: DataFrame, tmp: Scratch) -> DataFrame:
    """doc_id, rid and goes (a flag for every line, in order) of the rows that lose a line."""
    where = tmp(places(docs))
    classes = tmp(
        where.filter("size > 0").groupBy("k1", "k2").agg(
            F.min(F.struct(*ROW, "pos")).alias("first"),
            *[F.max(h).alias(h) for h in HALVES],
            F.count("*").alias("n"),
        )
    )
    close = tmp(_close(classes, docs, tmp)).withColumn("close", F.lit(True))
    gone = classes.join(close, ["k1", "k2"], "left").filter("n > 1 or close").select("k1", "k2", "first", "close")
    goes = F.col("first").isNotNull() & (F.coalesce("close", F.lit(False)) | ~F.struct(*ROW, "pos").eqNullSafe(F.col("first")))
    return (
        where.select(*ROW, "pos", "k1", "k2").join(gone, ["k1", "k2"], "left")
        .select(*ROW, F.struct("pos", goes.alias("goes")).alias("flag"))
        .groupBy(*ROW).agg(F.sort_array(F.collect_set("flag")).alias("flags"), F.max("flag.goes").alias("any"))
        .filter("any").select(*ROW, F.col("flags.goes").alias("goes"))
    )
