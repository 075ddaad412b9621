"""Spelling variants by a trie self-join with active-node sets (operator 12).

Words come from runs of letters of whole texts; they are counted in the tasks first. The vocabulary's trie is walked
level by level as a table: a node is a prefix with the number of its words. An active pair (p, q) says that the
prefixes p and q are one edit apart, so what follows them must be equal; a prefix is its own pair without an edit. From
a level to the next, a prefix gives one-edit pairs with its children's siblings, parent and children, and a pair goes on
to equal letters on both sides. Prefixes of at most LEAF words are partitions: words of one leaf meet in one task, in a
trie of their own with active-node sets; a pair of two leaves is finished by equal rests, an equi-join on whole words.
So no task gets more than LEAF words of a prefix, however many words share it, and only prefixes of more words
are walked by Spark.

Edge cases: null and empty texts have no words; a null doc_id stands as an empty string in the hash; rows that repeat
are counted each; runs of any length are whole; ties of n go to the smallest word in code-point order; a table
without words makes no row. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, _parts, materialize

#: Letters of a run, code points of a word, its occurrences, and how many times as frequent its form is.
RUNS, LEAST_LETTERS, LEAST_COUNT, TIMES = "[A-Za-z\u00C0-\u00FF]+", 6, 5, 5
#: Every run whose hash this divides loses a letter.
DAMAGE = 199
LEAF = 1024
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    find = re.compile(RUNS).findall
    for batch in batches:
        ids = batch.column(0)
        for at, size in _parts(batch.column(1)):
            total: Counter[str] = Counter()
            for doc, text in zip(ids.slice(at, size).to_pylist(), batch.column(1).slice(at, size).to_pylist(), strict=True):
                # The hash of an id goes on with that of the run.
                begun = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in Counter(find((text or "").translate(_LOWER))).items():
                    h = zlib.crc32(run.encode(), begun)
                    if h % DAMAGE == 0:
                        i = h % len(run)
                        run = run[:i] + run[i + 1 :]
                    if len(run) >= LEAST_LETTERS:
                        total[run] += n
            yield pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})


def counts(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """word and n of the words that stand at least `least` times in all texts; documents are (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.filter(F.col("n") >= least)


# --- the trie ---------------------------------------------------------------------------------


def leaf_pairs(words: list[str]) -> list[tuple[str, str]]:
    """Ordered pairs of words that are one edit apart, by active-node sets of a trie of these words.

    A node is (children, word or None); the active set of a node has the nodes that are at most one edit away, with
    that distance.
    """
    root: list = [{}, None]
    for w in words:
        node = root
        for c in w:
            node = node[0].setdefault(c, [{}, None])
        node[1] = w
    out = []
    # Active nodes by identity: {id: (node, distance)}.
    first = {id(root): (root, 0)} | {id(k): (k, 1) for k in root[0].values()}
    stack = [(root, first)]
    while stack:
        node, active = stack.pop()
        if node[1] is not None:
            out += [(node[1], q[1]) for q, d in active.values() if d == 1 and q[1] is not None]
        for c, child in node[0].items():
            mine: dict[int, tuple[list, int]] = {}

            def add(q: list, d: int, mine: dict[int, tuple[list, int]] = mine) -> None:
                if d <= 1 and (id(q) not in mine or mine[id(q)][1] > d):
                    mine[id(q)] = (q, d)

            for q, d in active.values():
                add(q, d + 1)
                for x, k in q[0].items():
                    if x != c:
                        add(k, d + 1)
                    else:
                        add(k, d)
                        for y in k[0].values():
                            add(y, d + 1)
            stack.append((child, mine))
    return out


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [p for words in batch.column(0).to_pylist() for p in leaf_pairs(words)]
        yield pa.RecordBatch.from_pydict({"word": pa.array([p for p, _ in pairs], pa.string()), "near": pa.array([q for _, q in pairs], pa.string())})


def near_pairs(words: DataFrame, leaf: int = LEAF) -> DataFrame:
    """word and near: all ordered pairs of distinct words that are one inserted, deleted or replaced code point apart.

    words: a column `word` of distinct, non-empty words.
    """
    with Scratch(words.sparkSession) as tmp:
        return materialize(_near_pairs(tmp(words.select("word")), leaf, tmp))


def _near_pairs(words: DataFrame, leaf: int, tmp: Scratch) -> DataFrame:
    root = words.sparkSession.createDataFrame([("", None, None, False, False)], "node string, parent string, last string, light boolean, ends boolean")
    levels = {0: root}

    def level(k: int) -> DataFrame:
        """Nodes of k letters: node, its parent and last letter, whether it has few words, and whether it is one."""
        if k not in levels:
            nodes = words.filter(F.length("word") >= k).groupBy(F.substring("word", 1, k).alias("node"))
            nodes = nodes.agg((F.count("*") <= leaf).alias("light"), F.max(F.length("word") == k).alias("ends"))
            levels[k] = tmp(nodes.select("node", F.substring("node", 1, k - 1).alias("parent"), F.substring("node", k, 1).alias("last"), "light", "ends"))
        return levels[k]

    def side(k: int, name: str) -> DataFrame:
        return level(k).select(F.col("node").alias(name), F.col("light").alias(f"{name}_light"), F.col("ends").alias(f"{name}_ends"))

    heavy = root.select("node")
    # A letter put before the whole word.
    pairs = level(1).select(F.lit("").alias("p"), F.col("node").alias("q"))
    met, units, leaves, k = [], [], [], 0
    while heavy is not None or pairs is not None:
        k += 1
        made = []
        if heavy is not None:
            children = level(k).join(heavy.select(F.col("node").alias("parent")), "parent", "left_semi")
            p, q = children.select(F.col("node").alias("p"), "parent"), children.select(F.col("node").alias("q"), "parent")
            made.append(p.select("p", F.col("parent").alias("q")))
            # Siblings: no node has more children than there are letters.
            made.append(p.join(q, "parent").filter("p <> q").select("p", "q"))
            made.append(p.select("p").join(level(k + 1).select(F.col("parent").alias("p"), F.col("node").alias("q")), "p"))
            leaves.append(children.filter("light").select("node"))
            heavy = tmp(children.filter("not light").select("node"))
            heavy = None if heavy.isEmpty() else heavy
        if pairs is not None:
            letters = level(k).select(F.col("parent").alias("p"), F.col("node").alias("next"), "last")
            made.append(pairs.join(letters, "p").select(F.col("next").alias("p"), F.concat("q", "last").alias("q")))
        # The other side is up to a letter shorter or longer; if it is no node, nothing goes on with it.
        others = side(k - 1, "q").union(side(k, "q")).union(side(k + 1, "q"))
        active = tmp(reduce(DataFrame.union, made).distinct().join(side(k, "p"), "p").join(others, "q"))
        done = F.col("p_light") & F.col("q_light")
        units.append(active.filter(done).select("p", "q"))
        met.append(active.filter(~done & F.col("p_ends") & F.col("q_ends")).select(F.col("p").alias("word"), F.col("q").alias("near")))
        pairs = active.filter(~done).select("p", "q")
        pairs = None if pairs.isEmpty() else pairs

    # Words under their prefixes of the levels walked.
    under = words.select("word", F.explode(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(k)))).alias("_k"))
    under = under.select("word", F.expr("substring(word, 1, _k)").alias("p"), F.expr("substring(word, _k + 1)").alias("rest"))
    likely = under.join(reduce(DataFrame.union, units), "p").select("word", F.concat("q", "rest").alias("near"))
    met.append(likely.join(words.select(F.col("word").alias("near")), "near", "left_semi").select("word", "near"))
    groups = under.join(reduce(DataFrame.union, leaves).select(F.col("node").alias("p")), "p").groupBy("p").agg(F.collect_list("word").alias("words"))
    met.append(groups.select("words").mapInArrow(_leaves, "word string, near string"))
    return reduce(DataFrame.union, met).distinct()


# --- forms ------------------------------------------------------------------------------------


def forms(words: DataFrame, times: int = TIMES, leaf: int = LEAF) -> DataFrame:
    """word, form, root, n, n_near and form_n of every row of words (word, n; distinct words)."""
    with Scratch(words.sparkSession) as tmp:
        words = tmp(words.select("word", "n"))
        near = near_pairs(words, leaf).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
        # The most frequent near word, the smallest of equals: strings are ordered by code point.
        best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
        of = words.join(best, "word", "left")
        found = -F.col("best.m") >= times * F.col("n")
        of = tmp(of.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(found, F.col("best.near")).alias("form"), F.when(found, -F.col("best.m")).alias("form_n")))
        # Every step is to a word `times` as frequent, so doubled steps end after few rounds.
        step = tmp(of.filter("form is not null").select("word", F.col("form").alias("root")))
        while True:
            on = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
            moved = tmp(step.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
            step = moved.select("word", "root")
            if moved.filter("moved").isEmpty():
                break
        out = of.join(step, "word", "left")
        return materialize(out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
