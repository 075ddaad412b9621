"""Near-dedup, line dedup and decontamination against brute force, and their edge cases."""

from __future__ import annotations

import random
import re

import numpy as np

from panelspark.llm import common, decontaminate, lines, near


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def changed(text, n, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_word_hashes_split_like_the_pattern():
    text = "a b  c\x1cd\te\x0bf\n\ng" + " x" * 5
    assert len(common.word_hashes(text.encode())) == len(re.findall(r"[^\x20\x09-\x0D]+", text))
    long = ("word " * 600_000).encode()
    h = common.word_hashes(long)
    assert len(h) == 600_000 and len(np.unique(h)) == 1


def test_sketch_fills_every_coordinate_and_estimates():
    r = np.random.default_rng(0)
    for n in (1, 2, 7, 60, 3000):
        assert (near.sketch(r.integers(0, 2**63, n).astype(np.uint64)) != near._EMPTY).all()
    x = r.integers(0, 2**63, 1000).astype(np.uint64)
    a, b = np.unique(x[:900]), np.unique(x[100:])
    assert abs((near.sketch(a) == near.sketch(b)).mean() - 0.8) < 0.09


def test_near_duplicates_equal_brute_force(documents, prose):
    base = [prose(i, 80) for i in range(6)]
    texts = [*base, base[0], base[0].upper(), None, "", "one two", "ONE  two", "one two three four five"]
    texts += [changed(base[1], k, 100 + k) for k in (1, 2, 3, 4, 6)] * 2 + [changed(base[2], 1, s) for s in range(60)]
    texts += [prose(900, 60) + " " + prose(950 + k, 40) for k in range(40)]  # a shared passage
    sets = [grams(t) for t in texts]
    group = list(range(len(texts)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                x, y = sorted((root(i), root(j)))
                group[y] = x
    rows = {r["doc_id"]: r for r in near.near_duplicates(documents(texts)).collect()}
    assert len(rows) == len(texts)
    for i in range(len(texts)):
        assert rows[i]["n_shingles"] == len(sets[i])
        assert rows[i]["component_id"] == root(i) and rows[i]["kept"] == (root(i) == i)


def test_near_duplicates_edges(spark, documents, prose):
    assert near.near_duplicates(documents([])).count() == 0
    a, b = prose(1, 60), prose(2, 60)
    rows = [(None, a), (3, a), (3, a), (3, b), (5, b + " tail"), (2, prose(4, 50)), (7, a), (None, None), (9, "")]
    odd = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'k' as key", "2 as comp", "3 as row", "4 as node")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near.near_duplicates(odd).collect()), key=str)
    # Rows of one doc_id are judged by their own text; a row without doc_id links with nothing.
    want = [(None, None, True), (None, None, True), (3, 3, True), (3, 3, True), (3, 3, True), (5, 3, False), (2, 2, True), (7, 3, False), (9, 9, True)]
    assert got == sorted(want, key=str)
    long = " ".join(prose(k, 2000) for k in range(60))
    rows = {r["doc_id"]: r for r in near.near_duplicates(documents([long, long + " x"])).collect()}
    assert rows[1]["component_id"] == 0 and rows[0]["n_shingles"] == len(grams(long))


def word_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_lines(texts):
    places = [(d, p, line, line.split()) for d, t in enumerate(texts) if t is not None for p, line in enumerate(t.split("\n"))]
    kept = {d: [] for d, t in enumerate(texts)}
    for n, (d, _, line, w) in enumerate(places):
        gone = False
        for _, _, _, v in places[:n]:
            gone = gone or len(w) > 0 and v == w
            gone = gone or min(len(v), len(w)) >= 4 and abs(len(v) - len(w)) <= 1 and word_distance(v, w) <= 1
        if not gone:
            kept[d].append(line)
    return ["\n".join(kept[d]) if t is not None else None for d, t in enumerate(texts)]


def test_lines_equal_brute_force(documents, prose):
    a, b, c = prose(1, 14), prose(2, 10), prose(3, 11)
    w = a.split()
    variants = [" ".join(w[:k] + w[k + 1 :]) for k in (0, 5, 13)] + [" ".join(w[:k] + ["zzz"] + w[k:]) for k in (0, 7, 14)] + [" ".join(w[:k] + ["yyy"] + w[k + 1 :]) for k in (0, 6, 13)]
    same = "same same " + " ".join(["again"] * 10)
    texts = [f"{a}\n\nshort\n{b}", None, "", f"short\n{c}\n{a} ", f"{same}\n{same} again", "a b c\nx\na b c\na b d", *variants, f"{c} tail\n{b}\n{changed(b, 2, 1)}", f"  {b}  \n{prose(9, 30)}"]
    got = {r["doc_id"]: r for r in lines.dedup_lines(documents(texts)).collect()}
    assert [got[i]["text"] for i in range(len(texts))] == brute_lines(texts)
    assert got[0]["lang"] == "en" and got[1]["n_lines"] == 0


def test_short_lines_equal_brute_force(documents, prose):
    a, b = "Copyright 2019 Example Ltd", "all rights are reserved here"
    texts = [f"{a}\nOf.\nmore info\n\n{b}", f"Of.\nCopyright 2020 Example Ltd\nmore info\n\nmore infos", f"all rights reserved here\nthe all rights are reserved here\nOn.\none two three\none two four", f" Of. \n{prose(3, 8)}\n{prose(3, 7)}\n  ", None]
    places = [(d, line, line.split()) for d, t in enumerate(texts) if t is not None for line in t.split("\n")]
    kept = {d: [] for d in range(len(texts))}
    for n, (d, line, w) in enumerate(places):
        if not any(w and v == w or min(len(v), len(w)) >= 4 and abs(len(v) - len(w)) <= 1 and word_distance(v, w) <= 1 for *_, v in places[:n]):
            kept[d].append(line)
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(documents(texts)).collect()}
    assert [got[d] for d in range(4)] == ["\n".join(kept[d]) for d in range(4)] and got[4] is None
    assert "2020" not in got[1] and "Of." not in got[1] and "On." in got[2] and "one two four" in got[2]


def test_lines_edges(spark, documents):
    assert lines.dedup_lines(documents([])).count() == 0
    rows = [(1, "one two three\nfour five six\nkeep me here"), (1, "seven eight nine\nten eleven twelve\nfresh line here"), (0, "four five six"), (2, "one two three\nx"), (2, "one two three\nx"),
            (None, "one two three"), (None, "nine ten"), (3, "nine ten"), (3, None), (4, "w " * 30_000 + "\nx")]
    odd = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as n_kept", "5 as pos", "'g' as goes", "7 as rid", "1 as first")
    got = lines.dedup_lines(odd)
    assert got.columns == ["doc_id", "text", "pos", "goes", "rid", "first", "n_lines", "n_kept"]
    texts = [(r["doc_id"], r["text"]) for r in got.collect()]
    want = [(1, "keep me here"), (1, rows[1][1]), (0, "four five six"), (2, "x"), (2, "x"), (None, "one two three"), (None, "nine ten"), (3, ""), (3, None), (4, "w " * 30_000)]
    assert sorted(texts, key=str) == sorted(want, key=str)


def test_contained_equals_brute_force(spark, documents, prose):
    items = [prose(50 + k, n) for k, n in enumerate((3, 5, 8, 12, 20, 33, 64, 130))] + [None, ""]
    long = [prose(1000 + k, 3000) for k in range(3)]
    texts = [*long, *[f"{x[:9000]} {t} {x[9000:]}" for t in items if t for x in long[:2]]]
    texts += [prose(7, 400) + " " + changed(items[6], k, k) + " " + prose(8, 90) for k in (1, 2, 3, 4)] + [None, "", items[0], items[1]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = set()
    for d, t in enumerate(texts):
        for k, q in enumerate(items):
            if grams(q) and len(grams(q) & grams(t)) >= 0.75 * len(grams(q)):
                want.add((d, k, len(grams(q)), len(grams(q) & grams(t))))
    got = decontaminate.contained(documents(texts), bench)
    assert {tuple(r) for r in got.collect()} == want
    block, decontaminate.BLOCK = decontaminate.BLOCK, 60
    try:  # several broadcast blocks give the same rows
        assert {tuple(r) for r in decontaminate.contained(documents(texts), bench).collect()} == want
    finally:
        decontaminate.BLOCK = block
    assert decontaminate.contained(documents([]), bench).count() == 0
    assert decontaminate.contained(documents(texts), bench.limit(0)).count() == 0


def test_contained_edges(spark, documents, prose):
    item, long = prose(3, 12), " ".join(prose(k, 3000) for k in range(100))
    bench = spark.createDataFrame([(1, item), (1, item), (2, item), (None, item)], "item_id long, text string").selectExpr("*", "1 as item", "2 as hits")
    docs = spark.createDataFrame([(5, f"{long} {item}"), (5, item), (5, item), (None, item)], "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as hashes")
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.contained(docs, bench).collect()), key=str)
    assert got == sorted([(d, i) for d in (5, 5, 5, None) for i in (1, 1, 2, None)], key=str)


def test_sample_is_the_first_by_hash(spark):
    rows = spark.range(20_000).selectExpr("id as doc_id", "if(id % 50 = 0, 'few', 'many') as label")
    got = {(r["doc_id"], r["label"]) for r in common.sampled(rows, "label", 600).collect()}
    hashed = sorted((r["h"], r["doc_id"], r["label"]) for r in rows.selectExpr("xxhash64(doc_id) as h", "*").collect())
    want = [(d, label) for label in ("few", "many") for d in [d for _, d, x in hashed if x == label][:600]]
    assert got == set(want) and len(want) == 1000
