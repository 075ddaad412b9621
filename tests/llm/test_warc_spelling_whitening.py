"""Operators 11 to 13 against brute force, on odd rows and on empty tables."""

from __future__ import annotations

import gzip
import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelspark.llm import spelling, warc, whitening
from panelspark.llm.common import Scratch, materialize

# --- WARC ---------------------------------------------------------------------------------------


def pages(spark, rows, **extra):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.withColumns({c: F.lit(v) for c, v in extra.items()})


def brute_warc(rows):
    least = {}
    for page, _, html in rows:
        if page is not None:
            least[html or ""] = min(page, least.get(html or "", page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        to = least.get(html or "") if len(data) >= 100 and least.get(html or "") != page else None
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


def test_warc_equals_brute_force(spark, prose):
    r = random.Random(3)
    copy, other = prose(1, 40), "ünï©ode " * 13
    rows = [(i, f"http://a.b/{i}?q=ü", prose(100 + i, r.randrange(0, 60))) for i in range(60)]
    rows += [(100 + i, f"http://c.d/{i}", copy) for i in range(70)] + [(7000, "u", "x" * 99), (7001, "u", "x" * 99), (7002, "u", "y" * 100), (7003, "u", "y" * 100)]
    rows += [(-5, None, other), (-4, "two\r\nlines: here", other), (None, "n", copy), (None, None, None), (None, "m", "only null " * 20), (9, "z", ""), (8000, "v", prose(5, 150_000)), (100, "http://c.d/0", copy)]
    got = warc.digest(pages(spark, rows, digest="d", refers_to="r", payload="p", n=1).repartition(5)).collect()
    assert sorted([tuple(x) for x in got], key=repr) == brute_warc(rows)
    assert warc.digest(pages(spark, [])).count() == 0


def test_warc_is_read_by_ranges(spark, prose, tmp_path):
    rows = [(i, f"http://a.b/{i}", prose(i, 300)) for i in range(200)] + [(300 + i, f"http://copy/{i}", prose(5, 300)) for i in range(3)]
    folder = f"file://{tmp_path}/archives"
    index = warc.archive(pages(spark, rows).coalesce(2), folder, file_bytes=40_000)
    entries = index.collect()
    assert len({e["file"] for e in entries}) > 4 and len(entries) == len(rows)
    for e in entries[::17]:  # the index alone finds a record, and every record can be unpacked alone
        with open(f"{tmp_path}/archives/{e['file']}", "rb") as f:
            f.seek(e["offset"])
            raw = gzip.decompress(f.read(e["length"]))
        assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n") and f"WARC-Target-URI: {e['url']}\r\n".encode() in raw
    whole = b"".join(gzip.decompress(open(f"{tmp_path}/archives/{n}", "rb").read()) for n in sorted(os.listdir(f"{tmp_path}/archives")) if n.endswith(".gz"))
    assert whole.count(b"WARC-Type: response") == 200 and whole.count(b"WARC-Type: revisit") == 3 and whole.count(b"WARC-Type: warcinfo") == len({e["file"] for e in entries})
    # Selected records only; ranges hold them, do not overlap, and are fewer than records where these are neighbours.
    chosen = index.filter("page_id % 3 <> 0 and page_id < 300")
    spans = warc.ranges(chosen, gap=2000).collect()
    assert sum(len(s["records"]) for s in spans) == chosen.count() > len(spans) > 1
    assert all(s["begin"] == s["records"][0]["offset"] and s["end"] == s["records"][-1]["offset"] + s["records"][-1]["length"] for s in spans)
    assert len(warc.ranges(chosen, gap=0).collect()) > len(spans)
    read = warc.read_records(chosen, folder, gap=2000).collect()
    assert {x["page_id"]: x["payload"].decode() for x in read} == {i: t for i, _, t in rows if i % 3 and i < 300}
    records = materialize(warc.read_records(index.filter("page_id >= 300 or page_id = 5"), folder))
    assert records.filter("payload is null").count() == 3
    assert {(x["page_id"], bytes(x["payload"]).decode()) for x in warc.resolved(records).collect()} == {(i, rows[5][2]) for i in (5, 300, 301, 302)}


# --- spelling -----------------------------------------------------------------------------------


def edits(a, b):
    """Whether two different strings are one edit apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute_forms(docs):
    n = Counter()
    for doc, text in docs:
        run = ""
        for c in (text or "") + " ":
            if "a" <= c.lower() <= "z" and c.isascii() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                k = h % len(run)
                w = run[:k] + run[k + 1 :] if h % 199 == 0 else run
                n[w] += len(w) >= 6
                run = ""
    n = {w: k for w, k in n.items() if k >= 5}
    near = {w: [v for v in n if edits(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 5 * n[w]}
    root = {}
    for w in n:
        root[w] = w
        while root[w] in form:
            root[w] = form[root[w]]
    return {(w, form.get(w), root[w], n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


@pytest.mark.parametrize("leaf", [1, 3, 64])
def test_spelling_equals_brute_force(spark, leaf):
    r = random.Random(11)
    base = ["".join(r.choice("abcé") for _ in range(r.randrange(6, 9))) for _ in range(25)] + ["straße", "aaaaaaa", "prefixes" * 30, "prefixes" * 30 + "s"]
    docs = []
    for i in range(300):
        words = []
        for _ in range(60):
            w = base[min(int(r.expovariate(0.25)), len(base) - 1)]
            if r.random() < 0.08:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abé") + w[k:], w[:k] + "c" + w[k + 1 :]])
            words.append(w.upper() if r.random() < 0.1 else w)
        docs.append((i, r.choice([" ", ", ", "1", "\n", "Ā"]).join(words)))
    docs += [(None, "straße Straße STRASSE straßen"), (7, None), (8, ""), (8, "straße"), (8, "straße")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"word": F.lit("w"), "n": F.lit(3), "form": F.lit("f")})
    got = {tuple(x) for x in spelling.forms(spelling.counts(df), leaf=leaf).collect()}
    want = brute_forms(docs)
    assert got == want and any(w[1] and w[1] != w[2] for w in want) and sum(w[4] > 0 for w in want) > 20


def test_spelling_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.forms(spelling.counts(df)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=6), max_size=25))
def test_active_nodes_find_all_pairs(words):
    assert sorted(set(spelling.leaf_pairs(sorted(words)))) == sorted((a, b) for a in words for b in words if edits(a, b))


def test_prefix_of_many_words(spark):
    """A third of the words share a long prefix: each leaf stays small and no link is lost."""
    r = random.Random(4)
    words = sorted({"anfang" + "".join(r.choice("abcd") for _ in range(r.randrange(1, 5))) for _ in range(400)} | {"".join(r.choice("abcdefg") for _ in range(6)) for _ in range(300)})
    got = {tuple(x) for x in spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string"), leaf=16).collect()}
    assert got == {(a, b) for a in words for b in words if edits(a, b)}


# --- whitening ----------------------------------------------------------------------------------


def vectors(spark, rows, **extra):
    df = spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<float>")
    return df.withColumns({c: F.lit(v) for c, v in extra.items()})


def brute_whiten(rows, k):
    x = np.array([[int(np.floor(1024.0 * float(np.float32(c)))) + 100_000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    z = ((n * x - s).astype(float)) / n
    values, v = np.linalg.eigh(z.T @ z / n)
    values, v = values[::-1][:k], v[:, ::-1][:, :k]
    return n, deviation, z @ v / np.sqrt(values), values / (np.square(z).sum() / n)


@pytest.mark.parametrize("d", [3, 12, 240])
def test_whitening_equals_brute_force(spark, d):
    g = np.random.default_rng(d)
    x = (g.normal(size=(700, d)) * (1.0 + np.arange(d)[::-1] / d)) @ np.linalg.qr(g.normal(size=(d, d)))[0]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += [(700 + i, rows[5][1]) for i in range(100)] + [(5, rows[5][1]), (None, rows[6][1])]
    bad = [(9001, None), (9002, []), (9003, [None] + [0.1] * (d - 1)), (9004, [float("nan")] * d), (9005, [float("inf")] + [0.0] * (d - 1)), (9006, [0.5] * (d + 1)), (9007, [1e30] * d)]
    got = whitening.whiten(vectors(spark, rows + bad, n=1, x="x", whitened="w").repartition(4)).collect()
    n, deviation, white, explained = brute_whiten(rows, 8)
    k = min(8, d)
    assert len(got) == len(rows) * k and {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-8
    at = {}
    for r in got:
        at.setdefault(r["vec_id"], {})[r["component"]] = r
    for j in range(k):
        sign = None
        for i, (vec, _) in enumerate(rows):
            r = at[vec][j + 1]
            assert r["deviation"] == deviation[i] and r["explained"] == pytest.approx(explained[j], rel=1e-9)
            sign = sign or np.sign(r["whitened"] * white[i, j])
            assert r["whitened"] * sign == pytest.approx(white[i, j], abs=1e-7)


def test_whitening_of_little(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).count() == 0
    # Equal vectors have no component; two different ones have one.
    assert whitening.whiten(vectors(spark, [(1, [1, 2]), (2, [1, 2])])).count() == 0
    two = whitening.whiten(vectors(spark, [(1, [1, 2]), (2, [3, 2])])).orderBy("vec_id").collect()
    assert [(r["vec_id"], r["component"], abs(r["whitened"]), r["deviation"]) for r in two] == [(1, 1, pytest.approx(1), 2048**2), (2, 1, pytest.approx(1), 2048**2)]
    # Sums of squares beyond a long are null.
    far = whitening.whiten(vectors(spark, [(1, [1e12, 0]), (2, [-1e12, 1])])).collect()
    assert {r["deviation"] for r in far} == {None} and all(abs(r["whitened"]) == pytest.approx(1) for r in far)


def test_folders_of_steps_go(spark):
    with Scratch(spark) as tmp:
        path = tmp.folder()
        os.makedirs(path.removeprefix("file:"))
    assert not os.path.exists(path.removeprefix("file:"))
