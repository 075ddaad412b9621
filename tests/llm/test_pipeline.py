"""The pipeline on a small folder against brute force, on odd rows, and on one with empty tables."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_pairs import brute_lines, changed, grams

import corpus_pipeline
from panelspark.llm import mixing, quality, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def folder(spark, tmp_path, prose):
    def make(n):
        langs = ["en", "de", "fr", "es"]
        good = [" ".join(w + langs[i % 4] for w in prose(i, 60).split()) + "." for i in range(n)]
        junk = [prose(500 + i, 60).upper().replace(" ", "!! ") for i in range(n // 2)]
        item = prose(77, 25)
        texts = [*good, *junk]
        if n:
            texts += [good[0], good[1] + " tail", f"{prose(41, 30)} {item} {prose(42, 30)}", None, ""]
        docs = [(i, t, langs[i % 4], "src0", len(t or "")) for i, t in enumerate(texts)]
        return write(spark, f"{tmp_path}/{n}", docs, [(0, item)] if n else [], [(i, int(i < n), 0) for i in range(n + n // 2)]), len(good), len(junk)

    return make


def write(spark, path, docs, items, labels, **extra):
    df = spark.createDataFrame(docs, SCHEMA).withColumns({c: F.lit(v) for c, v in extra.items()})
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_pipeline_drops_what_it_should(spark, folder):
    path, good, junk = folder(60)
    out = corpus_pipeline.run(spark, path)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_tokens", "rate"]
    ids = {r["doc_id"] for r in out.collect()}
    # Clean documents stay; junk, the copy, the near copy, the contaminated and the empty ones go.
    assert ids == set(range(good))


def test_pipeline_equals_brute_force(spark, tmp_path, prose):
    r, langs = random.Random(21), ["en", "de", "fr", "es"]
    shared, items = [prose(700 + k, 9) for k in range(4)], [prose(800 + k, 12) for k in range(5)]

    def page(seed):
        lines = [" ".join(w + langs[seed % 4] for w in prose(seed * 31 + k, r.randrange(5, 15)).split()) + "." for k in range(r.randrange(3, 8))]
        return "\n".join([*lines, r.choice(shared)] if seed % 3 == 0 else lines)

    texts = [page(i) for i in range(50)] + [prose(500 + i, 60).upper().replace(" ", "!! ") for i in range(25)]
    labels = [(i, int(i < 50), 0) for i in range(75)]
    texts += [texts[4], changed(texts[7].replace("\n", " "), 2, 3), texts[9] + "\nextra line of five words", f"{page(90)}\n{items[1]}", f"{page(91)} {changed(items[2], 1, 5)} {page(92)}", shared[0], None]
    docs = [(i, t, langs[i % 4], "s", len(t or "")) for i, t in enumerate(texts)]
    path = write(spark, f"{tmp_path}/x", docs, list(enumerate(items)), labels)

    table = spark.createDataFrame(docs, SCHEMA)
    model = queries.quality_model(table, spark, path)
    score = {x["doc_id"]: x["score"] for x in quality.score(table, model, ["doc_id"]).collect()}
    left = {i: t for i, t in enumerate(texts) if score[i] >= queries.GOOD}
    before, after = list(left.values()), brute_lines(list(left.values()))
    left = {i: b for i, a, b in zip(left, before, after, strict=True) if a == b or b.split()}
    sets, root = {i: grams(t) for i, t in left.items()}, {i: i for i in left}
    linked = True
    while linked:  # least document reachable
        linked = False
        for i in left:
            for j in left:
                both = len(sets[i] & sets[j])
                if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]) and root[i] > root[j]:
                    root[i], linked = root[j], True
    left = {i: t for i, t in left.items() if root[i] == i}
    left = {i: t for i, t in left.items() if not any(len(grams(q) & grams(t)) >= 0.75 * len(grams(q)) for q in items)}

    got = {x["doc_id"]: x for x in corpus_pipeline.run(spark, path).collect()}
    # The rates by the same steps on one machine, over the posteriors of what is left.
    last = spark.createDataFrame([(i, t, langs[i % 4], "s", len(t)) for i, t in left.items()], SCHEMA)
    domains = queries.domain_model(last, spark, path)
    made = [mixing.features(t) for t in left.values()]
    n, p = np.array([k for k, _ in made], float), domains.posteriors(np.stack([x for _, x in made])).astype(float)
    rate, weight = np.ones(len(n)), np.array([queries.TARGETS[d] for d in domains.domains])
    for _ in range(200):
        rate = np.maximum(0, rate - p @ np.linalg.solve((p * n[:, None]).T @ p, (rate * n) @ p - n.sum() * weight))
    want = {i: x for i, x in zip(left, rate, strict=True) if x > 0}
    assert {i: got[i]["text"] for i in got} == {i: left[i] for i in want} and 30 < len(want) < len(texts) - 25
    assert all(got[i]["rate"] == pytest.approx(want[i], abs=1e-3) and got[i]["n_chars"] == len(left[i]) for i in want)


def test_pipeline_on_odd_rows(spark, tmp_path, prose):
    """Repeated and null ids, conflicting texts, very long texts, and extra columns of the operators' own names."""
    long = "\n".join(" ".join(prose(k, 40).split()) + "." for k in range(1500))
    good = [prose(i, 60) + "." for i in range(40)]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(good)] + [(100 + i, prose(600 + i, 60).upper().replace(" ", "!! "), "de", "s", 9) for i in range(30)]
    docs += [(3, good[3], "en", "s", 9), (5, prose(950, 60) + ".", "en", "s", 9), (None, prose(951, 60) + ".", None, None, None), (200, long, "en", "s", len(long)), (201, None, None, None, None)]
    labels = [(i, 1, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(30)] + [(7, 0, 0), (None, 1, 0)]
    path = write(spark, f"{tmp_path}/x", docs, [(None, None), (1, "")], labels, _quality="q", score=1, rate=5.0, n_tokens=6, goes="g", rid=7, kept=False, component_id=8, item="i", posteriors="p", n_lines="l", n_kept=9)
    out = corpus_pipeline.run(spark, path)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "_quality", "score", "goes", "rid", "kept", "component_id", "item", "posteriors", "n_lines", "n_kept", "n_tokens", "rate"]
    rows = out.collect()
    ids = sorted(str(x["doc_id"]) for x in rows)
    # The copy of doc 3 is one document with it, and doc 5's other text is judged by itself.
    assert ids == sorted([*[str(i) for i in range(40)], "3", "5", "None", "200"])
    assert all((x["_quality"], x["score"], x["goes"], x["rid"], x["kept"], x["component_id"], x["item"], x["posteriors"], x["n_lines"], x["n_kept"]) == ("q", 1, "g", 7, False, 8, "i", "p", "l", 9) for x in rows)
    kinds = dict(out.dtypes)
    assert (kinds["posteriors"], kinds["n_lines"], kinds["n_kept"], kinds["rid"], kinds["rate"], kinds["n_tokens"]) == ("string", "string", "int", "int", "double", "bigint")


def test_stages_without_counts_of_characters(spark, folder):
    path, good, _ = folder(60)
    docs = spark.read.parquet(f"{path}/documents.parquet").drop("n_chars", "source")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == ["doc_id", "text", "lang"]
    assert {r["doc_id"] for r in docs.collect()} == set(range(good))


def test_pipeline_on_empty_tables(spark, folder):
    assert corpus_pipeline.run(spark, folder(0)[0]).count() == 0
