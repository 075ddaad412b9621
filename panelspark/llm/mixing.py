"""Mixing sources to target weights by soft membership (operator 1).

A labelled table (doc_id, domain) trains a softmax regression on hashed byte pairs, which gives every
document its domain posteriors p. With n tokens of a document and rates r >= 0, the expected token total
of domain k is sum(r n p_k). The rates minimise the weighted squared distance of these totals to the
targets (all tokens of the input times the weights) by projected gradient steps from r = 1::

    r <- max(0, r - p . theta),   theta = M^-1 (totals - targets),   M = sum(n p p')

M whitens the problem, so a full step never overshoots. A step needs only the K totals, a distributed
sum over documents; a document's rate follows from its posteriors and the thetas so far, so no state of
the documents passes through the driver.

Edge cases: null, empty and blank texts have no tokens, uniform posteriors, and the rate of such a
posterior; labels of unknown documents and null domains are ignored;
without any labelled domain there are no posteriors and every rate is 1; weights are scaled to sum 1 and a
domain without a weight has weight 0; targets that no rates reach are met as closely as the distance
allows, with a warning that tells by how much they are missed; an empty table gives no rows. Extra columns are kept with keep=; repeated rows count each.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import _IS_WORD, map_texts, materialize, sampled

DIMS = 1024
#: Most labelled documents of each domain that train the classifier.
SAMPLE = 800
#: Most domains: a step sums their square of numbers.
MOST_DOMAINS = 200
#: Totals may miss their targets by this share of all tokens.
TOLERANCE = 1e-6
_LONG = 1 << 18
_PAIR = np.random.default_rng(1).integers(0, DIMS, 65536)


def features(text: str | None) -> tuple[int, np.ndarray]:
    """Number of words, and the square roots of the shares of hashed byte pairs, of a whole text."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    counts, words, before = np.zeros(DIMS), 0, False
    for at in range(0, len(b), _LONG):
        part = b[at : at + _LONG]
        w = _IS_WORD[part]
        words += int(np.count_nonzero(w[1:] & ~w[:-1])) + int(w[0] and not before)
        before = bool(w[-1])
        both = (part[:-1].astype(np.int64) << 8) | part[1:]
        counts += np.bincount(_PAIR[both], minlength=DIMS)
    if not words:
        return 0, np.zeros(DIMS, np.float32)
    return words, np.sqrt(counts / max(1.0, counts.sum())).astype(np.float32)


@dataclass
class DomainModel:
    domains: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def posteriors(self, rows: np.ndarray) -> np.ndarray:
        if not self.domains:
            return np.zeros((len(rows), 0))
        z = rows @ self.weights + self.bias
        z[~rows.any(axis=1)] = 0.0
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE, steps: int = 300) -> DomainModel:
    """Softmax regression on labelled (doc_id, domain): at most `sample` rows a domain, in hash order."""
    # Of conflicting domains of a doc_id the first by name counts.
    rows = labelled.select("doc_id", F.col("domain").cast("string").alias("domain")).dropna()
    rows = rows.groupBy("doc_id").agg(F.min("domain").alias("domain"))
    domains = sorted(r[0] for r in rows.select("domain").distinct().limit(MOST_DOMAINS + 1).collect())
    if len(domains) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains")
    if not domains:
        return DomainModel([], np.zeros((DIMS, 0), np.float32), np.zeros(0, np.float32))
    chosen = sampled(rows, "domain", sample)

    def batch(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array([features(t)[1].tobytes() for t in texts], pa.binary())]

    # At most sample rows of each domain by the limit above; rows that repeat a doc_id give one of their vectors.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found = map_texts(texts, ["doc_id", "domain"], batch, "x binary")
    found = found.groupBy("doc_id").agg(F.min("domain").alias("domain"), F.min("x").alias("x")).orderBy("doc_id").toPandas()
    x = np.stack([np.frombuffer(b, np.float32) for b in found["x"]]).astype(np.float64) if len(found) else np.zeros((0, DIMS))
    y = (found["domain"].to_numpy()[:, None] == np.array(domains)[None, :]).astype(float) if len(found) else np.zeros((0, len(domains)))
    w, b = np.zeros((DIMS, len(domains))), np.zeros(len(domains))
    for _ in range(steps if len(x) else 0):
        model = DomainModel(domains, w, b)
        error = model.posteriors(x) - y
        w = w - 4.0 * (x.T @ error / len(x) + 1e-4 * w)
        b = b - 4.0 * error.mean(axis=0)
    return DomainModel(domains, w.astype(np.float32), b.astype(np.float32))


def _rates(p: np.ndarray, thetas: np.ndarray) -> np.ndarray:
    r = np.ones(len(p))
    for theta in thetas:
        r = np.maximum(0.0, r - p @ theta)
    return r


def _columns(batch: pa.RecordBatch, k: int, thetas: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = batch.column("n_tokens").to_numpy(zero_copy_only=False).astype(float)
    p = np.asarray(batch.column("posteriors").flatten()).reshape(len(n), k)
    return n, p, _rates(p, thetas)


def _totals(scored: DataFrame, k: int, thetas: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums over all documents: r n p, n p p' and n."""

    def part(batches):
        total, gram, tokens = np.zeros(k), np.zeros((k, k)), 0.0
        for batch in batches:
            if batch.num_rows:
                n, p, r = _columns(batch, k, thetas)
                total += (r * n) @ p
                gram += (p * n[:, None]).T @ p
                tokens += n.sum()
        yield pa.RecordBatch.from_arrays([pa.array([[*total, *gram.ravel(), tokens]], pa.list_(pa.float64()))], names=["v"])

    cells = scored.select("n_tokens", "posteriors").mapInArrow(part, "v array<double>").select(F.posexplode("v").alias("i", "x"))
    sums = np.zeros(k + k * k + 1)
    for row in cells.groupBy("i").agg(F.sum("x").alias("x")).collect():  # k + k * k + 1 rows
        sums[row["i"]] = row["x"]
    return sums[:k], sums[k:-1].reshape(k, k), float(sums[-1])


def mix(docs: DataFrame, model: DomainModel, targets: dict[str, float], keep: list[str] | None = None) -> DataFrame:
    """The kept columns of every row, n_tokens, posteriors (by model.domains) and rate."""
    k, spark = len(model.domains), docs.sparkSession
    keep = [c for c in keep or ["doc_id"] if c not in ("n_tokens", "posteriors", "rate")]
    shared = spark.sparkContext.broadcast(model)

    def batch(texts: list[str | None]) -> list[pa.Array]:
        made = [features(t) for t in texts]
        p = shared.value.posteriors(np.stack([x for _, x in made])) if made else np.zeros((0, k))
        return [pa.array([n for n, _ in made], pa.int64()), pa.array(list(p.astype(float)), pa.list_(pa.float64()))]

    scored = map_texts(docs, ["doc_id"], batch, "n_tokens long, posteriors array<double>")
    # The posteriors are narrow; texts are read again for the result rather than stored.
    scored = materialize(scored)
    weight = np.array([max(0.0, targets.get(d, 0.0)) for d in model.domains])
    weight = weight / weight.sum() if weight.sum() else np.full(k, 1 / max(1, k))
    thetas, least, stuck = np.zeros((0, k)), np.inf, 0
    while k:
        total, gram, tokens = _totals(scored, k, thetas)
        off = total - tokens * weight
        if not tokens or np.abs(off).max() <= TOLERANCE * tokens:
            break
        # The squared distance falls with every step; where it no longer does, no rates reach the targets.
        whitened = np.linalg.solve(gram + 1e-9 * np.trace(gram) * np.eye(k), off)
        distance = float(off @ whitened) / tokens
        stuck = stuck + 1 if distance > least * (1 - 1e-4) else 0
        if stuck >= 3:
            missed = {d: float(x) for d, x in zip(model.domains, np.round(off / tokens, 6), strict=True)}
            warnings.warn(f"no rates reach the targets; token shares miss them by {missed}", stacklevel=2)
            break
        least = min(least, distance)
        thetas = np.vstack([thetas, whitened])

    if keep == ["doc_id"]:

        def rates(batches):
            for b in batches:
                _, _, r = _columns(b, k, thetas)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r, pa.float64())], names=[*b.schema.names, "rate"])

        return scored.mapInArrow(rates, StructType([*scored.schema.fields, StructField("rate", DoubleType())]))

    def rated(texts: list[str | None]) -> list[pa.Array]:
        n, p = batch(texts)
        r = _rates(np.asarray(p.flatten()).reshape(len(n), k), thetas)
        return [n, p, pa.array(r, pa.float64())]

    # Wide rows stay where they are: their posteriors are made again rather than joined to them.
    return map_texts(docs, keep, rated, "n_tokens long, posteriors array<double>, rate double")
