"""Quality classifier: nearest-neighbour voting over latent-semantic vectors (operator 8).

Terms of a text are its words, hashed to WORDS columns, and n-grams of its character classes (runs of letters
collapse, every ASCII mark is a class of its own), hashed to DIMS columns, with a few counts of repetition
beside them. Weights are log-damped and scaled by inverse document frequency over a bounded labelled
sample, whose truncated SVD gives the latent space. The labelled vectors (at most SAMPLE of each label)
are broadcast; each document's cosines to all of them come from blocked matrix products over batches,
and its K nearest vote with the fourth power of their similarity as the weight.

Edge cases: null, empty and blank texts score 0; repeated rows score alike; neighbours as near as the K-th, to
six digits, vote too; of conflicting labels of a doc_id the least counts; extra columns are ignored, or kept
with keep. If the labelled rows hold a single label or none, the score is that label's share (0.5 with none).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, mix, sampled, word_hashes

#: Columns of hashed class n-grams and of hashed words, latent dimensions, and neighbours that vote.
DIMS, WORDS, LATENT, K = 1024, 512, 48, 25
#: What a word counts beside an n-gram; 512 columns of words share 48 latent dimensions with the shapes.
WORD_WEIGHT = 0.5
#: Most labelled documents of each label that are fitted and broadcast.
SAMPLE = 1500
_EXTRA = 6
_LONG = 1 << 18

# Character classes: 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 other bytes; ASCII marks follow.
_CLASS = np.full(256, 6, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[9, 11, 12, 13, 32]] = 4
_CLASS[10] = 5
_CLASS[0x80:] = 1
_marks = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASS[_marks] = np.arange(7, 7 + len(_marks))


def _class_grams(data: bytes) -> np.ndarray:
    counts = np.zeros(DIMS)
    for at in range(0, len(data), _LONG):
        c = _CLASS[np.frombuffer(data[at : at + _LONG], np.uint8)]
        c = c[np.append(True, c[1:] != c[:-1])].astype(np.uint64)
        code = c + np.uint64(1)
        for n in range(1, 5):
            if len(c) < n:
                break
            if n > 1:
                code = code[:-1] * np.uint64(64) + c[n - 1 :] + np.uint64(1)
            # Sizes differ by n, so codes of different n cannot meet except by the hash.
            counts += np.bincount((mix(code) >> np.uint64(54)).astype(np.int64), minlength=DIMS)
    return counts


def terms(text: str | None) -> np.ndarray:
    """Term counts of a whole text: hashed class n-grams, counts of repetition, then hashed words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(DIMS + _EXTRA + WORDS, np.float32)
    w = word_hashes(data)
    if not len(w):
        return out
    out[:DIMS] = np.log1p(_class_grams(data) * (100 / len(w)))
    distinct = len(np.unique(w)) / len(w)
    same = np.count_nonzero(w[1:] == w[:-1]) / len(w)
    lines = [x for x in data.split(b"\n") if x.strip()]
    out[DIMS : DIMS + _EXTRA] = np.array([1.0, same, same**0.5, distinct, 1 - len(set(lines)) / max(1, len(lines)), len(data) / len(w) / 10]) * 3
    of_words = np.bincount((mix(w) >> np.uint64(32)).astype(np.int64) % WORDS, minlength=WORDS)
    out[DIMS + _EXTRA :] = WORD_WEIGHT * np.log1p(of_words * (100 / len(w)))
    return out


@dataclass
class QualityModel:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray

    def vectors_of(self, rows: np.ndarray) -> np.ndarray:
        v = (rows.astype(np.float64) * self.idf) @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if len(self.vectors) == 0:
            return np.full(len(rows), 0.5)
        v, k = self.vectors_of(rows), min(K, len(self.vectors))
        out = np.empty(len(rows))
        for at in range(0, len(rows), 256):
            cos = v[at : at + 256] @ self.vectors.T
            cos = np.round(np.maximum(cos, 1e-6), 6)
            least = np.partition(cos, -k, axis=1)[:, -k, None]
            vote = np.where(cos >= least, cos * cos * cos * cos * self.weights, 0)
            out[at : at + 256] = (vote * self.labels).sum(axis=1) / vote.sum(axis=1)
        # Rests of rounding depend on the block; a text's score must not.
        return np.round(np.clip(out, 0.0, 1.0), 9)


def in_fold(doc_id: Column, fold: int = 2, folds: int = 4) -> Column:
    """Whether a document is in a fold; one without doc_id is in none."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def _terms_batch(texts: list[str | None]) -> list[pa.Array]:
    return [pa.array([terms(t).tobytes() for t in texts], pa.binary())]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Fit on labels (doc_id, label 0/1; others are ignored): at most `sample` documents of each label, in the order of a hash."""
    # Of conflicting labels of a doc_id the least counts.
    rows = labels.select("doc_id", F.col("label").cast("int").alias("label")).dropna().filter(F.col("label").isin(0, 1))
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"))
    shares = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    chosen = sampled(rows, "label", sample)
    # At most 2 * sample rows by the limit above; rows that repeat a doc_id give one of their vectors.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found = map_texts(texts, ["doc_id", "label"], _terms_batch, "terms binary")
    found = found.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("terms").alias("terms")).orderBy("doc_id").toPandas()
    if not len(found):
        none = np.empty((0, 0), np.float32)
        return QualityModel(none, none, none, none, none)
    x = np.stack([np.frombuffer(t, np.float32) for t in found["terms"]]).astype(np.float64)
    y = found["label"].to_numpy()
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 0.3
    x *= idf
    values, directions = np.linalg.eigh(x.T @ x)
    basis = directions[:, ::-1][:, : min(LATENT, len(x))]
    model = QualityModel(idf, basis, None, y.astype(np.float64), None)
    model.vectors = model.vectors_of(x / idf)
    # The sample is balanced; votes are weighted back to the labels' true shares, halfway on a log scale.
    share = np.array([shares.get(v, 1) / max(1, (y == v).sum()) for v in (0, 1)])
    model.weights = np.sqrt(share)[y]
    return model


def score(docs: DataFrame, model: QualityModel, keep: list[str], name: str = "score") -> DataFrame:
    """The kept columns of every row (a column of the score's name is replaced), and its score."""
    keep = [c for c in keep if c != name]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batch(texts: list[str | None]) -> list[pa.Array]:
        out = []
        for at in range(0, len(texts), 1000):
            rows = np.stack([terms(t) for t in texts[at : at + 1000]])
            scores = shared.value.score(rows)
            scores[~rows.any(axis=1)] = 0.0
            out.append(scores)
        return [pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())]

    return map_texts(docs, keep, batch, f"{name} double")
