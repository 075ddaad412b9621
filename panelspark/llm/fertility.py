"""Quality rules by tokeniser fertility (operator 6).

A public vocabulary with byte fallback measures every whole text: characters per token, the share of
byte-fallback tokens, and the entropy of its tokens as a share of the most that their number allows.
The entropy share falls with the number of tokens, so its distance from a line over log2 of that number,
fitted for each language, is judged. Bands come from all documents of a language that pass the base rules:
per measure, the quartiles of a histogram (values rounded to 0.001, counted before any shuffle) widened by
WIDTH times their distance, within the possible range. A text outside a band is
rejected; so is one that fails the base rules (fewer than 50 words, or more than half of the words in
repeated three-word windows).

Edge cases: null text has no words and fails; a null language is a language of its own; a language whose
documents all agree has the least width; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _IS_WORD, map_texts, materialize, mix, word_hashes

#: Place of the vocabulary file; a parameter, the file is never copied.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
WIDTH = 3.0
#: Least distance of a bound from its quartile, for languages whose documents nearly agree.
LEAST_WIDTH = {"chars_per_token": 0.1, "fallback_share": 0.01, "entropy_excess": 0.02}
#: Possible values.
RANGE = {"chars_per_token": (0.0, float("inf")), "fallback_share": (0.0, 1.0), "entropy_excess": (-1.0, 1.0)}
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_loaded: dict[str, tuple] = {}


def tokenizer(path: str) -> tuple:
    """The model and a flag for each of its ids that is a byte; loaded once in a worker."""
    if path not in _loaded:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        _loaded[path] = model, np.array([model.is_byte(i) for i in range(model.get_piece_size())])
    return _loaded[path]


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    data = text.encode("utf-8", "surrogatepass")
    b = np.frombuffer(data, np.uint8)
    words = word_hashes(data)
    chars = int(np.count_nonzero(_IS_WORD[b] & ((b & 0xC0) != 0x80)))
    seen, repeated = set(), 0
    for line in data.split(b"\n"):
        if line in seen:
            repeated += 1
        elif line.split():
            seen.add(line)
    in_repeat = 0
    if len(words) >= 3:
        windows = mix(words[:-2] * np.uint64(3) + mix(words[1:-1]) * np.uint64(5) + mix(mix(words[2:])) * np.uint64(7))
        _, which, n = np.unique(windows, return_inverse=True, return_counts=True)
        often, inside = n[which] > 1, np.zeros(len(words), bool)
        for k in range(3):
            inside[k : len(words) - 2 + k] |= often
        in_repeat = int(inside.sum())
    return len(words), chars, int(np.count_nonzero(_SYMBOLS[b])), repeated, in_repeat


def fertility(text: str, path: str) -> tuple[int, float | None, float | None, float | None]:
    """Tokens, characters per token, byte-fallback share and entropy share; nulls without tokens."""
    model, is_byte = tokenizer(path)
    ids = np.array(model.encode(text, num_threads=1), np.int64)
    if not len(ids):
        return 0, None, None, None
    n = np.unique(ids, return_counts=True)[1] / len(ids)
    most = np.log2(min(len(ids), len(is_byte)))
    entropy = float(-(n * np.log2(n)).sum() / most) if most else 1.0
    return len(ids), len(text) / len(ids), float(is_byte[ids].mean()), entropy


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MEASURES = ("chars_per_token", "fallback_share", "entropy_share")


def measure(docs: DataFrame, path: str = MODEL_FILE) -> DataFrame:
    """doc_id, lang, the base counts, n_tokens and the three measures of every row."""

    def batch(texts: list[str | None]) -> list[pa.Array]:
        rows = [(*base_counts(t or ""), *fertility(t or "", path)) for t in texts]
        columns = list(zip(*rows, strict=True)) or [()] * 9
        return [pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(c, pa.float64()) for c in columns[6:]]

    added = ", ".join([f"{c} long" for c in (*_COUNTS, "n_tokens")] + [f"{c} double" for c in _MEASURES])
    return map_texts(docs, ["doc_id", "lang"], batch, added)


def _failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def with_excess(measured: DataFrame) -> DataFrame:
    """Adds entropy_excess, the entropy share less what the language's line gives for the number of tokens."""
    size = F.log2(F.greatest("n_tokens", F.lit(1)))
    fit = measured.filter(~_failed() & F.col("entropy_share").isNotNull()).withColumn("_size", size).groupBy(F.col("lang").alias("_lang")).agg(
        F.coalesce(F.regr_slope("entropy_share", "_size"), F.lit(0.0)).alias("_slope"),
        F.avg("entropy_share").alias("_share"), F.avg("_size").alias("_mean"),
    )
    joined = measured.join(fit, F.col("lang").eqNullSafe(F.col("_lang")), "left")  # one row a language
    line = F.col("_share") + F.col("_slope") * (size - F.col("_mean"))
    return joined.withColumn("entropy_excess", F.col("entropy_share") - line).drop("_lang", "_slope", "_share", "_mean")


def bands(measured: DataFrame) -> DataFrame:
    """lang, and lower and upper bound of each judged value, from the language's documents that pass the base rules."""
    good = measured.filter(~_failed())
    stacked = good.select("lang", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.round(m, 3).alias("x")) for m in LEAST_WIDTH])).alias("e"))
    counted = stacked.select("lang", "e.m", "e.x").filter("x is not null").groupBy("lang", "m", "x").agg(F.count("*").alias("n"))
    quarters = counted.groupBy("lang", "m").agg(F.percentile("x", [0.25, 0.75], F.col("n")).alias("q"))
    least = F.create_map(*[F.lit(v) for item in LEAST_WIDTH.items() for v in item])[F.col("m")]
    width = F.greatest(WIDTH * (F.col("q")[1] - F.col("q")[0]), least)
    least_value, most_value = (F.create_map(*[F.lit(v) for m, ends in RANGE.items() for v in (m, ends[k])])[F.col("m")] for k in (0, 1))
    low, high = F.greatest(F.col("q")[0] - width, least_value), F.least(F.col("q")[1] + width, most_value)
    bound = quarters.select("lang", "m", F.struct(low.alias("lo"), high.alias("hi")).alias("b"))
    return bound.groupBy("lang").pivot("m", list(LEAST_WIDTH)).agg(F.first("b")).withColumnsRenamed({m: f"b_{m}" for m in LEAST_WIDTH})


def judge(docs: DataFrame, path: str = MODEL_FILE) -> DataFrame:
    """doc_id, the base counts, base_failed, the measures and kept of every row."""
    measured = with_excess(materialize(measure(docs, path)))
    limits = bands(measured)  # one row a language
    fits = F.lit(True)
    for m in LEAST_WIDTH:
        fits = fits & F.coalesce(F.col(m).between(F.col(f"b_{m}.lo"), F.col(f"b_{m}.hi")), F.lit(False))
    failed = _failed()
    x = measured.withColumnRenamed("lang", "own")
    return x.join(limits, F.col("own").eqNullSafe(F.col("lang")), "left").select(
        "doc_id", *_COUNTS, failed.alias("base_failed"), (~failed & fits).alias("kept"), *[F.round(m, 6).alias(m) for m in _MEASURES]
    )
