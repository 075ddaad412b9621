"""URL filters: host and path rules, else gradient-boosted trees on lexical features (operator 3).

The trees are trained on labelled URLs (url, blocked) with these features: lengths of url, host and
path, path depth, host labels, digit ratio, hyphens, host entropy, parameter counts, and the smoothed
share of blocked URLs for the last one and last two labels of the host and for the four-letter pieces
of its words among the labelled URLs. For a labelled URL, the pieces' shares are those of the hosts of the
other folds, so that a host doesn't vouch for itself.

Edge cases: a null url, or one without ``://``, has an empty host and path and is still judged by the
trees; repeated urls are judged alike; extra columns of any name are kept, but for those of the output's
names, which are replaced. An empty table gives no rows; without labelled URLs training is an error.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Sequence

import pandas as pd

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules of the query: (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: Words that name the hosts of the bundled labelled URLs.
BAD_WORDS = ("casino", "pills", "bets", "poker", "loans", "adult", "xxx", "spam", "track", "ads", "viagra", "jackpot", "crypto-win", "cheap-meds")
GOOD_WORDS = ("library", "school", "garden", "history", "physics", "museum", "cooking", "travel", "weather", "music", "village", "science", "theatre", "parks")
NAMES = ("alder", "brom", "cole", "dunmore", "elmet", "farrow", "grant", "hollis", "irwin", "jarrow", "keld", "lorne", "marden", "norby", "orwell", "perth", "quint", "rowan")
SYLLABLES = ("qua", "dre", "mib", "oth", "ess", "lun", "vor", "tep", "gha", "iru", "nul", "zes", "oke", "waf")
SUFFIXES = ("com", "org", "net", "info")

_LETTERS = string.ascii_lowercase + string.digits + "-._"
FEATURES = (
    "f_url_len", "f_host_len", "f_path_len", "f_depth", "f_labels", "f_digits", "f_hyphens",
    "f_entropy", "f_params", "f_value_len", "f_suffix1", "f_suffix2", "f_pieces",
)
#: Most labelled URLs used for training.
TRAIN_ROWS = 20_000
FOLDS = 5


def labelled_urls(spark: SparkSession) -> DataFrame:
    """Bundled labelled URLs (url, blocked), made by rule from the word lists above.

    Both classes have hosts with and without hyphens, digits and parameters; suffixes are skewed (most
    of org is clean, most of info blocked). Blocked are bad words in plain URLs, and neutral names with
    digits, long parameters or many hyphens; clean are good words, neutral and unseen names in plain URLs.
    """
    rows = []
    for i, suffix in enumerate(SUFFIXES):
        for j, (bad, good) in enumerate(zip(BAD_WORDS, GOOD_WORDS, strict=True)):
            bad2, good2, good3 = BAD_WORDS[(j + 3) % len(BAD_WORDS)], GOOD_WORDS[(j + 2) % len(GOOD_WORDS)], GOOD_WORDS[(j + 5) % len(GOOD_WORDS)]
            name, name2 = (NAMES[(j + k * (i + 2)) % len(NAMES)] for k in (1, 2))
            # Names that occur once or so: what nothing is known of is judged by its shape.
            once = [SYLLABLES[j] + SYLLABLES[(j + k + i) % 14] + SYLLABLES[(3 * j + i + 5 * k) % 14] for k in range(1, 7)]
            blocked = [
                f"http://{bad}-{bad2}.site.{suffix}/{good}/{7 * j + i}",
                f"https://www.{bad}{bad2}.pages.{suffix}/en/{53 * j}",
                f"http://{name}.{bad}.site.{suffix}/{good2}/{311 * j + i}",
                f"https://www.{once[3]}{1009 * j + 2003}.pages.{suffix}/{71003 + 97 * j}/{50021 + i}",
                f"http://{once[4]}.site.{suffix}/go?id={1009 * j}&ref=x{i}&k={j}&click={name2}{7 * j}&to={good}{good2}",
                f"https://{once[5]}-{name2}-{j}-{good}.pages.{suffix}/{good2}",
            ]
            clean = [
                f"https://{good}.site.{suffix}/{good2}/{311 * j + i}",
                f"http://www.{good}.pages.{suffix}/en/{53 * j}.html?page={i}",
                f"https://blog.{good}{good3}.site.{suffix}/en/{97 * j}?utm_source=feed",
                f"https://my-{good}.site.{suffix}/{good2}",
                f"http://www.{name}-{name2}.pages.{suffix}/en/{7 * j}",
                f"https://{name}.site.{suffix}/{good}/{11 * j}.html?page=2&ref=x",
            ]
            plain = [f"https://{once[0]}.site.{suffix}/en/{311 * j + i}", f"http://www.{once[1]}.pages.{suffix}/fr/{53 * j}.html?page={i}", f"http://m.{once[2]}.site.{suffix}/es/{29 * j}?page=2&ref=x"]
            rows += [(url, 0) for url in plain]
            n_blocked, n_clean = {"org": (3, 6), "info": (6, 2)}.get(suffix, (6, 5))
            rows += [(blocked[(j + k) % 6], 1) for k in range(n_blocked)] + [(clean[(j + k) % 6], 0) for k in range(n_clean)]
    return spark.createDataFrame(rows, "url string, blocked int")


def with_host_path(df: DataFrame) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    host = F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return df.withColumns({"host": host, "path": F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)})


def best_rule(rules: Sequence[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits host and path; null if none does."""
    fit = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, path = rule.partition("/")
        fits = ((F.col("host") == name) | F.endswith("host", F.lit("." + name))) & F.startswith("path", F.lit("/" + path))
        fit = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fit)
    return fit


def _features(df: DataFrame) -> DataFrame:
    """Lexical features of url, host and path."""
    url, n = F.coalesce("url", F.lit("")), F.greatest(F.length("host"), F.lit(1)).cast("double")
    entropy = F.lit(0.0)
    for letter in _LETTERS:
        share = (F.length("host") - F.length(F.replace("host", F.lit(letter)))) / n
        entropy = entropy - F.when(share > 0, share * F.log2(share)).otherwise(0.0)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return df.withColumns(
        {
            "f_url_len": F.length(url).cast("double"),
            "f_host_len": F.length("host").cast("double"),
            "f_path_len": F.length("path").cast("double"),
            "f_depth": F.length("path") - F.length(F.replace("path", F.lit("/"))) + F.lit(0.0),
            "f_labels": F.length("host") - F.length(F.replace("host", F.lit("."))) + F.lit(0.0),
            "f_digits": F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(F.length(url), F.lit(1)),
            "f_hyphens": F.length("host") - F.length(F.replace("host", F.lit("-"))) + F.lit(0.0),
            "f_entropy": entropy,
            "f_params": F.when(query == "", 0.0).otherwise(F.length(query) - F.length(F.replace(query, F.lit("&"))) + F.lit(1.0)),
            "f_value_len": F.length(query).cast("double"),
            "suffix1": F.substring_index("host", ".", -1),
            "suffix2": F.substring_index("host", ".", -2),
        }
    )


def _pieces(host: str) -> list[str]:
    """Four-letter pieces of the words in a host's labels, the last label left out; short words whole."""
    words = host.rpartition(".")[0].replace("-", ".").split(".")
    return [w[k : k + 4] for w in words if w for k in range(max(1, len(w) - 3))]


def _fold(host: str) -> int:
    return zlib.crc32(host.encode("utf-8", "surrogatepass")) % FOLDS


def _piece_shares(hosts: list[tuple[str, float]], base: float) -> dict[str, float]:
    """Smoothed share of blocked among the hosts that have a piece."""
    sums: dict[str, tuple[float, int]] = {}
    for host, blocked in hosts:
        for p in set(_pieces(host)):
            x, n = sums.get(p, (0.0, 0))
            sums[p] = x + blocked, n + 1
    return {p: (x + 5 * base) / (n + 5) for p, (x, n) in sums.items()}


def _mean_share(host: str, shares: dict[str, float], base: float) -> float:
    """Mean share of a host's pieces, weighted by their distance from the base; the base without any."""
    found = [shares.get(p, base) for p in _pieces(host)]
    weights = [abs(x - base) for x in found]
    return sum(x * w for x, w in zip(found, weights, strict=True)) / sum(weights) if sum(weights) else base


class UrlModel:
    """Trees and statistics of suffixes and pieces, trained by train().

    pieces has the shares without each fold's hosts and, last, those of all hosts.
    """

    def __init__(self, trees: GBTClassificationModel, suffixes: dict[str, DataFrame], pieces: list[dict[str, float]], base: float):
        self.trees, self.suffixes, self.base = trees, suffixes, base
        self.pieces = next(iter(suffixes.values())).sparkSession.sparkContext.broadcast(pieces)

    def features(self, df: DataFrame, held_out: bool = False) -> DataFrame:
        df = _features(df)
        for k, rates in self.suffixes.items():
            # At most TRAIN_ROWS suffixes: what the labelled URLs have.
            df = df.join(F.broadcast(rates), f"suffix{k}", "left").fillna(self.base, [f"f_suffix{k}"])
        shared, base = self.pieces, self.base

        @F.pandas_udf("double")
        def mean_share(hosts: pd.Series) -> pd.Series:
            pieces = shared.value
            return pd.Series([_mean_share(h, pieces[_fold(h) if held_out else FOLDS], base) for h in hosts], dtype="float64")

        df = df.withColumn("f_pieces", mean_share("host"))
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)

    def block_probability(self, df: DataFrame) -> DataFrame:
        """Adds host, path and p_block to every row; columns of those names are replaced."""
        kept = [c for c in df.columns if c not in ("host", "path", "p_block")]
        # Packed, so that no column of the input meets a name of the features or of the trees.
        packed = df.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col("url"))
        scored = self.trees.transform(self.features(with_host_path(packed)))
        return scored.select(*[F.col("_row").getField(c).alias(c) for c in kept], "host", "path", vector_to_array("probability")[1].alias("p_block"))


def train(labelled: DataFrame, trees: int = 10, depth: int = 3) -> UrlModel:
    """Fit on labelled URLs (url, blocked 0/1), at most TRAIN_ROWS of them in the order of a hash."""
    rows = labelled.select("url", F.col("blocked").cast("double").alias("blocked")).dropna()
    rows = _features(with_host_path(rows.orderBy(F.xxhash64("url"), "url").limit(TRAIN_ROWS))).cache()
    base = rows.agg(F.avg("blocked")).first()[0]
    if base is None:
        raise ValueError("no labelled URLs")
    suffixes = {}
    for k in ("1", "2"):
        rate = (F.sum("blocked") + 5 * F.lit(base)) / (F.count("*") + 5)
        suffixes[k] = rows.groupBy(f"suffix{k}").agg(rate.alias(f"f_suffix{k}"))
    hosts = [(r["host"], r["blocked"]) for r in rows.select("host", "blocked").collect()]  # at most TRAIN_ROWS
    pieces = [_piece_shares([x for x in hosts if _fold(x[0]) != k], base) for k in range(FOLDS + 1)]
    model = UrlModel(None, suffixes, pieces, base)
    raw = rows.select("url", "host", "path", "blocked")
    fit = GBTClassifier(labelCol="blocked", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7)
    model.trees = fit.fit(model.features(raw, held_out=True))
    rows.unpersist()
    return model


def filter_urls(pages: DataFrame, model: UrlModel, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """Adds host, path, rule, verdict and p_block to every row; the rule decides where one fits."""
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "p_block")]
    judged, fit = model.block_probability(pages.select(*[F.col(f"`{c}`") for c in kept])), best_rule(rules)
    by_model = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    return judged.select(*[F.col(f"`{c}`") for c in kept], "host", "path", fit["rule"].alias("rule"), F.coalesce(fit["verdict"], by_model).alias("verdict"), "p_block")
