"""The opN_ queries over the corpus tables; each returns the contract's columns from its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, fertility, licenses, lines, mixing, near, pii, quality, spelling, urls, warc, whitening
from .common import read


#: Target weights of the languages, of expected tokens.
TARGETS = {"en": 0.5, "de": 0.2, "fr": 0.15, "es": 0.15}
#: Score from which a document counts as good.
GOOD = 0.7


def domain_model(docs: DataFrame, spark: SparkSession, sf_dir: str) -> mixing.DomainModel:
    """Language posteriors, trained on the documents that the table of labels covers."""
    labelled = read(spark, sf_dir, "labels").select("doc_id").join(docs.select("doc_id", F.col("lang").alias("domain")), "doc_id")
    return mixing.train(docs, labelled)


def quality_model(docs: DataFrame, spark: SparkSession, sf_dir: str) -> quality.QualityModel:
    """Trained on the labels outside the held-out fold."""
    labels = read(spark, sf_dir, "labels").filter(~quality.in_fold(F.col("doc_id")))
    return quality.train(docs, labels.select("doc_id", F.col("quality").alias("label")))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = domain_model(docs, spark, sf_dir)
    mixed = mixing.mix(docs, model, TARGETS)
    shares = [F.round(F.col("posteriors")[i], 6).alias(f"p_{d}") for i, d in enumerate(model.domains)]
    return mixed.select("doc_id", "n_tokens", *shares, F.round("rate", 6).alias("rate"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(read(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(read(spark, sf_dir, "documents"))
    return found.withColumn("coverage", F.round("coverage", 6))


def op6_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge(read(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = quality.score(docs, quality_model(docs, spark, sf_dir), ["doc_id"])
    return scored.select(
        "doc_id",
        quality.in_fold(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"),
    )


def op3_url_filter(spark: SparkSession, sf_dir: str, labelled: DataFrame | None = None) -> DataFrame:
    """labelled is a table of (url, blocked) to train on instead of the bundled list."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    judged = urls.filter_urls(pages, urls.train(urls.labelled_urls(spark) if labelled is None else labelled))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("p_block", 6).alias("p_block"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat.digest(chat.format_chats(rows.unionByName(own)))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(read(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.forms(spelling.counts(read(spark, sf_dir, "documents")))


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_decontaminate, op3_url_filter, op4_pii, op5_licenses,
        op6_fertility, op7_line_dedup, op8_quality, op9_chat_format, op10_near_dedup,
        op11_warc, op12_spelling, op13_whiten,
    )
}
