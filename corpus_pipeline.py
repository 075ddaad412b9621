"""Corpus pipeline: five operators of panelspark.llm applied to `documents`, one after the other.

Every stage takes the documents that its predecessor kept and returns them with the same columns and values, whatever
their names; the last adds n_tokens and rate, and takes the place of input columns of these two names. A stage reads its input as often as its operator needs, so run()
writes the result of every stage to the shared folder and removes it when the next one is written.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import decontaminate, lines, mixing, near, quality, queries
from panelspark.llm.common import Scratch, materialize, read, with_ids


#: Columns that stages read; n_chars is brought up to date where it is there.
READ = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def carrying(stage: Stage) -> Stage:
    """The stage with other columns of the input under names that no operator uses, and under their own again after it."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        aside = {c: f"_carried_{i}" for i, c in enumerate(docs.columns) if c not in READ}
        out = stage(spark, docs.toDF(*[aside.get(c, c) for c in docs.columns]), sf_dir)
        back = {v: c for c, v in aside.items()}
        # What the stage adds goes before a column of that name.
        columns = [c for c in out.columns if back.get(c) is None or back[c] not in out.columns]
        return out.select(*[F.col(c).alias(back.get(c, c)) for c in columns])

    return run_stage


@carrying
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents with a score below the threshold go; null texts score 0 and go."""
    model = queries.quality_model(docs, spark, sf_dir)
    return quality.score(docs, model, docs.columns, "_quality").filter(F.col("_quality") >= queries.GOOD).select(*docs.columns)


@carrying
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: repeated lines go; a document that had words and has lost all of them goes too."""
    # Lines that go have words, so a document is emptied if no line with a word is left.
    columns, blank = docs.columns, "^[\\x20\\x09-\\x0D]*$"
    found = lines.dedup_lines(docs)
    emptied = F.coalesce((F.col("n_kept") < F.col("n_lines")) & F.col("text").rlike(blank), F.lit(False))
    found = found.filter(~emptied)
    if "n_chars" in columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*columns)


@carrying
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: the least doc_id of each group stays; so does a doc_id one of whose rows is to stay."""
    found = near.near_duplicates(docs).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = materialize(found.filter("not kept").select("doc_id"))
    return with_ids(docs, gone, "left_anti").select(*docs.columns)


@carrying
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that contain a test item go."""
    hits = decontaminate.contained(docs, read(spark, sf_dir, "benchmark"))
    return with_ids(docs, materialize(hits.select("doc_id").distinct()), "left_anti").select(*docs.columns)


@carrying
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: adds n_tokens and the rate at which a document is drawn; those of rate 0 go."""
    model = queries.domain_model(docs, spark, sf_dir)
    mixed = mixing.mix(docs, model, queries.TARGETS, docs.columns)
    return mixed.filter("rate > 0").select(*docs.columns, "n_tokens", F.round("rate", 6).alias("rate"))


STAGES = [
    ("quality", keep_good),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
]

#: The classifier and the rates are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), Scratch(spark)
    *first, (_, last) = STAGES
    for _, stage in first:
        written = Scratch(spark)
        docs = written(stage(spark, docs, sf_dir))
        before.clear()
        before = written
    return last(spark, docs, sf_dir)
