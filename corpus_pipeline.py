"""A training-data pipeline over ``documents``: each stage works on all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and reads back. All but
the last return the columns of their input. A row with a null doc_id passes like any other. Null and empty texts are
judged by the first stage like any text, and go in the second, as they are in no language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegraph.llm import decontaminate, langid, mixing, ngram_join, quality
from tracegraph.store import saved

#: Least probability with which a text stays: that its quality is good.
MIN_QUALITY = 0.5
#: How far the likeliest language's probability must be above that of a guess among all languages, as a share of the way
#: from there to 1.
MIN_MARGIN = 0.1


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the classifier, trained on all labels, finds good."""
    # statistics of all texts, of which those with a label are few, so that no text is shuffled
    stats = saved(quality.with_statistics(docs.select("doc_id", "text")), "stats")
    model = quality.train(quality.labelled(stats, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.with_scores(docs, model).where(F.col("quality_score") >= MIN_QUALITY).select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a language: those without letters go, and those in which no language stands out from a guess by
    MIN_MARGIN. Where no text has a language to learn, or all have one, every text with letters stays."""
    model = langid.train(docs)
    guess = 1 / max(1, len(model.languages))
    if len(model.languages) < 2:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = langid.predict(docs, model)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= guess + MIN_MARGIN * (1 - guess))).select(*docs.columns)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of ``benchmark``."""
    return decontaminate.remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed: documents, as often as drawn, with the number of the copy."""
    return mixing.mix(docs)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", duplicate_stage),
    ("decontamination", benchmark_stage),
    ("mixing", mixing_stage),
]

#: Trained models decide two of the stages: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
