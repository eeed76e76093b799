"""The corpus pipeline: quality, toxicity, near duplicates, contamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result
as Parquet in the shared folder and reads it again as the next stage's documents. All but
the last return the columns of ``documents`` with the rows that stay.

Columns beyond those of ``documents`` pass every filtering stage unchanged, whatever their
names: a stage sees them under names of their place.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import common, decontaminate, packing, quality, simhash, toxicity
from tracefold.sources.sinks import stored

#: The stages hold learned models, fingerprints and token ids; SQL cannot express them.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal regression expects to be at least of the middle grade."""
    ratings = quality.label_grades(common.table(spark, sf_dir, "labels"))
    judged = quality.classify(docs, quality.train(docs, ratings))
    return judged.where("keep").select(docs.columns)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold."""
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("predicted") == 0).select(docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of copies and near copies."""
    return simhash.remove_near_duplicates(docs)


def keep_unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.remove_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in full sequences."""
    return packing.pack(docs)


DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def _carrying(stage: Callable[[SparkSession, DataFrame, str], DataFrame]
              ) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with the caller's extra columns out of the way of its own."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        extra = {c: f"extra column {i}" for i, c in enumerate(docs.columns) if c not in DOCUMENT}
        if not extra:
            return stage(spark, docs, sf_dir)
        out = stage(spark, docs.withColumnsRenamed(extra), sf_dir)
        return out.withColumnsRenamed({place: c for c, place in extra.items()})

    return run_stage


STAGES = [
    ("quality", _carrying(keep_good)),
    ("toxicity", _carrying(keep_civil)),
    ("near_duplicates", _carrying(keep_one_of_each)),
    ("decontamination", _carrying(keep_unseen)),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
