"""The corpus pipeline: from raw documents to a mixed, clean training corpus.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage
before it kept. Near duplicates are texts with 80 % of their five-word
shingles in common.

Nulls, empty texts, repeated rows and empty tables pass through every stage as its
operator says; all columns are kept, whatever their names.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import decontam, jaccard, mixing, pii, quality
from loomspark.llm.common import fold, fresh, settled

#: SQL cannot express a trained classifier, alignments and discovered identifiers.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject: a score of at least 0.3. Null and empty texts have a score too."""
    (name,) = fresh(docs, "score")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold() != 0)
    model = quality.train(docs, labels)
    scored = quality.score(docs, model, docs.columns, name)
    return scored.filter(scored[name] >= 0.3).drop(name)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.deduplicate(docs, n=5, num=80, den=100)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item, whole or edited."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    (name,) = fresh(docs, "leaks")
    return decontam.find_leaks(docs, items, name=name).filter(F.size(name) == 0).drop(name)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, in the order of virtual finish time."""
    return mixing.mix(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(spark, partial(stage, spark, docs, sf_dir), name)  # what a stage has stored on its way goes
    return STAGES[-1][1](spark, docs, sf_dir)
