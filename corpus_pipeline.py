"""The corpus pipeline: low quality out, one document of each near-duplicate group, benchmark leaks out, then packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Every row is
decided by its own text:

- null and empty texts, and those without words, are scored like others by the classifier, are no near duplicates, hold no benchmark
  item, and pack as one end id;
- repeated rows, and rows of one doc_id with different texts, are rows of their own: of equal or near texts one row stays, whatever
  their ids; a leaking text goes and takes no other text of its doc_id with it;
- rows without a doc_id take part in every stage;
- very long texts are read whole; further columns are carried along, whatever their names, and left out by the last stage;
- an empty table gives no rows, without labels the classifier rejects nothing, and without benchmark items nothing leaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, ngram_join, packing, quality
from tessera.llm.common import materialize, remove, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(docs, k=5, num=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"), nameless=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", pack),
]

#: Model fitting, components and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{i}")
        if before is not None:
            remove(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
