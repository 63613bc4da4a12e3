"""A training corpus from raw documents, stage by stage.

Every stage keeps all columns of the documents, whatever their names, and works on all that the stage before
it kept; all but the last return the columns that they got. An empty table stays empty, with its columns.
Null texts count as empty texts (and stay null), null ids are documents like others, texts are read whole,
and what a stage does with ties and repeated rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flumen.llm import bpe, decontaminate, jaccard, pii, quality_classifier
from flumen.llm.common import read_table, shared_folder, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts: those of a score of ``THRESHOLD`` or more. Repeated rows go or stay together, and texts without a word are judged as such."""
    return quality_classifier.keep_good(docs, read_table(spark, sf_dir, "labels"))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the one of smallest id, null ids last; of repeated rows one. Rows that are linked with nothing, and all without words, stay, whatever their ids."""
    return jaccard.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item: fewer than 0.8 of the shingles of each. Repeated rows go or stay together."""
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; all rows stay. Of overlapping finds the base formats count, then the likelier."""
    return pii.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids: ``n_tokens`` and ``token_ids`` are added, or replaced; all rows stay. Empty texts have no tokens."""
    return bpe.encode_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", deduplicated), ("decontamination", decontaminated), ("pii", redacted), ("encoding", encoded)]
#: SQL can express neither the classifier nor the encoding; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again by the next."""
    folder = shared_folder(spark)
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, folder, f"{k}_{name}")
    return docs
