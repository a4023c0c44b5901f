"""A corpus pipeline of five stages over the documents table.

Each stage gets what its predecessor kept, works on all of it and returns it
with its decisions applied; the last one packs.  ``run`` writes each stage's
rows to the shared folder and reads them again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowproof.llm import pii_transducer, quality_lists, retrieval_packing, simhash_similar, toxicity_crf
from rowproof.llm.common import table, written
from rowproof.llm.queries import split_pattern, tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither a base rule nor the learned list rejects."""
    return quality_lists.filtered(docs, table(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    model = toxicity_crf.learned(docs, table(spark, sf_dir, "labels"))
    return toxicity_crf.filtered(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more."""
    return simhash_similar.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data masked."""
    return pii_transducer.redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences."""
    return retrieval_packing.packed(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"), split_pattern())


STAGES = [
    ("quality_rules", quality),
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("packing", packing),
]

#: SQL cannot express the learned stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
