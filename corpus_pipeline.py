"""Corpus pipeline: five stages over ``documents``, each calling one training-data operator
with its production parameters on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from suasion.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from suasion.llm.queries import TOXICITY_THRESHOLD, tokenizer_file, toxicity_model
from suasion.llm.shared import ready, written
from suasion.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    model = toxicity_model(ready(spark), sf_dir, docs)
    return toxicity.without_toxic(docs, model, TOXICITY_THRESHOLD)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, or all but one word of it, go; n_chars follows the text."""
    ready(spark)
    return line_dedup.without_duplicate_lines(docs, count_col="n_chars")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    ready(spark)
    return simhash.one_per_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate.without_contaminated(docs, table(ready(spark), sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, by their digests."""
    import public_tokenizers
    ready(spark)
    return bpe.digests(docs, tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_level_bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}", "snappy")
    return docs
