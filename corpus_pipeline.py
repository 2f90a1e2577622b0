"""The corpus pipeline: toxic documents out, one of each group of near copies, benchmark passages out, personal data replaced, then tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept. All but the
last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import decontaminate, near_dedup, pii, toxicity
from helixframe.llm.bpe import bpe_round_trip
from helixframe.llm.common import table, written

#: Documents of this score and more are rejected.
TOXIC = 0.5
VOCABULARY = "byte_bpe_50k.tiktoken"


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose score, learned from the labels, reaches 0.5."""
    grammar = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, grammar).where(F.col("score") < TOXIC).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the document of the least id."""
    return near_dedup.deduplicated(docs).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates; ``n_chars`` follows the text."""
    out = pii.replaced(docs)
    changed = F.col("n_replaced") > 0
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    return bpe_round_trip(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_copies),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("bpe", tokens),
]

#: The learned grammar, the samples and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
