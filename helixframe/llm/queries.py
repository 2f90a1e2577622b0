"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import decontaminate, licenses, multi_index, near_dedup, pii, secrets, suffix_dedup, toxicity, warc
from helixframe.llm.bpe import bpe_round_trip
from helixframe.llm.common import table

#: The rank file that the queries use, found by the package of public tokenizers.
VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again: token count and digests."""
    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in 400-byte strings that start more than once, removed."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each vector whose id is divisible by 20, among all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return multi_index.search(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base patterns and the field's spans in every text."""
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.fit(docs))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, paragraphs and texts that state a licence."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its personal data replaced."""
    return pii.replaced(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_replaced")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near duplicates of every document."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document, learned from labels that are not held out."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back."""
    return warc.archived(table(spark, sf_dir, "pages"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that documents hold."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_bpe, op2_suffix_dedup, op3_multi_index, op4_secrets, op5_licenses, op6_pii, op7_near_dedup, op8_toxicity, op9_warc, op10_decontaminate)}

_WARC = """
WITH d AS (SELECT page_id, url, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest HAVING count(*) > 1)
SELECT page_id, url, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM d LEFT JOIN f USING (digest)
"""

ORACLES: dict[str, str] = {"op5_licenses": licenses.oracle(), "op9_warc": _WARC}
