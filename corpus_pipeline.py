"""From raw documents to token ids: each stage takes what the one before kept.

language_id drops what is in no known language, near_dedup keeps one document of each
class of near copies, pii puts surrogates into texts, mixing selects a token-prefix of
each leaf of the domain, language and source tree, byte_bpe encodes what is left and
decodes it again.

Edge cases are those of the operators: a null text is dropped by the first stage (it has
no language); null ids are never near copies; repeated rows become one; empty tables go
through. Columns that documents doesn't have are dropped at the start, so names can't
clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm import bpe, langid, minhash, mixing, pii
from meridia.llm.common import DOCUMENT_COLUMNS, documents, written

#: Of all tokens, what the mix selects, each document once at most.
TARGET_SHARE = 0.8
PII_KEY = "corpus-surrogates"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled rows teach, with a score of 0.4 or more."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    return langid.keep_known(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs.select(*DOCUMENT_COLUMNS))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates; n_chars counts them anew."""
    return pii.replace(docs.select(*DOCUMENT_COLUMNS), PII_KEY).withColumn("n_chars", F.length("text").cast("long"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.select_mix(docs.select(*DOCUMENT_COLUMNS), mixing.QUERY_WEIGHTS, target_share=TARGET_SHARE).drop("copies")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and of what they decode to, and the ids."""
    return bpe.round_trip(docs, ids=True)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("pii", private_data),
    ("mixing", source_mix),
    ("byte_bpe", byte_bpe),
]

#: No SQL says any of the stages; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
