"""The queries of this subpackage, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meridia.llm import bpe, importance, langid, media, minhash, mixing, pii, quality, secrets, sharding, toxicity, url_filter, whitening
from meridia.llm.common import documents, spread, table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": lambda spark, sf: toxicity.op1_toxicity(documents(spark, sf, "doc_id", "text"), table(spark, sf, "labels")),
        "op2_url_filters": lambda spark, sf: url_filter.op2_url_filters(table(spark, sf, "pages")),
        "op3_near_dedup": lambda spark, sf: minhash.op3_near_dedup(documents(spark, sf, "doc_id", "text")),
        "op4_secret_scans": lambda spark, sf: secrets.op4_secret_scans(documents(spark, sf, "doc_id", "text")),
        "op5_language_id": lambda spark, sf: langid.op5_language_id(documents(spark, sf, "doc_id", "text", "lang")),
        "op6_byte_bpe": lambda spark, sf: bpe.op6_byte_bpe(documents(spark, sf, "doc_id", "text")),
        "op7_source_mix": lambda spark, sf: mixing.op7_source_mix(documents(spark, sf, "doc_id", "text", "lang", "source")),
        "op8_pii": lambda spark, sf: pii.op8_pii(documents(spark, sf, "doc_id", "text")),
        "op9_quality_rules": lambda spark, sf: quality.op9_quality_rules(documents(spark, sf, "doc_id", "text")),
        "op10_media_columns": lambda spark, sf: media.op10_media_columns(documents(spark, sf, "doc_id", "text")),
        "op11_importance": lambda spark, sf: importance.op11_importance(documents(spark, sf, "doc_id", "text"), table(spark, sf, "benchmark")),
        "op12_sharding": lambda spark, sf: sharding.op12_sharding(documents(spark, sf, "doc_id", "text")),
        "op13_whitening": lambda spark, sf: whitening.op13_whitening(spread(table(spark, sf, "embeddings").select("vec_id", "embedding"))),
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_quality_rules": quality.oracle_sql(), "op11_importance": importance.oracle_sql(), "op12_sharding": sharding.oracle_sql()}
