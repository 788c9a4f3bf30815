"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import bpe, collocations, exact_dedup, filter_audit, mil, near_dup, oracles, packing, pii, quality_rules, quotes, secrets, substring_dedup, token_counts
from furrow.llm.common import documents


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(documents(spark, sf_dir))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op4_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir), words=3, percent=85)


def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(documents(spark, sf_dir, "conversations"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(documents(spark, sf_dir)))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_dedup(exact_dedup.fingerprints(documents(spark, sf_dir)))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil.quality_scores(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_substring_dedup, op2_secret_scan, op3_token_counts, op4_minhash_near_dup, op5_quotation_linking,
        op6_best_fit_packing, op7_quality_rules, op8_bpe_round_trip, op9_exact_dedup, op10_quality_classifier,
        op11_personal_data, op12_filter_audit, op13_collocations,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": oracles.OP1, "op2_secret_scan": oracles.op2(), "op4_minhash_near_dup": oracles.OP4, "op5_quotation_linking": oracles.OP5, "op7_quality_rules": oracles.op7(), "op9_exact_dedup": oracles.OP9,
        "op12_filter_audit": oracles.OP12, "op13_collocations": oracles.OP13,
    }
