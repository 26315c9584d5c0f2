"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimweave.llm import bpe, chat, decontaminate, fingerprint, langid, licenses, linededup, merkle, neardup, resample, secrets, toxicity, urls
from claimweave.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def _documents(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_chat_formatting": lambda spark, sf_dir: chat.format_conversations(read(spark, sf_dir, "conversations")),
        "op2_license_scan": _documents(lambda docs: licenses.license_scan(docs, whole=True)),
        "op2_license_scan_all": _documents(lambda docs: licenses.license_scan(docs, whole=True)),
        "op3_bpe": _documents(bpe.encode_all),
        "op4_secret_scan": _documents(secrets.secrets_by_document),
        "op5_fingerprint": _documents(fingerprint.fingerprint_edits),
        "op6_language_id": langid.language_id,
        "op7_toxicity": toxicity.toxicity,
        "op8_near_duplicates": _documents(neardup.near_duplicates_op8),
        "op9_decontamination": lambda spark, sf_dir: decontaminate.contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")),
        "op10_line_dedup": _documents(linededup.line_dedup),
        "op11_importance_resampling": lambda spark, sf_dir: resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")),
        "op12_url_filter": lambda spark, sf_dir: urls.url_filter(spark, read(spark, sf_dir, "pages")),
        "op13_merkle_manifest": _documents(merkle.merkle_manifest),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_formatting": chat.ORACLE_SQL,
        "op2_license_scan": licenses.ORACLE_SQL,
        "op2_license_scan_all": licenses.ORACLE_SQL,
        "op4_secret_scan": secrets.ORACLE_SQL,
        "op9_decontamination": decontaminate.ORACLE_SQL,
        "op11_importance_resampling": resample.ORACLE_SQL,
        "op12_url_filter": urls.ORACLE_SQL,
        "op13_merkle_manifest": merkle.ORACLE_SQL,
    }
