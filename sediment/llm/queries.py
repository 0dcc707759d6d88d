"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_cnn, chat_format, fingerprint, html_text, minhash, mixing, packing, pii, quality_rules, secret_scan
from ..functions.plan import spread
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(name: str, op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: op(table(spark, sf_dir, name))


def _heavy(name: str, op: Callable[[DataFrame], DataFrame], *columns: str) -> Query:
    """For operators that work long on each row where it is read."""
    return lambda spark, sf_dir: op(spread(table(spark, sf_dir, name).select(*columns)))


def queries() -> dict[str, Query]:
    return {
        "op1_fingerprint": _over("documents", fingerprint.op1_fingerprint),
        "op2_near_dedup": _over("documents", minhash.op2_near_dedup),
        "op3_quality_cnn": byte_cnn.op3_quality_cnn,
        "op4_pii": _heavy("documents", pii.op4_pii, "doc_id", "text"),
        "op5_secret_scan": _heavy("documents", secret_scan.op5_secret_scan, "doc_id", "text"),
        "op6_quality_rules": _heavy("documents", quality_rules.op6_quality_rules, "doc_id", "text"),
        "op7_chat_format": lambda spark, sf_dir: chat_format.op7_chat_format(chat_format.with_probe(spark, sf_dir)),
        "op8_html_text": _heavy("pages", html_text.op8_html_text, "page_id", "html"),
        "op9_mixing": _over("documents", mixing.op9_mixing),
        "op10_packing": _over("documents", packing.op10_packing),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_fingerprint": fingerprint.ORACLE,
        "op2_near_dedup": minhash.ORACLE,
        "op5_secret_scan": secret_scan.ORACLE,
        "op6_quality_rules": quality_rules.ORACLE,
        "op7_chat_format": chat_format.ORACLE,
        "op9_mixing": mixing.ORACLE,
    }
