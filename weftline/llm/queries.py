"""Queries p6 to p8 over the documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.functions.scale import cut, table
from weftline.llm import leakage, packing, truncation


def p6_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Every document in a window of every size."""
    sizes = cut(packing.token_counts(table(spark, sf, "documents")))
    return packing.pack(sizes, table(spark, sf, "context_windows"))


def p6_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Windows used and room left per window size, and how near to the fewest possible."""
    sizes, windows = cut(packing.token_counts(table(spark, sf, "documents"))), table(spark, sf, "context_windows")
    plans = packing.window_plans(sizes, windows)
    return packing.usage(packing.pack(sizes, windows, plans), windows, plans)


def p6_faults(spark: SparkSession, sf: str) -> DataFrame:
    """What a right packing never has, counted per window size."""
    sizes, windows = cut(packing.token_counts(table(spark, sf, "documents"))), table(spark, sf, "context_windows")
    return packing.faults(cut(packing.pack(sizes, windows)), sizes, windows)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and the eval items that leaked into them."""
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose text was cut."""
    return truncation.truncated(table(spark, sf, "documents")).select("doc_id").distinct()


def p8_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Share of cut texts per source."""
    documents = table(spark, sf, "documents")
    return truncation.source_shares(documents, truncation.truncated(documents))


def p8_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """What tells that texts were cut, per source."""
    return truncation.evidence_counts(truncation.truncated(table(spark, sf, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p6_windows, p6_usage, p6_faults, p7_found, p8_found, p8_sources, p8_evidence)}
SQL: dict[str, str] = {
    "p6_faults": "SELECT window_id, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, 0 AS overfull, 0 AS incomplete, 0 AS torn FROM context_windows WHERE capacity_tokens > 0 GROUP BY window_id",
}
