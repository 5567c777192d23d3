"""Queries of the training-data operators, with SQL where DuckDB can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from namelens.llm import bpe, linkage, lookalikes, packing, truncation, variants
from namelens.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of entries of one list that mean the same person or organisation."""
    return variants.variant_pairs(table(spark, d, "sanctions_list"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Names and aliases that hold characters other than they seem to."""
    return lookalikes.unusual_values(table(spark, d, "sanctions_list"))


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every name and alias in its consistent form."""
    return lookalikes.usual_forms(table(spark, d, "sanctions_list"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of entries of different lists that describe the same person or organisation."""
    return linkage.linked_pairs(table(spark, d, "sanctions_list"))


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs with their scores and confidences."""
    return linkage.links(table(spark, d, "sanctions_list"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document."""
    return bpe.encode(table(spark, d, "documents").select("doc_id", "text"))


def p7_assigned(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or of its pieces, for each capacity."""
    return packing.pack_texts(table(spark, d, "documents"), table(spark, d, "pack_limit"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text was cut off."""
    return truncation.cut_texts(table(spark, d, "documents"))


def p8_sources(spark: SparkSession, d: str) -> DataFrame:
    """How often each source cuts texts, and at what length."""
    return truncation.cut_by_source(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p4_found, p4_forms, p5_found, p5_links, p6_ids, p7_assigned, p8_found, p8_sources)}
ORACLE_SQL: dict[str, str] = {}
