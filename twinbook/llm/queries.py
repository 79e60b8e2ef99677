"""Queries of the problems on texts and descriptions (3, 6, 7, 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinbook.llm.encoding import decode_ids, encode_texts
from twinbook.llm.linkage import link_markets
from twinbook.llm.mixture import Mixture, mix_sources
from twinbook.llm.quality import judge_texts
from twinbook.operators.instants import with_instant
from twinbook.sources.tables import table


def _catalog(spark: SparkSession, sf: str, name: str) -> DataFrame:
    markets = with_instant(table(spark, sf, name), "expiration_datetime", table(spark, sf, "feeds"))
    return markets.withColumn("ends_day", F.floor(F.col("utc_us") / 86_400_000_000).cast("int"))


def p3_links(spark: SparkSession, sf: str) -> DataFrame:
    return link_markets(_catalog(spark, sf, "k_markets"), _catalog(spark, sf, "p_markets"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_links(spark, sf).select(F.least("k_id", "p_id").alias("id_a"), F.greatest("k_id", "p_id").alias("id_b")).distinct()


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_texts(table(spark, sf, "documents"))


def p6_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    decoded = decode_ids(encode_texts(table(spark, sf, "documents")))
    return decoded.select("doc_id", F.length("text").cast("int").alias("n_chars"))


def _mixture(spark: SparkSession, sf: str) -> Mixture:
    return mix_sources(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf).documents.where("repeats > 0")


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf).shares


def p8_quality(spark: SparkSession, sf: str) -> DataFrame:
    return judge_texts(table(spark, sf, "documents"), judged=table(spark, sf, "doc_kinds"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_quality(spark, sf).where("kind <> 'prose'").select("doc_id", "kind").distinct()


QUERIES = {"p3_found": p3_found, "p3_links": p3_links, "p6_ids": p6_ids, "p6_roundtrip": p6_roundtrip, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p8_found": p8_found, "p8_quality": p8_quality}
SQL = {"p6_roundtrip": "SELECT doc_id, CAST(length(coalesce(text, '')) AS INTEGER) AS n_chars FROM documents"}
