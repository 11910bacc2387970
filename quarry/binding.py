"""How the test tables become the engine's inputs; the only place that knows their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.dims import SOURCE_TYPES, SOURCES, STANCES, lookup, source_weight, strings
from quarry.functions.text import pack_chunks, token_estimate
from quarry.functions.vector import clamp01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as raw items: id, ord, source, source_type, url, title, author, publish_date, text, summary."""
    d = table(spark, sf_dir, "documents")
    source = F.element_at(strings(SOURCES), (F.substring("source", 4, 10).cast("int") % len(SOURCES) + 1).cast("int"))
    d = d.select("doc_id", "text", F.col("source").alias("site"), source.alias("source"))
    return d.select(
        F.concat(F.lit("doc:"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("id"), F.col("doc_id").alias("ord"), "source",
        lookup(SOURCE_TYPES, F.col("source"), "academic").alias("source_type"), F.concat(F.lit("https://"), "site", F.lit(".example.org/doc/"), F.col("doc_id").cast("string")).alias("url"),
        F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"), F.lit(None).cast("string").alias("author"),
        F.date_sub(F.lit("2025-01-01").cast("date"), (F.col("doc_id") % 4000).cast("int")).cast("timestamp").alias("publish_date"), "text", F.lit(None).cast("string").alias("summary"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def age_days(published, now: str) -> F.Column:
    return (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(published)) / F.lit(8.64e10)


def freshness_stored(published, now: str) -> F.Column:
    """The bucket that chunks carry: null 0.5, future 0.8, then by 30 days, 1 and 5 years."""
    a = age_days(published, now)
    return F.when(published.isNull(), 0.5).when(a < 0, 0.8).when(a < 30, 1.0).when(a < 365, 0.85).when(a < 1825, 0.7).otherwise(0.55)


def freshness_ranked(published, now: str) -> F.Column:
    """The bucket that pre-ranking uses: null 0.55, then by 1, 3 and 8 years."""
    a = F.greatest(F.lit(0.0), age_days(published, now))
    return F.when(published.isNull(), 0.55).when(a <= 365, 1.0).when(a <= 1095, 0.78).when(a <= 2920, 0.6).otherwise(0.45)


def chunks(items: DataFrame, now: str, least: int = 500, most: int = 1000, carry: tuple[str, ...] = ()) -> DataFrame:
    """Raw items as chunks with the scores that they start with, and the columns ``carry``."""
    c = items.select("*", F.posexplode(pack_chunks(F.trim("text"), least, most)).alias("n", "content")).filter(F.col("content") != "")
    weight = source_weight(F.col("source"), F.col("source_type"))
    return c.select(
        F.concat("id", F.lit(":chunk:"), F.lpad(F.col("n").cast("string"), 4, "0")).alias("chunk_id"), F.col("id").alias("item_id"), (F.col("ord") * 10000 + F.col("n")).alias("ord"),
        "source", "source_type", "url", "title", "author", "publish_date", "content", lookup(STANCES, F.col("source_type"), "speculation").alias("stance"),
        clamp01(weight).alias("weight"), freshness_stored(F.col("publish_date"), now).alias("freshness"), token_estimate(F.col("content")).alias("tokens"), *carry,
    )
