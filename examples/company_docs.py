"""An example source: a company's own documents, registered beside the built-in connectors.

    from examples.company_docs import MANIFEST, items
    faults = facade.plugin_diagnostics(manifests, handlers)   # with MANIFEST among the manifests
    e = Evidence(asked, raw_items.unionByName(items(spark.read.parquet("company_docs"))))
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MANIFEST = ("company_docs", "Company documents")


def items(docs: DataFrame) -> DataFrame:
    """Raw items of documents (path, title, body, changed); titles and bodies as they are, the path as the address."""
    return docs.select(
        F.concat(F.lit("company_docs:"), F.sha1("path").substr(1, 12)).alias("id"), F.pmod(F.xxhash64("path"), F.lit(1 << 40)).alias("ord"), F.lit(MANIFEST[0]).alias("source"), F.lit("other").alias("source_type"),
        F.concat(F.lit("https://docs.example.org/"), "path").alias("url"), "title", F.lit(None).cast("string").alias("author"), F.col("changed").alias("publish_date"), F.col("body").alias("text"), F.lit(None).cast("string").alias("summary"),
    )
