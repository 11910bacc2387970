"""Text of documents from what a source says and from pages: a ladder of statuses, the best attempt of every document."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from quarry.dims import lookup
from quarry.functions.pdf import text_of_pdf
from quarry.functions.text import strip_html
from quarry.functions.url import document_type, evidence_key, normalized_url

# Bounds in characters, the ladder of statuses with confidence and coverage, sources that give abstracts.
MOST_CHARS, FULL_CHARS, SOME_CHARS = 30_000, 1_200, 300
LADDER = {"full_text": 5, "section_text": 4, "structured_abstract": 3, "snippet": 2, "metadata_only": 1, "failed": 0}
CONFIDENCE = {"full_text": 0.9, "section_text": 0.8, "structured_abstract": 0.55, "snippet": 0.35, "metadata_only": 0.1, "failed": 0.0}
COVERAGE = {"full_text": 0.85, "section_text": 0.65, "structured_abstract": 0.45, "snippet": 0.25, "metadata_only": 0.0, "failed": 0.0}
THIN = ["arxiv", "semantic_scholar", "openalex", "crossref", "core", "pubmed"]
DEGRADED = ["structured_abstract", "snippet", "metadata_only", "failed"]
AUTHORITY = ["government", "filing", "medical", "academic", "structured_fact"]


class _Main(HTMLParser):
    """Text of <article> or <main> if there is any, else of the body, without scripts, styles and page furniture."""

    skipped = {"script", "style", "noscript", "nav", "header", "footer", "aside", "form", "template"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.every: list[str] = []
        self.main: list[str] = []
        self.skip = self.inside = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skip += tag in self.skipped
        self.inside += tag in ("article", "main")

    def handle_endtag(self, tag: str) -> None:
        self.skip = max(0, self.skip - (tag in self.skipped))
        self.inside = max(0, self.inside - (tag in ("article", "main")))

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.every.append(data)
            if self.inside:
                self.main.append(data)


def main_text(html: str | None) -> str:
    parser = _Main()
    parser.feed(html or "")
    parser.close()
    said = " ".join(" ".join(parser.main).split())
    return said or " ".join(" ".join(parser.every).split())


@pandas_udf(StringType())
def readable(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Main content of HTML pages on one line."""
    for series in parts:
        yield series.map(main_text)


def truncated(text: Column, most: int = MOST_CHARS) -> Column:
    return F.when(F.length(text) > most, F.trim(F.substring(text, 1, most))).otherwise(text)


def composed(title: Column, summary: Column, text: Column) -> Column:
    """Title, summary and text of an item as one line."""
    present = lambda c: F.when(c != "", c)
    return strip_html(F.concat_ws("\n\n", present(title), present(summary), present(text)))


def structured_status(text: Column, source: Column, mock: Column | None = None) -> Column:
    """Status of what a source itself says."""
    long = F.length(text) >= SOME_CHARS
    s = F.when(F.length(text) >= FULL_CHARS, "full_text").when(long & source.isin(*THIN), "structured_abstract").when(F.trim(text) != "", "snippet").otherwise("metadata_only")
    return s if mock is None else F.when(mock & (F.trim(text) != ""), "full_text").otherwise(s)


def page_status(text: Column) -> Column:
    """Status of what a page says."""
    n = F.length(text)
    return F.when(n >= FULL_CHARS, "full_text").when(n >= SOME_CHARS, "section_text").when(F.trim(text) != "", "snippet").otherwise("metadata_only")


def degradation(status: Column, kind: Column) -> Column:
    """Why a status is less than a text; null for texts."""
    return (
        F.when(status == "structured_abstract", F.lit("Only an abstract was to be had.")).when(status == "snippet", F.lit("Only a snippet or short text was to be had."))
        .when(status == "metadata_only", F.concat(F.lit("Only metadata of a "), kind, F.lit(" was to be had."))).when(status == "failed", F.lit("The page could not be had."))
    )


def is_degraded(status: Column) -> Column:
    return status.isin(*DEGRADED)


def high_authority(weight: Column, kind: Column, stance: Column) -> Column:
    return (weight >= 0.65) | kind.isin(*AUTHORITY) | (stance == "primary_source")


def documents(items: DataFrame, pages: DataFrame, most: int = 12, doi: str = "doi") -> DataFrame:
    """One row a document: raw items grouped by canonical URL, its best item, and the best of two attempts at its text.

    ``items``: raw items with ``ord`` and ``group_id`` (a query; at most ``most`` documents of a group are looked up);
    ``pages``: (url, html) and, where pages may be PDF files, ``pdf``, their bytes or null. The page of a canonical URL
    that ``pages`` does not have is a failed attempt, and so is a PDF file whose text cannot be read.
    """
    known_doi = F.col(doi) if doi in items.columns else F.lit(None).cast("string")
    i = items.withColumn("canonical_url", normalized_url(F.col("url"), F.col("source"))).withColumn("document_key", evidence_key(F.col("url"), F.col("source"), F.col("source_type"), F.col("title"), known_doi))
    i = i.withColumn("said", truncated(composed(F.col("title"), F.col("summary"), F.col("text"))))
    worth = F.when(F.col("source_type").isin("government", "filing"), 20).otherwise(0) + F.length("said")
    own = W.partitionBy("group_id", "document_key")
    i = i.withColumn("first", F.min("ord").over(own)).withColumn("items", F.count(F.lit(1)).over(own)).withColumn("r", F.row_number().over(own.orderBy(F.desc(worth), "ord"))).filter("r = 1")
    i = i.withColumn("turn", F.row_number().over(W.partitionBy("group_id").orderBy("first"))).withColumn("document_type", document_type(F.col("canonical_url"), F.col("source"), F.col("source_type")))
    i = i.withColumn("own_status", structured_status(F.col("said"), F.col("source")))
    look = (F.col("own_status") != "full_text") & (F.col("turn") <= most) & F.col("canonical_url").rlike("^https?://") & (F.col("source") != "github")
    files = "pdf" in pages.columns
    one = F.struct("html", *(["pdf"] if files else []))
    p = pages.withColumn("canonical_url", normalized_url(F.col("url"), F.lit("page"))).groupBy("canonical_url").agg(F.min_by(one, "url").alias("found"))
    i = i.withColumn("looked", look).join(p.select("canonical_url", "found.*"), "canonical_url", "left")
    as_file = F.col("pdf").isNotNull() if files else F.lit(False)
    body = readable(F.col("html"))
    body = F.when(as_file, text_of_pdf(F.when(F.col("looked"), F.col("pdf")))).otherwise(body) if files else body
    i = i.withColumn("page", F.when(F.col("looked") & (as_file | F.col("html").isNotNull()), truncated(body)))
    i = i.withColumn("page_status", F.when(F.col("looked"), F.when(F.col("page").isNull(), "failed").otherwise(page_status(F.col("page")))))
    rank = lambda c: lookup(LADDER, F.col(c), -1)
    better = F.col("looked") & ((rank("page_status") > rank("own_status")) | ((rank("page_status") == rank("own_status")) & (F.length("page") > F.length("said"))))
    i = i.withColumn("status", F.when(better, F.col("page_status")).otherwise(F.col("own_status"))).withColumn("body", F.when(better, F.col("page")).otherwise(F.col("said")))
    method = F.when(better & as_file, "pdf_text").when(better, "readable_html").when(F.col("status") == "metadata_only", "metadata_only").when(F.col("status") == "snippet", "source_snippet").otherwise("source_api_text")
    return i.select(
        "group_id", "document_key", "canonical_url", "document_type", F.col("id").alias("item_id"), F.col("first").alias("ord"), "items", "source", "source_type", "title", "author", "publish_date", F.col("body").alias("text"), "summary",
        "status", method.alias("method"), lookup(CONFIDENCE, F.col("status")).alias("extraction_confidence"), lookup(COVERAGE, F.col("status")).alias("content_coverage"), degradation(F.col("status"), F.col("document_type")).alias("degradation_reason"),
        (F.lit(1) + F.col("looked").cast("int")).alias("attempts"), F.col("looked").alias("deepened"),
    )


def counters(docs: DataFrame) -> DataFrame:
    """Diagnostics of documents by group; those of several rounds add up."""
    return docs.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("items").alias("source_items"), F.count_if("deepened").alias("deepened"), F.count_if(is_degraded(F.col("status"))).alias("degraded"),
        F.count_if(F.col("status") == "metadata_only").alias("metadata_only"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("attempts").alias("attempts"),
    )


def merged(*rounds: DataFrame) -> DataFrame:
    """Counters of several rounds as one."""
    every = rounds[0]
    for r in rounds[1:]:
        every = every.unionByName(r)
    return every.groupBy("group_id").agg(*(F.sum(c).alias(c) for c in every.columns if c != "group_id"))


def to_deepen(chunks: DataFrame, items: DataFrame, done: DataFrame, most: int = 4) -> DataFrame:
    """Raw items to look at again: of degraded chunks of high authority, one a canonical URL, none that was looked at before."""
    wanted = chunks.filter(high_authority(F.col("weight"), F.col("source_type"), F.col("stance")) & is_degraded(F.col("status"))).select("group_id", "canonical_url").distinct()
    left = items.join(wanted, ["group_id", "canonical_url"], "left_semi").join(done.select("group_id", "id"), ["group_id", "id"], "left_anti")
    one = left.withColumn("r", F.row_number().over(W.partitionBy("group_id", "canonical_url").orderBy("ord"))).filter("r = 1")
    return one.withColumn("r", F.row_number().over(W.partitionBy("group_id").orderBy("ord"))).filter(F.col("r") <= most).drop("r")
