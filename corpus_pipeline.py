"""A corpus through five stages: quality, near copies, secrets, mixing, packing.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns that they got, whatever else there
is besides ``doc_id``, ``text`` and ``source``; ``n_chars`` follows the text if it is there.

Defined results: a null or empty text fails the quality rules; a null doc_id is a document like others, and of a group
the least doc_id that is not null stays; of rows with equal doc_id, and of repeated rows, the first in the input files; a
null source is mixed as a source, the last one; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import mixing, ngram_join, packing, quality, secret_scan
from quarry.llm._spark import collected, drop, materialize, numbered
from quarry.llm._tokens import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only documents that pass the base rules and the compression bands stay."""
    prefix = "_quality_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    return quality.assess(docs, tuple(docs.columns), prefix=prefix).filter(f"{prefix}kept").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of near copies the document of the least id stays, of several the first in the input files."""
    rows = numbered(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    place = F.struct(F.col("row")["doc_id"].isNull().alias("none"), F.col("row")["doc_id"].alias("id"), "file", "index")
    found = ngram_join.jaccard_components(rows.select(place.alias("place"), F.col("row")["text"].alias("text")), key="place")
    first = materialize(found.filter("place = component_id").select("place.file", "place.index"))
    # those that stay grow with the corpus, so they are merged at every size, never broadcast
    return rows.join(first.hint("merge"), ["file", "index"], "left_semi").select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is masked; ``n_chars`` follows the text."""
    masked = secret_scan.redact(secret_scan.scan(docs, tuple(docs.columns)))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    mixed = mixing.mix(docs, tuple(docs.columns)).filter("copies > 0")
    return mixed.select("_carry", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_carry.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs, vocabulary())


STAGES = [("quality_rules", quality_rules), ("ngram_join", near_copies), ("secret_scan", secrets), ("mixing", mix_sources), ("packing", pack)]

#: SQL can express neither compression nor tokenization; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage writes besides its result goes as soon as that is written, and its input after it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        now: list[str] = []
        with collected() as made:
            docs = materialize(stage(spark, docs, sf_dir), now)
        drop(spark, [*made, *before])
        before = now
    return STAGES[-1][1](spark, docs, sf_dir)
