"""File scans and sinks: JSON artifacts, run logs, feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.pdf import text_of_pdf

GOLD = "questions array<struct<id:string,question:string,atomic_facts:array<struct<id:string,text:string,keywords:array<string>,weight:double>>,required_sources:array<struct<id:string,type:string,description:string,weight:double>>,penalize_if:array<string>>>, _corrupt_record string"


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a gold artifact; a file that does not parse gives one row with ``error``."""
    raw = spark.read.schema(GOLD).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    q = raw.select(F.explode_outer("questions").alias("q"), F.col("_corrupt_record").isNotNull().alias("error"))
    return q.select("q.*", "error")


def write_runs(runs: DataFrame, path: str, longest: int = 2500) -> None:
    """Run records as JSON by day: no vectors, texts cut to ``longest`` characters."""
    kept = [F.substring(c, 1, longest).alias(c) if t == "string" else F.col(c) for c, t in runs.dtypes if not t.startswith("array<double")]
    runs.select(*kept, F.current_date().alias("day")).write.mode("append").partitionBy("day").json(path)


def latest_runs(runs: DataFrame, n: int, order: str = "finished") -> DataFrame:
    """Of the newest n runs, those that are ok: the limit comes before the filter."""
    return runs.orderBy(F.desc(order)).limit(n).filter("ok")


def with_feedback(runs: DataFrame, feedback: DataFrame) -> DataFrame:
    """Runs with their newest feedback; feedback is appended, never updated in place."""
    last = feedback.groupBy("run_id").agg(F.max_by("vote", "updated_at").alias("vote"), F.max_by(F.substring("note", 1, 2000), "updated_at").alias("note"))
    return runs.join(last, "run_id", "left")


def parse_gold_markdown(lines: DataFrame, line: str = "value", order: str = "n") -> DataFrame:
    """Facts and sources of a gold draft: ``# question`` opens a question, ``## section`` a section, ``- a | b | w`` a record."""
    w = W.partitionBy("file").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    c = F.col(line)
    at = lines.withColumn("question", F.last(F.when(c.rlike("^# "), F.substring(c, F.lit(3), F.length(c))), ignorenulls=True).over(w)).withColumn("section", F.last(F.when(c.rlike("^## "), F.lower(F.substring(c, F.lit(4), F.length(c)))), ignorenulls=True).over(w))
    p = F.split(F.regexp_replace(c, r"^-\s*", ""), r"\s*\|\s*")
    return at.filter(c.rlike(r"^-\s")).select("question", "section", F.get(p, F.lit(0)).alias("id"), F.get(p, F.lit(1)).alias("text"), F.coalesce(F.expr(f"try_cast(get(split(regexp_replace({line}, '^-\\\\s*', ''), '\\\\s*\\\\|\\\\s*'), 2) AS DOUBLE)"), F.lit(1.0)).alias("weight"))


def to_gold_markdown(facts: DataFrame) -> DataFrame:
    """One text a question, which ``parse_gold_markdown`` reads back."""
    line = F.concat(F.lit("- "), F.concat_ws(" | ", "id", "text", F.col("weight").cast("string")))
    s = facts.groupBy("question", "section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    t = s.groupBy("question").agg(F.sort_array(F.collect_list(F.struct("section", "body"))).alias("parts"))
    return t.select("question", F.concat(F.lit("# "), "question", F.lit("\n"), F.array_join(F.transform("parts", lambda x: F.concat(F.lit("## "), x["section"], F.lit("\n"), x["body"])), "\n")).alias("markdown"))


def recorded(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded responses of a folder in any file system that Spark reads: (task, ok, payload, error), one row a file.

    A file that is no UTF-8 text is a failure row; nothing raises.
    """
    raw = spark.read.format("binaryFile").load(folder).select(F.substring_index("path", "/", -1).alias("task"), "content")
    good = F.expr("is_valid_utf8(cast(content AS STRING))")
    return raw.select("task", good.alias("ok"), F.when(good, F.col("content").cast("string")).alias("payload"), F.when(~good, "DECODE_FAILED").alias("error"))


def read_runs(spark: SparkSession, path: str, schema: str, day: str | None = None, run_id: str | None = None) -> DataFrame:
    """Run records written by ``write_runs``; a day prunes folders, an id picks one run."""
    r = spark.read.schema(f"{schema}, day date").json(path)
    r = r if day is None else r.filter(F.col("day") == F.lit(day).cast("date"))
    return r if run_id is None else r.filter(F.col("run_id") == run_id)


def read_gold_csv(spark: SparkSession, path: str) -> DataFrame:
    """Records (question, section, id, text, keywords, weight) of a gold draft as CSV with a header; keywords by semicolons."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema("question string, section string, id string, text string, keywords string, weight string").csv(path)
    words = F.filter(F.transform(F.split(F.coalesce("keywords", F.lit("")), ";"), lambda k: F.trim(k)), lambda k: k != "")
    return raw.select("question", F.lower("section").alias("section"), "id", "text", words.alias("keywords"), F.coalesce(F.expr("try_cast(weight AS DOUBLE)"), F.lit(1.0)).alias("weight"))


def gold_of_records(records: DataFrame) -> DataFrame:
    """Gold answers (question_id, valid, facts, required, penalties) of records; a question without facts is not valid."""
    part = lambda name, value: F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == name, F.struct("id", value.alias("v"))))), lambda x: x["v"])
    words = F.col("keywords") if "keywords" in records.columns else F.array().cast("array<string>")
    g = records.groupBy(F.col("question").alias("question_id")).agg(part("facts", F.struct("text", words.alias("keywords"))).alias("facts"), part("sources", F.col("text")).alias("required"), part("penalties", F.col("text")).alias("penalties"))
    return g.select("question_id", (F.size("facts") > 0).alias("valid"), "facts", "required", "penalties")


def pdf_pages(spark: SparkSession, folder: str) -> DataFrame:
    """PDF files of a folder as pages (url, html, pdf), which ``extraction.documents`` takes; ``html`` is null."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(folder)
    return raw.select(F.col("path").alias("url"), F.lit(None).cast("string").alias("html"), F.col("content").alias("pdf"))


def read_pdf(spark: SparkSession, folder: str) -> DataFrame:
    """(file, ok, text, error) of the PDF files of a folder; one that cannot be read is a failure row."""
    t = pdf_pages(spark, folder).select(F.substring_index("url", "/", -1).alias("file"), text_of_pdf("pdf").alias("text"))
    return t.select("file", F.col("text").isNotNull().alias("ok"), "text", F.when(F.col("text").isNull(), "PDF_UNREADABLE").alias("error"))
