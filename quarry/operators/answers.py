"""Answers from selected chunks by rule: ranking, sentences with citations, checks of a model's answer, cautious reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.dims import lookup
from quarry.functions.text import token_estimate

_WS = r"[ \t\n\r\f\x0B]"
#: Fixed value: what a stance says of where a claim comes from.
PROVENANCE = {"primary_source": "primary", "secondary_analysis": "secondary", "tertiary_summary": "tertiary", "opinion": "forum/opinion"}
COMPARATIVE = r"(?i)\b(trade-?offs?|compare|comparison|versus|vs\.?|between|which)\b"
FUSION = r"(?i)\b(rrf|reciprocal rank fusion|rank fusion|hybrid retrieval|fusion retrieval|bm25|dense|sparse)\b"
RERANKER = r"(?i)\b(cross[- ]?encoder|rerank|reranker|learned rerank|cross-attention|top-k|top k)\b"
SYSTEMS = r"(?i)\b(open[- ]?source|github|implementation|framework|rag|trec|benchmark|system)\b"


def provenance(stance: Column) -> Column:
    return lookup(PROVENANCE, stance, "unknown")


def answer_score() -> Column:
    return F.col("relevance") * 0.55 + F.col("confidence") * 0.3 + F.col("weight") * 0.15


def sentence(text: Column) -> Column:
    """A claim on one line without a closing citation or closing marks."""
    one = F.trim(F.regexp_replace(text, _WS + "+", " "))
    bare = F.regexp_replace(one, rf"{_WS}*\[[^\]]+\]{_WS}*$", "")
    return F.when(bare == "", F.lit("The evidence kept is relevant to the query")).otherwise(F.regexp_replace(bare, r"[.!?]+$", ""))


def short_title(title: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(title, _WS + "+", " ")), rf"[:.]{_WS}*$", "")


def searchable(title: Column, summary: Column, claims: Column, content: Column) -> Column:
    """The text of a chunk that signals are looked for in."""
    present = lambda c: F.when(c != "", c)
    return F.concat_ws(" ", present(title), present(summary), F.array_join(claims, " "), present(content))


def cited_ids(answer: Column, ids: Column) -> Column:
    """The chunk ids that an answer cites in square brackets, each once, in order."""
    return F.array_distinct(F.filter(F.regexp_extract_all(answer, F.lit(r"\[([^\]]+)\]"), F.lit(1)), lambda i: F.array_contains(ids, i)))


def misshapen(answer: Column) -> Column:
    """Whether an answer is an inventory of chunks: it says so, or two of its first four lines are numbered."""
    lines = F.slice(F.split(F.trim(answer), r"\n+"), 1, 4)
    return F.trim(answer).rlike(r"(?i)^synthesized from\b") | (F.size(F.filter(lines, lambda x: x.rlike(rf"^{_WS}*[0-9]+\.{_WS}+"))) >= 2)


def ranked(chunks: DataFrame) -> DataFrame:
    """Chunks with ``answer_rank``, and ``best_rank`` by relevance times confidence; ties by id."""
    order = lambda c: W.partitionBy("query_id").orderBy(F.desc(F.round(c, 12)), "chunk_id")
    return chunks.withColumn("answer_rank", F.row_number().over(order(answer_score()))).withColumn("best_rank", F.row_number().over(order(F.col("relevance") * F.col("confidence"))))


def general_answer(chunks: DataFrame, most: int = 4) -> DataFrame:
    """(query_id, answer, citations): a sentence each of a query's best chunks, with a caveat where one is thin."""
    b = ranked(chunks).filter(F.col("best_rank") <= most)
    claim = F.coalesce("claim", "summary", F.substring("content", 1, 260)) if "summary" in chunks.columns else F.coalesce("claim", F.substring("content", 1, 260))
    said = F.concat(sentence(claim), F.lit(" ["), "chunk_id", F.lit("]."))
    g = b.groupBy("query_id", "query").agg(F.array_sort(F.collect_list(F.struct("best_rank", said.alias("said"), "chunk_id"))).alias("b"), F.max(F.col("confidence") < 0.4).alias("thin"))
    lines = F.transform("b", lambda x: x["said"])
    caveat = F.when(F.col("thin"), F.lit("The evidence found is thin in places, so what goes beyond the chunks cited is unresolved."))
    answer = F.concat(F.lit('The selected evidence supports this answer to "'), "query", F.lit('": '), F.concat_ws(" ", F.array_join(lines, " "), caveat))
    return g.select("query_id", answer.alias("answer"), F.transform("b", lambda x: x["chunk_id"]).alias("citations"))


def comparative_parts(chunks: DataFrame) -> DataFrame:
    """For comparative questions: the chunks that speak for either side and of systems, first each, by answer score."""
    text = searchable(F.col("title"), F.lit(None).cast("string"), F.array(F.coalesce("claim", F.lit(""))), F.col("content"))
    r = ranked(chunks).withColumn("said", text)
    pick = lambda pattern, k: F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("said").rlike(pattern), F.struct("answer_rank", "chunk_id")))), lambda x: x["chunk_id"]), 1, k)
    p = r.groupBy("query_id").agg(pick(FUSION, 2).alias("fusion"), pick(RERANKER, 3).alias("reranker"), pick(SYSTEMS, 3).alias("systems"), F.min_by("chunk_id", "answer_rank").alias("top"), F.max(F.col("source_type") == "code").alias("has_code"))
    first = F.coalesce(F.get("fusion", F.lit(0)), F.col("top"))
    other = F.coalesce(F.get(F.filter("reranker", lambda x: x != first), F.lit(0)), F.get("reranker", F.lit(0)))
    support = F.array_distinct(F.array_compact(F.concat(F.array(first, other), "fusion", "reranker", "systems")))
    return p.select("query_id", first.alias("fusion_chunk"), other.alias("reranker_chunk"), "systems", "has_code", support.alias("support"), (F.size(support) < 3).alias("narrow"))


def inventory_answer(chunks: DataFrame, most: int = 6) -> DataFrame:
    """(query_id, answer): numbered claims of a query's chunks by relevance, with their ids."""
    r = chunks.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("relevance"), "chunk_id"))).filter(F.col("r") <= most)
    line = F.concat(F.col("r").cast("string"), F.lit(". "), sentence(F.coalesce("claim", F.substring("content", 1, 260))), F.lit(" ["), "chunk_id", F.lit("]"))
    return r.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("l")))), lambda x: x["l"]), "\n").alias("answer"))


def review(drafts: DataFrame) -> DataFrame:
    """A cautious review by rule of drafts (query_id, query, draft, status, reasons, claims, chunk_ids)."""
    coverage = F.when(F.col("status") == "insufficient", "insufficient_evidence").when(F.col("status") == "weak", "partially_answered").otherwise("answered")
    limited = F.lit("Evidence is limited, so this answer separates what was found from general reasoning.\n\n")
    return drafts.select(
        "query_id", F.concat(F.when(coverage == "answered", "").otherwise(limited), "draft").alias("final_answer"), coverage.alias("coverage_status"), F.array("query").alias("addressed_questions"), F.col("reasons").alias("remaining_gaps"),
        F.slice("claims", 1, 10).alias("source_backed_claims"), F.col("chunk_ids").alias("cited_chunk_ids"), token_estimate(F.col("draft")).alias("token_count"),
    )


def coerced_review(raw: Column, draft: Column) -> Column:
    """The final answer of a reviewer's JSON object; the draft if it has none; null if it is no object."""
    object_ = F.trim(raw).rlike(r"(?s)^\{.*\}$") & F.try_parse_json(raw).isNotNull()
    final = F.get_json_object(raw, "$.final_answer")
    return F.when(object_, F.coalesce(F.when(F.trim(final) != "", final), draft))
