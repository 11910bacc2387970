"""Queries over the evidence plan, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry import dims
from quarry.binding import chunks, raw_items
from quarry.operators import assembly, dedup, ranking
from quarry.operators.ranking import GUARD
from quarry.plans import evidence
from quarry.plans.planning import HITS, PLAN
from quarry.plans.scalars import CHUNKS, PRE_STOP, RAW, STOP, terms_sql, tokens_sql

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_PRIMARY = "('government','filing','structured_fact','medical')"
_MATCH = f"len(list_filter(required, lambda r: CASE r WHEN 'primary-document' THEN source_type IN {_PRIMARY} WHEN 'news' THEN NEWS ELSE source_type = r END)) > 0"
_WEIGHTS = (
    f"s(source, sw) AS (VALUES {','.join(f'({chr(39)}{k}{chr(39)}, {v}::DOUBLE)' for k, v in dims.SOURCE_WEIGHTS.items())}), "
    f"t(source_type, tw) AS (VALUES {','.join(f'({chr(39)}{k}{chr(39)}, {v}::DOUBLE)' for k, v in dims.TYPE_WEIGHTS.items())})"
)
#: candidates with the columns of query and chunk
BASE = f"""WITH RECURSIVE {RAW}, {CHUNKS}, {_WEIGHTS},
q AS (SELECT item_id AS query_id, text AS query FROM benchmark), {PLAN}, {HITS},
c AS (SELECT query_id, chunk_id, query, types, required, content, {tokens_sql('content')} AS tokens, raw.source, raw.source_type, url, title, publish_date, raw.ord * 10000 + n AS ord, greatest(coalesce(sw, 0.35), coalesce(tw, 0.35)) AS weight,
  lower(title || '  ' || content) AS hay, epoch_us(TIMESTAMP '2025-01-01') / 8.64e10 - epoch_us(publish_date::TIMESTAMP) / 8.64e10 AS age
  FROM (SELECT DISTINCT query_id, item_id FROM hit) JOIN qi USING (query_id) JOIN chunk USING (item_id) JOIN raw ON raw.id = chunk.item_id LEFT JOIN s ON s.source = raw.source LEFT JOIN t ON t.source_type = raw.source_type),
f AS (SELECT *, CASE WHEN age < 0 THEN 0.8 WHEN age < 30 THEN 1.0 WHEN age < 365 THEN 0.85 WHEN age < 1825 THEN 0.7 ELSE 0.55 END::DOUBLE AS freshness,
  {terms_sql('query', PRE_STOP)} AS pt, list_distinct({terms_sql('query', STOP)}) AS st FROM c)"""

LOCAL = f""", g AS (SELECT *, least(1, greatest(0, (
  CASE WHEN len(pt) = 0 THEN 0 ELSE len(list_filter(pt, lambda x: contains(hay, x))) / greatest(4, least(14, len(pt)))::DOUBLE END * 0.46 + weight * 0.24
  + CASE WHEN greatest(0, age) <= 365 THEN 1.0 WHEN age <= 1095 THEN 0.78 WHEN age <= 2920 THEN 0.6 ELSE 0.45 END::DOUBLE * 0.1
  + least(0.12, len(list_filter(pt, lambda x: contains(lower(title), x))) * 0.03)
  + CASE WHEN len(pt) < 2 THEN 0 ELSE least(0.1, len(list_filter(list_zip(list_slice(pt, 1, len(pt) - 1), list_slice(pt, 2, len(pt))), lambda x: contains(hay, x[1] || ' ' || x[2]))) * 0.035) END
  + CASE WHEN source_type IN ('filing','government','structured_fact') THEN 0.06 ELSE 0 END
  + least(0.12, CASE WHEN list_contains(types, 'fresh-fact') THEN freshness * 0.04 ELSE 0 END + CASE WHEN list_contains(types, 'source-attribution') AND source_type IN ('filing','government') THEN 0.05 ELSE 0 END
    + CASE WHEN list_contains(types, 'academic') AND source_type = 'academic' THEN 0.05 ELSE 0 END + CASE WHEN list_contains(types, 'adversarial') AND source_type IN ('government','filing','medical') THEN 0.04 ELSE 0 END)
  + CASE WHEN {_MATCH.replace("NEWS", "source = 'hacker_news'")} THEN 0.1 ELSE 0 END)
  * CASE WHEN regexp_matches(substr(hay, 1, 500), 'about the author|editorial board|copyright|privacy policy|terms of use') THEN 0.45 ELSE 1 END))::DOUBLE AS local_score FROM f)"""

_BOOST = " + ".join(f"CASE WHEN regexp_matches(lower(query), '{p}') AND regexp_matches(hay, '{c}') THEN {b} ELSE 0 END" for p, c, b in dims.PHRASE_BOOSTS)
SCORED = f""", b AS (SELECT *, least(0.35, {_BOOST}) AS boost FROM f),
rel AS (SELECT *, least(1, greatest(0, CASE WHEN len(st) = 0 THEN boost ELSE least(1, len(list_filter(st, lambda x: contains(hay, x))) / greatest(4, least(12, len(st)))::DOUBLE + boost) END
  * CASE WHEN regexp_matches(substr(hay, 1, 300), '{GUARD["boilerplate"]}') THEN 0.08 ELSE 1 END)) AS rel0 FROM b),
sc AS (SELECT *, least(rel0, CASE WHEN regexp_matches(lower(title), '{GUARD["boilerplate"]}') THEN 0.05 ELSE 1 END,
  CASE WHEN NOT regexp_matches(lower(query), '{GUARD["oil"]}') THEN 1 WHEN regexp_matches(lower(title), '{GUARD["heating"]}') AND NOT regexp_matches(hay, '{GUARD["oil_text"]}') THEN 0.18
    WHEN source_type = 'encyclopedic' AND NOT regexp_matches(lower(title), '{GUARD["oil_title"]}') AND NOT regexp_matches(hay, '{GUARD["oil_signal"]}') THEN 0.16 WHEN source_type = 'encyclopedic' AND NOT regexp_matches(lower(title), '{GUARD["oil_title"]}') THEN 0.24 ELSE 1 END,
  CASE WHEN regexp_matches(lower(query), '{GUARD["retrieval"]}') AND NOT regexp_matches(hay, '{GUARD["retrieval_signal"]}') THEN 0.12 ELSE 1 END,
  CASE WHEN regexp_matches(lower(query), '{GUARD["trading"]}') AND NOT regexp_matches(hay, '{GUARD["trading_signal"]}') THEN 0.16 ELSE 1 END)::DOUBLE AS relevance,
  least(0.92, greatest(0.28, weight)) AS confidence FROM rel),
cb AS (SELECT *, relevance * weight * confidence * greatest(0.4, greatest(0.2, freshness)) AS combined FROM sc)"""


@query("t00_candidates", f"WITH {RAW}, q AS (SELECT item_id AS query_id, text AS query FROM benchmark), {PLAN}, {HITS} SELECT query_id, ix, source, item_id, shared FROM hit")
def t00(spark, d):
    return evidence.of(spark, d).hits


@query("t01_local_score", BASE + LOCAL + " SELECT query_id, chunk_id, round(local_score, 6) AS local_score FROM g")
def t01(spark, d):
    e = evidence.of(spark, d)
    return e.fetched.withColumn("surprise", F.lit(0.0)).select("query_id", "chunk_id", F.round(ranking.local_score(e.conf.now), 6).alias("local_score"))


@query("t03_prerank_groups", BASE + LOCAL + """, k AS (SELECT *, 'url:' || lower(substr(url, 9)) AS dup FROM g)
    SELECT query_id, dup, arg_min(chunk_id, (-round(local_score, 9), ord)) AS best, count(*) AS members FROM k GROUP BY ALL""")
def t03(spark, d):
    e = evidence.of(spark, d)
    scored = e.fetched.withColumn("surprise", F.lit(0.0)).withColumn("local_score", F.round(ranking.local_score(e.conf.now), 9))
    return ranking.one_per_duplicate_key(scored).select("query_id", F.col("dup_key").alias("dup"), F.col("chunk_id").alias("best"), F.col("group_size").alias("members"))


@query("t02_diverse_topk")
def t02(spark, d):
    return evidence.of(spark, d).preranked.select("query_id", "chunk_id", "position", F.round("local_score", 6).alias("local_score"))


@query("t04_fallback_score", BASE + SCORED + " SELECT query_id, chunk_id, round(rel0, 6) AS raw_relevance, round(relevance, 6) AS relevance, round(confidence, 6) AS confidence, round(combined, 6) AS combined FROM cb")
def t04(spark, d):
    e = evidence.of(spark, d)
    s = ranking.score(e.fetched.withColumn("raw_relevance", ranking.fallback_relevance()))
    return s.select("query_id", "chunk_id", *(F.round(c, 6).alias(c) for c in ("raw_relevance", "relevance", "confidence", "combined")))


@query("t06_kept_or_rescued", BASE + SCORED + f""", p AS (SELECT *, combined >= 0.2 AS passed, relevance >= 0.12 AND combined >= 0.04 AS plausible, max((combined >= 0.2)::INT) OVER (PARTITION BY query_id) = 1 AS any_passed FROM cb),
  need AS (SELECT query_id, unnest(required) AS r FROM qi), m AS (SELECT p.*, r FROM p JOIN need USING (query_id) WHERE CASE r WHEN 'primary-document' THEN source_type IN {_PRIMARY} WHEN 'news' THEN false ELSE source_type = r END),
  top AS (SELECT * FROM m WHERE plausible AND NOT passed QUALIFY row_number() OVER (PARTITION BY query_id, r ORDER BY round(combined, 9) DESC, ord) = 1),
  res AS (SELECT p.query_id, p.chunk_id FROM p LEFT JOIN (SELECT DISTINCT query_id, chunk_id, 1 AS reserved FROM top) x USING (query_id, chunk_id) WHERE plausible AND NOT any_passed
    QUALIFY row_number() OVER (PARTITION BY p.query_id ORDER BY reserved DESC NULLS LAST, round(combined, 9) DESC, ord) <= 6)
  SELECT query_id, chunk_id, 'passed' AS how FROM p WHERE passed UNION ALL SELECT query_id, chunk_id, 'rescued' FROM res
  UNION ALL SELECT DISTINCT query_id, chunk_id, 'covered' FROM top WHERE any_passed AND NOT EXISTS (SELECT 1 FROM m WHERE m.query_id = top.query_id AND m.r = top.r AND m.passed)""")
def t06(spark, d):
    e = evidence.of(spark, d)
    return ranking.keep_or_rescue(ranking.score(e.fetched).withColumn("combined", F.col("combined"))).select("query_id", "chunk_id", "how")


@query("p13_extraction_treatment", """SELECT doc_id, status, least(0.9, CASE status WHEN 'structured_abstract' THEN 0.55 WHEN 'snippet' THEN 0.35 WHEN 'metadata_only' THEN 0.15 WHEN 'failed' THEN 0.08 ELSE 1 END)::DOUBLE AS confidence, CASE WHEN status IN ('metadata_only','failed') THEN 0.12 ELSE 0.5 END::DOUBLE AS relevance
    FROM (SELECT doc_id, (['full_text','structured_abstract','snippet','metadata_only','failed'])[doc_id % 5 + 1] AS status FROM documents)""")
def p13(spark, d):
    status = F.element_at(dims.strings(["full_text", "structured_abstract", "snippet", "metadata_only", "failed"]), (F.col("doc_id") % 5 + 1).cast("int"))
    r = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", status.alias("status"), F.lit(0.9).alias("confidence"), F.lit(0.5).alias("relevance"), F.lit("c").alias("claim"), F.lit("opinion").alias("stance"))
    return ranking.treat_extraction(r).select("doc_id", "status", F.col("confidence").cast("double"), F.col("relevance").cast("double"))


@query("a05_document_components", f"""WITH RECURSIVE {RAW}, {CHUNKS} SELECT chunk_id, min(chunk_id) OVER (PARTITION BY item_id) AS cluster FROM chunk""")
def a05(spark, d):
    c = chunks(raw_items(spark, d), dims.NOW).select(F.lit(0).alias("query_id"), "chunk_id", "item_id")
    w = W.partitionBy("item_id").orderBy("chunk_id")
    chain = c.withColumn("b", F.lag("chunk_id").over(w)).filter("b IS NOT NULL").select("query_id", F.col("chunk_id").alias("a"), "b")
    return dedup.components(c.select("query_id", "chunk_id"), chain).select("chunk_id", "cluster")


@query("a06_a09_clusters")
def a06(spark, d):
    c = evidence.of(spark, d).clusters
    return c.select("query_id", "cluster", "representative", "size", "level", F.round("novelty", 6).alias("novelty"))


@query("t09_assembly")
def t09(spark, d):
    return evidence.of(spark, d).selection.select("query_id", "chunk_id", "decision", "position", F.round("gain", 6).alias("gain"), "reason")


@query("t11_final_gains")
def t11(spark, d):
    e = evidence.of(spark, d)
    return assembly.final_gains(e.unique, e.selection)


@query("a11_health")
def a11(spark, d):
    return evidence.of(spark, d).health


@query("a13_gaps")
def a13(spark, d):
    g = evidence.of(spark, d).gaps
    joined = [F.array_join(c, "|").alias(c) for c in ("missing", "hard_gaps", "soft_gaps", "missing_facets", "low_ids", "keyword_only_ids", "failed_sources", "reasons")]
    return g.select("query_id", *joined, "critical", "action", "stop_reason", F.size("plan").alias("repairs"))


@query("c01_repair_rounds")
def c01(spark, d):
    e = evidence.of(spark, d)
    return evidence.rounds(evidence.run(e.asked, e.items))


@query("f18_answers")
def f18(spark, d):
    return evidence.answers(evidence.of(spark, d)).withColumn("citations", F.array_join("citations", ","))


@query("flagship_evidence")
def flagship(spark, d):
    e = evidence.of(spark, d)
    s = evidence.final(evidence.run(e.asked, e.items), "selected")
    return s.select("query_id", "chunk_id", "source", "source_type", "tokens", F.round("relevance", 6).alias("relevance"), F.round("gain", 6).alias("gain"))
