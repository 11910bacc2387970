"""Queries over what outlives a job: cached scores, a store fed by a stream, recorded responses as a data source."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry import dims
from quarry.binding import table
from quarry.operators import ranking, stores, traces
from quarry.plans import evidence
from quarry.plans.engine import BASE, SCORED
from quarry.plans.operations import S01, _answered
from quarry.shared import checkpointed, scratch_root
from quarry.sources import curated
from quarry.streaming import events

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _place(spark) -> str:
    return f"{scratch_root(spark)}/{uuid.uuid4().hex}"


@query("c06_cached_scoring", BASE + SCORED + """ SELECT query_id, CASE WHEN query_id % 2 = 0 THEN count(*) ELSE 0 END AS hits, CASE WHEN query_id % 2 = 0 THEN 0 ELSE count(*) END AS misses,
    CASE WHEN query_id % 2 = 0 THEN 0 ELSE ceil(count(*) / 8)::BIGINT END AS batches, round(min(relevance), 6) AS low, round(max(relevance), 6) AS high FROM cb GROUP BY 1""")
def cached_scoring(spark, d):
    """Chunks of every second query are scored, then those of all; the second time scores what the cache lacks, in batches of eight."""
    cache = stores.Table(spark, _place(spark), stores.CACHE)
    keyed = checkpointed(evidence.of(spark, d).fetched.withColumn("status", F.lit(None).cast("string")).withColumn("key", stores.score_key(F.sha2(F.concat_ws(":", "query_id", "query"), 256))))
    for rows in (keyed.filter("query_id % 2 = 0"), keyed):
        scored = checkpointed(stores.cached_scores(rows, cache.read(), ranking.rate))
        cache.update(lambda held: stores.cache_used(held, scored, 1 << 20))  # noqa: B023
    found = (F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.max("turn").alias("batches"))
    return scored.groupBy("query_id").agg(*found, F.round(F.min("relevance"), 6).alias("low"), F.round(F.max("relevance"), 6).alias("high"))


@query("k03_store_from_stream", f"""WITH o AS (SELECT event_type AS source, (user_id % 3)::VARCHAR AS domain, event_id, (['confirmed','contradicted','repeated','observed'])[event_id % 4 + 1] AS kind, (['filing','forum','academic'])[event_id % 3 + 1] AS source_type FROM events),
    g AS (SELECT source, domain, arg_min(source_type, event_id) AS st, sum(CASE kind WHEN 'confirmed' THEN 1 WHEN 'repeated' THEN 0.2 WHEN 'observed' THEN 0.05 ELSE 0 END)::DOUBLE AS up, sum(CASE kind WHEN 'contradicted' THEN 1 WHEN 'repeated' THEN 0.1 WHEN 'observed' THEN 0.05 ELSE 0 END)::DOUBLE AS down, count(*) AS n FROM o GROUP BY ALL),
    w(st, prior) AS (VALUES ('filing', 0.95::DOUBLE), ('forum', {dims.TYPE_WEIGHTS['forum']}::DOUBLE), ('academic', {dims.TYPE_WEIGHTS['academic']}::DOUBLE))
    SELECT source, domain, round(6 * prior + up, 6) AS alpha, round(6 * (1 - prior) + down, 6) AS beta, n AS observations FROM g JOIN w USING (st)""")
def store_from_stream(spark, d):
    """The event stream as observations, added to a versioned store batch by batch."""
    raw = spark.readStream.schema(events.SCHEMA).option("pathGlobFilter", "events.parquet").parquet(d)
    kind = F.element_at(dims.strings(["confirmed", "contradicted", "repeated", "observed"]), (F.col("event_id") % 4 + 1).cast("int"))
    kinds = F.element_at(dims.strings(["filing", "forum", "academic"]), (F.col("event_id") % 3 + 1).cast("int"))
    observed = raw.select(F.col("event_type").alias("source"), (F.col("user_id") % 3).cast("string").alias("domain"), kinds.alias("source_type"), kind.alias("kind"), F.col("event_id").alias("ord"))
    place = _place(spark)
    store = stores.Table(spark, f"{place}/store", stores.INCREMENTS)
    stores.feed(observed, store, "events", f"{place}/state")
    return stores.reliability_of(store.read()).select("source", "domain", F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta"), "observations")


@query("c11_stage_counts", BASE + """ SELECT 'hits:0' AS stage, (SELECT count(*) FROM hit) AS n, NULL::BIGINT AS tokens UNION ALL SELECT 'fetched:0', count(*), sum(tokens)::BIGINT FROM c""")
def stage_counts(spark, d):
    """Rows and tokens of stages, as observed while they ran."""
    e = evidence.of(spark, d)
    e.trace = traces.Trace(spark, "run")
    e.fetched  # noqa: B018
    seen = e.trace.stages().filter("stage IN ('hits:0', 'fetched:0')")
    return seen.select("stage", F.col("counts")["rows"].alias("n"), F.col("counts")["tokens"].alias("tokens"))


@query("s01_data_source", S01)
def data_source(spark, d):
    """Recorded responses written as a folder and read by the data source, then joined to their tasks."""
    from quarry.sources import connectors, recorded

    tasks, responses = _answered(spark, d)
    folder = _place(spark)
    recorded.record(responses, folder)
    return connectors.routed(tasks, recorded.read_recorded(spark, folder))[1].drop("ix")


_LONG = "'long text ' || page_id || repeat(' and more', 9)"
_WEB = "regexp_matches(url, '(?i)^https?://')"


@query("s28_provider_answers", f"""SELECT page_id, (['openai','claude','gemini'])[page_id % 3 + 1] AS engine, CASE page_id % 5 WHEN 3 THEN 'missing' WHEN 4 THEN 'malformed' ELSE 'live' END AS mode,
    CASE WHEN page_id % 5 > 2 THEN '' WHEN page_id % 3 = 0 THEN {_LONG} WHEN page_id % 3 = 1 THEN 'part a' || chr(10) || chr(10) || 'part b' ELSE 'one' || chr(10) || chr(10) || 'two' END AS answer,
    CASE WHEN page_id % 5 > 2 THEN '' ELSE CASE WHEN {_WEB} THEN url || '=T,' ELSE '' END || 'https://x.example.org/' || page_id || '=https://x.example.org/' || page_id END AS sources FROM pages""")
def provider_answers(spark, d):
    """Payloads of three services over the pages' addresses, walked as JSON."""
    none, page = F.lit(None).cast("string"), F.col("page_id").cast("string")
    more = F.concat(F.lit("https://x.example.org/"), page)

    def part(text=none, kind=none, **links):
        at = {n: links.get(n, none) for n in ("url", "uri", "title", "name")}
        return F.struct(text.alias("text"), kind.alias("type"), F.when(F.lit(bool(links)), F.array(F.struct(*(c.alias(n) for n, c in at.items())))).alias("links"))

    long = F.concat(F.lit("long text "), page, F.repeat(F.lit(" and more"), 9))
    seen, other, again = dict(url=F.col("url"), title=F.lit("T")), dict(uri=more), dict(uri=F.col("url"), name=F.lit("again"))
    openai = F.to_json(F.struct(F.array(F.struct(F.array(part(long, **seen), part(F.lit("short"), **again), part(long, **other)).alias("content"))).alias("output")))
    claude = F.to_json(F.struct(F.array(part(F.lit("part a"), F.lit("text"), **seen), part(F.lit("unseen"), F.lit("tool"), **again), part(F.lit("part b"), F.lit("text"), **other)).alias("content")))
    gemini = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(part(F.lit("one"), **seen), part(F.lit("two"), **other)).alias("parts")).alias("content"))).alias("candidates")))
    which = F.col("page_id") % 3
    body = F.when(which == 0, openai).when(which == 1, claude).otherwise(gemini)
    payload = F.when(F.col("page_id") % 5 == 3, none).when(F.col("page_id") % 5 == 4, F.concat(F.lit("{"), body)).otherwise(body)
    engine = F.element_at(dims.strings(["openai", "claude", "gemini"]), (which + 1).cast("int"))
    rows = curated.provider_answers(table(spark, d, "pages").select(engine.alias("engine"), F.col("page_id").alias("question_id"), payload.alias("payload")))
    return rows.select(F.col("question_id").alias("page_id"), "engine", "mode", "answer", F.array_join(F.transform("sources", lambda x: F.concat(x["url"], F.lit("="), x["title"])), ",").alias("sources"))
