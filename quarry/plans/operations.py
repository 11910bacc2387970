"""Queries over model calls, routing, events, traces and records of runs, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import dims
from quarry.binding import table
from quarry.operators import health, models, traces
from quarry.plans import evidence
from quarry.plans.planning import _asked
from quarry.sources import files
from quarry.streaming import events

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_FAST = {"default": "small", "scoring": "scorer", "synthesis": "large", "adjudicator": "largest"}
_EVEN = {"default": "tiny", "synthesis": "large"}


def _models(table_: dict) -> str:
    return " ".join(f"WHEN '{s}' THEN '{m}'" for s, m in models.stage_models(table_).items())


@query("c09_model_routes", f"""WITH r AS (SELECT event_id, (['fast','balanced','quality'])[event_id % 3 + 1] AS mode, (['default','intent','strategy','scoring','synthesis','adjudicator'])[event_id % 6 + 1] AS stage, event_id % 5 = 0 AS forced, event_id % 7 = 0 AS own FROM events),
    b AS (SELECT *, CASE WHEN own AND stage = 'scoring' THEN 'mine' WHEN mode = 'balanced' THEN CASE stage {_models(_EVEN)} END ELSE CASE stage {_models(_FAST)} END END AS base,
      CASE WHEN stage IN ('synthesis','adjudicator') THEN NULL WHEN mode = 'quality' AND stage IN ('strategy','scoring') THEN 'quality_mode_requested' WHEN forced THEN 'explicit_stage_escalation' END AS reason FROM r)
    SELECT event_id AS request_id, stage, CASE WHEN reason IS NOT NULL THEN 'largest' ELSE base END AS model, reason IS NOT NULL AND base <> 'largest' AS escalated, CASE WHEN reason IS NOT NULL AND base <> 'largest' THEN base END AS from_model, reason FROM b""")
def c09(spark, d):
    i = F.col("event_id")
    r = table(spark, d, "events").select(
        i.alias("request_id"), F.element_at(dims.strings(["fast", "balanced", "quality"]), (i % 3 + 1).cast("int")).alias("mode"), F.element_at(dims.strings(models.STAGES), (i % 6 + 1).cast("int")).alias("stage"), (i % 5 == 0).alias("forced"),
        F.when(i % 7 == 0, F.create_map(F.lit("scoring"), F.lit("mine"))).otherwise(F.create_map().cast("map<string,string>")).alias("overrides"),
    )
    return models.route(r, _FAST, _EVEN)


@query("z03_stage_models", "SELECT * FROM (VALUES ('default','small'),('intent','small'),('strategy','other'),('scoring','scorer'),('synthesis','large'),('adjudicator','largest')) t(stage, model)")
def z03(spark, d):
    return spark.createDataFrame(list(models.stage_models(_FAST, {"strategy": "other"}).items()), "stage string, model string")


def _stubborn(asked: dict) -> str:
    """A provider that answers by the prompt's kind: well, in fences, after one mistake, or never."""
    kind = int(asked["prompt"].rsplit(" ", 1)[1]) % 4
    if kind == 3:
        raise TimeoutError
    if kind == 2 and "error" not in asked:
        return '{"other": 1}'
    return '```json\n{"answer": "x", "cited_chunk_ids": ["a"]}\n```' if kind == 1 else '{"final_answer": "x", "cited_chunk_ids": ["a"]}'


@query("c08_model_calls", "SELECT doc_id AS key, CASE WHEN doc_id % 4 < 2 THEN 1 ELSE 2 END AS attempts, doc_id % 4 < 3 AS ok, CASE WHEN doc_id % 4 = 3 THEN 'TimeoutError' END AS error, CASE WHEN doc_id % 4 < 3 THEN 'x' END AS answer FROM documents")
def c08(spark, d):
    prompts = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.lit("synthesis").alias("task"), F.concat(F.lit("question "), F.col("doc_id").cast("string")).alias("prompt"))
    return models.call(prompts, _stubborn, models.SCHEMAS["synthesis"]).select("key", "attempts", "ok", "error", F.col("output.final_answer").alias("answer"))


@query("z14_answers_with_fallback", "SELECT doc_id AS query_id, CASE WHEN doc_id % 4 = 3 THEN text ELSE 'x' END AS answer, CASE WHEN doc_id % 4 = 3 THEN 'rule' ELSE 'model' END AS by FROM documents")
def z14(spark, d):
    drafts = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.concat(F.lit("question "), F.col("doc_id").cast("string")).alias("prompt"), F.col("text").alias("fallback"))
    return models.answers_with_fallback(drafts, _stubborn)


@query("z05_model_by_rule", "SELECT doc_id AS key, 0.82::DOUBLE AS relevance, 0.78::DOUBLE AS confidence, 0.75::DOUBLE AS freshness, 0.55::DOUBLE AS surprise FROM documents")
def z05(spark, d):
    prompts = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.lit("scoring").alias("task"), F.col("text").alias("prompt"))
    s = models.call(prompts, models.rule_provider, models.SCHEMAS["scoring"]).select("key", F.get("output.scores", F.lit(0)).alias("s"))
    return s.select("key", "s.relevance", "s.confidence", "s.freshness", "s.surprise")


@query("z19_prompts", "SELECT item_id, 'Today is 2025-01-01.' || chr(10) || 'State the intent of the question as JSON with the fields of the contract.' || chr(10) || 'Question: ' || text AS prompt FROM benchmark")
def z19(spark, d):
    return table(spark, d, "benchmark").select("item_id", models.intent_prompt(F.col("text"), F.lit(""), "2025-01-01").alias("prompt"))


@query("z04_stage_events", """WITH s AS (SELECT event_id, event_type AS stage, ts AS started, (value * 1000)::BIGINT AS ms FROM events) SELECT event_id AS run_id, stage, 0 AS n, 'stage_start' AS type, started AS at, 'begun: ' || stage AS message FROM s
    UNION ALL SELECT event_id, stage, 1, 'counts', started + to_microseconds(ms * 1000), 'a=1, b=' || event_id FROM s UNION ALL SELECT event_id, stage, 2, 'stage_complete', started + to_microseconds(ms * 1000), 'done: ' || stage FROM s""")
def z04(spark, d):
    s = table(spark, d, "events").select(F.col("event_id").alias("run_id"), F.col("event_type").alias("stage"), F.col("ts").cast("timestamp").alias("started"), F.create_map(F.lit("b"), F.col("event_id"), F.lit("a"), F.lit(1).cast("long")).alias("counts"), F.expr("CAST(round(value * 1000) AS BIGINT)").alias("ms"))
    return traces.stage_events(s).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("z22_stage_errors", "SELECT event_id, 'fetch' AS stage, 'HTTP_' || (400 + event_id % 4) AS code, event_id % 4 = 3 AS retryable, event_type AS source FROM events WHERE event_type = 'error'")
def z22(spark, d):
    i = F.col("event_id")
    e = table(spark, d, "events").filter("event_type = 'error'").select("event_id", traces.stage_error(F.lit("fetch"), F.concat(F.lit("HTTP_"), (i % 4 + 400).cast("string")), F.lit("m"), i % 4 == 3, F.create_map(F.lit("source"), "event_type")).alias("e"))
    return e.select("event_id", "e.stage", "e.code", "e.retryable", F.col("e.details")["source"].alias("source"))


@query("k05_event_frames", """SELECT event_id, 'event: ' || event_type || chr(10) || 'data: {"event_id":' || event_id || ',"user_id":' || user_id || '}' || chr(10) || chr(10) AS frame FROM events""")
def k05(spark, d):
    return events.frames(table(spark, d, "events").select("event_id", "user_id", "event_type"))


@query("c13_heartbeats", """WITH g AS (SELECT user_id, event_id, epoch_us(ts) AS us, (lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - epoch_us(ts)) / 3600000000.0 AS silent FROM events),
    b AS (SELECT user_id, event_id, us, unnest(range(1, ceil(silent)::BIGINT)) AS beat FROM g WHERE silent > 1) SELECT user_id, event_id, beat::INT AS beat, make_timestamp(us + beat * 3600000000) AS at FROM b""")
def c13_beats(spark, d):
    return events.heartbeats(table(spark, d, "events"), 3600).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("c03_cautious_stop", "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'synthesize_cautiously' ELSE 'retry_retrieval' END AS action, CASE WHEN item_id % 3 = 0 THEN 'a;out of time' ELSE 'a' END AS reasons, item_id % 2 = 0 AND (item_id % 4 = 0 OR item_id % 5 > 1) AS enough FROM benchmark")
def c03(spark, d):
    i = F.col("item_id")
    g = table(spark, d, "benchmark").select("item_id", F.lit("retry_retrieval").alias("action"), F.array(F.lit("a")).alias("reasons"), F.when(i % 2 == 0, "balanced").otherwise("fast").alias("mode"), F.when(i % 4 == 0, "strong").otherwise("adequate").alias("status"), F.lit(70).alias("quality"), (i % 5 > 1).alias("soft"))
    out = traces.cautious(g, i % 3 == 0, "out of time")
    return out.select("item_id", "action", F.array_join("reasons", ";").alias("reasons"), traces.enough(F.col("mode"), F.col("status"), F.col("quality"), F.col("soft")).alias("enough"))


@query("z15_comparison_payloads", """SELECT item_id AS file, 'e' || (item_id % 3) AS engine, 'Q1' AS question_id, 'scoring_unavailable' AS score_status FROM benchmark WHERE item_id % 5 < 4 UNION ALL SELECT item_id, NULL, NULL, 'scoring_unavailable' FROM benchmark WHERE item_id % 5 = 4""")
def z15(spark, d):
    i = F.col("item_id")
    one = F.to_json(F.struct(F.concat(F.lit("e"), (i % 3).cast("string")).alias("engine_name"), F.lit("Q1").alias("questionId"), F.lit("a").alias("final_answer")))
    value = F.when(i % 5 == 0, F.concat(F.lit("["), one, F.lit("]"))).when(i % 5 == 1, F.concat(F.lit('{"results": ['), one, F.lit("]}"))).when(i % 5 == 2, F.concat(F.lit('{"pipeline": '), one, F.lit("}"))).when(i % 5 == 3, one).otherwise("{broken")
    return traces.comparison_rows(table(spark, d, "benchmark").select(i.alias("file"), value.alias("value"))).select("file", "engine", "question_id", "score_status")


@query("z17_history", "WITH r AS (SELECT item_id, text FROM benchmark), f AS (SELECT event_id % (SELECT count(*) FROM benchmark) AS item_id, event_type, event_id FROM events) SELECT r.item_id AS run_id, CASE WHEN length(text) > 240 THEN rtrim(substr(text, 1, 240)) || '...' ELSE text END AS preview, arg_max(event_type, f.event_id) AS vote FROM r LEFT JOIN f USING (item_id) GROUP BY ALL")
def z17(spark, d):
    b, e = table(spark, d, "benchmark"), table(spark, d, "events")
    n = b.count()
    feedback = e.select((F.col("event_id") % n).alias("run_id"), F.col("event_type").alias("vote"), F.col("event_id").alias("updated_at"))
    return traces.history(b.select(F.col("item_id").alias("run_id"), F.lit("q").alias("query"), F.col("text").alias("answer"), F.lit(0).alias("finished")), feedback).select("run_id", "preview", "vote")


@query("p19_shapes")
def p19(spark, d):
    e = evidence.of(spark, d)
    shape = traces.evidence_shape(e.selected).select("query_id", F.size("evidence").alias("evidence"))
    cited = traces.citations(e.selected).groupBy("query_id").agg(F.count(F.lit(1)).alias("citations"))
    return shape.join(cited, "query_id").join(traces.trace_shape(evidence.rounds([e])), "query_id")


@query("a12_reasons", """WITH h AS (SELECT item_id, (item_id * 3) % 100 AS quality, (item_id * 7) % 100 AS coverage, item_id % 4 AS prim, item_id % 5 AS claims, (item_id % 10) / 10::DOUBLE AS rel, item_id % 3 AS degraded FROM benchmark)
    SELECT item_id, array_to_string(list_slice(list_filter([CASE WHEN quality >= 80 THEN 'Evidence is of high quality.' END, CASE WHEN claims = 0 THEN 'No claims were selected.' END, CASE WHEN prim > 0 THEN prim || ' selected from primary sources.' ELSE 'No primary source was selected.' END,
      CASE WHEN rel < 0.35 THEN 'Mean relevance is low.' END, CASE WHEN degraded > 0 THEN degraded || ' selected from degraded texts.' END, CASE WHEN coverage < 35 THEN 'Coverage is low.' END], lambda x: x IS NOT NULL), 1, 4), '|') AS reasons FROM h""")
def a12(spark, d):
    i = F.col("item_id")
    h = table(spark, d, "benchmark").select("item_id", (i * 3 % 100).alias("quality"), (i * 7 % 100).alias("coverage"), (i % 4).alias("primary_sources"), (i % 5).alias("claims"), (i % 10 / 10).alias("avg_relevance"), (i % 3).alias("degraded"))
    return h.select("item_id", F.array_join(health.reasons(), "|").alias("reasons"))


@query("p03_news_intent", """SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'news,code' ELSE 'code,government,academic' END AS required FROM benchmark""")
def p03_news(spark, d):
    from quarry.operators.intent import without_news

    text = F.when(F.col("item_id") % 2 == 0, "what do the headlines say").otherwise("what is said")
    return table(spark, d, "benchmark").select("item_id", F.array_join(without_news(text, dims.strings(["news", "code"])), ",").alias("required"))


@query("s22_run_records", "SELECT item_id, text AS answer FROM benchmark")
def s22(spark, d):
    """Run records written by day and read back."""
    import uuid

    from quarry.shared import scratch_root

    path = f"{scratch_root(spark)}/runs-{uuid.uuid4().hex}"
    runs = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("run_id"), F.col("item_id"), F.col("text").alias("answer"), F.array(F.lit(1.0)).alias("vector"))
    files.write_runs(runs, path, longest=1 << 30)
    return files.read_runs(spark, path, "run_id string, item_id long, answer string").select("item_id", "answer")


@query("f23_formats_of_costs", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.05 THEN printf('$%.2f', floor(l_discount * 100 + 0.5) / 100) ELSE printf('$%.4f', floor(l_discount * 10000 + 0.5) / 10000) END AS cost, printf('%.0f%%', floor(l_tax * 100 + 0.5)) AS ratio FROM lineitem")
def f23(spark, d):
    from quarry.functions.vector import half_up

    x = F.col("l_discount")
    cost = F.when(x >= 0.05, F.format_string("$%.2f", half_up(x, 2))).otherwise(F.format_string("$%.4f", half_up(x, 4)))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", cost.alias("cost"), F.format_string("%.0f%%", F.floor(F.col("l_tax") * 100 + 0.5).cast("double")).alias("ratio"))


@query("p21_plan_shapes", "SELECT doc_id AS key, 1 AS n FROM documents")
def p21_shapes(spark, d):
    """A model's plan as a bare list, or under another name."""
    def provider(asked: dict) -> str:
        row = '{"sub_query": "x", "target_sources": ["EIA"], "retrieval_intent": "temporal", "max_results": 3}'
        return (f"[{row}]", f'{{"subqueries": [{row}]}}', f'Here: {{"query_strategy": [{row}]}}')[int(asked["prompt"]) % 3]

    prompts = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.lit("strategy").alias("task"), F.col("doc_id").cast("string").alias("prompt"))
    return models.call(prompts, provider, models.SCHEMAS["strategy"]).select("key", F.size("output.sub_queries").alias("n"))


@query("z02_attempts", "SELECT query_id, CASE WHEN abs(query_id // 1000) % 3 = 2 THEN 2 ELSE 1 END AS attempts FROM (SELECT conv_id * 1000 + turn AS query_id FROM conversations WHERE role = 'user' UNION ALL SELECT -item_id * 1000 FROM benchmark)")
def z02(spark, d):
    mode = F.element_at(dims.strings(["fast", "balanced", "quality"]), (F.abs(F.floor(F.col("query_id") / 1000)) % 3 + 1).cast("int"))
    return _asked(spark, d).select("query_id", models.attempts_of(mode, F.lit("scoring")).alias("attempts"))


@query("w03_fitting_rows", """WITH RECURSIVE o AS (SELECT user_id, event_id, (event_id % 37)::BIGINT AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    f AS (SELECT user_id, event_id, n, CASE WHEN t <= 100 THEN t ELSE 0 END AS used, t <= 100 AS taken FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.event_id, o.n, CASE WHEN used + t <= 100 THEN used + t ELSE used END, used + t <= 100 FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
    SELECT user_id, event_id, used FROM f WHERE taken""")
def w03(spark, d):
    from quarry.operators.assembly import fitting

    return fitting(table(spark, d, "events").withColumn("t", F.col("event_id") % 37), "user_id", "event_id", "t", 100)


@query("a23_merged_entries", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(b.lang, a.lang) AS lang, coalesce(b.source, a.source) AS source FROM (SELECT doc_id, lang, source FROM documents WHERE doc_id % 3 > 0) a FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'new' END AS lang, NULL::VARCHAR AS source FROM documents WHERE doc_id % 5 > 0) b USING (doc_id)")
def a23(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    new = docs.filter("doc_id % 5 > 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "new").alias("lang"), F.lit(None).cast("string").alias("source"))
    return traces.merged_entries(docs.filter("doc_id % 3 > 0"), new, "doc_id")


@query("a01_source_results", "SELECT event_type AS source, count(*) AS queried, count(*) FILTER (WHERE event_id % 3 > 0) AS ok, count(*) FILTER (WHERE event_id % 3 = 0) AS failed, sum(event_id % 100)::BIGINT AS timing, coalesce(string_agg(DISTINCT 'HTTP_' || (400 + event_id % 4), ',' ORDER BY 'HTTP_' || (400 + event_id % 4)) FILTER (WHERE event_id % 3 = 0), '') AS errors FROM events GROUP BY 1")
def a01(spark, d):
    i = F.col("event_id")
    r = table(spark, d, "events").select(F.col("event_type").alias("source"), (i % 3 > 0).alias("ok"), (i % 100).alias("timing_ms"), F.concat(F.lit("HTTP_"), (i % 4 + 400).cast("string")).alias("code"))
    return traces.source_results(r).withColumn("errors", F.array_join("errors", ","))


@query("f41_padded_cosine", "SELECT a.vec_id AS q, b.vec_id AS vec_id, round(list_inner_product(list_slice(a.embedding, 1, 40)::DOUBLE[], list_slice(b.embedding, 1, 40)::DOUBLE[]) / sqrt(list_inner_product(list_slice(a.embedding, 1, 40)::DOUBLE[], list_slice(a.embedding, 1, 40)::DOUBLE[])) / sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def f41(spark, d):
    from quarry.functions.vector import cosine_padded

    e = table(spark, d, "embeddings")
    a = e.select(F.col("vec_id").alias("q"), (F.col("vec_id") + 1).alias("vec_id"), F.slice("embedding", 1, 40).alias("short"))
    return a.join(e.select("vec_id", "embedding"), "vec_id").select("q", "vec_id", F.round(cosine_padded(F.col("short"), F.col("embedding")), 5).alias("cosine"))


_TASKS = "t AS (SELECT doc_id, (['wikipedia','core','github','nowhere'])[doc_id % 4 + 1] AS source, (doc_id % 3 + 1)::INT AS most, (doc_id % 6)::INT AS n, doc_id % 7 AS k FROM documents)"


def _answered(spark, d):
    from quarry.operators.intent import tasks

    i = F.col("doc_id")
    source = F.element_at(dims.strings(["wikipedia", "core", "github", "nowhere"]), (i % 4 + 1).cast("int"))
    docs = table(spark, d, "documents")
    plan = docs.select(i.alias("query_id"), F.lit(0).alias("ix"), F.lit("q").alias("sub_query"), F.array(source).alias("target_sources"), F.lit("temporal").alias("retrieval_intent"), (i % 3 + 1).cast("int").alias("max_results"))
    one = F.struct(F.lit("k").alias("key"), F.lit("t").alias("title"), F.lit("1").alias("id"), F.lit("o/r").alias("full_name"))
    many = F.array_repeat(one, (i % 6).cast("int"))
    body = F.when(source == "wikipedia", F.to_json(F.struct(many.alias("pages")))).when(source == "core", F.to_json(F.struct(many.alias("results")))).otherwise(F.to_json(F.struct(many.alias("items"))))
    payload = F.when(i % 7 == 1, "oops").when(i % 7 == 2, '{"other": 1}').when(i % 7 == 3, None).otherwise(body)
    responses = docs.select(i.alias("query_id"), F.lit(0).alias("ix"), source.alias("source"), payload.alias("payload"), F.when(i % 7 == 4, "HTTP_429").alias("code"))
    return tasks(plan, dims.registry(spark)).select("query_id", "ix", "source", "max_results", "error"), responses


def _routed(spark, d):
    from quarry.sources import connectors

    return connectors.routed(*_answered(spark, d))


S01 = f"""WITH {_TASKS} SELECT doc_id AS query_id, source, code IS NULL AS ok, code, CASE code WHEN 'HTTP_429' THEN 'rate_limited' WHEN 'MALFORMED_PAYLOAD' THEN 'query_invalid' WHEN 'MISSING_FIELD' THEN 'missing_config' WHEN 'SOURCE_HANDLER_MISSING' THEN 'missing_config' WHEN 'NO_RESPONSE' THEN 'unknown' END AS category
    FROM (SELECT *, CASE WHEN source = 'nowhere' THEN 'SOURCE_HANDLER_MISSING' WHEN k = 4 THEN 'HTTP_429' WHEN k = 3 THEN 'NO_RESPONSE' WHEN k = 1 THEN 'MALFORMED_PAYLOAD' WHEN k = 2 THEN 'MISSING_FIELD' END AS code FROM t)"""


@query("s01_routed_results", S01)
def s01_results(spark, d):
    return _routed(spark, d)[1].drop("ix")


@query("s25_routed_items", f"WITH {_TASKS} SELECT doc_id AS query_id, source, least(most, n) AS items FROM t WHERE source <> 'nowhere' AND k NOT IN (1, 2, 3, 4) AND n > 0")
def s25_items(spark, d):
    return _routed(spark, d)[0].groupBy("query_id", "source").agg(F.count(F.lit(1)).cast("int").alias("items"))
