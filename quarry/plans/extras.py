"""Queries over requests, plugins, model output, routing and order-dependent clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import dims, facade
from quarry.binding import table
from quarry.operators import firsts

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("p01_request_validation", """SELECT item_id, coalesce(mode, 'balanced') AS quality_mode, coalesce(budget, 4000)::INT AS token_budget, CASE WHEN coalesce(trim(query), '') = '' THEN 'query is empty'
    WHEN coalesce(mode, 'balanced') = 'odd' THEN 'unknown quality mode' WHEN coalesce(budget, 4000) <= 0 THEN 'token budget must be positive' END AS problem
    FROM (SELECT item_id, CASE WHEN item_id % 5 = 0 THEN ' ' ELSE text END AS query, CASE item_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'odd' ELSE 'fast' END AS mode, CASE item_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 500 END AS budget FROM benchmark)""")
def p01(spark, d):
    i = F.col("item_id")
    r = table(spark, d, "benchmark").select("item_id", F.when(i % 5 == 0, " ").otherwise(F.col("text")).alias("query"), F.when(i % 4 == 0, None).when(i % 4 == 1, "odd").otherwise("fast").alias("quality_mode"), F.when(i % 3 == 0, 0).when(i % 3 == 1, 500).alias("token_budget"))
    return facade.validate_requests(r).select("item_id", "quality_mode", "token_budget", "problem")


@query("x01_plugin_diagnostics", """SELECT * FROM (VALUES ('Bad Id', 'error', 'INVALID_ID'), ('wikipedia', 'error', 'RESERVED_ID'), ('twice', 'error', 'DUPLICATE_ID'), ('nohandler', 'error', 'HANDLER_MISSING'), ('Bad Id', 'error', 'HANDLER_MISSING'), ('blank', 'warning', 'LABEL_MISSING')) t(id, level, code)""")
def x01(spark, d):
    m = spark.createDataFrame([("Bad Id", "a"), ("wikipedia", "b"), ("twice", "c"), ("twice", "d"), ("nohandler", "e"), ("blank", " "), ("fine", "f")], "id string, label string")
    return facade.plugin_diagnostics(m, spark.createDataFrame([("wikipedia",), ("twice",), ("blank",), ("fine",)], "id string"))


@query("p21_model_output", "SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE doc_id % 10 END AS score, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE lang END AS label FROM documents")
def p21(spark, d):
    body = F.format_string('{"score": %d, "label": "%s"}', F.col("doc_id") % 10, F.col("lang"))
    said = F.when(F.col("doc_id") % 4 == 0, body).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\n"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("The answer is "), body, F.lit(" indeed."))).otherwise("no json here")
    return table(spark, d, "documents").select("doc_id", facade.coerce_json(said, "score bigint, label string").alias("x")).select("doc_id", "x.score", "x.label")


@query("z02_mode_policy", """SELECT item_id, mode, (item_id % 3 = 2)::INT + 1 AS attempts, item_id % 3 > 0 AS extraction, ([0, 2, 4])[item_id % 3 + 1] AS rounds, CASE WHEN item_id % 3 = 1 THEN 12 ELSE 18 END AS cap
    FROM (SELECT item_id, (['fast','balanced','quality'])[item_id % 3 + 1] AS mode FROM benchmark)""")
def z02(spark, d):
    mode = F.element_at(dims.strings(["fast", "balanced", "quality"]), (F.col("item_id") % 3 + 1).cast("int"))
    policy = F.broadcast(spark.createDataFrame(dims.MODE_POLICY, "mode string, attempts int, extraction boolean, rounds int, cap int"))  # three rows
    return table(spark, d, "benchmark").select("item_id", mode.alias("mode")).join(policy, "mode")


@query("f36_cache_keys", "SELECT count(DISTINCT sha1(lang || chr(0) || source || chr(0) || text)) AS keys, count(*) AS n FROM documents")
def f36(spark, d):
    return table(spark, d, "documents").agg(F.countDistinct(F.sha1(F.concat_ws("\x00", "lang", "source", "text"))).alias("keys"), F.count(F.lit(1)).alias("n"))


@query("f39_durations", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 86400000 * (o_orderkey % 5) ELSE o_orderkey % 100 + o_orderkey % 7 END::BIGINT AS ms FROM orders")
def f39(spark, d):
    k = F.col("o_orderkey")
    started = F.when(k % 2 == 0, F.col("o_orderdate").cast("timestamp"))
    o = table(spark, d, "orders").select("o_orderkey", started.alias("started"), (started + F.make_interval(days=(k % 5).cast("int"))).alias("finished"), F.create_map(F.lit("fetch"), k % 100, F.lit("score"), k % 7).alias("stages"))
    total = F.aggregate(F.map_values("stages"), F.lit(0).cast("long"), lambda s, x: s + x)
    return o.select("o_orderkey", F.coalesce(F.unix_millis("finished") - F.unix_millis("started"), total).alias("ms"))


@query("j05_adjusted_weight", f"""WITH s(source_type, prior) AS (VALUES {",".join(f"('{k}', least(0.95, greatest(0.05, {v}))::DOUBLE)" for k, v in dims.TYPE_WEIGHTS.items())}),
    d AS (SELECT doc_id, (['filing','forum','academic'])[doc_id % 3 + 1] AS source_type FROM documents) SELECT doc_id, round(least(1, greatest(0.05, (0.5 + CASE WHEN source_type = 'forum' THEN 0.9 ELSE prior END) / 2)), 6) AS weight FROM d JOIN s USING (source_type)""")
def j05(spark, d):
    from quarry.operators.health import adjust_weights

    kind = F.element_at(dims.strings(["filing", "forum", "academic"]), (F.col("doc_id") % 3 + 1).cast("int"))
    c = table(spark, d, "documents").select("doc_id", kind.alias("source_type"), kind.alias("source"), F.lit("general").alias("domain"), F.lit(0.5).alias("weight"))
    store = spark.createDataFrame([("forum", "general", 0.9)], "source string, domain string, score double")
    return adjust_weights(c, store).select("doc_id", F.round("weight", 6).alias("weight"))


@query("a10_greedy_clusters", """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    e AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND y.vec_id < x.vec_id AND list_cosine_similarity(x.v, y.v) >= 0.5),
    r AS (SELECT vec_id, vec_id AS f FROM v UNION SELECT r.vec_id, e.b FROM r JOIN e ON e.a = r.f), m AS (SELECT vec_id, min(f) AS f FROM r GROUP BY 1)
    SELECT vec_id, label, (dense_rank() OVER (PARTITION BY label ORDER BY f) - 1)::INT AS cluster FROM m JOIN v USING (vec_id)""")
def a10(spark, d):
    """The first cluster with a similar member takes a vector, in the order of ids."""
    return firsts.first_similar(table(spark, d, "embeddings"), "vec_id", "label", "embedding", 0.5)
