"""Queries over joins, groupings, windows, sorts and set operations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry import dims
from quarry.binding import raw_items, table
from quarry.functions import text as T
from quarry.operators import health, intent
from quarry.operators.dedup import js_to_common, set_pairs
from quarry.plans.scalars import RAW, terms_sql

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _list(values: list[str]) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + "]"


def _union_sql(column: int) -> str:
    """First-wins distinct over the rules in order."""
    parts = [f"(CASE WHEN regexp_matches(lower(query), '{r[0]}') THEN {_list(r[column])} ELSE []::VARCHAR[] END)" for r in dims.INTENT_RULES]
    joined = " || ".join(parts)
    return f"list_filter({joined}, lambda x, i: list_position({joined}, x) = i)"


USER_TURNS = "q AS (SELECT conv_id, turn, text AS query FROM conversations WHERE role = 'user' UNION ALL SELECT -item_id, 0, text FROM benchmark)"


@query(
    "p03_p04_intent",
    f"""WITH {USER_TURNS}, t AS (SELECT *, list_slice({_union_sql(1)}, 1, 4) AS types, list_slice({_union_sql(2)}, 1, 5) AS asked FROM q),
    a AS (SELECT *, CASE WHEN regexp_matches(lower(query), '{dims.OIL}') THEN list_filter(asked || ['government','academic','encyclopedic'], lambda x, i: list_position(asked || ['government','academic','encyclopedic'], x) = i) ELSE asked END AS r FROM t)
    SELECT conv_id, turn, CASE WHEN len(types) = 0 THEN 'multi-hop' ELSE array_to_string(types, ',') END AS types,
    array_to_string(list_slice(CASE WHEN list_contains(types, 'fresh-fact') AND len(r) = 0 THEN ['government','academic'] ELSE r END, 1, 6), ',') AS required,
    CASE WHEN regexp_matches(lower(query), 'current|present') THEN 'current' END AS temporal FROM a""",
)
def p04(spark, d):
    q = _turns(spark, d)
    c = F.col("query")
    return q.select("conv_id", "turn", F.array_join(intent.query_types(c), ",").alias("types"), F.array_join(intent.required_types(c), ",").alias("required"), intent.temporal(c).alias("temporal"))


def _turns(spark, d):
    q = table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    return q.unionByName(table(spark, d, "benchmark").select((-F.col("item_id")).alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.col("text").alias("query")))


@query("p05_entities", rf"""WITH {USER_TURNS}, e AS (SELECT conv_id, turn, regexp_extract_all(query, '\b[A-Z][A-Za-z0-9.-]*(?:\s+[A-Z][A-Za-z0-9.-]*){{0,3}}\b') AS m FROM q)
    SELECT conv_id, turn, array_to_string(list_slice(list_filter(m, lambda x, i: list_position(m, x) = i), 1, 10), '|') AS entities FROM e""")
def p05(spark, d):
    return _turns(spark, d).select("conv_id", "turn", F.array_join(intent.entities(F.col("query")), "|").alias("entities"))


@query("p11_domain", "WITH " + USER_TURNS + " SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches(lower(query), '{p}') THEN '{n}'" for p, n in dims.DOMAIN_RULES) + " ELSE 'general' END AS domain FROM q")
def p11(spark, d):
    return _turns(spark, d).select("conv_id", "turn", intent.domain(F.col("query")).alias("domain"))


@query("p09_source_aliases", "SELECT * FROM (VALUES ('EIA','data_gov'), ('FRED','data_gov'), ('Google Scholar','semantic_scholar,openalex'), ('Wikipedia','wikipedia'), ('sec.gov','sec_edgar'), ('nothing','')) t(name, sources) WHERE name <> 'sec.gov' UNION ALL SELECT 'sec.gov', 'official_docs,sec_edgar'")
def p09(spark, d):
    names = spark.createDataFrame([("EIA",), ("FRED",), ("Google Scholar",), ("Wikipedia",), ("sec.gov",), ("nothing",)], "name string")
    return names.select("name", F.array_join(intent.coerce_source(F.col("name")), ",").alias("sources"))


@query("p22_history_window", """SELECT conv_id, turn, role, CASE WHEN length(text) > 600 THEN rtrim(substr(text, 1, 600)) || ' [truncated]' ELSE text END AS content
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6""")
def p22(spark, d):
    c = table(spark, d, "conversations").withColumn("r", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))).filter("r <= 6")
    return c.select("conv_id", "turn", "role", F.when(F.length("text") > 600, F.concat(F.rtrim(F.substring("text", 1, 600)), F.lit(" [truncated]"))).otherwise(F.col("text")).alias("content"))


@query("p16_required_match", f"""WITH {RAW}, r AS (SELECT unnest(['primary-document','news','academic','government']) AS required), v AS (SELECT unnest(['assemble','health','prerank','score']) AS stage)
    SELECT stage, required, source, CASE WHEN required = 'primary-document' THEN source_type IN ('filing','government','structured_fact','medical') WHEN required = 'news' THEN stage = 'prerank' AND source = 'hacker_news' ELSE source_type = required END AS matched, count(*) AS n
    FROM raw, r, v GROUP BY ALL""")
def p16(spark, d):
    """What each stage takes for a required type; only pre-ranking has a source of news."""
    from quarry.operators.ranking import matches_required

    r = raw_items(spark, d).withColumn("stance", dims.lookup(dims.STANCES, F.col("source_type"), "speculation")).withColumn("required", F.explode(dims.strings(["primary-document", "news", "academic", "government"])))
    match = lambda stage: F.struct(F.lit(stage).alias("stage"), matches_required(F.col("stance"), F.col("source_type"), F.col("source"), F.col("required"), "prerank" if stage == "prerank" else "never").alias("matched"))
    each = r.select("required", "source", F.explode(F.array(*map(match, ["assemble", "health", "prerank", "score"]))).alias("m"))
    return each.groupBy("m.stage", "required", "source", "m.matched").agg(F.count(F.lit(1)).alias("n"))


# joins


@query("j01_fanout", "SELECT o_orderkey, i - 1 AS pos, s AS source FROM (SELECT o_orderkey, generate_subscripts(t, 1)::INT AS i, unnest(t) AS s FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN ['arxiv','github'] ELSE ['wikipedia'] END AS t FROM orders))")
def j01(spark, d):
    t = F.when(F.col("o_orderkey") % 2 == 0, dims.strings(["arxiv", "github"])).otherwise(dims.strings(["wikipedia"]))
    return table(spark, d, "orders").select("o_orderkey", F.posexplode(t).alias("pos", "source"))


@query("j02_handler_lookup", f"""WITH {RAW} SELECT id, source, CASE WHEN source IN ('core', 'github') THEN 'SOURCE_HANDLER_MISSING' END AS error FROM raw""")
def j02(spark, d):
    handlers = dims.registry(spark).filter("source NOT IN ('core', 'github')").select("source", F.lit(True).alias("known"))
    r = raw_items(spark, d).select("id", "source")
    return r.join(F.broadcast(handlers), "source", "left").select("id", "source", F.when(F.col("known").isNull(), "SOURCE_HANDLER_MISSING").alias("error"))  # 14 handlers


@query("j03_scores_with_fallback", "SELECT d.doc_id, coalesce(l.quality::DOUBLE, 0.5) AS relevance, l.doc_id IS NULL AS fallback FROM documents d LEFT JOIN labels l USING (doc_id)")
def j03(spark, d):
    labels = table(spark, d, "labels").select("doc_id", "quality", F.lit(False).alias("miss"))
    return table(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("double"), F.lit(0.5)).alias("relevance"), F.coalesce("miss", F.lit(True)).alias("fallback"))


@query("j04_source_weight", f"""WITH {RAW}, s(source, sw) AS (VALUES {",".join(f"('{k}', {v}::DOUBLE)" for k, v in dims.SOURCE_WEIGHTS.items())}), t(source_type, tw) AS (VALUES {",".join(f"('{k}', {v}::DOUBLE)" for k, v in dims.TYPE_WEIGHTS.items())})
    SELECT id, greatest(coalesce(sw, 0.35), coalesce(tw, 0.35)) AS weight FROM raw LEFT JOIN s USING (source) LEFT JOIN t USING (source_type)""")
def j04(spark, d):
    return raw_items(spark, d).select("id", dims.source_weight(F.col("source"), F.col("source_type")).alias("weight"))


@query("j07_set_similarity", f"""WITH d AS (SELECT doc_id, list_distinct({terms_sql('text')}) AS s FROM documents), p AS (SELECT doc_id, unnest(s) AS t FROM d WHERE len(s) > 0),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM p a JOIN p b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL)
    SELECT a, b, round(n / (len(x.s) + len(y.s) - n)::DOUBLE, 6) AS jaccard FROM c JOIN d x ON x.doc_id = a JOIN d y ON y.doc_id = b WHERE n / (len(x.s) + len(y.s) - n)::DOUBLE >= 0.92
    UNION ALL SELECT a.doc_id, b.doc_id, 1.0 FROM d a JOIN d b ON a.doc_id < b.doc_id AND len(a.s) = 0 AND len(b.s) = 0""")
def j07(spark, d):
    sets = table(spark, d, "documents").select(F.lit(0).alias("query_id"), F.col("doc_id").alias("chunk_id"), T.terms(F.col("text")).alias("tokens"))
    return set_pairs(sets, 0.92, stars=False).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query("j08_cosine_pairs", """SELECT a.vec_id AS q, b.vec_id AS vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.25""")
def j08(spark, d):
    from quarry.functions.vector import in_blocks

    e = table(spark, d, "embeddings")
    return in_blocks(e.filter("vec_id % 50 = 0"), e, "vec_id", least=0.25, digits=5)


@query("j09_cache_split", "SELECT d.doc_id, CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) THEN 'hit' ELSE 'miss' END AS cache FROM documents d")
def j09(spark, d):
    docs, keys = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    return docs.join(keys, "doc_id", "left_semi").withColumn("cache", F.lit("hit")).unionByName(docs.join(keys, "doc_id", "left_anti").withColumn("cache", F.lit("miss")))


@query("j10_selected_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def j10(spark, d):
    big = table(spark, d, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(big, "c_custkey", "left_semi").select("c_custkey")


@query("j13_rule_join", "SELECT conv_id, turn, count(*) AS rules FROM conversations, (VALUES " + ",".join(f"('{r[0]}')" for r in dims.INTENT_RULES) + ") r(p) WHERE regexp_matches(lower(text), p) GROUP BY ALL")
def j13(spark, d):
    c = table(spark, d, "conversations")
    rules = spark.createDataFrame([(r[0],) for r in dims.INTENT_RULES], "p string")
    return c.join(F.broadcast(rules), F.expr("lower(text) rlike p")).groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("rules"))  # six rules


@query("j14_ordered_lookup", "SELECT o_orderkey, pos, o_totalprice FROM (SELECT l_orderkey AS o_orderkey, row_number() OVER (ORDER BY l_orderkey) - 1 AS pos FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity >= 49)) JOIN orders USING (o_orderkey)")
def j14(spark, d):
    ids = table(spark, d, "lineitem").filter("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    ranked = _global_rank(ids, "o_orderkey")
    return ranked.join(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", "pos", "o_totalprice")


def _global_rank(df, key: str):
    """Zero-based rank by a distinct numeric key without one task for all rows: ranks within value ranges, and range totals."""
    spark = df.sparkSession
    low, high = df.agg(F.min(key), F.max(key)).first()
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = max(1, ((high or 0) - (low or 0)) // n + 1)
    b = df.withColumn("bucket", F.floor((F.col(key) - F.lit(low or 0)) / width))
    totals = b.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"))  # at most n rows
    before = totals.select("bucket", (F.sum("c").over(W.orderBy("bucket")) - F.col("c")).alias("before"))
    return b.join(F.broadcast(before), "bucket").withColumn("pos", F.col("before") + F.row_number().over(W.partitionBy("bucket").orderBy(key)) - 1).drop("bucket", "before")


@query("j15_engine_matrix", """SELECT e AS engine, item_id, CASE WHEN e = 'own' THEN 'scored' WHEN item_id % 3 = 0 THEN 'fixture' ELSE 'missing' END AS mode FROM benchmark, (VALUES ('own'), ('a'), ('b')) t(e)""")
def j15(spark, d):
    items, engines = table(spark, d, "benchmark").select("item_id"), spark.createDataFrame([("own",), ("a",), ("b",)], "engine string")
    fixtures = items.filter("item_id % 3 = 0").select("item_id", F.lit("fixture").alias("mode"))
    return items.join(F.broadcast(engines)).join(fixtures, "item_id", "left").select("engine", "item_id", F.when(F.col("engine") == "own", "scored").otherwise(F.coalesce("mode", F.lit("missing"))).alias("mode"))  # three engines


@query("j16_events_with_details", "SELECT e.event_id, e.event_type, t.n AS peers FROM events e LEFT JOIN (SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1) t USING (event_type)")
def j16(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", "event_type").join(e.filter("event_type <> 'error'").groupBy("event_type").agg(F.count(F.lit(1)).alias("peers")), "event_type", "left")


@query("star_join_rollup", """SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def star(spark, d):
    t = lambda n: table(spark, d, n)
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    o = t("orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "r_name", "n_name")
    j = t("lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.rollup("r_name", "n_name").agg(F.round(F.sum("v"), 2).alias("revenue"), F.count(F.lit(1)).alias("lines"))


# grouping


@query("a01_source_rollup", "SELECT event_type AS source, count(*) AS queried, count(*) FILTER (WHERE value >= 1) AS ok, count(*) FILTER (WHERE value < 1) AS failed, round(sum(value), 4) AS timing FROM events GROUP BY 1")
def a01(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("source")).agg(F.count(F.lit(1)).alias("queried"), F.count_if(F.col("value") >= 1).alias("ok"), F.count_if(F.col("value") < 1).alias("failed"), F.round(F.sum("value"), 4).alias("timing"))


@query("a02_canonical_groups", f"""WITH {RAW}, s AS (SELECT md5(text) AS key, id, ord, length(text) + CASE WHEN source_type IN ('government','filing') THEN 20 ELSE 0 END AS score FROM raw)
    SELECT key, count(*) AS items, max(score)::BIGINT AS best, arg_min(id, (-score, ord)) AS primary_id FROM s GROUP BY key""")
def a02(spark, d):
    score = F.length("text") + F.when(F.col("source_type").isin("government", "filing"), 20).otherwise(0)
    s = raw_items(spark, d).select(F.md5("text").alias("key"), "id", "ord", score.alias("score"))
    return s.groupBy("key").agg(F.count(F.lit(1)).alias("items"), F.max("score").cast("long").alias("best"), F.min_by("id", F.struct(-F.col("score"), "ord")).alias("primary_id"))



@query("a04_exact_duplicates", "SELECT doc_id, k, n FROM (SELECT doc_id, sha1(text) AS k, count(*) OVER (PARTITION BY sha1(text)) AS n, row_number() OVER (PARTITION BY sha1(text) ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def a04(spark, d):
    g = table(spark, d, "documents").select("doc_id", F.sha1("text").alias("k"), "n_chars").groupBy("k")
    return g.agg(F.min_by("doc_id", F.struct(-F.col("n_chars"), "doc_id")).alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query("a14_a15_cost_summary", """WITH f AS (SELECT l_returnflag AS stage, l_shipmode AS model, l_quantity AS tokens, round(l_extendedprice * 1e-6, 9) AS cost FROM (SELECT *, p_brand AS l_shipmode FROM lineitem JOIN part ON l_partkey = p_partkey))
    SELECT stage, model, count(*) AS calls, sum(tokens)::BIGINT AS tokens, round(sum(cost), 6) AS cost FROM f GROUP BY GROUPING SETS ((), (stage), (model))""")
def a15(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("model"))
    f = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_returnflag").alias("stage"), "model", F.col("l_quantity").alias("tokens"), F.round(F.col("l_extendedprice") * F.lit(1e-6), 9).alias("cost"))
    f.createOrReplaceTempView("quarry_cost_facts")
    return spark.sql("SELECT stage, model, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 6) AS cost FROM quarry_cost_facts GROUP BY GROUPING SETS ((), (stage), (model))")



@query("a18_adjudication_merge", "SELECT doc_id, greatest(quality, toxic) AS facts, (CASE WHEN quality = 1 THEN 'q' ELSE '' END) || (CASE WHEN toxic = 1 THEN 't' ELSE '' END) AS flags FROM labels")
def a18(spark, d):
    flags = F.array_union(F.when(F.col("quality") == 1, dims.strings(["q"])).otherwise(dims.strings([])), F.when(F.col("toxic") == 1, dims.strings(["t"])).otherwise(dims.strings([])))
    return table(spark, d, "labels").select("doc_id", F.greatest("quality", "toxic").alias("facts"), F.array_join(flags, "").alias("flags"))


@query("a19_source_failures", "SELECT event_id, event_type, value FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50")
def a19(spark, d):
    return table(spark, d, "events").filter("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "event_type", "value")


@query("a20_trace_rollup", "SELECT user_id, round(sum(value), 4) AS total, max(value) AS slowest, count(*) FILTER (WHERE value > 2) AS slow_calls FROM events GROUP BY 1")
def a20(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("slowest"), F.count_if(F.col("value") > 2).alias("slow_calls"))


@query("a21_first_wins_distinct", "SELECT source, lang, min(doc_id) AS first_doc FROM documents GROUP BY ALL")
def a21(spark, d):
    w = W.partitionBy("source", "lang").orderBy("doc_id")
    return table(spark, d, "documents").withColumn("r", F.row_number().over(w)).filter("r = 1").select("source", "lang", F.col("doc_id").alias("first_doc"))


@query("a22_validation", "SELECT 'duplicate' AS issue, doc_id FROM labels GROUP BY doc_id HAVING count(*) > 1 UNION ALL SELECT 'missing', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'unexpected', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def a22(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    issue = lambda df, name: df.select(F.lit(name).alias("issue"), "doc_id")
    return issue(labels.groupBy("doc_id").count().filter("count > 1"), "duplicate").unionByName(issue(docs.join(labels, "doc_id", "left_anti"), "missing")).unionByName(issue(labels.join(docs, "doc_id", "left_anti"), "unexpected"))


@query("a23_history_merge", "SELECT user_id, max(ts) AS last_seen, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1 ORDER BY last_seen DESC, user_id LIMIT 30")
def a23(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_seen"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))
    return g.orderBy(F.desc("last_seen"), "user_id").limit(30)


@query("a24_cube", "SELECT lang, source, count(*) AS n FROM documents GROUP BY CUBE (lang, source)")
def a24(spark, d):
    return table(spark, d, "documents").cube("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("f14_js_divergence", f"""WITH d AS (SELECT lang, t, count(*) AS n FROM (SELECT lang, unnest({terms_sql('text', None, 2)}) AS t FROM documents) GROUP BY ALL), b AS (SELECT t, count(*) AS n FROM (SELECT unnest({terms_sql('text', None, 2)}) AS t FROM benchmark) GROUP BY ALL),
    p AS (SELECT lang, t, n / sum(n) OVER (PARTITION BY lang) AS p FROM d), q AS (SELECT lang, t, n / (SELECT sum(n) FROM b) AS q FROM b, (SELECT DISTINCT lang FROM d)),
    j AS (SELECT lang, coalesce(p, 0) AS p, coalesce(q, 0) AS q, (coalesce(p, 0) + coalesce(q, 0)) / 2 AS m FROM p FULL JOIN q USING (lang, t))
    SELECT lang, round((sum(CASE WHEN p > 0 THEN p * ln(p / m) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * ln(q / m) ELSE 0 END)) / 2 / ln(2), 6) AS js FROM j GROUP BY lang""")
def f14(spark, d):
    docs = table(spark, d, "documents")
    a = docs.select("lang", F.explode(T.terms(F.col("text"), 2)).alias("term")).groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n"))
    b = table(spark, d, "benchmark").select(F.explode(T.terms(F.col("text"), 2)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return js_to_common(a, b, ["lang"]).select("lang", F.round("js", 6).alias("js"))


@query("f47_reliability", """WITH o AS (SELECT CASE event_type WHEN 'click' THEN 'confirmed' WHEN 'error' THEN 'contradicted' WHEN 'view' THEN 'repeated' ELSE 'observed' END AS kind, user_id FROM events)
    SELECT 'user' || user_id AS source, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(alpha / (alpha + beta), 6) AS score FROM (SELECT user_id,
    6 * 0.55 + sum(CASE kind WHEN 'confirmed' THEN 1 WHEN 'repeated' THEN 0.2 WHEN 'observed' THEN 0.05 ELSE 0 END)::DOUBLE AS alpha, 6 * (1 - 0.55) + sum(CASE kind WHEN 'contradicted' THEN 1 WHEN 'repeated' THEN 0.1 WHEN 'observed' THEN 0.05 ELSE 0 END)::DOUBLE AS beta FROM o GROUP BY 1)""")
def f47(spark, d):
    e = F.col("event_type")
    kind = F.when(e == "click", "confirmed").when(e == "error", "contradicted").when(e == "view", "repeated").otherwise("observed")
    o = table(spark, d, "events").select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("source"), F.lit("general").alias("domain"), F.lit("forum").alias("source_type"), kind.alias("kind"), F.col("event_id").alias("ord"))
    r = health.reliability(o)
    return r.select("source", *(F.round(c, 6).alias(c) for c in ("alpha", "beta", "score")))


# windows


@query("w01_timeline", """SELECT event_id, round((epoch_us(ts) - epoch_us(first_value(ts) OVER w)) / 1e6, 3) AS elapsed, round(greatest(0, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w), 0)) / 1e6, 3) AS delta, event_type = 'error' AS severe FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def w01(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.select("event_id", F.round((F.col("us") - F.first("us").over(w)) / 1e6, 3).alias("elapsed"), F.round(F.greatest(F.lit(0), F.coalesce(F.col("us") - F.lag("us").over(w), F.lit(0))) / 1e6, 3).alias("delta"), (F.col("event_type") == "error").alias("severe"))


@query("w02_first_per_group", "SELECT * FROM (SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1)")
def w02(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.min_by(F.struct("doc_id", "n_chars"), F.struct(-F.col("n_chars"), "doc_id")).alias("x")).select("source", "x.doc_id", "x.n_chars")


@query("w03_running_tokens", "SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM conversations")
def w03(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.sum(F.length("text")).over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)).alias("running"))


@query("w04_batches", "SELECT event_id, ((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 8)::BIGINT AS batch FROM events")
def w04(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.floor((F.row_number().over(w) - 1) / 8).alias("batch"))


@query("w05_history_navigation", "SELECT event_id, coalesce(lag(event_id) OVER w, event_id) AS newer, coalesce(lead(event_id) OVER w, event_id) AS older FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)")
def w05(spark, d):
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").select("event_id", F.coalesce(F.lag("event_id").over(w), "event_id").alias("newer"), F.coalesce(F.lead("event_id").over(w), "event_id").alias("older"))


@query("w06_lru_eviction", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 2000")
def w06(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(2000).select("event_id")


@query("w07_forward_fill", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS last_user_turn FROM conversations")
def w07(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, d, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("last_user_turn"))


@query("w08_bigrams", f"SELECT item_id, array_to_string(list_transform(list_zip(list_slice(t, 1, len(t) - 1), list_slice(t, 2, len(t))), lambda x: x[1] || ' ' || x[2]), '|') AS bigrams FROM (SELECT item_id, {terms_sql('text')} AS t FROM benchmark)")
def w08(spark, d):
    t = T.terms(F.col("text"))
    n = F.greatest(F.size(t) - 1, F.lit(0))
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.zip_with(F.slice(t, 1, n), F.slice(t, 2, n), lambda a, b: F.concat_ws(" ", a, b)), "|").alias("bigrams"))


@query("w09_distribution", "SELECT doc_id, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars, doc_id)")
def w09(spark, d):
    w = W.partitionBy("source").orderBy("n_chars", "doc_id")
    return table(spark, d, "documents").select("doc_id", F.ntile(4).over(w).cast("long").alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"))


@query("t12_best_attempt", "SELECT page_id, CASE WHEN length(html) >= 1200 THEN 'html' ELSE 'metadata' END AS method, greatest(length(html), length(url))::BIGINT AS len FROM pages")
def t12(spark, d):
    p = table(spark, d, "pages")
    attempts = F.array(F.struct(F.lit("metadata").alias("method"), F.length("url").alias("len"), F.lit(2).alias("rank")), F.struct(F.lit("html").alias("method"), F.length("html").alias("len"), F.when(F.length("html") >= 1200, 3).otherwise(1).alias("rank")))
    x = p.select("page_id", F.explode(attempts).alias("a"))
    return x.groupBy("page_id").agg(F.max_by("a.method", F.struct("a.rank", "a.len")).alias("method"), F.max("a.len").cast("long").alias("len"))


@query("t13_top_groups", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 12")
def t13(spark, d):
    w = W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, d, "documents").withColumn("r", F.row_number().over(w)).filter("r <= 12").select("source", "doc_id")


@query("t15_cost_groups", "SELECT p_brand, round(sum(l_extendedprice), 2) AS cost FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY cost DESC LIMIT 10")
def t15(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    j = table(spark, d, "lineitem").select("l_partkey", "l_extendedprice").join(p, F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("p_brand").agg(F.round(F.sum("l_extendedprice"), 2).alias("cost")).orderBy(F.desc("cost")).limit(10)


# sets


@query("u01_union_rounds", "SELECT doc_id, 0 AS round FROM documents UNION ALL SELECT doc_id, 1 FROM labels")
def u01(spark, d):
    return table(spark, d, "documents").select("doc_id", F.lit(0).alias("round")).unionByName(table(spark, d, "labels").select("doc_id", F.lit(1).alias("round")))


@query("u02_distinct_union", "SELECT source FROM documents UNION SELECT lang FROM documents")
def u02(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("source").union(docs.select("lang")).distinct()


@query("u03_intersect", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def u03(spark, d):
    return table(spark, d, "documents").select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))


@query("u04_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u04(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@query("u05_except_all", "SELECT l_suppkey FROM lineitem EXCEPT ALL SELECT s_suppkey FROM supplier")
def u05(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey").exceptAll(table(spark, d, "supplier").select("s_suppkey"))


# events


@query("c14_stall_gaps", "SELECT event_id, user_id, round(gap, 3) AS gap, gap >= 1800 AS stalled FROM (SELECT event_id, user_id, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6 AS gap FROM events)")
def c14(spark, d):
    from quarry.streaming.events import stall_gaps

    return stall_gaps(table(spark, d, "events"), 1800)


@query("c15_tumbling", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def c15(spark, d):
    from quarry.streaming.events import hourly

    return hourly(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("c15_sessions", """WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark, d):
    from quarry.streaming.events import sessions as by_gap

    return by_gap(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), "n")


