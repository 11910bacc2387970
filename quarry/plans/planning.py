"""Queries over plans of sub-queries and repair plans, with the SQL that is made from the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import dims, topics
from quarry.binding import queries, raw_items, table
from quarry.operators import health, intent, planner
from quarry.plans.relational import _list, _union_sql
from quarry.plans.scalars import RAW, WS, terms_sql

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _row(text: str, sources: str, kind: str, n: str) -> str:
    return f"{{'sub_query': {text}, 'target_sources': {sources}, 'retrieval_intent': {kind}, 'max_results': {n}}}"


def rows_sql(templates: list[tuple], q: str = "query") -> str:
    said = [_row(f"replace('{t}', '{{q}}', {q})" if "{q}" in t else f"'{t}'", _list(s), f"'{i}'", str(n)) for t, s, i, n in templates]
    return "[" + ", ".join(said) + "]"


def present_sql(*rows: str) -> str:
    return f"list_filter([{', '.join(rows)}], lambda x: x IS NOT NULL)"


_UNION = "list_filter(asked || ['government','academic','encyclopedic'], lambda x, i: list_position(asked || ['government','academic','encyclopedic'], x) = i)"
_FOUND = " || ".join(
    [f"(CASE WHEN list_contains(required, '{t}') THEN {_list(s)} ELSE []::VARCHAR[] END)" for t, s in dims.TYPE_SOURCES.items()]
    + [f"(CASE WHEN regexp_matches(lower(query), '{p}') THEN {_list(s)} ELSE []::VARCHAR[] END)" for p, s in dims.TOPIC_SOURCES]
)
_GENERAL = "list_filter(" + present_sql(
    _row("query", "sources", "CASE WHEN list_contains(types, 'source-attribution') THEN 'primary_evidence' ELSE 'corroborating' END", "least(6, greatest(3, len(sources)))"),
    "CASE WHEN list_contains(types, 'fresh-fact') THEN " + _row("query || ' latest official data projections'", "list_slice(list_filter(sources, lambda s: s IN ('data_gov','sec_edgar','openalex','crossref')), 1, 4)", "'temporal'", "5") + " END",
    "CASE WHEN list_contains(types, 'adversarial') THEN " + _row("query || ' primary source evidence risks limitations'", "list_slice(list_filter(sources, lambda s: s <> 'hacker_news'), 1, 5)", "'contrarian'", "4") + " END",
) + ", lambda r: len(r.target_sources) > 0)"
_LACKS = {n: f"NOT list_has_any(asked_sources, {_list(r[1][:1] if n == 'code' else r[1])})" for n, r in topics.BROADER.items()}
_MARKET, _SHORT = f"regexp_matches(lower(query), '{topics.MARKET}')", f"len(string_split_regex(regexp_replace(query, '^{WS}+|{WS}+$', '', 'g'), '{WS}+')) <= 10"
_WHEN = {"background": f"({_SHORT} OR {_MARKET})", "data": f"(list_contains(types, 'fresh-fact') OR {_MARKET})", "analysis": f"({_SHORT} OR {_MARKET} OR list_contains(required, 'academic'))", "code": f"regexp_matches(lower(query), '{topics.SOFTWARE}')"}
#: from q (query_id, query): qi with types and required, pl with the broadened plan, task by sub-query and source
PLAN = f"""i1 AS (SELECT *, list_slice({_union_sql(1)}, 1, 4) AS types0, list_slice({_union_sql(2)}, 1, 5) AS asked FROM q),
i2 AS (SELECT *, CASE WHEN regexp_matches(lower(query), '{dims.OIL}') THEN {_UNION} ELSE asked END AS r0 FROM i1),
qi AS (SELECT query_id, query, CASE WHEN len(types0) = 0 THEN ['multi-hop'] ELSE types0 END AS types, list_slice(CASE WHEN list_contains(types0, 'fresh-fact') AND len(r0) = 0 THEN ['government','academic'] ELSE r0 END, 1, 6) AS required FROM i2),
pl1 AS (SELECT *, {_FOUND} AS found FROM qi),
pl2 AS (SELECT *, list_slice(list_filter({_list(dims.ASKED)}, lambda s: list_contains(CASE WHEN len(found) = 0 THEN ['wikipedia','wikidata','crossref'] ELSE found END, s)), 1, 6) AS sources FROM pl1),
pl3 AS (SELECT *, CASE {" ".join(f"WHEN regexp_matches(lower(query), '{p}') THEN {rows_sql(t)}" for _, p, t in topics.PLANS)} ELSE list_slice({_GENERAL}, 1, 6) END AS plan FROM pl2),
pl4 AS (SELECT *, flatten(list_transform(plan, lambda r: r.target_sources)) AS asked_sources FROM pl3),
pl AS (SELECT query_id, query, types, required, list_slice(plan || {present_sql(*(f"CASE WHEN {_WHEN[n]} AND {_LACKS[n]} THEN {rows_sql([r])[1:-1]} END" for n, r in topics.BROADER.items()))}, 1, 7) AS plan FROM pl4),
sub AS (SELECT query_id, generate_subscripts(plan, 1) - 1 AS ix, unnest(plan) AS s FROM pl),
task AS (SELECT query_id, ix, s.sub_query AS sub_query, s.max_results AS max_results, unnest(s.target_sources) AS source FROM sub)"""
STOP = _list(dims.SCORE_STOPWORDS)
#: after RAW and PLAN: hit, the items that a plan's sub-queries retrieve
HITS = f"""ask AS (SELECT query_id, ix, source, max_results, unnest(list_distinct({terms_sql('sub_query', STOP)})) AS term FROM task),
has AS (SELECT id AS item_id, ord, source, unnest(list_distinct({terms_sql('text')})) AS term FROM raw),
met AS (SELECT query_id, ix, source, max_results, item_id, ord, count(*) AS shared FROM ask JOIN has USING (source, term) GROUP BY ALL),
hit AS (SELECT query_id, ix, source, item_id, shared FROM met QUALIFY row_number() OVER (PARTITION BY query_id, ix, source ORDER BY shared DESC, ord) <= max_results)"""
#: put behind the test tables' texts, which have no topics of their own
_TAILS = ["", " crude oil outlook", " duplicate claims and token budget", " what do traders read in the news", " owasp repository check", " sec filing on inflation and debt", " open source rag reranker", " present github code"]
_TURNS = f"q AS (SELECT query_id, query || ({_list(_TAILS)})[abs(query_id // 1000) % 8 + 1] AS query FROM (SELECT conv_id * 1000 + turn AS query_id, text AS query FROM conversations WHERE role = 'user' UNION ALL SELECT -item_id * 1000, text FROM benchmark))"
_SAID = "s.sub_query AS sub_query, array_to_string(s.target_sources, ',') AS target_sources, s.retrieval_intent AS retrieval_intent, s.max_results AS max_results"


def _asked(spark, d):
    turns = table(spark, d, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    both = turns.unionByName(queries(spark, d).select((-F.col("query_id") * 1000).alias("query_id"), "query"))
    tail = F.element_at(dims.strings(_TAILS), (F.abs(F.floor(F.col("query_id") / 1000)) % 8 + 1).cast("int"))
    return intent.with_intent(both.withColumn("query", F.concat("query", tail)))


@query("p06_p07_plan", f"WITH {_TURNS}, {PLAN} SELECT query_id, ix, {_SAID} FROM sub")
def p06(spark, d):
    plan = planner.broadened(planner.first_plan(_asked(spark, d)))
    return planner.sub_queries(plan).withColumn("target_sources", F.array_join("target_sources", ","))


_PREFERRED = ["data_gov", "arxiv", "github"]


@query("p08_preferred", f"""WITH {_TURNS}, {PLAN}, k AS (SELECT query_id, query, list_filter(list_transform(plan, lambda r: struct_update(r, target_sources := list_filter(r.target_sources, lambda s: s IN ('data_gov','arxiv','github')))), lambda r: len(r.target_sources) > 0) AS kept FROM pl)
    SELECT query_id, ix, {_SAID} FROM (SELECT query_id, generate_subscripts(p, 1) - 1 AS ix, unnest(p) AS s FROM (SELECT query_id, CASE WHEN len(kept) > 0 THEN kept ELSE {rows_sql([("{q}", _PREFERRED, "primary_evidence", 3)])} END AS p FROM k))""")
def p08(spark, d):
    plan = planner.preferred(planner.broadened(planner.first_plan(_asked(spark, d))), [*_PREFERRED, "no_such_source"])
    return planner.sub_queries(plan).withColumn("target_sources", F.array_join("target_sources", ","))


@query("p07_plan_from_elsewhere", """SELECT doc_id, array_to_string(list_slice(list_filter(s, lambda x, i: list_position(s, x) = i), 1, 6), ',') AS target_sources, CASE doc_id % 3 WHEN 0 THEN 'temporal' ELSE 'corroborating' END AS retrieval_intent, least(10, greatest(1, doc_id % 15))::INT AS max_results
    FROM (SELECT doc_id, (CASE doc_id % 4 WHEN 0 THEN ['data_gov'] WHEN 1 THEN ['semantic_scholar','openalex'] WHEN 2 THEN ['wikipedia'] ELSE []::VARCHAR[] END) || (CASE WHEN doc_id % 2 = 1 THEN ['openalex','crossref'] ELSE []::VARCHAR[] END) AS s FROM documents WHERE doc_id % 4 < 3 OR doc_id % 2 = 1)""")
def p07(spark, d):
    """Free source names, intents and limits, as a model gives them."""
    i = F.col("doc_id")
    name = F.element_at(dims.strings(["EIA", "Google Scholar", " Wikipedia", "someone's blog"]), (i % 4 + 1).cast("int"))
    row = F.struct(F.lit("x").alias("sub_query"), F.array_compact(F.array(name, F.when(i % 2 == 1, "IEA"))).alias("target_sources"), F.when(i % 3 == 0, "temporal").when(i % 3 == 1, "guess").otherwise("corroborating").alias("retrieval_intent"), (i % 15).cast("int").alias("max_results"))
    plan = planner.coerced(table(spark, d, "documents").select(i.alias("query_id"), F.array(row).cast(f"array<{planner.ROW}>").alias("plan")), intent.coerce_source)
    return planner.sub_queries(plan).select(F.col("query_id").alias("doc_id"), F.array_join("target_sources", ",").alias("target_sources"), "retrieval_intent", "max_results")


@query("z01_gap_topics", f"WITH {_TURNS} SELECT query_id, CASE {' '.join(f'WHEN regexp_matches(lower(query), {chr(39)}{p}{chr(39)}) THEN {chr(39)}{n}{chr(39)}' for n, p, *_ in topics.GAPS)} END AS topic FROM q")
def z01(spark, d):
    return _asked(spark, d).select("query_id", planner.gap_topic(F.col("query")).alias("topic"))


_FACETS = "CASE " + " ".join(
    f"WHEN regexp_matches(lower(query), '{p}') THEN " + (present_sql(*(f"CASE WHEN NOT ({' OR '.join(f'contains(said, {chr(39)}{t}{chr(39)})' for t in terms)}) THEN '{n}' END" for n, terms in facets)) if facets else "[]::VARCHAR[]")
    for _, p, _, facets, _ in topics.GAPS
) + " ELSE []::VARCHAR[] END"


@query("a13_missing_facets", f"WITH {_TURNS}, t AS (SELECT query_id, query, lower(query) AS said FROM q) SELECT query_id, array_to_string({_FACETS}, '|') AS facets FROM t")
def a13(spark, d):
    return _asked(spark, d).select("query_id", F.array_join(planner.missing_facets(F.col("query"), F.lower("query")), "|").alias("facets"))


_BY_GAP = "flatten(list_transform(hard, lambda g: CASE g " + " ".join(f"WHEN '{k}' THEN {rows_sql(r)}" for k, r in topics.TYPE_GAPS.items()) + " ELSE [] END))"
_TOPIC_ROWS = "CASE " + " ".join(f"WHEN regexp_matches(lower(query), '{p}') THEN {rows_sql(t)}" for _, p, t, *_ in topics.GAPS) + " ELSE [] END"
_KEY1 = "lower(x.sub_query) || '::' || array_to_string(x.target_sources, ',')"
_KEY2 = "lower(x.sub_query) || '|' || array_to_string(list_sort(x.target_sources), ',')"


def _first_sql(rows: str, key: str) -> str:
    return f"list_filter({rows}, lambda x, i: list_position(list_transform({rows}, lambda x: {key}), {key}) = i)"


def _later(kinds: list[str], broad: bool) -> str:
    table = {k: topics.by_type(k, broad) for k in ("academic", "primary-document", "filing", "government", "encyclopedic", "forum", "code", "medical")}
    return f"flatten(list_transform(CASE WHEN len(hard) > 0 THEN hard ELSE {_list(kinds)} END, lambda g: CASE g " + " ".join(f"WHEN '{k}' THEN {rows_sql(r)}" for k, r in table.items()) + " ELSE [] END))"


@query("c02_repair_plan", f"""WITH {_TURNS}, {PLAN}, g AS (SELECT query_id, query, types, CASE WHEN query_id % 3 = 0 THEN required ELSE [] END AS hard, query_id % 5 AS selected FROM pl),
    f1 AS (SELECT *, {_TOPIC_ROWS} AS t1, {_BY_GAP} AS t2 FROM g), f2 AS (SELECT *, t1 || t2 AS found FROM f1),
    f3 AS (SELECT *, found || (CASE WHEN len(found) = 0 AND selected < 3 THEN {rows_sql(topics.NOTHING)} ELSE [] END) || (CASE WHEN list_contains(types, 'adversarial') THEN {rows_sql(topics.CONTRARY)} ELSE [] END) AS every FROM f2),
    f4 AS (SELECT *, list_slice({_first_sql("every", _KEY1)}, 1, 7) AS base FROM f3), f5 AS (SELECT *, base || {_later(topics.BROAD_TYPES, True)} || {_later(topics.EXHAUSTIVE_TYPES, False)} AS later FROM f4),
    f6 AS (SELECT query_id, {_first_sql("later", _KEY2)} AS plan FROM f5), f7 AS (SELECT query_id, list_filter(list_transform(plan, lambda r: struct_update(r, target_sources := list_filter(r.target_sources, lambda s: s <> 'sec_edgar'))), lambda r: len(r.target_sources) > 0) AS plan FROM f6)
    SELECT query_id, ix, {_SAID} FROM (SELECT query_id, generate_subscripts(plan, 1) - 1 AS ix, unnest(plan) AS s FROM f7)""")
def c02(spark, d):
    """Repair plans of the third round for made-up gaps, with one source unavailable."""
    none = F.array().cast("array<string>")
    g = _asked(spark, d).withColumn("hard_gaps", F.when(F.pmod("query_id", F.lit(3)) == 0, F.col("required_types")).otherwise(none)).withColumn("missing_facets", none).withColumn("selected", F.col("query_id") % 5)
    plan = planner.broadened_repair(planner.repair_plan(g).withColumn("gaps", F.col("hard_gaps")), 3)
    return planner.sub_queries(planner.without(plan, dims.strings(["sec_edgar"]))).withColumn("target_sources", F.array_join("target_sources", ","))


_GAP_STOP = _list(dims.GAP_STOPWORDS)


@query("p18_keyword_only", f"""WITH {RAW}, q AS (SELECT item_id, text AS query FROM benchmark), r AS (SELECT id, title, text, query, (ord % 7) / 10.0::DOUBLE AS relevance, (ord % 7) AS k FROM raw JOIN q ON q.item_id = raw.ord % (SELECT count(*) FROM benchmark)),
    s AS (SELECT *, list_filter(list_distinct({terms_sql('query', None, 2)}), lambda t: NOT list_contains({_GAP_STOP}, t)) AS asked, list_distinct({terms_sql("title || ' ' || text", None, 2)}) AS have FROM r)
    SELECT id, k < 2 OR (len(asked) >= 4 AND (regexp_matches(lower(title), 'about the author|author biography|editorial board|copyright|terms of use') OR (len(list_intersect(asked, have)) <= 1 AND k < 4))) AS keyword_only FROM s""")
def p18(spark, d):
    n = table(spark, d, "benchmark").count()
    r = raw_items(spark, d).withColumn("query_id", F.col("ord") % n).join(queries(spark, d), "query_id")
    return r.select("id", health._keyword_only(F.col("query"), F.col("title"), F.col("text"), (F.col("ord") % 7) / 10).alias("keyword_only"))


@query("p10_unavailable_sources", "SELECT DISTINCT user_id AS query_id, event_type AS source FROM events WHERE (user_id + ascii(event_type)) % 4 IN (1, 2)")
def p10(spark, d):
    k = (F.col("user_id") + F.ascii("event_type")) % 4
    r = table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("source"), (k == 3).alias("ok"), F.when(k == 1, "rate_limited").when(k == 0, "timeout").otherwise("unknown").alias("category"), F.when(k == 2, "API_KEY_MISSING").otherwise("X").alias("code"))
    return health.unavailable(r)


@query("c02_plan_without_failed_sources", f"""WITH {_TURNS}, {PLAN} SELECT query_id, len(list_filter(list_transform(plan, lambda r: len(list_filter(r.target_sources, lambda s: s NOT IN ('data_gov','crossref')))), lambda n: n > 0))::INT AS rows FROM pl""")
def c02_without(spark, d):
    plan = planner.without(planner.broadened(planner.first_plan(_asked(spark, d))), dims.strings(["data_gov", "crossref"]))
    return plan.select("query_id", F.size("plan").alias("rows"))


@query("a13_important_sources", f"""WITH {_TURNS}, {PLAN}, x AS (SELECT query_id, {" || ".join([f"(CASE WHEN regexp_matches(lower(query), '{p}') THEN {_list(s)} ELSE []::VARCHAR[] END)" for _, p, _, _, s in topics.GAPS if s])}
    || (CASE WHEN list_contains(required, 'filing') THEN ['sec_edgar'] ELSE []::VARCHAR[] END) || (CASE WHEN list_contains(required, 'government') THEN ['data_gov','official_docs'] ELSE []::VARCHAR[] END) AS l FROM qi)
    SELECT query_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS sources FROM x""")
def a13_sources(spark, d):
    return _asked(spark, d).select("query_id", F.array_join(planner.important_sources(F.col("query"), F.col("required_types")), ",").alias("sources"))


@query("a13_hard_and_soft", f"""WITH {_TURNS}, {PLAN}, g AS (SELECT query_id, lower(query) AS l, types, required, query_id % 2 = 0 AS ok, abs(query_id) % 3 AS sources, abs(query_id) % 2 AS prim FROM qi),
    h AS (SELECT *, regexp_matches(l, '{next(p for n, p, *_ in topics.GAPS if n == "appsec")}') AND ok AND sources >= 2 AND prim > 0 AS app, list_contains(required, 'code') AND regexp_matches(l, '{topics.NEEDS_CODE}') AS code FROM g),
    u AS (SELECT *, generate_subscripts(required, 1) AS i, unnest(required) AS g FROM h),
    v AS (SELECT query_id, i, g, CASE WHEN g = 'code' AND app THEN true WHEN g = 'encyclopedic' AND (ok OR app) THEN true WHEN g = 'forum' AND ok THEN true WHEN g = 'code' AND NOT code AND ok THEN true WHEN g = 'news' THEN true
      WHEN g IN ('primary-document','government','filing','medical') THEN false WHEN g = 'academic' AND list_has_any(types, ['academic','source-attribution']) THEN false ELSE ok END AS soft FROM u)
    SELECT query_id, coalesce(string_agg(g, ',' ORDER BY i) FILTER (WHERE NOT soft), '') AS hard, coalesce(string_agg(g, ',' ORDER BY i) FILTER (WHERE soft), '') AS soft FROM v GROUP BY query_id""")
def a13_hard(spark, d):
    i = _asked(spark, d).filter(F.size("required_types") > 0)
    hard, soft = health.classify_gaps(F.col("query"), F.col("query_types"), F.col("required_types"), F.col("required_types"), F.col("query_id") % 2 == 0, dims.strings([]), F.abs("query_id") % 3, F.abs("query_id") % 2)
    return i.select("query_id", F.array_join(hard, ",").alias("hard"), F.array_join(soft, ",").alias("soft"))
