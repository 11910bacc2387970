"""Queries over connectors, the event stream and sinks. Payloads are recorded from the documents table, then parsed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry import dims
from quarry.binding import table
from quarry.plans.scalars import WS, _html_sql
from quarry.shared import shared_dir
from quarry.sources import connectors
from quarry.streaming import events

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


BODY = "text"


def _strip(sql: str) -> str:
    return _html_sql(sql, (WS + "+", " "))


#: by source: the payload as a Spark SQL expression over documents, and url, title, author, published, text as DuckDB SQL
RECORDED = {
    "wikipedia": ("named_struct('pages', array(named_struct('id', doc_id, 'key', concat('D', doc_id), 'title', source, 'excerpt', b, 'description', lang)))", ["'https://en.wikipedia.org/wiki/D' || doc_id", "source", "NULL::VARCHAR", "NULL::VARCHAR", _strip(f"source || ' ' || lang || CASE WHEN {BODY} = '' THEN '' ELSE ' ' || {BODY} END")]),
    "semantic_scholar": ("named_struct('data', array(named_struct('paperId', concat('p', doc_id), 'title', source, 'abstract', b, 'url', concat('https://s2.example.org/', doc_id), 'year', 2000 + doc_id % 20, 'authors', array(named_struct('name', 'A'), named_struct('name', lang)))))", ["'https://s2.example.org/' || doc_id", "source", "'A, ' || lang", "(2000 + doc_id % 20) || '-01-01'", _strip(BODY)]),
    "core": ("named_struct('results', array(named_struct('id', concat('c', doc_id), 'title', source, 'abstract', b, 'authors', array(named_struct('name', lang)), 'publishedDate', '2020-02-03', 'doi', concat('10.1/', doc_id))))", ["'https://doi.org/10.1/' || doc_id", "source", "lang", "'2020-02-03'", _strip(BODY)]),
    "crossref": ("named_struct('message', named_struct('items', array(named_struct('DOI', concat('10.2/', doc_id), 'title', array(source), 'abstract', b, 'author', array(named_struct('given', 'G', 'family', lang)), 'published-print', named_struct('date-parts', array(array(2010, doc_id % 12 + 1)))))))", ["'https://doi.org/10.2/' || doc_id", "source", "'G ' || lang", "'2010-' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') || '-01'", _strip(BODY)]),
    "stack_exchange": ("named_struct('items', array(named_struct('question_id', doc_id, 'title', source, 'link', concat('https://se.example.org/q/', doc_id), 'owner', named_struct('display_name', lang), 'creation_date', 86400 * doc_id, 'body', b)))", ["'https://se.example.org/q/' || doc_id", "source", "lang", "strftime(DATE '1970-01-01' + doc_id::INT, '%Y-%m-%d')", _strip(BODY)]),
    "hacker_news": ("named_struct('hits', array(named_struct('objectID', cast(doc_id AS string), 'story_title', source, 'author', lang, 'created_at', '2024-01-02', 'comment_text', b)))", ["'https://news.ycombinator.com/item?id=' || doc_id", "source", "lang", "'2024-01-02'", _strip(BODY)]),
    "github": ("named_struct('items', array(named_struct('id', doc_id, 'full_name', concat(source, '/', doc_id), 'html_url', concat('https://github.com/', source, '/', doc_id), 'description', b, 'updated_at', '2024-03-04', 'owner', named_struct('login', source), 'language', lang)))", ["'https://github.com/' || source || '/' || doc_id", "source || '/' || doc_id", "source", "'2024-03-04'", _strip(f"CASE WHEN {BODY} = '' THEN '' ELSE {BODY} || ' ' END || lang")]),
    "wikidata": ("named_struct('results', named_struct('bindings', array(named_struct('item', named_struct('value', concat('https://www.wikidata.org/entity/Q', doc_id)), 'itemLabel', named_struct('value', source), 'itemDescription', named_struct('value', b)))))", ["'https://www.wikidata.org/entity/Q' || doc_id", "source", "NULL::VARCHAR", "NULL::VARCHAR", _strip(f"source || CASE WHEN {BODY} = '' THEN '' ELSE ' ' || {BODY} END")]),
    "sec_edgar": ("named_struct('hits', named_struct('hits', array(named_struct('_id', concat('0001-24-', doc_id, ':doc.htm'), '_source', named_struct('ciks', array(concat('000', doc_id + 1)), 'file_date', '2024-05-06', 'form', '10-K', 'display_names', array(source), 'adsh', concat('0001-24-', doc_id))))))", ["'https://www.sec.gov/Archives/edgar/data/' || (doc_id + 1) || '/000124' || doc_id || '/doc.htm'", "'10-K - ' || source", "source", "'2024-05-06'", "'10-K ' || source"]),
    "data_gov": ("named_struct('results', array(named_struct('slug', concat('d-', doc_id), 'title', source, 'description', b, 'publisher', lang)))", ["'https://catalog.data.gov/dataset/d-' || doc_id", "source", "lang", "NULL::VARCHAR", _strip(BODY)]),
    "openalex": ("named_struct('results', array(named_struct('id', concat('W', doc_id), 'display_name', source, 'publication_date', '2021-01-01', 'abstract_inverted_index', map('beta', array(1), source, array(0, 2)))))", ["'W' || doc_id", "source", "NULL::VARCHAR", "'2021-01-01'", "source || ' beta ' || source"]),
}


def _connector(source: str, payload: str):
    def run(spark, d):
        docs = table(spark, d, "documents").withColumn("b", F.col("text"))
        recorded = docs.select(F.to_json(F.expr(payload)).alias("payload"))
        return connectors.parse(recorded, source).select("source_type", "url", "title", "author", "published", F.col("text").alias("body"))

    return run


for _i, (_source, (_payload, _columns)) in enumerate(RECORDED.items()):
    _type = dims.SOURCE_TYPES.get(_source, "academic")
    _name = f"s{[3, 5, 8, 9, 10, 11, 12, 14, 15, 16, 7][_i]:02d}_{_source}"
    QUERIES[_name] = _connector(_source, _payload)
    SQL[_name] = f"SELECT '{_type}' AS source_type, " + ", ".join(f"{c} AS {n}" for c, n in zip(_columns, ["url", "title", "author", "published", "body"], strict=True)) + " FROM documents"


_ESCAPED = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("s04_arxiv", f"SELECT 'https://arxiv.org/abs/' || doc_id AS url, source AS title, 'A, ' || lang AS author, '2020-01-01' AS published, {_strip(_ESCAPED)} AS body FROM documents")
def s04(spark, d):
    text = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    entry = F.format_string("<feed><entry><id>https://arxiv.org/abs/%s</id><title>%s</title><summary>%s</summary><published>2020-01-01</published><author><name>A</name></author><author><name>%s</name></author></entry></feed>", F.col("doc_id").cast("string"), F.col("source"), text, F.col("lang"))
    return connectors.parse(table(spark, d, "documents").select(entry.alias("payload")), "arxiv").select("url", "title", "author", "published", F.col("text").alias("body"))


@query("s06_pubmed", "SELECT 'https://pubmed.ncbi.nlm.nih.gov/' || doc_id || '/' AS url, source AS title, '10.3/' || doc_id AS doi FROM documents")
def s06(spark, d):
    payload = "named_struct('result', map(cast(doc_id AS string), named_struct('title', source, 'pubdate', '2020', 'articleids', array(named_struct('idtype', 'pii', 'value', 'x'), named_struct('idtype', 'doi', 'value', concat('10.3/', doc_id))))))"
    recorded = table(spark, d, "documents").select(F.array(F.lit("absent"), F.col("doc_id").cast("string")).alias("ids"), F.to_json(F.expr(payload)).alias("payload"))
    return connectors.parse(recorded, "pubmed").select("url", "title", "doi")


@query("s02_registry", "SELECT * FROM (VALUES " + ",".join(f"('{s}', '{dims.SOURCE_TYPES.get(s, 'academic')}', {w}::DOUBLE)" for s, w in dims.SOURCE_WEIGHTS.items()) + ") t(source, source_type, weight)")
def s02(spark, d):
    return dims.registry(spark)


@query("s13_compact_query")
def s13(spark, d):
    return table(spark, d, "benchmark").select("item_id", connectors.compact_query(F.col("text")).alias("compact"))


@query("s12_most_starred", "SELECT user_id, string_agg('r' || event_id, ',' ORDER BY stars DESC, event_id) AS repos FROM (SELECT *, (event_id * 37) % 101 AS stars FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (event_id * 37) % 101 DESC, event_id) <= 5) GROUP BY 1")
def s12_starred(spark, d):
    """Repositories of a response by stars, at most five."""
    e = table(spark, d, "events").withColumn("stars", (F.col("event_id") * 37 % 101).cast("int"))
    one = F.struct(F.col("event_id").alias("id"), F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("full_name"), F.lit("https://github.com/o/r").alias("html_url"), F.col("stars").alias("stargazers_count"))
    responses = e.groupBy("user_id").agg(F.array_sort(F.collect_list(one)).alias("items")).select("user_id", F.to_json(F.struct("items")).alias("payload"))
    found = connectors.parse(responses, "github", 5, keep=("user_id",))
    return found.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]), ",").alias("repos"))


@query("s16_query_variants", """WITH q AS (SELECT item_id, text || (['', ' crude and cpi', ' jobs and gdp', ' inflation'])[item_id % 4 + 1] AS t FROM benchmark), v AS (SELECT item_id, [trim(t)] || (CASE WHEN regexp_matches(lower(t), '(oil|crude|wti|brent|petroleum|gasoline|fuel)') THEN ['oil prices', 'Short-Term Energy Outlook petroleum prices', 'crude oil', 'petroleum prices'] ELSE [] END)
    || (CASE WHEN regexp_matches(lower(t), '(inflation|cpi|prices|consumer price)') THEN ['consumer price index', 'inflation'] ELSE [] END) || (CASE WHEN regexp_matches(lower(t), '(employment|jobs|unemployment|labor)') THEN ['unemployment', 'employment'] ELSE [] END) || (CASE WHEN regexp_matches(lower(t), '(gdp|gross domestic product|economic growth)') THEN ['gross domestic product', 'GDP'] ELSE [] END) AS l FROM q)
    SELECT item_id, array_to_string(list_slice(l, 1, 5), '|') AS variants FROM v""")
def s16_variants(spark, d):
    tail = F.element_at(dims.strings(["", " crude and cpi", " jobs and gdp", " inflation"]), (F.col("item_id") % 4 + 1).cast("int"))
    return table(spark, d, "benchmark").select("item_id", F.array_join(connectors.query_variants(F.concat("text", tail)), "|").alias("variants"))


@query("s16_first_non_empty", "SELECT user_id, min(event_id) AS chosen FROM events WHERE event_type <> 'error' GROUP BY 1")
def s16_first(spark, d):
    r = table(spark, d, "events").select("user_id", F.col("event_id").alias("variant"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("items"))
    return connectors.first_non_empty(r, "user_id").filter("items > 0").select("user_id", F.col("variant").alias("chosen"))


@query("s08_disabled_sources", "SELECT * FROM (VALUES ('core', 'CORE_API_KEY_MISSING', false), ('sec_edgar', 'SEC_USER_AGENT_MISSING', false)) t(source, code, retryable)")
def s08_disabled(spark, d):
    return connectors.disabled(dims.registry(spark), {}).select("source", "code", "retryable")


@query("s05_retry_budget", "SELECT user_id, least(2, count(*) FILTER (WHERE event_type = 'error')) AS retries, count(*) FILTER (WHERE event_type = 'error') > 2 AS gave_up FROM events GROUP BY 1")
def s05_retries(spark, d):
    tries = table(spark, d, "events").select(F.col("user_id").alias("task"), F.when(F.col("event_type") == "error", "HTTP_429").alias("code"))
    return connectors.retried(tries, "task", 2).select(F.col("task").alias("user_id"), "retries", "gave_up")


@query("s24_failures_as_rows", "SELECT doc_id, doc_id % 3 = 0 AS ok, CASE WHEN doc_id % 3 = 1 THEN 'MALFORMED_PAYLOAD' WHEN doc_id % 3 = 2 THEN 'MISSING_FIELD' END AS code FROM documents")
def s24(spark, d):
    payload = F.when(F.col("doc_id") % 3 == 0, '{"items": []}').when(F.col("doc_id") % 3 == 1, "oops").otherwise('{"other": 1}')
    return connectors.fetch(table(spark, d, "documents").select("doc_id", payload.alias("payload")), "github", "doc_id").select("doc_id", "ok", "code")


@query("s27_error_classes", "SELECT * FROM (VALUES ('HTTP_429', 'rate_limited'), ('CORE_API_KEY_MISSING', 'missing_config'), ('HTTP_400', 'query_invalid'), ('TIMEOUT', 'timeout'), ('HTTP_503', 'unavailable'), ('X', 'unknown')) t(code, category)")
def s27(spark, d):
    codes = spark.createDataFrame([(c,) for c in ("HTTP_429", "CORE_API_KEY_MISSING", "HTTP_400", "TIMEOUT", "HTTP_503", "X")], "code string")
    return codes.select("code", connectors.classify_error(F.col("code"), F.lit("")).alias("category"))


def _checkpoint(spark) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


@query("c13_stream_hourly", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def c13(spark, d):
    stream = events.hourly(events.read_stream(spark, d)).drop("total")
    out = events.run_once(stream, "complete", _checkpoint(spark))
    return out.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query("c07_stream_reliability", """SELECT user_id, round(3.3 + sum(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 0.2 WHEN 'error' THEN 0 ELSE 0.05 END)::DOUBLE, 6) AS alpha FROM events GROUP BY 1""")
def c07(spark, d):
    raw = spark.readStream.schema(events.SCHEMA).option("pathGlobFilter", "events.parquet").parquet(d)
    out = events.run_once(events.reliability_stream(raw), "update", _checkpoint(spark))
    return out.groupBy("user_id").agg(F.max_by("alpha", F.struct("batch", F.col("alpha") + F.col("beta"))).alias("alpha")).select("user_id", F.round("alpha", 6).alias("alpha"))


@query("k02_feedback_view", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS vote FROM events GROUP BY 1")
def k02(spark, d):
    from quarry.sources.files import with_feedback

    e = table(spark, d, "events")
    runs = e.select(F.col("user_id").alias("run_id")).distinct()
    feedback = e.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("vote"), F.lit("").alias("note"), F.struct("ts", "event_id").alias("updated_at"))
    return with_feedback(runs, feedback).select(F.col("run_id").alias("user_id"), "vote")


@query("k04_gold_round_trip", "SELECT 'Q' || (item_id % 5) AS question, 'facts' AS section, 'f' || item_id AS id, trim(replace(text, chr(10), ' ')) AS fact FROM benchmark")
def k04(spark, d):
    from quarry.sources.files import parse_gold_markdown, to_gold_markdown

    b = table(spark, d, "benchmark")
    facts = b.select(F.concat(F.lit("Q"), (F.col("item_id") % 5).cast("string")).alias("question"), F.lit("facts").alias("section"), F.concat(F.lit("f"), F.col("item_id").cast("string")).alias("id"), F.trim(F.translate("text", "\n", " ")).alias("text"), F.lit(1.0).alias("weight"))
    lines = to_gold_markdown(facts).select(F.col("question").alias("file"), F.posexplode(F.split("markdown", "\n")).alias("n", "value"))
    return parse_gold_markdown(lines).select("question", "section", "id", F.col("text").alias("fact"))
