"""Queries over scalar functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import dims
from quarry.binding import freshness_ranked, freshness_stored, raw_items, table
from quarry.functions import text as T
from quarry.functions import url as U
from quarry.functions import vector as V

WS = r"[ \t\n\r\f\v]"
QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


#: documents bound to raw items, as SQL
RAW = """raw AS (
  SELECT 'doc:' || lpad(doc_id::VARCHAR, 8, '0') AS id, doc_id AS ord, text, src AS source,
         CASE src WHEN 'sec_edgar' THEN 'filing' WHEN 'data_gov' THEN 'government' WHEN 'official_docs' THEN 'government' WHEN 'pubmed' THEN 'medical'
           WHEN 'wikipedia' THEN 'encyclopedic' WHEN 'wikidata' THEN 'structured_fact' WHEN 'github' THEN 'code' WHEN 'stack_exchange' THEN 'forum'
           WHEN 'hacker_news' THEN 'tech_discussion' ELSE 'academic' END AS source_type,
         'https://' || site || '.example.org/doc/' || doc_id AS url, substr(split_part(text, chr(10), 1), 1, 80) AS title,
         DATE '2025-01-01' - (doc_id % 4000)::INT AS publish_date
  FROM (SELECT doc_id, text, source AS site,
          (['""" + "','".join(dims.SOURCES) + """'])[(substr(source, 4)::INT % 14) + 1] AS src FROM documents))"""
STOP = "['" + "','".join(dims.SCORE_STOPWORDS) + "']"
PRE_STOP = "['" + "','".join(dims.PRERANK_STOPWORDS) + "']"


def terms_sql(c: str, stop: str | None = None, longer: int = 3) -> str:
    cond = f" AND NOT list_contains({stop}, t)" if stop else ""
    return f"list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda t: length(t) > {longer}{cond})"


def words_sql(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '{WS}+'), lambda w: w <> '')"


def tokens_sql(c: str, least: int = 1) -> str:
    return f"(CASE WHEN len({words_sql(c)}) = 0 THEN 0 ELSE greatest({least}, ceil(len({words_sql(c)}) * 1.33::DOUBLE)) END)::BIGINT"


def _html_sql(c: str, *tail: tuple[str, str]) -> str:
    s = c
    for p, r in [("(?is)<script.*?</script>", " "), ("(?is)<style.*?</style>", " "), ("<[^>]+>", " "), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), *tail]:
        s = f"regexp_replace({s}, '{p}', '{r}', 'g')"
    return f"regexp_replace({s}, '^{WS}+|{WS}+$', '', 'g')"


@query("f01_clean_html", f"SELECT page_id, {_html_sql('html', (chr(92) + 'r' + chr(92) + 'n?', chr(10)), ('[ ' + chr(92) + 't]+', ' '), (chr(92) + 'n{3,}', chr(10) * 2))} AS body FROM pages")
def f01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.clean_html(F.col("html")).alias("body"))


@query("f02_strip_html", f"SELECT page_id, {_html_sql('html', (WS + '+', ' '))} AS body FROM pages")
def f02(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("body"))


@query("f05_token_estimate", f"SELECT doc_id, {tokens_sql('text')} AS tokens, {tokens_sql('text', 0)} AS tokens_ui FROM documents")
def f05(spark, d):
    return table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"), T.token_estimate(F.col("text"), 0).alias("tokens_ui"))


@query("f06_truncate", f"SELECT doc_id, CASE WHEN len({words_sql('text')}) <= 75 THEN text ELSE array_to_string(list_slice({words_sql('text')}, 1, 75), ' ') || '...' END AS cut FROM documents")
def f06(spark, d):
    return table(spark, d, "documents").select("doc_id", T.truncate_to_budget(F.col("text"), 100).alias("cut"))


CHUNKS = (
    """marked AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(text, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g'), '\\n{2,}', chr(1), 'g'), '\\.[ \\t\\n\\r\\f\\v]+([A-Z0-9])', '.' || chr(1) || '\\1', 'g') AS m FROM raw),
parts AS (SELECT id, list_filter(list_transform(string_split(m, chr(1)), lambda p: regexp_replace(p, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g')), lambda p: p <> '') AS ps FROM marked),
para AS (SELECT id, generate_subscripts(ps, 1) AS i, unnest(ps) AS p FROM parts),
sized AS (SELECT id, i, p, """
    + tokens_sql("p")
    + """ AS tok FROM para),
fold AS (
  SELECT id, i, p, 0::BIGINT AS n, tok AS cur, (tok >= 500 AND tok >= 750) AS full_ FROM sized WHERE i = 1
  UNION ALL
  SELECT s.id, s.i, s.p, CASE WHEN f.full_ OR (f.cur > 0 AND f.cur + s.tok > 1000) THEN f.n + 1 ELSE f.n END,
         CASE WHEN f.full_ OR (f.cur > 0 AND f.cur + s.tok > 1000) THEN s.tok ELSE f.cur + s.tok END,
         (CASE WHEN f.full_ OR (f.cur > 0 AND f.cur + s.tok > 1000) THEN s.tok ELSE f.cur + s.tok END) >= 750
  FROM fold f JOIN sized s ON s.id = f.id AND s.i = f.i + 1),
chunk AS (SELECT id || ':chunk:' || lpad(n::VARCHAR, 4, '0') AS chunk_id, id AS item_id, n, string_agg(p, chr(10) || chr(10) ORDER BY i) AS content FROM fold GROUP BY id, n)"""
)


@query("f07_chunk_split", f"WITH RECURSIVE {RAW}, {CHUNKS} SELECT chunk_id, item_id, {tokens_sql('content')} AS tokens, md5(content) AS digest FROM chunk")
def f07(spark, d):
    from quarry.binding import chunks

    return chunks(raw_items(spark, d), dims.NOW).select("chunk_id", "item_id", "tokens", F.md5("content").alias("digest"))


@query("f09_tokens", f"SELECT doc_id, array_to_string({terms_sql('text', PRE_STOP)}, ' ') AS prerank, array_to_string({terms_sql('text', STOP)}, ' ') AS scored, len(list_distinct({terms_sql('text', None, 2)}))::INT AS gap_terms FROM documents")
def f09(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.array_join(T.terms(c, 3, dims.PRERANK_STOPWORDS), " ").alias("prerank"), F.array_join(T.terms(c, 3, dims.SCORE_STOPWORDS), " ").alias("scored"), F.size(F.array_distinct(T.terms(c, 2))).alias("gap_terms"))


@query("f11_normalized", "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS norm, sha1(substr(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), 1, 900)) AS digest FROM documents")
def f11(spark, d):
    n = T.normalized(F.col("text"))
    return table(spark, d, "documents").select("doc_id", n.alias("norm"), F.sha1(F.substring(n, 1, 900)).alias("digest"))


KEY = r"substr(trim(regexp_replace(regexp_replace(lower({c}), '[^A-Za-z0-9_ \t\n\r\f\v./:-]', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')), 1, {n})"


@query("f12_content_key", f"SELECT doc_id, {KEY.format(c='text', n=2000)} AS key FROM documents")
def f12(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_key(F.col("text")).alias("key"))


@query(
    "f13_jaccard_to_benchmark",
    f"""WITH d AS (SELECT doc_id, list_distinct({terms_sql('text')}) AS a FROM documents), b AS (SELECT item_id, list_distinct({terms_sql('text')}) AS b FROM benchmark),
    hit AS (SELECT doc_id, item_id, count(*) AS n FROM (SELECT doc_id, unnest(a) AS t FROM d) JOIN (SELECT item_id, unnest(b) AS t FROM b) USING (t) GROUP BY ALL)
    SELECT doc_id, item_id, round(n / (len(a) + len(b) - n)::DOUBLE, 6) AS jaccard, round(n / least(len(a), len(b))::DOUBLE, 6) AS overlap FROM hit JOIN d USING (doc_id) JOIN b USING (item_id)""",
)
def f13(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.array_distinct(T.terms(F.col("text"))).alias("a"))
    items = table(spark, d, "benchmark").select("item_id", F.array_distinct(T.terms(F.col("text"))).alias("b"))
    right = items.select("item_id", F.size("b").alias("nb"), F.explode("b").alias("t"))
    left = docs.select("doc_id", F.size("a").alias("na"), F.explode("a").alias("t")).join(right.select("t").distinct(), "t", "left_semi")
    n = F.col("n")
    hit = left.join(right, "t").groupBy("doc_id", "item_id", "na", "nb").agg(F.count(F.lit(1)).alias("n"))
    return hit.select("doc_id", "item_id", F.round(n / (F.col("na") + F.col("nb") - n), 6).alias("jaccard"), F.round(n / F.least("na", "nb"), 6).alias("overlap"))


@query("f16_first_sentence", r"""SELECT doc_id, substr(CASE WHEN s <> '' THEN s ELSE text END, 1, 240) AS claim FROM
    (SELECT doc_id, text, string_split(regexp_replace(text, '\.[ \t\n\r\f\v]+', '.' || chr(1), 'g'), chr(1))[1] AS s FROM documents)""")
def f16(spark, d):
    return table(spark, d, "documents").select("doc_id", T.first_sentence(F.col("text")).alias("claim"))


@query("f22_slug", "SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, CASE WHEN length(text) > 100 THEN rtrim(substr(text, 1, 100)) || ' [truncated]' ELSE text END AS short FROM documents")
def f22(spark, d):
    short = F.when(F.length("text") > 100, F.concat(F.rtrim(F.substring("text", 1, 100)), F.lit(" [truncated]"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"), short.alias("short"))


@query("s26_item_id", """SELECT doc_id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(source || '/' || doc_id, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)::BIGINT AS hash FROM documents""")
def s26(spark, d):
    return table(spark, d, "documents").select("doc_id", T.fnv1a(F.concat_ws("/", "source", F.col("doc_id").cast("string"))).alias("hash"))


PARTS = r"""p AS (SELECT page_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$', 2) AS host,
    regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$', 1) AS scheme,
    regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$', 3) AS path,
    regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$', 4) AS query FROM pages)"""


@query("f31_normalized_url", f"""WITH {PARTS}, k AS (SELECT *, list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT list_contains(['{"','".join(dims.TRACKING)}'], lower(split_part(x, '=', 1)))) AS kept FROM p)
    SELECT page_id, lower(scheme) || '://' || lower(host) || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END AS url FROM k""")
def f31(spark, d):
    return table(spark, d, "pages").select("page_id", U.normalized_url(F.col("url"), F.lit("wikipedia")).alias("url"))


@query("f32_prerank_url", f"WITH {PARTS} SELECT page_id, lower(regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '')) AS url FROM p")
def f32(spark, d):
    return table(spark, d, "pages").select("page_id", U.prerank_url(F.col("url")).alias("url"))


@query("f30_evidence_key", f"""WITH {RAW} SELECT id, CASE WHEN ord % 7 = 0 THEN 'doi:10.1000/x' || ord WHEN ord % 7 = 1 THEN 'arxiv:2101.' || lpad(ord::VARCHAR, 5, '0') WHEN ord % 7 = 2 THEN 'github:owner/repo' || ord
    WHEN source_type = 'academic' AND title <> '' THEN 'title:' || trim(regexp_replace(lower(title), '{WS}+', ' ', 'g')) ELSE url END AS key FROM raw""")
def f30(spark, d):
    r = raw_items(spark, d)
    n = F.col("ord").cast("string")
    doi = F.when(F.col("ord") % 7 == 0, F.concat(F.lit("https://doi.org/10.1000/X"), n))
    link = F.when(F.col("ord") % 7 == 1, F.concat(F.lit("https://arxiv.org/pdf/2101."), F.lpad(n, 5, "0"), F.lit(".pdf"))).when(F.col("ord") % 7 == 2, F.concat(F.lit("https://github.com/Owner/Repo"), n, F.lit(".git"))).otherwise(F.col("url"))
    return r.select("id", U.evidence_key(link, F.col("source"), F.col("source_type"), F.col("title"), doi).alias("key"))


@query("f33_document_key", f"WITH {RAW} SELECT id, concat_ws('::', source, regexp_replace(substr(url, 9), '/+$', ''), nullif(lower(trim(title)), ''), strftime(publish_date, '%Y-%m-%d')) AS key FROM raw")
def f33(spark, d):
    r = raw_items(spark, d)
    return r.select("id", U.document_key(*(F.col(c) for c in ("source", "url", "title", "author", "publish_date"))).alias("key"))


@query("f34_document_type", f"""WITH {RAW} SELECT id, CASE WHEN source_type = 'code' THEN 'repository' WHEN source_type = 'filing' THEN 'filing' WHEN source_type = 'government' THEN 'dataset'
    WHEN source_type = 'academic' THEN 'paper' ELSE 'html' END AS document_type FROM raw""")
def f34(spark, d):
    return raw_items(spark, d).select("id", U.document_type(F.col("url"), F.col("source"), F.col("source_type")).alias("document_type"))


@query("f35_fingerprints", "SELECT doc_id, sha1(text) AS full_, substr(sha1(text), 1, 12) AS first12, substr(sha1(text), 1, 16) AS first16 FROM documents")
def f35(spark, d):
    s = F.sha1("text")
    return table(spark, d, "documents").select("doc_id", s.alias("full_"), F.substring(s, 1, 12).alias("first12"), F.substring(s, 1, 16).alias("first16"))


@query("f38_freshness", """WITH a AS (SELECT o_orderkey, (epoch_us(TIMESTAMP '1998-01-01') - epoch_us(o_orderdate)) / 8.64e10 AS age FROM orders)
    SELECT o_orderkey, CASE WHEN age < 0 THEN 0.8 WHEN age < 30 THEN 1.0 WHEN age < 365 THEN 0.85 WHEN age < 1825 THEN 0.7 ELSE 0.55 END::DOUBLE AS stored,
    CASE WHEN greatest(0, age) <= 365 THEN 1.0 WHEN age <= 1095 THEN 0.78 WHEN age <= 2920 THEN 0.6 ELSE 0.45 END::DOUBLE AS ranked FROM a""")
def f38(spark, d):
    ts, now = F.col("o_orderdate").cast("timestamp"), "1998-01-01 00:00:00"
    return table(spark, d, "orders").select("o_orderkey", freshness_stored(ts, now).cast("double").alias("stored"), freshness_ranked(ts, now).cast("double").alias("ranked"))


@query("f40_rounding", "SELECT l_orderkey, l_linenumber, floor(l_extendedprice * l_discount * 10000 + 0.5) / 10000 AS r4, floor(least(100, greatest(0, l_discount * 1000)) + 0.5)::BIGINT AS pct FROM lineitem")
def f40(spark, d):
    x = F.col("l_extendedprice") * F.col("l_discount")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", V.half_up(x, 4).alias("r4"), F.floor(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("l_discount") * 1000)) + 0.5).alias("pct"))


@query("f41_cosine_topk", """WITH q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT q, vec_id, round(list_cosine_similarity(e::DOUBLE[], embedding::DOUBLE[]), 6) AS cosine FROM q JOIN embeddings ON vec_id <> q)
    SELECT q, vec_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, vec_id) AS r FROM s) WHERE r <= 5""")
def f41(spark, d):
    e = table(spark, d, "embeddings")
    return V.in_blocks(e.filter("vec_id % 50 = 0"), e, "vec_id", top=5)  # the stated query set, against all rows


@query("f42_mean_vectors", """WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT label, i, avg(v) AS v FROM x GROUP BY ALL)
    SELECT label, count(*)::BIGINT AS dims, round(sqrt(sum(v * v)), 6) AS norm FROM m GROUP BY label""")
def f42(spark, d):
    x = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    m = x.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return m.groupBy("label").agg(F.count(F.lit(1)).alias("dims"), F.round(F.sqrt(F.sum(F.col("v") * F.col("v"))), 6).alias("norm"))


@query("f43_hash_embedding")
def f43(spark, d):
    return table(spark, d, "documents").select("doc_id", V.hash_embedding()(F.col("text")).alias("embedding"))


@query("f44_signed_hash_embedding")
def f44(spark, d):
    return table(spark, d, "benchmark").select("item_id", V.signed_hash_embedding()(F.col("text")).alias("embedding"))


@query("f45_json_coercion", """SELECT event_id, greatest(0, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0))::BIGINT AS k, try_cast(json_extract_string(props, '$.missing') AS DOUBLE) AS missing FROM events""")
def f45(spark, d):
    k = F.coalesce(F.expr("try_cast(get_json_object(props, '$.k') AS DOUBLE)"), F.lit(0.0))
    return table(spark, d, "events").select("event_id", F.greatest(F.lit(0.0), k).cast("long").alias("k"), F.expr("try_cast(get_json_object(props, '$.missing') AS DOUBLE)").alias("missing"))


@query("f46_map_counts", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def f46(spark, d):
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    m = e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return m.select("user_id", F.explode("m").alias("event_type", "n"))


@query("f37_iso_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS parsed FROM orders")
def f37(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 3 == 0, "not a date").otherwise(day)
    return table(spark, d, "orders").select("o_orderkey", day.alias("day"), F.date_format(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), "yyyy-MM-dd").alias("parsed"))


@query("f23_formats", "SELECT event_id, CASE WHEN value >= 1 THEN format('{:.1f} s', floor(value * 10 + 0.5) / 10) ELSE format('{:.0f} ms', floor(value * 1000 + 0.5)) END AS duration FROM events")
def f23(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.when(v >= 1, F.format_string("%.1f s", V.half_up(v, 1))).otherwise(F.format_string("%.0f ms", F.floor(v * 1000 + 0.5).cast("double"))).alias("duration"))
