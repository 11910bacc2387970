"""Queries over extraction, answers, gold scores, costs, stores and curated sources, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import dims
from quarry.binding import queries, table
from quarry.functions import text as T
from quarry.functions.pdf import text_of_pdf
from quarry.operators import answers, costs, extraction, gold, stores
from quarry.plans import evidence
from quarry.plans.relational import _list
from quarry.plans.scalars import RAW, WS, _html_sql, terms_sql, tokens_sql
from quarry.sources import curated

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- extraction ---------------------------------------------------------------------------------------------------------


def _page_items(spark, d):
    """Pages as raw items: a short text by every second source, the addresses of some lead nowhere."""
    i = F.col("page_id")
    source = F.element_at(dims.strings(dims.SOURCES), (i % len(dims.SOURCES) + 1).cast("int"))
    p = table(spark, d, "pages").select("page_id", "html", F.concat("url", F.when(i % 3 == 2, "/gone").otherwise("")).alias("url"), source.alias("source"))
    return p.select(
        F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("id"), F.col("page_id").alias("ord"), (F.col("page_id") % 10).alias("group_id"), "source", dims.lookup(dims.SOURCE_TYPES, F.col("source"), "academic").alias("source_type"), "url",
        F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"), F.lit(None).cast("string").alias("author"), F.lit(None).cast("timestamp").alias("publish_date"), F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise("A short text.").alias("text"), F.lit(None).cast("string").alias("summary"),
    )


@query("c05_documents")
def c05(spark, d):
    found = extraction.documents(_page_items(spark, d), table(spark, d, "pages"))
    return found.select("group_id", "document_key", "document_type", "items", "status", "method", "attempts", "deepened", "degradation_reason", F.length("text").alias("chars"), F.sha1("text").alias("digest"))


@query("a03_extraction_counters")
def a03(spark, d):
    found = extraction.documents(_page_items(spark, d), table(spark, d, "pages"))
    once = extraction.counters(found)
    return extraction.merged(once, once)


@query("c05_evidence_from_pages")
def c05_evidence(spark, d):
    """The evidence plan over pages: short items are looked up, and degraded texts count for less."""
    items = _page_items(spark, d).drop("group_id")
    e = evidence.Evidence(queries(spark, d), items, pages=table(spark, d, "pages"))
    return e.scored.select("query_id", "chunk_id", "status", "degraded", F.round("confidence", 6).alias("confidence"), F.round("relevance", 6).alias("relevance"), "how")


@query("f08_item_parts", "SELECT doc_id, array_to_string(list_filter([source, lang, text], lambda x, i: x <> '' AND list_position([source, lang, text], x) = i), chr(10) || chr(10)) AS body FROM documents")
def f08(spark, d):
    return table(spark, d, "documents").select("doc_id", T.item_parts(F.col("source"), F.col("lang"), F.col("text")).alias("body"))


@query("f03_main_text")
def f03(spark, d):
    return table(spark, d, "pages").select("page_id", extraction.readable(F.col("html")).alias("body"))


_PDF_LETTERS = 3600  # letters a page


def _pdf(text):
    """A PDF file (binary Column) that shows a text in pages: fonts with two-byte codes and a map to Unicode."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / _PDF_LETTERS)).cast("int")
    each = lambda f: F.transform(F.sequence(F.lit(0), n - 1), f)
    ref = lambda i, at: (i * 2 + at).cast("string")
    shown = lambda i: F.hex(F.encode(F.substr(text, i * _PDF_LETTERS + 1, F.lit(_PDF_LETTERS)), "UTF-16BE"))
    page = each(lambda i: F.concat(ref(i, 5), F.lit(" 0 obj\n<< /Type /Page /Parent 2 0 R /Contents "), ref(i, 6), F.lit(" 0 R >>\nendobj\n"), ref(i, 6), F.lit(" 0 obj\n<< >>\nstream\nBT /F1 9 Tf 20 800 Td <"), shown(i), F.lit("> Tj ET\nendstream\nendobj\n")))
    cmap = "4 0 obj\n<< >>\nstream\n1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange\nendstream\nendobj\n"
    head = F.concat(F.lit("%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Resources << /Font << /F1 3 0 R >> >> /Count "), n.cast("string"), F.lit(" /Kids ["), F.array_join(each(lambda i: F.concat(ref(i, 5), F.lit(" 0 R"))), " "), F.lit("] >>\nendobj\n3 0 obj\n<< /Type /Font /Subtype /Type0 /ToUnicode 4 0 R >>\nendobj\n" + cmap))
    return F.concat(head, F.array_join(page, ""), F.lit("trailer << /Root 1 0 R >>\n%%EOF\n")).cast("binary")


@query("f04_pdf_text", f"""WITH s AS (SELECT page_id, unnest(range(8)) AS i, html FROM pages),
    t AS (SELECT page_id, i, trim(regexp_replace(substr(html, i * {_PDF_LETTERS} + 1, {_PDF_LETTERS}), '[ \t\n\v\f\r]+', ' ', 'g'), ' ') AS body FROM s)
    SELECT page_id, page_id % 7 <> 3 AS ok, CASE WHEN page_id % 7 <> 3 THEN coalesce(string_agg(body, ' ' ORDER BY i) FILTER (body <> ''), '') END AS body FROM t GROUP BY page_id""")
def f04(spark, d):
    """Sources of pages shown as PDF files, of which some are cut off, and read again; of a file the first eight pages count."""
    p = table(spark, d, "pages").withColumn("pdf", _pdf(F.coalesce("html", F.lit(""))))
    cut = F.when(F.col("page_id") % 7 == 3, F.substring("pdf", 1, 200)).otherwise(F.col("pdf"))
    return p.select("page_id", text_of_pdf(cut).alias("body")).select("page_id", F.col("body").isNotNull().alias("ok"), "body")


_SAID = _html_sql("(title || chr(10) || chr(10) || text)", (WS + "+", " "))


@query("z06_status_ladder", f"""WITH {RAW}, s AS (SELECT id, source, source_type, {_SAID} AS whole FROM raw), u AS (SELECT *, CASE WHEN length(whole) > 30000 THEN trim(substr(whole, 1, 30000)) ELSE whole END AS said FROM s),
    v AS (SELECT *, CASE WHEN length(said) >= 1200 THEN 'full_text' WHEN length(said) >= 300 AND source IN ({_list(extraction.THIN)[1:-1]}) THEN 'structured_abstract' WHEN trim(said) <> '' THEN 'snippet' ELSE 'metadata_only' END AS own,
      CASE WHEN length(said) >= 1200 THEN 'full_text' WHEN length(said) >= 300 THEN 'section_text' WHEN trim(said) <> '' THEN 'snippet' ELSE 'metadata_only' END AS page FROM u)
    SELECT id, length(said) AS chars, own, page, CASE own {" ".join(f"WHEN '{k}' THEN {v}" for k, v in extraction.CONFIDENCE.items())} END::DOUBLE AS confidence, CASE own {" ".join(f"WHEN '{k}' THEN {v}" for k, v in extraction.COVERAGE.items())} END::DOUBLE AS coverage,
      CASE own WHEN 'structured_abstract' THEN 'Only an abstract was to be had.' WHEN 'snippet' THEN 'Only a snippet or short text was to be had.' WHEN 'metadata_only' THEN 'Only metadata of a ' || source_type || ' was to be had.' END AS reason FROM v""")
def z06(spark, d):
    from quarry.binding import raw_items

    said = extraction.truncated(extraction.composed(F.col("title"), F.col("summary"), F.col("text")))
    r = raw_items(spark, d).withColumn("said", said).withColumn("own", extraction.structured_status(F.col("said"), F.col("source")))
    return r.select("id", F.length("said").alias("chars"), "own", extraction.page_status(F.col("said")).alias("page"), dims.lookup(extraction.CONFIDENCE, F.col("own")).alias("confidence"), dims.lookup(extraction.COVERAGE, F.col("own")).alias("coverage"), extraction.degradation(F.col("own"), F.col("source_type")).alias("reason"))


_STATUS = "(['full_text','section_text','structured_abstract','snippet','metadata_only','failed'])[doc_id % 6 + 1]"


def _chunk_like(spark, d):
    """documents as scored chunks of made-up statuses."""
    i = F.col("doc_id")
    kind = F.element_at(dims.strings(["government", "forum", "academic", "other"]), (i % 4 + 1).cast("int"))
    stance = F.element_at(dims.strings(["primary_source", "opinion", "secondary_analysis"]), (i % 3 + 1).cast("int"))
    return table(spark, d, "documents").select(
        "doc_id", (i % 20).alias("group_id"), F.concat(F.lit("u"), ((i % 97).cast("string"))).alias("canonical_url"), F.element_at(dims.strings(list(extraction.LADDER)), (i % 6 + 1).cast("int")).alias("status"), kind.alias("source_type"), stance.alias("stance"), ((i % 10) / 10).alias("weight"),
    )


_AUTHORITY = f"(weight >= 0.65 OR source_type IN ({_list(extraction.AUTHORITY)[1:-1]}) OR stance = 'primary_source')"
_CHUNK_LIKE = f"""x AS (SELECT doc_id, doc_id % 20 AS group_id, 'u' || (doc_id % 97) AS canonical_url, {_STATUS} AS status, (['government','forum','academic','other'])[doc_id % 4 + 1] AS source_type,
    (['primary_source','opinion','secondary_analysis'])[doc_id % 3 + 1] AS stance, (doc_id % 10) / 10::DOUBLE AS weight FROM documents)"""


@query("p17_predicates", f"WITH {_CHUNK_LIKE} SELECT doc_id, status IN ({_list(extraction.DEGRADED)[1:-1]}) AS degraded, {_AUTHORITY} AS authority FROM x")
def p17(spark, d):
    return _chunk_like(spark, d).select("doc_id", extraction.is_degraded(F.col("status")).alias("degraded"), extraction.high_authority(F.col("weight"), F.col("source_type"), F.col("stance")).alias("authority"))


@query("j11_to_deepen", f"""WITH {_CHUNK_LIKE}, w AS (SELECT DISTINCT group_id, canonical_url FROM x WHERE {_AUTHORITY} AND status IN ({_list(extraction.DEGRADED)[1:-1]})),
    l AS (SELECT x.* FROM x JOIN w USING (group_id, canonical_url) WHERE doc_id % 5 <> 0), o AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY group_id, canonical_url ORDER BY doc_id) = 1)
    SELECT group_id, doc_id FROM o QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY doc_id) <= 4""")
def j11(spark, d):
    c = _chunk_like(spark, d)
    items = c.select("group_id", "canonical_url", F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"))
    return extraction.to_deepen(c, items, items.filter("id % 5 = 0")).select("group_id", F.col("id").alias("doc_id"))


@query("z08_extraction_metadata", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'snippet' END AS status, CASE WHEN event_id % 3 = 0 THEN 0.35 END::DOUBLE AS confidence FROM events""")
def z08(spark, d):
    """Metadata of an earlier extraction passes through; what is not of its form becomes null."""
    said = F.when(F.col("event_id") % 3 == 0, '{"status":"snippet","confidence":0.35}').when(F.col("event_id") % 3 == 1, "{broken").otherwise('"a text"')
    e = table(spark, d, "events").select("event_id", F.from_json(said, "status string, confidence double").alias("x"))
    return e.select("event_id", "x.status", "x.confidence")


# --- answers ------------------------------------------------------------------------------------------------------------

_ANSWER_CHUNKS = "ch AS (SELECT doc_id % 40 AS query_id, 'c' || lpad(doc_id::VARCHAR, 8, '0') AS chunk_id, text AS content, ((doc_id * 7) % 100) / 100::DOUBLE AS relevance, ((doc_id * 13) % 100) / 100::DOUBLE AS confidence, ((doc_id * 3) % 100) / 100::DOUBLE AS weight FROM documents)"


def _answer_chunks(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select(
        (i % 40).alias("query_id"), F.concat(F.lit("c"), F.lpad(i.cast("string"), 8, "0")).alias("chunk_id"), F.concat(F.lit("question "), (i % 40).cast("string")).alias("query"), F.col("text").alias("content"), F.lit(None).cast("string").alias("claim"), "source", F.lit("code").alias("source_type"), F.lit("title").alias("title"),
        ((i * 7) % 100 / 100).alias("relevance"), ((i * 13) % 100 / 100).alias("confidence"), ((i * 3) % 100 / 100).alias("weight"),
    )


@query("t14_answer_ranks", f"WITH {_ANSWER_CHUNKS} SELECT chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(relevance * 0.55 + confidence * 0.3 + weight * 0.15, 12) DESC, chunk_id) AS answer_rank, row_number() OVER (PARTITION BY query_id ORDER BY round(relevance * confidence, 12) DESC, chunk_id) AS best_rank FROM ch")
def t14(spark, d):
    return answers.ranked(_answer_chunks(spark, d)).select("chunk_id", "answer_rank", "best_rank")


def sentence_sql(c: str) -> str:
    bare = f"regexp_replace(trim(regexp_replace({c}, '{WS}+', ' ', 'g')), '{WS}*\\[[^\\]]+\\]{WS}*$', '')"
    return f"CASE WHEN {bare} = '' THEN 'The evidence kept is relevant to the query' ELSE regexp_replace({bare}, '[.!?]+$', '') END"


@query("f17_sentences", f"SELECT doc_id, {sentence_sql('text')} AS sentence, regexp_replace(trim(regexp_replace(text, '{WS}+', ' ', 'g')), '[:.]{WS}*$', '') AS title FROM documents")
def f17(spark, d):
    return table(spark, d, "documents").select("doc_id", answers.sentence(F.col("text")).alias("sentence"), answers.short_title(F.col("text")).alias("title"))


@query("f17_cited_ids", r"""WITH a AS (SELECT doc_id, 'see [a] and [b' || (doc_id % 3) || '] and [a] or [zz]' AS answer FROM documents)
    SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS ids FROM (SELECT doc_id, list_filter(regexp_extract_all(answer, '\[([^\]]+)\]', 1), lambda x: x IN ('a','b1','b2')) AS l FROM a)""")
def f17_cited(spark, d):
    answer = F.concat(F.lit("see [a] and [b"), (F.col("doc_id") % 3).cast("string"), F.lit("] and [a] or [zz]"))
    return table(spark, d, "documents").select("doc_id", F.array_join(answers.cited_ids(answer, dims.strings(["a", "b1", "b2"])), ",").alias("ids"))


@query("f17_answer_shape", r"""WITH a AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Synthesized from 3 chunks' WHEN 1 THEN '1. one' || chr(10) || '2. two' WHEN 2 THEN text || chr(10) || '1. one' ELSE text END AS answer FROM conversations)
    SELECT conv_id, turn, regexp_matches(trim(answer), '(?i)^synthesized from\b') OR len(list_filter(list_slice(string_split_regex(trim(answer), '\n+'), 1, 4), lambda x: regexp_matches(x, '^[ \t\n\r\f\v]*[0-9]+\.[ \t\n\r\f\v]+'))) >= 2 AS misshapen FROM a""")
def f17_shape(spark, d):
    n = F.col("turn") % 4
    answer = F.when(n == 0, "Synthesized from 3 chunks").when(n == 1, "1. one\n2. two").when(n == 2, F.concat("text", F.lit("\n1. one"))).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", answers.misshapen(answer).alias("misshapen"))


@query("f18_general_answer", f"""WITH {_ANSWER_CHUNKS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(relevance * confidence, 12) DESC, chunk_id) AS n FROM ch),
    s AS (SELECT query_id, n, confidence, chunk_id, {sentence_sql("substr(content, 1, 260)")} || ' [' || chunk_id || '].' AS said FROM r WHERE n <= 4)
    SELECT query_id, 'The selected evidence supports this answer to "question ' || query_id || '": ' || string_agg(said, ' ' ORDER BY n) || CASE WHEN min(confidence) < 0.4 THEN ' The evidence found is thin in places, so what goes beyond the chunks cited is unresolved.' ELSE '' END AS answer,
    string_agg(chunk_id, ',' ORDER BY n) AS citations FROM s GROUP BY query_id""")
def f18(spark, d):
    return answers.general_answer(_answer_chunks(spark, d)).withColumn("citations", F.array_join("citations", ","))


@query("f18_comparative_parts", f"""WITH {_ANSWER_CHUNKS}, t AS (SELECT *, content || ' benchmark' || CASE WHEN relevance < 0.3 THEN ' RRF fusion' ELSE '' END || CASE WHEN confidence < 0.4 THEN ' cross-encoder' ELSE '' END AS said FROM ch),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(relevance * 0.55 + confidence * 0.3 + weight * 0.15, 12) DESC, chunk_id) AS n FROM t),
    g AS (SELECT query_id, list(chunk_id ORDER BY n) FILTER (WHERE regexp_matches(said, '{answers.FUSION}')) AS f, list(chunk_id ORDER BY n) FILTER (WHERE regexp_matches(said, '{answers.RERANKER}')) AS k, list(chunk_id ORDER BY n) FILTER (WHERE regexp_matches(said, '{answers.SYSTEMS}')) AS s, arg_min(chunk_id, n) AS top FROM r GROUP BY 1),
    h AS (SELECT *, coalesce(f[1], top) AS fu, list_slice(k, 1, 3) AS k3 FROM g)
    SELECT query_id, fu AS fusion_chunk, coalesce(list_filter(k3, lambda x: x <> fu)[1], k3[1]) AS reranker_chunk, array_to_string(list_slice(s, 1, 3), ',') AS systems FROM h""")
def f18_comparative(spark, d):
    c = _answer_chunks(spark, d)
    c = c.withColumn("content", F.concat("content", F.lit(" benchmark"), F.when(F.col("relevance") < 0.3, " RRF fusion").otherwise(""), F.when(F.col("confidence") < 0.4, " cross-encoder").otherwise("")))
    return answers.comparative_parts(c.withColumn("title", F.lit(None).cast("string"))).select("query_id", "fusion_chunk", "reranker_chunk", F.array_join("systems", ",").alias("systems"))


@query("f19_inventory_answer", f"""WITH {_ANSWER_CHUNKS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, chunk_id) AS n FROM ch)
    SELECT query_id, string_agg(n || '. ' || {sentence_sql("substr(content, 1, 260)")} || ' [' || chunk_id || ']', chr(10) ORDER BY n) AS answer FROM r WHERE n <= 6 GROUP BY 1""")
def f19(spark, d):
    return answers.inventory_answer(_answer_chunks(spark, d))


_LIMITED = "'Evidence is limited, so this answer separates what was found from general reasoning.' || chr(10) || chr(10)"


@query("f20_cautious_review", f"""SELECT item_id AS query_id, CASE WHEN item_id % 4 < 2 THEN {_LIMITED} ELSE '' END || text AS final_answer, (['insufficient_evidence','partially_answered','answered','answered'])[item_id % 4 + 1] AS coverage_status, {tokens_sql('text')} AS token_count FROM benchmark""")
def f20(spark, d):
    status = F.element_at(dims.strings(["insufficient", "weak", "adequate", "strong"]), (F.col("item_id") % 4 + 1).cast("int"))
    none = F.array().cast("array<string>")
    drafts = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("q").alias("query"), F.col("text").alias("draft"), status.alias("status"), none.alias("reasons"), none.alias("claims"), none.alias("chunk_ids"))
    return answers.review(drafts).select("query_id", "final_answer", "coverage_status", "token_count")


@query("z11_review_coercion", "SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'final' WHEN 3 THEN NULL ELSE text END AS answer FROM benchmark")
def z11(spark, d):
    raw = F.element_at(dims.strings(['{"final_answer": "final"}', '{"final_answer": "  "}', '{"other": 1}', "no object"]), (F.col("item_id") % 4 + 1).cast("int"))
    return table(spark, d, "benchmark").select("item_id", answers.coerced_review(raw, F.col("text")).alias("answer"))


@query("p20_provenance", f"SELECT doc_id, CASE s {' '.join(f'WHEN {_q(k)} THEN {_q(v)}' for k, v in answers.PROVENANCE.items())} ELSE 'unknown' END AS provenance FROM (SELECT doc_id, (['primary_source','secondary_analysis','tertiary_summary','opinion','speculation'])[doc_id % 5 + 1] AS s FROM documents)")
def p20(spark, d):
    stance = F.element_at(dims.strings(["primary_source", "secondary_analysis", "tertiary_summary", "opinion", "speculation"]), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", answers.provenance(stance).alias("provenance"))


@query("z12_searchable", "SELECT doc_id, concat_ws(' ', nullif(source, ''), nullif(lang, ''), 'claim a claim b', nullif(text, '')) AS said FROM documents")
def z12(spark, d):
    return table(spark, d, "documents").select("doc_id", answers.searchable(F.col("source"), F.col("lang"), dims.strings(["claim a", "claim b"]), F.col("text")).alias("said"))


# --- text ---------------------------------------------------------------------------------------------------------------


@query("f10_normalized_text")
def f10(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalized_text(F.col("text")).alias("norm"))


@query("f21_matched_questions", f"SELECT a.conv_id, a.turn, b.item_id FROM (SELECT conv_id, turn, lower(trim(regexp_replace(nfc_normalize(text), '{WS}+', ' ', 'g'))) AS k FROM conversations UNION ALL SELECT item_id, -1, lower(trim(regexp_replace(nfc_normalize(text), '{WS}+', ' ', 'g'))) FROM benchmark) a JOIN (SELECT item_id, lower(trim(regexp_replace(nfc_normalize(text), '{WS}+', ' ', 'g'))) AS k FROM benchmark) b USING (k)")
def f21(spark, d):
    asked = table(spark, d, "conversations").select("conv_id", "turn", "text").unionByName(table(spark, d, "benchmark").select(F.col("item_id").alias("conv_id"), F.lit(-1).cast("long").alias("turn"), F.concat(F.lit("  "), "text").alias("text")))
    b = table(spark, d, "benchmark").select("item_id", T.matched_question(F.col("text")).alias("k"))
    return asked.withColumn("k", T.matched_question(F.col("text"))).join(b, "k").select("conv_id", "turn", "item_id")


@query("f09_other_tokens", f"SELECT doc_id, array_to_string(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9 \\t\\n\\r\\f\\v.-]', ' ', 'g'), '{WS}+'), lambda t: length(t) > 2), ' ') AS embedder, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z0-9]+)?'), ' ') AS words FROM documents")
def f09(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.embedder_tokens(F.col("text")), " ").alias("embedder"), F.array_join(T.apostrophe_words(F.col("text")), " ").alias("words"))


# --- gold scores --------------------------------------------------------------------------------------------------------

_GOLD = """g AS (SELECT item_id AS question_id, item_id % 7 <> 3 AS valid, [{'text': text, 'keywords': CASE WHEN item_id % 2 = 0 THEN [split_part(text, ' ', 1), split_part(text, ' ', 3)] ELSE []::VARCHAR[] END}, {'text': text, 'keywords': ['data', 'water', 'report', 'zzz']}] AS facts,
    ['government', 'primary-document', 'news', 'forum'] AS required, ['used insider news', 'treats consensus as truth', split_part(text, '.', 1)] AS penalties FROM benchmark),
a AS (SELECT doc_id, 'e' || (doc_id % 3) AS engine, doc_id % 45 AS question_id, CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE text || CASE WHEN doc_id % 5 = 0 THEN ' It used insider news.' ELSE '' END END AS answer, CASE doc_id % 4 WHEN 0 THEN []
    WHEN 1 THEN [{'source_name': 'sec_edgar', 'source_type': 'filing', 'url': 'https://a.org', 'title': 'Reuters news', 'provenance': 'primary'}]
    WHEN 2 THEN [{'source_name': 'data_gov', 'source_type': 'government', 'url': NULL, 'title': 't', 'provenance': 'unknown'}, {'source_name': 'data_gov', 'source_type': 'government', 'url': NULL, 'title': 't', 'provenance': 'unknown'}]
    ELSE [{'source_name': 'x', 'source_type': 'forum', 'url': 'https://b.org', 'title': NULL, 'provenance': 'forum/opinion'}] END AS sources FROM documents)"""
_SOURCES = "array<struct<source_name:string,source_type:string,url:string,title:string,provenance:string>>"


def _gold(spark, d):
    words = F.split("text", " ")
    few = F.when(F.col("item_id") % 2 == 0, F.array(F.coalesce(F.get(words, F.lit(0)), F.lit("")), F.coalesce(F.get(words, F.lit(2)), F.lit("")))).otherwise(F.array().cast("array<string>"))
    facts = F.array(F.struct("text", few.alias("keywords")), F.struct("text", dims.strings(["data", "water", "report", "zzz"]).alias("keywords")))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), (F.col("item_id") % 7 != 3).alias("valid"), facts.alias("facts"), dims.strings(["government", "primary-document", "news", "forum"]).alias("required"), F.array(F.lit("used insider news"), F.lit("treats consensus as truth"), F.get(F.split("text", r"\."), F.lit(0))).alias("penalties"))


def _gold_answers(spark, d):
    i = F.col("doc_id")
    one = lambda *v: F.struct(*(F.lit(x).cast("string").alias(k) for x, k in zip(v, ("source_name", "source_type", "url", "title", "provenance"), strict=True)))
    government = one("data_gov", "government", None, "t", "unknown")
    sources = F.when(i % 4 == 0, F.array().cast(_SOURCES)).when(i % 4 == 1, F.array(one("sec_edgar", "filing", "https://a.org", "Reuters news", "primary"))).when(i % 4 == 2, F.array(government, government)).otherwise(F.array(one("x", "forum", "https://b.org", None, "forum/opinion")))
    answer = F.when(i % 11 == 0, " ").otherwise(F.concat("text", F.when(i % 5 == 0, " It used insider news.").otherwise("")))
    return table(spark, d, "documents").select(F.concat(F.lit("e"), (i % 3).cast("string"), F.lit(":"), i.cast("string")).alias("engine"), (i % 45).alias("question_id"), answer.alias("answer"), sources.alias("sources"))


def _plain(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '{WS}+', ' ', 'g'))"


_LETTERS, _BASES = "".join(T._MARKED), "".join(T._MARKED.values())


def _folded(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(translate(regexp_replace(lower({c}), '([{_LETTERS}])', '\\1 ', 'g'), '{_LETTERS}', '{_BASES}'), '[^A-Za-z0-9_ \\t\\n\\r\\f\\v./:-]+', ' ', 'g'), '{WS}+', ' ', 'g'))"


def _meaning(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda t: length(t) > 2 AND NOT list_contains({_list(gold.EMPTY_WORDS)}, t))"


_STATUS_SQL = "CASE WHEN trim(answer) = '' THEN 'scoring_unavailable' WHEN valid IS NULL THEN 'blocked_missing_gold' WHEN NOT valid THEN 'blocked_invalid_gold' ELSE 'scored' END"


@query("a16_gold_scores", f"""WITH {_GOLD}, j AS (SELECT a.*, valid, facts, required, penalties, {_STATUS_SQL} AS st, {_plain('answer')} AS said FROM a LEFT JOIN g USING (question_id))
    SELECT engine || ':' || doc_id AS engine, question_id, st AS score_status,
    CASE WHEN st = 'scored' THEN len(list_filter(facts, lambda f: len(list_filter(CASE WHEN len(f.keywords) > 0 THEN f.keywords ELSE list_slice(list_filter(string_split_regex(f.text, '[^a-z0-9]+'), lambda t: length(t) > 5), 1, 5) END, lambda t: contains(said, {_plain('t')}))) > 0)) ELSE 0 END::INT AS facts_hit, coalesce(len(facts), 0)::INT AS facts_total,
    CASE WHEN st = 'scored' THEN len(list_filter(required, lambda r: len(list_filter(sources, lambda s: s.source_type = (CASE r {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in gold.GOLD_TYPES.items())} END) OR s.provenance = 'primary')) > 0)) ELSE 0 END::INT AS required_hit, coalesce(len(required), 0)::INT AS required_total,
    CASE WHEN st = 'scored' THEN len(list_filter(sources, lambda s: s.provenance = 'primary' OR s.source_type IN ('filing','government'))) ELSE 0 END::INT AS primary_sources,
    CASE WHEN st = 'scored' THEN len(list_filter(penalties, lambda p: CASE WHEN contains({_plain('p')}, 'automatically') AND contains({_plain('p')}, 'hyperinflation') THEN regexp_matches(said, 'automatic.*hyperinflation|hyperinflation.*automatic') WHEN contains({_plain('p')}, 'llm scan as enough') THEN regexp_matches(said, 'llm.*(enough|sufficient)|scan.*enough')
      WHEN contains({_plain('p')}, 'insider news') THEN regexp_matches(said, 'insider news|inside information') WHEN contains({_plain('p')}, 'consensus as truth') THEN regexp_matches(said, 'consensus.*truth') ELSE false END)) ELSE 0 END::INT AS penalties_hit,
    CASE WHEN st = 'scored' AND len(sources) = 0 THEN len(list_slice(list_filter(list_transform(string_split(regexp_replace(answer, '([.]){WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^{WS}+|{WS}+$', '', 'g')), lambda s: length(s) > 80), 1, 3)) ELSE 0 END::INT AS unsourced FROM j""")
def a16(spark, d):
    s = gold.score(_gold_answers(spark, d), _gold(spark, d))
    return s.withColumn("penalties_hit", F.size("penalties_hit")).withColumn("unsourced", F.size("unsourced"))


@query("a17_strict_gold_scores", f"""WITH {_GOLD}, j AS (SELECT a.*, valid, facts, required, penalties, {_STATUS_SQL} AS st, {_folded('answer')} AS said FROM a LEFT JOIN g USING (question_id)), k AS (SELECT *, {_meaning('said')} AS have FROM j),
    u AS (SELECT *, list_transform(facts, lambda f: {{'n': len(f.keywords), 'hits': len(list_filter(f.keywords, lambda t: contains(said, {_folded('t')}))), 'own': {_meaning(_folded('f.text'))}}}) AS fs, list_transform(penalties, lambda p: {{'p': {_folded('p')}, 'own': {_meaning(_folded('p'))}}}) AS ps,
      list_transform(sources, lambda s: {{'prim': coalesce(s.provenance = 'primary' OR s.source_type IN ({_list(gold.PRIMARY_TYPES)[1:-1]}) OR s.source_name IN ({_list(gold.PRIMARY_NAMES)[1:-1]}), false), 'kind': s.source_type, 'key': coalesce(s.url, coalesce(s.source_name, 'unknown') || ':' || coalesce(s.title, '')), 'said': {_folded("concat_ws(' ', s.source_name, s.title, s.url)")}}}) AS ss FROM k)
    SELECT engine || ':' || doc_id AS engine, question_id, st AS score_status,
    CASE WHEN st = 'scored' THEN len(list_filter(fs, lambda f: (f.n > 0 AND f.hits >= CASE WHEN f.n <= 2 THEN f.n ELSE ceil(f.n * 0.75) END) OR (len(f.own) > 0 AND len(list_filter(f.own, lambda t: list_contains(have, t))) >= greatest(3, ceil(len(f.own) * 0.55))))) ELSE 0 END::INT AS facts_hit,
    CASE WHEN st = 'scored' THEN len(list_filter(required, lambda r: CASE r WHEN 'primary-document' THEN len(list_filter(ss, lambda s: s.prim)) > 0 WHEN 'news' THEN len(list_filter(ss, lambda s: len(list_filter({_list(gold.NEWS_NAMES)}, lambda n: contains(s.said, n))) > 0)) > 0 ELSE len(list_filter(ss, lambda s: s.kind = r)) > 0 END)) ELSE 0 END::INT AS required_hit,
    CASE WHEN st = 'scored' THEN len(list_distinct(list_transform(list_filter(ss, lambda s: s.prim), lambda s: s.key))) ELSE 0 END::INT AS primary_sources,
    CASE WHEN st = 'scored' THEN len(list_filter(ps, lambda p: p.p <> '' AND (contains(said, p.p) OR (len(p.own) >= 3 AND len(list_filter(p.own, lambda t: list_contains(have, t))) >= ceil(len(p.own) * 0.8))))) ELSE 0 END::INT AS penalties_hit FROM u""")
def a17(spark, d):
    s = gold.score(_gold_answers(spark, d), _gold(spark, d), strict=True)
    return s.select("engine", "question_id", "score_status", "facts_hit", "required_hit", "primary_sources", F.size("penalties_hit").alias("penalties_hit"))


@query("j12_gold_join", f"WITH {_GOLD} SELECT a.doc_id, question_id, len(facts) * len(a.sources) AS pairs FROM a JOIN g USING (question_id)")
def j12(spark, d):
    a = _gold_answers(spark, d).withColumn("doc_id", F.element_at(F.split("engine", ":"), 2).cast("long"))
    j = a.join(_gold(spark, d), "question_id")
    each = j.select("doc_id", "question_id", F.explode_outer("sources").alias("s"), F.size("facts").alias("n"))
    return each.groupBy("doc_id", "question_id").agg(F.sum(F.when(F.col("s").isNotNull(), F.col("n")).otherwise(0)).alias("pairs"))


@query("z13_blocked_rows", f"WITH {_GOLD}, j AS (SELECT {_STATUS_SQL} AS score_status FROM a LEFT JOIN g USING (question_id)) SELECT score_status, count(*) AS n FROM j GROUP BY 1")
def z13(spark, d):
    return gold.score(_gold_answers(spark, d), _gold(spark, d)).groupBy("score_status").agg(F.count(F.lit(1)).alias("n"))


# --- costs --------------------------------------------------------------------------------------------------------------

_CALLS = """c AS (SELECT l_orderkey * 10 + l_linenumber AS call_id, CASE l_returnflag WHEN 'A' THEN NULL ELSE l_returnflag END AS stage, CASE l_orderkey % 4 WHEN 0 THEN 'mock' ELSE 'router' END AS provider, CASE l_partkey % 3 WHEN 0 THEN '~m' || (l_partkey % 5) ELSE 'm' || (l_partkey % 5) END AS model,
    l_quantity::BIGINT AS prompt, l_linenumber::BIGINT AS completion, CASE WHEN l_orderkey % 4 = 1 THEN l_linenumber / 1000::DOUBLE END AS told FROM lineitem),
r AS (SELECT call_id, coalesce(stage, 'default') AS stage, provider, model, prompt, completion, CASE WHEN provider = 'mock' THEN 0.0 ELSE told END AS known, (regexp_replace(model, '^~', '') IN ('m0','m1','m2')) AS listed, (regexp_extract(model, 'm([0-9])', 1)::INT + 1) * 0.000001::DOUBLE AS price FROM c),
p AS (SELECT *, CASE WHEN known IS NULL AND listed THEN round(prompt * price + completion * 2 * price, 12) ELSE known END AS cost, CASE WHEN known IS NULL AND listed THEN 'catalog_estimate' WHEN provider = 'mock' THEN 'mock_zero' WHEN known IS NOT NULL THEN 'provider_usage' ELSE 'unavailable' END AS pricing_source, known IS NULL AND listed AS estimated FROM r)"""


def _calls(spark, d):
    i = table(spark, d, "lineitem")
    model = F.concat(F.when(F.col("l_partkey") % 3 == 0, "~m").otherwise("m"), (F.col("l_partkey") % 5).cast("string"))
    raw = F.when(F.col("l_linenumber") % 2 == 0, F.to_json(F.struct(F.col("l_quantity").cast("long").alias("prompt_tokens"), F.col("l_linenumber").alias("completion_tokens")))).otherwise(F.to_json(F.struct(F.col("l_quantity").cast("long").alias("input_tokens"), F.col("l_linenumber").cast("string").alias("output_tokens"))))
    calls = i.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call_id"), F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("stage"), F.when(F.col("l_orderkey") % 4 == 0, "mock").otherwise("router").alias("provider"), model.alias("model"), raw.alias("raw"), F.when(F.col("l_orderkey") % 4 == 1, F.col("l_linenumber") / 1000).alias("told_cost"))
    catalog = spark.createDataFrame([(f"m{k}", (k + 1) * 1e-6, 2 * (k + 1) * 1e-6) for k in range(3)], "model string, prompt_price double, completion_price double")
    return costs.resolved(costs.line_items(calls), catalog)


@query("a14_cost_resolution", f"WITH {_CALLS} SELECT call_id, stage, model, prompt AS prompt_tokens, completion AS completion_tokens, round(cost, 9) AS cost, pricing_source, estimated FROM p")
def a14(spark, d):
    return _calls(spark, d).select("call_id", "stage", "model", "prompt_tokens", "completion_tokens", F.round("cost", 9).alias("cost"), "pricing_source", "estimated")


@query("a15_cost_groups", f"""WITH {_CALLS}, s AS (SELECT 'all' AS kind, NULL::VARCHAR AS name, * FROM p UNION ALL SELECT 'stage', stage, * FROM p UNION ALL SELECT 'provider', provider, * FROM p UNION ALL SELECT 'model', model, * FROM p)
    SELECT kind, name, count(*) AS calls, sum(prompt)::BIGINT AS prompt_tokens, sum(completion)::BIGINT AS completion_tokens, round(sum(coalesce(cost, 0)), 6) AS cost, bool_or(estimated OR pricing_source = 'unavailable') AS estimated, CASE WHEN count(DISTINCT pricing_source) = 1 THEN min(pricing_source) ELSE 'mixed' END AS pricing_source FROM s GROUP BY 1, 2""")
def a15(spark, d):
    return costs.summary(_calls(spark, d)).withColumn("cost", F.round("cost", 6))


# --- stores -------------------------------------------------------------------------------------------------------------


def _cache(spark, d):
    i = F.col("doc_id")
    c = table(spark, d, "documents").select((i % 10).alias("query_id"), i.alias("chunk_id"), i.alias("ord"), F.md5("text").alias("key"), (i % 100 / 100).alias("relevance"), F.lit(0.5).alias("confidence"))
    cache = c.filter("chunk_id % 3 = 0").groupBy("key").agg(F.min("relevance").alias("relevance"), F.min("confidence").alias("confidence"), F.min("ord").alias("used_at"))
    return c, cache


_CACHE = "c AS (SELECT doc_id % 10 AS query_id, doc_id, md5(text) AS key FROM documents), k AS (SELECT key, min(doc_id) AS used_at FROM c WHERE doc_id % 3 = 0 GROUP BY 1)"


@query("z09_cache_rows", f"WITH {_CACHE} SELECT query_id, 'score_cache' AS stage, count(k.key) AS hits, count(*) - count(k.key) AS misses, coalesce(string_agg(CASE WHEN k.key IS NOT NULL THEN doc_id END::VARCHAR, ',' ORDER BY doc_id), '') AS hit_ids FROM c LEFT JOIN k USING (key) GROUP BY 1")
def z09(spark, d):
    c, cache = _cache(spark, d)
    return stores.cache_row("score", c, cache).withColumn("hit_ids", F.array_join("hit_ids", ","))


@query("c06_score_cache", f"""WITH {_CACHE}, h AS (SELECT c.key, doc_id, 0 AS rank FROM c JOIN k USING (key) UNION ALL SELECT c.key, doc_id, 1 FROM c WHERE key NOT IN (SELECT key FROM k)), n AS (SELECT key, row_number() OVER (ORDER BY rank, doc_id, key) + (SELECT max(used_at) FROM k) AS used_at FROM h),
    e AS (SELECT key, max(used_at) AS used_at FROM (SELECT key, used_at FROM k UNION ALL SELECT key, used_at FROM n) GROUP BY 1) SELECT key, used_at FROM e ORDER BY used_at DESC, key LIMIT 50""")
def c06(spark, d):
    c, cache = _cache(spark, d)
    hits, misses = stores.split_by_cache(c.drop("relevance", "confidence"), cache)
    return stores.cache_after(cache, hits, misses.withColumn("relevance", F.lit(0.4)).withColumn("confidence", F.lit(0.5)), most=50).select("key", "used_at")


@query("k03_reliability_store", f"""WITH o AS (SELECT event_type AS source, user_id % 3 AS domain, event_id, (['confirmed','contradicted','repeated','observed'])[event_id % 4 + 1] AS kind, (['filing','forum','academic'])[event_id % 3 + 1] AS source_type FROM events),
    s AS (SELECT DISTINCT event_type AS source, 0 AS domain, 2.0::DOUBLE AS alpha, 3.0::DOUBLE AS beta, 5 AS observations FROM events WHERE event_type <> 'error'),
    g AS (SELECT source, domain, arg_min(source_type, event_id) AS st, sum(CASE kind WHEN 'confirmed' THEN 1 WHEN 'repeated' THEN 0.2 WHEN 'observed' THEN 0.05 ELSE 0 END)::DOUBLE AS up, sum(CASE kind WHEN 'contradicted' THEN 1 WHEN 'repeated' THEN 0.1 WHEN 'observed' THEN 0.05 ELSE 0 END)::DOUBLE AS down, count(*) AS n FROM o GROUP BY ALL),
    w(st, prior) AS (VALUES ('filing', 0.95), ('forum', {dims.TYPE_WEIGHTS['forum']}), ('academic', {dims.TYPE_WEIGHTS['academic']}))
    SELECT source, domain, round(coalesce(alpha, 6 * prior::DOUBLE) + up, 6) AS alpha, round(coalesce(beta, 6 * (1 - prior::DOUBLE)) + down, 6) AS beta, (coalesce(observations, 0) + n)::BIGINT AS observations FROM g JOIN w USING (st) LEFT JOIN s USING (source, domain)""")
def k03(spark, d):
    e = table(spark, d, "events")
    kind = F.element_at(dims.strings(["confirmed", "contradicted", "repeated", "observed"]), (F.col("event_id") % 4 + 1).cast("int"))
    kinds = F.element_at(dims.strings(["filing", "forum", "academic"]), (F.col("event_id") % 3 + 1).cast("int"))
    observed = e.select(F.col("event_type").alias("source"), (F.col("user_id") % 3).alias("domain"), kinds.alias("source_type"), kind.alias("kind"), F.col("event_id").alias("ord"))
    store = e.filter("event_type <> 'error'").select(F.col("event_type").alias("source"), F.lit(0).cast("long").alias("domain"), F.lit(2.0).alias("alpha"), F.lit(3.0).alias("beta"), F.lit(5).alias("observations")).distinct()
    return stores.updated_reliability(store, observed).select("source", "domain", F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta"), "observations")


# --- curated sources ----------------------------------------------------------------------------------------------------

_OFFICIAL = ", ".join(f"({i}, {_q(r[0])}, {_q(r[1] + ' ' + r[6] + ' ' + ' '.join(r[5]))}, [{', '.join(_q(t.lower()) for t in r[5])}])" for i, r in enumerate(curated.OFFICIAL))
_ASKED = "q AS (SELECT item_id AS query_id, text || (['', ' SEC filings and direct feeds', ' crude oil prices', ' secure by design'])[item_id % 4 + 1] AS sub_query, (item_id % 6)::INT AS n FROM benchmark)"


@query("s17_official_docs", f"""WITH {_ASKED}, o(i, doc_id, said, tags) AS (VALUES {_OFFICIAL}), t AS (SELECT *, list_distinct({terms_sql('sub_query', None, 2)}) AS w FROM q),
    s AS (SELECT query_id, n, i, doc_id, round(CASE WHEN len(w) = 0 THEN 0 ELSE len(list_intersect(w, {terms_sql('said', None, 2)})) / len(w)::DOUBLE END + 0.35 * len(list_filter(tags, lambda x: contains(lower(sub_query), x))), 9) AS score FROM t, o),
    b AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, i) AS r FROM b WHERE score > 0 OR best = 0)
    SELECT query_id, r::INT AS r, doc_id, round(score, 6) AS score FROM r WHERE r <= greatest(1, least(10, n))""")
def s17(spark, d):
    tail = F.element_at(dims.strings(["", " SEC filings and direct feeds", " crude oil prices", " secure by design"]), (F.col("query_id") % 4 + 1).cast("int"))
    asked = queries(spark, d).select("query_id", F.concat("query", tail).alias("sub_query"), (F.col("query_id") % 6).cast("int").alias("max_results"))
    return curated.official(asked).select("query_id", "r", "doc_id", F.round("score", 6).alias("score"))


_MADE = ", ".join(f"({_q(r[0])}, {_q(r[1])}, {_q(r[2])}, {_q(r[6])})" for r in curated.MADE_UP)


@query("s18_made_up_items", f"SELECT item_id AS query_id, id, source, source_type, replace(t, '{{q}}', text) AS text, 'mock' AS mode FROM benchmark, (VALUES {_MADE}) m(id, source, source_type, t)")
def s18(spark, d):
    return curated.made_up(queries(spark, d)).select("query_id", "id", "source", "source_type", "text", "mode")


@query("s21_fixtures", """SELECT item_id AS file, 'manual' AS mode, 'e' || (item_id % 3) AS engine, CASE item_id % 5 WHEN 4 THEN 'question is missing' END AS problem, (item_id % 7)::BIGINT AS token_count FROM benchmark WHERE item_id % 6 < 5
    UNION ALL SELECT item_id, 'manual', NULL, 'not JSON', 0 FROM benchmark WHERE item_id % 6 = 5""")
def s21(spark, d):
    i = F.col("item_id")
    one = F.to_json(F.struct(F.concat(F.lit("e"), (i % 3).cast("string")).alias("engine"), F.when(i % 5 != 4, F.concat(F.lit("Q"), (i % 5).cast("string"))).alias("question_id"), F.lit("a").alias("answer"), F.lit("live").alias("mode"), ((i % 7) + 0.5).alias("token_count")))
    value = F.when(i % 6 == 0, F.concat(F.lit("["), one, F.lit("]"))).when(i % 6 == 1, F.concat(F.lit('{"fixtures": ['), one, F.lit("]}"))).when(i % 6 == 2, F.concat(F.lit('{"results": ['), one, F.lit("]}"))).when(i % 6 == 5, "{broken").otherwise(one)
    return curated.fixtures(table(spark, d, "benchmark").select(i.alias("file"), value.alias("value"))).select("file", "engine", "mode", "problem", "token_count")


@query("s28_web_search", """SELECT page_id, CASE WHEN page_id % 4 = 3 THEN 'missing' ELSE 'live' END AS mode, CASE WHEN page_id % 4 = 3 THEN '' ELSE regexp_replace(url, '[.,;:!?]+$', '') || ',https://x.example.org/' || page_id END AS urls, CASE WHEN page_id % 4 = 3 THEN '' ELSE repeat('long text ', 10) END AS answer FROM pages""")
def s28(spark, d):
    payload = F.to_json(F.struct(F.struct(F.col("url"), F.concat(F.lit("see https://x.example.org/"), F.col("page_id").cast("string"), F.lit(".")).alias("note")).alias("nested"), F.repeat(F.lit("long text "), 10).alias("output")))
    p = table(spark, d, "pages").select(F.lit("web").alias("engine"), F.col("page_id").alias("question_id"), F.when(F.col("page_id") % 4 != 3, payload).alias("payload"))
    return curated.provider_row(p).select(F.col("question_id").alias("page_id"), "mode", F.array_join("urls", ",").alias("urls"), "answer")


@query("f18_answers_with_evidence")
def f18_run(spark, d):
    e = evidence.of(spark, d)
    return answers.general_answer(e.selected).withColumn("citations", F.array_join("citations", ","))


# --- health and gains of made-up selections -----------------------------------------------------------------------------

_KINDS, _STANCES = ["government", "forum", "academic", "medical", "code"], ["primary_source", "opinion", "secondary_analysis", "tertiary_summary"]
_SELECTED = f"""s AS (SELECT doc_id, doc_id % 30 AS query_id, 's' || (doc_id % 7) AS source, ({_list(_KINDS)})[doc_id % 5 + 1] AS source_type, ({_list(_STANCES)})[doc_id % 4 + 1] AS stance, ((doc_id * 7) % 97) / 97::DOUBLE AS relevance, ((doc_id * 13) % 97) / 97::DOUBLE AS confidence,
    ((doc_id * 3) % 97) / 97::DOUBLE AS weight, ((doc_id * 11) % 97) / 97::DOUBLE AS freshness, doc_id % 3 > 0 AS has_claim, doc_id % 9 = 0 AS degraded, text FROM documents),
i AS (SELECT n AS query_id, CASE WHEN n % 3 = 0 THEN ['fresh-fact'] ELSE ['multi-hop'] END AS types, CASE n % 4 WHEN 0 THEN ['government','academic'] WHEN 1 THEN ['primary-document','forum'] WHEN 2 THEN [] ELSE ['news','code'] END AS required FROM range(33) t(n))"""


def _selected(spark, d):
    i = F.col("doc_id")
    pick = lambda values, n: F.element_at(dims.strings(values), (i % n + 1).cast("int"))
    s = table(spark, d, "documents").select(
        F.concat(F.lit("c"), F.lpad(i.cast("string"), 8, "0")).alias("chunk_id"), (i % 30).alias("query_id"), F.concat(F.lit("s"), (i % 7).cast("string")).alias("source"), pick(_KINDS, 5).alias("source_type"), pick(_STANCES, 4).alias("stance"), (i * 7 % 97 / 97).alias("relevance"), (i * 13 % 97 / 97).alias("confidence"),
        (i * 3 % 97 / 97).alias("weight"), (i * 11 % 97 / 97).alias("freshness"), F.when(i % 3 > 0, F.col("text")).alias("claim"), (i % 9 == 0).alias("degraded"),
    )
    n = F.col("query_id")
    none = F.array().cast("array<string>")
    types = F.when(n % 3 == 0, dims.strings(["fresh-fact"])).otherwise(dims.strings(["multi-hop"]))
    required = F.when(n % 4 == 0, dims.strings(["government", "academic"])).when(n % 4 == 1, dims.strings(["primary-document", "forum"])).when(n % 4 == 2, none).otherwise(dims.strings(["news", "code"]))
    return s, spark.range(33).select(F.col("id").alias("query_id")).select("query_id", types.alias("query_types"), required.alias("required_types"))


@query("a11_health_of_selections", f"""WITH {_SELECTED}, a AS (SELECT query_id, count(*) AS n, avg(relevance) AS rel, avg(confidence) AS conf, avg(weight) AS wt, avg(freshness) AS fresh, count(*) FILTER (WHERE has_claim) AS claims, count(DISTINCT source_type) AS types, count(DISTINCT source) AS sources,
      count(*) FILTER (WHERE stance = 'primary_source' OR source_type IN ('government','filing','structured_fact','medical')) AS prim, count(*) FILTER (WHERE relevance < 0.18) AS zero, count(*) FILTER (WHERE degraded) AS deg FROM s GROUP BY 1),
    m AS (SELECT query_id, count(DISTINCT r) AS matched FROM (SELECT query_id, unnest(required) AS r FROM i) JOIN s USING (query_id) WHERE CASE r WHEN 'primary-document' THEN stance = 'primary_source' OR source_type IN ('government','filing','structured_fact','medical') WHEN 'news' THEN false ELSE source_type = r END GROUP BY 1),
    j AS (SELECT i.query_id, required, coalesce(n, 0) AS n, coalesce(rel, 0) AS rel, coalesce(conf, 0) AS conf, coalesce(wt, 0) AS wt, coalesce(fresh, 0) AS fresh, coalesce(claims, 0) AS claims, coalesce(a.types, 0) AS types, coalesce(sources, 0) AS sources, coalesce(prim, 0) AS prim, coalesce(zero, 0) AS zero, coalesce(deg, 0) AS deg, coalesce(matched, 0) AS matched, i.query_id % 5 AS merged,
      list_has_any(required, ['primary-document','government','filing','medical']) OR list_has_any(i.types, ['source-attribution','adversarial','fresh-fact']) AS need FROM i LEFT JOIN a USING (query_id) LEFT JOIN m USING (query_id)),
    k AS (SELECT *, n / greatest(1, n + merged)::DOUBLE AS nr FROM j),
    p AS (SELECT *, floor(greatest(0, least(100, (rel + conf) / 2 * 100)) + 0.5) AS rc, floor(greatest(0, least(100, (0.72 * wt + 0.18 * (prim > 0)::INT + CASE WHEN NOT need THEN 0.08 WHEN prim > 0 THEN 0.1 ELSE -0.14 END) * 100)) + 0.5) AS sa,
      floor(greatest(0, least(100, (0.34 * least(1, claims / 8::DOUBLE) + 0.24 * least(1, types / 3::DOUBLE) + 0.16 * least(1, sources / 3::DOUBLE) + 0.16 * matched / greatest(1, len(required))::DOUBLE + 0.1 * nr) * 100)) + 0.5) AS cd, floor(greatest(0, least(100, fresh * 100)) + 0.5) AS ff FROM k),
    q AS (SELECT *, floor(greatest(0, least(100, 0.35 * rc + 0.25 * sa + 0.25 * cd + 0.15 * ff)) + 0.5) AS q0, floor(greatest(0, least(100, 0.65 * cd + 0.2 * rc + 15 * nr)) + 0.5) AS c0, CASE WHEN zero > 0 THEN greatest(0.45, 1 - zero / greatest(1, n)::DOUBLE) ELSE 1 END * CASE WHEN deg > 0 THEN greatest(0.55, 1 - 0.25 * deg / greatest(1, n)::DOUBLE) ELSE 1 END AS ze, CASE WHEN rel < 0.25 THEN 34 WHEN rel < 0.35 THEN 58 ELSE 100 END AS cap FROM p),
    z AS (SELECT *, CASE WHEN n > 0 THEN least(floor(q0 * ze + 0.5), cap) ELSE 0 END::BIGINT AS quality, CASE WHEN n > 0 THEN least(floor(c0 * ze + 0.5), cap) ELSE 0 END::BIGINT AS coverage FROM q)
    SELECT query_id, n AS selected, matched, quality, coverage, CASE WHEN n = 0 THEN 'insufficient' WHEN least(quality, coverage) >= 80 THEN 'strong' WHEN least(quality, coverage) >= 60 THEN 'adequate' WHEN least(quality, coverage) >= 35 THEN 'weak' ELSE 'insufficient' END AS status FROM z""")
def a11(spark, d):
    from quarry.operators import health

    s, i = _selected(spark, d)
    clusters = i.select("query_id", (F.col("query_id") % 5 + 1).alias("size"))
    return health.health(i, s, clusters).select("query_id", "selected", "matched", "quality", "coverage", "status")


_OVERLAP = "CASE WHEN len(x.own) = 0 OR len(y.own) = 0 THEN 0 ELSE len(list_intersect(x.own, y.own)) / least(len(x.own), len(y.own))::DOUBLE END"
_MATCHED = "len(list_filter(required, lambda r: CASE r WHEN 'primary-document' THEN stance = 'primary_source' OR source_type IN ('government','filing','structured_fact','medical') WHEN 'news' THEN false ELSE source_type = r END)) > 0"


@query("t11_gains_of_selections", f"""WITH {_SELECTED}, x AS (SELECT s.*, types, list_distinct({terms_sql("(CASE WHEN has_claim THEN text ELSE '' END)")}) AS own, 1 + CASE WHEN {_MATCHED} THEN 0.28 ELSE 0 END + CASE WHEN list_contains(types, 'multi-hop') THEN least(0.25, has_claim::INT * 0.04) ELSE 0 END + CASE WHEN list_contains(types, 'fresh-fact') THEN freshness * 0.25 ELSE 0 END AS tw,
      CASE WHEN list_contains(types, 'fresh-fact') AND stance = 'tertiary_summary' THEN 0.05 ELSE 0 END AS pen FROM s JOIN i USING (query_id)),
    o AS (SELECT x.doc_id, max({_OVERLAP}) AS alike FROM x JOIN x y ON y.query_id = x.query_id AND y.doc_id <> x.doc_id AND y.doc_id % 2 = 0 GROUP BY 1)
    SELECT x.query_id, 'c' || lpad(x.doc_id::VARCHAR, 8, '0') AS chunk_id, floor((relevance * CASE WHEN alike IS NULL THEN 1 ELSE least(1, greatest(0.05, 1 - alike)) END * weight * tw - pen) * 10000 + 0.5) / 10000 AS gain FROM x LEFT JOIN o USING (doc_id)""")
def t11(spark, d):
    from quarry.operators import assembly

    s, i = _selected(spark, d)
    c = s.join(i, "query_id").withColumn("surprise", F.lit(0.0))
    selection = s.filter("cast(substring(chunk_id, 2) as long) % 2 = 0").select("query_id", "chunk_id", F.lit("selected").alias("decision"))
    return assembly.final_gains(c, selection)
