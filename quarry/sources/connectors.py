"""Connectors: recorded payloads of search services to raw items, as ``from_json`` and ``select``.

Every mapping takes a DataFrame with a ``payload`` column (one response a row) and returns
(source, source_type, item_key, url, title, author, published, text). A payload that does not parse gives no rows
and one failure row in ``fetch``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.dims import SOURCE_TYPES
from quarry.functions.text import item_id, strip_html

# The shapes of the services' responses.
SCHEMAS = {
    "wikipedia": "pages array<struct<id:bigint,key:string,title:string,excerpt:string,description:string>>",
    "semantic_scholar": "data array<struct<paperId:string,title:string,abstract:string,url:string,year:int,publicationDate:string,authors:array<struct<name:string>>>>",
    "openalex": "results array<struct<id:string,doi:string,title:string,display_name:string,publication_date:string,abstract_inverted_index:map<string,array<int>>>>",
    "core": "results array<struct<id:string,title:string,abstract:string,authors:array<struct<name:string>>,publishedDate:string,downloadUrl:string,doi:string>>",
    "crossref": "message struct<items:array<struct<DOI:string,URL:string,title:array<string>,abstract:string,author:array<struct<given:string,family:string>>,published:struct<`date-parts`:array<array<int>>>,`published-online`:struct<`date-parts`:array<array<int>>>,`published-print`:struct<`date-parts`:array<array<int>>>>>>",
    "stack_exchange": "items array<struct<question_id:bigint,title:string,link:string,owner:struct<display_name:string>,creation_date:bigint,body:string,tags:array<string>>>",
    "hacker_news": "hits array<struct<objectID:string,title:string,story_title:string,url:string,story_url:string,author:string,created_at:string,comment_text:string,points:int,num_comments:int>>",
    "github": "items array<struct<id:bigint,full_name:string,html_url:string,description:string,updated_at:string,owner:struct<login:string>,language:string,stargazers_count:int>>",
    "wikidata": "results struct<bindings:array<struct<item:struct<value:string>,itemLabel:struct<value:string>,itemDescription:struct<value:string>>>>",
    "sec_edgar": "hits struct<hits:array<struct<_id:string,_source:struct<ciks:array<string>,file_date:string,form:string,display_names:array<string>,adsh:string>>>>",
    "data_gov": "results array<struct<identifier:string,slug:string,title:string,description:string,publisher:string,landingPage:string>>",
    "pubmed": "result map<string,struct<title:string,fulljournalname:string,pubdate:string,authors:array<struct<name:string>>,articleids:array<struct<idtype:string,value:string>>>>",
}


def _names(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda a: a["name"]), ", ")


def _text(*parts: Column) -> Column:
    return strip_html(F.concat_ws(" ", *(F.when(p != "", p) for p in parts)))


def _parts_date(c: Column) -> Column:
    p = c["date-parts"][0]
    two = lambda i: F.lpad(F.coalesce(F.get(p, F.lit(i)), F.lit(1)).cast("string"), 2, "0")
    return F.when(F.get(p, F.lit(0)).isNotNull(), F.concat_ws("-", F.get(p, F.lit(0)).cast("string"), two(1), two(2)))


def uninvert(index: Column) -> Column:
    """An abstract from its map of words to places."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def _row(source: str, key: Column, url: Column, title: Column, author: Column, published: Column, text: Column) -> list[Column]:
    return [F.lit(source).alias("source"), F.lit(SOURCE_TYPES.get(source, "academic")).alias("source_type"), item_id(F.lit(source), key).alias("item_key"), url.alias("url"), title.alias("title"), author.alias("author"), published.alias("published"), text.alias("text")]




def _maps() -> dict[str, tuple[str, Callable[[Column], list[Column]]]]:
    """By source: the path to the array of items, and the columns of an item."""
    none = F.lit(None).cast("string")
    return {
        "wikipedia": ("p.pages", lambda x: _row("wikipedia", x["key"], F.concat(F.lit("https://en.wikipedia.org/wiki/"), x["key"]), x["title"], none, none, _text(x["title"], x["description"], x["excerpt"]))),
        "semantic_scholar": ("p.data", lambda x: _row("semantic_scholar", x["paperId"], x["url"], x["title"], _names(x["authors"]), F.coalesce(x["publicationDate"], F.concat(x["year"].cast("string"), F.lit("-01-01"))), _text(x["abstract"]))),
        "openalex": ("p.results", lambda x: _row("openalex", x["id"], F.coalesce(x["doi"], x["id"]), F.coalesce(x["title"], x["display_name"]), none, x["publication_date"], uninvert(x["abstract_inverted_index"]))),
        "core": ("p.results", lambda x: _row("core", x["id"], F.coalesce(x["downloadUrl"], F.concat(F.lit("https://doi.org/"), x["doi"])), x["title"], _names(x["authors"]), x["publishedDate"], _text(x["abstract"]))),
        "crossref": ("p.message.items", lambda x: _row("crossref", x["DOI"], F.coalesce(x["URL"], F.concat(F.lit("https://doi.org/"), x["DOI"])), F.get(x["title"], F.lit(0)), F.array_join(F.transform(x["author"], lambda a: F.concat_ws(" ", a["given"], a["family"])), ", "), F.coalesce(_parts_date(x["published"]), _parts_date(x["published-online"]), _parts_date(x["published-print"])), _text(x["abstract"]))),
        "stack_exchange": ("p.items", lambda x: _row("stack_exchange", x["question_id"].cast("string"), x["link"], x["title"], x["owner"]["display_name"], F.date_format(F.timestamp_seconds(x["creation_date"]), "yyyy-MM-dd"), _text(x["body"]))),
        "hacker_news": ("p.hits", lambda x: _row("hacker_news", x["objectID"], F.coalesce(x["url"], x["story_url"], F.concat(F.lit("https://news.ycombinator.com/item?id="), x["objectID"])), F.coalesce(x["title"], x["story_title"]), x["author"], x["created_at"], _text(F.coalesce(x["comment_text"], x["title"])))),
        "github": ("p.items", lambda x: _row("github", x["full_name"], x["html_url"], x["full_name"], x["owner"]["login"], x["updated_at"], _text(x["description"], x["language"]))),
        "wikidata": ("p.results.bindings", lambda x: _row("wikidata", x["item"]["value"], x["item"]["value"], x["itemLabel"]["value"], none, none, _text(x["itemLabel"]["value"], x["itemDescription"]["value"]))),
        "sec_edgar": ("p.hits.hits", lambda x: _row("sec_edgar", x["_id"], F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.regexp_replace(x["_source"]["ciks"][0], "^0+", ""), F.lit("/"), F.regexp_replace(x["_source"]["adsh"], "-", ""), F.lit("/"), F.substring_index(x["_id"], ":", -1)), F.concat_ws(" - ", x["_source"]["form"], F.get(x["_source"]["display_names"], F.lit(0))), F.get(x["_source"]["display_names"], F.lit(0)), x["_source"]["file_date"], F.concat_ws(" ", x["_source"]["form"], F.get(x["_source"]["display_names"], F.lit(0))))),
        "data_gov": ("p.results", lambda x: _row("data_gov", F.coalesce(x["identifier"], x["slug"]), F.coalesce(x["landingPage"], F.concat(F.lit("https://catalog.data.gov/dataset/"), x["slug"])), x["title"], x["publisher"], none, _text(x["description"]))),
    }


def parse(payloads: DataFrame, source: str, limit: int = 10, keep: tuple[str, ...] = ()) -> DataFrame:
    """Items of every payload row, at most ``limit`` each, in response order, repositories by falling stars.

    ``keep``: columns of the payload's row to carry along, and then ``rank``, an item's place.
    """
    if source == "pubmed":
        return parse_pubmed(payloads, limit)
    if source == "arxiv":
        return parse_atom(payloads, limit)
    path, columns = _maps()[source]
    p = payloads.select(*keep, F.from_json("payload", SCHEMAS[source]).alias("p"))
    items = F.col(path)
    if source == "github":
        marked = F.transform(items, lambda x, i: F.struct((-F.coalesce(x["stargazers_count"], F.lit(0))).alias("s"), i.alias("i"), x.alias("x")))
        items = F.transform(F.array_sort(marked), lambda m: m["x"])
    p = p.select(*keep, F.posexplode(F.slice(items, 1, limit)).alias("rank", "x"))
    return p.select(*keep, *(["rank"] if keep else []), *columns(F.col("x")))


def parse_pubmed(payloads: DataFrame, limit: int) -> DataFrame:
    """``ids`` (array) in order joined to the summaries of ``payload``; the DOI from the article ids."""
    p = payloads.select(F.posexplode(F.slice("ids", 1, limit)).alias("pos", "id"), F.from_json("payload", SCHEMAS["pubmed"]).alias("p")).select("pos", "id", F.element_at(F.col("p.result"), F.col("id")).alias("x")).filter("x IS NOT NULL")
    x = F.col("x")
    return p.select(*_row("pubmed", F.col("id"), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), F.col("id"), F.lit("/")), x["title"], _names(x["authors"]), x["pubdate"], _text(x["title"], x["fulljournalname"])), F.get(F.filter(x["articleids"], lambda a: a["idtype"] == "doi"), F.lit(0))["value"].alias("doi"))


def parse_atom(payloads: DataFrame, limit: int) -> DataFrame:
    """Entries of an Atom feed."""
    tag = lambda e, t: strip_html(F.regexp_extract(e, rf"(?s)<{t}[^>]*>(.*?)</{t}>", 1))
    e = payloads.select(F.explode(F.slice(F.regexp_extract_all("payload", F.lit(r"(?s)<entry>(.*?)</entry>"), F.lit(1)), 1, limit)).alias("e"))
    x = F.col("e")
    authors = F.array_join(F.regexp_extract_all(x, F.lit(r"(?s)<name>\s*(.*?)\s*</name>"), F.lit(1)), ", ")
    return e.select(*_row("arxiv", tag(x, "id"), tag(x, "id"), tag(x, "title"), authors, F.coalesce(F.nullif(tag(x, "published"), F.lit("")), tag(x, "updated")), tag(x, "summary")))


def classify_error(code: Column, message: Column) -> Column:
    """The category of a failure, by the first rule that holds."""
    both = F.lower(F.concat_ws(" ", code, message))
    return (
        F.when(both.rlike("missing|disabled|api_key|user_agent"), "missing_config").when(both.rlike("429|rate"), "rate_limited").when(both.rlike("400|invalid|malformed"), "query_invalid")
        .when(both.rlike("timeout|abort"), "timeout").when(both.rlike("50[0-9]|unavailable|network|fetch failed"), "unavailable").otherwise("unknown")
    )


def fetch(payloads: DataFrame, source: str, key: str = "task") -> DataFrame:
    """One row a payload: ok, items or the failure; never raises on a malformed payload."""
    schema = SCHEMAS[source]
    good = F.from_json("payload", schema, {"mode": "PERMISSIVE"})
    first = schema.split(" ")[0]
    ok = good.getField(first).isNotNull()
    n = F.when(F.col("payload").startswith("{"), F.lit(1)).otherwise(F.lit(0))
    return payloads.select(key, F.lit(source).alias("source"), ok.alias("ok"), F.when(~ok, F.when(n == 0, "MALFORMED_PAYLOAD").otherwise("MISSING_FIELD")).alias("code"))


def routed(tasks: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and results of tasks (query_id, ix, source, max_results, error) by their recorded responses (query_id, ix, source,
    payload, code): items with their task, at most ``max_results`` of each; one result a task, ok or with a code and category.

    A task without a connector or a response, and a payload that is not of its service's form, are failures, never errors.
    """
    key = ["query_id", "ix", "source"]
    r = tasks.join(responses, key, "left")
    good = [s for s in SCHEMAS if s != "pubmed"]
    items, oks = None, F.lit(False)
    for source in good:
        first = SCHEMAS[source].split(" ")[0]
        oks = oks | ((F.col("source") == source) & F.coalesce(F.from_json("payload", SCHEMAS[source]).getField(first).isNotNull(), F.lit(False)))
        found = parse(r.filter((F.col("source") == source) & F.col("code").isNull()).drop("source", "text", "title"), source, keep=("query_id", "ix", "max_results")).filter("rank < max_results").drop("max_results")
        items = found if items is None else items.unionByName(found)
    failed = F.coalesce("error", F.col("code"), F.when(F.col("payload").isNull(), "NO_RESPONSE"), F.when(~oks, F.when(F.trim("payload").startswith("{"), "MISSING_FIELD").otherwise("MALFORMED_PAYLOAD")))
    results = r.select(*key, failed.isNull().alias("ok"), failed.alias("code"), F.when(failed.isNotNull(), classify_error(failed, F.lit(""))).alias("category"))
    return items, results


def http_get(url: str, timeout: float = 8.0, agent: str = "quarry/1") -> tuple[bool, str | None, str | None, bool]:
    """(ok, body, code, retryable) of an address; never raises. Rate limits and server errors may be tried again."""
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as response:
            return True, response.read().decode("utf-8", "replace"), None, False
    except urllib.error.HTTPError as e:
        return False, None, f"HTTP_{e.code}", e.code == 429 or e.code >= 500
    except TimeoutError:
        return False, None, "TIMEOUT", True
    except (OSError, ValueError) as e:
        return False, None, "TIMEOUT" if "timed out" in str(e) else "NETWORK", not isinstance(e, ValueError)


# Words that a repository search leaves out, and words that it puts first.
SEARCH_STOP = [
    "about", "after", "again", "also", "and", "are", "because", "before", "being", "between", "but", "can", "could", "did", "does", "doing", "for", "from", "had", "has", "have", "how", "into", "its", "more", "most", "not", "should", "than", "that",
    "the", "their", "them", "there", "these", "they", "this", "through", "was", "were", "what", "when", "where", "which", "while", "who", "why", "will", "with", "would", "you", "your",
]
FIRST = r"(?i)^(owasp|asvs|nist|cisa|appsec|security|sast|dast|sca|webhook|auth|authorization|vulnerability|scanner|semgrep|codeql|trivy|zap|dependency|secret|iac|ssrf|csrf|cors)$"
SECOND = r"(?i)^(implementation|example|template|repository|library|framework|docs|testing|validation|release|gate)$"


def compact_query(query: Column, most: int = 220, most_encoded: int = 256) -> Column:
    """A repository search: distinct words, telling ones first, as many as fit in characters and in their encoded form."""
    words = F.split(F.regexp_replace(query, "[\"'`\u201c\u201d\u2018\u2019]", " "), r"[^a-zA-Z0-9_.#+-]+")
    words = F.filter(words, lambda w: (F.length(w) > 1) & ~F.lower(w).isin(*SEARCH_STOP))
    lower = F.transform(words, lambda w: F.lower(w))
    once = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_position(lower, F.lower(x["w"])) == x["i"] + 1)
    worth = lambda w: F.least(F.lit(12), F.length(w)) + F.when(w.rlike(FIRST), 20).otherwise(0) + F.when(w.rlike(SECOND), 10).otherwise(0) + F.when(w.rlike("[._#+-]"), 4).otherwise(0)
    ordered = F.transform(F.array_sort(F.transform(once, lambda x: F.struct((-worth(x["w"])).alias("o"), x["i"].alias("i"), x["w"].alias("w")))), lambda x: x["w"])
    encoded = lambda s: F.length(F.regexp_replace(F.regexp_replace(s, "[^A-Za-z0-9_.~!*'()-]", "%xx"), "%xx", "xxx"))  # noqa: E731  (ASCII words)
    grown = lambda s, w: F.when(s == "", w).otherwise(F.concat(s, F.lit(" "), w))
    found = F.aggregate(ordered, F.lit(""), lambda s, w: F.when((F.length(grown(s, w)) <= most) & (encoded(grown(s, w)) <= most_encoded), grown(s, w)).otherwise(s))
    return F.when(found != "", found).otherwise("secure software development appsec testing")


def query_variants(query: Column, most: int = 5) -> Column:
    """The query and, by what it is on, the names of data sets to try after it."""
    lower, none = F.lower(query), F.array().cast("array<string>")
    rules = [  # fixed values
        ("(oil|crude|wti|brent|petroleum|gasoline|fuel)", ["oil prices", "Short-Term Energy Outlook petroleum prices", "crude oil", "petroleum prices"]), ("(inflation|cpi|prices|consumer price)", ["consumer price index", "inflation"]),
        ("(employment|jobs|unemployment|labor)", ["unemployment", "employment"]), ("(gdp|gross domestic product|economic growth)", ["gross domestic product", "GDP"]),
    ]
    more = [F.when(lower.rlike(p), F.array(*map(F.lit, v))).otherwise(none) for p, v in rules]
    return F.slice(F.array_distinct(F.filter(F.concat(F.array(F.trim(query)), *more), lambda v: v != "")), 1, most)


def first_non_empty(responses: DataFrame, key: str, order: str = "variant") -> DataFrame:
    """Of a task's responses (with ``items``, their number) the first that has any, else the last."""
    full = F.col("items") > 0
    rank = F.struct(F.when(full, 0).otherwise(1).alias("a"), F.when(full, F.col(order)).otherwise(-F.col(order)).alias("b"))
    return responses.groupBy(key).agg(F.min_by(F.struct(*responses.columns), rank).alias("r")).select("r.*")


def disabled(registry: DataFrame, settings: dict[str, str]) -> DataFrame:
    """(source, code, message, retryable) of connectors that lack a setting: an API key, or a user agent."""
    lacks = [(s, code, text) for s, name, code, text in (("core", "core_api_key", "CORE_API_KEY_MISSING", "the API key is not set"), ("sec_edgar", "sec_user_agent", "SEC_USER_AGENT_MISSING", "the user agent is not set")) if not settings.get(name)]
    rows = F.explode(F.array(*(F.struct(F.lit(s).alias("s"), F.lit(c).alias("code"), F.lit(m).alias("message")) for s, c, m in lacks)) if lacks else F.array().cast("array<struct<s:string,code:string,message:string>>"))
    return registry.select("source", rows.alias("x")).filter("source = x.s").select("source", "x.code", "x.message", F.lit(False).alias("retryable"))


def retried(tries: DataFrame, key: str, budget: int = 2) -> DataFrame:
    """By task: how many of its rate-limited tries (``code`` HTTP_429) a budget lets it repeat, and whether it gave up."""
    limited = F.count_if(F.col("code") == "HTTP_429")
    return tries.groupBy(key).agg(F.least(F.lit(budget), limited).alias("retries"), (limited > budget).alias("gave_up"))
