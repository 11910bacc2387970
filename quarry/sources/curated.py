"""Sources without a service: a curated table of official documents, made-up items, fixtures of other engines, web searches."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import terms

# Id, title, address, author, type, tags and summary of official documents.
OFFICIAL = [
    ("sec-market-structure", "SEC Market Structure", "https://www.sec.gov/market-structure", "U.S. Securities and Exchange Commission", "government", ["sec", "market structure", "direct feeds", "co-location", "exchange data", "trading", "latency"], "SEC market-structure material is a primary source for U.S. equity market plumbing, including exchanges, market data, order routing, trading centers, and low-latency infrastructure context."),
    ("sec-edgar-access", "SEC EDGAR Access Guidance", "https://www.sec.gov/os/accessing-edgar-data", "U.S. Securities and Exchange Commission", "government", ["sec", "edgar", "filings", "fair access", "rate limits", "10 requests per second", "disclosures"], "SEC EDGAR access guidance explains programmatic access expectations and fair-access limits for public company filings and disclosure feeds."),
    ("fed-fomc-calendar", "Federal Reserve FOMC Calendars", "https://www.federalreserve.gov/monetarypolicy/fomccalendars.htm", "Board of Governors of the Federal Reserve System", "government", ["fomc", "federal reserve", "macro releases", "scheduled events", "rates", "trading"], "The Federal Reserve publishes scheduled FOMC calendars and policy materials that institutions prepare for before market-moving macro events."),
    ("bls-cpi", "BLS Consumer Price Index", "https://www.bls.gov/cpi/", "U.S. Bureau of Labor Statistics", "government", ["cpi", "inflation", "macro release", "scheduled releases", "prices", "economy"], "BLS CPI is a primary scheduled macro release used to track inflation surprises, expectations, rates, and market reactions."),
    ("treasury-fiscal-data", "Treasury Fiscal Data", "https://fiscaldata.treasury.gov/", "U.S. Department of the Treasury", "government", ["treasury", "debt", "interest costs", "fiscal data", "auctions", "government finance"], "Treasury Fiscal Data is a primary public-data portal for U.S. debt, interest costs, fiscal flows, and Treasury auction datasets."),
    ("cbo-long-term-budget", "CBO Long-Term Budget Outlook", "https://www.cbo.gov/topics/budget/long-term-budget", "Congressional Budget Office", "government", ["cbo", "debt", "deficits", "interest costs", "fiscal capacity", "budget projections"], "CBO long-term budget projections are primary high-authority evidence for deficits, debt, interest costs, and fiscal-capacity pressure."),
    ("eia-steo", "EIA Short-Term Energy Outlook", "https://www.eia.gov/outlooks/steo/", "U.S. Energy Information Administration", "government", ["eia", "oil", "crude", "brent", "wti", "petroleum", "forecast", "prices", "supply", "demand"], "EIA STEO is an official forecast source for oil prices, petroleum supply and demand, inventories, consumption, production, and energy-market outlooks."),
    ("eia-open-data", "EIA Open Data", "https://www.eia.gov/opendata/", "U.S. Energy Information Administration", "government", ["eia", "oil", "energy data", "api", "petroleum", "gasoline", "prices", "inventory"], "EIA Open Data documents public access to energy datasets and APIs for petroleum, crude oil, electricity, natural gas, forecasts, and prices."),
    ("owasp-top-ten", "OWASP Top 10", "https://owasp.org/www-project-top-ten/", "OWASP Foundation", "other", ["owasp", "appsec", "web security", "access control", "injection", "misconfiguration", "vulnerabilities"], "OWASP Top 10 is a high-authority application-security reference for recurring web-application risks such as broken access control, injection, and misconfiguration."),
    ("owasp-asvs", "OWASP Application Security Verification Standard", "https://owasp.org/www-project-application-security-verification-standard/", "OWASP Foundation", "other", ["owasp", "asvs", "appsec", "verification", "testing", "auth", "session", "authorization"], "OWASP ASVS is a verification standard for application-security controls, useful for converting LLM-assisted review into concrete release gates."),
    ("nist-ssdf", "NIST Secure Software Development Framework SP 800-218", "https://csrc.nist.gov/pubs/sp/800/218/final", "National Institute of Standards and Technology", "government", ["nist", "ssdf", "secure software", "sdlc", "pre-production", "security testing"], "NIST SSDF frames secure software development as repeatable SDLC practices rather than a single final security scan."),
    ("cisa-secure-by-design", "CISA Secure by Design", "https://www.cisa.gov/securebydesign", "Cybersecurity and Infrastructure Security Agency", "government", ["cisa", "secure by design", "software security", "appsec", "release gates", "security defaults"], "CISA Secure by Design guidance emphasizes building security into product design, defaults, testing, and development practices."),
    ("nasdaq-totalview", "Nasdaq TotalView Market Data", "https://www.nasdaqtrader.com/Trader.aspx?id=TotalView2", "Nasdaq", "other", ["nasdaq", "direct feed", "market data", "order book", "trading", "latency", "exchange"], "Nasdaq TotalView documentation is an exchange-side reference for direct market data depth feeds used by professional market participants."),
    ("cme-market-data-platform", "CME Market Data Platform", "https://www.cmegroup.com/market-data/real-time/market-data-platform.html", "CME Group", "other", ["cme", "market data", "direct feed", "futures", "latency", "exchange"], "CME Market Data Platform documentation describes real-time exchange market data delivery for derivatives and futures markets."),
    ("huggingface-minilm", "all-MiniLM-L6-v2 model card", "https://huggingface.co/sentence-transformers/all-MiniLM-L6-v2", "Hugging Face and sentence-transformers", "code", ["embeddings", "miniLM", "semantic similarity", "sentence transformers", "deduplication", "vectors"], "The all-MiniLM-L6-v2 model card documents a lightweight sentence-transformer embedding model commonly used for semantic similarity and clustering."),
]
# Made-up items for runs without any source, with the query put in.
MADE_UP = [
    ("mock:cbo", "data_gov", "government", "https://www.cbo.gov/", "Mock official data result", "Public agency", "Official data relevant to {q}. It includes primary-source evidence, fiscal constraints, source attribution, and traceable decision points.", "Mock official source summary."),
    ("mock:academic", "crossref", "academic", "https://api.crossref.org/", "Mock academic result", "Research metadata", "Academic metadata relevant to {q}. It supports corroborating evidence, definitions, and method framing for a consuming LLM.", "Mock academic source summary."),
    ("mock:discussion", "github", "code", "https://github.com/", "Mock code evidence result", "Public repository", "Code-oriented evidence relevant to {q}. It highlights implementation choices, tests, validation, and operational guardrails.", "Mock code source summary."),
]


def official_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(OFFICIAL)], "n int, doc_id string, title string, url string, author string, source_type string, tags array<string>, summary string")


def official(asked: DataFrame) -> DataFrame:
    """(query_id, r, doc_id, title, url, author, source_type, summary, score): of every sub-query (query_id, sub_query,
    max_results) the documents of best score; all stand in where none scores. The table is a literal in the query."""
    words = F.array_distinct(terms(F.col("sub_query"), 2))
    told = terms(F.concat_ws(" ", F.col("d.title"), F.col("d.summary"), F.array_join("d.tags", " ")), 2)
    table = F.array(*(F.struct(F.lit(i).alias("n"), *(F.lit(v).alias(k) for k, v in zip(("doc_id", "title", "url", "author", "source_type"), r[:5], strict=True)), F.array(*map(F.lit, r[5])).alias("tags"), F.lit(r[6]).alias("summary")) for i, r in enumerate(OFFICIAL)))
    each = asked.select("query_id", "sub_query", "max_results", F.explode(table).alias("d"))
    overlap = F.when(F.size(words) == 0, 0.0).otherwise(F.size(F.array_intersect(words, told)) / F.size(words))
    phrases = F.size(F.filter("d.tags", lambda t: F.contains(F.lower("sub_query"), F.lower(t)))) * 0.35
    s = each.withColumn("score", F.round(overlap + phrases, 9))
    own = W.partitionBy("query_id")
    s = s.withColumn("best", F.max("score").over(own)).filter("score > 0 OR best = 0").withColumn("r", F.row_number().over(own.orderBy(F.desc("score"), "d.n")))
    return s.filter(F.col("r") <= F.greatest(F.lit(1), F.least(F.lit(10), F.col("max_results")))).select("query_id", "r", "d.doc_id", "d.title", "d.url", "d.author", "d.source_type", "d.summary", "score")


def made_up(asked: DataFrame) -> DataFrame:
    """Three raw items a query, marked as made up."""
    rows = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("id", "source", "source_type", "url", "title", "author"), r[:6], strict=True)), F.replace(F.lit(r[6]), F.lit("{q}"), F.col("query")).alias("text"), F.lit(r[7]).alias("summary")) for r in MADE_UP))
    return asked.select("query_id", F.explode(rows).alias("i")).select("query_id", "i.*", F.lit("mock").alias("mode"))


FIXTURE = "engine string, question_id string, answer string, mode string, token_count double, time_ms double"


def fixtures(texts: DataFrame, live: str = "manual") -> DataFrame:
    """Results of other engines from JSON texts (file, value): an array, ``{"fixtures": [...]}``, ``{"results": [...]}`` or one
    object; results that call themselves live become ``live``, and one without engine or question is a problem."""
    many = f"array<struct<{FIXTURE.replace(' ', ':').replace(',:', ',')}>>"
    v = F.col("value")
    body = F.coalesce(F.get_json_object(v, "$.fixtures"), F.get_json_object(v, "$.results"), F.when(F.trim(v).rlike(r"^\["), v), F.concat(F.lit("["), v, F.lit("]")))
    read = texts.select("file", F.posexplode_outer(F.from_json(body, many)).alias("n", "f")).select("file", "n", "f.*")
    problem = F.when(F.col("n").isNull(), "not JSON").when(F.coalesce("engine", F.lit("")) == "", "engine is missing").when(F.coalesce("question_id", F.lit("")) == "", "question is missing")
    return read.select("file", "n", "engine", "question_id", "answer", F.when(F.col("mode") == "live", live).otherwise(F.coalesce("mode", F.lit(live))).alias("mode"), F.greatest(F.lit(0), F.floor(F.coalesce("token_count", F.lit(0.0)))).alias("token_count"), problem.alias("problem"))


def harvested(payload: Column, most: int = 12) -> Column:
    """Web addresses anywhere in a JSON payload, in order, each once, without closing marks."""
    found = F.regexp_extract_all(payload, F.lit(r"https?://[^\s\"'<>\\\\)\]}]+"), F.lit(0))
    return F.slice(F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?]+$", ""))), 1, most)


def long_texts(payload: Column, least: int = 80) -> Column:
    """String values of a JSON payload of some length that are no addresses, in order, each once."""
    found = F.regexp_extract_all(payload, F.lit(r":\s*\"((?:[^\"\\\\]|\\\\.)*)\""), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= least) & ~t.rlike("^https?://")))


def provider_row(results: DataFrame) -> DataFrame:
    """Rows of other engines' web searches (engine, question_id, payload): mode live, or missing without a payload; no score."""
    has = F.coalesce(F.trim("payload"), F.lit("")) != ""
    texts = long_texts(F.coalesce("payload", F.lit("")))
    return results.select("engine", "question_id", F.when(has, "live").otherwise("missing").alias("mode"), F.lit("scoring_unavailable").alias("score_status"), F.coalesce(F.get(texts, F.lit(0)), F.lit("")).alias("answer"), harvested(F.coalesce("payload", F.lit(""))).alias("urls"))


def _nodes(payload: object) -> list[dict]:
    """All objects of a parsed payload, each before what it holds, in the payload's order; of any depth."""
    out, todo = [], [payload]
    while todo:
        node = todo.pop()
        inner = list(node.values()) if isinstance(node, dict) else node if isinstance(node, list) else []
        if isinstance(node, dict):
            out.append(node)
        todo += reversed(inner)
    return out


def _first(node: dict, names: tuple[str, ...]) -> str | None:
    return next((node[n] for n in names if isinstance(node.get(n), str) and node[n].strip()), None)


def _told(engine: str, payload: object) -> str:
    """The answer, where each service has it; of any other shape the first four long texts."""
    told = payload if isinstance(payload, dict) else {}
    if engine == "openai" and isinstance(told.get("output_text"), str):
        return told["output_text"]
    parts = None
    if engine == "claude" and isinstance(told.get("content"), list):
        parts = [p["text"] for p in told["content"] if isinstance(p, dict) and p.get("type") == "text" and isinstance(p.get("text"), str)]
    if engine == "gemini" and isinstance(told.get("candidates"), list):
        held = [c["content"]["parts"] for c in told["candidates"] if isinstance(c, dict) and isinstance(c.get("content"), dict) and isinstance(c["content"].get("parts"), list)]
        parts = [p["text"] for h in held for p in h if isinstance(p, dict) and isinstance(p.get("text"), str)]
    if parts is None:
        parts = list(dict.fromkeys(n["text"] for n in _nodes(payload) if isinstance(n.get("text"), str) and len(n["text"]) > 40))[:4]
    return "\n\n".join(parts).strip()


def _searched(engine: pd.Series, payload: pd.Series) -> pd.DataFrame:
    out = []
    for name, text in zip(engine, payload, strict=True):
        try:
            told = json.loads(text) if text is not None else None
        except (ValueError, RecursionError):
            told = None
        found: dict[str, str] = {}
        for node in _nodes(told):
            url = _first(node, ("url", "uri"))
            if url and re.match("(?i)https?://", url):
                found.setdefault(url, _first(node, ("title", "name")) or url)
        out.append((told is not None, _told(name, told), [{"url": u, "title": t} for u, t in [*found.items()][:12]]))
    return pd.DataFrame(out, columns=["parsed", "answer", "sources"])


def provider_answers(results: DataFrame) -> DataFrame:
    """Web searches of other engines (engine, question_id, payload) as result rows: the answer as the service tells it, and up
    to twelve sources (url, title) from anywhere in the payload, in its order, each address once.

    A row without a payload is missing; one whose payload is no JSON is malformed, with an empty answer. Nothing is scored.
    """
    has = F.coalesce(F.trim("payload"), F.lit("")) != ""
    searched = F.pandas_udf(_searched, "struct<parsed:boolean,answer:string,sources:array<struct<url:string,title:string>>>")
    found = results.withColumn("found", searched("engine", F.when(has, F.col("payload"))))
    mode = F.when(~has, "missing").when(F.col("found.parsed"), "live").otherwise("malformed")
    return found.select("engine", "question_id", mode.alias("mode"), F.lit("scoring_unavailable").alias("score_status"), F.col("found.answer").alias("answer"), F.col("found.sources").alias("sources"))
