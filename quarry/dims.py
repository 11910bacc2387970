"""Constant tables of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Source and type weights, stances, stop words and rules that results depend on.
SOURCE_WEIGHTS = {
    "sec_edgar": 0.98, "data_gov": 0.95, "wikidata": 0.86, "wikipedia": 0.72, "arxiv": 0.88, "semantic_scholar": 0.86, "pubmed": 0.93,
    "openalex": 0.84, "core": 0.8, "crossref": 0.82, "github": 0.74, "stack_exchange": 0.58, "hacker_news": 0.42, "official_docs": 0.92,
}
TYPE_WEIGHTS = {
    "filing": 0.98, "government": 0.95, "medical": 0.93, "academic": 0.87, "structured_fact": 0.86,
    "code": 0.74, "encyclopedic": 0.72, "forum": 0.55, "tech_discussion": 0.42, "other": 0.35,
}
DEFAULT_WEIGHT = 0.35
SOURCES = list(SOURCE_WEIGHTS)
#: The order in which sources are asked.
ASKED = [
    "wikipedia", "arxiv", "semantic_scholar", "pubmed", "openalex", "core", "crossref", "stack_exchange", "hacker_news", "github", "wikidata", "sec_edgar", "data_gov", "official_docs",
]
SOURCE_TYPES = {
    "sec_edgar": "filing", "data_gov": "government", "official_docs": "government", "pubmed": "medical", "wikipedia": "encyclopedic",
    "wikidata": "structured_fact", "github": "code", "stack_exchange": "forum", "hacker_news": "tech_discussion",
}
STANCES = {
    "filing": "primary_source", "government": "primary_source", "academic": "secondary_analysis", "medical": "secondary_analysis", "code": "secondary_analysis",
    "encyclopedic": "tertiary_summary", "structured_fact": "tertiary_summary", "forum": "opinion", "tech_discussion": "opinion",
}
PRERANK_STOPWORDS = [
    "about", "after", "also", "because", "before", "between", "could", "from", "have", "into", "like", "more", "most", "that", "their", "there", "these", "this", "what",
    "when", "where", "which", "while", "with", "would", "your",
]
SCORE_STOPWORDS = [
    "about", "after", "again", "also", "because", "being", "between", "could", "does", "doing", "down", "each", "exactly", "from", "have", "more", "most", "should",
    "that", "their", "there", "these", "they", "this", "through", "using", "what", "when", "where", "which", "while", "with", "would",
]
GAP_STOPWORDS = [
    "about", "after", "again", "against", "also", "because", "been", "being", "between", "could", "does", "doing", "down", "each", "exactly", "from", "have", "more",
    "most", "should", "that", "their", "there", "these", "they", "this", "through", "towards", "using", "what", "when", "where", "which", "while", "with", "would",
]
# Rules of intents and domains, phrase boosts, sources by type and topic, aliases, tracking parameters.
OIL = "(oil|crude|wti|brent|opec|gasoline|energy|petroleum|fuel|commodity|commodities)"
INTENT_RULES = [  # pattern, query types, source types
    ("(debt|inflation|deficit|spending|fiscal|geopolitic|market downturn|crash)", ["multi-hop", "fresh-fact"], ["government", "academic"]),
    ("(source|cite|attribution|edgar|filing|legal|insider|owasp|nist|cisa)", ["source-attribution", "adversarial"], ["primary-document"]),
    ("(duplicate|dedup|submodular|bayesian|embedding|similarity|pipeline)", ["multi-hop", "academic", "source-attribution"], ["academic", "code"]),
    ("(vibecode|appsec|security|pre-production|webhook|sast|dast)", ["source-attribution", "adversarial"], ["code", "primary-document"]),
    ("(retail|institution|trader|bank|news|market)", ["multi-hop", "source-attribution"], ["filing", "government"]),
    (OIL, ["fresh-fact", "multi-hop"], ["government", "academic", "encyclopedic"]),
]
DOMAIN_RULES = [
    ("(security|appsec|owasp|vulnerability|auth|webhook)", "appsec"),
    ("(market|trader|inflation|debt|fiscal|fed|sec|filing|macro)", "markets_macro"),
    ("(medical|clinical|pubmed|health)", "medical"),
    ("(dedup|embedding|submodular|bayesian|pipeline|similarity)", "technical_retrieval"),
]
PHRASE_BOOSTS = [  # query pattern, content pattern, boost
    ("(oil|crude|wti|brent|petroleum)", "(eia|short-term energy outlook|steo|supply|demand|inventory|forecast)", 0.22),
    ("(trader|institution|bank|news|market data|co-?location|direct feed)", "(sec|direct feed|co-location|edgar|fomc|cpi|market data|exchange)", 0.24),
    ("(dedup|duplicate|submodular|bayesian|similarity|pipeline)", "(submodular|embedding|similarity|truth discovery|bayesian|jensen|kl|claim)", 0.22),
    ("(appsec|security|vibecode|owasp|nist|cisa)", "(owasp|nist|cisa|authorization|access control|verification|ssdf)", 0.24),
    ("(debt|deficit|inflation|fiscal|cbo|treasury)", "(cbo|treasury|interest|deficit|debt|inflation)", 0.2),
]
TYPE_SOURCES = {
    "academic": ["arxiv", "semantic_scholar", "openalex", "crossref"], "medical": ["pubmed"], "encyclopedic": ["wikipedia"], "forum": ["stack_exchange", "hacker_news"],
    "code": ["github"], "filing": ["sec_edgar"], "government": ["official_docs", "data_gov", "wikidata"],
    "primary-document": ["official_docs", "data_gov", "sec_edgar", "wikidata", "openalex", "crossref"],
}
TOPIC_SOURCES = [
    ("(debt|deficit|inflation|cbo|treasury|fred)", ["official_docs", "data_gov", "openalex", "crossref"]),
    (OIL, ["wikipedia", "wikidata", "data_gov", "openalex", "crossref"]),
    ("(appsec|owasp|nist|cisa|security|vibecode)", ["official_docs", "github", "stack_exchange", "crossref"]),
    ("(market|crash|downturn|trader|filing|edgar|co-location|macro)", ["official_docs", "sec_edgar", "data_gov", "crossref", "wikipedia"]),
    ("(duplicate|dedup|submodular|bayesian|embedding|truth discovery)", ["arxiv", "semantic_scholar", "github", "crossref"]),
]
SOURCE_ALIASES = {
    "eia": ["data_gov"], "energy_information_administration": ["data_gov"], "fred": ["data_gov"], "bls": ["data_gov"], "bea": ["data_gov"],
    "opec": ["wikidata", "openalex"], "iea": ["openalex", "crossref"], "scholar": ["semantic_scholar", "openalex"], "google_scholar": ["semantic_scholar", "openalex"],
    "sec": ["sec_edgar"], "edgar": ["sec_edgar"], "wiki": ["wikipedia"], "wikidata_sparql": ["wikidata"], "government": ["data_gov"], "official_data": ["data_gov"],
    "sec_gov": ["official_docs", "sec_edgar"], "nist": ["official_docs"], "cisa": ["official_docs"], "owasp": ["official_docs"],
    "eia_open_data": ["official_docs", "data_gov"], "eia_steo": ["official_docs", "data_gov"], "exchange_docs": ["official_docs"],
}
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid"]
#: mode, attempts of a model call, extraction, repair rounds, chunks that pre-ranking keeps
MODE_POLICY = [("fast", 1, False, 0, 18), ("balanced", 1, True, 2, 12), ("quality", 2, True, 4, 18)]
NOW = "2025-01-01 00:00:00"


def lookup(table: dict, key: Column, default=None) -> Column:
    """A literal map's value of ``key``."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*entries), key), F.lit(default))


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def source_weight(source: Column, kind: Column) -> Column:
    """The larger of a source's and its type's weight."""
    return F.greatest(lookup(SOURCE_WEIGHTS, source, DEFAULT_WEIGHT), lookup(TYPE_WEIGHTS, kind, DEFAULT_WEIGHT))


def registry(spark: SparkSession) -> DataFrame:
    """The catalog of connectors: (source, source_type, weight)."""
    rows = [(s, SOURCE_TYPES.get(s, "academic"), SOURCE_WEIGHTS[s]) for s in SOURCES]
    return spark.createDataFrame(rows, "source string, source_type string, weight double")
