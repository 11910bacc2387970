"""Constant tables of plans: which sub-queries a topic asks, first and when evidence has gaps."""

from __future__ import annotations

# Patterns, sub-queries ({q} is the query), sources, retrieval intents and result limits that results depend on.
ACADEMIC = ["semantic_scholar", "arxiv", "crossref"]
PAPERS = ["semantic_scholar", "openalex", "crossref"]

#: name, pattern of the lower-cased query, rows (sub-query, sources, intent, limit); the first topic that fits plans alone
PLANS = [
    ("trading", r"(institution|bank|trader|top traders|news updates|squawk|co-?location|direct feeds?|market data|edgar|macro releases?|competitive edge)", [
        ("SEC market structure direct exchange data feeds co-location public guidance", ["official_docs"], "primary_evidence", 6),
        ("SEC EDGAR access guidance public filings 8-K 10-Q 10-K fair access rate limits", ["official_docs", "sec_edgar"], "primary_evidence", 5),
        ("Federal Reserve FOMC BLS CPI macro release calendar expectations surprise trading", ["official_docs", "data_gov"], "temporal", 6),
        ("institutional traders market data feeds squawk news NLP entity mapping expectations versus surprise", PAPERS, "corroborating", 6),
        ("material nonpublic information insider trading compliance public information SEC guidance", ["official_docs", "sec_edgar"], "contrarian", 5),
    ]),
    ("retrieval", r"(dedup|duplicates?|submodular|bayesian|source reliability|truth discovery|jensen|kl divergence|token budget|learned similarity)", [
        ("domain specific duplicate detection entity resolution learned similarity claim overlap", ACADEMIC, "primary_evidence", 6),
        ("sentence transformers all-MiniLM-L6-v2 semantic similarity clustering embeddings", ["official_docs", "github"], "primary_evidence", 5),
        ("information theoretic novelty KL divergence Jensen Shannon divergence text summarization retrieval", ["arxiv", "semantic_scholar", "crossref"], "corroborating", 6),
        ("submodular optimization budgeted multi document summarization greedy coverage token budget", ["arxiv", "semantic_scholar", "crossref"], "primary_evidence", 6),
        ("truth discovery Bayesian source reliability source correlation consensus herding", ["arxiv", "semantic_scholar", "crossref"], "primary_evidence", 6),
    ]),
    ("oil", r"(oil|crude|wti|brent|opec|gasoline|energy|petroleum|fuel|commodity|commodities)", [
        ("EIA Short-Term Energy Outlook crude oil Brent WTI price forecast supply demand inventory", ["official_docs", "data_gov"], "temporal", 7),
        ("{q} crude oil price forecast EIA Brent WTI supply demand inventory", ["data_gov", "official_docs"], "temporal", 6),
        ("{q} OPEC Brent WTI crude oil supply demand background", ["wikipedia", "wikidata"], "definitional", 4),
        ("{q} crude oil price forecast supply demand geopolitical risk analysis", ["openalex", "crossref"], "corroborating", 5),
        ("{q} crude oil prices forecast literature supply shock demand shock", ["semantic_scholar", "arxiv"], "contrarian", 4),
    ]),
]

#: name, pattern, repair rows, facets (name, terms of which one must occur in the selection), sources whose failure matters
GAPS = [
    ("trading", r"(institution|bank|trader|top traders|news|squawk|co-?location|direct feed|edgar|macro release|market data)", [
        ("SEC market structure direct feeds co-location exchange data feeds public guidance", ["official_docs"], "primary_evidence", 6),
        ("SEC EDGAR access guidance public filings fair access rate limits", ["official_docs", "sec_edgar"], "primary_evidence", 5),
        ("Federal Reserve FOMC calendar CPI BLS scheduled macro releases market surprise", ["official_docs", "data_gov"], "temporal", 6),
        ("exchange direct market data feed order book co-location documentation", ["official_docs"], "primary_evidence", 5),
        ("institutional market data feeds news squawk expectations versus surprise market microstructure", PAPERS, "corroborating", 6),
        ("material nonpublic information trading compliance SEC insider trading public information", ["official_docs", "sec_edgar"], "contrarian", 5),
    ], [
        ("direct feeds/co-location", ["direct feed", "co-location", "colocation", "exchange data"]),
        ("scheduled macro releases", ["fomc", "cpi", "macro", "scheduled", "release calendar"]),
        ("SEC filings/EDGAR", ["edgar", "8-k", "10-q", "filing", "disclosure"]),
        ("expectations versus surprise", ["surprise", "expectation", "consensus"]),
        ("legal/compliance boundaries", ["material nonpublic", "insider", "compliance", "legal"]),
    ], ["official_docs", "sec_edgar", "data_gov"]),
    ("fusion", r"(rrf|reciprocal rank fusion|rank fusion|cross[- ]?encoder|rerank|reranker|hybrid retrieval|rag implementation|rag benchmarks?)", [
        ("Reciprocal Rank Fusion RRF hybrid retrieval BM25 dense sparse benchmark", ACADEMIC, "primary_evidence", 6),
        ("cross-encoder reranking learned reranker retrieval augmented generation benchmark", ACADEMIC, "primary_evidence", 6),
        ("open source RAG implementation RRF cross encoder reranking benchmark GitHub", ["github", "semantic_scholar", "arxiv"], "corroborating", 6),
    ], [
        ("RRF or rank-fusion evidence", ["rrf", "reciprocal rank fusion", "rank fusion", "hybrid retrieval"]),
        ("learned cross-encoder reranking", ["cross-encoder", "cross encoder", "rerank", "reranker"]),
        ("speed/quality trade-off", ["latency", "compute", "cost", "speed", "precision", "quality", "trade-off", "tradeoff"]),
        ("open-source benchmark evidence", ["open-source", "open source", "github", "benchmark", "trec", "beir", "rag implementation"]),
    ], []),
    ("retrieval", r"(dedup|duplicates?|submodular|bayesian|source reliability|truth discovery|jensen|kl divergence|token budget|learned similarity)", [
        ("domain specific duplicate detection entity resolution claim overlap learned similarity", ACADEMIC, "primary_evidence", 6),
        ("sentence transformers all-MiniLM-L6-v2 semantic similarity clustering model card", ["official_docs", "github"], "primary_evidence", 5),
        ("information theoretic novelty KL divergence Jensen Shannon divergence retrieval summarization", ["arxiv", "semantic_scholar", "crossref"], "corroborating", 6),
        ("submodular optimization budgeted multi document summarization token budget greedy selection", ["arxiv", "semantic_scholar", "crossref"], "primary_evidence", 6),
        ("truth discovery Bayesian source reliability source correlation consensus herding", ["arxiv", "semantic_scholar", "crossref"], "primary_evidence", 6),
        ("RAG context relevance faithfulness retrieval evaluation RAGAS corrective RAG self RAG", ["arxiv", "semantic_scholar", "github"], "corroborating", 6),
    ], [
        ("claim-level duplication", ["claim-level", "claim overlap", "atomic claim"]),
        ("information-theoretic novelty", ["kl", "jensen", "information-theoretic", "divergence"]),
        ("submodular selection", ["submodular", "budgeted", "greedy", "coverage"]),
        ("Bayesian reliability", ["bayesian", "truth discovery", "source reliability", "consensus"]),
    ], []),
    ("oil", r"(oil|crude|wti|brent|opec|petroleum|gasoline)", [
        ("EIA Short-Term Energy Outlook crude oil Brent WTI price forecast supply demand inventory", ["official_docs", "data_gov"], "temporal", 7),
        ("EIA petroleum crude oil prices inventories production consumption forecast", ["official_docs", "data_gov"], "primary_evidence", 7),
        ("crude oil price forecast supply demand OPEC inventory geopolitical risk academic evidence", PAPERS, "corroborating", 5),
    ], [
        ("official forecast", ["eia", "forecast", "outlook", "steo"]),
        ("supply-demand mechanism", ["supply", "demand", "inventory", "production", "consumption"]),
    ], ["official_docs", "data_gov"]),
    ("appsec", r"(appsec|owasp|asvs|nist|cisa|vibecode|security|webhook|sast|dast|sca)", [
        ("OWASP Top 10 broken access control injection security misconfiguration vulnerable dependencies", ["official_docs"], "primary_evidence", 5),
        ("OWASP ASVS verification standard authentication authorization input validation release gate", ["official_docs"], "primary_evidence", 5),
        ("NIST SSDF secure software development framework pre production testing SDLC", ["official_docs"], "primary_evidence", 5),
        ("CISA secure by design software security guidance production readiness", ["official_docs"], "corroborating", 5),
    ], [], ["official_docs"]),
    ("fiscal", r"(debt|deficit|cbo|treasury|inflation|fiscal|ai productivity|data center|electricity)", [
        ("CBO long-term budget outlook deficits debt net interest costs projections", ["official_docs", "data_gov"], "primary_evidence", 6),
        ("Treasury Fiscal Data interest costs debt public data", ["official_docs", "data_gov"], "primary_evidence", 5),
        ("AI data center electricity demand energy infrastructure IEA academic evidence", ["openalex", "crossref", "semantic_scholar"], "corroborating", 5),
    ], [], ["official_docs", "data_gov"]),
]
NEEDS_CODE = r"(repository|github|code sample|implementation|library|sdk|api|package|framework|test file|scanner rule)"

_OFFICIAL = ("{q} official primary source guidance data", ["official_docs", "data_gov"], "primary_evidence", 5)
#: by missing source type, the rows of every round
TYPE_GAPS = {
    "government": [_OFFICIAL],
    "primary-document": [_OFFICIAL],
    "academic": [("{q} academic paper evidence mechanism", PAPERS, "corroborating", 5)],
    "filing": [("{q} SEC filing EDGAR disclosure", ["sec_edgar", "official_docs"], "primary_evidence", 4)],
}
NOTHING = [
    ("{q} official primary source evidence", ["official_docs", "data_gov"], "primary_evidence", 5),
    ("{q} academic evidence mechanism", PAPERS, "corroborating", 5),
]
CONTRARY = [("{q} limitations risks legal boundaries primary source", ["official_docs", "sec_edgar", "data_gov"], "contrarian", 5)]
#: from the second round on broad rows, from the third on exhaustive ones too; without gaps these types stand in
BROAD_TYPES = ["primary-document", "academic", "government"]
EXHAUSTIVE_TYPES = ["academic", "primary-document", "government", "encyclopedic", "forum", "code"]


def by_type(kind: str, broad: bool) -> list[tuple]:
    """Rows that a missing source type adds in later rounds."""
    suffix = "official evidence mechanism source details" if broad else "supporting context source attribution"
    filing = [
        (f"{{q}} SEC filing EDGAR official disclosure {suffix}", ["sec_edgar", "official_docs"], "primary_evidence", 7 if broad else 5),
        (f"{{q}} official primary source documentation {suffix}", ["official_docs", "data_gov", "wikidata"], "primary_evidence", 7 if broad else 5),
    ]
    rows = {
        "academic": [("{q} academic literature evidence mechanism", ["openalex", "crossref", "arxiv", "semantic_scholar"], "corroborating", 8 if broad else 6)],
        "primary-document": filing,
        "filing": filing,
        "government": [(f"{{q}} government official data report {suffix}", ["official_docs", "data_gov", "wikidata"], "primary_evidence", 8 if broad else 5)],
        "encyclopedic": [("{q} background entities definitions context", ["wikipedia", "wikidata"], "definitional", 4)],
        "forum": [("{q} practitioner discussion implementation constraints", ["stack_exchange", "hacker_news"], "contrarian", 4)],
        "code": [("{q} implementation repository documentation", ["github", "stack_exchange"], "corroborating", 5)],
        "medical": [("{q} medical clinical literature", ["pubmed", "openalex"], "corroborating", 5)],
    }
    return rows.get(kind, [])


# What broadens a plan that asks no source of a family.
MARKET = r"(oil|crude|wti|brent|opec|gasoline|energy|petroleum|fuel|commodity|commodities|inflation|rates|fed|treasury|market|prices?)"
SOFTWARE = r"(software|security|appsec|code|api|library|framework|github|vulnerability)"
BROADER = {
    "background": ("{q} background entities official context", ["wikipedia", "wikidata"], "definitional", 3),
    "data": ("{q} official data forecast statistics", ["official_docs", "data_gov"], "temporal", 5),
    "analysis": ("{q} causes forecast analysis evidence", ["openalex", "crossref"], "corroborating", 4),
    "code": ("{q} implementation examples documentation", ["github", "stack_exchange"], "corroborating", 4),
}
