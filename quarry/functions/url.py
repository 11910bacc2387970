"""URL functions as Column expressions over parts of a parsed URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.dims import TRACKING, strings

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, group: int) -> Column:
    """1 scheme, 2 host, 3 path, 4 query; empty where absent or not a URL."""
    return F.regexp_extract(url, _URL, group)


def prerank_url(url: Column) -> Column:
    """Host without ``www.`` and path without trailing slashes, in lower case; empty if not a URL."""
    return F.lower(F.concat(F.regexp_replace(part(url, 2), r"^www\.", ""), F.regexp_replace(part(url, 3), "/+$", "")))


def normalized_url(url: Column, source: Column) -> Column:
    """Without fragment and tracking parameters; for three official sources without any query."""
    kept = F.filter(F.split(part(url, 4), "&"), lambda p: (p != "") & ~F.array_contains(strings(TRACKING), F.lower(F.substring_index(p, "=", 1))))
    drop = source.isin("official_docs", "sec_edgar", "data_gov") | (F.size(kept) == 0)
    path = F.when(part(url, 3) == "", F.lit("/")).otherwise(part(url, 3))
    base = F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)), path)
    arxiv = arxiv_id(url)
    clean = F.when(drop, base).otherwise(F.concat(base, F.lit("?"), F.array_join(kept, "&")))
    return F.when(part(url, 2) == "", url).when(F.lower(part(url, 2)).eqNullSafe("arxiv.org") & (arxiv != ""), F.concat(F.lit("https://arxiv.org/abs/"), arxiv)).otherwise(clean)


def arxiv_id(url: Column) -> Column:
    return F.regexp_extract(url, r"(?i)arxiv\.org/(?:abs|pdf)/([0-9]{4}\.[0-9]{4,5}(?:v\d+)?)(?:\.pdf)?", 1)


def github_repo(url: Column) -> Column:
    on_github = part(url, 2).rlike(r"(?i)(^|\.)github\.com$")
    parts = F.filter(F.split(part(url, 3), "/"), lambda p: p != "")
    return F.when(on_github & (F.size(parts) >= 2), F.concat(F.get(parts, F.lit(0)), F.lit("/"), F.regexp_replace(F.get(parts, F.lit(1)), r"(?i)\.git$", ""))).otherwise("")


def evidence_key(url: Column, source: Column, kind: Column, title: Column, doi: Column) -> Column:
    """DOI, else arXiv id, else repository, else title (academic), else normalised URL."""
    d = F.lower(F.regexp_replace(F.trim(doi), r"(?i)^https?://(dx\.)?doi\.org/", ""))
    arxiv, repo = F.lower(arxiv_id(url)), F.lower(github_repo(url))
    stable = F.trim(F.regexp_replace(F.lower(title), r"[ \t\n\r\f\x0B]+", " "))
    return (
        F.when(F.coalesce(F.trim(doi), F.lit("")) != "", F.concat(F.lit("doi:"), d))
        .when(arxiv != "", F.concat(F.lit("arxiv:"), arxiv))
        .when(repo != "", F.concat(F.lit("github:"), repo))
        .when((kind == "academic") & (F.coalesce(title, F.lit("")) != ""), F.concat(F.lit("title:"), stable))
        .otherwise(normalized_url(url, source))
    )


def document_type(url: Column, source: Column, kind: Column) -> Column:
    return (
        F.when(url.rlike(r"(?i)\.pdf($|[?#])"), "pdf")
        .when((source == "github") | (kind == "code"), "repository")
        .when((source == "sec_edgar") | (kind == "filing"), "filing")
        .when((source == "data_gov") | (kind == "government"), "dataset")
        .when((kind == "academic") | source.isin("arxiv", "semantic_scholar", "openalex", "crossref", "core"), "paper")
        .when(url.startswith("http"), "html")
        .otherwise("unknown")
    )


def document_key(source: Column, url: Column, title: Column, author: Column, published: Column) -> Column:
    """Source, host and path, title, author and day, empty parts left out."""
    parts = [source, F.concat(F.lower(part(url, 2)), F.regexp_replace(part(url, 3), "/+$", "")), F.lower(F.trim(title)), F.lower(F.trim(author)), F.date_format(published, "yyyy-MM-dd")]
    return F.concat_ws("::", *(F.when(p != "", p) for p in parts))
