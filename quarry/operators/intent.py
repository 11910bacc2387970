"""Intent of a query and its plan of sub-queries, by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.dims import ASKED, DOMAIN_RULES, INTENT_RULES, OIL, SOURCE_ALIASES, SOURCES, TOPIC_SOURCES, TYPE_SOURCES, strings
from quarry.functions.control import let

_NONE = "array<string>"
#: A word boundary over ASCII word characters; the engine's own ``\\b`` also knows other letters.
_EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def _where(pairs: list[tuple[Column, list[str]]]) -> Column:
    """The lists whose condition holds, joined in order, first occurrences only."""
    return F.array_distinct(F.concat(*(F.when(c, strings(v)).otherwise(F.array().cast(_NONE)) for c, v in pairs)))


def _first_wins(c: Column, limit: int) -> Column:
    return F.slice(c, 1, limit)


def query_types(query: Column) -> Column:
    found = _first_wins(_where([(F.lower(query).rlike(p), t) for p, t, _ in INTENT_RULES]), 4)
    return let(found, lambda f: F.when(F.size(f) == 0, strings(["multi-hop"])).otherwise(f))


def required_types(query: Column) -> Column:
    """Source types of the rules (at most 5), then the normaliser's additions (at most 6)."""
    lower = F.lower(query)
    asked = _first_wins(_where([(lower.rlike(p), s) for p, _, s in INTENT_RULES]), 5)
    asked = let(asked, lambda a: F.when(lower.rlike(OIL), F.array_distinct(F.concat(a, strings(["government", "academic", "encyclopedic"])))).otherwise(a))
    fresh = F.array_contains(query_types(query), "fresh-fact")
    return let(asked, lambda a: _first_wins(F.when((F.size(a) == 0) & fresh, strings(["government", "academic"])).otherwise(a), 6))


def without_news(query: Column, required: Column) -> Column:
    """Required types without news that the query does not ask for; official and academic sources stand in."""
    asks = F.lower(query).rlike(r"\b(news|headline|headlines|article|articles|press)\b")
    other = F.array_distinct(F.concat(F.filter(required, lambda r: r != "news"), strings(["government", "academic"])))
    return F.when(F.array_contains(required, "news") & ~asks, other).otherwise(required)


def entities(query: Column) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(query, F.lit(rf"{_EDGE}[A-Z][A-Za-z0-9.-]*(?:\s+[A-Z][A-Za-z0-9.-]*){{0,3}}{_EDGE}"), F.lit(0))), 1, 10)


def temporal(query: Column) -> Column:
    return F.when(F.lower(query).rlike("current|present"), F.lit("current"))


def domain(query: Column) -> Column:
    c = F.lit(None).cast("string")
    for pattern, name in reversed(DOMAIN_RULES):
        c = F.when(F.lower(query).rlike(pattern), F.lit(name)).otherwise(c)
    return F.coalesce(c, F.lit("general"))


def with_intent(queries: DataFrame, query: str = "query") -> DataFrame:
    q = F.col(query)
    return queries.select(
        "*", F.substring(q, 1, 280).alias("core_intent"), query_types(q).alias("query_types"), entities(q).alias("entities"),
        temporal(q).alias("temporal"), required_types(q).alias("required_types"), domain(q).alias("domain"),
    )


def fallback_sources(query: Column, required: Column) -> Column:
    """Target sources of the general plan: by required type, then by topic, in the order in which sources are asked, at most 6."""
    lower = F.lower(query)
    pairs = [(F.array_contains(required, t), s) for t, s in TYPE_SOURCES.items()] + [(lower.rlike(p), s) for p, s in TOPIC_SOURCES]
    found = let(_where(pairs), lambda f: F.when(F.size(f) == 0, strings(["wikipedia", "wikidata", "crossref"])).otherwise(f))
    return let(found, lambda f: F.slice(F.filter(strings(ASKED), lambda s: F.array_contains(f, s)), 1, 6))


def coerce_source(name: Column) -> Column:
    """Sources that a free name stands for: exact, normalised, or by alias; empty if unknown."""
    norm = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_|_$", "")
    out = F.array().cast(_NONE)
    for alias, targets in reversed(SOURCE_ALIASES.items()):
        out = F.when(norm == alias, strings(targets)).otherwise(out)
    return F.when(norm.isin(*SOURCES), F.array(norm)).otherwise(out)


def tasks(plan_: DataFrame, registry: DataFrame) -> DataFrame:
    """One row for each sub-query and source in plan order; a source without a connector is marked."""
    t = plan_.select("query_id", "ix", "sub_query", "retrieval_intent", "max_results", F.posexplode("target_sources").alias("pos", "source"))
    known = F.broadcast(registry.select("source", F.lit(True).alias("known")))  # one row a connector
    return t.join(known, "source", "left").withColumn("error", F.when(F.col("known").isNull(), "SOURCE_HANDLER_MISSING")).drop("known")
