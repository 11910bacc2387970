"""Plans of sub-queries by topic, and the repair plans that gaps of evidence call for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import topics
from quarry.dims import SOURCES, strings
from quarry.functions.control import let
from quarry.operators.intent import fallback_sources

ROW = "struct<sub_query:string,target_sources:array<string>,retrieval_intent:string,max_results:int>"
_NO_ROWS = f"array<{ROW}>"


def rows(templates: list[tuple], query: Column) -> Column:
    """Template rows as an array of structs, the query put in."""
    if not templates:
        return F.array().cast(_NO_ROWS)
    said = [F.struct(F.replace(F.lit(t), F.lit("{q}"), query).alias("sub_query"), strings(s).alias("target_sources"), F.lit(i).alias("retrieval_intent"), F.lit(n).alias("max_results")) for t, s, i, n in templates]
    return F.array(*said).cast(_NO_ROWS)


def _present(array: Column) -> Column:
    return F.filter(array, lambda r: r.isNotNull())


def general(query: Column, types: Column, sources: Column) -> Column:
    """The plan of queries without a topic: the query, and variants for fresh facts and for claims to be contested."""
    row = lambda text, targets, intent, n: F.struct(text.alias("sub_query"), targets.alias("target_sources"), intent.alias("retrieval_intent"), n.alias("max_results")).cast(ROW)
    main = row(query, sources, F.when(F.array_contains(types, "source-attribution"), "primary_evidence").otherwise("corroborating"), F.least(F.lit(6), F.greatest(F.lit(3), F.size(sources))))
    fresh = row(F.concat(query, F.lit(" latest official data projections")), F.slice(F.filter(sources, lambda s: s.isin("data_gov", "sec_edgar", "openalex", "crossref")), 1, 4), F.lit("temporal"), F.lit(5))
    contrary = row(F.concat(query, F.lit(" primary source evidence risks limitations")), F.slice(F.filter(sources, lambda s: s != "hacker_news"), 1, 5), F.lit("contrarian"), F.lit(4))
    every = F.array(main, F.when(F.array_contains(types, "fresh-fact"), fresh), F.when(F.array_contains(types, "adversarial"), contrary))
    return F.slice(F.filter(every, lambda r: r.isNotNull() & (F.size(r["target_sources"]) > 0)), 1, 6)


def first_plan(intents: DataFrame) -> DataFrame:
    """Adds ``plan``: the rows of the first topic that fits, else the general plan; sources no longer than the schema allows."""
    q, lower = F.col("query"), F.lower("query")
    asked = F.struct(F.col("query_types").alias("types"), F.col("required_types").alias("required"))
    plan = let(asked, lambda x: let(fallback_sources(q, x["required"]), lambda sources: general(q, x["types"], sources)))
    for _, pattern, templates in reversed(topics.PLANS):
        plan = F.when(lower.rlike(pattern), rows(templates, q)).otherwise(plan)
    return intents.withColumn("plan", plan)


def broadened(planned: DataFrame, most: int = 7) -> DataFrame:
    """``plan`` with rows for source families that it does not ask."""
    lower, q = F.lower("query"), F.col("query")
    short = F.size(F.split(F.regexp_replace("query", r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", ""), r"[ \t\n\r\f\x0B]+")) <= 10
    known = F.struct(F.col("plan").alias("plan"), short.alias("short"), lower.rlike(topics.MARKET).alias("market"), F.array_contains("query_types", "fresh-fact").alias("fresh"), F.array_contains("required_types", "academic").alias("academic"))

    def more(x: Column) -> Column:
        wide = x["short"] | x["market"]
        when = {"background": wide, "data": x["fresh"] | x["market"], "analysis": wide | x["academic"], "code": lower.rlike(topics.SOFTWARE)}
        asked = F.flatten(F.transform(x["plan"], lambda r: r["target_sources"]))
        lacks = lambda name: ~F.arrays_overlap(asked, strings(topics.BROADER[name][1][:1] if name == "code" else topics.BROADER[name][1]))
        extra = F.array(*(F.when(c & lacks(name), rows([topics.BROADER[name]], q)[0]) for name, c in when.items()))
        return F.slice(F.concat(x["plan"], _present(extra)), 1, most)

    return planned.withColumn("plan", let(known, more))


def preferred(planned: DataFrame, wanted: list[str], most: int = 7) -> DataFrame:
    """``plan`` restricted to preferred sources; if no row asks one, a row that asks them for the query itself."""
    wanted = [s for s in wanted if s in SOURCES]
    if not wanted:
        return planned
    kept = F.transform("plan", lambda r: r.withField("target_sources", F.filter(r["target_sources"], lambda s: s.isin(*wanted))))
    kept = F.filter(kept, lambda r: F.size(r["target_sources"]) > 0)
    only = rows([("{q}", wanted[:6], "primary_evidence", min(10, max(3, len(wanted))))], F.col("query"))
    return planned.withColumn("plan", let(kept, lambda k: F.when(F.size(k) > 0, F.slice(k, 1, most)).otherwise(only)))


def coerced(planned: DataFrame, coerce) -> DataFrame:
    """A plan from elsewhere made fit: free source names by ``coerce``, distinct and at most 6, rows without any left out,
    unknown retrieval intents as corroborating, result limits within 1..10."""
    known = strings(["primary_evidence", "corroborating", "contrarian", "definitional", "temporal"])

    def fit(r: Column) -> Column:
        sources = F.slice(F.array_distinct(F.flatten(F.transform(r["target_sources"], coerce))), 1, 6)
        intent = F.when(F.array_contains(known, r["retrieval_intent"]), r["retrieval_intent"]).otherwise("corroborating")
        return F.struct(r["sub_query"].alias("sub_query"), sources.alias("target_sources"), intent.alias("retrieval_intent"), F.greatest(F.lit(1), F.least(F.lit(10), r["max_results"])).alias("max_results")).cast(ROW)

    return planned.withColumn("plan", F.filter(F.transform("plan", fit), lambda r: F.size(r["target_sources"]) > 0))


def sub_queries(planned: DataFrame) -> DataFrame:
    """(query_id, ix, sub_query, target_sources, retrieval_intent, max_results), one row a sub-query."""
    return planned.select("query_id", F.posexplode("plan").alias("ix", "s")).select("query_id", "ix", "s.*")


def gap_topic(query: Column) -> Column:
    c = F.lit(None).cast("string")
    for name, pattern, *_ in reversed(topics.GAPS):
        c = F.when(F.lower(query).rlike(pattern), F.lit(name)).otherwise(c)
    return c


def missing_facets(query: Column, text: Column) -> Column:
    """Names of the topic's facets none of whose terms occurs in the (lower-cased) text."""
    out = F.array().cast("array<string>")
    for _, pattern, _, facets, _ in reversed(topics.GAPS):
        lacking = [F.when(~F.greatest(*(F.contains(text, F.lit(t)) for t in terms)) if len(terms) > 1 else ~F.contains(text, F.lit(terms[0])), F.lit(name)) for name, terms in facets]
        own = F.filter(F.array(*lacking), lambda x: x.isNotNull()) if lacking else F.array().cast("array<string>")
        out = F.when(F.lower(query).rlike(pattern), own).otherwise(out)
    return out


def important_sources(query: Column, required: Column) -> Column:
    """Sources whose failure may leave a query unanswered."""
    lower, none = F.lower(query), F.array().cast("array<string>")
    parts = [F.when(lower.rlike(p), strings(s)).otherwise(none) for _, p, _, _, s in topics.GAPS if s]
    parts += [F.when(F.array_contains(required, "filing"), strings(["sec_edgar"])).otherwise(none), F.when(F.array_contains(required, "government"), strings(["data_gov", "official_docs"])).otherwise(none)]
    return F.array_distinct(F.concat(*parts))


def _first_wins(array: Column, key) -> Column:
    """Structs of an array whose key no earlier one has."""
    marked = F.transform(array, lambda r, i: F.struct(r.alias("r"), i.alias("i"), key(r).alias("k")))

    def first(marked: Column) -> Column:
        keys = F.transform(marked, lambda m: m["k"])
        return F.transform(F.filter(marked, lambda m: F.array_position(keys, m["k"]) == m["i"] + 1), lambda m: m["r"])

    return let(marked, first)


def repair_plan(gapped: DataFrame, most: int = 7) -> DataFrame:
    """Adds ``plan``: what to ask for gaps, from query, query_types, missing_facets, hard_gaps (source types) and selected."""
    q, lower, none = F.col("query"), F.lower("query"), F.array().cast(_NO_ROWS)
    by_topic = none
    for _, pattern, templates, _, _ in reversed(topics.GAPS):
        by_topic = F.when(lower.rlike(pattern), rows(templates, q)).otherwise(by_topic)
    by_gap = F.flatten(F.transform("hard_gaps", lambda g: _by_kind(g, q, topics.TYPE_GAPS)))
    lacking = (F.size("missing_facets") > 0) | (F.col("selected") < 3)
    found = let(F.concat(by_topic, by_gap), lambda f: F.when((F.size(f) == 0) & lacking, rows(topics.NOTHING, q)).otherwise(f))
    found = F.concat(found, F.when(F.array_contains("query_types", "adversarial"), rows(topics.CONTRARY, q)).otherwise(none))
    key = lambda r: F.concat(F.lower(r["sub_query"]), F.lit("::"), F.array_join(r["target_sources"], ","))
    return gapped.withColumn("plan", F.slice(_first_wins(found, key), 1, most))


def _by_kind(kind: Column, query: Column, table: dict[str, list]) -> Column:
    out = F.array().cast(_NO_ROWS)
    for name, templates in table.items():
        out = F.when(kind == name, rows(templates, query)).otherwise(out)
    return out


def broadened_repair(repair: DataFrame, round_: int) -> DataFrame:
    """``plan`` with broad rows from round 2 and exhaustive ones from round 3 on, for ``gaps`` (source types) or all."""
    q, parts = F.col("query"), [F.col("plan")]
    for least, kinds, broad in ((2, topics.BROAD_TYPES, True), (3, topics.EXHAUSTIVE_TYPES, False)):
        if round_ >= least:
            table = {k: topics.by_type(k, broad) for k in ("academic", "primary-document", "filing", "government", "encyclopedic", "forum", "code", "medical")}
            gaps = F.when(F.size("gaps") > 0, F.col("gaps")).otherwise(strings(kinds))  # at most a handful
            parts.append(F.flatten(F.transform(gaps, lambda g: _by_kind(g, q, table))))  # noqa: B023  (called at once)
    key = lambda r: F.concat(F.lower(r["sub_query"]), F.lit("|"), F.array_join(F.array_sort(r["target_sources"]), ","))
    return repair.withColumn("plan", _first_wins(F.concat(*parts), key))


def without(planned: DataFrame, unavailable: Column) -> DataFrame:
    """``plan`` without unavailable sources (an array), and without rows that have no other."""
    kept = F.transform("plan", lambda r: r.withField("target_sources", F.array_except(r["target_sources"], unavailable)))
    return planned.withColumn("plan", F.filter(kept, lambda r: F.size(r["target_sources"]) > 0))
