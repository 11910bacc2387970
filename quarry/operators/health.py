"""Evidence health and gaps of a query's selection, and reliability of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import topics
from quarry.dims import GAP_STOPWORDS, TYPE_WEIGHTS, lookup, strings
from quarry.functions.text import terms
from quarry.operators import planner
from quarry.operators.ranking import matches_required


def _clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def _pct(x: Column) -> Column:
    return F.floor(_clip(x * 100, 0, 100) + 0.5)


def health(intents: DataFrame, selected: DataFrame, clusters: DataFrame, failed_important: DataFrame | None = None) -> DataFrame:
    """One row a query: components, quality, coverage and status; without a selection all zeros, insufficient."""
    primary = (F.col("stance") == "primary_source") | F.col("source_type").isin("government", "filing", "structured_fact", "medical")
    s = selected.select("query_id", "source", "source_type", "stance", "relevance", "confidence", "weight", "freshness", F.when(F.col("claim").isNull(), 0).otherwise(1).alias("claims"), F.coalesce("degraded", F.lit(False)).alias("degraded") if "degraded" in selected.columns else F.lit(False).alias("degraded"))
    a = s.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("relevance").alias("rel"), F.avg("confidence").alias("conf"), F.avg("weight").alias("wt"), F.avg("freshness").alias("fresh"),
        F.sum("claims").alias("claims"), F.countDistinct("source_type").alias("types"), F.countDistinct("source").alias("sources"), F.count_if(primary).alias("primary"),
        F.count_if(F.col("relevance") < 0.18).alias("near_zero"), F.count_if("degraded").alias("degraded"),
    )
    needs = intents.select("query_id", F.explode("required_types").alias("needs"))
    met = needs.join(s, "query_id").filter(matches_required(F.col("stance"), F.col("source_type"), F.col("source"), F.col("needs"))).groupBy("query_id").agg(F.countDistinct("needs").alias("matched"))
    rejected = clusters.groupBy("query_id").agg(F.sum(F.col("size") - 1).alias("merged"))
    h = intents.select("query_id", "query_types", "required_types").join(a, "query_id", "left").join(met, "query_id", "left").join(rejected, "query_id", "left")
    h = h.join(failed_important, "query_id", "left") if failed_important is not None else h.withColumn("failed", F.lit(0))
    h = h.fillna(0, ["n", "rel", "conf", "wt", "fresh", "claims", "types", "sources", "primary", "near_zero", "degraded", "matched", "merged", "failed"])
    need_primary = F.arrays_overlap("required_types", F.array(*map(F.lit, ["primary-document", "government", "filing", "medical"]))) | F.arrays_overlap("query_types", F.array(*map(F.lit, ["source-attribution", "adversarial", "fresh-fact"])))
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    nr = F.col("n") / F.greatest(F.lit(1), F.col("n") + F.col("merged"))
    h = h.withColumn("nr", nr).withColumn("relevance_confidence", _pct((F.col("rel") + F.col("conf")) / 2))
    bonus = F.when(~need_primary, 0.08).when(F.col("primary") > 0, 0.1).otherwise(-0.14)
    h = h.withColumn("source_authority", _pct(0.72 * F.col("wt") + 0.18 * one(F.col("primary") > 0) + bonus))
    share = lambda c, k: F.least(F.lit(1.0), F.col(c) / k)
    h = h.withColumn("coverage_diversity", _pct(0.34 * share("claims", 8) + 0.24 * share("types", 3) + 0.16 * share("sources", 3) + 0.16 * F.col("matched") / F.greatest(F.lit(1), F.size("required_types")) + 0.1 * F.col("nr")))
    h = h.withColumn("freshness_fit", _pct(F.greatest(F.lit(0.0), F.col("fresh") - F.least(F.lit(0.35), 0.12 * F.col("failed")))))
    q0 = F.floor(_clip(0.35 * F.col("relevance_confidence") + 0.25 * F.col("source_authority") + 0.25 * F.col("coverage_diversity") + 0.15 * F.col("freshness_fit"), 0, 100) + 0.5)
    c0 = F.floor(_clip(0.65 * F.col("coverage_diversity") + 0.2 * F.col("relevance_confidence") + 15 * F.col("nr"), 0, 100) + 0.5)
    n = F.greatest(F.lit(1), F.col("n"))
    z = F.when(F.col("near_zero") > 0, F.greatest(F.lit(0.45), 1 - F.col("near_zero") / n)).otherwise(1.0)
    e = F.when(F.col("degraded") > 0, F.greatest(F.lit(0.55), 1 - 0.25 * F.col("degraded") / n)).otherwise(1.0)
    cap = F.when(F.col("rel") < 0.25, 34).when(F.col("rel") < 0.35, 58).otherwise(100)
    some = F.col("n") > 0
    final = lambda x: F.when(some, F.least(F.floor(x * z * e + 0.5), cap)).otherwise(0).cast("long")
    h = h.withColumn("quality", final(q0)).withColumn("coverage", final(c0))
    worst = F.least("quality", "coverage")
    status = F.when(~some, "insufficient").when(worst >= 80, "strong").when(worst >= 60, "adequate").when(worst >= 35, "weak").otherwise("insufficient")
    parts = ["relevance_confidence", "source_authority", "coverage_diversity", "freshness_fit"]
    return h.select("query_id", F.col("n").alias("selected"), "matched", *(F.when(some, F.col(p)).otherwise(0).cast("long").alias(p) for p in parts), "quality", "coverage", status.alias("status"), (F.floor(F.col("rel") * 1e6 + 0.5) / 1e6).alias("avg_relevance"), F.col("primary").alias("primary_sources"), F.col("near_zero"))


def reasons(most: int = 4) -> Column:
    """What a health row (quality, coverage, claims, primary_sources, avg_relevance, degraded) is due to, the first four."""
    n = lambda c: F.col(c).cast("string")
    said = [
        F.when(F.col("quality") >= 80, F.lit("Evidence is of high quality.")), F.when(F.col("claims") == 0, F.lit("No claims were selected.")),
        F.when(F.col("primary_sources") > 0, F.concat(n("primary_sources"), F.lit(" selected from primary sources."))).otherwise(F.lit("No primary source was selected.")),
        F.when(F.col("avg_relevance") < 0.35, F.lit("Mean relevance is low.")), F.when(F.col("degraded") > 0, F.concat(n("degraded"), F.lit(" selected from degraded texts."))), F.when(F.col("coverage") < 35, F.lit("Coverage is low.")),
    ]
    return F.slice(F.filter(F.array(*said), lambda r: r.isNotNull()), 1, most)


def _keyword_only(query: Column, title: Column, content: Column, relevance: Column) -> Column:
    """Whether a chunk only shares words with the query: hardly relevant, about its author, or with one query term at most."""
    asked = F.array_except(terms(query, 2), strings(GAP_STOPWORDS))
    hits = F.size(F.array_intersect(asked, terms(F.concat_ws(" ", F.coalesce(title, F.lit("")), content), 2)))
    author = F.lower(F.coalesce(title, F.lit(""))).rlike("about the author|author biography|editorial board|copyright|terms of use")
    return (relevance < 0.18) | ((F.size(asked) >= 4) & (author | ((hits <= 1) & (relevance < 0.35))))


def unavailable(results: DataFrame) -> DataFrame:
    """(query_id, source) of sources that were asked, never answered, and only failed in ways that a retry cannot mend.

    ``results``: (query_id, source, ok, category, code), one row a request.
    """
    code = F.upper(F.coalesce("code", F.lit("")))
    final = F.col("category").isin("missing_config", "rate_limited", "query_invalid", "unavailable") | code.contains("MISSING") | code.contains("DISABLED") | code.isin("HTTP_403", "HTTP_429", "HTTP_422")
    r = results.groupBy("query_id", "source").agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(~F.col("ok") & ~F.coalesce(final, F.lit(False))).alias("other"))
    return r.filter("ok = 0 AND failed > 0 AND other = 0").select("query_id", "source")


def classify_gaps(query: Column, types: Column, required: Column, missing: Column, healthy: Column, matched: Column, sources: Column, primary: Column) -> tuple[Column, Column]:
    """The missing source types that evidence can't do without, and those that it can."""
    lower, has = F.lower(query), lambda a, x: F.array_contains(a, x)
    appsec = lower.rlike(next(p for n, p, *_ in topics.GAPS if n == "appsec")) & healthy & (has(matched, "academic") | (sources >= 2)) & (has(matched, "primary-document") | (primary > 0))
    code_needed = has(required, "code") & lower.rlike(topics.NEEDS_CODE)
    academic = has(types, "academic") | has(types, "source-attribution")

    def soft(g: Column) -> Column:
        return (
            F.when((g == "code") & appsec, True).when((g == "encyclopedic") & (healthy | appsec), True).when((g == "forum") & healthy, True).when((g == "code") & ~code_needed & healthy, True).when(g == "news", True)
            .when(g.isin("primary-document", "government", "filing", "medical"), False).when((g == "academic") & academic, False).otherwise(healthy)
        )

    return F.filter(missing, lambda g: ~soft(g)), F.filter(missing, soft)


def gaps(intents: DataFrame, selected: DataFrame, healthy: DataFrame, results: DataFrame | None = None, round_: int = 0, rounds: int = 2) -> DataFrame:
    """One row a query: what its evidence lacks, whether another round is to mend it, and the sub-queries of that round.

    ``results``: (query_id, source, ok) of the requests made. Lists of chunk ids are in ascending order.
    """
    q = intents.select("query_id", "query", "query_types", "required_types") if "query" in intents.columns else intents.select("query_id", F.lit("").alias("query"), "query_types", "required_types")
    met = selected.select("query_id", "stance", "source_type", "source", "title", "content", "relevance", "chunk_id").join(q, "query_id")
    per_query = met.groupBy("query_id").agg(
        F.array_distinct(F.flatten(F.collect_list(F.filter("required_types", lambda r: matches_required(F.col("stance"), F.col("source_type"), F.col("source"), r))))).alias("matched"),
        F.countDistinct("source").alias("sources"), F.avg("relevance").alias("average"), F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("relevance") < 0.18, F.col("chunk_id")))).alias("low_ids"),
        F.array_sort(F.collect_list(F.when(_keyword_only(F.col("query"), F.col("title"), F.col("content"), F.col("relevance")), F.col("chunk_id")))).alias("keyword_only_ids"),
        F.lower(F.array_join(F.collect_list(F.concat_ws(" ", F.coalesce("title", F.lit("")), "content")), " ")).alias("said"),
    )
    none = F.array().cast("array<string>")
    g = q.join(healthy.select("query_id", "status", "primary_sources"), "query_id").join(per_query, "query_id", "left").fillna(0, ["sources", "average", "n"]).fillna("", ["said"])
    for c in ("matched", "low_ids", "keyword_only_ids"):
        g = g.withColumn(c, F.coalesce(c, none))
    failed = F.lit(None).cast("array<string>")
    if results is not None:
        lost = results.groupBy("query_id", "source").agg(F.count_if("ok").alias("ok"), F.count(F.lit(1)).alias("asked")).filter("ok = 0 AND asked > 0")
        g = g.join(lost.groupBy("query_id").agg(F.array_sort(F.collect_list("source")).alias("lost")), "query_id", "left")
        failed = F.array_intersect(planner.important_sources(F.col("query"), F.col("required_types")), F.coalesce("lost", none))
    ok = F.col("status").isin("adequate", "strong")
    g = g.withColumn("missing", F.array_except("required_types", "matched")).withColumn("failed_sources", F.coalesce(failed, none))
    hard, soft = classify_gaps(F.col("query"), F.col("query_types"), F.col("required_types"), F.col("missing"), ok, F.col("matched"), F.col("sources"), F.col("primary_sources"))
    g = g.withColumn("hard_gaps", hard).withColumn("soft_gaps", soft).withColumn("missing_facets", planner.missing_facets(F.col("query"), F.col("said"))).withColumn("selected", F.col("n"))
    weak = F.col("status").isin("weak", "insufficient")
    some = lambda c: F.size(c) > 0
    critical = (F.col("n") == 0) | weak | some("low_ids") | some("keyword_only_ids") | some("hard_gaps") | some("missing_facets") | some("failed_sources") | (F.col("average") < 0.25)
    g = planner.repair_plan(g.withColumn("critical", critical))
    retry = F.col("critical") & (some("plan") if round_ < rounds else F.lit(False))
    joined = lambda c: F.array_join(c, ", ")
    reasons = [
        F.when(F.col("n") == 0, F.lit("No selected evidence is left after retrieval, scoring, deduplication and assembly.")), F.when(weak, F.concat(F.lit("Evidence is "), "status", F.lit("."))),
        F.when(some("hard_gaps"), F.concat(F.lit("Source types that are needed are missing: "), joined("hard_gaps"), F.lit("."))), F.when(some("soft_gaps"), F.concat(F.lit("Source types that are missing but not needed: "), joined("soft_gaps"), F.lit("."))),
        F.when((F.col("average") > 0) & (F.col("average") < 0.35), F.concat(F.lit("Mean relevance is low ("), F.format_number("average", 2), F.lit(")."))), F.when(some("missing_facets"), F.concat(F.lit("Missing facets: "), joined("missing_facets"), F.lit("."))),
        F.when(some("failed_sources"), F.concat(F.lit("Sources that matter failed: "), joined("failed_sources"), F.lit("."))), F.when(some("low_ids"), F.concat(F.lit("Chunks hardly relevant: "), joined("low_ids"), F.lit("."))),
        F.when(some("keyword_only_ids"), F.concat(F.lit("Chunks that only share words: "), joined("keyword_only_ids"), F.lit("."))),
    ]
    return g.select(
        "query_id", "query", "query_types", "required_types", "missing", "hard_gaps", "soft_gaps", "missing_facets", "low_ids", "keyword_only_ids", "failed_sources", "critical", "plan",
        F.when(retry, "retry_retrieval").when(F.col("critical"), "synthesize_cautiously").otherwise("no_retry").alias("action"),
        F.when(retry, "retryable_critical_gaps").when(F.col("critical"), "critical_gaps_not_retryable").when(ok & some("soft_gaps"), "adequate_with_soft_gaps").otherwise("no_retryable_gaps").alias("stop_reason"),
        F.filter(F.array(*reasons), lambda r: r.isNotNull()).alias("reasons"),
    )


DELTAS = {"confirmed": (1.0, 0.0), "contradicted": (0.0, 1.0), "repeated": (0.2, 0.1), "observed": (0.05, 0.05)}


def reliability(observations: DataFrame) -> DataFrame:
    """(source, domain, alpha, beta, score, observations) from (source, domain, source_type, kind, ord).

    The prior is the type weight of a source's first observation; increments commute, so they are summed.
    """
    up = F.when(F.col("kind") == "confirmed", 1.0).when(F.col("kind") == "repeated", 0.2).when(F.col("kind") == "observed", 0.05).otherwise(0.0)
    down = F.when(F.col("kind") == "contradicted", 1.0).when(F.col("kind") == "repeated", 0.1).when(F.col("kind") == "observed", 0.05).otherwise(0.0)
    g = observations.groupBy("source", "domain").agg(F.min_by("source_type", "ord").alias("source_type"), F.sum(up).alias("up"), F.sum(down).alias("down"), F.count(F.lit(1)).alias("observations"))
    p = _clip(lookup(TYPE_WEIGHTS, F.col("source_type"), 0.35), 0.05, 0.95)
    g = g.withColumn("alpha", 6 * p + F.col("up")).withColumn("beta", 6 * (1 - p) + F.col("down"))
    return g.select("source", "domain", "alpha", "beta", (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("score"), "observations")


def adjust_weights(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """Chunk weights averaged with their source's reliability in the query's domain, the prior where none is known."""
    known = store.select("source", "domain", "score")
    prior = _clip(lookup(TYPE_WEIGHTS, F.col("source_type"), 0.35), 0.05, 0.95)
    return chunks.join(known, ["source", "domain"], "left").withColumn("weight", _clip((F.col("weight") + F.coalesce("score", prior)) / 2, 0.05, 1)).drop("score")


