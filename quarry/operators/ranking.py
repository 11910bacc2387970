"""Retrieval, pre-ranking and scoring of chunks for queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.binding import freshness_ranked
from quarry.dims import PHRASE_BOOSTS, PRERANK_STOPWORDS, SCORE_STOPWORDS
from quarry.functions.text import first_sentence, normalized, terms
from quarry.functions.url import prerank_url
from quarry.functions.vector import clamp01

_PRIMARY = ["government", "filing", "structured_fact", "medical"]


def matches_required(stance: Column, kind: Column, source: Column, required: Column, news: str = "never") -> Column:
    """Whether a chunk is of a required source type; ``news`` means one source while pre-ranking, else none."""
    as_news = (source == "hacker_news") if news == "prerank" else F.lit(False)
    return F.when(required == "primary-document", (stance == "primary_source") | kind.isin(*_PRIMARY)).when(required == "news", as_news).otherwise(kind == required)


def any_required(required: str = "required_types", news: str = "never") -> Column:
    return F.exists(required, lambda r: matches_required(F.col("stance"), F.col("source_type"), F.col("source"), r, news))


def with_haystack(rows: DataFrame) -> DataFrame:
    """Adds ``hay``, the lower-cased text that scores look into; a column of its own, so that it is made once a row."""
    return rows.withColumn("hay", F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")), "content")))


def haystack() -> Column:
    return F.col("hay")


def _boilerplate(text: Column, first: int) -> Column:
    return F.substring(text, 1, first).rlike("about the author|editorial board|copyright|privacy policy|terms of use")


def local_score(now: str) -> Column:
    """The pre-ranking score of rows with query, query_types, required_types, hay and a chunk's columns."""
    hay, title, t = haystack(), F.lower(F.coalesce("title", F.lit(""))), terms(F.col("query"), 3, PRERANK_STOPWORDS)
    n = F.size(t)
    hits = F.size(F.filter(t, lambda x: F.contains(hay, x)))
    lexical = F.when(n == 0, 0.0).otherwise(hits / F.greatest(F.lit(4), F.least(F.lit(14), n)))
    title_hits = F.size(F.filter(t, lambda x: F.contains(title, x)))
    pairs = F.zip_with(F.slice(t, 1, F.greatest(n - 1, F.lit(0))), F.slice(t, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    phrase = F.when(n < 2, 0.0).otherwise(F.least(F.lit(0.1), F.size(F.filter(pairs, lambda x: F.contains(hay, x))) * 0.035))
    primary = F.when((F.col("stance") == "primary_source") | F.col("source_type").isin("filing", "government", "structured_fact"), 0.06).otherwise(0.0)
    has = lambda kind: F.array_contains("query_types", kind)
    kind = F.least(
        F.lit(0.12),
        F.when(has("fresh-fact"), F.col("freshness") * 0.04).otherwise(0.0) + F.when(has("source-attribution") & (F.col("stance") == "primary_source"), 0.05).otherwise(0.0)
        + F.when(has("academic") & (F.col("source_type") == "academic"), 0.05).otherwise(0.0) + F.when(has("adversarial") & F.col("source_type").isin("government", "filing", "medical"), 0.04).otherwise(0.0),
    )
    total = lexical * 0.46 + F.col("weight") * 0.24 + freshness_ranked(F.col("publish_date"), now) * 0.1 + F.least(F.lit(0.12), title_hits * 0.03)
    total = total + phrase + primary + kind + F.when(any_required(news="prerank"), 0.1).otherwise(0.0)
    return clamp01(total * F.when(_boilerplate(hay, 500), 0.45).otherwise(1.0))


def duplicate_key() -> Column:
    """Canonical URL, else title and text, else text."""
    url, digest = prerank_url(F.col("url")), F.sha1(F.substring(normalized(F.col("content")), 1, 900))
    title = normalized(F.coalesce("title", F.lit("")))
    return F.when(url != "", F.concat(F.lit("url:"), url)).when(title != "", F.concat_ws(":", F.lit("title"), title, digest)).otherwise(F.concat(F.lit("text:"), digest))


def one_per_duplicate_key(scored: DataFrame) -> DataFrame:
    """The best chunk of every (query, duplicate key), with the size of its group."""
    w = W.partitionBy("query_id", "dup_key")
    ranked = scored.withColumn("dup_key", duplicate_key()).withColumn("rank", F.row_number().over(w.orderBy(F.desc("local_score"), "ord"))).withColumn("group_size", F.count(F.lit(1)).over(w))
    return ranked.filter("rank = 1").drop("rank")


def diverse_top_k(scored: DataFrame, k: int) -> DataFrame:
    """At most k chunks of a query: one of each required type, then by score damped by sources and types already taken.

    The choice is sequential, so it runs in pandas, on the k best chunks of every (source, source type, stance) of a
    query. It sees nothing else of a chunk than these and the score, so of each such group it takes the best ones first,
    and at most k: the cut loses no possible choice.
    """
    w = W.partitionBy("query_id", "source", "source_type", "stance").orderBy(F.desc("local_score"), "ord")
    small = scored.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    small = small.select("query_id", "chunk_id", "ord", "local_score", "source", "source_type", "stance", "required_types")

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["local_score", "ord"], ascending=[False, True]).reset_index(drop=True)
        required = list(rows.required_types[0]) if len(rows) else []
        score, source, source_type, stance = (rows[c].tolist() for c in ("local_score", "source", "source_type", "stance"))

        def fits(i: int, kind: str) -> bool:
            if kind == "primary-document":
                return stance[i] == "primary_source" or source_type[i] in _PRIMARY
            return source[i] == "hacker_news" if kind == "news" else source_type[i] == kind

        taken: list[int] = []
        for kind in required:
            if len(taken) < k and (found := next((i for i in range(len(rows)) if i not in taken and fits(i, kind)), None)) is not None:
                taken.append(found)
        while len(taken) < min(k, len(rows)):
            open_kinds = [r for r in required if not any(fits(i, r) for i in taken)]
            sources, kinds = {source[i] for i in taken}, {source_type[i] for i in taken}
            value = lambda i: score[i] * 0.82 ** (source[i] in sources) * 0.9 ** (source_type[i] in kinds) + 0.08 * any(fits(i, r) for r in open_kinds)  # noqa: B023, E731
            taken.append(max((i for i in range(len(rows)) if i not in taken), key=lambda i: (value(i), -i)))
        out = rows.loc[taken, ["query_id", "chunk_id", "local_score"]].reset_index(drop=True)
        out["position"] = range(len(out))
        return out[["query_id", "chunk_id", "position", "local_score"]]

    return small.groupBy("query_id").applyInPandas(pick, "query_id long, chunk_id string, position int, local_score double")


def phrase_boost(query: Column, text: Column) -> Column:
    parts = [F.when(F.lower(query).rlike(p) & text.rlike(c), b).otherwise(0.0) for p, c, b in PHRASE_BOOSTS]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.least(F.lit(0.35), total)


def fallback_relevance() -> Column:
    hay, t = haystack(), F.array_distinct(terms(F.col("query"), 3, SCORE_STOPWORDS))
    n, boost = F.size(t), phrase_boost(F.col("query"), haystack())
    hits = F.size(F.filter(t, lambda x: F.contains(hay, x)))
    rel = F.when(n == 0, boost).otherwise(F.least(F.lit(1.0), hits / F.greatest(F.lit(4), F.least(F.lit(12), n)) + boost))
    bad = F.substring(hay, 1, 300).rlike("about the author|author biography|editorial board|copyright|terms of use")
    return clamp01(rel * F.when(bad, 0.08).otherwise(1.0))


# Topics of queries, and the signals that titles and texts on them have.
GUARD = {
    "boilerplate": "about the author|author biography|editorial board|copyright|terms of use",
    "oil": "(oil|crude|wti|brent|opec|petroleum)",
    "oil_title": "(oil|crude|wti|brent|opec|petroleum|eia|steo)",
    "oil_signal": "(forecast|outlook|steo|brent|wti|supply|demand|inventor|production|consumption|price)",
    "heating": "home heating oil|kerosene|propane",
    "oil_text": "forecast|outlook|steo|crude|brent|wti",
    "retrieval": "(dedup|duplicates?|submodular|bayesian|source reliability|truth discovery|jensen|kl divergence|token budget|learned similarity|pipeline)",
    "retrieval_signal": "(dedup|duplicate|submodular|bayesian|truth discovery|source reliability|similarity|embedding|jensen|kl|retrieval|claim)",
    "trading": "(institution|bank|trader|news|squawk|co-?location|direct feeds?|market data|edgar|macro releases?)",
    "trading_signal": "(sec|edgar|direct feed|co-location|colocation|market data|squawk|fomc|cpi|filing|exchange|release|surprise|consensus|compliance)",
}


def guarded(relevance: Column) -> Column:
    """Relevance capped where a query's topic and a chunk's signals disagree."""
    lower, title, text = F.lower("query"), F.lower(F.coalesce("title", F.lit(""))), haystack()
    broad = F.col("source_type") == "encyclopedic"
    own, signal = title.rlike(GUARD["oil_title"]), text.rlike(GUARD["oil_signal"])
    heating = title.rlike(GUARD["heating"]) & ~text.rlike(GUARD["oil_text"])
    caps = [
        F.when(title.rlike(GUARD["boilerplate"]), 0.05),
        F.when(lower.rlike(GUARD["oil"]), F.when(heating, 0.18).when(broad & ~own & ~signal, 0.16).when(broad & ~own, 0.24)),
        F.when(lower.rlike(GUARD["retrieval"]) & ~text.rlike(GUARD["retrieval_signal"]), 0.12),
        F.when(lower.rlike(GUARD["trading"]) & ~text.rlike(GUARD["trading_signal"]), 0.16),
    ]
    return F.least(relevance, *(F.coalesce(c, F.lit(1.0)) for c in caps))


def combined() -> Column:
    return F.col("relevance") * F.col("weight") * F.col("confidence") * F.greatest(F.lit(0.4), F.col("freshness"))


def rate(rows: DataFrame) -> DataFrame:
    """Relevance and confidence by rule: what a model would be asked for, and what a cache keeps."""
    return rows.withColumn("relevance", guarded(fallback_relevance())).withColumn("confidence", F.least(F.lit(0.92), F.greatest(F.lit(0.28), F.col("weight"))))


def completed(rated: DataFrame) -> DataFrame:
    """Freshness, surprise, the claim and the combined score of rows with relevance and confidence."""
    s = rated.withColumn("freshness", F.greatest(F.lit(0.2), F.col("freshness")))
    s = s.withColumn("surprise", F.when(F.col("source_type").isin("forum", "tech_discussion"), 0.35).otherwise(0.55)).withColumn("claim", first_sentence(F.col("content")))
    return s.withColumn("combined", combined())


def score(rows: DataFrame) -> DataFrame:
    """Relevance, confidence, freshness, surprise, the claim and the combined score, by rule."""
    return completed(rate(rows))


def keep_or_rescue(scored: DataFrame, threshold: float = 0.2, limit: int = 6) -> DataFrame:
    """Rows above the threshold; where a query has none, its best plausible ones; then the best plausible one of every
    required type still without any. Column ``how``: passed, rescued or covered."""
    s = scored.withColumn("passed", F.col("combined") >= threshold).withColumn("plausible", (F.col("relevance") >= 0.12) & (F.col("combined") >= max(0.025, threshold * 0.2)))
    per_query = W.partitionBy("query_id")
    s = s.withColumn("any_passed", F.max("passed").over(per_query))
    first = F.explode_outer("required_types").alias("needs")
    best = s.filter("plausible AND NOT passed").select("*", first).filter(matches_required(F.col("stance"), F.col("source_type"), F.col("source"), F.col("needs")))
    best = best.withColumn("b", F.row_number().over(W.partitionBy("query_id", "needs").orderBy(F.desc("combined"), "ord"))).filter("b = 1")
    reserved = best.filter("NOT any_passed").select("query_id", "chunk_id").distinct().withColumn("reserved", F.lit(1))
    r = s.filter("plausible AND NOT any_passed").join(reserved, ["query_id", "chunk_id"], "left")
    r = r.withColumn("b", F.row_number().over(per_query.orderBy(F.desc_nulls_last("reserved"), F.desc("combined"), "ord"))).filter(F.col("b") <= limit).drop("b", "reserved")
    kept = s.filter("passed").withColumn("how", F.lit("passed")).unionByName(r.withColumn("how", F.lit("rescued")))
    covered = kept.select("query_id", F.explode("required_types").alias("needs"), "stance", "source_type", "source")
    covered = covered.filter(matches_required(F.col("stance"), F.col("source_type"), F.col("source"), F.col("needs"))).select("query_id", "needs").distinct()
    more = best.filter("any_passed").join(covered, ["query_id", "needs"], "left_anti").drop("needs", "b").dropDuplicates(["query_id", "chunk_id"])
    return kept.unionByName(more.withColumn("how", F.lit("covered"))).drop("passed", "plausible", "any_passed")


def treat_extraction(rows: DataFrame, status: str = "status") -> DataFrame:
    """Confidence ceilings by extraction status; metadata-only and failed rows lose claim, stance and relevance."""
    ceiling = F.when(F.col(status) == "structured_abstract", 0.55).when(F.col(status) == "snippet", 0.35).when(F.col(status) == "metadata_only", 0.15).when(F.col(status) == "failed", 0.08).otherwise(1.0)
    poor = F.col(status).isin("metadata_only", "failed")
    r = rows.withColumn("confidence", F.least("confidence", ceiling)).withColumn("claim", F.when(~poor, F.col("claim"))).withColumn("stance", F.when(poor, "speculation").otherwise(F.col("stance")))
    return r.withColumn("relevance", F.when(poor, F.least("relevance", F.lit(0.12))).otherwise(F.col("relevance")))


