"""Costs of model calls: line items, prices of a catalog for those that no provider told, and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded(x: Column) -> Column:
    return F.round(x, 12)


def usage(raw: Column) -> Column:
    """(prompt, completion, total) tokens of a provider's JSON, by any of the customary names; never negative, 0 if absent."""
    number = lambda *paths: F.greatest(F.lit(0), F.floor(F.coalesce(*(F.expr(f"try_cast(get_json_object(raw, '{p}') AS DOUBLE)") for p in paths), F.lit(0.0))).cast("long"))
    prompt, completion = number("$.prompt_tokens", "$.input_tokens", "$.promptTokenCount"), number("$.completion_tokens", "$.output_tokens", "$.candidatesTokenCount")
    told = number("$.total_tokens", "$.totalTokenCount")
    return F.struct(prompt.alias("prompt"), completion.alias("completion"), F.when(told > 0, told).otherwise(prompt + completion).alias("total"))


def line_items(calls: DataFrame) -> DataFrame:
    """Calls (call_id, stage, provider, model, raw: usage as JSON, told_cost) as line items; a mock provider costs nothing."""
    c = calls.withColumn("u", usage(F.col("raw")))
    source = F.when(F.col("provider") == "mock", "mock_zero").when(F.col("told_cost").isNotNull(), "provider_usage").otherwise("unavailable")
    cost = F.when(F.col("provider") == "mock", F.lit(0.0)).otherwise(F.col("told_cost"))
    return c.select("call_id", F.coalesce("stage", F.lit("default")).alias("stage"), "provider", "model", F.col("u.prompt").alias("prompt_tokens"), F.col("u.completion").alias("completion_tokens"), F.col("u.total").alias("total_tokens"), cost.alias("cost"), source.alias("pricing_source"), F.lit(False).alias("estimated"))


def resolved(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Line items whose cost no provider told priced by the catalog (model, prompt_price, completion_price), as estimates.

    A model is looked up by its name, then without leading ``~``. The catalog has a row a model; the join picks its own way.
    """
    prices = catalog.select(F.col("model").alias("listed"), "prompt_price", "completion_price")
    bare = catalog.select(F.col("model").alias("bare"), F.col("prompt_price").alias("p2"), F.col("completion_price").alias("c2"))
    j = items.join(prices, F.col("model") == F.col("listed"), "left").join(bare, F.regexp_replace("model", "^~", "") == F.col("bare"), "left")
    prompt, completion = F.coalesce("prompt_price", "p2"), F.coalesce("completion_price", "c2")
    open_ = F.col("cost").isNull() & prompt.isNotNull() & completion.isNotNull()
    cost = rounded(F.col("prompt_tokens") * prompt + F.col("completion_tokens") * completion)
    return j.select(*(F.col(c) for c in items.columns if c not in ("cost", "pricing_source", "estimated")), F.when(open_, cost).otherwise(F.col("cost")).alias("cost"), F.when(open_, "catalog_estimate").otherwise(F.col("pricing_source")).alias("pricing_source"), (F.col("estimated") | open_).alias("estimated"))


def summary(items: DataFrame) -> DataFrame:
    """In all, by stage, by provider and by model: calls, tokens, cost, whether any is estimated, and where prices come from."""
    g = items.withColumn("cost", F.coalesce("cost", F.lit(0.0)))
    # rows are added up once; the four groupings are of the few sums
    g = g.groupBy("stage", "provider", "model", "pricing_source").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("cost").alias("cost"), F.max("estimated").alias("estimated")
    )
    sets = [[], ["stage"], ["provider"], ["model"]]
    out = g.groupingSets([[F.col(c) for c in s] for s in sets], "stage", "provider", "model").agg(
        F.grouping_id().alias("level"), F.sum("calls").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), rounded(F.sum("cost")).alias("cost"),
        F.max(F.col("estimated") | (F.col("pricing_source") == "unavailable")).alias("estimated"), F.when(F.countDistinct("pricing_source") == 1, F.min("pricing_source")).otherwise("mixed").alias("pricing_source"),
    )
    kind = F.when(F.col("level") == 7, "all").when(F.col("level") == 3, "stage").when(F.col("level") == 5, "provider").otherwise("model")
    return out.select(kind.alias("kind"), F.coalesce("stage", "provider", "model").alias("name"), "calls", "prompt_tokens", "completion_tokens", "cost", "estimated", "pricing_source")
