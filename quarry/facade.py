"""The engine as seven callables that return DataFrames, and plugin registration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import dims
from quarry.plans.evidence import EngineConf, Evidence, answers, rounds, run

#: Fixed value: what a source id looks like.
SOURCE_ID = r"^[a-z][a-z0-9_:-]{1,63}$"


def validate_requests(requests: DataFrame) -> DataFrame:
    """Requests with defaults, and ``problem`` where one is not valid (null otherwise)."""
    r = requests.withColumn("quality_mode", F.coalesce("quality_mode", F.lit("balanced"))).withColumn("token_budget", F.coalesce("token_budget", F.lit(4000)))
    problem = F.when(F.coalesce(F.trim("query"), F.lit("")) == "", "query is empty").when(~F.col("quality_mode").isin("fast", "balanced", "quality"), "unknown quality mode").when(F.col("token_budget") <= 0, "token budget must be positive")
    return r.withColumn("problem", problem)


def plugin_diagnostics(manifests: DataFrame, handlers: DataFrame) -> DataFrame:
    """(id, level, code) for every fault of source plugins: bad or reserved id, repeated id, handler missing."""
    m = manifests.select("id", "label")
    fault = lambda df, level, code: df.select("id", F.lit(level).alias("level"), F.lit(code).alias("code"))
    return (
        fault(m.filter(~F.col("id").rlike(SOURCE_ID)), "error", "INVALID_ID").unionByName(fault(m.filter(F.col("id").isin(*dims.SOURCES)), "error", "RESERVED_ID"))
        .unionByName(fault(m.groupBy("id").count().filter("count > 1"), "error", "DUPLICATE_ID")).unionByName(fault(m.join(handlers.select("id"), "id", "left_anti").distinct(), "error", "HANDLER_MISSING"))
        .unionByName(fault(m.filter(F.coalesce(F.trim("label"), F.lit("")) == ""), "warning", "LABEL_MISSING"))
    )


def coerce_json(text: Column, schema: str) -> Column:
    """A struct from model output: inside code fences if there are any, else from the first brace to the last."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(text)
    return F.from_json(F.regexp_extract(body, r"(?s)(\{.*\})", 1), schema)


class Tools:
    """``search``, ``evidence``, ``trace``, ``sources``, ``source_health``, ``cost`` and ``plugin_doctor``."""

    def __init__(self, asked: DataFrame, items: DataFrame, conf: EngineConf = EngineConf()) -> None:
        self.asked, self.items, self.conf = asked, items, conf
        self.plan = Evidence(asked, items, conf)

    def search(self) -> DataFrame:
        return answers(self.plan)

    def evidence(self) -> DataFrame:
        return self.plan.selected.select("query_id", "chunk_id", "source", "source_type", "url", "content", "claim", "stance", "relevance", "confidence", "gain")

    def trace(self) -> DataFrame:
        return rounds(run(self.asked, self.items, self.conf))

    def sources(self) -> DataFrame:
        return dims.registry(self.plan.asked.sparkSession)

    def source_health(self, results: DataFrame) -> DataFrame:
        """(source, queried, ok, failed, timing) of fetch results (source, ok, timing_ms)."""
        return results.groupBy("source").agg(F.count(F.lit(1)).alias("queried"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.sum("timing_ms").alias("timing"))

    def cost(self, items: DataFrame) -> DataFrame:
        """Calls, tokens and cost in all, by stage and by model."""
        return items.groupingSets([[], ["stage"], ["model"]], "stage", "model").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 9).alias("cost"))

    def plugin_doctor(self, manifests: DataFrame, handlers: DataFrame) -> DataFrame:
        return plugin_diagnostics(manifests, handlers)
