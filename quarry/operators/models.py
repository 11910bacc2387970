"""Model calls as columns: which model a stage uses, calls by a pluggable function with checks and repairs, and a model by rule.

A provider is a Python function from a prompt (a dict) to text. Calls run in ``mapInPandas`` on their rows alone; without a
provider every stage keeps its rule.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.dims import lookup, strings

STAGES = ["default", "intent", "strategy", "scoring", "synthesis", "adjudicator"]
MOST_ATTEMPTS, SNIPPET = 4, 900
#: What the model by rule answers.
RULE_SCORES = {"relevance": 0.82, "confidence": 0.78, "freshness": 0.75, "surprise": 0.55}
# Contracts of model output, as Spark schemas.
SCHEMAS = {
    "intent": "core_intent string, query_type array<string>, entities array<string>, temporal_constraints string, required_source_types array<string>",
    "strategy": "sub_queries array<struct<sub_query:string,target_sources:array<string>,retrieval_intent:string,max_results:int>>",
    "scoring": "scores array<struct<id:string,relevance:double,confidence:double,freshness:double,surprise:double,claim:string,stance:string>>",
    "synthesis": "final_answer string, cited_chunk_ids array<string>",
    "adjudicator": "final_answer string, coverage_status string, remaining_gaps array<string>",
}
# What a field of another name stands for.
ALIASES = {"sub_queries": ["subqueries", "queries", "query_strategy"], "final_answer": ["answer", "finalAnswer"], "scores": ["results", "items", "chunks"]}


def stage_models(models: dict[str, str], overrides: dict[str, str] | None = None) -> dict[str, str]:
    """A model for every stage: overrides, then the table, then its default."""
    both = models | (overrides or {})
    return {s: both.get(s, both.get("default", "")) for s in STAGES}


def route(requests: DataFrame, models: dict[str, str], balanced: dict[str, str], best: str | None = None) -> DataFrame:
    """(request_id, stage, model, escalated, from_model, reason) from (request_id, mode, stage, forced, overrides: map)."""
    fast, even = stage_models(models), stage_models(balanced)
    best = best or fast["adjudicator"] or fast["synthesis"] or fast["default"]
    table = F.when(F.col("mode") == "balanced", lookup(even, F.col("stage"))).otherwise(lookup(fast, F.col("stage")))
    base = F.coalesce(F.element_at("overrides", F.col("stage")), F.element_at("overrides", F.lit("default")), table)
    never = F.col("stage").isin("synthesis", "adjudicator")
    reason = F.when(never, None).when((F.col("mode") == "quality") & F.col("stage").isin("strategy", "scoring"), "quality_mode_requested").when(F.col("forced"), "explicit_stage_escalation")
    up = reason.isNotNull() & (base != best)
    return requests.select("request_id", "stage", F.when(reason.isNotNull(), F.lit(best)).otherwise(base).alias("model"), up.alias("escalated"), F.when(up, base).alias("from_model"), reason.alias("reason"))


def rule_scores(chunks: DataFrame) -> DataFrame:
    """Chunks scored by the model by rule: constant scores."""
    return chunks.select("*", *(F.lit(v).alias(k) for k, v in RULE_SCORES.items()))


def parse_output(text: str | None) -> object:
    """The JSON value of a model's text: in code fences, else from the first bracket to the last; None if there is none."""
    body = text or ""
    if "```" in body:
        parts = body.split("```")
        body = parts[1].removeprefix("json") if len(parts) > 2 else body
    spans = [(body.find(a), body.rfind(b)) for a, b in ("{}", "[]")]
    for start, end in sorted((s, e) for s, e in spans if 0 <= s < e):
        try:
            return json.loads(body[start : end + 1])
        except ValueError:
            continue
    return None


def coerced(value: object, fields: list[str]) -> dict | None:
    """An object with the fields: a bare list as the first one, fields under other names, a text as a list of one."""
    if isinstance(value, list):
        return {fields[0]: value}
    if not isinstance(value, dict):
        return None
    out = dict(value)
    for f in fields:
        if f not in out and (other := next((a for a in ALIASES.get(f, ()) if a in out), None)):
            out[f] = out[other]
    return out


def call(prompts: DataFrame, provider: Callable[[dict], str], schema: str, attempts: int = 2) -> DataFrame:
    """(key, attempts, ok, error, output) of prompts (key, task, prompt): an answer is tried again, with what was wrong with it,
    until it has every field, at most ``attempts`` (1 to 4) times; a provider that raises is a failed attempt."""
    fields = [f.strip().split(" ")[0] for f in _top_level(schema)]
    limit = max(1, min(MOST_ATTEMPTS, attempts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, task, prompt in zip(b.key, b.task, b.prompt, strict=True):
                said, error, out, n = "", None, None, 0
                while n < limit and out is None:
                    n += 1
                    asked = {"task": task, "prompt": prompt} if error is None else {"task": task, "prompt": prompt, "error": error, "last": said[:SNIPPET]}
                    try:
                        said = provider(asked) or ""
                        value = coerced(parse_output(said), fields)
                        lacking = [f for f in fields if value is not None and f not in value]
                        error = "no JSON object" if value is None else f"missing: {', '.join(lacking)}" if lacking else None
                        out = json.dumps(value) if error is None else None
                    except Exception as e:  # a provider's failure is a row, never the job's
                        error = type(e).__name__
                rows.append((key, n, out is not None, error, out))
            yield pd.DataFrame(rows, columns=["key", "attempts", "ok", "error", "output"])

    return prompts.select("key", "task", "prompt").mapInPandas(run, "key long, attempts int, ok boolean, error string, output string").withColumn("output", F.from_json("output", schema))


def _top_level(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(schema[start:i])
            start = i + 1
    return [*out, schema[start:]]


def rule_provider(asked: dict) -> str:
    """A provider by rule, for runs without a model."""
    task = asked["task"]
    if task == "scoring":
        return json.dumps({"scores": [{"id": "1", **RULE_SCORES, "claim": asked["prompt"][:200], "stance": "secondary_analysis"}]})
    if task == "synthesis":
        return json.dumps({"final_answer": asked["prompt"][:200], "cited_chunk_ids": []})
    return json.dumps({"core_intent": asked["prompt"][:200], "query_type": ["multi-hop"], "entities": [], "temporal_constraints": None, "required_source_types": []})


def http_provider(endpoint: str, model: str, key_variable: str, timeout: float = 30.0) -> Callable[[dict], str]:
    """A provider that posts prompts to a chat endpoint; the key is read from the environment where the call runs."""
    def ask(asked: dict) -> str:
        import os
        import urllib.request

        turns = [{"role": "user", "content": asked["prompt"]}]
        if "error" in asked:
            turns += [{"role": "assistant", "content": asked["last"]}, {"role": "user", "content": f"That was not of the form asked for ({asked['error']}). Answer again."}]
        body = json.dumps({"model": model, "messages": turns}).encode()
        request = urllib.request.Request(endpoint, body, {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get(key_variable, '')}"})
        with urllib.request.urlopen(request, timeout=timeout) as response:
            return json.load(response)["choices"][0]["message"]["content"]

    return ask


def answers_with_fallback(drafts: DataFrame, provider: Callable[[dict], str] | None) -> DataFrame:
    """(query_id, answer, by) of drafts (query_id, prompt, fallback): the provider's answer, else the rule's."""
    if provider is None:
        return drafts.select("query_id", F.col("fallback").alias("answer"), F.lit("rule").alias("by"))
    said = call(drafts.select(F.col("query_id").alias("key"), F.lit("synthesis").alias("task"), "prompt"), provider, SCHEMAS["synthesis"])
    final = F.when(F.trim("output.final_answer") != "", F.col("output.final_answer"))
    j = drafts.join(said.select(F.col("key").alias("query_id"), final.alias("final")), "query_id", "left")
    return j.select("query_id", F.coalesce("final", "fallback").alias("answer"), F.when(F.col("final").isNull(), "rule").otherwise("model").alias("by"))


def intent_prompt(query: Column, history: Column, now: str) -> Column:
    return F.concat(F.lit(f"Today is {now}.\nState the intent of the question as JSON with the fields of the contract.\nQuestion: "), query, F.when(F.coalesce(history, F.lit("")) != "", F.concat(F.lit("\nEarlier turns:\n"), history)).otherwise(""))


def strategy_prompt(query: Column, types: Column, sources: list[str], most: int) -> Column:
    return F.concat(F.lit(f"Plan at most {most} sub-queries as JSON. Sources: {', '.join(sources)}.\nKinds of question: "), F.array_join(types, ", "), F.lit("\nQuestion: "), query)


def review_prompt(query: Column, draft: Column, reasons: Column) -> Column:
    return F.concat(F.lit("Review the draft against its evidence; answer as JSON.\nQuestion: "), query, F.lit("\nDraft: "), draft, F.lit("\nGaps: "), F.coalesce(F.nullif(F.array_join(reasons, "; "), F.lit("")), F.lit("none")))


def attempts_of(mode: Column, stage: Column) -> Column:
    """Attempts that a mode grants a stage."""
    return F.when((mode == "quality") & stage.isin(*[s for s in STAGES if s != "default"]), 2).otherwise(1)


def known_stage(stage: Column) -> Column:
    return F.when(F.array_contains(strings(STAGES), stage), stage).otherwise("default")
