"""Command line: ``python -m quarry.cli search|plugins|compare ...``; also usable with spark-submit."""

from __future__ import annotations

import argparse
import json
import os
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from quarry import dims, facade
from quarry.operators import gold, traces
from quarry.plans.evidence import EngineConf
from quarry.sources.files import read_gold


def conf_from_env(env: dict[str, str] | None = None) -> EngineConf:
    """The engine's policy from ``QUARRY_*`` variables; what is not set or not valid keeps its default."""
    env, conf = os.environ if env is None else env, EngineConf()
    modes = [m for m, *_ in dims.MODE_POLICY]
    if env.get("QUARRY_MODE") in modes:
        conf = replace(conf, mode=env["QUARRY_MODE"])
    if env.get("QUARRY_TOKEN_BUDGET", "").isdigit() and int(env["QUARRY_TOKEN_BUDGET"]) > 0:
        conf = replace(conf, token_budget=int(env["QUARRY_TOKEN_BUDGET"]))
    if env.get("QUARRY_SOURCES"):
        conf = replace(conf, preferred=tuple(s.strip() for s in env["QUARRY_SOURCES"].split(",") if s.strip() in dims.SOURCES))
    return conf


def adapters(tools: facade.Tools) -> dict[str, dict]:
    """The engine's callables as tool descriptions that agent frameworks take: name, description, parameters, function."""
    def one(name: str) -> dict:
        f = getattr(tools, name)
        return {"name": f"quarry_{name}", "description": (f.__doc__ or name).strip().splitlines()[0], "parameters": {"type": "object", "properties": {}}, "function": f}

    return {n: one(n) for n in ("search", "evidence", "trace", "sources")}


def compare(answers: DataFrame, gold_: DataFrame, strict: bool = False) -> DataFrame:
    """Scores of engines, best first."""
    return gold.score(answers, gold_, strict).orderBy("question_id", "engine")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="quarry")
    commands = p.add_subparsers(dest="command", required=True)
    search = commands.add_parser("search", help="answer questions from a table of items")
    search.add_argument("items", help="Parquet of raw items")
    search.add_argument("query", nargs="+")
    search.add_argument("--mode", choices=[m for m, *_ in dims.MODE_POLICY])
    search.add_argument("--trace", action="store_true")
    plugins = commands.add_parser("plugins", help="list or check sources")
    plugins.add_argument("what", choices=["list", "doctor", "validate"])
    plugins.add_argument("--manifests", help="JSON lines with id and label")
    other = commands.add_parser("compare", help="score results of engines")
    other.add_argument("results", help="JSON texts of results")
    other.add_argument("--gold", help="gold artifact")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("quarry").getOrCreate()
    if a.command == "plugins":
        if a.what == "list":
            out = dims.registry(spark)
        else:
            manifests = spark.read.schema("id string, label string").json(a.manifests) if a.manifests else spark.createDataFrame([], "id string, label string")
            out = facade.plugin_diagnostics(manifests, dims.registry(spark).selectExpr("source AS id"))
    elif a.command == "search":
        conf = conf_from_env() if not a.mode else replace(conf_from_env(), mode=a.mode)
        asked = spark.createDataFrame(list(enumerate(a.query)), "query_id long, query string")
        tools = facade.Tools(asked, spark.read.parquet(a.items), conf)
        out = tools.trace() if a.trace else tools.search()
    else:
        texts = spark.read.option("wholetext", True).text(a.results).selectExpr("_metadata.file_name AS file", "value")
        out = traces.comparison_rows(texts)
        if a.gold:
            out = out.join(read_gold(spark, a.gold).selectExpr("id AS question_id", "size(atomic_facts) AS facts"), "question_id", "left")
    for row in out.toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), default=str))
    return 0 if a.command != "plugins" or a.what == "list" else int(out.filter("level = 'error'").count() > 0)


if __name__ == "__main__":
    raise SystemExit(main())
