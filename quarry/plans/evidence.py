"""The evidence plan: from queries and a corpus to scored, deduplicated and selected chunks with diagnostics.

Every stage is a DataFrame keyed by query, so all queries run in one job. ``Evidence`` builds the stages lazily and
keeps each for the next; ``rounds`` asks repair plans for queries whose evidence has gaps, over the union of what all
rounds have found. Only items that some sub-query retrieved are chunked, and their texts are joined by id.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.binding import chunks, queries, raw_items
from quarry.dims import MODE_POLICY, NOW, registry, strings
from quarry.functions.vector import hash_embedding
from quarry.operators import assembly, dedup, extraction, health, intent, planner, ranking, retrieval, stores
from quarry.operators.traces import Deadline, DeadlineReached, Trace, cautious
from quarry.shared import arrow_batches, checkpointed, collected, drop


@dataclass(frozen=True)
class EngineConf:
    """Policy of a run; ``mode`` sets the number of repair rounds and of chunks that pre-ranking keeps."""

    now: str = NOW
    mode: str = "balanced"
    token_budget: int = 4000
    threshold: float = 0.2
    tau: float = 0.85
    preferred: tuple[str, ...] = ()
    #: seconds that all repair rounds may take; and what a cache of scores keeps, and scores at a time
    repair_seconds: float | None = None
    cache_size: int = 2000
    batch: int = 8

    @property
    def max_rounds(self) -> int:
        return next(r for m, _, _, r, _ in MODE_POLICY if m == self.mode)

    @property
    def prerank_cap(self) -> int:
        return next(c for m, *_, c in MODE_POLICY if m == self.mode)


class Evidence:
    """One round. ``plan``: (query_id, plan), if it is not the first one; ``before``: scored chunks of earlier rounds;
    ``store``: (source, domain, score), reliability known from earlier runs; ``pages``: (url, html), where the texts of
    retrieved items are looked up; ``cache``: a ``stores.Table`` of ``stores.CACHE``, scores known from earlier runs; ``trace``: where stages are told of."""

    def __init__(self, asked: DataFrame, items: DataFrame, conf: EngineConf = EngineConf(), plan: DataFrame | None = None, before: DataFrame | None = None, round_: int = 0, store: DataFrame | None = None, pages: DataFrame | None = None, cache: stores.Table | None = None, trace: Trace | None = None) -> None:
        self.asked, self.items, self.conf, self.own_plan, self.before, self.round, self.store, self.pages, self.cache = asked, items, conf, plan, before, round_, store, pages, cache
        self.trace = trace

    def _kept(self, stage: str, rows: DataFrame) -> DataFrame:
        """``rows`` as a table; with a trace, under the stage's name with its time, rows and tokens as they are written."""
        return checkpointed(rows) if self.trace is None else self.trace.written(f"{stage}:{self.round}", rows, checkpointed)

    @cached_property
    def intents(self) -> DataFrame:
        return self._kept("intents", intent.with_intent(self.asked))

    @cached_property
    def planned(self) -> DataFrame:
        if self.own_plan is not None:
            return self.intents.join(self.own_plan, "query_id")
        return self._kept("planned", planner.preferred(planner.broadened(planner.first_plan(self.intents)), list(self.conf.preferred)))

    @cached_property
    def hits(self) -> DataFrame:
        """Items that the plan's sub-queries retrieve."""
        tasks = intent.tasks(planner.sub_queries(self.planned), registry(self.asked.sparkSession)).filter("error IS NULL")
        with arrow_batches(self.asked.sparkSession, retrieval.BATCH):
            return self._kept("hits", retrieval.search(tasks, self.items))

    @cached_property
    def documents(self) -> DataFrame:
        """What is known of the texts of retrieved items, by query."""
        wanted = self.items.join(self.hits.select(F.col("query_id").alias("group_id"), F.col("item_id").alias("id")).distinct(), "id")
        return self._kept("documents", extraction.documents(wanted, self.pages))

    @cached_property
    def chunks(self) -> DataFrame:
        if self.pages is not None:
            docs = self.documents.select(F.col("group_id").alias("query_id"), F.col("item_id").alias("id"), "ord", "source", "source_type", F.col("canonical_url").alias("url"), "title", "author", "publish_date", "text", "status")
            return self._kept("chunks", chunks(docs, self.conf.now, carry=("query_id", "status")).withColumn("summary", F.lit(None).cast("string")))
        found = self.items.join(self.hits.select(F.col("item_id").alias("id")).distinct(), "id", "left_semi")
        return self._kept("chunks", chunks(found, self.conf.now).withColumn("summary", F.lit(None).cast("string")))

    @cached_property
    def fetched(self) -> DataFrame:
        """Chunks of retrieved items with their query's columns, without those that an earlier round had."""
        found = self.chunks if self.pages is not None else self.chunks.join(self.hits.select("query_id", "item_id").distinct(), "item_id")
        if self.before is not None:
            found = found.join(self.before.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
        wanted = self.intents.select("query_id", "query", "query_types", "required_types", "domain")
        # few bytes, but costly to score: dealt out by number, as small partitions would be put together
        parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return ranking.with_haystack(self._kept("fetched", found.join(wanted, "query_id").repartition(parts)))

    @cached_property
    def preranked(self) -> DataFrame:
        scored = self.fetched.withColumn("surprise", F.lit(0.0)).withColumn("local_score", ranking.local_score(self.conf.now))
        unique = self._kept("grouped", ranking.one_per_duplicate_key(scored))
        kept = ranking.diverse_top_k(unique, self.conf.prerank_cap).select("query_id", "chunk_id", "position")
        return self._kept("preranked", unique.drop("surprise").join(kept, ["query_id", "chunk_id"]))

    @cached_property
    def rated(self) -> DataFrame:
        """Pre-ranked chunks with relevance and confidence; what the cache has is not scored again, and what it has not it learns."""
        if self.cache is None:
            return self._kept("rated", ranking.score(self.preranked))
        rows = self.preranked if "status" in self.preranked.columns else self.preranked.withColumn("status", F.lit(None).cast("string"))
        keyed = rows.withColumn("key", stores.score_key(F.sha2("query", 256)))
        scored = self._kept("rated", stores.cached_scores(keyed, self.cache.read(), ranking.rate, self.conf.batch))
        self.cache.update(lambda held: stores.cache_used(held, scored, self.conf.cache_size))
        self.cache_use = self._kept("cache", scored.groupBy("query_id").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.max("turn").alias("batches")))
        return ranking.completed(scored.drop("key", "hit", "turn", *(set(rows.columns) - set(self.preranked.columns))))

    @cached_property
    def scored(self) -> DataFrame:
        rated = self.rated
        if self.pages is not None:
            rated = ranking.treat_extraction(rated).withColumn("combined", ranking.combined()).withColumn("degraded", extraction.is_degraded(F.col("status")))
        return self._kept("scored", ranking.keep_or_rescue(rated, self.conf.threshold))

    @cached_property
    def weighted(self) -> DataFrame:
        """Scored chunks of all rounds, with their sources' reliability: as stored, else from what was observed."""
        seen = self.scored.select("source", "domain", "source_type", F.lit("observed").alias("kind"), "ord")
        own = health.adjust_weights(self.scored, health.reliability(seen) if self.store is None else self.store)
        own = own.withColumn("embedding", hash_embedding()(F.col("content")))
        return self._kept("weighted", own if self.before is None else own.unionByName(self.before))

    @cached_property
    def links(self) -> DataFrame:
        return self._kept("links", dedup.edges_by_query(self.weighted, "embedding", self.conf.tau))

    @cached_property
    def clusters(self) -> DataFrame:
        labels = dedup.components_by_query(self.weighted, self.links)
        return self._kept("clusters", dedup.representatives(self.weighted, labels, self.links))

    @cached_property
    def unique(self) -> DataFrame:
        return self.weighted.join(self.clusters.select("query_id", F.col("representative").alias("chunk_id"), "novelty"), ["query_id", "chunk_id"])

    @cached_property
    def selection(self) -> DataFrame:
        return self._kept("selection", assembly.assemble(self.unique, self.conf.token_budget))

    @cached_property
    def selected(self) -> DataFrame:
        return self.unique.join(self.selection.filter("decision = 'selected'").select("query_id", "chunk_id", "gain"), ["query_id", "chunk_id"])

    @cached_property
    def results(self) -> DataFrame:
        """(query_id, source, ok) of what the plan asked; a source without a connector fails."""
        tasks = intent.tasks(planner.sub_queries(self.planned), registry(self.asked.sparkSession))
        return tasks.select("query_id", "source", F.col("error").isNull().alias("ok"))

    @cached_property
    def health(self) -> DataFrame:
        return self._kept("health", health.health(self.intents, self.selected, self.clusters))

    @cached_property
    def gaps(self) -> DataFrame:
        return self._kept("gaps", health.gaps(self.intents, self.selected, self.health, self.results, self.round, self.conf.max_rounds))

    def finish(self) -> Evidence:
        """Computes the round and drops the tables of its stages but for those that results and later rounds read."""
        self.planned  # noqa: B018
        with collected() as stages:
            self.scored  # noqa: B018
        self.weighted  # noqa: B018
        with collected() as links:
            self.links  # noqa: B018
        self.clusters, self.selection, self.health, self.gaps  # noqa: B018
        drop(self.asked.sparkSession, stages + links)
        for name in ("hits", "documents", "chunks", "fetched", "preranked", "rated", "scored", "links"):
            self.__dict__.pop(name, None)  # made again if asked for
        return self

    def next_plan(self) -> DataFrame:
        """(query_id, plan) of the round after this one, for the queries that are to be retried."""
        todo = self.gaps.filter("action = 'retry_retrieval'").withColumn("gaps", F.when(F.size("hard_gaps") > 0, F.col("hard_gaps")).otherwise(F.col("required_types")))
        lost = self.results.groupBy("query_id", "source").agg(F.max("ok").alias("ok")).filter("NOT ok").groupBy("query_id").agg(F.collect_list("source").alias("lost"))
        todo = planner.broadened_repair(todo, self.round + 1).join(lost, "query_id", "left")
        return planner.without(todo, F.coalesce("lost", strings([]))).filter(F.size("plan") > 0).select("query_id", "plan")


def run(
    asked: DataFrame, items: DataFrame, conf: EngineConf = EngineConf(), store: DataFrame | None = None, pages: DataFrame | None = None, cache: stores.Table | None = None, trace: Trace | None = None
) -> list[Evidence]:
    """The rounds: each asks the repair plan of the queries that are to be retried, and ends with none or the mode's last.

    With ``conf.repair_seconds`` the rounds after the first end when that time is over: what runs then is cancelled and
    what it has written is dropped, the rounds before stay, and queries that were to be retried are answered cautiously.
    """
    spark, began = asked.sparkSession, None
    steps = [Evidence(asked, items, conf, store=store, pages=pages, cache=cache, trace=trace).finish()]
    while steps[-1].round < conf.max_rounds:
        last, began = steps[-1], began or time.monotonic()
        left = None if conf.repair_seconds is None else max(0.0, conf.repair_seconds - (time.monotonic() - began))
        with collected() as made:
            try:
                with Deadline(spark, left) as limit:
                    limit.check()
                    plan = checkpointed(last.next_plan())
                    if plan.isEmpty():
                        break
                    todo = checkpointed(asked.join(plan.select("query_id"), "query_id", "left_semi"))
                    before = last.weighted.join(plan.select("query_id"), "query_id", "left_semi")
                    steps.append(Evidence(todo, items, conf, plan, before, last.round + 1, store, pages, cache, trace).finish())
            except DeadlineReached:
                drop(spark, made)
                why = f"Repair loop stopped after reaching the {conf.repair_seconds:g} s repair time budget."
                stopped = last.gaps.withColumn("stopped", F.col("action") == "retry_retrieval")
                last.gaps = checkpointed(cautious(stopped, F.col("stopped"), why).drop("stopped"))
                break
    return steps


def final(steps: list[Evidence], name: str) -> DataFrame:
    """A result (``selected``, ``health``, ``gaps``, ``clusters``) of every query in its last round."""
    out = getattr(steps[-1], name)
    for earlier, later in zip(steps[-2::-1], steps[:0:-1], strict=True):
        out = out.unionByName(getattr(earlier, name).join(later.asked.select("query_id"), "query_id", "left_anti"))
    return out


def rounds(steps: list[Evidence]) -> DataFrame:
    """Gaps and health of every round: (round, query_id, status, quality, ...)."""
    done = None
    for step in steps:
        found = step.gaps.select("query_id", "action", "stop_reason", F.size("hard_gaps").alias("hard_gaps"), F.size("missing_facets").alias("missing_facets"), F.size("plan").alias("repairs"))
        found = found.join(step.health.select("query_id", "selected", "status", "quality", "coverage"), "query_id").withColumn("round", F.lit(step.round))
        done = found if done is None else done.unionByName(found)
    return done


def answers(evidence: Evidence, per_query: int = 4) -> DataFrame:
    """Cited answers composed from each query's best selected chunks, and a cautious note where evidence is weak."""
    worth = F.col("relevance") * F.col("confidence")
    top = evidence.selected.select("query_id", F.struct((-worth).alias("w"), "chunk_id", "claim").alias("x"))
    best = top.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list("x")), 1, per_query).alias("best"))
    said = F.array_join(F.transform("best", lambda b: F.concat(b["claim"], F.lit(" ["), b["chunk_id"], F.lit("]"))), " ")
    a = evidence.health.select("query_id", "status", "quality").join(best, "query_id", "left")
    cautious = F.when(F.col("status").isin("weak", "insufficient"), F.concat(F.lit("Evidence is "), "status", F.lit("; treat this answer with caution. "))).otherwise("")
    return a.select("query_id", "status", "quality", F.concat(cautious, F.coalesce(said, F.lit("No evidence was selected."))).alias("answer"), F.coalesce(F.transform("best", lambda b: b["chunk_id"]), F.array().cast("array<string>")).alias("citations"))


def of(spark: SparkSession, sf_dir: str, conf: EngineConf = EngineConf()) -> Evidence:
    """The plan over the test tables."""
    return Evidence(queries(spark, sf_dir), raw_items(spark, sf_dir), conf)
