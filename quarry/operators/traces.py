"""Events, errors, traces and records of runs, as rows."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ERROR = "struct<stage:string,code:string,message:string,retryable:boolean,details:map<string,string>>"


def stage_error(stage: Column, code: Column, message: Column, retryable: Column | None = None, details: Column | None = None) -> Column:
    """A failure of a stage as a struct."""
    return F.struct(stage.alias("stage"), code.alias("code"), message.alias("message"), (retryable if retryable is not None else F.lit(None)).cast("boolean").alias("retryable"), (details if details is not None else F.lit(None)).cast("map<string,string>").alias("details")).cast(ERROR)


def stage_events(stages: DataFrame) -> DataFrame:
    """Start, progress and completion events of (run_id, stage, started, ms, counts: map), in order of time."""
    at = lambda kind, ts, message: F.struct(F.lit(kind).alias("type"), ts.alias("at"), message.alias("message"))
    ended = F.timestamp_micros(F.unix_micros("started") + F.col("ms") * 1000)
    counts = F.concat_ws(", ", F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    three = F.array(at("stage_start", F.col("started"), F.concat(F.lit("begun: "), "stage")), at("counts", ended, counts), at("stage_complete", ended, F.concat(F.lit("done: "), "stage")))
    return stages.select("run_id", "stage", F.posexplode(three).alias("n", "e")).select("run_id", "stage", "n", "e.*")


def cautious(gaps: DataFrame, stopped: Column, reason: str) -> DataFrame:
    """Gaps whose rounds were stopped marked for a cautious answer, with the reason added."""
    return gaps.withColumn("action", F.when(stopped, "synthesize_cautiously").otherwise(F.col("action"))).withColumn("reasons", F.when(stopped, F.array_append("reasons", F.lit(reason))).otherwise(F.col("reasons")))


def enough(mode: Column, status: Column, quality: Column, soft_only: Column) -> Column:
    """Whether a balanced run stops although gaps are left: its evidence is strong, or adequate with nothing hard missing."""
    return (mode == "balanced") & ((status == "strong") | ((status == "adequate") & (quality >= 60) & soft_only))


class Trace:
    """Stages of a run on the driver, as rows: when they began, how long they took, and what was observed of their results."""

    def __init__(self, spark: SparkSession, run_id: str) -> None:
        self.spark, self.run_id, self.rows = spark, run_id, []

    @contextmanager
    def stage(self, name: str) -> Iterator[dict]:
        """Times what is inside; counts that are put into the dict are told with it. A stage that fails is told of too."""
        began, counts = time.time(), {}
        try:
            yield counts
        finally:
            self.rows.append((self.run_id, name, began, int((time.time() - began) * 1000), counts))

    def written(self, name: str, rows: DataFrame, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``write(rows)`` as a stage: its rows, and the sum of ``tokens`` if there are, are observed by the job that writes them."""
        seen = Observation()
        sums = [F.sum("tokens").alias("tokens")] if "tokens" in rows.columns else []
        with self.stage(name) as counts:
            done = write(rows.observe(seen, F.count(F.lit(1)).alias("rows"), *sums))
            counts |= {k: int(v or 0) for k, v in seen.get.items()}
        return done

    def stages(self) -> DataFrame:
        """(run_id, stage, started, ms, counts), what ``stage_events`` takes."""
        rows = self.spark.createDataFrame(self.rows, "run_id string, stage string, began double, ms long, counts map<string,long>")
        return rows.select("run_id", "stage", F.timestamp_seconds("began").alias("started"), "ms", "counts")

    def frame(self) -> DataFrame:
        return self.stages().select("run_id", "stage", F.col("started").alias("began"), "ms")


class DeadlineReached(Exception):
    """The time of a piece of work is over; what it had running was cancelled."""


class Deadline:
    """Bounds the Spark jobs that are begun inside, on this thread, by time.

    A thread watches the clock beside the running jobs, which carry a tag; when the time is over it cancels them, and
    whatever is begun after that, until the block is left, which then raises ``DeadlineReached``. ``check`` raises it
    between jobs. Jobs of other threads and outside the block go on.
    """

    def __init__(self, spark: SparkSession, seconds: float | None, tag: str | None = None) -> None:
        self.context, self.seconds, self.tag = spark.sparkContext, seconds, tag or f"deadline-{uuid.uuid4().hex}"
        self.over, self.left = threading.Event(), threading.Event()

    def _watch(self) -> None:
        if not self.left.wait(self.seconds):
            self.over.set()
            while True:
                self.context.cancelJobsWithTag(self.tag)
                if self.left.wait(0.1):
                    return

    def check(self) -> None:
        if self.over.is_set():
            raise DeadlineReached(self.tag)

    def __enter__(self) -> Deadline:
        self.context.addJobTag(self.tag)
        if self.seconds is not None:
            self.watcher = threading.Thread(target=self._watch, daemon=True)
            self.watcher.start()
        return self

    def __exit__(self, kind, error, trace) -> bool:
        self.left.set()
        if self.seconds is not None:
            self.watcher.join()
        self.context.removeJobTag(self.tag)
        if kind is not None and self.over.is_set() and not issubclass(kind, DeadlineReached):
            raise DeadlineReached(self.tag) from error
        return False


def cancel(spark: SparkSession, run_id: str) -> list[str]:
    """Interrupts what a run has going; its jobs carry ``run_id`` as a tag (``spark.addTag``)."""
    return spark.interruptTag(run_id)


def citations(chunks: DataFrame) -> DataFrame:
    """Chunks as the citations that an answer shows."""
    return chunks.select("query_id", F.col("chunk_id").alias("id"), "title", "url", "source", "source_type")


def evidence_shape(chunks: DataFrame) -> DataFrame:
    """One row a query: its selected chunks as an array of structs, best first."""
    one = F.struct((-F.col("relevance")).alias("o"), F.col("chunk_id").alias("id"), "source", "url", "claim", "stance", F.round("relevance", 6).alias("relevance"))
    return chunks.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["id"].alias("id"), x["source"].alias("source"), x["url"].alias("url"), x["claim"].alias("claim"), x["stance"].alias("stance"), x["relevance"].alias("relevance"))).alias("evidence"))


def trace_shape(rounds: DataFrame) -> DataFrame:
    """One row a query: how many rounds it took, and its first and last status."""
    return rounds.groupBy("query_id").agg((F.max("round") + 1).alias("rounds"), F.min_by("status", "round").alias("first_status"), F.max_by("status", "round").alias("last_status"), F.max_by("quality", "round").alias("quality"))


def comparison_rows(payloads: DataFrame) -> DataFrame:
    """Results of comparisons from JSON texts (file, value) of any customary shape: an array, or an object with ``results``,
    ``items``, ``comparison``, ``result`` or ``pipeline``, or one result."""
    v = F.col("value")
    inner = F.coalesce(*(F.get_json_object(v, f"$.{k}") for k in ("results", "items", "comparison", "result", "pipeline")), v)
    many = F.when(F.trim(inner).rlike(r"^\["), inner).otherwise(F.concat(F.lit("["), inner, F.lit("]")))
    kind = "array<struct<engine:string,engine_name:string,question_id:string,questionId:string,answer:string,final_answer:string,score_status:string>>"
    r = payloads.select("file", F.posexplode_outer(F.from_json(many, kind)).alias("n", "r"))
    return r.select("file", "n", F.coalesce("r.engine", "r.engine_name").alias("engine"), F.coalesce("r.question_id", "r.questionId").alias("question_id"), F.coalesce("r.answer", "r.final_answer").alias("answer"), F.coalesce("r.score_status", F.lit("scoring_unavailable")).alias("score_status"))


def history(runs: DataFrame, feedback: DataFrame, most: int = 240) -> DataFrame:
    """Run records (run_id, query, answer, finished) as entries of a history: no texts beyond a preview, with the newest vote."""
    last = feedback.groupBy("run_id").agg(F.max_by("vote", "updated_at").alias("vote"))
    preview = F.when(F.length("answer") > most, F.concat(F.rtrim(F.substring("answer", 1, most)), F.lit("..."))).otherwise(F.col("answer"))
    return runs.select("run_id", "query", preview.alias("preview"), "finished").join(last, "run_id", "left")


def merged_entries(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Entries of two histories as one: of an entry that both have, each field as the new one has it, else as the old one."""
    o = old.select(*(F.col(c).alias(f"{c}_old" if c != key else c) for c in old.columns))
    j = o.join(new, key, "full")
    return j.select(key, *(F.coalesce(F.col(c), F.col(f"{c}_old")).alias(c) for c in new.columns if c != key))


def source_results(requests: DataFrame) -> DataFrame:
    """(source, queried, ok, failed, timing, errors) of requests (source, ok, timing_ms, code); each error code once."""
    return requests.groupBy("source").agg(F.count(F.lit(1)).alias("queried"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.sum("timing_ms").alias("timing"), F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("code")))).alias("errors"))
