"""The event feed: the same functions serve batch tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_stream(spark: SparkSession, folder: str, late: str = "10 minutes") -> DataFrame:
    """events.parquet of a folder as a stream with event time, each event once within the watermark."""
    raw = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events.parquet").parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def hourly(events: DataFrame) -> DataFrame:
    """Tumbling windows of one hour by type."""
    g = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def sliding(events: DataFrame) -> DataFrame:
    g = events.groupBy(F.window("ts", "1 hour", "15 minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes 1 microsecond") -> DataFrame:
    """A user's sessions: events no further apart than 30 minutes."""
    g = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("started"))
    return g.select("user_id", "started", "n")


def stall_gaps(events: DataFrame, seconds: float) -> DataFrame:
    """Seconds to a user's next event, and whether they reach the stall limit."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = events.select("event_id", "user_id", "ts", us.alias("us")).withColumn("gap", (F.lead("us").over(w) - F.col("us")) / 1e6)
    return e.select("event_id", "user_id", F.round("gap", 3).alias("gap"), (F.col("gap") >= seconds).alias("stalled"))


def reliability_stream(events: DataFrame, prior: float = 0.55) -> DataFrame:
    """Running reliability by user as state: alpha and beta move with every observation."""
    import pandas as pd

    output = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("alpha", T.DoubleType()), T.StructField("beta", T.DoubleType()), T.StructField("score", T.DoubleType())])
    kept = "alpha double, beta double"

    def update(key, batches, state):
        alpha, beta = state.get if state.exists else (6 * prior, 6 * (1 - prior))
        for b in batches:
            n = b.event_type.value_counts()
            up, down = n.get("click", 0) + 0.2 * n.get("view", 0), n.get("error", 0) + 0.1 * n.get("view", 0)
            rest = len(b) - n.get("click", 0) - n.get("view", 0) - n.get("error", 0)
            alpha, beta = alpha + up + 0.05 * rest, beta + down + 0.05 * rest
        state.update((float(alpha), float(beta)))
        yield pd.DataFrame({"user_id": [key[0]], "alpha": [alpha], "beta": [beta], "score": [alpha / (alpha + beta)]})

    return events.select("user_id", "event_type").groupBy("user_id").applyInPandasWithState(update, output, kept, "update", "NoTimeout")


def run_once(df: DataFrame, mode: str, folder: str) -> DataFrame:
    """Everything that is available now, written by batch under a shared folder and read back, with the number of the batch.

    Of a complete result only the last batch stays; a batch that is tried again overwrites itself.
    """
    rows = f"{folder}/rows"

    def keep(batch: DataFrame, n: int) -> None:
        path = rows if mode == "complete" else f"{rows}/batch={n}"
        (batch.withColumn("batch", F.lit(n).cast("long")) if mode == "complete" else batch).write.mode("overwrite").parquet(path)

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    schema = T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])
    return df.sparkSession.read.schema(schema).parquet(rows)


def heartbeats(events: DataFrame, seconds: int) -> DataFrame:
    """A progress row for every full interval in which a user's run is silent: (user_id, event_id, beat, at)."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = events.select("event_id", "user_id", us.alias("us"), ((F.lead(us).over(w) - us) / F.lit(seconds * 1_000_000)).alias("silent"))
    beats = e.filter("silent > 1").select("user_id", "event_id", "us", F.explode(F.sequence(F.lit(1), (F.ceil("silent") - 1).cast("int"))).alias("beat"))
    return beats.select("user_id", "event_id", "beat", F.timestamp_micros(F.col("us") + F.col("beat") * F.lit(seconds * 1_000_000)).alias("at"))


def frames(events: DataFrame, kind: str = "event_type", order: str = "event_id") -> DataFrame:
    """Rows as frames of a server-sent event stream: ``event:``, ``data:`` as JSON on one line, a blank line."""
    body = F.to_json(F.struct(*(F.col(c) for c in events.columns if c != kind)))
    return events.select(F.col(order), F.concat(F.lit("event: "), F.col(kind), F.lit("\ndata: "), body, F.lit("\n\n")).alias("frame"))
