"""Tables that outlive a run: scores of chunks by content, and what is known of the reliability of sources.

``Table`` keeps versions that several drivers may write: data lie in folders that never change, a version is a small file
that names its folders, and it is put in place by an operation that fails if another writer has been there first.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.dims import TYPE_WEIGHTS, lookup
from quarry.shared import on_disk


def score_key(context: Column) -> Column:
    """What a chunk's score depends on: the context, and the chunk's source, title, address, extraction and text."""
    told = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "source_type", "title", "url", "status", "content")]
    return F.concat(context, F.lit(":"), F.sha2(F.to_json(F.array(*told)), 256))


def split_by_cache(chunks: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks with ``key`` whose scores the cache (key, relevance, confidence, used_at) has, with these, and the others."""
    found = cache.select("key", "relevance", "confidence")
    return chunks.join(found, "key"), chunks.join(found, "key", "left_anti")


def cache_after(cache: DataFrame, hits: DataFrame, scored: DataFrame, most: int = 2000) -> DataFrame:
    """The cache with new scores, hits moved to the end, and only the ``most`` last used (a least-recently-used cache)."""
    last = F.coalesce(F.max("used_at"), F.lit(0))
    start = cache.agg(last.alias("start"))  # one row
    touched = hits.select("key", "relevance", "confidence", F.col("ord").alias("turn")).withColumn("rank", F.lit(0))
    fresh = scored.select("key", "relevance", "confidence", F.col("ord").alias("turn")).withColumn("rank", F.lit(1))
    now = touched.unionByName(fresh).withColumn("n", F.row_number().over(W.orderBy("rank", "turn", "key")))  # what one run scores
    moved = now.join(F.broadcast(start)).select("key", "relevance", "confidence", (F.col("start") + F.col("n")).alias("used_at"))  # by one row
    every = cache.unionByName(moved).groupBy("key").agg(F.max_by("relevance", "used_at").alias("relevance"), F.max_by("confidence", "used_at").alias("confidence"), F.max("used_at").alias("used_at"))
    return every.orderBy(F.desc("used_at"), "key").limit(most)


def cache_row(stage: str, chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Diagnostics by query: hits, misses and the ids that were hit, under the stage's name with ``_cache``."""
    known = chunks.join(cache.select("key", F.lit(True).alias("hit")), "key", "left")
    return known.groupBy("query_id").agg(F.lit(f"{stage}_cache").alias("stage"), F.count_if("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"), F.array_sort(F.collect_list(F.when(F.col("hit"), F.col("chunk_id")))).alias("hit_ids"))


def updated_reliability(store: DataFrame, observed: DataFrame) -> DataFrame:
    """The store (source, domain, alpha, beta, observations) after observations (source, domain, source_type, kind, ord).

    A source that the store does not know starts from six observations' worth of its type's weight. Increments commute.
    """
    up = F.when(F.col("kind") == "confirmed", 1.0).when(F.col("kind") == "repeated", 0.2).when(F.col("kind") == "observed", 0.05).otherwise(0.0)
    down = F.when(F.col("kind") == "contradicted", 1.0).when(F.col("kind") == "repeated", 0.1).when(F.col("kind") == "observed", 0.05).otherwise(0.0)
    o = observed.groupBy("source", "domain").agg(F.min_by("source_type", "ord").alias("kind"), F.sum(up).alias("up"), F.sum(down).alias("down"), F.count(F.lit(1)).alias("n"))
    prior = F.greatest(F.lit(0.05), F.least(F.lit(0.95), lookup(TYPE_WEIGHTS, F.col("kind"), 0.35)))
    j = store.join(o, ["source", "domain"], "full")
    a = F.coalesce("alpha", 6 * prior) + F.coalesce("up", F.lit(0.0))
    b = F.coalesce("beta", 6 * (1 - prior)) + F.coalesce("down", F.lit(0.0))
    return j.select("source", "domain", a.alias("alpha"), b.alias("beta"), (F.coalesce("observations", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("observations"))


def cached_scores(chunks: DataFrame, cache: DataFrame, rate: Callable[[DataFrame], DataFrame], batch: int = 8) -> DataFrame:
    """``chunks`` (query_id, key, ord, ...) with relevance and confidence, hit and turn.

    What the cache has is not scored again; ``rate`` adds relevance and confidence to the others, which are scored in
    batches of ``batch`` a query, in order. ``turn`` is when a score is used: hits at once, then one batch after the other.
    """
    known = chunks.join(cache.select("key", "relevance", "confidence"), "key").withColumn("hit", F.lit(True)).withColumn("turn", F.lit(0).cast("long"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("ord", "key"))
    fresh = rate(chunks.join(cache.select("key"), "key", "left_anti")).withColumn("hit", F.lit(False))
    return known.unionByName(fresh.withColumn("turn", F.floor((place - 1) / F.lit(batch)) + 1))


def cache_used(cache: DataFrame, scored: DataFrame, most: int = 2000) -> DataFrame:
    """The cache (key, relevance, confidence, used_at) after a run: what it used counts as used in the turn of its last use,
    and only the ``most`` last used stay. Turns go on from the last of the run before; of equal keys the first score is kept."""
    start = cache.agg(F.coalesce(F.max("used_at"), F.lit(0)).alias("start"))  # one row
    first = F.struct("turn", "query_id", "ord")
    used = scored.groupBy("key").agg(*(F.min_by(c, first).alias(f"new_{c}") for c in ("relevance", "confidence")), F.max("turn").alias("turn"))
    used = used.join(F.broadcast(start)).withColumn("now", F.col("start") + 1 + F.col("turn"))
    every = cache.join(used, "key", "full").select("key", *(F.coalesce(c, f"new_{c}").alias(c) for c in ("relevance", "confidence")), F.coalesce("now", "used_at").alias("used_at"))
    return every.orderBy(F.desc("used_at"), "key").limit(most)


CACHE = "key string, relevance double, confidence double, used_at long"


class Conflict(Exception):
    """Other writers were faster, as often as was tried."""


@dataclass(frozen=True)
class Version:
    """What a version consists of: data folders, and by feed the last batch that was added."""

    number: int = -1
    folders: tuple[str, ...] = ()
    batches: dict = field(default_factory=dict)


class Table:
    """A versioned table in a shared folder, for any number of readers and writers.

    A reader sees a whole version. A writer writes its data first, then claims the next number; if another has claimed it,
    ``compare_and_set`` says so, and ``update`` and ``append`` try again from what is there now, so no update is lost.
    The last two versions can be read; folders that only earlier ones have are dropped. What a failed writer leaves is no
    part of any version.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    def _fs(self, path: str) -> tuple:
        return on_disk(self.spark, path)

    def numbers(self) -> list[int]:
        """Numbers of the versions there are, ascending."""
        fs, where = self._fs(f"{self.path}/log")
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n) for n in names if n.isdigit())

    def folders(self) -> list[str]:
        """Data folders on disk."""
        fs, where = self._fs(f"{self.path}/data")
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def version(self, number: int | None = None) -> Version:
        """A version, by default the last; before the first, an empty one."""
        have = self.numbers() if number is None else [number]
        if not have:
            return Version()
        fs, where = self._fs(f"{self.path}/log/{have[-1]:020d}")
        stream = fs.open(where)
        try:
            told = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(have[-1], tuple(told["folders"]), told["batches"])

    def read(self, version: Version | None = None) -> DataFrame:
        folders = (version or self.version()).folders
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{x}" for x in folders)) if folders else self.spark.createDataFrame([], self.schema)

    def _stored(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.select(*self.spark.createDataFrame([], self.schema).columns).write.parquet(f"{self.path}/data/{name}")
        return name

    def _claim(self, new: Version) -> bool:
        """Puts the version's file in place unless there is one: by a hard link on a local disk, else by a rename that never overwrites."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        target, temporary = f"{self.path}/log/{new.number:020d}", f"{self.path}/log/.{uuid.uuid4().hex}"
        fs, source = self._fs(temporary)
        out = fs.create(source, False)
        out.write(json.dumps({"folders": new.folders, "batches": new.batches}).encode())
        out.close()
        goal = fs.makeQualified(self._fs(target)[1])
        try:
            if fs.getScheme() == "file":
                plain = lambda p: jvm.java.io.File(fs.makeQualified(p).toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(plain(goal), plain(source))
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(goal.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                context.rename(fs.makeQualified(source), goal, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            fs.delete(source, False)

    def _set(self, folders: tuple[str, ...], batches: dict, expected: Version) -> bool:
        done = self._claim(Version(expected.number + 1, folders, batches))
        if done:
            self._tidy()
        return done

    def _tidy(self, keep: int = 2, logs: int = 1000) -> None:
        """Drops the folders that the version before the last ``keep`` alone has, and files of versions long past.

        A version's file stays for long, so that a slow writer finds its number taken."""
        have = self.numbers()
        paths = [f"{self.path}/log/{n:020d}" for n in have[:-logs]]
        if len(have) > keep:
            used = {x for n in have[-keep:] for x in self.version(n).folders}
            paths += [f"{self.path}/data/{x}" for x in self.version(have[-keep - 1]).folders if x not in used]
        for path in paths:
            fs, where = self._fs(path)
            fs.delete(where, True)

    def compare_and_set(self, rows: DataFrame, expected: Version) -> bool:
        """``rows`` as the version after ``expected``; false, and nothing happens, if there is one already."""
        name = self._stored(rows)
        if self._set((name,), expected.batches, expected):
            return True
        fs, where = self._fs(f"{self.path}/data/{name}")
        fs.delete(where, True)
        return False

    def update(self, change: Callable[[DataFrame], DataFrame], attempts: int = 20) -> int:
        """``change`` of what the table holds as the next version; made again if another writer was faster. Its number."""
        for _ in range(attempts):
            now = self.version()
            try:
                if self.compare_and_set(change(self.read(now)), now):
                    return now.number + 1
            except Exception:
                if self.version().number < now.number + 2:  # else its data may have been dropped while they were read
                    raise
        raise Conflict(f"{attempts} attempts at {self.path}")

    def write(self, rows: DataFrame) -> int:
        """``rows`` as the next version, whatever the last one held."""
        return self.update(lambda _: rows)

    def append(self, rows: DataFrame, feed: str | None = None, batch: int = 0, attempts: int = 100) -> int:
        """Adds ``rows``, which are written once; a batch of a feed that was added before is left out. The version's number."""
        name = None
        for _ in range(attempts):
            now = self.version()
            if feed is not None and now.batches.get(feed, -1) >= batch:
                return now.number
            name = name or self._stored(rows)
            if self._set((*now.folders, name), now.batches | ({feed: batch} if feed is not None else {}), now):
                return now.number + 1
        raise Conflict(f"{attempts} attempts at {self.path}")

    def compact(self, merge: Callable[[DataFrame], DataFrame], least: int = 8) -> bool:
        """Folders that were added merged into one, once there are ``least``; of several writers one does it, appends go on.

        What is added meanwhile stays beside the merged folder."""
        now = self.version()
        if len(now.folders) < least:
            return False
        name = self._stored(merge(self.read(now)))
        while set(now.folders) <= set((last := self.version()).folders):
            if self._set((name, *(x for x in last.folders if x not in now.folders)), last.batches, last):
                return True
        return False


#: What a table of reliability holds: increments of sources, which add up in any order.
INCREMENTS = "source string, domain string, source_type string, ord long, up double, down double, n long"


def increments(observed: DataFrame) -> DataFrame:
    """Observations (source, domain, source_type, kind, ord) added up by source and domain; so are increments."""
    if "kind" in observed.columns:
        up = F.when(F.col("kind") == "confirmed", 1.0).when(F.col("kind") == "repeated", 0.2).when(F.col("kind") == "observed", 0.05).otherwise(0.0)
        down = F.when(F.col("kind") == "contradicted", 1.0).when(F.col("kind") == "repeated", 0.1).when(F.col("kind") == "observed", 0.05).otherwise(0.0)
        observed = observed.select("source", "domain", "source_type", "ord", up.alias("up"), down.alias("down"), F.lit(1).cast("long").alias("n"))
    sums = [F.sum(c).alias(c) for c in ("up", "down", "n")]
    return observed.groupBy("source", "domain").agg(F.min_by("source_type", "ord").alias("source_type"), F.min("ord").alias("ord"), *sums)


def reliability_of(rows: DataFrame) -> DataFrame:
    """(source, domain, alpha, beta, observations, score) from increments, each source starting from its type's weight."""
    prior = F.greatest(F.lit(0.05), F.least(F.lit(0.95), lookup(TYPE_WEIGHTS, F.col("source_type"), 0.35)))
    r = increments(rows).select("source", "domain", (6 * prior + F.col("up")).alias("alpha"), (6 * (1 - prior) + F.col("down")).alias("beta"), F.col("n").alias("observations"))
    return r.withColumn("score", F.col("alpha") / (F.col("alpha") + F.col("beta")))


def feed(observed: DataFrame, table: Table, name: str, checkpoint: str) -> None:
    """A stream of observations into a table of increments: every micro-batch once, also if it is run again."""

    def add(batch: DataFrame, n: int) -> None:
        table.append(increments(batch), name, n)
        table.compact(increments)

    query = observed.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
