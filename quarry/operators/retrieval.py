"""Retrieval with upper bounds: the items that share most terms with a sub-query, found without shuffling any terms.

Sub-queries are asked in blocks, in each of which an inverted index (source and term to sub-queries) is broadcast; its
size is bounded by ``_TASKS`` and ``_TERMS``, so more queries mean more blocks, not larger ones. A task scans its items in
stretches and holds the best of each sub-query. A term can add at most one to a score, and nothing where it does not occur,
so the terms of a stretch bound what each sub-query can find there; those whose bound is below the least score that they
already hold are left out of the stretch, and of the others only items that reach that score are looked at. What is
shuffled is ``max_results`` rows a sub-query and task, whatever the items hold: frequent terms cost scans, not rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.dims import SCORE_STOPWORDS
from quarry.functions.text import terms
from quarry.shared import checkpointed

#: Sub-queries and terms of a block; items of a stretch; pairs held until the best are kept.
_TASKS, _TERMS, _STRETCH, _PAIRS = 4096, 1 << 18, 1024, 1 << 17
#: Bytes of a batch of items that a task is handed: what a scan holds does not grow with its partition.
BATCH = 8 << 20


def blocks(tasks: DataFrame, most: int = _TASKS) -> Iterator[list]:
    """Rows (query_id, ix, source, max_results, terms) in blocks; the driver holds one block at a time."""
    q = tasks.select("query_id", "ix", "source", "max_results", F.array_distinct(terms(F.col("sub_query"), 3, SCORE_STOPWORDS)).alias("terms"))
    block, size = [], 0
    for row in q.filter("size(terms) > 0 AND max_results > 0").toLocalIterator():
        if block and (len(block) >= most or size + len(row["terms"]) > _TERMS):
            yield block
            block, size = [], 0
        block.append(row)
        size += len(row["terms"])
    if block:
        yield block


def index(block: list) -> dict[str, tuple[pa.Array, np.ndarray, np.ndarray]]:
    """By source: its terms, and as offsets and numbers the sub-queries that ask for each."""
    asked: dict[str, dict[str, list[int]]] = {}
    for i, row in enumerate(block):
        own = asked.setdefault(row["source"], {})
        for term in row["terms"]:
            own.setdefault(term, []).append(i)
    return {s: (pa.array(list(own), pa.string()), np.cumsum([0, *map(len, own.values())]), np.concatenate([np.array(x) for x in own.values()])) for s, own in asked.items()}


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers ``first[i]`` to ``first[i] + count[i] - 1``, for all i in turn."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


class Best:
    """The best items of each sub-query that a task has seen: by score, then by ``ord``."""

    def __init__(self, most: np.ndarray) -> None:
        self.most, self.bar = most, np.ones(len(most), np.int64)  # the least score that is still of use
        self.rows = np.zeros((4, 0), np.int64)  # sub-query, score, ord, place of the item's id
        self.ids: list = []
        self.looked = self.skipped = 0

    def add(self, task: np.ndarray, score: np.ndarray, order: np.ndarray, ids: list) -> None:
        self.rows = np.concatenate([self.rows, [task, score, order, np.arange(len(ids)) + len(self.ids)]], 1)
        self.ids += ids

    def cut(self) -> None:
        task, score, order, _ = self.rows
        at = np.lexsort((order, -score, task))
        task = task[at]
        first = np.flatnonzero(np.append(True, task[1:] != task[:-1])) if len(task) else np.zeros(0, int)
        turn = np.arange(len(task)) - np.repeat(first, np.diff(np.append(first, len(task))))
        keep = turn < self.most[task]
        full = turn == self.most[task] - 1
        self.rows = self.rows[:, at[keep]]
        self.bar[task[full]] = score[at[full]]
        self.ids = [self.ids[i] for i in self.rows[3]]
        self.rows[3] = np.arange(len(self.ids))

    def scan(self, known: tuple[pa.Array, np.ndarray, np.ndarray], words: pa.Array, order: np.ndarray, ids: pa.Array) -> None:
        """One stretch of items of one source."""
        vocabulary, offsets, askers = known
        item = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
        code = pc.index_in(words.flatten(), value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
        item, code = item[code >= 0], code[code >= 0]
        here = np.unique(code)
        bound = np.bincount(askers[_spread(offsets[here], np.diff(offsets)[here])], minlength=len(self.bar))
        open_ = np.flatnonzero((bound >= self.bar) & (bound > 0))
        self.looked += len(open_)
        self.skipped += int((bound > 0).sum()) - len(open_)
        if not len(open_):
            return
        place = np.full(len(self.bar), -1)
        place[open_] = np.arange(len(open_))
        wanted = place[askers]  # postings of open sub-queries only
        some = np.add.reduceat(wanted >= 0, offsets[:-1])
        starts, wanted = np.cumsum(some) - some, wanted[wanted >= 0]
        each = some[code]
        scores = np.bincount(np.repeat(item, each) * len(open_) + wanted[_spread(starts[code], each)], minlength=len(words) * len(open_)).reshape(len(words), -1)
        i, t = np.nonzero(scores >= self.bar[open_])
        self.add(open_[t], scores[i, t], order[i], ids.take(pa.array(i)).to_pylist())


def _scan(items: DataFrame, block: list, schema: T.StructType) -> DataFrame:
    shared = items.sparkSession.sparkContext.broadcast((index(block), np.array([r["max_results"] for r in block]), [r["query_id"] for r in block], [r["ix"] for r in block], [r["source"] for r in block]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, most, query_ids, ixs, sources = shared.value
        best, kinds = Best(most), None
        for batch in batches:
            kinds = batch.schema.field(1).type
            for source in pc.unique(batch.column(0)).to_pylist():
                if source not in known:
                    continue
                own = batch.filter(pc.equal(batch.column(0), source))
                for a in range(0, own.num_rows, _STRETCH):
                    part = own.slice(a, _STRETCH)
                    words = pa.array(part.column(3))  # of its own
                    best.scan(known[source], words, part.column(2).to_numpy().astype(np.int64), part.column(1))
                    if best.rows.shape[1] > _PAIRS or not a:
                        best.cut()
        if kinds is not None:
            best.cut()
            task, score, order, _ = best.rows
            names = ["query_id", "ix", "source", "item_id", "ord", "shared"]
            for a in range(0, len(task), 10_000):
                t = task[a : a + 10_000]
                columns = [[query_ids[i] for i in t], [ixs[i] for i in t], [sources[i] for i in t], best.ids[a : a + 10_000], order[a : a + 10_000], score[a : a + 10_000]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, arrow, strict=True)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(f.dataType) for f in schema.fields]
    return items.select("source", F.col("id"), F.col("ord").cast("long"), F.array_distinct(terms(F.col("text")))).mapInArrow(run, schema)


def search(tasks: DataFrame, items: DataFrame, most: int = _TASKS) -> DataFrame:
    """(query_id, ix, source, item_id, shared): of every sub-query and source the ``max_results`` items that share most
    distinct terms; ties go to the lesser ``ord``. ``tasks`` has a row a query_id, ix and source."""
    fields = [T.StructField(n, tasks.schema[n].dataType) for n in ("query_id", "ix", "source")]
    fields += [T.StructField("item_id", items.schema["id"].dataType), T.StructField("ord", T.LongType()), T.StructField("shared", T.LongType())]
    schema, done = T.StructType(fields), []
    items = items.select("source", "id", "ord", "text")
    limits = tasks.select("query_id", "ix", "source", "max_results")
    own = F.row_number().over(W.partitionBy("query_id", "ix", "source").orderBy(F.desc("shared"), "ord"))
    for block in blocks(tasks, most):
        k = max(r["max_results"] for r in block)
        found = _scan(items, block, schema).withColumn("r", own).filter(F.col("r") <= k)
        done.append(found if not done else checkpointed(found))  # a second block and more are written as they come
        if len(done) == 2:
            done[0] = checkpointed(done[0])
    if not done:
        return items.sparkSession.createDataFrame([], schema).drop("ord")
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every.join(limits, ["query_id", "ix", "source"]).filter("r <= max_results").select("query_id", "ix", "source", "item_id", "shared")
