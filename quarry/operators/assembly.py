"""Selection under a token budget by greedy marginal gain."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import terms
from quarry.operators.ranking import any_required

#: Chunks of a cell, of a product of matrices, words of one; meetings of a chunk and a word that are counted at once.
_BLOCK, _STEP, _WORDS, _MEETINGS = 1 << 14, 2048, 4096, 1 << 22
_PRIMARY = ["government", "filing", "structured_fact", "medical"]


def query_type_weight() -> Column:
    has = lambda kind: F.array_contains("query_types", kind)
    claims = F.when(F.col("claim").isNull(), 0).otherwise(1)
    parts = [
        F.when(any_required(), 0.28), F.when(has("multi-hop"), F.least(F.lit(0.25), claims * 0.04)), F.when(has("fresh-fact"), F.col("freshness") * 0.25),
        F.when(has("adversarial") & (F.col("stance") == "primary_source"), 0.25), F.when(has("source-attribution") & (claims > 0), 0.18), F.when(has("dedup-prone"), F.col("surprise") * 0.3),
        F.when(has("academic") & F.col("source_type").isin("academic", "medical"), 0.22), F.when(has("cultural") & (F.col("stance") != "speculation"), 0.08),
    ]
    total = F.lit(1.0)
    for p in parts:
        total = total + F.coalesce(p, F.lit(0.0))
    return total


def penalty() -> Column:
    has = lambda kind: F.array_contains("query_types", kind)
    return F.when(F.col("stance") == "speculation", 0.18).when(has("adversarial") & (F.col("stance") == "opinion"), 0.12).when(has("fresh-fact") & (F.col("stance") == "tertiary_summary"), 0.05).otherwise(0.0)


def assemble(chunks: DataFrame, budget: int = 4000) -> DataFrame:
    """(query_id, chunk_id, decision, position, gain, reason): required types first, then by gain; rejects keep their last
    gain, and why: ``relevance``, ``budget`` or ``gain``.

    Gain is relevance * novelty * weight * type weight - penalty; novelty is 1 less the largest claim overlap with
    the selection. The choice is sequential and a query's chunks are few after pre-ranking, so it runs per query.
    """
    rows = chunks.withColumn("type_weight", query_type_weight()).withColumn("penalty", penalty()).withColumn("claim_terms", F.array_distinct(terms(F.coalesce("claim", F.lit("")))))
    rows = rows.select("query_id", "chunk_id", "source_type", "stance", "relevance", "weight", "freshness", "tokens", "type_weight", "penalty", "claim_terms", "required_types")

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        r = rows.to_dict("records")
        sets = [frozenset(x["claim_terms"]) for x in r]
        pool, taken, used, out = set(range(len(r))), [], 0, []

        def like(i: int, j: int) -> float:
            return len(sets[i] & sets[j]) / min(len(sets[i]), len(sets[j])) if sets[i] and sets[j] else 0.0

        def gain(i: int) -> float:
            new = min(1.0, max(0.05, 1 - max(like(i, j) for j in taken))) if taken else 1.0
            return r[i]["relevance"] * new * r[i]["weight"] * r[i]["type_weight"] - r[i]["penalty"]

        def best(places) -> int:
            return min(places, key=lambda i: (-gain(i), -r[i]["relevance"], -r[i]["weight"], -r[i]["freshness"], r[i]["chunk_id"]))

        def fits(i: int, kind: str) -> bool:
            return r[i]["stance"] == "primary_source" or r[i]["source_type"] in _PRIMARY if kind == "primary-document" else kind != "news" and r[i]["source_type"] == kind

        def settle(i: int, ok: bool, value: float) -> None:
            nonlocal used
            pool.discard(i)
            why = None if ok else "relevance" if r[i]["relevance"] < 0.08 else "budget" if used + r[i]["tokens"] > budget else "gain"
            out.append((r[i]["query_id"], r[i]["chunk_id"], "selected" if ok else "rejected", len(taken) if ok else None, value, why))
            if ok:
                taken.append(i)
                used += r[i]["tokens"]

        for kind in r[0]["required_types"]:
            if kind != "news" and not any(fits(i, kind) for i in taken):
                open_ = [i for i in pool if fits(i, kind) and r[i]["relevance"] >= 0.12]
                if open_:
                    i = best(open_)
                    settle(i, used + r[i]["tokens"] <= budget and gain(i) + 0.35 > 0.02, gain(i) + 0.35)
        while pool and used < budget:
            i = best(pool)
            value = gain(i)
            settle(i, r[i]["relevance"] >= 0.08 and used + r[i]["tokens"] <= budget and value > 0, value)
        for i in sorted(pool):
            settle(i, False, gain(i))
        return pd.DataFrame(out, columns=["query_id", "chunk_id", "decision", "position", "gain", "reason"]).astype({"position": "Int32"})

    return rows.groupBy("query_id").applyInPandas(choose, "query_id long, chunk_id string, decision string, position int, gain double, reason string")


class _Held:
    """Chunks of a cell, ready to meet selected ones: the words that many of them have as columns of a matrix, the others as the
    rows that have them."""

    def __init__(self, ids: list, own: pa.ListArray) -> None:
        self.ids, self.size = ids, pc.list_value_length(own).to_numpy()
        self.best, self.at = np.zeros(len(ids)), {}
        for i, name in enumerate(ids):
            self.at.setdefault(name, []).append(i)
        self.words, word = np.unique(pc.list_flatten(own).to_numpy(), return_inverse=True)
        often = np.bincount(word, minlength=len(self.words))
        common = np.argsort(-often, kind="stable")[: min(_WORDS, int((often > 0.1 * len(ids)).sum()))]
        self.column = np.full(len(self.words), -1)
        self.column[common] = np.arange(len(common))
        ends = np.concatenate([[0], np.cumsum(self.size)])
        self.blocks = []
        for start in range(0, len(ids), _STEP):
            n = min(_STEP, len(ids) - start)
            row, mine = np.repeat(np.arange(n), self.size[start : start + n]), word[ends[start] : ends[start + n]]
            columns = self.column[mine]
            marks = np.zeros((len(common), n), np.uint8)
            marks[columns[columns >= 0], row[columns >= 0]] = 1
            row, mine = row[columns < 0], mine[columns < 0]
            order = np.argsort(mine, kind="stable")
            begin = np.searchsorted(mine[order], np.arange(len(self.words) + 1)).astype(np.int32)
            self.blocks.append((start, n, marks, row[order].astype(np.int32), begin))

    def meet(self, ids: list, own: pa.ListArray) -> None:
        """Raise ``best`` to the largest overlap coefficient with chunks that have other ids."""
        size, words = pc.list_value_length(own).to_numpy(), pc.list_flatten(own).to_numpy()
        word, row = np.searchsorted(self.words, words).clip(max=len(self.words) - 1), np.repeat(np.arange(len(ids)), size)
        known = self.words[word] == words
        word, row = word[known], row[known]
        columns = self.column[word]
        theirs = np.zeros((len(ids), int(self.column.max()) + 1), np.float32)
        theirs[row[columns >= 0], columns[columns >= 0]] = 1
        word, row = word[columns < 0], row[columns < 0]
        own_rows = [(i, j) for i, name in enumerate(ids) for j in self.at.get(name, ())]
        for start, n, marks, rows, begin in self.blocks:
            shared = theirs @ marks.astype(np.float32)
            count = (begin[word + 1] - begin[word]).astype(np.int64)
            stop = np.cumsum(count)
            cuts = [*np.searchsorted(stop, np.arange(0, stop[-1] if len(stop) else 0, _MEETINGS), "right"), len(stop)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                met = count[x:y]
                first = np.cumsum(met) - met
                there = rows[np.arange(met.sum()) + np.repeat(begin[word[x:y]] - first, met)]
                shared += np.bincount(np.repeat(row[x:y] * n, met) + there, minlength=shared.size).reshape(shared.shape)
            like = shared / np.minimum.outer(size, self.size[start : start + n]).astype(np.float64)
            for i, j in own_rows:
                if start <= j < start + n:
                    like[i, j - start] = 0
            np.maximum(self.best[start : start + n], like.max(0), out=self.best[start : start + n])


def _most_alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the chunks of each cell the largest overlap coefficient with its selected ones, which follow them and are not kept."""
    names, cell, parts, held = ["query_id", "chunk_id", "like"], None, [], None

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.Table.from_batches(parts)[c].combine_chunks() for c in names[:2]] + [pa.array(held.best)], names=names)

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("query_id", "i", "side")), strict=True))
        cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if start == end:
                continue
            piece, (*at, side) = batch.slice(start, end - start), keys[start]
            if at != cell:
                if held:
                    yield told()
                cell, parts, held = at, [], None
            if side == 0:
                parts.append(piece)
            elif parts:
                if held is None:
                    asked = pa.Table.from_batches(parts)
                    held = _Held(asked["chunk_id"].to_pylist(), asked["own"].combine_chunks())
                    parts, asked = asked.select(names[:2]).to_batches(), None
                for k in range(0, piece.num_rows, _STEP // 4):
                    step = piece.slice(k, _STEP // 4)
                    held.meet(step.column("chunk_id").to_pylist(), step.column("own"))
    if held:
        yield told()


def final_gains(chunks: DataFrame, selection: DataFrame, block: int = _BLOCK) -> DataFrame:
    """Every chunk's gain against the final selection without itself, to 4 digits.

    Each cell holds about ``block`` chunks of a query at most, and all selected ones of the query pass by them in steps: chunks move
    once, selected ones once a cell, and no pair leaves its cell. Small inputs have as many cells as keep all cores busy. Words are
    known by 64-bit hashes.
    """
    parts = ["relevance", "weight", "type_weight", "penalty"]
    rows = chunks.withColumn("type_weight", query_type_weight()).withColumn("penalty", penalty()).withColumn("own", F.transform(F.array_distinct(terms(F.coalesce("claim", F.lit("")))), lambda t: F.xxhash64(t)))
    rows = rows.select("query_id", "chunk_id", "own", *parts)
    taken = selection.filter("decision = 'selected'").select("query_id", "chunk_id").distinct()
    picked = rows.select("query_id", "chunk_id").join(taken, ["query_id", "chunk_id"])
    count = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    busy = 4 * chunks.sparkSession.sparkContext.defaultParallelism
    spread = F.least(F.ceil(F.col("n") / _STEP), F.ceil(F.col("n") * busy / F.col("all")))
    number = count.crossJoin(count.agg(F.sum("n").alias("all"))).select("query_id", F.greatest(F.ceil(F.col("n") / block), spread).cast("int").alias("across"))
    marked = rows.select("query_id", "chunk_id", "own").filter("size(own) > 0").join(taken.withColumn("taken", F.lit(True)), ["query_id", "chunk_id"], "left").join(number, "query_id")
    place = lambda i, side: F.struct(i.cast("int").alias("i"), F.lit(side).alias("side"))
    once = F.array(place(F.pmod(F.xxhash64("chunk_id"), F.col("across")), 0))
    each = F.when(F.col("taken"), F.transform(F.sequence(F.lit(0), F.col("across") - 1), lambda i: place(i, 1)))
    cells = marked.select("query_id", "chunk_id", "own", F.explode(F.concat(once, F.coalesce(each, F.array().cast("array<struct<i:int,side:int>>")))).alias("to")).select("query_id", "to.i", "to.side", "chunk_id", "own")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    likes = cells.repartition("query_id", "i").sortWithinPartitions("query_id", "i", "side").mapInArrow(_most_alike, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, like double").groupBy("query_id", "chunk_id").agg(F.max("like").alias("like"))
    one = rows.groupBy("query_id", "chunk_id").agg(*(F.first(c).alias(c) for c in parts))
    ends = picked.groupBy("query_id").agg(F.min("chunk_id").alias("low"), F.max("chunk_id").alias("high"))
    most = one.join(ends, "query_id", "left").join(likes, ["query_id", "chunk_id"], "left")
    alone = F.col("low").isNull() | ((F.col("low") == F.col("chunk_id")) & (F.col("high") == F.col("chunk_id")))  # none else is selected
    new = F.when(alone, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.05), 1 - F.coalesce("like", F.lit(0.0)))))
    g = F.col("relevance") * new * F.col("weight") * F.col("type_weight") - F.col("penalty")
    return most.select("query_id", "chunk_id", (F.floor(g * 10000 + 0.5) / 10000).alias("gain"))


def fitting(rows: DataFrame, group: str, order: str, tokens: str, budget: int) -> DataFrame:
    """(group, order, used): of every group, in order, the rows that still fit the budget; one that does not is passed over.

    Whether a row fits depends on those taken before it, so a group's sizes are folded as one array, in the JVM.
    """
    sizes = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(tokens).cast("long").alias("t")))).alias("s"))
    kept = "struct<used:bigint,taken:array<struct<o:bigint,used:bigint>>>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<o:bigint,used:bigint>>").alias("taken")).cast(kept)

    def step(acc: Column, x: Column) -> Column:
        now = acc["used"] + x["t"]
        more = F.concat(acc["taken"], F.array(F.struct(x["o"].cast("long").alias("o"), now.alias("used"))))
        return F.when(now <= budget, F.struct(now.alias("used"), more.alias("taken")).cast(kept)).otherwise(acc)

    taken = sizes.select(group, F.explode(F.aggregate("s", start, step, lambda a: a["taken"])).alias("x"))
    return taken.select(group, F.col("x.o").alias(order), F.col("x.used").alias("used"))
