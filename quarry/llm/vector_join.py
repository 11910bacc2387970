"""Near duplicates among vectors by spherical-cap filters.

Equal vectors are one node. A filter is a direction on the sphere; a node belongs to the cap of a filter if it lies near
enough to its direction, and near nodes share caps. Directions are the words of ``CODES`` structured random product codes:
the space is rotated at random and cut into two halves, each with ``WORDS`` random unit vectors, and every pair of such is a
direction, so a code of 2 * ``WORDS`` vectors names ``WORDS ** 2`` directions. Those near a node are list-decoded from the
best vectors of each half, without visiting the others. The caps are as high as lets each node into ``LIST`` of a code's
filters: at one height for all, a node would be in anything from none to hundreds of them, as the sums of a product code
depend on each other. Nodes are joined on filters, and pairs verified:

* nodes travel with their vectors in bytes and the exact error of that. Inner products of these, with their bounds, decide
  nearly all pairs in the task; the few that may be on either side of the threshold are looked up and compared in double precision;
* a pair that shares several filters counts at the least of them, which every node's list of filters tells. So links are
  counted where they are found, and only counts by node and a spanning forest of each group leave the task, no pairs;
* a group that holds much of the input (near copies) is not compared with itself: up to ``_PIVOTS`` pivots are chosen from
  a sample of ``_SAMPLE`` nodes, and nodes within half the threshold's angle of a pivot are linked by the triangle
  inequality, so they are counted as a ball and are one node for components. The sample decides what is fast, not what is linked;
* filters of more than ``_STRIPE`` nodes are cut into stripes; the nodes of the filter's main ball are dealt to stripes,
  the others meet each stripe. Each pair meets in one cell.

Of pairs at the threshold 99 % share a filter, of pairs at 0.95 all but one in a thousand (on random vectors, whatever the
data, as the codes are random); each link that is reported is one. An index of another size has the same recall.

Defined results: a vector that is null, empty, zero or holds null or non-finite components links with nothing, nor do
vectors of different lengths; equal vectors, repeated rows too, link with one another, and each row counts; a null id is
least of none: it is a component's id only if all are null; ``kept`` is true where the id is the component's, so also for
null ids of such; repeated ids are all kept or none; an empty table gives an empty result; other columns do not matter. A
node is known by a 64-bit hash of its vector: among 10^9 different vectors two coincide with a chance of 3 %.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._spark import drop, materialize, shuffle_partitions
from quarry.llm.components import components, salted_join
from quarry.llm.vector_codes import _usable

CODES, WORDS, LIST = 4, 1024, 6
_SAMPLE, _PIVOTS, _STRIPE = 2048, 512, 2048
#: Members that a pivot has in the sample at least; inner products in float32 are this near.
_HOT, _FLOAT = 4, 1e-5
#: Filters of more than a stripe's nodes up to which their table is broadcast.
_FEW = 1 << 15


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled before they are squared, so that any finite numbers do."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


@cache
def _code(width: int, turn: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Signs of a random rotation (signs and Hadamard transforms, three times) and the unit vectors of each half."""
    rng = np.random.default_rng([0x5EED, width, turn])
    halves = rng.normal(size=(2, WORDS, width // 2)).astype(np.float32)
    return rng.choice([-1.0, 1.0], (3, width)).astype(np.float32), [h / np.linalg.norm(h, axis=1, keepdims=True) for h in halves]


def _rotated(rows: np.ndarray, signs: np.ndarray) -> np.ndarray:
    n, width = rows.shape
    for s in signs:
        rows, step = rows * s, 1
        while step < width:
            pairs = rows.reshape(n, -1, 2, step)
            rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, width)
            step *= 2
        rows = rows / np.float32(np.sqrt(width))
    return rows


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of each row's ``k`` largest, in descending order."""
    at = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    value = np.take_along_axis(scores, at, 1)
    order = np.argsort(-value, axis=1, kind="stable")
    return np.take_along_axis(at, order, 1), np.take_along_axis(value, order, 1)


def filters(rows: np.ndarray) -> np.ndarray:
    """The filters of unit vectors: CODES * LIST ascending numbers a row."""
    width = max(64, 1 << (rows.shape[1] - 1).bit_length())
    padded = np.zeros((len(rows), width), np.float32)
    padded[:, : rows.shape[1]] = rows
    p, q = np.nonzero(np.multiply.outer(np.arange(1, LIST + 1), np.arange(1, LIST + 1)) <= LIST)  # the best sums are among these ranks
    out = []
    for turn in range(CODES):
        signs, (one, two) = _code(width, turn)
        turned = _rotated(padded, signs)
        (a, x), (b, y) = _best(turned[:, : width // 2] @ one.T, LIST), _best(turned[:, width // 2 :] @ two.T, LIST)
        top, _ = _best(x[:, p] + y[:, q], LIST)
        out.append((turn * WORDS + np.take_along_axis(a[:, p], top, 1)) * WORDS + np.take_along_axis(b[:, q], top, 1))
    return np.sort(np.concatenate(out, 1), 1)


def _rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and doubles of the vectors of each length."""
    flat, size = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(column.offsets.to_numpy())
    start = np.cumsum(size) - size
    for width in np.unique(size).tolist():
        at = np.flatnonzero(size == width)
        for a in range(0, len(at), 2048):
            yield at[a : a + 2048], flat[start[at[a : a + 2048]][:, None] + np.arange(width)]


def _half(threshold: float) -> float:
    """The cosine of half the threshold's angle, and a little."""
    return float(np.cos(np.arccos(threshold) / 2)) + 1e-9


def pivots(nodes: DataFrame, threshold: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length of vectors, numbers and unit vectors of nodes that many of a sample lie near, none near another."""
    sample = nodes.select("node", "vector").orderBy(F.xxhash64("node"), "node").limit(_SAMPLE).toArrow().combine_chunks()
    out = {}
    for width in set(np.diff(sample.column(1).chunk(0).offsets.to_numpy()).tolist()) if sample.num_rows else ():
        ids, rows = zip(*((sample.column(0).to_numpy()[at], unit(v)) for at, v in _rows(sample.column(1).chunk(0)) if v.shape[1] == width), strict=True)
        ids, rows = np.concatenate(ids), np.concatenate(rows)
        near, free, chosen = rows @ rows.T >= _half(threshold), np.ones(len(rows), bool), []
        while len(chosen) < _PIVOTS:
            members = near[:, free].sum(1) * free
            p = int(members.argmax())
            if members[p] < _HOT:
                break
            chosen.append(p)
            free &= ~near[p]
        if chosen:
            out[width] = ids[chosen], rows[chosen]
    return out


_CODED = "node long, mult long, least {key}, ball long, width int, code binary, step float, error float, filters array<int>"


def _coded(nodes: DataFrame, known: dict, threshold: float) -> DataFrame:
    """Nodes with their ball, their vector in bytes and its error, and their filters."""
    shared, half = nodes.sparkSession.sparkContext.broadcast(known), _half(threshold)
    schema = _CODED.format(key=nodes.schema["least"].dataType.simpleString())
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in _rows(batch.column(3)):
                rows = unit(rows)
                ball = pa.nulls(len(at), pa.int64())
                if rows.shape[1] in shared.value:
                    ids, centres = shared.value[rows.shape[1]]
                    cos = rows @ centres.T
                    ball = pa.array(ids[cos.argmax(1)], mask=cos.max(1) < half)
                step = (np.abs(rows).max(1) / 127).astype(np.float32)
                code = np.rint(rows / step[:, None].astype(np.float64)).astype(np.int8)
                error = np.sqrt(((rows - code * step[:, None].astype(np.float64)) ** 2).sum(1)) * 1.001 + 1e-7
                found = filters(rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel().astype(np.int32)))
                taken = [batch.column(i).take(pa.array(at)) for i in range(3)]
                columns = [*taken, ball, pa.array(np.full(len(at), rows.shape[1], np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(step), pa.array(error.astype(np.float32)), lists]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return nodes.select("node", "mult", "least", "vector").mapInArrow(run, schema)


def _cells(coded: DataFrame, stripe: int, scratch: list[str]) -> DataFrame:
    """Nodes by filter and cell. side 2: compared with all of its cell; else with those of the other side."""
    flat = coded.select("width", F.explode("filters").alias("filter"), "ball")
    own = flat.groupBy("width", "filter", "ball").agg(F.count(F.lit(1)).alias("n"))
    large = own.groupBy("width", "filter").agg(F.sum("n").alias("n"), F.max(F.when(F.col("ball").isNotNull(), F.struct("n", "ball"))).alias("main")).filter(F.col("n") > stripe)
    many = F.coalesce(F.col("main.n"), F.lit(0))
    parts = lambda n: F.ceil(n / F.lit(stripe)).cast("int")
    large = materialize(large.select("width", "filter", F.col("main.ball").alias("main"), parts(many).alias("mains"), parts(F.col("n") - many).alias("opens")), scratch)
    rows = coded.select("node", "mult", "ball", "width", "code", "step", "error", "filters", F.posexplode("filters").alias("at", "filter"))
    rows = rows.withColumn("smaller", F.expr("slice(filters, 1, at)")).drop("filters", "at")
    if large.limit(_FEW + 1).count() <= _FEW:
        rows = rows.join(F.broadcast(large), ["width", "filter"], "left")  # at most _FEW rows
    else:  # a large filter's rows are dealt to parts before they meet its row; merged, as Spark sees no size of what is multiplied
        salt = F.pmod(F.xxhash64("node"), F.lit(16)).cast("int")
        salted = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        rows = rows.withColumn("salt", salt).join(salted.hint("merge"), ["width", "filter", "salt"], "left")
    # cells of main stripe i and open stripe j: i * opens + j; of open stripes j <= k: behind those, j * opens + k
    mine = F.pmod(F.xxhash64(F.col("node"), F.lit(7)), F.when(F.col("ball") == F.col("main"), F.col("mains")).otherwise(F.col("opens"))).cast("int")
    cells = F.expr(
        "CASE WHEN opens IS NULL THEN array(struct(0 AS cell, 2 AS side))"
        " WHEN opens = 0 THEN array()"
        " WHEN ball = main THEN transform(sequence(0, opens - 1), j -> struct(mine * opens + j AS cell, 0 AS side))"
        " ELSE concat(transform(filter(sequence(0, mains), i -> i < mains), i -> struct(i * opens + mine AS cell, 1 AS side)),"
        "             transform(sequence(0, opens - 1), j -> struct((mains + least(j, mine)) * opens + greatest(j, mine) AS cell, CASE WHEN j = mine THEN 2 WHEN j > mine THEN 0 ELSE 1 END AS side))) END"
    )
    rows = rows.withColumn("mine", mine).withColumn("cell", F.explode(cells))
    return rows.select("width", "filter", F.col("cell.cell").alias("cell"), F.col("cell.side").alias("side"), "node", "mult", F.coalesce("ball", "node").alias("super"), "code", "step", "error", "smaller")


def _compare(group: list[tuple], width: int, threshold: float) -> tuple[np.ndarray, ...]:
    """Of one cell: nodes with counts of links, edges between nodes or balls, pairs to be looked at."""
    side, node, mult, ball, code, step, error, smaller = zip(*group, strict=True)
    side, node, mult, ball = np.array(side), np.array(node, np.int64), np.array(mult, np.int64), np.array(ball, np.int64)
    rows = np.frombuffer(b"".join(code), np.int8).reshape(-1, width).astype(np.float32) * np.array(step, np.float32)[:, None]
    error = np.array(error, np.float32)
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    sure, maybe = [], []
    for a in range(0, len(left), 512):
        i = left[a : a + 512]
        product = rows[i] @ rows[right].T
        bound = (1 + error[i])[:, None] * error[right] + (1 + error[right]) * error[i][:, None] + error[i][:, None] * error[right] + _FLOAT
        x, y = np.nonzero(product + bound >= threshold)
        p, q = i[x], right[y]
        keep = (ball[p] != ball[q]) & ((side[p] != side[q]) | ((side[p] == 2) & (p < q)))
        keep[keep] = [not smaller[s] or not smaller[t] or smaller[s].isdisjoint(smaller[t]) for s, t in zip(p[keep].tolist(), q[keep].tolist(), strict=True)]
        certain = (product[x, y] - bound[x, y] >= threshold)[keep]
        sure.append(np.stack([p[keep][certain], q[keep][certain]]))
        maybe.append(np.stack([p[keep][~certain], q[keep][~certain]]))
    sure, maybe = np.concatenate(sure, 1) if sure else np.zeros((2, 0), int), np.concatenate(maybe, 1) if maybe else np.zeros((2, 0), int)
    count = np.bincount(sure[0], mult[sure[1]], len(node)).astype(np.int64) + np.bincount(sure[1], mult[sure[0]], len(node)).astype(np.int64)
    if not sure.size and not maybe.size:
        return node[:0], count[:0], np.zeros((0, 2), np.int64), np.zeros((0, 2), np.int64), np.zeros((0, 2), np.int64)
    at = np.flatnonzero(count)
    label = ball.copy()  # a forest: each node or ball to the least one that it reaches
    ends = ball[sure]
    while sure.size:
        low = np.minimum(label[sure[0]], label[sure[1]])
        before = label.copy()
        np.minimum.at(label, sure[0], low)
        np.minimum.at(label, sure[1], low)
        ids, place = np.unique(ball, return_inverse=True)  # all of a ball follow its least
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, place, label)
        label = least[place]
        if (label == before).all():
            break
    edges = np.unique(np.stack([ball, label], 1)[np.isin(ball, ends)], axis=0)
    edges = edges[edges[:, 0] != edges[:, 1]]
    return node[at], count[at], edges, node[maybe.T], ball[maybe.T]


_FOUND = "kind int, a long, b long, sa long, sb long"


def _found(cells: DataFrame, threshold: float) -> DataFrame:
    """kind 0: node a has b more links; 1: an edge between the nodes or balls a and b; 2: nodes a, b of sa, sb to be looked at."""
    names = [c.split()[0] for c in _FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def close(key: tuple, group: list[tuple]) -> None:
            nonlocal size
            if len(group) > 1:
                nodes, counts, edges, maybe, balls = _compare(group, key[0], threshold)
                links, none = np.zeros((len(nodes), 5), np.int64), np.zeros((len(edges), 5), np.int64)
                links[:, 1], links[:, 2] = nodes, counts
                none[:, 0], none[:, 1:3] = 1, edges
                new = [links, none, np.concatenate([np.full((len(maybe), 1), 2), maybe, balls], 1)]
                held.extend(x for x in new if len(x))
                size += sum(map(len, new))

        def ship() -> pa.RecordBatch:
            nonlocal size
            rows = np.concatenate(held) if held else np.zeros((0, 5), np.int64)
            held.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(rows[:, 0].astype(np.int32)), *(pa.array(rows[:, i]) for i in range(1, 5))], names=names)

        key, group = None, []
        for batch in batches:
            for width, filter_, cell, *row, smaller in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (width, filter_, cell) != key and group:
                    close(key, group)
                    group = []
                    if size > 200_000:
                        yield ship()
                key = (width, filter_, cell)
                group.append((*row, frozenset(smaller)))
        if group:
            close(key, group)
        yield ship()

    dealt = cells.repartition(shuffle_partitions(cells.sparkSession), "width", "filter", "cell").sortWithinPartitions("width", "filter", "cell")
    return dealt.mapInArrow(run, _FOUND)


def _verified(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sa, sb, ma, mb) of the pairs whose cosine reaches the threshold in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for at, x in _rows(batch.column(6)):
                y = batch.column(7).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(x.shape)
                keep[at] = cosines(x, y) >= threshold
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:6]], names=["a", "b", "sa", "sb", "ma", "mb"])

    a = nodes.select(F.col("node").alias("a"), F.col("mult").alias("ma"), F.col("vector").alias("va"))
    b = nodes.select(F.col("node").alias("b"), F.col("mult").alias("mb"), F.col("vector").alias("vb"))
    joined = salted_join(salted_join(pairs, a, "a", "b"), b, "b", "a").select("a", "b", "sa", "sb", "ma", "mb", "va", "vb")
    return joined.mapInArrow(run, "a long, b long, sa long, sb long, ma long, mb long")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, stripe: int = _STRIPE) -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    if not 0 < threshold < 1:
        raise ValueError("threshold must be between 0 and 1")
    spark, scratch = vectors.sparkSession, []
    usable = _usable(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector")).withColumn("node", F.when(usable, F.xxhash64("vector")))
    known = rows.filter("node is not null")
    nodes = materialize(known.groupBy("node").agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("mult"), F.min("key").alias("least")), scratch)
    coded = materialize(_coded(nodes, pivots(nodes, threshold), threshold), scratch)
    found = materialize(_found(_cells(coded, stripe, scratch), threshold), scratch)
    looked = materialize(_verified(found.filter("kind = 2").select("a", "b", "sa", "sb"), nodes, threshold), scratch)
    more = found.filter("kind = 0").select(F.col("a").alias("node"), F.col("b").alias("more"))
    more = more.unionByName(looked.select(F.col("a").alias("node"), F.col("mb").alias("more"))).unionByName(looked.select(F.col("b").alias("node"), F.col("ma").alias("more")))
    more = more.groupBy("node").agg(F.sum("more").alias("more"))
    edges = found.filter("kind = 1").select("a", "b").unionByName(looked.select(F.col("sa").alias("a"), F.col("sb").alias("b")))
    roots = materialize(components(edges, scratch), scratch)
    # balls are few (at most _PIVOTS a length), so their sizes are a small table
    sizes = coded.filter("ball is not null").groupBy("ball").agg(F.sum("mult").alias("size"))
    own = coded.select("node", "mult", "least", "ball", F.coalesce("ball", "node").alias("super")).join(F.broadcast(sizes), "ball", "left").join(more, "node", "left")
    own = own.select("node", "super", "least", (F.coalesce("size", "mult") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    firsts = own.groupBy("super").agg(F.min("least").alias("least")).join(roots.withColumnRenamed("node", "super"), "super", "left").withColumn("root", F.coalesce("root", "super"))
    firsts = salted_join(firsts.select("super", "root"), firsts.groupBy("root").agg(F.min("least").alias("component_id")), "root", "super").select("super", "component_id")
    named = materialize(salted_join(own, firsts, "super", "node").select("node", "n_links", "component_id"), scratch)
    linked = salted_join(known.select("key", "node"), named, "node", "key").select("key", "n_links", "component_id")
    alone = rows.filter("node is null").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    result = linked.unionByName(alone).select(F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
    result = materialize(result)
    drop(spark, scratch)
    return result
