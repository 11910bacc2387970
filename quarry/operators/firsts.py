"""Clusters by the first similar member, without putting a group into one task.

In the order of ids, a vector joins the first cluster that has a member similar to it, else it begins one. A cluster's
first vector is thus, for each member, the least one that can be reached by steps from a vector to an earlier similar
one: what cannot be left is the beginning of a cluster. So the order needs no sequence of steps over all rows:

1. a group is dealt to blocks of about ``block`` vectors by a hash of the ids, and each pair of blocks is one task, which
   keeps, as bits, the earlier similar vectors of each (all pairs of a group are compared, as any may be the similar one);
2. in rounds, every vector takes the least beginning that its earlier similar vectors know, until none changes. A round
   reads the bits and passes one number a vector and block; there are as many rounds as the longest chain needs;
3. beginnings are numbered in order within a group, by ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.shared import checkpointed

_NONE = np.iinfo(np.int64).max


def _unit(vectors: pa.ListArray) -> np.ndarray:
    if len(np.unique(np.diff(vectors.offsets.to_numpy()))) > 1:
        raise ValueError("vectors of a group differ in length")
    v = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """The values of each row, arrays as Arrow arrays: what is held as Python objects is one row's numbers and names."""
    for batch in batches:
        for i in range(batch.num_rows):
            values = (c[i] for c in batch.columns)
            yield [x.values if isinstance(x, pa.ListScalar) else x.as_py() for x in values]


def _earlier(pairs: DataFrame, threshold: float) -> DataFrame:
    """Of pairs of blocks (g, a, b, ids_a, vectors_a, ids_b, vectors_b), a <= b: (g, block, other, bits), the earlier similar
    vectors in ``other`` of each vector of ``block``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, a, b, ids_a, va, ids_b, vb in _rows(batches):
            ids_a, ids_b = ids_a.to_numpy(), ids_b.to_numpy()
            near = _unit(va) @ _unit(vb).T >= threshold
            found = [(g, a, b, near & (ids_b < ids_a[:, None]))] + ([(g, b, a, near.T & (ids_a < ids_b[:, None]))] if a != b else [])
            rows = [(g, x, y, np.packbits(bits).tobytes()) for g, x, y, bits in found if bits.any()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["g", "block", "other", "bits"])

    return pairs.mapInArrow(run, "g string, block int, other int, bits binary")


def _passed(known: DataFrame) -> DataFrame:
    """Of (g, block, bits, n, firsts of the other block): (g, block, firsts), the least that each vector hears of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = ["g", "block", "firsts"], {}
        for g, block, bits, n, firsts in _rows(batches):
            flags = np.unpackbits(np.frombuffer(bits, np.uint8), count=n * len(firsts)).reshape(n, -1).astype(bool)
            heard = np.where(flags, firsts.to_numpy(), _NONE).min(1)
            if (g, block) in held:
                np.minimum(held[g, block], heard, out=held[g, block])
            else:
                held[g, block] = heard
            if len(held) >= 256:  # a task tells each block once, or as often as it has seen so many
                yield _told(held, names)
        if held:
            yield _told(held, names)

    return known.select("g", "block", "bits", "n", "firsts").mapInArrow(run, "g string, block int, firsts array<long>")


def _told(held: dict, names: list[str]) -> pa.RecordBatch:
    flat = pa.array(np.concatenate(list(held.values())))
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, held.values())]), pa.int32()), flat)
    out = pa.RecordBatch.from_arrays([pa.array([g for g, _ in held], pa.string()), pa.array([b for _, b in held], pa.int32()), lists], names=names)
    held.clear()
    return out


def _least(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"g": rows.g[:1], "block": rows.block[:1], "firsts": [np.minimum.reduce(list(rows.firsts))]})


def first_similar(rows: DataFrame, key: str, group: str, vector: str, threshold: float, block: int = 1024) -> DataFrame:
    """(key, group, cluster) of every row with a vector: its cluster's number in the group, from 0, in order of its first member.

    Keys are whole numbers, different within a group; vectors of a group are of one length. A null group is one; rows
    without a key or vector are left out; an empty table gives an empty result.
    """
    own = rows.filter(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.to_json(F.struct(F.col(group).alias("g"))).alias("g"), F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.col(group).alias("of"))
    sizes = own.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"), F.first("of").alias("of"))
    sizes = checkpointed(sizes)
    dealt = own.drop("of").join(sizes.drop("of"), "g").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    packed = F.sort_array(F.collect_list(F.struct("id", "v")))
    blocks = dealt.groupBy("g", "block").agg(packed.alias("x"), F.first("blocks").alias("blocks"))
    blocks = checkpointed(blocks.select("g", "block", "blocks", F.transform("x", lambda x: x["id"]).alias("ids"), F.transform("x", lambda x: x["v"]).alias("vectors")))
    left = blocks.select("g", F.col("block").alias("a"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("b"), F.col("ids").alias("ids_a"), F.col("vectors").alias("va"))
    right = blocks.select("g", F.col("block").alias("b"), F.col("ids").alias("ids_b"), F.col("vectors").alias("vb"))
    earlier = checkpointed(_earlier(left.join(right, ["g", "b"]).select("g", "a", "b", "ids_a", "va", "ids_b", "vb"), threshold))
    firsts = checkpointed(blocks.select("g", "block", F.col("ids").alias("firsts")))
    mark = None
    while True:
        told = earlier.join(firsts.select("g", F.col("block").alias("other"), "firsts"), ["g", "other"]).join(blocks.select("g", "block", F.size("ids").alias("n")), ["g", "block"])
        firsts = checkpointed(firsts.unionByName(_passed(told)).groupBy("g", "block").applyInPandas(_least, "g string, block int, firsts array<long>"))
        now = firsts.agg(F.sum(F.xxhash64("g", "block", "firsts").cast("decimal(38,0)"))).first()[0]
        if now == mark:
            break
        mark = now
    found = blocks.join(firsts, ["g", "block"]).select("g", F.explode(F.arrays_zip("ids", "firsts")).alias("x")).select("g", F.col("x.ids").alias("id"), F.col("x.firsts").alias("first"))
    # beginnings in ranges of (group, number); of a group, each range counts on from the ranges before
    heads = checkpointed(found.filter("id = first").select("g", "first").repartitionByRange("g", "first").withColumn("part", F.spark_partition_id()))
    before = heads.groupBy("g", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(W.partitionBy("g").orderBy("part")) - F.col("n"))  # a row a range
    numbered = heads.withColumn("r", F.row_number().over(W.partitionBy("g", "part").orderBy("first"))).join(before, ["g", "part"]).select("g", "first", (F.col("before") + F.col("r") - 1).cast("int").alias("cluster"))
    return found.join(numbered, ["g", "first"]).join(sizes.select("g", "of"), "g").select(F.col("id").alias(key), F.col("of").alias(group), "cluster")
