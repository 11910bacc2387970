"""Token-ID output: best-fit-decreasing packing into id matrices with segment lengths and position resets.

A document is its ids and an end id. Documents above ``limit`` ids are split losslessly into full pieces and
a rest. The pieces of a group (about ``group`` ids, read in stored order) are placed longest first, each into
the open sequence with the least remaining capacity that still holds it; a segment tree over capacities finds
that sequence in O(log limit). One row is one sequence: a row of the id matrix padded with ``pad_id``, the
cumulative segment lengths, and the positions, which start from 0 in every segment.

No shuffle and no driver state: a partition is packed where it is read; memory is one group.

Defined results: a null text is empty and gives the end id alone; repeated rows are packed once each; an
empty table gives an empty result; other columns do not matter. ``unpack`` restores every document exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm._tokens import encoder


class CapacityTree:
    """Open sequences by remaining capacity; ``take(need)`` removes one of least sufficient capacity."""

    def __init__(self, limit: int) -> None:
        self.size = 1 << limit.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(limit + 1)]

    def put(self, capacity: int, number: int) -> None:
        self.bins[capacity].append(number)
        at = self.size + capacity
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        count, at = self.count, self.size + need
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at == 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if count[2 * at] else 2 * at + 1
        capacity = at - self.size
        while at:
            count[at] -= 1
            at >>= 1
        return capacity, self.bins[capacity].pop()


def best_fit(lengths: list[int], limit: int) -> list[list[int]]:
    """Sequences as lists of item numbers, in the order in which the items were placed."""
    tree, sequences = CapacityTree(limit), []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if found := tree.take(lengths[item]):
            capacity, number = found
            sequences[number].append(item)
        else:
            capacity, number = limit, len(sequences)
            sequences.append([item])
        if capacity > lengths[item]:
            tree.put(capacity - lengths[item], number)
    return sequences


def matrices(docs: DataFrame, tokenizer: str, limit: int = 2048, end_id: int = 1, pad_id: int = 0, key: str = "doc_id", text: str = "text", group: int = 2_000_000) -> DataFrame:
    """Rows of the packed matrix: ids and positions are little-endian unsigned 32- and 16-bit arrays of ``limit`` entries."""
    if not 0 < limit <= 65536:
        raise ValueError("limit must lie in 1..65536")
    array = lambda kind: T.ArrayType(kind)
    schema = T.StructType(
        [T.StructField("sequence_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("positions", T.BinaryType())]
        + [T.StructField("cu_seqlens", array(T.IntegerType())), T.StructField("doc_id", array(docs.schema[key].dataType)), T.StructField("starts", array(T.LongType())), T.StructField("doc_tokens", array(T.LongType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, tail = encoder(tokenizer).ids, np.array([end_id], "<u4")
        sequence = TaskContext.get().partitionId() << 33
        pieces: list[tuple] = []  # key, start, ids, ids of the document in all
        held = 0

        def emit() -> pa.RecordBatch:
            nonlocal held, sequence
            found = best_fit([len(p[2]) for p in pieces], limit)
            ids, spots = np.full((len(found), limit), pad_id, "<u4"), np.zeros((len(found), limit), "<u2")
            cu = []
            for row, items in enumerate(found):
                at, edges = 0, [0]
                for i in items:
                    n = len(pieces[i][2])
                    ids[row, at : at + n], spots[row, at : at + n] = pieces[i][2], np.arange(n)
                    edges.append(at := at + n)
                cu.append(edges)
            column = lambda k: [[pieces[i][k] for i in items] for items in found]
            arrays = [
                pa.array(range(sequence, sequence + len(found)), pa.int64()), pa.array([e[-1] for e in cu], pa.int64()),
                pa.array([r.tobytes() for r in ids], pa.binary()), pa.array([r.tobytes() for r in spots], pa.binary()),
                pa.array(cu, pa.list_(pa.int32())), pa.array(column(0), pa.list_(kind)), pa.array(column(1), pa.list_(pa.int64())), pa.array(column(3), pa.list_(pa.int64())),
            ]
            sequence += len(found)
            pieces.clear()
            held = 0
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([np.frombuffer(ids_of(value.as_py() or ""), "<u4"), tail])
                for a in range(0, len(ids), limit):
                    pieces.append((k, a, ids[a : a + limit], len(ids)))
                held += len(ids)
                if held >= group:
                    yield emit()
        if pieces:
            yield emit()

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def write(packed: DataFrame, path: str, sequences_per_file: int = 100_000) -> None:
    """Write the matrix rows as Parquet with binary columns, at most ``sequences_per_file`` rows a file."""
    packed.write.option("maxRecordsPerFile", sequences_per_file).mode("overwrite").parquet(path)


def unpack(packed: DataFrame) -> DataFrame:
    """The pieces again: doc_id, start, doc_tokens and ids as an array, one row a piece."""
    piece = T.StructType([T.StructField("doc_id", packed.schema["doc_id"].dataType.elementType), T.StructField("start", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (d, s, t, np.frombuffer(r["ids"], "<u4")[a:b].astype(np.int64))
                for r in batch.to_pylist() for d, s, t, a, b in zip(r["doc_id"], r["starts"], r["doc_tokens"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False)
            ]
            kinds = (batch.schema.field("doc_id").type.value_type, pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=piece.names)

    return packed.select("ids", "cu_seqlens", "doc_id", "starts", "doc_tokens").mapInArrow(run, piece)
