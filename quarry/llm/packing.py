"""Packing: order-preserving dynamic programming over token windows.

Each input partition is one stream of ids in stored order, every document followed by an end id. A window
holds at most ``limit`` ids and ends at a document end, at a sentence end (truncation penalty), or, only
where no boundary lies in reach, inside a sentence. With ``b`` the boundary positions, the least cost of
cutting at ``b[j]`` is

    f[j] = min over i with b[j] - b[i] <= limit of f[i] + (limit - (b[j] - b[i])) + penalty[j],

so the transition needs the minimum of ``f[i] + b[i]`` over a sliding window: a monotone queue gives it in
amortised constant time. Chunks of about ``chunk`` ids are solved at once, and the last window of a chunk is
carried into the next, so memory is bounded for any stream and any document length.

No shuffle: a partition is packed where it is read. ``sequence_id`` holds the partition in its high bits.

Defined results: a null text is empty and gives the end id alone; repeated rows are packed once each, as
they come; an empty table gives an empty result; other columns do not matter. Every id of every document
lies in exactly one piece, in order.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarry.llm._tokens import encoder, sentence_ends

PIECES = [("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())]


def boundaries(doc_ends: np.ndarray, sentence: np.ndarray, total: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending cut positions in (0, total] and their kinds: 0 document end, 1 sentence end, 2 neither.

    Positions of kind 2 are added so that no gap exceeds ``limit``.
    """
    kind = np.full(total + 1, 3, np.int8)
    kind[sentence] = 1
    kind[doc_ends] = 0
    kind[total] = min(kind[total], 2)
    kind[0] = 3
    at = np.flatnonzero(kind < 3)
    gaps = np.diff(at, prepend=0)
    if (gaps > limit).any():
        extra = [np.arange(a - g + limit, a, limit) for a, g in zip(at[gaps > limit], gaps[gaps > limit], strict=True)]
        kind[np.concatenate(extra)] = 2
        at = np.flatnonzero(kind < 3)
    return at, kind[at]


def best_cuts(at: np.ndarray, penalty: np.ndarray, limit: int) -> list[int]:
    """The cut positions of least total padding plus penalties, by a monotone queue."""
    places, costs = [0, *at.tolist()], [0, *penalty.tolist()]
    n = len(places)
    value, back = [0] * n, [0] * n  # value: f[i] + b[i]
    queue: deque[int] = deque([0])
    pop, popleft, push = queue.pop, queue.popleft, queue.append
    for j in range(1, n):
        b = places[j]
        while b - places[queue[0]] > limit:
            popleft()
        i = queue[0]
        back[j] = i
        value[j] = v = value[i] + limit + costs[j]
        while queue and value[queue[-1]] >= v:
            pop()
        push(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(places[j])
        j = back[j]
    return cuts[::-1]


class _Stream:
    """Documents in, windows out: lists of (document number, start, length, crc32) by window."""

    def __init__(self, limit: int, chunk: int, sentence_penalty: int, hard_penalty: int, ends: np.ndarray) -> None:
        self.limit, self.chunk, self.ends = limit, chunk, ends
        self.penalty = np.array([0, sentence_penalty, hard_penalty])
        self.parts: list[tuple[int, int, np.ndarray]] = []  # document, start in it, its ids from there
        self.held = 0

    def add(self, doc: int, ids: np.ndarray) -> Iterator[list[tuple[int, int, int, int]]]:
        for a in range(0, len(ids), self.chunk):  # an overlong document comes in slices
            part = ids[a : a + self.chunk]
            self.parts.append((doc, a, part))
            self.held += len(part)
            if self.held >= self.chunk:
                yield from self.solve(last=False, ended=a + len(part) == len(ids))

    def solve(self, last: bool, ended: bool = True) -> Iterator[list[tuple[int, int, int, int]]]:
        if not self.held:
            return
        flat = np.concatenate([p for _, _, p in self.parts])
        sizes = np.array([len(p) for _, _, p in self.parts])
        stops = np.cumsum(sizes)
        docs = np.array([d for d, _, _ in self.parts])
        done = stops[np.append(docs[1:] != docs[:-1], ended)]
        at, kind = boundaries(done, np.flatnonzero(self.ends[flat]) + 1, len(flat), self.limit)
        cuts = best_cuts(at, self.penalty[kind], self.limit)
        if not last:
            cuts = cuts[:-1]
        lo, k, begin = 0, 0, stops - sizes
        for hi in cuts:
            window, x = [], lo
            while x < hi:
                while stops[k] <= x:
                    k += 1
                doc, start, part = self.parts[k]
                y, a = min(hi, int(stops[k])), int(begin[k])
                if window and window[-1][0] == doc:  # two slices of one document
                    d, s, n, crc = window[-1]
                    window[-1] = (d, s, n + y - x, zlib.crc32(part[x - a : y - a].tobytes(), crc))
                else:
                    window.append((doc, start + x - a, y - x, zlib.crc32(part[x - a : y - a].tobytes())))
                x = y
            yield window
            lo = hi
        kept = []
        for (doc, start, part), a, b in zip(self.parts, begin.tolist(), stops.tolist(), strict=True):
            if b > lo:
                cut = max(0, lo - a)
                kept.append((doc, start + cut, part[cut:]))
        self.parts, self.held = (kept, len(flat) - lo) if cuts or last else (self.parts, self.held)


def pack(
    docs: DataFrame, tokenizer: str, limit: int = 2048, end_id: int = 1, carry: tuple[str, ...] = ("doc_id",), text: str = "text",
    sentence_penalty: int = 16, hard_penalty: int = 256, chunk: int = 1 << 20,
) -> DataFrame:
    """One row for each piece: the ``carry`` columns of its document and the columns of ``PIECES``.

    Penalties are in padding ids: a sentence cut costs as much as ``sentence_penalty`` ids of padding.
    """
    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField(n, t) for n, t in PIECES])
    chunk = max(chunk, 4 * limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, ends = encoder(tokenizer).ids, sentence_ends(tokenizer)
        ends = np.append(ends, np.zeros(max(0, end_id + 1 - len(ends)), bool))
        stream = _Stream(limit, chunk, sentence_penalty, hard_penalty, ends)
        tail = np.array([end_id], "<u4")
        sequence = TaskContext.get().partitionId() << 33
        waiting: dict[int, tuple] = {}  # documents with pieces to come: carried values, ids in all
        rows: list[tuple] = []
        number = 0

        def out(windows: Iterator[list[tuple[int, int, int, int]]]) -> None:
            nonlocal sequence
            for window in windows:
                offset = 0
                for doc, start, length, crc in window:
                    values, total = waiting[doc]
                    rows.append((*values, start, length, crc, total, sequence, offset))
                    offset += length
                    if start + length == total:
                        del waiting[doc]
                sequence += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)

        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(len(carry))] + [pa.int64()] * len(PIECES)
            carried = [batch.column(i).to_pylist() for i in range(len(carry))]
            for i, value in enumerate(batch.column(len(carry))):
                ids = np.concatenate([np.frombuffer(ids_of(value.as_py() or ""), "<u4"), tail])
                waiting[number] = (tuple(c[i] for c in carried), len(ids))
                out(stream.add(number, ids))
                number += 1
            yield flush()
        if kinds:
            out(stream.solve(last=True))
            yield flush()

    return docs.select(*carry, docs[text].alias("_text")).mapInArrow(run, schema)
