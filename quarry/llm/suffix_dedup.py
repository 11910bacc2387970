"""Suffix-array dedup: remove every byte covered by a long string that also starts somewhere else.

Two strings of ``length`` bytes (windows) are equal only if their anchors are: the least hash among the window's
``ANCHOR``-byte substrings, leftmost of equals. So each text falls into segments, runs of windows with one anchor
occurrence, and equal windows lie in segments of equal anchor hash. Segments that occur twice as a whole are all
repeats; of the others, those whose anchor hash has different segments are brought together, by anchor hash, each
different content once (so a passage in a third of all rows travels once a task), and their suffix array tells
which windows repeat:

1. two-stage sorting: only suffixes smaller than their successors are sorted directly (by 8 bytes at a time, to the
   depth of ``length``); all others are induced by one scan over the buckets of first bytes, as a suffix larger than
   its successor follows from the place of its successor;
2. common prefixes of adjacent suffixes: a window repeats if the prefix reaches ``length`` on either side.

Matches never cross texts or segments. Anchor groups above ``_LARGE`` bytes are split before their shuffle, exactly, by
the place of the anchor in the window and the bytes that all windows of such places share. A segment that a task meets
twice is told of on the spot and travels once, so a passage in a third of all rows does not meet in one task.

Defined results: a null text is empty; texts shorter than ``length`` keep all; rows are told apart by their place in the
input files, so keys may repeat or be null, and repeated rows repeat each other and lose every covered byte; strings are
judged on the input; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm._spark import drop, files, materialize, numbered, shuffle_partitions
from quarry.llm._text import _BYTE, mix

_U64 = np.uint64
ANCHOR = 24
_BASE = _U64(0xD6E8FEB86659FD93)
_INVERSE = _U64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
#: Windows of a text handled at once, segments held before they are shipped, bytes of one suffix array, of a large group.
_SLICE, _FLUSH, _SORT, _LARGE = 1 << 20, 150_000, 3 << 20, 8 << 20
_SEPARATOR = 0xFF


def _powers(n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    if len(cache.get("up", ())) <= n:
        size = max(2 * n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size + 1, base, _U64)
            table[0] = 1
            cache[name] = np.cumprod(table)
    return cache["up"], cache["down"]


class Hashes:
    """Hashes of the substrings of a byte array, from prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _powers(len(data))
        self.sums = np.zeros(len(data) + 1, _U64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(_U64))


def segments(data: np.ndarray, edges: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of texts side by side in ``data``: text number, first window, windows, anchor place, anchor hash, content hash."""
    n = len(data) - length + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty, empty, empty.astype(_U64), empty.astype(_U64)
    hashes, at = Hashes(data), np.arange(len(data) - ANCHOR + 1)
    grams = hashes.of(at, at + ANCHOR)
    low = _U64((1 << 22) - 1)
    least, width, span = (grams & ~low) | at.astype(_U64), 1, length - ANCHOR + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[span - width : span - width + n])
    anchor = (least & low).astype(np.int64)
    text = np.searchsorted(edges, np.arange(n), "right") - 1
    inside = np.arange(n) + length <= edges[text + 1]
    first = np.flatnonzero(inside & np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]))
    stop = np.append(first[1:], n)
    last = np.minimum(stop, edges[text[first] + 1] - length + 1) if len(first) else first
    return text[first], first, last - first, anchor[first], grams[anchor[first]], hashes.of(first, last + length - 1)


_MAP = "slot int, docs binary, anchors binary, contents binary, owners binary, starts binary, counts binary, offsets binary"
#: A row's place in the input as one number: the file's place among all files, and the row's in it.
_ROW = 40


def _postings(rows: DataFrame, files: np.ndarray, length: int, slots: int) -> DataFrame:
    """By slot, a range of anchor hashes, its segments, packed. Without anchors: segments that the stretch of rows which
    was shipped together has twice; of these only one goes on as a posting, twice, so that a frequent one stays small."""
    names = [c.split()[0] for c in _MAP.split(", ")]
    shift = _U64(64 - (slots - 1).bit_length())
    kinds = [pa.int32(), *[pa.binary()] * 7]
    known = rows.sparkSession.sparkContext.broadcast(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total = turn = 0

        def ship() -> Iterator[pa.RecordBatch]:
            nonlocal turn
            doc, start, count, offset, anchor, content = (np.concatenate([h[i] for h in held]) for i in range(6))
            held.clear()
            order = np.lexsort((content, anchor))
            doc, start, count, offset, anchor, content = (x[order] for x in (doc, start, count, offset, anchor, content))
            new = np.append(True, (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1]))
            first = np.flatnonzero(new)
            sizes = np.diff(np.append(first, len(doc)))
            out = []
            if (sizes > 1).any():
                at = np.flatnonzero(np.repeat(sizes, sizes) > 1)
                docs, local = np.unique(doc[at], return_inverse=True)
                turn += 1
                out.append((turn % slots, docs.tobytes(), None, None, local.astype("<u4").tobytes(), start[at].astype("<u8").tobytes(), count[at].astype("<u2").tobytes(), None))
            keep = np.repeat(first, np.minimum(sizes, 2))  # one of them, counted as two
            doc, start, count, offset, anchor, content = (x[keep] for x in (doc, start, count, offset, anchor, content))
            slot = (anchor >> shift).astype(np.int64)  # ascending, as anchors are
            present = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
            for a, b in zip(present, np.append(present[1:], len(slot)), strict=True):
                docs, local = np.unique(doc[a:b], return_inverse=True)
                out.append((int(slot[a]), docs.tobytes(), anchor[a:b].tobytes(), content[a:b].tobytes(), local.astype("<u4").tobytes(), start[a:b].astype("<u8").tobytes(), count[a:b].astype("<u2").tobytes(), offset[a:b].astype("<u2").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            waiting: list[tuple[int, int, bytes]] = []
            size = 0

            def solve() -> None:
                nonlocal total
                if not waiting:
                    return
                edges = np.cumsum([0, *(len(w[2]) for w in waiting)])
                text, first, count, anchor, a, c = segments(np.frombuffer(b"".join(w[2] for w in waiting), np.uint8), edges, length)
                keys, base = np.array([w[0] for w in waiting], np.int64), np.array([w[1] for w in waiting], np.int64)
                held.append((keys[text], first - edges[text] + base[text], count, anchor - first, a, c))
                total += len(text)
                waiting.clear()

            keys = (np.searchsorted(known.value, batch.column(0).to_numpy()) << _ROW) + batch.column(1).to_numpy()
            for key, value in zip(keys.tolist(), batch.column(2), strict=True):
                data = (value.as_py() or "").encode("utf-8", "replace")
                for a in range(0, len(data) - length + 1, _SLICE):
                    waiting.append((key, a, data[a : a + _SLICE + length - 1]))
                    size += len(waiting[-1][2])
                    if size >= _SLICE:
                        solve()
                        size = 0
                if total >= _FLUSH:
                    yield from ship()
                    total = 0
            solve()
        if total:
            yield from ship()

    return rows.mapInArrow(run, _MAP)


_FOUND = "kind int, file long, index long, start long, count int, anchor long, offset int"


def _candidates(postings: DataFrame, files: np.ndarray) -> DataFrame:
    """kind 0: a segment whose windows all repeat. Of anchors with different segments, one occurrence of each: kind 1
    where it is the only one, kind 2 where there are more (which is then of kind 0 as well)."""
    names = [c.split()[0] for c in _FOUND.split(", ")]
    known = postings.sparkSession.sparkContext.broadcast(files)

    def out(kind: int, doc: np.ndarray, start: np.ndarray, count: np.ndarray, anchor: np.ndarray, offset: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(doc), 100_000):
            d = doc[a : a + 100_000]
            columns = [np.full(len(d), kind, np.int32), known.value[d >> _ROW], d & ((1 << _ROW) - 1), start[a : a + 100_000].astype(np.int64), count[a : a + 100_000].astype(np.int32), anchor[a : a + 100_000].view(np.int64), offset[a : a + 100_000].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    def reduce(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        pick = lambda i, kind: np.concatenate([np.frombuffer(x[i], kind) for x in found])
        doc = np.concatenate([np.frombuffer(x[0], "<i8")[np.frombuffer(x[3], "<u4")] for x in found])
        anchor, content, start, count, offset = pick(1, "<u8"), pick(2, "<u8"), pick(4, "<u8"), pick(5, "<u2"), pick(6, "<u2")
        order = np.lexsort((start, doc, content, anchor))
        doc, anchor, content, start, count, offset = (x[order] for x in (doc, anchor, content, start, count, offset))
        new_a = np.append(True, anchor[1:] != anchor[:-1])
        new_c = new_a | np.append(True, content[1:] != content[:-1])
        sizes = np.diff(np.append(np.flatnonzero(new_c), len(doc)))
        same = np.repeat(sizes, sizes) > 1
        distinct = np.bincount(np.cumsum(new_a) - 1, weights=new_c).astype(int)[np.cumsum(new_a) - 1] > 1
        twice = np.append(False, (doc[1:] == doc[:-1]) & (start[1:] == start[:-1]) & ~new_c[1:])  # one that stands for two: its stretch has told of it
        told = twice | np.append(twice[1:], False)
        for kind, keep in ((0, same & ~told), (1, distinct & new_c & ~same), (2, distinct & new_c & same)):
            at = np.flatnonzero(keep)
            yield from out(kind, doc[at], start[at], count[at], anchor[at], offset[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, found = None, []
        for batch in batches:
            for s, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if packed[1] is None:
                    doc = np.frombuffer(packed[0], "<i8")[np.frombuffer(packed[3], "<u4")]
                    none = np.zeros(len(doc), _U64)
                    yield from out(0, doc, np.frombuffer(packed[4], "<u8"), np.frombuffer(packed[5], "<u2"), none, none)
                    continue
                if s != slot and found:
                    yield from reduce(found)
                    found = []
                slot = s
                found.append(packed)
        if found:
            yield from reduce(found)

    dealt = postings.repartition(shuffle_partitions(postings.sparkSession), "slot").sortWithinPartitions("slot")
    return dealt.mapInArrow(run, _FOUND)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of a byte array, which ends with its largest byte, in the order of their first ``depth`` bytes."""
    n = len(text)
    change = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    run_end = np.repeat(change, np.diff(np.append(-1, change)))
    small = np.zeros(n, bool)  # smaller than the suffix that follows
    inner = run_end < n - 1
    small[inner] = text[run_end[inner]] < text[run_end[inner] + 1]
    # stage one: sort these directly, 8 bytes at a time
    keys = np.lib.stride_tricks.sliding_window_view(np.append(text, np.zeros(depth + 8, np.uint8)), 8).copy().view(">u8").ravel().astype(_U64)
    at = np.flatnonzero(small)
    at = at[np.argsort(keys[at], kind="stable")]
    group = np.cumsum(np.append(True, keys[at][1:] != keys[at][:-1])) if len(at) else at
    live = np.arange(len(at))
    for d in range(8, depth, 8):
        g = group[live]
        tied = np.append(False, g[1:] == g[:-1])
        tied |= np.append(tied[1:], False)
        live = live[tied]
        if not len(live):
            break
        g, k = group[live], keys[np.minimum(at[live] + d, n)]
        order = np.lexsort((k, g))
        at[live] = at[live][order]
        k = k[order]
        new = np.append(True, (g[1:] != g[:-1]) | (k[1:] != k[:-1]))
        step = np.zeros(len(at) + 1, np.int64)
        step[live[new & np.append(False, g[1:] == g[:-1])]] = 1
        group = group + np.cumsum(step)[:-1]
    direct = np.searchsorted(text[at], np.arange(257)) if len(at) else np.zeros(257, int)
    # stage two: scan the buckets in order; a place whose predecessor is not smaller puts that predecessor in its bucket
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[int(text[-1])].append(np.array([n - 1]))
    out = []
    for c in range(256):
        wave, scanned = waiting[c], []
        while wave:
            now = np.concatenate(wave)
            scanned.append(now)
            before = now[now > 0] - 1
            wave = [before[text[before] == c]]
            wave = wave if len(wave[0]) else []
        scanned.append(at[direct[c] : direct[c + 1]])
        place = np.concatenate(scanned)
        out.append(place)
        before = place[place > 0] - 1
        first = text[before]
        before, first = before[first > c], first[first > c]
        order = np.argsort(first, kind="stable")
        edges = np.searchsorted(first[order], np.arange(257))
        for b in np.unique(first).tolist():
            waiting[b].append(before[order[edges[b] : edges[b + 1]]])
    return np.concatenate(out)


def repeats(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """By piece, which of its windows start elsewhere too, within these pieces."""
    text = np.frombuffer(bytes([_SEPARATOR]).join(pieces) + bytes([_SEPARATOR]), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes + 1) - 1
    place = suffix_array(text, length)
    room = ends[np.searchsorted(ends, place)] - place  # bytes to the end of the piece
    a, b = place[:-1], place[1:]
    live = np.flatnonzero((room[:-1] >= length) & (room[1:] >= length))
    keys = np.lib.stride_tricks.sliding_window_view(np.append(text, np.zeros(8, np.uint8)), 8).copy().view(">u8").ravel()
    for d in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:  # common prefixes of neighbours
        live = live[keys[a[live] + d] == keys[b[live] + d]]
    twice = np.zeros(len(text), bool)
    twice[a[live]] = twice[b[live]] = True
    return [twice[e - s : e - length + 1] if s >= length else np.zeros(0, bool) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


_PIECE = "anchor long, wanted boolean, file long, index long, start long, offset int, piece binary"


def _extract(joined: DataFrame, length: int) -> DataFrame:
    """From (file, index, text, wanted: array of (kind, start, count, anchor, offset, large)): the bytes of every segment."""
    names = [c.split()[0] for c in _PIECE.split(", ")]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def ship() -> pa.RecordBatch:
            nonlocal size
            size = 0
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for file, index, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                data = text.as_py().encode("utf-8", "replace")
                for w in wanted.as_py():
                    piece = data[w["start"] : w["start"] + w["count"] + length - 1]
                    parts = _split(w["anchor"], w["offset"], piece, length) if w["large"] else [(w["anchor"], 0, w["offset"], piece)]
                    for group, skip, offset, part in parts:
                        rows.append((group, w["kind"] == 1, file, index, w["start"] + skip, offset, part))
                        size += len(part)
                    if size >= _SORT:
                        yield ship()
            yield ship()

    return joined.mapInArrow(run, _PIECE)


def _split(anchor: int, offset: int, piece: bytes, length: int, step: int = 44) -> list[tuple[int, int, int, bytes]]:
    """A piece as shorter ones (group, windows skipped, offset, bytes); equal windows of all pieces of an anchor stay in one group."""
    out, windows = [], len(piece) - length + 1
    # window i has the anchor at offset - i; places of one step share the bytes from the step's last window to its first's end
    for j in range(max(0, offset - windows + 1) // step, offset // step + 1):
        first, last = max(0, offset - (j + 1) * step + 1), min(windows - 1, offset - j * step)
        if first <= last:
            core = piece[max(0, offset - j * step) : offset - (j + 1) * step + 1 + length]
            group = hashlib.blake2b(core, digest_size=8, key=anchor.to_bytes(8, "little", signed=True), salt=j.to_bytes(2, "little")).digest()
            out.append((int.from_bytes(group, "little", signed=True), first, offset - first, piece[first : last + length]))
    return out


_RANGES = "file long, index long, start long, count long"


def _sorted_repeats(pieces: DataFrame, length: int) -> DataFrame:
    """Ranges of repeated windows of the wanted pieces, by suffix arrays over whole anchor groups."""

    def solve(batch: list[tuple]) -> pa.RecordBatch:
        rows = []
        for (wanted, file, index, start, _, _), twice in zip(batch, repeats([b[5] for b in batch], length), strict=True):
            if wanted and twice.any():
                edge = np.flatnonzero(np.diff(twice.view(np.int8), prepend=0, append=0))
                rows += [(file, index, start + int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["file", "index", "start", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, group, ready, size = None, [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal ready, size
            if any(p[0] for p in group):
                ready += group
                size += sum(len(p[5]) for p in group)
            if size >= _SORT:
                yield solve(ready)
                ready, size = [], 0

        for batch in batches:
            for a, *piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if a != anchor and group:
                    yield from close()
                    group = []
                anchor = a
                group.append(tuple(piece))
        if group:
            yield from close()
        if ready:
            yield solve(ready)

    dealt = pieces.repartition(shuffle_partitions(pieces.sparkSession), "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, _RANGES)


def _kept(data: bytes, spans: list[dict], length: int) -> tuple[int, int, list[bytes]]:
    """Bytes and runs that the spans (start, count of windows) cover, and what is left."""
    removed = runs = at = 0
    left = []
    for start, end in sorted((s["start"], s["start"] + s["count"] + length - 1) for s in spans):
        if start > at or not runs:
            left.append(data[at:start])
            runs += 1
            at = start
        removed += max(0, end - at)
        at = max(at, end)
    return removed, runs, [*left, data[at:]]


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, with_text: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row, with ``with_text`` also ``kept`` (bytes)."""
    if length < 2 * ANCHOR:
        raise ValueError(f"length must be {2 * ANCHOR} or more")
    spark = docs.sparkSession
    rows = numbered(docs, F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known, place, scratch = files(rows), ["file", "index"], []
    slots = 1 << max(6, (8 * shuffle_partitions(spark) - 1).bit_length())
    found = materialize(_candidates(_postings(rows.select(*place, "text"), known, length, slots), known), scratch)
    wanted = found.filter("kind > 0")
    large = wanted.groupBy("anchor").agg(F.sum(F.col("count") + length).alias("bytes")).filter(F.col("bytes") > _LARGE).select("anchor", F.lit(True).alias("large"))
    wanted = wanted.join(large, "anchor", "left") if not large.isEmpty() else wanted.withColumn("large", F.lit(False))
    wanted = wanted.groupBy(*place).agg(F.collect_list(F.struct("kind", "start", "count", "anchor", "offset", F.coalesce("large", F.lit(False)).alias("large"))).alias("wanted"))
    pieces = _extract(rows.select(*place, "text").join(wanted, place).select(*place, "text", "wanted"), length)
    ranges = materialize(_sorted_repeats(pieces, length).unionByName(found.filter("kind = 0").select(*place, "start", F.col("count").cast("long").alias("count"))))
    drop(spark, scratch)
    cover = ranges.groupBy(*place).agg(F.collect_list(F.struct("start", "count")).alias("cover"))
    schema = T.StructType(
        [T.StructField("key", docs.schema[key].dataType), *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())]
        + [T.StructField("kept", T.BinaryType())] * with_text
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, spans in zip(batch.column(1), batch.column(2), strict=True):
                data = value.as_py().encode("utf-8", "replace")
                removed, runs, left = _kept(data, spans.as_py() or [], length)
                kept = b"".join(left)
                out.append((len(data), removed, runs, hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if with_text else [])]
            arrays = [batch.column(0)] + [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.join(cover, place, "left").select("key", "text", "cover").mapInArrow(cut, schema).withColumnRenamed("key", key)
