"""N-gram Jaccard join by token-combination prefixes.

A document's set holds its distinct 5-word shingles, as 64-bit hashes. Documents of equal sets form one node, so
copies are joined once. Tokens are ordered by rising document frequency over all nodes. Two sets within the
threshold share at least ``o = ceil(t * |x|)`` tokens with either side ``x``; hence

* if the first ``|x| - o + 1`` tokens of ``x`` (its prefix) are all rare, the partner's prefix holds one of them;
* if the prefix reaches frequent tokens, it is extended by ``B`` tokens, and the two extended prefixes share a rare
  token or ``B + 1`` frequent ones, of which two fall into the same of ``B`` classes of tokens (by hash).

So rare tokens (in at most ``rare`` nodes) are indexed alone, and frequent ones as pairs within a class. ``B`` grows
with the smaller set's size (by powers of two), so the pairs of a set are in proportion to its size. Tokens of a single node
take their places in the prefix but are never indexed. Every node under a signature is verified against three
pivots there: the least and the largest node, and the one with the largest share of tokens that others have too. Nodes
of one component need no further comparison. What is left under a signature, pairs of different components, is compared
by parity bitmaps: two sets differ in at least as many tokens as their bitmaps do in bits, which bounds their overlap
from above, exactly. Only pairs that pass this bound are given out and verified: first one of a node and a component, and
of those that stay apart, all. Thus no link between components is lost, and the pairs that leave a task are near misses
and a few links, not all pairs of a group.

Tokens travel as packed arrays keyed by ranges of their hashes, not as rows: a stretch of rows ships each of its distinct
sets once, the reducer of a hash range finds frequencies, and only tokens of two or more nodes go back to a stretch.

Defined results: a null or wordless text has the empty set, linked with nothing; fewer than five words count as one
shingle; repeated rows share a node; the key may be of any type that can be ordered; a null key is carried along and never
is a component's id unless all are null; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm._spark import drop, materialize, shuffle_partitions
from quarry.llm._text import batch_word_hashes, groups, mix, ngram_hashes
from quarry.llm.components import components, salted_join

_U64 = np.uint64
#: Tokens that a map task gathers before it ships them; bounds its memory.
_FLUSH = 1_000_000


def shingle_sets(texts: list[bytes], n: int = 5) -> list[np.ndarray]:
    """The sorted distinct n-word shingle hashes of every text."""
    out = []
    for a, b in groups([len(t) for t in texts], 1 << 20):
        words, offsets = batch_word_hashes([t.lower() for t in texts[a:b]])
        out += [np.unique(ngram_hashes(words[offsets[i] : offsets[i + 1]], n)) for i in range(b - a)]
    return out


def node_of(tokens: np.ndarray) -> int:
    """A set's identity: a 64-bit hash of its tokens, 0 for the empty set."""
    if not len(tokens):
        return 0
    with np.errstate(over="ignore"):
        h = mix(tokens).sum(dtype=_U64) + mix(tokens ^ _U64(0x5851F42D4C957F2D))[0] + _U64(len(tokens))
    return int(mix(np.array([h]))[0].view(np.int64)) or 1


def needed(n: np.ndarray, t: Fraction) -> np.ndarray:
    """Least number of tokens that a set of n shares with any set within the threshold."""
    return -(-n * t.numerator // t.denominator)


_MAP = "slot int, kind int, key {key}, node long, n int, stretch long, nodes binary, sizes binary, owners binary, tokens binary"


def _postings(docs: DataFrame, key: str, text: str, n: int, slots: int) -> DataFrame:
    """kind 0: (key, node, n) of every row. kind 1: by slot and stretch of rows, the postings of a hash range, packed."""
    names = [c.split()[0] for c in _MAP.split(", ")]
    shift = _U64(64 - (slots - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, int] = {}
        sets: list[np.ndarray] = []
        held = turn = 0
        stretch = TaskContext.get().partitionId() << 33

        def ship() -> Iterator[pa.RecordBatch]:
            nonlocal held, stretch
            sizes = np.array([len(s) for s in sets], "<u4")
            tokens, owners = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype="<u4"), sizes)
            nodes = np.array([*known], "<i8")
            order = np.argsort(tokens, kind="stable")
            tokens, owners = tokens[order], owners[order]
            slot = (tokens >> shift).astype(np.int64)
            present = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
            rows = []
            for a, b in zip(present, np.append(present[1:], len(slot)), strict=True):
                used, local = np.unique(owners[a:b], return_inverse=True)
                rows.append((int(slot[a]), 1, None, None, None, stretch, nodes[used].tobytes(), sizes[used].tobytes(), local.astype("<u2" if len(used) <= 65536 else "<u4").tobytes(), tokens[a:b].tobytes()))
            known.clear()
            sets.clear()
            held = 0
            stretch += 1
            for a in range(0, len(rows), 64):
                yield _batch(rows[a : a + 64], names, kind)

        for batch in _slices(batches, 1000):
            rows, kind = [], batch.schema.field(0).type
            texts = [(x or "").encode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            for k, s in zip(batch.column(0).to_pylist(), shingle_sets(texts, n), strict=True):
                node = node_of(s)
                turn += 1
                rows.append((turn % slots, 0, k, node, len(s), None, None, None, None, None))
                if len(s) and node not in known:
                    known[node] = len(sets)
                    sets.append(s)
                    held += len(s)
                    if held >= _FLUSH:
                        yield from ship()
            yield _batch(rows, names, kind)
        if sets:
            yield from ship()

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, _typed(_MAP, docs.schema[key].dataType))


def _typed(schema: str, key: T.DataType) -> T.StructType:
    """The schema with the key's type, which may be any that can be ordered."""
    return T.StructType([T.StructField(f.name, key) if f.name == "key" else f for f in T.StructType.fromDDL(schema.format(key="long")).fields])


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows; what is made of one at a time is bounded by that."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def _batch(rows: list[tuple], names: list[str], key: pa.DataType) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), key, pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


_REDUCED = "kind int, key {key}, node long, n int, stretch long, nodes binary, sizes binary, owners binary, tokens binary, freqs binary"


def _frequencies(postings: DataFrame) -> DataFrame:
    """kind 0 as it comes; kind 1: the postings of tokens of two or more nodes, with frequencies, sent back by stretch.

    A set that several stretches have is sent back to the first of them alone, as every token of it is known in each.
    """
    names = [c.split()[0] for c in _REDUCED.split(", ")]

    def make(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
        kinds = [pa.int32(), key, pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def reduce(found: list[tuple], key: pa.DataType) -> Iterator[pa.RecordBatch]:
        found.sort(key=lambda x: x[0])
        nodes = [np.frombuffer(x[1], "<i8") for x in found]
        sizes = [np.frombuffer(x[2], "<u4") for x in found]
        owners = [np.frombuffer(x[3], "<u2" if len(m) <= 65536 else "<u4") for x, m in zip(found, nodes, strict=True)]
        tokens = np.frombuffer(b"".join(x[4] for x in found), "<u8")
        node = np.concatenate([m[o] for m, o in zip(nodes, owners, strict=True)])
        size = np.concatenate([m[o] for m, o in zip(sizes, owners, strict=True)])
        piece = np.repeat(np.arange(len(found), dtype=np.int32), [len(o) for o in owners])
        order = np.argsort(tokens, kind="stable")
        tokens = tokens[order]
        start = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else np.zeros(0, int)
        count = np.diff(np.append(start, len(tokens)))
        many = np.repeat(count > 1, count)
        tokens, order = tokens[many], order[many]
        node, size, piece = node[order], size[order], piece[order]
        order = np.lexsort((piece, node, tokens))  # one set may come from several stretches
        tokens, node, size, piece = tokens[order], node[order], size[order], piece[order]
        fresh = np.append(True, (tokens[1:] != tokens[:-1]) | (node[1:] != node[:-1]))[: len(tokens)]
        tokens, node, size, piece = tokens[fresh], node[fresh], size[fresh], piece[fresh]
        start = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else np.zeros(0, int)
        count = np.diff(np.append(start, len(tokens)))
        freq = np.repeat(count, count)
        keep = freq > 1
        tokens, node, size, piece, freq = tokens[keep], node[keep], size[keep], piece[keep], freq[keep]
        order = np.argsort(piece, kind="stable")
        edges = np.flatnonzero(np.diff(piece[order], prepend=-1, append=len(found)))
        rows = []
        for a, b in zip(edges, edges[1:], strict=False):
            at = order[a:b]
            used, first, local = np.unique(node[at], return_index=True, return_inverse=True)
            rows.append((1, None, None, None, found[piece[at[0]]][0], used.tobytes(), size[at][first].astype("<u4").tobytes(), local.astype("<u4").tobytes(), tokens[at].tobytes(), freq[at].astype("<u4").tobytes()))
        yield make(rows, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, found = None, []
        for batch in batches:
            plain, of = [], batch.schema.field(2).type
            for s, kind, key, node, n, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    plain.append((0, key, node, n, None, None, None, None, None, None))
                    continue
                if s != slot and found:
                    yield from reduce(found, of)
                    found = []
                slot = s
                found.append(packed)
            yield make(plain, of)
        if found:
            yield from reduce(found, of)

    dealt = postings.repartition(shuffle_partitions(postings.sparkSession), "slot").sortWithinPartitions("slot", "kind")
    return dealt.mapInArrow(run, _typed(_REDUCED, postings.schema["key"].dataType))


_INDEXED = "node long, n int, m int, bits binary, tokens binary, sigs array<long>"


def _classes(size_class: int) -> int:
    """Classes of frequent tokens for sets of the size class ``int.bit_length(n)``."""
    return max(1, (1 << size_class) // 64)


def _class_pairs(tokens: np.ndarray, classes: int, size_class: int) -> np.ndarray:
    """Signatures of all pairs of tokens of one class; the order of tokens is the same in every set."""
    of = (mix(tokens ^ _U64(0xA0761D6478BD642F)) % _U64(classes)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    tokens, of = tokens[order], of[order]
    out, lag = [np.zeros(0, _U64)], 1
    while lag < len(tokens) and (same := of[lag:] == of[:-lag]).any():
        out.append(mix(mix(tokens[:-lag][same] + _U64(size_class)) + _U64(3) * tokens[lag:][same]))
        lag += 1
    return np.concatenate(out)


def _signatures(reduced: DataFrame, t: Fraction, rare: int) -> DataFrame:
    """Nodes with signatures: their size, their tokens of two or more nodes in ascending order, their signatures."""

    def index(found: list[tuple]) -> pa.RecordBatch:
        owner = [np.frombuffer(x[2], "<u4") for x in found]
        node = np.concatenate([np.frombuffer(x[0], "<i8")[o] for x, o in zip(found, owner, strict=True)])
        size = np.concatenate([np.frombuffer(x[1], "<u4")[o] for x, o in zip(found, owner, strict=True)]).astype(np.int64)
        tokens = np.concatenate([np.frombuffer(x[3], "<u8") for x in found])
        freq = np.concatenate([np.frombuffer(x[4], "<u4") for x in found]).astype(np.int64)
        order = np.lexsort((tokens, freq, node))
        node, size, tokens, freq = node[order], size[order], tokens[order], freq[order]
        starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        stops = np.append(starts[1:], len(node))
        n, m = size[starts], stops - starts
        prefix = n - needed(n, t) + 1 - (n - m)  # of it, behind the tokens of this node alone
        out = []
        for i in np.flatnonzero((prefix > 0) & (needed(n, t) <= m)):
            a, p = starts[i], int(prefix[i])
            own, f = tokens[a : stops[i]], freq[a : stops[i]]
            if f[min(p, len(f)) - 1] <= rare:
                sigs = own[:p]
            else:
                split = int(np.searchsorted(f, rare, "right"))
                top, low = int(n[i]).bit_length(), int(needed(n[i], t)).bit_length()  # size classes of this set and of its least partner
                sigs = [own[: min(split, p + _classes(top))]]
                sigs += [_class_pairs(own[split : p + _classes(c)], _classes(c), c) for c in range(low, top + 1)]
                sigs = np.concatenate(sigs)
            out.append((int(node[a]), int(n[i]), len(own), _bitmap(own), np.sort(own).tobytes(), np.unique(sigs).view(np.int64)))
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["node", "n", "m", "bits", "tokens", "sigs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, found = None, []
        for batch in batches:
            for x, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if x != stretch and found:
                    yield index(found)
                    found = []
                stretch = x
                found.append(packed)
        if found:
            yield index(found)

    rows = reduced.filter("kind = 1").select("stretch", "nodes", "sizes", "owners", "tokens", "freqs")
    return rows.repartition(shuffle_partitions(reduced.sparkSession), "stretch").sortWithinPartitions("stretch").mapInArrow(run, _INDEXED)


def _bitmap(tokens: np.ndarray) -> bytes:
    """Parity of the tokens' counts by hash place; a power of two of places, about eight a token."""
    width = min(8192, max(256, 1 << (8 * len(tokens) - 1).bit_length()))
    place = (mix(tokens ^ _U64(0xE7037ED1A0B428DB)) % _U64(width)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def _survivors(n: np.ndarray, m: np.ndarray, root: np.ndarray, main: int, bits: list[bytes], t: Fraction, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places, of different roots and one not in ``main``, whose bitmaps allow the threshold.

    ``most``: of a place and a root, only so many, those that the bitmaps allow the largest overlap.
    """
    width = min(map(len, bits))
    folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(b, np.uint8).reshape(-1, width), 0) for b in bits]).view(_U64)
    open_ = np.flatnonzero(root != main)
    step = max(1, (4 << 20) // len(n))
    for a in range(0, len(open_), step):
        x = open_[a : a + step]
        differ = np.zeros((len(x), len(n)), np.uint16)
        for w in range(folded.shape[1]):
            differ += np.bitwise_count(folded[x, w][:, None] ^ folded[:, w][None, :])
        bound = (m[x][:, None] + m[None, :] - differ.astype(np.int64)) // 2
        ok = bound * (t.numerator + t.denominator) >= t.numerator * (n[x][:, None] + n[None, :])
        i, j = np.nonzero(ok & (root[x][:, None] != root[None, :]))
        if most and len(i):
            order = np.lexsort((-bound[i, j] / (n[x[i]] + n[j]), root[j], i))
            i, j = i[order], j[order]
            first = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (root[j[1:]] != root[j[:-1]])))
            turn = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
            i, j = i[turn < most], j[turn < most]
        yield x[i], j


_OPEN = ("sig", "node", "n", "m", "root", "main", "bits")


def _near_pairs(rows: DataFrame, t: Fraction, most: int | None = None) -> DataFrame:
    """(a, b) that may be linked, each once a task, from rows of ``_OPEN``; ``most`` as in ``_survivors``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def close(group: list[tuple]) -> None:
            nonlocal size
            node, n, m, root, main, bits = zip(*group, strict=True)
            ids = np.array(node, np.int64)
            for x, y in _survivors(np.array(n, np.int64), np.array(m, np.int64), np.array(root, np.int64), main[0], list(bits), t, most):
                pairs = np.unique(np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])], 1), axis=0)
                held.append(pairs)
                size += len(pairs)

        def ship() -> pa.RecordBatch:
            nonlocal size
            pairs = np.unique(np.concatenate(held), axis=0) if held else np.zeros((0, 2), np.int64)
            held.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        sig, group = None, []
        for batch in batches:
            for s, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != sig and group:
                    close(group)
                    group = []
                    if size > 1_000_000:
                        yield ship()
                sig = s
                group.append(tuple(row))
        if group:
            close(group)
        yield ship()

    dealt = rows.select(*_OPEN).repartition(shuffle_partitions(rows.sparkSession), "sig").sortWithinPartitions("sig")
    return dealt.mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b) whose sets are within the threshold; exact on the token hashes."""
    a = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 500):
            x, y, nx, ny, tx, ty = (c.to_pylist() for c in batch.columns)
            keep = []
            for i in range(len(x)):
                p, q = np.frombuffer(tx[i], "<u8"), np.frombuffer(ty[i], "<u8")
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                shared = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                keep.append(shared * t.denominator >= t.numerator * (nx[i] + ny[i] - shared))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "ta", "tb")
    return joined.mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, threshold: str = "3/4", rare: int = 256) -> DataFrame:
    """(key, n_shingles, component_id) of every row."""
    t, spark = Fraction(threshold), docs.sparkSession
    slots = 1 << max(6, (shuffle_partitions(spark) - 1).bit_length())  # a range a task; more would repeat the lists of nodes
    first, scratch = [], []
    reduced = materialize(_frequencies(_postings(docs, key, text, n, slots)), first)
    rows = materialize(reduced.filter("kind = 0").select("key", "node", F.col("n").cast("long").alias("n_shingles")), scratch)
    indexed = materialize(_signatures(reduced, t, rare), scratch)
    drop(spark, first)
    sets = indexed.select("node", "n", "tokens")
    sigs = indexed.select("node", (F.col("m") / F.col("n")).alias("share"), F.explode("sigs").alias("sig"))
    ends = sigs.groupBy("sig").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.max_by("node", F.struct("share", "node")).alias("best")).filter("low < high")
    met = materialize(sigs.join(ends, "sig"), scratch)
    star = met.select("node", F.explode(F.array("low", "high", "best")).alias("other")).filter("node <> other")
    pairs = star.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    links = materialize(_verify(pairs, sets, t), scratch)
    roots = materialize(components(links, scratch), scratch)
    # what is left: under a signature, pairs of different components; the commonest component there is only compared with
    # others. One link joins two components, so first the likeliest pair of a node and a component is tried, then, of
    # what is still apart, every pair
    for tries in (1, None):
        own = met.select("sig", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        of_sig = W.partitionBy("sig")  # all windows read one shuffle
        apart = own.withColumn("least", F.min("root").over(of_sig)).withColumn("most", F.max("root").over(of_sig)).filter("least <> most")
        apart = apart.withColumn("c", F.count(F.lit(1)).over(W.partitionBy("sig", "root"))).withColumn("main", F.max_by("root", F.struct("c", "root")).over(of_sig))
        apart = apart.select("sig", "node", "root", "main")
        if tries:  # a signature of one component stays one
            apart = met = materialize(apart, scratch)
        open_ = apart.join(indexed.select("node", "n", "m", "bits"), "node")
        more = materialize(_verify(_near_pairs(open_, t, tries).distinct(), sets, t), scratch)
        if not more.isEmpty():
            links = links.unionByName(more)
            roots = materialize(components(links, scratch), scratch)
    final = roots
    # least key of a node, then of a component, back to rows
    least = materialize(rows.groupBy("node").agg(F.min("key").alias("least")).join(final, "node", "left").withColumn("root", F.coalesce("root", "node")), scratch)
    named = materialize(salted_join(least, least.groupBy("root").agg(F.min("least").alias("component_id")), "root", "node").filter("node <> 0").select("node", "component_id"), scratch)
    linked = rows.filter("n_shingles > 0").join(named, "node").select(F.col("key").alias(key), "n_shingles", "component_id")
    result = materialize(linked.unionByName(rows.filter("n_shingles = 0").select(F.col("key").alias(key), "n_shingles", F.col("key").alias("component_id"))))
    drop(spark, scratch)
    return result
