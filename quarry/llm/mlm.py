"""LM scoring by masked pseudo-likelihood.

Tokens are lower-cased words, and the vocabulary has every word of the corpus. The network predicts codes: one for
each of the ``KNOWN`` most frequent words (counted in distribution; only these come to the driver) and ``SHARED`` hash
classes for all others. A word of a class has its share of the class's tokens as conditional probability,
``P(word | both sides) = P(class | both sides) * n(word) / n(class)``, so probabilities sum to 1 over the vocabulary.
The counts of these words stay distributed: their hashes go to buckets of bounded size, which count them and send
sums back, packed by the stretch of rows that sent them. A code is a pair of digits, so a prediction needs two small
softmaxes. The network sees ``SIDE`` tokens on either side of a position, never the position itself: one embedding
table an offset, summed, ``tanh``, then the first digit from the hidden units, and the second from them and the first
digit.

Texts are tokenised twice, to count words and to write codes (two bytes a token); all else reads these. Training is
masked prediction in numpy over all documents and all positions: a round masks one ``stride``-th of each document's
positions, pseudo-randomly split among as many rounds as the stride, so that every token is predicted once. A task
trains on its rows from the round's parameters and sends them back weighted by its masked tokens; a tree of sums
averages them (at most ``_SALTS`` sums reach the driver, of a fixed size). ``train`` reports the loss of each round.
Scoring then sums the conditional log-probability of every token given both sides.

Defined results: a text without words (or null) has no tokens and scores 0; repeated rows score alike; rows of one key
or of none are scored one by one; an empty table gives an empty result; other columns do not matter. Reruns over the
same files agree up to float summation order.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm._spark import drop, materialize, shuffle_partitions
from quarry.llm._text import batch_word_hashes

DIGIT, SHARED, SIDE, WIDTH = 64, 256, 2, 16
KNOWN = DIGIT * DIGIT - SHARED
_PAD = KNOWN + SHARED
_OFFSETS = [o for o in range(-SIDE, SIDE + 1) if o]
_SALTS = 8
#: Of a stretch of rows: rare tokens, rows. Tokens of a bucket, about.
_FLUSH, _ROWS, _BUCKET = 200_000, 20_000, 2_000_000
_UNIT = 2.0**32  # logarithms of counts are added as integers, so that their order does not matter
SHAPES = {"embed": (2 * SIDE, _PAD + 1, WIDTH), "hidden": (WIDTH,), "first": (WIDTH, DIGIT), "first_bias": (DIGIT,), "second": (WIDTH, DIGIT), "second_bias": (DIGIT, DIGIT)}


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def _words_of(value: pa.Scalar) -> list[bytes]:
    """The same of a text as it lies in a batch."""
    data = value.as_buffer()
    return [] if data is None else data.to_pybytes().lower().split()


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of every word; counts are exact and cover all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def ship() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for value in batch.column(0):
                counts.update(_words_of(value))
                if len(counts) >= _FLUSH:
                    yield ship()
        yield ship()

    return docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _most_frequent(counted: DataFrame, n: int = KNOWN) -> dict[bytes, int]:
    return {bytes(r["word"]): r["n"] for r in counted.orderBy(F.desc("n"), "word").limit(n).collect()}


def frequent_words(docs: DataFrame, text: str = "text", n: int = KNOWN) -> list[bytes]:
    """The n most frequent words, ties by bytes."""
    return list(_most_frequent(word_counts(docs, text), n))


def _class_sizes(counted: DataFrame, known: dict[bytes, int]) -> np.ndarray:
    """By class, the tokens of all words that are not known."""
    sizes = np.zeros(SHARED, np.int64)
    for r in counted.groupBy((F.crc32("word") % SHARED).alias("c")).agg(F.sum("n").alias("n")).collect():
        sizes[r["c"]] = r["n"]
    for word, n in known.items():
        sizes[zlib.crc32(word) % SHARED] -= n
    return sizes


def _coder(known: list[bytes]):
    table = {w: i for i, w in enumerate(known)}

    def code(text: str | None) -> np.ndarray:
        return code.parts(_words(text))[0]

    def parts(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Codes, and places and words of those that share their codes."""
        ids = np.fromiter(map(table.get, words, repeat(KNOWN)), np.uint16, len(words))
        at = np.flatnonzero(ids == KNOWN)
        rare = [words[j] for j in at.tolist()]
        ids[at] += (np.fromiter(map(zlib.crc32, rare), np.uint32, len(rare)) % SHARED).astype(np.uint16)
        return ids, at, rare

    code.parts = parts
    return code


def start_parameters(used: np.ndarray | None = None, seed: int = 7) -> dict[str, np.ndarray]:
    """Random tables and zero biases; codes that no word has (not ``used``) are shut out by their biases."""
    rng = np.random.default_rng(seed)
    p = {k: rng.normal(0, 0.1, s).astype(np.float32) if "bias" not in k and k != "hidden" else np.zeros(s, np.float32) for k, s in SHAPES.items()}
    if used is not None:
        table = used.reshape(DIGIT, DIGIT)
        p["first_bias"][~table.any(1)] = p["second_bias"][~table] = -1e9
    return p


def contexts(texts: list[np.ndarray], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids at ``_OFFSETS`` of every position of the texts, outside of a text the padding id, and its own id; ``keep``: of these positions."""
    edge = np.full(SIDE, _PAD, np.uint16)
    wide = np.concatenate([edge, *(x for t in texts for x in (t, edge))])
    at = np.flatnonzero(wide != _PAD)
    at = at if keep is None else at[keep]
    return np.stack([wide[at + o] for o in _OFFSETS]), wide[at]


_ONES = np.ones(2 * DIGIT, np.float32)


def _room(n: int) -> np.ndarray:
    """Scratch of ``_forward`` for n positions; kept from batch to batch, since fresh pages cost more than the sums in them."""
    return np.empty((2, n, 2 * DIGIT), np.float32)


def _forward(p: dict[str, np.ndarray], near: np.ndarray, first: np.ndarray, second: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hidden units, exponentials of the logits of both digits side by side (in ``room``), their two sums, where the right
    digits are among them (flat), and ln P of these.

    A logit above 60 counts as 60, which keeps the sums finite in place of a subtracted maximum.
    """
    n = len(first)
    logits, biases = room[:, :n]
    h = np.take(p["embed"][0], near[0], axis=0)
    for i in range(1, 2 * SIDE):
        h += np.take(p["embed"][i], near[i], axis=0)
    h += p["hidden"]
    np.tanh(h, out=h)
    np.matmul(h, np.concatenate([p["first"], p["second"]], 1), out=logits)
    table = np.concatenate([np.broadcast_to(p["first_bias"], (DIGIT, DIGIT)), p["second_bias"]], 1)
    logits += np.take(table, first, axis=0, out=biases, mode="clip")  # with another mode numpy copies ``out``
    if n and logits.max() > 60:
        np.minimum(logits, np.float32(60), out=logits)
    right = np.arange(0, 2 * DIGIT * n, 2 * DIGIT) + np.stack([first, second + np.uint16(DIGIT)])
    log = logits.reshape(-1)[right].sum(0)
    np.exp(logits, out=logits)
    total = (logits.reshape(-1, DIGIT) @ _ONES[:DIGIT]).reshape(-1, 2)
    return h, logits, total, right, log - np.log(total) @ _ONES[:2]


def log_probability(p: dict[str, np.ndarray], ids: np.ndarray) -> float:
    """Sum over all positions of ln P(code | both sides)."""
    return float(log_probabilities(p, [ids])[0])


def log_probabilities(p: dict[str, np.ndarray], texts: list[np.ndarray], step: int = 8192) -> np.ndarray:
    """The same for many texts at once."""
    sizes = [len(t) for t in texts]
    if not sum(sizes):
        return np.zeros(len(texts))
    near, ids = contexts(texts)
    each, room = np.empty(len(ids)), _room(min(step, len(ids)))
    for s in range(0, len(ids), step):
        part = ids[s : s + step]
        each[s : s + step] = _forward(p, near[:, s : s + step], part // DIGIT, part % DIGIT, room)[4]
    owner = np.repeat(np.arange(len(texts)), sizes)
    return np.bincount(owner, each, len(texts))


class _Trainer:
    """Adagrad on minibatches of masked positions."""

    def __init__(self, p: dict[str, np.ndarray], rate: float) -> None:
        self.p, self.rate, self.loss = {k: v.copy() for k, v in p.items()}, rate, 0.0
        self.seen = {k: np.full(v.shape, 1e-2, np.float32) for k, v in p.items()}
        self.room = _room(0)
        self.places = np.arange((_PAD + 1) * WIDTH).reshape(-1, WIDTH)  # of a table's entries when it lies flat

    def step(self, near: np.ndarray, ids: np.ndarray) -> None:
        p, n = self.p, len(ids)
        if n > self.room.shape[1]:
            self.room = _room(n)
        order = np.argsort(ids, kind="stable")  # by first digit, then by second
        near, ids = np.take(near, order, axis=1), ids[order]
        first, second = ids // DIGIT, ids % DIGIT
        h, d, total, right, log = _forward(p, near, first, second, self.room)
        self.loss -= float(log.sum(dtype=np.float64))
        d.reshape(-1, DIGIT)[:] *= (1 / (n * total)).reshape(-1, 1)
        d.reshape(-1)[right] -= np.float32(1 / n)
        both = np.concatenate([p["first"], p["second"]], 1)
        dh = d @ both.T
        dh *= 1 - h * h
        grad = h.T @ d
        ones = np.ones(n, np.float32)
        by_first = np.zeros((DIGIT, DIGIT), np.float32)
        edges = np.searchsorted(first, np.arange(DIGIT + 1)).tolist()
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if a < b:
                np.matmul(ones[a:b], d[a:b, DIGIT:], out=by_first[k])
        self._move("first", grad[:, :DIGIT])
        self._move("second", grad[:, DIGIT:])
        self._move("first_bias", (ones @ d)[:DIGIT])
        self._move("hidden", ones @ dh)
        self._move("second_bias", by_first)
        flat = dh.astype(np.float64).reshape(-1)
        for i in range(2 * SIDE):
            by_word = np.bincount(np.take(self.places, near[i], axis=0).reshape(-1), flat, self.places.size)
            self._move("embed", by_word.astype(np.float32).reshape(-1, WIDTH), i)

    def _move(self, name: str, grad: np.ndarray, table: int | None = None) -> None:
        """Entries without a gradient stay as they are."""
        p, seen = (x[name] if table is None else x[name][table] for x in (self.p, self.seen))
        seen += grad * grad
        grad *= self.rate
        grad /= np.sqrt(seen)
        p -= grad


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def _shaped(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def _masked(n: int, number: int, turn: int, stride: int) -> np.ndarray:
    """Of n positions of a task, from the ``number``-th on, those that a round predicts; ``stride`` rounds have each once."""
    x = (np.arange(number, number + n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return np.flatnonzero((x >> np.uint64(40)) % np.uint64(stride) == turn % stride)


def train(docs: DataFrame, known: list[bytes], text: str = "text", rounds: int = 2, rate: float = 0.1, batch_size: int = 4096, stride: int = 2, losses: list[float] | None = None) -> dict[str, np.ndarray]:
    """Parameters after ``rounds`` of averaged training over all rows; ``stride`` rounds predict every token once."""
    words = docs.sparkSession.sparkContext.broadcast(known)  # a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _coder(words.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([code(v.as_py()).tobytes() for v in batch.column(0)], pa.binary())], names=["ids"])

    return train_codes(docs.select(text).mapInArrow(run, "ids binary"), rounds, rate, batch_size, stride, losses)


def train_codes(coded: DataFrame, rounds: int = 2, rate: float = 0.1, batch_size: int = 4096, stride: int = 2, losses: list[float] | None = None, used: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The same on a column ``ids`` of codes. ``losses`` gets the mean loss of a predicted token of every round."""
    p = start_parameters(used)
    for turn in range(rounds):
        shared = coded.sparkSession.sparkContext.broadcast(_flat(p))  # a fixed size

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn, shared=shared) -> Iterator[pa.RecordBatch]:
            trainer = _Trainer(_shaped(shared.value), rate)
            held: list[tuple[np.ndarray, np.ndarray]] = []
            waiting = weight = number = 0
            for whole in batches:
                for a in range(0, whole.num_rows, 200):
                    texts = [np.frombuffer(v.as_buffer(), np.uint16) for v in whole.column(0).slice(a, 200)]
                    n = sum(map(len, texts))
                    masked = _masked(n, number, turn, stride)
                    number += n
                    if not len(masked):
                        continue
                    held.append(contexts(texts, masked))
                    waiting += len(masked)
                    weight += len(masked)
                    if waiting >= batch_size:
                        near, ids = np.concatenate([x[0] for x in held], 1), np.concatenate([x[1] for x in held])
                        for s in range(0, len(ids), batch_size):
                            trainer.step(near[:, s : s + batch_size], ids[s : s + batch_size])
                        held, waiting = [], 0
            if held:
                trainer.step(np.concatenate([x[0] for x in held], 1), np.concatenate([x[1] for x in held]))
            if weight:
                rows = [[TaskContext.get().partitionId() % _SALTS], [float(weight)], [trainer.loss], [(_flat(trainer.p).astype(np.float64) * weight).tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1]), pa.array(rows[2]), pa.array(rows[3], pa.binary())], names=["salt", "weight", "loss", "total"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weight, loss, total = 0.0, 0.0, None
            for batch in batches:
                for w, x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                    weight, loss = weight + w, loss + x
                    part = np.frombuffer(y.as_buffer(), np.float64)
                    total = part.copy() if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([weight]), pa.array([loss]), pa.array([total.tobytes()], pa.binary())], names=["salt", "weight", "loss", "total"])

        schema = "salt int, weight double, loss double, total binary"
        sums = coded.select("ids").mapInArrow(run, schema).repartition(_SALTS, "salt").sortWithinPartitions("weight").mapInArrow(add, schema).collect()
        weight = sum(r["weight"] for r in sums)
        if not weight:
            break
        if losses is not None:
            losses.append(sum(r["loss"] for r in sums) / weight)
        p = _shaped(sum(np.frombuffer(bytes(r["total"]), np.float64) for r in sorted(sums, key=lambda r: r["weight"])) / weight)
    return p


def _encode(docs: DataFrame, key: str, text: str, known: list[bytes], buckets: int) -> DataFrame:
    """By row its codes; by stretch of rows (``start``, its first row) and bucket the hashes of its rare words and their rows."""
    words = docs.sparkSession.sparkContext.broadcast(known)
    schema = T.StructType(
        [T.StructField("start", T.LongType()), T.StructField("row", T.LongType()), T.StructField("key", docs.schema[key].dataType), T.StructField("ids", T.BinaryType())]
        + [T.StructField("bucket", T.IntegerType()), T.StructField("words", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _coder(words.value)
        start = row = TaskContext.get().partitionId() << 33
        rare: list[bytes] = []  # of a row, joined: kept one by one, words hold the memory that later rows could use again
        owners: list[np.ndarray] = []
        held = 0

        def ship(kind: pa.DataType) -> pa.RecordBatch:
            hashes, owner = batch_word_hashes([b"\n".join(rare)])[0], np.concatenate(owners)
            to = (hashes % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            hashes, owner, to = hashes[order].astype("<u8"), owner[order].astype("<u4"), to[order]
            edges = np.flatnonzero(np.diff(to, prepend=-1, append=buckets))
            data = [hashes[a:b].tobytes() + owner[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]
            n = len(data)
            return pa.RecordBatch.from_arrays([pa.array([start] * n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, kind), pa.nulls(n, pa.binary()), pa.array(to[edges[:-1]], pa.int32()), pa.array(data, pa.binary())], names=schema.names)

        for whole in batches:
            kind = whole.schema.field(0).type
            for a in range(0, whole.num_rows, 1000):
                batch = whole.slice(a, 1000)
                n, ids = batch.num_rows, []
                for i, value in enumerate(batch.column(1)):
                    codes, at, own = code.parts(_words_of(value))
                    ids.append(codes)
                    if own:
                        rare.append(b"\n".join(own))
                        owners.append(np.full(len(at), row + i - start, np.int64))
                        held += len(at)
                yield pa.RecordBatch.from_arrays([pa.array([start] * n, pa.int64()), pa.array(range(row, row + n), pa.int64()), batch.column(0), pa.array([x.tobytes() for x in ids], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=schema.names)
                row += n
                if held >= _FLUSH or row - start >= _ROWS:
                    if rare:
                        yield ship(kind)
                    rare, owners, held, start = [], [], 0, row
        if rare:
            yield ship(kind)

    return docs.select(key, text).mapInArrow(run, schema)


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of packed words sorted by bucket: by what was sent, the rows and the sums of ln n(word) over their words."""
    bucket, held = None, []

    def sums() -> pa.RecordBatch:
        words = np.concatenate([w for _, w, _ in held])
        _, which, n = np.unique(words, return_inverse=True, return_counts=True)
        logs, at, out = np.rint(np.log(n) * _UNIT).astype(np.int64)[which], 0, []
        for start, w, owner in held:
            rows, local = np.unique(owner, return_inverse=True)
            total = np.zeros(len(rows), np.int64)
            np.add.at(total, local, logs[at : at + len(w)])
            at += len(w)
            out.append((start, rows.astype("<u4").tobytes(), total.tobytes()))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["start", "rows", "sums"])

    for batch in batches:
        for b, start, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if held and b != bucket:
                yield sums()
            bucket, data = b, data.as_buffer()
            n = data.size // 12
            held.append((start, np.frombuffer(data, "<u8", n).copy(), np.frombuffer(data, "<u4", n, 8 * n).copy()))
    if held:
        yield sums()


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", losses: list[float] | None = None) -> DataFrame:
    """(key, n_tokens, log_probability, per_token) of every row, by a network trained on all rows."""
    spark, scratch = docs.sparkSession, []
    counted = materialize(word_counts(docs, text), scratch)
    frequent = _most_frequent(counted)
    sizes = _class_sizes(counted, frequent)
    drop(spark, scratch)
    parts = shuffle_partitions(spark)
    coded = materialize(_encode(docs, key, text, list(frequent), max(parts, -(-int(sizes.sum()) // _BUCKET))))
    own = coded.filter("row IS NOT NULL")
    shared = spark.sparkContext.broadcast((_flat(train_codes(own, losses=losses, used=np.append(np.arange(KNOWN) < len(frequent), sizes > 0))), np.log(np.maximum(sizes, 1))))
    scored = T.StructType(
        [T.StructField("start", T.LongType()), T.StructField("row", T.LongType()), T.StructField("key", docs.schema[key].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("network", T.DoubleType())]
        + [T.StructField("rows", T.BinaryType()), T.StructField("sums", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, log_sizes = _shaped(shared.value[0]), shared.value[1]
        share = np.concatenate([np.zeros(KNOWN), log_sizes])
        for whole in batches:
            for a in range(0, whole.num_rows, 200):
                batch = whole.slice(a, 200)
                texts = [np.frombuffer(v.as_buffer(), np.uint16) for v in batch.column(3)]
                total = log_probabilities(p, texts) - np.array([share[t].sum() for t in texts])
                k = len(texts)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array([len(t) for t in texts], pa.int64()), pa.array(total), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], names=scored.names)

    result = T.StructType([docs.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("log_probability", T.DoubleType()), T.StructField("per_token", T.DoubleType())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By stretch, the network's part of a row's score and the sums sent back for it."""
        start, kind, own, sent = None, pa.null(), [], []

        def close() -> pa.RecordBatch:
            own.sort(key=lambda r: r[0])  # a stretch has every row from its first on
            total = np.zeros(len(own), np.int64)
            for rows, sums in sent:
                total[np.frombuffer(rows, "<u4")] += np.frombuffer(sums, "<i8")
            n = np.array([r[2] for r in own], np.int64)
            found = np.array([r[3] for r in own]) + total / _UNIT
            each = np.divide(found, n, out=np.zeros(len(n)), where=n > 0)
            batch = pa.RecordBatch.from_arrays([pa.array([r[1] for r in own], kind), pa.array(n), pa.array(found), pa.array(each)], names=result.names)
            own.clear()
            sent.clear()
            return batch

        for batch in batches:
            kind = batch.schema.field(2).type
            for s, row, k, n, network, rows, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own and s != start:
                    yield close()
                start = s
                if row is None:
                    sent.append((rows, sums))
                else:
                    own.append((row, k, n, network))
        if own:
            yield close()

    counts = coded.filter("row IS NULL").select("bucket", "start", "words").repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_add_counts, "start long, rows binary, sums binary")
    both = own.select("start", "row", "key", "ids").mapInArrow(run, scored).unionByName(counts, allowMissingColumns=True)
    return both.repartition(parts, "start").sortWithinPartitions("start").mapInArrow(meet, result)
