"""Document fingerprints: a homomorphic hash of the multiset of paragraphs.

Every paragraph (non-empty line) is hashed to a wide vector, and a document's fingerprint is the sum of its
paragraphs' vectors, lane by lane, modulo a power of two. So it does not depend on the order of paragraphs,
and inserting or deleting a paragraph adds or subtracts its vector (``combine``). A paragraph's vector has

* ``STRONG`` lanes modulo 2**32, expanded from a 128-bit hash of the paragraph's text: equality;
* ``LANES`` lanes modulo 2**64: the paragraph's word trigrams (of a shorter paragraph the sequence of words),
  each adding +1 or -1 to one lane: likeness. They are written in as few bytes as the largest of them needs. The inner product of two such vectors estimates how many
  trigrams the multisets share, so likeness is twice it over the two squared norms, cut to 0..1.

Defined results: a null text is empty; texts without a paragraph have the zero fingerprint, whose likeness is
1 to itself and 0 to any other; the key may be of any type that can be ordered; rows of one key, repeated rows too,
follow one another in the order of a hash of their texts, rows with a null key come last, and the next row of the last
is the first (with one row, itself); an empty table gives an empty result. Other columns do not matter. A text of any
length is hashed in slices of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm._spark import shuffle_partitions
from quarry.llm._text import batch_word_hashes, groups, mix

STRONG, LANES = 32, 256
_U64 = np.uint64


def sums(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The strong lanes (uint32) and likeness lanes (int64) of every text, one row each."""
    strong, lanes = np.zeros((len(texts), STRONG), np.uint32), np.zeros((len(texts), LANES), np.int64)
    for a, b in groups([len(t) for t in texts], 1 << 20):
        paragraphs, owner = [], []
        for i in range(a, b):
            own = [p for p in texts[i].split(b"\n") if p.strip()]
            paragraphs += own
            owner += [i] * len(own)
        if not paragraphs:
            continue
        owner = np.array(owner)
        digest = np.frombuffer(b"".join(hashlib.blake2b(p, digest_size=16).digest() for p in paragraphs), "<u8").reshape(-1, 2)
        steps = mix(np.arange(1, STRONG // 2 + 1, dtype=_U64))
        wide = mix(digest[:, :1] + steps) ^ digest[:, 1:] * (steps | _U64(1))
        np.add.at(strong, owner, mix(wide).view(np.uint32))
        words, offsets = batch_word_hashes(paragraphs)
        n = np.diff(offsets)
        word_owner = np.repeat(np.arange(len(paragraphs)), n)
        first = np.repeat(offsets[:-1], n)
        h = words.copy()
        at = np.arange(len(words))
        full = at - first >= 2  # trigrams end here
        if len(words) > 2:
            h[2:] = np.where(full[2:], mix(words[2:] + mix(words[1:-1] + mix(words[:-2]))), h[2:])
        two = (at - first == 1) & (np.repeat(n, n) == 2)
        if two.any():
            h[two] = mix(words[two] + mix(words[np.flatnonzero(two) - 1]))
        keep = full | two | (np.repeat(n, n) == 1)
        h, rows = h[keep], owner[word_owner[keep]] - a
        sign = np.where(h >> _U64(63), 1, -1)
        flat = np.bincount(rows * LANES + (h % _U64(LANES)).astype(np.int64), weights=sign, minlength=(b - a) * LANES)
        lanes[a:b] += flat.astype(np.int64).reshape(b - a, LANES)
    return strong, lanes


def combine(a: str, b: str, sign: int = 1) -> str:
    """The fingerprint of both multisets together; with ``sign`` -1, of ``a`` without ``b``'s paragraphs."""
    x, y = decode(a), decode(b)
    return encode((x[0] + np.uint32(sign % (1 << 32)) * y[0]).astype(np.uint32), x[1] + sign * y[1])


def encode(strong: np.ndarray, lanes: np.ndarray) -> str:
    """Base64 of the strong lanes and the likeness lanes, these in the least of 1, 2, 4 and 8 bytes that holds them all."""
    width = next(k for k in (1, 2, 4, 8) if k == 8 or (lanes.min() >= -(1 << 8 * k - 1) and lanes.max() < 1 << 8 * k - 1))
    return base64.b64encode(strong.astype("<u4").tobytes() + lanes.astype(f"<i{width}").tobytes()).decode()


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    return np.frombuffer(raw[: 4 * STRONG], "<u4"), np.frombuffer(raw[4 * STRONG :], f"<i{(len(raw) - 4 * STRONG) // LANES}").astype(np.int64)


def likeness(strong_a: np.ndarray, lanes_a: np.ndarray, strong_b: np.ndarray, lanes_b: np.ndarray) -> np.ndarray:
    """By row, the estimated share of trigrams in common (Dice on the multisets); 1 for equal fingerprints."""
    x, y = lanes_a.astype(np.float64), lanes_b.astype(np.float64)
    norm = (x * x).sum(1) + (y * y).sum(1)
    found = np.clip(np.divide(2 * (x * y).sum(1), norm, out=np.zeros(len(x)), where=norm > 0), 0, 1)
    return np.where((strong_a == strong_b).all(1) & (lanes_a == lanes_b).all(1), 1.0, found)


FIELDS = [("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType())]


def _edited(text: str, following: str) -> str:
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def _digest(keys: list, texts: list[str], nexts: list[str], known: tuple[np.ndarray, np.ndarray], at: np.ndarray, follow: np.ndarray, names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    """known: the sums of all these texts, of the texts at ``at``, of the next ones at ``follow``."""
    strong, lanes = known
    edited = [_edited(a, b).encode("utf-8", "replace") for a, b in zip(texts, nexts, strict=True)]
    s, v = sums(edited)
    columns = [
        pa.array(keys, kind), pa.array(list(map(len, texts)), pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
        pa.array([encode(strong[i], lanes[i]) for i in at]), pa.array([encode(*x) for x in zip(s, v, strict=True)]),
        pa.array(likeness(strong[at], lanes[at], s, v)), pa.array(likeness(strong[at], lanes[at], strong[follow], lanes[follow])),
    ]
    return pa.RecordBatch.from_arrays(columns, names=names)


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows in runs: by ``bucket`` (a range of keys), in descending order, each run closed by the row that follows it.

    The order is that of the key and, within a key, of a hash of the text. Buckets are quantiles of it, found by Spark's
    range partitioning of these two alone, so neither a far key nor a frequent one makes a large bucket; the first row of
    a bucket is also sent, as a guest, to the bucket before. So texts are shuffled once. Columns: bucket, guest, key, text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    parts = shuffle_partitions(spark)
    place = F.struct(F.col("key").isNotNull().alias("known"), "key", "hash")
    light = rows.select("key", "hash").repartitionByRange(parts, F.asc_nulls_first("key"), "hash")
    ends = light.groupBy(F.spark_partition_id()).agg(F.min(place).alias("low"), F.max(place).alias("high")).collect()  # one row a partition
    plain = lambda p: tuple(x for x in p if x is not None)
    nested = isinstance(docs.schema[key].dataType, (T.StructType, T.ArrayType))
    lows, highs = ([], []) if nested else (sorted(plain(r["low"]) for r in ends), sorted(plain(r["high"]) for r in ends))
    edges = spark.sparkContext.broadcast((lows, highs))

    @F.pandas_udf("array<int>")
    def buckets(known: pd.Series, key: pd.Series, hash_: pd.Series) -> pd.Series:
        lows, highs = edges.value
        out = []
        for k, x, h in zip(known, key.tolist(), hash_, strict=True):
            at = (True, x, h) if k else (False, h)
            b = bisect_right(lows, at) - 1
            out.append([b] if at != highs[b] else [b, (b + 1) % len(lows)])
        return pd.Series(out)

    kind = docs.schema[key].dataType
    if nested:  # Python has no order of these; the edges, one a partition, are compared by Spark
        known = T.StructType([T.StructField("known", T.BooleanType()), T.StructField("key", kind), T.StructField("hash", T.LongType())])
        both = T.StructType([T.StructField(n, T.ArrayType(known)) for n in ("lows", "highs")])
        one = spark.createDataFrame([([r["low"] for r in ends], [r["high"] for r in ends])], both).select(F.sort_array("lows").alias("lows"), F.sort_array("highs").alias("highs"))
        at = rows.join(F.broadcast(one)).withColumn("b", F.size(F.filter("lows", lambda x: x <= place)) - 1)  # one row
        last = F.get("highs", F.col("b")).eqNullSafe(place)
        marked = at.withColumn("buckets", F.when(last, F.array("b", (F.col("b") + 1) % F.size("lows"))).otherwise(F.array("b")))
    else:
        # a null key is stood in for by any other value, as pandas would turn whole numbers beside nulls into fractions
        some = F.coalesce("key", F.lit(lows[-1][1] if lows and lows[-1][0] else None).cast(kind))
        marked = rows.withColumn("buckets", buckets(F.col("key").isNotNull(), some, "hash"))
    spread = marked.select("key", "text", "hash", F.posexplode("buckets").alias("guest", "bucket")).select("bucket", "guest", "key", "text", "hash")
    return spread.repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", F.desc_nulls_last("key"), F.desc("hash"), F.desc("text")).drop("hash")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key of every row and ``FIELDS``: its fingerprint, and that of its text edited with the next row's."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType)] + [T.StructField(n, t) for n, t in FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # bucket, guest, key, text; its last row waits for what follows

        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            # a row's next is the row behind it in the run; a run ends with its first guest
            own = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i + 1][0] == rows[i][0]]
            for a, b in groups([len(rows[i][3]) for i in own], 4 << 20):
                part = own[a:b]
                needed = sorted({*part, *(i + 1 for i in part)})
                place = {j: n for n, j in enumerate(needed)}
                strong, lanes = sums([rows[j][3].encode("utf-8", "replace") for j in needed])
                at, follow = np.array([place[i] for i in part]), np.array([place[i + 1] for i in part])
                yield _digest([rows[i][2] for i in part], [rows[i][3] for i in part], [rows[i + 1][3] for i in part], (strong, lanes), at, follow, schema.names, kind)

        size, kind = 0, pa.null()
        for batch in batches:
            kind = batch.schema.field(2).type
            new = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            held += new
            size += sum(len(r[3]) for r in new)
            if size > 8 << 20:
                yield from out(held)
                held, size = held[-1:], len(held[-1][3])
        yield from out(held)

    return with_next(docs, key, text).mapInArrow(run, schema)
