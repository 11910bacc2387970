"""Vector functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths or without length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0) | norm.isNull(), F.lit(0.0)).otherwise(dot(a, b) / F.nullif(norm, F.lit(0.0)))


def cosine_padded(a: Column, b: Column) -> Column:
    """Cosine of vectors of any lengths, the shorter one as if it went on with zeros."""
    n = F.least(F.size(a), F.size(b))
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((norm == 0) | norm.isNull(), F.lit(0.0)).otherwise(dot(F.slice(a, 1, n), F.slice(b, 1, n)) / F.nullif(norm, F.lit(0.0)))


#: Queries that a task holds at once, rows of a part, rows that are compared at once.
_BLOCK, _PART, _STEP = 4096, 1 << 16, 1024


def _held(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors in doubles; None for null ones and such with null components."""
    flat, ends, null = column.values, column.offsets.to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    holes = np.append(0, np.cumsum(flat.is_null().to_numpy(zero_copy_only=False)))
    return [None if n or holes[a] < holes[b] else values[a:b] for n, a, b in zip(null.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _cosines(a: list[np.ndarray | None], b: list[np.ndarray | None]) -> np.ndarray:
    """All cosines in double precision, with the results of ``cosine``: 0 for other lengths, zero and null vectors; not a number stays so."""
    out = np.zeros((len(a), len(b)))
    by_width: tuple[dict, dict] = {}, {}
    for side, vectors in zip(by_width, (a, b), strict=True):
        for i, v in enumerate(vectors):
            if v is not None and len(v):
                side.setdefault(len(v), []).append(i)
    for width in by_width[0].keys() & by_width[1].keys():
        i, j = (np.array(side[width]) for side in by_width)
        x, y = np.stack([a[k] for k in i]), np.stack([b[k] for k in j])
        with np.errstate(all="ignore"):
            norm = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))
            out[np.ix_(i, j)] = np.where(norm == 0, 0.0, (x @ y.T) / norm)
    return out


def in_blocks(queries: DataFrame, rows: DataFrame, key: str, vector: str = "embedding", least: float | None = None, top: int | None = None, digits: int = 6, block: int = _BLOCK, part: int = _PART) -> DataFrame:
    """(q, key, cosine to ``digits``) of a stated query set against all other rows: pairs of at least ``least`` (before rounding),
    each query's ``top`` (by rounded cosine, then key), or all.

    Each cell of a block of queries and a part of the rows is a task's work: it holds the queries of the block and streams the rows
    past them as matrix products. Only pairs that may be in the result leave it; neither side is broadcast.
    """
    blocks = max(1, -(-queries.count() // block))
    parts = max(-(-rows.count() // part), -(-2 * rows.sparkSession.sparkContext.defaultParallelism // blocks))
    deal = lambda n, salt: F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(F.lit(0).alias("side"), F.col(key).alias("key"), F.col(vector).alias("v"), deal(blocks, 1).alias("block"), each(parts).alias("part"))
    r = rows.select(F.lit(1).alias("side"), F.col(key).alias("key"), F.col(vector).alias("v"), deal(parts, 2).alias("part"), each(blocks).alias("block"))
    cells = q.unionByName(r).filter("key IS NOT NULL").select((F.col("block") * parts + F.col("part")).alias("cell"), "side", "key", "v")
    kind = rows.schema[key].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, held, cell, best = [], [], None, None

        def shipped(i: np.ndarray, k: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(k), pa.array(c)], names=["q", key, "cosine"])

        def kept(i: np.ndarray, k: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
            order = np.lexsort((k, -np.nan_to_num(c, nan=2.0, posinf=3.0, neginf=-3.0), i))  # not a number is greatest
            i, k, c = i[order], k[order], c[order]
            first = np.searchsorted(i, i)
            keep = np.arange(len(i)) - first < top
            return i[keep], k[keep], c[keep]

        for batch in batches:
            at = 0
            numbers, sides = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(sides) != 0)) + 1
            for end in [*cuts.tolist(), batch.num_rows]:
                piece, number, side = batch.slice(at, end - at), int(numbers[at]), int(sides[at])
                at = end
                if number != cell:
                    if best is not None:
                        yield shipped(*best)
                    asked, held, cell, best = [], [], number, None
                if side == 0:
                    asked.append(piece.column(2).to_numpy())
                    held += _held(piece.column(3))
                    continue
                if not held:
                    continue
                ids = np.concatenate(asked)
                for a in range(0, piece.num_rows, _STEP):
                    step = piece.slice(a, _STEP)
                    keys, cos = step.column(2).to_numpy(), _cosines(held, _held(pa.concat_arrays([step.column(3)])))
                    keep = (ids[:, None] != keys) & (~(cos < least) if least is not None else True)
                    cos = np.sign(cos) * np.floor(np.abs(cos) * 10.0**digits + 0.5) / 10.0**digits + 0.0
                    if top and best is not None and len(best[0]) == top * len(ids):
                        keep &= ~(cos < best[2].reshape(-1, top).min(1)[:, None])  # equal ones may come first by key
                    i, j = np.nonzero(keep)
                    if top is None:
                        yield shipped(i, keys[j], cos[i, j])
                    else:
                        found = i, keys[j], cos[i, j]
                        best = kept(*(found if best is None else map(np.concatenate, zip(best, found, strict=True))))
        if best is not None:
            yield shipped(*best)

    found = cells.repartitionById(blocks * parts, "cell").sortWithinPartitions("cell", "side").mapInArrow(compare, f"q {kind}, `{key}` {kind}, cosine double")
    if top is None:
        return found
    order = W.partitionBy("q").orderBy(F.desc("cosine"), key)
    return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top).drop("r")


def unit(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.when(norm == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / F.nullif(norm, F.lit(0.0))))


def clamp01(x: Column) -> Column:
    return F.when(F.isnan(x) | x.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounding as floor(x * 10^d + 0.5) / 10^d."""
    k = float(10**digits)
    return F.floor(x * F.lit(k) + F.lit(0.5)) / F.lit(k) if digits else F.floor(x + F.lit(0.5))


def _fnv1a(text: str) -> int:
    h = 2166136261
    for ch in text.encode("utf-16-le")[::2]:
        h = ((h ^ ch) * 16777619) & 0xFFFFFFFF
    return h


def hash_embedding(dimensions: int = 256) -> Column:
    """A pandas UDF: unit vectors of token (1) and character trigram (0.3) weights in hash buckets."""
    import re

    @pandas_udf("array<double>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bucket: dict[str, int] = {}

        def place(key: str) -> int:
            if key not in bucket:
                if len(bucket) > 200_000:
                    bucket.clear()
                bucket[key] = _fnv1a(key) % dimensions
            return bucket[key]

        def one(text: str) -> np.ndarray:
            v = np.zeros(dimensions)
            for token in re.sub(r"[^a-z0-9\s.-]", " ", (text or "").lower()).split():
                if len(token) > 2:
                    v[place(token)] += 1
                    for gram in [token] if len(token) <= 3 else [token[i : i + 3] for i in range(len(token) - 2)]:
                        v[place("g:" + gram)] += 0.3
            n = np.linalg.norm(v)
            return v / n if n else v

        for series in parts:
            yield series.map(one)

    return embed


def signed_hash_embedding(dimensions: int = 128) -> Column:
    """A pandas UDF: signed hash buckets of tokens (by length), bigrams (0.7) and padded trigrams (0.28), unit length."""
    import re

    @pandas_udf("array<double>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def add(v: np.ndarray, key: str, weight: float) -> None:
            v[_fnv1a(key) % dimensions] += weight if _fnv1a("s:" + key) % 2 == 0 else -weight

        def one(text: str) -> np.ndarray:
            v, tokens = np.zeros(dimensions), re.findall(r"[a-z0-9]+(?:'[a-z0-9]+)?", (text or "").lower())
            for token in tokens:
                add(v, token, 1 + min(len(token) / 12, 0.6))
                padded = f"^{token}$"
                for i in range(len(padded) - 2):
                    add(v, padded[i : i + 3], 0.28)
            for a, b in zip(tokens, tokens[1:], strict=False):
                add(v, f"{a} {b}", 0.7)
            n = np.linalg.norm(v)
            return v / n if n else v

        for series in parts:
            yield series.map(one)

    return embed
