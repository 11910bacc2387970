"""Vector code compression: product codes whose nearest entries are found by VA-file filtering.

Vectors become whole numbers (``floor(scale * x)``) and are cut into equal parts. Each part position has a codebook, which
starts as that part of the vectors of the smallest ids and is moved ``rounds`` times to the floored means of the parts
nearest to its entries. A pass over the rows, which is what every round costs, finds the nearest entries in each task:

1. the entries' coordinates are quantised to ``2**BITS`` cells a coordinate, by rank, so each entry is a few bits;
2. of each part a lookup table says how near and how far a coordinate can be from any entry in a cell; summed over an
   entry's cells they bound its squared distance from below and above;
3. only entries whose lower bound is within the least upper bound are compared, by distances of whole numbers.

Of a round only sums and counts by entry leave a task (parts x entries rows, whatever the input), are added up by entry,
and the new codebook, of fixed size, is collected and broadcast. Sums are exact for numbers of any size.

Defined results: rows whose vector is null, empty or holds null or non-finite components are dropped; the others must be
of one length that ``parts`` divides (else ``ValueError``); repeated rows and ids count each; where ids tie, the vector in
lexicographic order comes first into the codebook; a null id comes last; with fewer rows than entries the codebook is that
small; an error that no long can hold, and the sum it is part of, is null; an empty table gives an empty result; other
columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm._spark import materialize, shuffle_partitions
from quarry.llm.components import SALTS

#: Bits of a coordinate's cell; rows whose bounds are held at once.
BITS, _ROWS = 3, 1024
#: Whole numbers up to this have exact squared distances in doubles, for parts of up to 128 coordinates.
_EXACT, _WIDE = 1 << 22, 128
_LONG = (1 << 63) - 1


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)``: int64, or Python's numbers in an object array if some are too large for exact doubles."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values.astype(np.float64) * scale)
    if not len(scaled) or np.abs(scaled).max() <= _EXACT:
        return scaled.astype(np.int64)
    return np.array([math.floor(Fraction(float(x)) * scale) for x in values.ravel()], object).reshape(values.shape)


class Filter:
    """The nearest entries of one part's codebook."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.exact = entries.dtype != object and np.abs(entries).max(initial=0) <= _EXACT and entries.shape[1] <= _WIDE
        near = entries.astype(np.float64)
        n, width = near.shape
        cells = min(1 << BITS, n)
        order = np.argsort(near, axis=0, kind="stable")
        cell = np.empty((n, width), np.int64)
        np.put_along_axis(cell, order, np.repeat((np.arange(n) * cells // n)[:, None], width, 1), 0)
        edges = np.searchsorted(np.arange(n) * cells // n, np.arange(cells + 1))
        ranked = np.take_along_axis(near, order, 0)
        self.low, self.high = ranked[edges[:-1]].T, ranked[edges[1:] - 1].T  # width x cells: what the entries in a cell span
        self.member = np.zeros((width * cells, n))  # the cells of an entry, one a coordinate
        self.member[(np.arange(width) * cells + cell).ravel(), np.repeat(np.arange(n), width)] = 1

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By row of ``parts``, the nearest entry (the first of equals) and its squared distance."""
        found = [self._nearest(parts[a : a + _ROWS]) for a in range(0, len(parts), _ROWS)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        exact = self.exact and parts.dtype != object
        x = parts.astype(np.float64)[:, :, None]
        below, above = self.low - x, x - self.high
        lower, upper = np.maximum(np.maximum(below, above), 0) ** 2, np.maximum(np.abs(below), np.abs(above)) ** 2
        slack = 0 if exact else 1e-9
        lower = lower.reshape(len(x), -1) @ self.member * (1 - slack)
        upper = (upper.reshape(len(x), -1) @ self.member).min(1) * (1 + slack)
        row, entry = np.nonzero(lower <= upper[:, None])
        kind = np.int64 if exact else object
        distance = ((parts[row].astype(kind) - self.entries[entry].astype(kind)) ** 2).sum(1)
        first = np.searchsorted(row, np.arange(len(x)))
        if exact:
            least = np.minimum.reduceat(distance, first)
        else:
            least = np.array([min(distance[a:b]) for a, b in zip(first, np.append(first[1:], len(row)), strict=True)], object)
        hit = np.flatnonzero(distance == least[row])
        hit = hit[np.searchsorted(row[hit], np.arange(len(x)))]
        return entry[hit], distance[hit]


def _matrix(column: pa.Array, width: int, scale: int) -> np.ndarray:
    return whole(column.flatten().to_numpy(zero_copy_only=False), scale).reshape(-1, width)


def _usable(vector: Column) -> Column:
    plain = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, plain)


def _moved(vectors: DataFrame, books: list[np.ndarray], width: int, scale: int) -> list[np.ndarray]:
    """The codebooks after one round."""
    parts, size = len(books), width // len(books)
    known = vectors.sparkSession.sparkContext.broadcast(books)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [Filter(b) for b in known.value]
        sums = [np.zeros((len(b), size), object) for b in known.value]
        counts = [np.zeros(len(b), np.int64) for b in known.value]
        for batch in batches:
            rows = _matrix(batch.column(0), width, scale)
            for p in range(parts if len(rows) else 0):
                own = rows[:, p * size : (p + 1) * size]
                entry, _ = filters[p].nearest(own)
                counts[p] += np.bincount(entry, minlength=len(counts[p]))
                order = np.argsort(entry, kind="stable")
                first = np.flatnonzero(np.diff(entry[order], prepend=-1))
                sums[p][entry[order][first]] += np.add.reduceat(own[order], first, 0).astype(object)
        out = [(p, int(e), int(counts[p][e]), [str(x) for x in sums[p][e]]) for p in range(parts) for e in np.flatnonzero(counts[p])]
        yield _rows(out, [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())], ["part", "entry", "n", "sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, list] = {}
        for batch in batches:
            for p, e, n, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total = totals.setdefault((p, e), [0, np.zeros(size, object)])
                total[0] += n
                total[1] += np.array([int(x) for x in sums], object)
        out = [(p, e, [str(x // n) for x in total]) for (p, e), (n, total) in totals.items()]
        yield _rows(out, [pa.int32(), pa.int32(), pa.list_(pa.string())], ["part", "entry", "mean"])

    gathered = vectors.select("vector").mapInArrow(gather, "part int, entry int, n long, sums array<string>")
    dealt = gathered.repartition(shuffle_partitions(vectors.sparkSession), "part", "entry")
    new = [b.astype(object) for b in books]
    for r in dealt.mapInArrow(merge, "part int, entry int, mean array<string>").collect():  # at most parts x entries rows
        new[r["part"]][r["entry"]] = [int(x) for x in r["mean"]]
    known.unpersist()
    return [_narrow(b) for b in new]


def _narrow(entries: np.ndarray) -> np.ndarray:
    return entries.astype(np.int64) if max((abs(x) for x in entries.ravel()), default=0) <= _EXACT else entries


def _rows(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def compress(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024
) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every row with a vector; ``entries`` is at most 256."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte a part: 1 to 256 entries")
    spark = vectors.sparkSession
    kept = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector")).filter(_usable(F.col("vector")))
    lengths = kept.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
    width = lengths[0] or parts
    if lengths[0] != lengths[1] or width % parts:
        raise ValueError(f"vectors must be of one length that {parts} divides; lengths are {lengths[0]} to {lengths[1]}")
    size = width // parts
    first = kept.select("key", "vector").orderBy(F.asc_nulls_last("key"), "vector").limit(entries).collect()
    start = whole(np.array([r["vector"] for r in first], np.float64).reshape(-1, width), scale)
    books = [start[:, p * size : (p + 1) * size] for p in range(parts)]
    for _ in range(rounds if first else 0):
        books = _moved(kept, books, width, scale)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    known = spark.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [Filter(b) for b in known.value] if len(known.value[0]) else []
        for batch in batches:
            rows = _matrix(batch.column(2), width, scale)
            found = [f.nearest(rows[:, p * size : (p + 1) * size]) for p, f in enumerate(filters)] if len(rows) else []
            codes = np.stack([f[0] for f in found], 1).astype(np.uint8) if found else np.zeros((0, parts), np.uint8)
            errors = sum(f[1].astype(object) for f in found) if found else []
            columns = [pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array([int(x) if x <= _LONG else None for x in errors], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["key", "label", "code", "error"])

    schema = T.StructType([kept.schema["key"], kept.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = materialize(kept.select("key", "label", "vector").mapInArrow(assign, schema))
    # a frequent label's rows are dealt to SALTS parts, each of which gets the label's sum
    total = F.when(F.count("error") == F.count(F.lit(1)), F.sum(F.col("error").cast("decimal(38,0)")))
    sums = coded.groupBy(F.col("label").alias("of")).agg(total.alias("total"))
    sums = sums.select("of", F.expr("try_cast(total as bigint)").alias("label_error"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = coded.withColumn("part", F.pmod(F.xxhash64("key", "code"), F.lit(SALTS)).cast("int"))
    joined = dealt.join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col("part") == F.col("salt")))
    return joined.select(F.col("key").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
