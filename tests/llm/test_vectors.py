"""The operators on vectors against brute force, with nulls, ties, repeated rows and numbers of any size."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from quarry.llm import vector_codes, vector_join
from quarry.llm._spark import materialize
from quarry.llm.components import salted_join
from quarry.llm.queries import _VECTOR_JOIN_SQL

SCHEMA = "vec_id long, embedding array<{}>, label int, code string, error string, key string, vector int"


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], SCHEMA.format(kind)).repartition(3)


def brute_codes(rows, entries=256, rounds=4, parts=4):
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(1024 * x) for x in r[1]] for r in kept]
    size = len(whole[0]) // parts
    book = [[v[p * size : (p + 1) * size] for v in whole[:entries]] for p in range(parts)]

    def near(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v[p * size : (p + 1) * size], e, strict=True)), i) for i, e in enumerate(book[p]))

    for _ in range(rounds):
        new = [[list(e) for e in b] for b in book]
        for p in range(parts):
            members = {}
            for v in whole:
                members.setdefault(near(p, v)[1], []).append(v[p * size : (p + 1) * size])
            for e, m in members.items():
                new[p][e] = [sum(c) // len(m) for c in zip(*m, strict=True)]
        book = new
    digest = hashlib.sha256(",".join(str(x) for b in book for e in b for x in e).encode()).hexdigest()
    out, sums = [], {}
    for r, v in zip(kept, whole, strict=True):
        found = [near(p, v) for p in range(parts)]
        out.append((r[0], "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found), r[2]))
        sums[r[2]] = sums.get(r[2], 0) + out[-1][2]
    return sorted(((k, c, e, sums[label], digest) for k, c, e, label in out), key=repr)


def coded(df, **how):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compress(df, **how).collect()), key=repr)


def single(values):
    return [float(np.float32(x)) for x in values]


def test_vector_codes_match_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, single(rng.normal(size=8)), i % 3 if i % 5 else None) for i in range(400)]
    rows += [(1, None, 1), (2, [None] * 8, 1), (3, [math.nan] * 8, 1), (4, [math.inf] + [0.0] * 7, 1), (5, [], 1), (None, single([0.1] * 8), 2), rows[3], rows[3], (7, single([0.2] * 8), 2), (8, single([-0.0] * 8), None)]
    assert coded(table(spark, rows)) == brute_codes(rows)


def test_vector_codes_of_few_rows_ties_and_large_numbers(spark):
    few = [(i, [float(i // 2)] * 4, 1) for i in range(9)]
    assert coded(table(spark, few)) == brute_codes(few)
    rng = random.Random(2)
    big = [(i, [rng.gauss(0, 1) * 10.0 ** rng.randint(0, 20) for _ in range(8)], None) for i in range(60)]
    want = [(k, c, e if e < 1 << 63 else None, None, d) for k, c, e, _, d in brute_codes(big, 16)]
    assert coded(table(spark, big, "double"), entries=16) == want
    assert coded(table(spark, [])) == []
    with pytest.raises(ValueError, match="of one length"):
        vector_codes.compress(table(spark, [(1, [1.0] * 8, 1), (2, [1.0] * 4, 1)]))


def test_bounds_leave_few_entries_and_never_the_nearest():
    rng = np.random.default_rng(3)
    entries, parts = np.floor(rng.normal(size=(256, 16)) * 128).astype(np.int64), np.floor(rng.normal(size=(500, 16)) * 128).astype(np.int64)
    entry, distance = vector_codes.Filter(entries).nearest(parts)
    every = ((parts[:, None] - entries) ** 2).sum(2)
    assert (entry == every.argmin(1)).all() and (distance == every.min(1)).all()


def brute_links(rows, threshold=0.9):
    """(id, links, component, kept) of every row, comparing all pairs."""
    fit = [bool(r[1]) and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    unit = [vector_join.unit(np.array([r[1]], float))[0] if ok else None for r, ok in zip(rows, fit, strict=True)]
    near = [[j for j in range(len(rows)) if j != i and fit[i] and fit[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(len(rows))]
    out, seen = [], {}
    for i in range(len(rows)):
        if i not in seen:
            reached, todo = {i}, [i]
            while todo:
                todo = [j for k in todo for j in near[k] if j not in reached and not reached.add(j)]
            ids = [rows[j][0] for j in reached if rows[j][0] is not None]
            seen |= dict.fromkeys(reached, min(ids) if ids else None)
        out.append((rows[i][0], len(near[i]), seen[i], rows[i][0] == seen[i]))
    return sorted(out, key=repr)


def linked(df, **how):
    return sorted(map(tuple, vector_join.near_duplicates(df, **how).collect()), key=repr)


def cluster(rng, centre, n, spread):
    return [single(centre + rng.normal(size=len(centre)) * spread) for _ in range(n)]


@pytest.mark.parametrize("stripe", [2048, 40])
def test_vector_links_match_brute_force(spark, stripe):
    rng = np.random.default_rng(5)
    unit = lambda: vector_join.unit(rng.normal(size=(1, 24)))[0]
    vectors = [single(unit()) for _ in range(150)]
    vectors += cluster(rng, unit(), 120, 0.02) + cluster(rng, unit(), 60, 0.06) + cluster(rng, unit(), 3, 0.03)
    vectors += [single(3 * np.array(vectors[0])), single(-np.array(vectors[1])), vectors[2], vectors[2], vectors[200], [0.0] * 24, None, [], [None] * 24, [math.nan] * 24, [math.inf] * 24, [1.0] * 8, [1.0] * 8, [1.0] * 7]
    rows = [(i, v, 1) for i, v in enumerate(vectors)]
    rows += [(None, vectors[160], 1), (None, single(unit()), 1), (None, [0.5] * 5, 2), (None, [0.5] * 5, 2), rows[7], (9, single(unit()), 1)]
    assert linked(table(spark, rows), stripe=stripe) == brute_links(rows)


def test_vectors_of_any_size(spark):
    rng = np.random.default_rng(6)
    a = vector_join.unit(rng.normal(size=(1, 10)))[0]
    rows = [(i, v.tolist(), 1) for i, v in enumerate((a * 1e300, a * 1e-300, -a, a + 0.01))]
    assert linked(table(spark, rows, "double")) == brute_links(rows)
    assert linked(table(spark, [])) == [] and linked(table(spark, [(1, None, 1)])) == [(1, 0, 1, True)]


def test_near_threshold_pairs_are_decided_in_doubles(spark):
    rng, rows = np.random.default_rng(7), []
    for i in range(300):
        x, z = vector_join.unit(rng.normal(size=(2, 64)))
        z = vector_join.unit((z - (z @ x) * x)[None])[0]
        c = 0.9 + (i - 149.5) * 1e-5
        rows += [(2 * i, x.tolist(), 1), (2 * i + 1, (c * x + math.sqrt(1 - c * c) * z).tolist(), 1)]
    got, want = linked(table(spark, rows, "double")), brute_links(rows)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g[1] for g in got) >= 0.95 * sum(w[1] for w in want)


@pytest.mark.parametrize("width", [3, 64, 300])
def test_recall_of_filters(width):
    rng = np.random.default_rng(8)
    x, z = vector_join.unit(rng.normal(size=(800, width))), rng.normal(size=(800, width))
    z = vector_join.unit(z - (z * x).sum(1, keepdims=True) * x)
    f = vector_join.filters(x)
    for c, least in ((0.9, 0.97), (0.95, 0.99)):
        g = vector_join.filters(c * x + math.sqrt(1 - c * c) * z)
        assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(f, g, strict=True)]) >= least
    far = vector_join.filters(vector_join.unit(rng.normal(size=(800, width))))
    assert width < 10 or np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(f, far, strict=True)]) < 0.01


def test_vector_links_match_sql(spark):
    import duckdb

    rng = np.random.default_rng(9)
    rows = [(i, v, 1) for i, v in enumerate(cluster(rng, np.ones(16), 40, 0.1) + cluster(rng, -np.ones(16), 30, 0.2) + [None, [0.0] * 16])]
    df = table(spark, rows)
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    assert linked(df) == sorted(con.execute(_VECTOR_JOIN_SQL).fetchall(), key=repr)


def test_salted_tables_are_not_sent_through_the_driver(spark):
    """Sixteen copies of a row are not in the size that Spark goes by: a small file was broadcast sixteen times as large."""
    one = materialize(spark.range(1000).withColumnRenamed("id", "a"))
    rows = spark.range(4000).select((F.col("id") % 1000).alias("a"), F.col("id").alias("b"))
    joined = salted_join(rows, one, "a", "b")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 4000


def test_links_are_the_same_when_large_filters_are_merged(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [(i, (rng.normal(size=8) * 0.2 + (i % 3 == 0)).tolist(), 0) for i in range(120)]
    links = lambda: sorted(vector_join.near_duplicates(table(spark, rows), stripe=4).collect())
    before = links()
    monkeypatch.setattr(vector_join, "_FEW", 0)
    assert links() == before and any(r["n_links"] for r in before)
