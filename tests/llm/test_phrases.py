"""Phrase mining against counting with dictionaries."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import phrases
from quarry.llm._spark import materialize
from quarry.llm.queries import _PHRASES_SQL

SCHEMA = "doc_id long, text string, lang string, phrase string, shard int, ids string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "p", 1, "x") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)


def brute(rows, least, longest=4, cover=80, top=2000):
    counts, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            counts.update((lang, tuple(words[i : i + m])) for m in range(1, longest + 1) for i in range(len(words) - m + 1))
    often = {k: a for k, a in counts.items() if a >= least}
    most = Counter()
    for (lang, p), a in often.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                most[lang, p[i : i + m]] = max(most[lang, p[i : i + m]], a)
    out = []
    for lang in n:
        rows = []
        for (of, p), a in often.items():
            if of == lang and len(p) > 1 and 100 * most[of, p] < cover * a:
                score, _, left, right = min((2000000 * a // (counts[of, p[:k]] + counts[of, p[k:]]), k, counts[of, p[:k]], counts[of, p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def made(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "b", "ab", "a\x01", "ß", "É", "é", "漢字", "x\x1fy", "\x85"]
    ends = [" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "?", ";:", "!\r\n"]
    rows = [("".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 80))), rng.choice(["en", "en", "de", None, "und"])) for _ in range(n)]
    return [*rows, (None, "en"), ("", None), (" \t\n", "fr"), ("solo", "es"), rows[0], rows[0], ("the of a b " * 3000, "en"), ("z " * 500, "de")]


@pytest.mark.parametrize("shard", [1 << 20, 50])
def test_phrases_match_brute_force(spark, shard):
    rows = made(1)
    got = sorted(map(tuple, phrases.phrases(table(spark, rows), least=5, shard=shard).collect()))
    assert got == brute(rows, 5) and len(got) > 50


def test_longest_and_top(spark):
    rows = made(2, 40)
    for longest, top in ((2, 7), (6, 50)):
        got = phrases.phrases(table(spark, rows), least=3, longest=longest, top=top)
        assert sorted(map(tuple, got.collect())) == brute(rows, 3, longest, top=top)


def test_without_phrases(spark):
    for rows in ([], [(None, None), ("", "en")], [("one two three", "en")]):
        assert phrases.phrases(table(spark, rows)).collect() == []


@pytest.mark.parametrize("seed", range(8))
def test_common_prefixes(seed):
    rng = np.random.default_rng(seed)
    seq = rng.integers(0, 4, 200).astype("<u4")
    found = phrases.Suffixes(seq, 4)
    for n in range(1, 5):
        place, counts = found.phrases(n, None)
        want = Counter(tuple(seq[i : i + n].tolist()) for i in range(len(seq) - n + 1) if (seq[i : i + n] > 0).all())
        assert {tuple(g): c for g, c in zip(found.grams(place, n).tolist(), counts.tolist(), strict=True)} == want


def test_scores_pass_64_bits(spark):
    """Counts whose products no long can hold."""
    found = spark.createDataFrame([([1, 2], 9 * 10**12)], "ids array<long>, f long")
    parts = found.unionByName(spark.createDataFrame([([1], 9 * 10**12 + 1), ([2], 10**13)], "ids array<long>, f long"))
    assert phrases._scored(found, parts).first()["score"] == 2000000 * 9 * 10**12 // (9 * 10**12 + 1 + 10**13)


def test_phrases_match_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(map(tuple, phrases.phrases(docs.withColumn("n", F.lit(1))).collect())) == sorted(con.execute(_PHRASES_SQL).fetchall())


def test_scores_are_not_joined_by_broadcast(spark):
    """Parts of phrases are multiplied by the salts after Spark has taken their size."""
    found = materialize(spark.createDataFrame([([1, 2], 40), ([2, 3], 30)], "ids array<long>, f long"))
    parts = materialize(spark.createDataFrame([([i], 50) for i in (1, 2, 3)], "ids array<long>, f long"))
    scored = phrases._scored(found, parts)
    assert "BroadcastHashJoin" not in scored._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r["ids"]): r["score"] for r in scored.collect()} == {(1, 2): 800000, (2, 3): 600000}


def test_what_grows_is_not_broadcast(spark, monkeypatch):
    """Spark takes sizes of packed files, which are several times as large in the driver's memory."""
    plans = []
    write = phrases.materialize
    monkeypatch.setattr(phrases, "materialize", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, *a))
    docs = table(spark, [("one two three four five. one two three. " * 20, "en"), ("drei vier fünf. " * 20, "de")])
    assert phrases.phrases(docs, least=5).count()
    sent = [sum(x.split("BroadcastHashJoin [")[1].split("]")[0].split("#")[0] not in ("part", "lang") for x in p.splitlines() if "BroadcastHashJoin [" in x) for p in plans]
    assert len(plans) > 6 and not any(sent)
