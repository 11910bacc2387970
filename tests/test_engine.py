"""Operators of the evidence plan on hand-made rows."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quarry.binding import freshness_ranked, freshness_stored
from quarry.functions import text as T
from quarry.functions import url as U
from quarry.functions import vector as V
from quarry.operators import assembly, dedup, health, intent, planner, ranking, retrieval

CHUNK = (
    "query_id long, chunk_id string, ord long, source string, source_type string, url string, title string, summary string, author string, publish_date timestamp, content string, claim string, "
    "stance string, weight double, freshness double, surprise double, relevance double, confidence double, tokens long, local_score double, query_types array<string>, required_types array<string>"
)


def chunk(chunk_id: str, **over) -> tuple:
    row = {
        "query_id": 1, "chunk_id": chunk_id, "ord": 0, "source": "openalex", "source_type": "academic", "url": f"https://example.com/{chunk_id}", "title": chunk_id, "summary": None, "author": None,
        "publish_date": None, "content": f"{chunk_id} alpha bravo charlie delta echo", "claim": f"claim {chunk_id} unique statement", "stance": "secondary_analysis", "weight": 0.9, "freshness": 0.8,
        "surprise": 0.5, "relevance": 0.8, "confidence": 0.8, "tokens": 10, "local_score": 0.5, "query_types": [], "required_types": [],
    }
    return tuple((row | over).values())


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), CHUNK)


def clusters(spark, *rows, tau=0.85):
    c = frame(spark, *rows)
    links = dedup.edges(c, tau=tau)
    return {r.representative: r for r in dedup.representatives(c, dedup.components_by_query(c, links), links).collect()}


def test_exact_duplicates_keep_the_stronger(spark):
    got = clusters(spark, chunk("weak", content="same words here again", relevance=0.4), chunk("strong", content="same words here again", relevance=0.9))
    assert set(got) == {"strong"} and got["strong"]["size"] == 2 and got["strong"].level == "chunk"


def test_unrelated_chunks_stay(spark):
    got = clusters(spark, chunk("a", content="solar panels lower demand charges", claim="panels lower charges"), chunk("b", content="medieval trade routes crossed mountains", claim="routes crossed mountains"))
    assert set(got) == {"a", "b"} and all(r.level == "semantic" and r.novelty == 1 for r in got.values())


def test_equal_claims_in_other_words_are_claim_duplicates(spark):
    got = clusters(spark, chunk("a", content="first wording entirely about trains", claim="trains reduce traffic congestion"), chunk("b", content="second phrase speaks nothing alike", claim="trains reduce traffic congestion", relevance=0.5))
    assert set(got) == {"a"} and got["a"].level == "claim"


def test_chunks_of_one_document_merge(spark):
    got = clusters(spark, chunk("a", url="https://x.org/d", title="t"), chunk("b", url="https://x.org/d", title="t", content="zulu yankee", claim="other things entirely"))
    assert len(got) == 1 and next(iter(got.values())).level == "document"


def test_components_agree_with_the_general_form(spark):
    rng = random.Random(1)
    nodes = [(1, f"n{i:03d}") for i in range(60)]
    links = [(1, f"n{min(a, b):03d}", f"n{max(a, b):03d}") for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(35)) if a != b]
    n, e = spark.createDataFrame(nodes, "query_id long, chunk_id string"), spark.createDataFrame(links, "query_id long, a string, b string")
    assert sorted(dedup.components(n, e).collect()) == sorted(dedup.components_by_query(n, e).collect())


def test_prefix_filter_loses_no_pair(spark):
    rng = random.Random(2)
    sets = [(1, f"s{i:02d}", rng.sample("abcdefghijkl", rng.randint(0, 8))) for i in range(60)]
    got = {(r.a, r.b) for r in dedup.set_pairs(spark.createDataFrame(sets, "query_id long, chunk_id string, tokens array<string>"), 0.6).collect()}
    want = {(x[1], y[1]) for x in sets for y in sets if x[1] < y[1] and (x[2] or y[2]) and len(set(x[2]) & set(y[2])) >= 0.6 * len(set(x[2]) | set(y[2]))}
    empty = [s[1] for s in sets if not s[2]]
    assert got == want | {(min(empty), e) for e in empty if e != min(empty)}


def choose(spark, *rows, budget=4000):
    return {r.chunk_id: r for r in assembly.assemble(frame(spark, *rows), budget).collect()}


def test_budget_rejects_long_chunks(spark):
    got = choose(spark, chunk("short", tokens=15), chunk("long", tokens=500), budget=20)
    assert got["short"].decision == "selected" and got["long"].decision == "rejected"


def test_required_types_come_first(spark):
    need = ["government", "academic", "encyclopedic"]
    kinds = [("g", "government"), ("a", "academic"), ("e", "encyclopedic"), ("c", "code")]
    got = choose(spark, *(chunk(k, source_type=t, required_types=need, relevance=0.3 if k != "c" else 0.9, tokens=10, claim=f"{k} says {t}") for k, t in kinds), budget=30)
    assert {k for k, r in got.items() if r.decision == "selected"} == {"g", "a", "e"}


def test_near_zero_relevance_is_rejected(spark):
    got = choose(spark, chunk("x", relevance=0.02, source_type="government", required_types=["government"]))
    assert got["x"].decision == "rejected"


def test_ties_go_to_the_lesser_id(spark):
    got = choose(spark, chunk("b", claim="one two three four"), chunk("a", claim="five seven eight nine"), budget=10)
    assert got["a"].decision == "selected" and got["b"].decision == "rejected"


@pytest.mark.parametrize("seed", range(3))
def test_budget_is_never_exceeded(spark, seed):
    rng = random.Random(seed)
    rows = [chunk(f"c{i}", tokens=rng.randint(1, 300), relevance=rng.random(), claim=" ".join(rng.choices("alpha bravo charlie delta echoes foxtrot".split(), k=3))) for i in range(25)]
    got = assembly.assemble(frame(spark, *rows), 700).collect()
    tokens = {r[1]: r[18] for r in rows}
    assert sum(tokens[r.chunk_id] for r in got if r.decision == "selected") <= 700 and len(got) == 25


def test_prerank_keeps_one_a_url(spark):
    rows = ranking.one_per_duplicate_key(frame(spark, chunk("a", url="https://www.example.com/p/?utm=1", local_score=0.4), chunk("b", url="https://example.com/p#x", local_score=0.6))).collect()
    assert [(r.chunk_id, r.group_size) for r in rows] == [("b", 2)]


def test_diverse_top_k_covers_required_types(spark):
    need = ["academic", "government"]
    rows = [chunk("a1", local_score=0.9, required_types=need), chunk("a2", local_score=0.8, required_types=need), chunk("g", source="data_gov", source_type="government", local_score=0.3, required_types=need)]
    assert {r.chunk_id for r in ranking.diverse_top_k(frame(spark, *rows), 2).collect()} == {"a1", "g"}


def test_diverse_top_k_chooses_among_all(spark):
    """A source that fills the first ranks does not hide another one of its type."""
    rows = [chunk(f"a{i}", ord=i, source="arxiv", source_type="academic", local_score=0.9 - i * 1e-5, required_types=["news"]) for i in range(250)]
    rows += [chunk(f"o{i}", ord=300 + i, source="openalex", source_type="academic", local_score=0.85 - i * 1e-5, required_types=["news"]) for i in range(3)]
    rows += [chunk(f"r{i}", ord=400 + i, source="reddit", source_type="forum", local_score=0.4, required_types=["news"]) for i in range(5)]
    rows += [chunk("h", ord=500, source="hacker_news", source_type="forum", local_score=0.1, required_types=["news"])]
    got = [r.chunk_id for r in ranking.diverse_top_k(frame(spark, *rows), 3).orderBy("position").collect()]
    assert got == ["h", "a0", "o0"]


def test_nothing_plausible_is_rescued(spark):
    rows = frame(spark, *(chunk(f"c{i}", relevance=0.1, confidence=0.5) for i in range(5))).withColumn("combined", ranking.combined())
    assert ranking.keep_or_rescue(rows).count() == 0


def test_rescue_takes_the_best_plausible(spark):
    rows = frame(spark, *(chunk(f"c{i}", relevance=0.13 + i / 100, confidence=0.8, ord=i) for i in range(8))).withColumn("combined", ranking.combined())
    got = ranking.keep_or_rescue(rows).collect()
    assert {r.how for r in got} == {"rescued"} and {r.chunk_id for r in got} == {f"c{i}" for i in range(2, 8)}


def test_metadata_only_is_capped(spark):
    r = ranking.treat_extraction(frame(spark, chunk("m")).withColumn("status", F.lit("metadata_only"))).first()
    assert r.confidence <= 0.15 and r.claim is None and r.relevance <= 0.12 and r.stance == "speculation"


def intents(spark, types=(), required=()):
    return spark.createDataFrame([(1, list(types), list(required))], "query_id long, query_types array<string>, required_types array<string>")


NO_CLUSTERS = "query_id long, size long"


def test_health_without_evidence_is_insufficient(spark):
    got = health.health(intents(spark), frame(spark, chunk("x")).limit(0), spark.createDataFrame([], NO_CLUSTERS)).first()
    assert (got.status, got.quality, got.coverage) == ("insufficient", 0, 0)


def test_strong_health(spark):
    kinds = ["government", "academic", "filing"]
    rows = [chunk(f"c{i}", source=["data_gov", "openalex", "sec_edgar"][i % 3], source_type=kinds[i % 3], stance="primary_source", relevance=0.95, confidence=0.95, weight=0.95, freshness=1.0) for i in range(9)]
    got = health.health(intents(spark, ["source-attribution"], ["government", "academic"]), frame(spark, *rows), spark.createDataFrame([], NO_CLUSTERS)).first()
    assert got.status == "strong" and min(got.quality, got.coverage) >= 80


def test_missing_primary_lowers_authority(spark):
    got = health.health(intents(spark, ["source-attribution"]), frame(spark, chunk("x", source_type="forum", stance="opinion", weight=0.55)), spark.createDataFrame([], NO_CLUSTERS)).first()
    assert got.source_authority < 60


def test_hard_gap_asks_for_a_retry(spark):
    i = intents(spark, ["fresh-fact"], ["government"])
    s = frame(spark, chunk("x", source_type="forum", stance="opinion", relevance=0.9, weight=0.9))
    got = health.gaps(i, s, health.health(i, s, spark.createDataFrame([], NO_CLUSTERS))).first()
    assert got.critical and got.hard_gaps == ["government"] and got.action == "retry_retrieval" and "data_gov" in got.plan[0].target_sources


def test_healthy_evidence_with_soft_gaps_is_not_retried(spark):
    i = spark.createDataFrame([(1, "how are solar panels made", ["multi-hop"], ["academic", "encyclopedic"])], "query_id long, query string, query_types array<string>, required_types array<string>")
    s = frame(spark, *(chunk(f"c{n}", source=f"s{n}", content="how solar panels are made of cells", relevance=0.9, weight=0.9) for n in range(6)))
    h = spark.createDataFrame([(1, "adequate", 0)], "query_id long, status string, primary_sources long")
    got = health.gaps(i, s, h).first()
    assert not got.critical and (got.action, got.stop_reason, got.soft_gaps) == ("no_retry", "adequate_with_soft_gaps", ["encyclopedic"])


def test_keyword_only_chunks_call_for_a_retry(spark):
    i = spark.createDataFrame([(1, "crude inventory forecast brent outlook", ["fresh-fact"], ["academic"])], "query_id long, query string, query_types array<string>, required_types array<string>")
    s = frame(spark, chunk("k", content="a crude joke", relevance=0.3), chunk("low", content="none", relevance=0.1))
    h = spark.createDataFrame([(1, "adequate", 0)], "query_id long, status string, primary_sources long")
    got = health.gaps(i, s, h, spark.createDataFrame([(1, "data_gov", False), (1, "arxiv", True)], "query_id long, source string, ok boolean")).first()
    assert (got.low_ids, got.keyword_only_ids, got.failed_sources, got.missing_facets) == (["low"], ["k", "low"], ["data_gov"], ["official forecast", "supply-demand mechanism"]) and got.action == "retry_retrieval"
    assert health.gaps(i, s, h, round_=2).first().action == "synthesize_cautiously"


def test_reliability_moves_with_observations(spark):
    o = spark.createDataFrame([("s", "d", "government", "contradicted", 1), ("t", "d", "government", "confirmed", 1)], "source string, domain string, source_type string, kind string, ord long")
    got = {r.source: r.score for r in health.reliability(o).collect()}
    assert got["s"] < 0.95 < got["t"]


def test_urls(spark):
    u = spark.createDataFrame([("https://www.Example.com/A/?utm_source=x&q=1#f", "wikipedia"), ("https://arxiv.org/pdf/2101.00001.pdf", "arxiv"), ("not a url", "core"), ("https://data.gov/x?y=1", "data_gov")], "u string, s string")
    got = [r[0] for r in u.select(U.normalized_url(F.col("u"), F.col("s"))).collect()]
    assert got == ["https://www.example.com/A/?q=1", "https://arxiv.org/abs/2101.00001", "not a url", "https://data.gov/x"]


def test_freshness_buckets(spark):
    d = spark.createDataFrame([(None,), (datetime(2026, 1, 1),), (datetime(2024, 12, 20),), (datetime(2010, 1, 1),)], "d timestamp")
    now = "2025-01-01 00:00:00"
    assert [tuple(r) for r in d.select(freshness_stored(F.col("d"), now), freshness_ranked(F.col("d"), now)).collect()] == [(0.5, 0.55), (0.8, 1.0), (1.0, 1.0), (0.55, 0.45)]


def test_text_edges(spark):
    d = spark.createDataFrame([("",), ("   ",), ("one",), ("a b c",)], "t string")
    assert [r[0] for r in d.select(T.token_estimate(F.col("t"))).collect()] == [0, 0, 2, 4]
    assert d.select(T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))).first()[0] == 1.0
    assert d.select(T.fnv1a(F.lit("abc"))).first()[0] == 440920331


def test_chunk_sizes(spark):
    sentence = "Alpha bravo charlie delta echo foxtrot golf hotel india juliet. "
    got = spark.createDataFrame([(sentence * 20,)], "t string").select(F.explode(T.pack_chunks(F.col("t"), 15, 35))).collect()
    assert len(got) > 5 and "".join(r[0] for r in got).count("Alpha") == 20


def test_hash_embedding_is_unit(spark):
    v = spark.createDataFrame([("alpha bravo",), ("",)], "t string").select(V.hash_embedding()(F.col("t")).alias("v")).collect()
    assert sum(x * x for x in v[0].v) == pytest.approx(1) and sum(map(abs, v[1].v)) == 0


def test_plan_for_a_query(spark):
    q = spark.createDataFrame([(1, "Which SEC filing shows inflation risk?"), (2, "hello"), (3, "Why did crude prices fall?"), (4, "do squawk news reach bank desks first")], "query_id long, query string")
    i = intent.with_intent(q)
    rows = planner.sub_queries(planner.broadened(planner.first_plan(i))).orderBy("query_id", "ix").collect()
    assert {r.retrieval_intent for r in rows if r.query_id == 1} >= {"primary_evidence", "temporal", "contrarian"}
    assert all(0 < len(r.target_sources) <= 6 for r in rows) and any(r.query_id == 2 for r in rows)
    assert [r.target_sources for r in rows if r.query_id == 3][0] == ["official_docs", "data_gov"] and [r.target_sources for r in rows if r.query_id == 4][1] == ["official_docs", "sec_edgar"]
    t = intent.tasks(planner.sub_queries(planner.first_plan(i)), spark.createDataFrame([("wikipedia",)], "source string")).collect()
    assert {r.error for r in t if r.source == "crossref"} == {"SOURCE_HANDLER_MISSING"}


def test_one_common_term_retrieves(spark):
    items = spark.createDataFrame([("a", 1, "arxiv", "alpha words"), ("b", 2, "arxiv", "alpha bravo"), ("c", 3, "core", "alpha bravo"), ("d", 4, "arxiv", None), ("e", 5, "arxiv", "nothing here")], "id string, ord long, source string, text string")
    tasks = spark.createDataFrame([(1, 0, "arxiv", 1, "alpha bravo alpha"), (2, 0, "arxiv", 5, "alpha")], "query_id long, ix int, source string, max_results int, sub_query string")
    assert sorted(tuple(r) for r in retrieval.search(tasks, items).collect()) == [(1, 0, "arxiv", "b", 2), (2, 0, "arxiv", "a", 1), (2, 0, "arxiv", "b", 1)]


def test_similar_vectors_merge_below_a_type_limit(spark):
    import math

    turned = [1.0, 0.0], [0.9, math.sqrt(1 - 0.81)]
    for kinds, n in ((("academic", "academic"), 1), (("academic", "code"), 2)):  # 0.9 is enough within a type, not across
        rows = frame(spark, chunk("a", source_type=kinds[0], content="solar panels lower charges", claim="panels lower charges"), chunk("b", source_type=kinds[1], content="medieval routes crossed mountains", claim="routes crossed mountains"))
        rows = rows.withColumn("v", F.when(F.col("chunk_id") == "a", F.array(*map(F.lit, turned[0]))).otherwise(F.array(*map(F.lit, turned[1]))))
        links = dedup.edges(rows, "v")
        got = dedup.representatives(rows, dedup.components_by_query(rows, links), links).collect()
        assert len(got) == n and got[0].level == "semantic"


def test_repair_rounds_unite_what_they_find(spark):
    from quarry.plans import evidence

    text = "EIA short term energy outlook crude Brent forecast supply demand inventory " * 6
    items = [(f"i{n}", n, s, k, f"https://{s}.example.org/{n}", f"title {n}", None, None, f"{text} number{n} note{n}", None) for n, (s, k) in enumerate([("data_gov", "government"), ("openalex", "academic"), ("wikipedia", "encyclopedic"), ("stack_exchange", "forum")] * 3)]
    items = spark.createDataFrame(items, "id string, ord long, source string, source_type string, url string, title string, author string, publish_date timestamp, text string, summary string")
    asked = spark.createDataFrame([(1, "What does the outlook say on crude oil demand?"), (2, "medical zebra stripes")], "query_id long, query string")
    steps = evidence.run(asked, items)
    assert 1 < len(steps) <= 3
    seen = [{r.chunk_id for r in s.weighted.filter("query_id = 1").collect()} for s in steps if s.asked.filter("query_id = 1").count()]
    assert all(a <= b for a, b in zip(seen, seen[1:], strict=False)) and seen[0]
    last = evidence.final(steps, "health").collect()
    assert sorted(r.query_id for r in last) == [1, 2] and {r.status for r in last if r.query_id == 2} == {"insufficient"}
    assert {r["round"] for r in evidence.rounds(steps).collect()} == set(range(len(steps)))
