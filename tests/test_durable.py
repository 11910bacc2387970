"""Tables with several writers, scores that are cached, rounds that end in time, and pruned retrieval."""

from __future__ import annotations

import random
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import firsts, retrieval, stores, traces
from quarry.plans import evidence
from quarry.shared import collected, scratch_root


def counter(spark, path):
    return stores.Table(spark, str(path), "n long")


def together(*work):
    errors = []

    def guarded(f):
        try:
            f()
        except Exception as e:  # shown by the assertion
            errors.append(e)

    threads = [threading.Thread(target=guarded, args=(f,)) for f in work]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors, errors


def test_two_writers_lose_no_update(spark, tmp_path):
    t = counter(spark, tmp_path / "t")
    t.write(spark.range(1).select(F.lit(0).cast("long").alias("n")))

    def add():
        for _ in range(4):
            counter(spark, tmp_path / "t").update(lambda rows: rows.select((F.col("n") + 1).alias("n")))

    together(add, add, add)
    assert t.read().first().n == 12 and t.numbers() == list(range(13)) and len(t.folders()) <= 2


def test_compare_and_set_of_an_old_version_fails(spark, tmp_path):
    t = counter(spark, tmp_path / "t")
    old = t.version()
    assert t.compare_and_set(spark.range(3).toDF("n"), old) and not t.compare_and_set(spark.range(5).toDF("n"), old)
    assert t.read().count() == 3 and t.version().number == 0 and len(t.folders()) == 1


def test_appends_meet_compaction(spark, tmp_path):
    t = counter(spark, tmp_path / "t")

    def add(name):
        for i in range(6):
            t.append(spark.range(1).select(F.lit(1).cast("long").alias("n")), name, i)
            t.append(spark.range(1).select(F.lit(9).cast("long").alias("n")), name, i)  # the same batch again

    def merge():
        for _ in range(6):
            t.compact(lambda rows: rows.agg(F.sum("n").alias("n")), least=3)

    together(lambda: add("a"), lambda: add("b"), merge)
    assert t.read().agg(F.sum("n")).first()[0] == 12 and t.version().batches == {"a": 5, "b": 5}
    while len(t.version().folders) > 1:
        assert t.compact(lambda rows: rows.agg(F.sum("n").alias("n")), least=2)
    assert t.read().agg(F.sum("n")).first()[0] == 12


def test_a_stream_feeds_the_store_once(spark, tmp_path):
    rows = [(f"s{i % 3}", "d", "filing", ["confirmed", "contradicted", "repeated", "other"][i % 4], i) for i in range(40)]
    schema = "source string, domain string, source_type string, kind string, ord long"
    for i in range(4):
        spark.createDataFrame(rows[i * 10 : i * 10 + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    t = stores.Table(spark, str(tmp_path / "t"), stores.INCREMENTS)
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stores.feed(read(), t, "seen", str(tmp_path / "c1"))
    stores.feed(read(), t, "seen", str(tmp_path / "c2"))  # its checkpoint was lost: the batches are known
    empty = spark.createDataFrame([], "source string, domain string, alpha double, beta double, observations long")
    want = {(r.source, round(r.alpha, 6), round(r.beta, 6), r.observations) for r in stores.updated_reliability(empty, spark.createDataFrame(rows, schema)).collect()}
    assert {(r.source, round(r.alpha, 6), round(r.beta, 6), r.observations) for r in stores.reliability_of(t.read()).collect()} == want


def made_items(spark, n=12):
    text = "EIA short term energy outlook crude Brent forecast supply demand inventory " * 6
    kinds = [("data_gov", "government"), ("openalex", "academic"), ("wikipedia", "encyclopedic"), ("stack_exchange", "forum")]
    rows = [(f"i{i}", i, *kinds[i % 4], f"https://{kinds[i % 4][0]}.example.org/{i}", f"title {i}", None, None, f"{text} number{i} note{i}", None) for i in range(n)]
    return spark.createDataFrame(rows, "id string, ord long, source string, source_type string, url string, title string, author string, publish_date timestamp, text string, summary string")


def asked(spark):
    return spark.createDataFrame([(1, "What does the outlook say on crude oil demand?"), (2, "medical zebra stripes")], "query_id long, query string")


def test_a_second_run_scores_only_what_is_new(spark, tmp_path):
    cache = stores.Table(spark, str(tmp_path / "cache"), stores.CACHE)
    items = made_items(spark)
    plain = evidence.Evidence(asked(spark), items).rated.select("chunk_id", "relevance", "confidence", "combined").collect()
    first = evidence.Evidence(asked(spark), items.filter("ord < 8"), cache=cache)
    first.rated.count()
    second = evidence.Evidence(asked(spark), items, cache=cache)
    assert sorted(map(tuple, second.rated.select("chunk_id", "relevance", "confidence", "combined").collect())) == sorted(map(tuple, plain))
    was, now = first.cache_use.first(), second.cache_use.first()
    assert was.hits == 0 and was.misses > 0 and now.hits == was.misses and now.misses == len(plain) - was.misses and now.batches == -(-now.misses // 8)
    third = evidence.Evidence(asked(spark), items, cache=cache)
    third.rated.count()
    assert (third.cache_use.first().hits, third.cache_use.first().misses) == (len(plain), 0)


def test_the_least_recently_used_scores_go(spark):
    cache = spark.createDataFrame([("a", 0.1, 0.1, 5), ("b", 0.2, 0.2, 4), ("c", 0.3, 0.3, 3)], stores.CACHE)
    chunks = spark.createDataFrame([(1, "c", 0), *((1, f"n{i}", i) for i in range(1, 4))], "query_id long, key string, ord long")
    rate = lambda rows: rows.withColumn("relevance", F.lit(0.5)).withColumn("confidence", F.lit(0.6))
    scored = stores.cached_scores(chunks, cache, rate, batch=2)
    assert {r.key: (r.hit, r.turn, r.relevance) for r in scored.collect()} == {"c": (True, 0, 0.3), "n1": (False, 1, 0.5), "n2": (False, 1, 0.5), "n3": (False, 2, 0.5)}
    assert [(r.key, r.used_at) for r in stores.cache_used(cache, scored, most=5).collect()] == [("n3", 8), ("n1", 7), ("n2", 7), ("c", 6), ("a", 5)]


def test_a_slow_round_is_cancelled_and_the_one_before_stays(spark, monkeypatch):
    plan = evidence.Evidence.next_plan

    def slow(self):
        @F.udf("boolean")
        def wait(_):
            time.sleep(120)
            return True

        return plan(self).filter(wait("query_id"))

    monkeypatch.setattr(evidence.Evidence, "next_plan", slow)
    began = time.monotonic()
    steps = evidence.run(asked(spark), made_items(spark), evidence.EngineConf(repair_seconds=2))
    assert len(steps) == 1 and time.monotonic() - began < 100
    retried = [r.query_id for r in evidence.Evidence(asked(spark), made_items(spark)).gaps.filter("action = 'retry_retrieval'").collect()]
    gaps = {r.query_id: r for r in evidence.final(steps, "gaps").collect()}
    assert retried and all(gaps[q].action == "synthesize_cautiously" and any("2 s repair time budget" in x for x in gaps[q].reasons) for q in retried)
    assert evidence.final(steps, "selected").filter("query_id = 1").count() > 0


def test_a_deadline_ends_only_its_own_jobs(spark):
    @F.udf("long")
    def wait(x):
        time.sleep(0.5)
        return x

    slow = spark.range(0, 200, 1, 4).select(wait("id").alias("id"))
    with pytest.raises(traces.DeadlineReached), traces.Deadline(spark, 1):
        slow.agg(F.sum("id")).collect()
    assert spark.range(10).count() == 10
    with traces.Deadline(spark, 60):
        assert spark.range(5).count() == 5
    with pytest.raises(ZeroDivisionError), traces.Deadline(spark, None):
        raise ZeroDivisionError


def test_a_finished_round_keeps_few_tables(spark):
    with collected() as made:
        step = evidence.Evidence(asked(spark), made_items(spark)).finish()
    kept = [p for p in made if spark.sparkContext._jvm.java.io.File(p.removeprefix("file:")).exists()]
    assert len(kept) <= 7 and kept[0].startswith(scratch_root(spark))
    assert step.selected.count() > 0 and step.scored.count() > 0


def brute_search(tasks, items):
    from quarry.dims import SCORE_STOPWORDS

    words = lambda t: {w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in (t or "").lower()).split() if len(w) > 3}
    out = []
    for query_id, ix, source, most, text in tasks:
        asked_words = words(text) - set(SCORE_STOPWORDS)
        scored = sorted((-len(asked_words & words(t)), o, i) for i, o, s, t in items if s == source)
        out += [(query_id, ix, source, i, -n) for n, o, i in [x for x in scored if x[0] < 0][:most]]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 7])
def test_search_matches_brute_force(spark, monkeypatch, block):
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(40)] + ["common"] * 20
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(f"i{o}", o, "hot" if o % 3 else f"s{o % 5}", text(rng.randint(0, 40))) for o in range(3000)] + [("null", 3001, "hot", None), ("none", 3002, None, "word1")]
    tasks = [(q, ix, rng.choice(["hot", "s0", "s1", "unknown"]), rng.choice([0, 1, 3, 12]), text(rng.randint(0, 9))) for q in range(12) for ix in range(2)]
    df = spark.createDataFrame(items, "id string, ord long, source string, text string").repartition(3)
    asked_ = spark.createDataFrame(tasks, "query_id long, ix int, source string, max_results int, sub_query string")
    assert sorted(map(tuple, retrieval.search(asked_, df, block).collect())) == brute_search(tasks, items)
    assert retrieval.search(asked_.limit(0), df).count() == 0 and retrieval.search(asked_, df.limit(0)).count() == 0


def test_bounds_leave_out_stretches():
    import pyarrow as pa

    known = retrieval.index([{"source": "s", "terms": ["a", "b", "c"]}, {"source": "s", "terms": ["a"]}])["s"]
    best = retrieval.Best(np.array([1, 1]))
    for n, words in enumerate([[["a", "b"]], [["a"]], [["c", "z"]], [["c", "b", "a"]]]):
        best.scan(known, pa.array(words), np.array([n]), pa.array([f"i{n}"]))
        best.cut()
    assert best.ids == ["i3", "i0"] and best.skipped == 2 and best.looked == 5


def test_recorded_responses_as_a_data_source(spark, tmp_path):
    from quarry.sources import recorded

    rows = [(i, i % 3, ["core", "a b/c", "github"][i % 3], None if i % 4 == 0 else f'{{"x": "é{i}"}}', "HTTP_429" if i % 5 == 0 else None) for i in range(60)]
    folder = str(tmp_path / "r")
    recorded.record(spark.createDataFrame(rows, recorded.SCHEMA).repartition(2), folder)
    for split in ("67108864", "100", "1"):
        assert sorted(map(tuple, recorded.read_recorded(spark, folder, splitBytes=split).collect()), key=repr) == sorted(rows, key=repr)
    core = recorded.read_recorded(spark, folder).filter("source = 'core' AND query_id > 5")
    assert sorted(r.query_id for r in core.collect()) == [i for i in range(6, 60) if i % 3 == 0]
    assert recorded.read_recorded(spark, folder).filter("source IN ('core', 'github')").count() == 40 and recorded.read_recorded(spark, folder).filter("source = 'none'").count() == 0
    (tmp_path / "r" / "source=bad").mkdir()
    (tmp_path / "r" / "source=bad" / "x.json").write_bytes(b'{"query_id": 1}\nno json\n[1]\n\n{"query_id": "x"}\n\xff\xfe\n{"query_id": 2, "payload": "p"}')
    got = recorded.read_recorded(spark, folder).filter("source = 'bad'").collect()
    assert sorted((r.query_id or 0, r.code or "", r.payload or "") for r in got) == sorted([(1, "", ""), (2, "", "p")] + [(0, "MALFORMED_RECORD", "")] * 4)


def test_filters_on_the_source_prune_folders():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    from quarry.sources.recorded import RecordedReader

    r = RecordedReader("unused", 1)
    left = list(r.pushFilters([EqualTo(("source",), "a"), GreaterThan(("query_id",), 3), In(("source",), ("a", "b"))]))
    assert r.sources == {"a"} and left == [GreaterThan(("query_id",), 3)]


@pytest.mark.parametrize("block", [1024, 16])
def test_first_similar_equals_the_sequence(spark, block):
    rng = np.random.default_rng(3)
    rows = [(int(i), None if g == 2 else g, rng.normal(size=3).tolist()) for i, g in zip(rng.permutation(600), rng.choice([0, 0, 0, 1, 2], 600), strict=True)]
    rows = [(i, None if g is None else int(g), v) for i, g, v in rows]
    want = []
    for group in (0, 1, None):
        done: list[tuple[np.ndarray, int]] = []
        for i, _, v in sorted(r for r in rows if r[1] == group):
            v = np.array(v) / np.linalg.norm(v)
            near = [c for u, c in done if u @ v >= 0.9]
            done.append((v, min(near) if near else max((c for _, c in done), default=-1) + 1))
            want.append((i, group, done[-1][1]))
    df = spark.createDataFrame([*rows, (None, 0, [1.0, 0.0, 0.0]), (9999, 0, None)], "id long, g int, v array<double>")
    assert sorted(map(tuple, firsts.first_similar(df, "id", "g", "v", 0.9, block).collect())) == sorted(want)
    assert firsts.first_similar(df.limit(0), "id", "g", "v", 0.9).count() == 0


def test_stages_of_a_real_run_are_told(spark):
    trace = traces.Trace(spark, "r1")
    steps = evidence.run(asked(spark), made_items(spark), trace=trace)
    told = {r.stage: r for r in trace.stages().collect()}
    assert {f"{s}:{n}" for n in range(len(steps)) for s in ("hits", "fetched", "scored", "selection", "gaps")} <= set(told)
    assert told["intents:0"].counts == {"rows": 2} and told["scored:0"].counts["tokens"] > 0 and all(r.ms >= 0 for r in told.values())
    events = traces.stage_events(trace.stages()).filter("stage = 'intents:0'").orderBy("n").collect()
    assert [e.type for e in events] == ["stage_start", "counts", "stage_complete"] and events[1].message == "rows=2" and events[0].at <= events[2].at
    with pytest.raises(ZeroDivisionError), trace.stage("fails"):
        raise ZeroDivisionError
    assert trace.frame().filter("stage = 'fails'").count() == 1


def test_nested_payloads_are_walked(spark):
    import json

    from quarry.sources import curated

    deep = {"a": [{"url": "https://one", "title": " ", "name": "One", "kids": [{"uri": "HTTP://two"}, {"url": 5, "uri": "https://three"}]}, {"url": "ftp://no"}, {"url": "https://one", "title": "later"}]}
    many = [{"url": f"https://h/{i}"} for i in range(20)]
    nested = 1
    for _ in range(900):
        nested = [nested]
    texts = {"x": [{"text": "t" * 41}, {"text": "short"}, {"text": "t" * 41}, *({"text": str(i) * 50} for i in range(5))]}
    rows = [("openai", "1", json.dumps(deep)), ("claude", "2", json.dumps(many)), ("gemini", "3", json.dumps(texts)), ("openai", "4", json.dumps({"output_text": "said", "text": "z" * 90})), ("openai", "5", "{oops"), ("openai", "6", None), ("claude", "7", json.dumps({"content": [nested, {"type": "text", "text": "c"}]})), ("gemini", "8", "7")]
    got = {r.question_id: r for r in curated.provider_answers(spark.createDataFrame(rows, "engine string, question_id string, payload string")).collect()}
    assert [tuple(x) for x in got["1"].sources] == [("https://one", "One"), ("HTTP://two", "HTTP://two"), ("https://three", "https://three")] and got["1"].answer == ""
    assert [x.url for x in got["2"].sources] == [f"https://h/{i}" for i in range(12)]
    assert got["3"].answer == "\n\n".join(["t" * 41, *(str(i) * 50 for i in range(3))]) and got["4"].answer == "said"
    assert [got[i].mode for i in "45678"] == ["live", "malformed", "missing", "live", "live"] and got["7"].answer == "c"
