"""Extraction, gold scores, answers, costs, stores, models and text against brute force on hand-made rows."""

from __future__ import annotations

import json
import random
import re
import unicodedata
from urllib.parse import quote

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry import cli
from quarry.functions import text as T
from quarry.functions import vector as V
from quarry.functions.vector import in_blocks
from quarry.operators import answers, assembly, dedup, extraction, gold, models, planner, ranking, stores, traces
from quarry.sources import connectors, curated, files
from tests.test_engine import chunk, frame

ITEM = "id string, ord long, group_id long, source string, source_type string, url string, title string, author string, publish_date timestamp, text string, summary string"


def item(i: int, source: str, kind: str, url: str, text: str, title: str = "t") -> tuple:
    return (f"i{i}", i, 1, source, kind, url, title, None, None, text, None)


def test_documents_take_the_best_attempt(spark):
    long = "<html><body><nav>menu</nav><article><p>" + "page words " * 200 + "</p></article></body></html>"
    items = [
        item(1, "openalex", "academic", "https://a.org/x?utm_source=z", "short"), item(2, "crossref", "academic", "https://a.org/x", "a longer text of the same page"),
        item(3, "data_gov", "government", "https://b.org/none", "words " * 80), item(4, "github", "code", "https://github.com/o/r", "r"), item(5, "wikipedia", "encyclopedic", "https://c.org/full", "words " * 300), item(6, "arxiv", "academic", "https://d.org/abs", "words " * 80, "other"),
        item(7, "hacker_news", "tech_discussion", "https://e.org/empty", "", ""),
    ]
    pages = [("https://a.org/x#top", long), ("https://c.org/full", "<p>never looked at</p>"), ("https://d.org/abs", "<p>less</p>")]
    got = {r.item_id: r for r in extraction.documents(spark.createDataFrame(items, ITEM), spark.createDataFrame(pages, "url string, html string")).collect()}
    assert set(got) == {"i2", "i3", "i4", "i5", "i6", "i7"} and got["i2"]["items"] == 2
    assert (got["i2"].status, got["i2"].method, got["i2"].text[:10], "menu" in got["i2"].text) == ("full_text", "readable_html", "page words", False)
    assert [(got[k].status, got[k].attempts, got[k].deepened) for k in ("i3", "i4", "i5", "i6", "i7")] == [("snippet", 2, True), ("snippet", 1, False), ("full_text", 1, False), ("structured_abstract", 2, True), ("metadata_only", 2, True)]
    assert got["i5"].degradation_reason is None and "abstract" in got["i6"].degradation_reason
    few = extraction.documents(spark.createDataFrame(items, ITEM), spark.createDataFrame(pages, "url string, html string"), most=1).filter("deepened").collect()
    assert [r.item_id for r in few] == ["i2"]
    assert extraction.documents(spark.createDataFrame([], ITEM), spark.createDataFrame(pages, "url string, html string")).count() == 0


def test_main_text():
    assert extraction.main_text("<body><header>h</header><main>a <b>b</b>&amp;c<script>x</script></main><p>d</p></body>") == "a b &c"
    assert extraction.main_text("<p>a</p><style>s</style><p>b</p>") == "a b" and extraction.main_text(None) == "" and extraction.main_text("<<not html") != ""


def test_normalized_text_decomposes(spark):
    texts = ["Café Ünïted ＡＢＣ ﬁne ½ x", "plain ASCII, text!", "漢字 éa", "", None, "ÅNGSTRÖM/path:ok"]
    want = [None if t is None else re.sub(r"\s+", " ", re.sub(r"[^A-Za-z0-9_\s./:-]+", " ", unicodedata.normalize("NFKD", t.lower()))).strip() for t in texts]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.normalized_text(F.col("t")).alias("n"), T.folded(F.col("t")).alias("f")).orderBy("i").collect()
    assert [r.n for r in got] == want
    assert [r.f for r in got][1:2] + [r.f for r in got][5:] == want[1:2] + want[5:]


def test_matched_questions_fold_quotes(spark):
    rows = spark.createDataFrame([("What’s  “new” – Now?",), ("what's \"new\" - now?",)], "t string")
    a, b = (r[0] for r in rows.select(T.matched_question(F.col("t"))).collect())
    assert a == b


def test_matched_questions_are_composed_once_and_only_beyond_ascii(spark, tmp_path):
    """One Python operator a side: a pushed filter computed every key twice, in workers of their own."""
    from quarry.plans import evaluation

    texts = ["plain ASCII ", "ﬁne Ⅳ caſe", "Cafe\u0301", None, "", "line\u2028", "a\nb\u0085"] * 300
    spark.createDataFrame([(i, i % 3, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(7, "FINE iv case"), (8, "caf\u00e9"), (9, None), (10, "Plain  ascii")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    found = evaluation.f21(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    key = lambda t: re.sub(r"[ \t\n\r\f\x0b]+", " ", unicodedata.normalize("NFKC", t)).strip(" ").lower()
    known = {key(t): i for i, t in ((7, "FINE iv case"), (8, "café"), (10, "Plain  ascii"))}
    want = sorted([(i, i % 3, known[key(t)]) for i, t in enumerate(texts) if t is not None and key(t) in known] + [(i, -1, i) for i in (7, 8, 10)])
    assert len(want) == 903 and sorted(map(tuple, found.collect())) == want
    assert len(re.findall("ArrowEvalPython", plan)) == 2


def brute_compact(query: str, most: int = 220, encoded: int = 256) -> str:
    words, seen = [], set()
    for w in re.split(r"[^a-zA-Z0-9_.#+-]+", re.sub("[\"'`“”‘’]", " ", query)):
        if len(w) > 1 and w.lower() not in connectors.SEARCH_STOP and w.lower() not in seen:
            seen.add(w.lower())
            words.append(w)
    worth = lambda w: min(12, len(w)) + 20 * bool(re.search(connectors.FIRST, w)) + 10 * bool(re.search(connectors.SECOND, w)) + 4 * bool(re.search(r"[._#+-]", w))
    out: list[str] = []
    for w in sorted(words, key=lambda w: -worth(w)):
        said = " ".join([*out, w])
        if len(said) <= most and len(quote(said, safe="~()*!.'")) <= encoded:
            out.append(w)
    return " ".join(out) or "secure software development appsec testing"


def test_compact_query_matches_brute_force(spark):
    rng = random.Random(3)
    pool = "owasp Testing c++ node.js the and repository alpha bravo charlie supercalifragilistic x y2 C# semgrep framework what's".split()
    texts = [" ".join(rng.choices(pool, k=rng.randint(0, 60))) + " " + " ".join(f"w{rng.randrange(999)}" for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["", "the and of"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", connectors.compact_query(F.col("t")).alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == [brute_compact(t) for t in texts]


def fnv(text: str) -> int:
    h = 2166136261
    for c in text.encode("utf-16-le")[::2]:
        h = ((h ^ c) * 16777619) % 2**32
    return h


def test_hash_embeddings_match_brute_force(spark):
    texts = ["alpha Bravo alpha x it's", "", "zz 12 a.b-c", "one two three four"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", V.hash_embedding()(F.col("t")).alias("a"), V.signed_hash_embedding()(F.col("t")).alias("b")).orderBy("i").collect()
    for r, t in zip(got, texts, strict=True):
        a, b = np.zeros(256), np.zeros(128)
        for w in re.sub(r"[^a-z0-9\s.-]", " ", t.lower()).split():
            if len(w) > 2:
                a[fnv(w) % 256] += 1
                for g in [w[i : i + 3] for i in range(max(1, len(w) - 2))]:
                    a[fnv("g:" + g) % 256] += 0.3
        words = re.findall(r"[a-z0-9]+(?:'[a-z0-9]+)?", t.lower())
        parts = [(w, 1 + min(len(w) / 12, 0.6)) for w in words] + [(f"^{w}$"[i : i + 3], 0.28) for w in words for i in range(len(w))] + [(f"{x} {y}", 0.7) for x, y in zip(words, words[1:], strict=False)]
        for k, v in parts:
            b[fnv(k) % 128] += v if fnv("s:" + k) % 2 == 0 else -v
        for want, found in ((a, r.a), (b, r.b)):
            n = np.linalg.norm(want)
            assert np.allclose(found, want / n if n else want)


@pytest.mark.parametrize("seed", range(4))
def test_diverse_choice_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    need = rng.sample(["academic", "government", "news", "primary-document", "forum"], 2)
    kinds = {"arxiv": "academic", "openalex": "academic", "data_gov": "government", "hacker_news": "tech_discussion", "stack_exchange": "forum"}
    rows = [chunk(f"c{i:02d}", ord=i, source=(s := rng.choice(list(kinds))), source_type=kinds[s], stance=rng.choice(["opinion", "primary_source"]), local_score=rng.randrange(20) / 20, required_types=need) for i in range(40)]
    at = {n: i for i, n in enumerate(("query_id", "chunk_id", "ord", "source", "source_type"))}
    fits = lambda r, k: (r[12] == "primary_source" or r[4] in ("government", "filing", "structured_fact", "medical")) if k == "primary-document" else r[3] == "hacker_news" if k == "news" else r[4] == k
    left, taken = sorted(rows, key=lambda r: (-r[19], r[at["ord"]])), []
    for k in need:
        if found := next((r for r in left if r not in taken and fits(r, k)), None):
            taken.append(found)
    while len(taken) < 8:
        open_ = [k for k in need if not any(fits(t, k) for t in taken)]
        value = lambda r: r[19] * 0.82 ** (r[3] in {t[3] for t in taken}) * 0.9 ** (r[4] in {t[4] for t in taken}) + 0.08 * any(fits(r, k) for k in open_)  # noqa: B023, E731
        taken.append(max((r for r in left if r not in taken), key=lambda r: (value(r), -left.index(r))))
    got = ranking.diverse_top_k(frame(spark, *rows), 8).orderBy("position").collect()
    assert [r.chunk_id for r in got] == [r[1] for r in taken]


def test_links_of_few_chunks_equal_the_general_form(spark):
    rng = random.Random(8)
    base = [" ".join(rng.choices("alpha bravo charlie delta echoes foxtrot golfing hotels india juliet".split(), k=n)) for n in (0, 3, 6, 9)]
    rows = [chunk(f"c{i:02d}", url=f"https://x.org/{rng.randrange(12)}", title=rng.choice(["t", "u"]), source=rng.choice(["core", "arxiv"]), source_type=rng.choice(["academic", "code"]), content=rng.choice(base) + rng.choice(["", " extra"]), claim=rng.choice([None, *base])) for i in range(30)]
    f = frame(spark, *rows).withColumn("v", V.hash_embedding()(F.col("content")))
    assert sorted(map(tuple, dedup.edges(f, "v", 0.8).collect())) == sorted(map(tuple, dedup.edges_by_query(f, "v", 0.8).collect()))


def test_final_gains_against_the_selection(spark):
    rows = [chunk("a", claim="alpha bravo charlie"), chunk("b", claim="alpha bravo delta"), chunk("c", claim="other words entirely")]
    selection = spark.createDataFrame([(1, "a", "selected"), (1, "c", "selected"), (1, "b", "rejected")], "query_id long, chunk_id string, decision string")
    got = {r.chunk_id: r.gain for r in assembly.final_gains(frame(spark, *rows), selection).collect()}
    assert got == {"a": 0.72, "b": pytest.approx(0.72 / 3, abs=1e-4), "c": 0.72}


def test_gold_scores_and_blocked_rows(spark):
    sources = "array<struct<source_name:string,source_type:string,url:string,title:string,provenance:string>>"
    a = [("e", "Q1", "Debt rose and inflation fell. " + "x" * 90 + ". It used insider news.", []), ("f", "Q1", "debt", [("sec_edgar", "filing", "u", "t", "primary")]), ("g", "Q1", " ", []), ("h", "Q9", "debt", []), ("i", "Q2", "debt", [])]
    g = [("Q1", True, [("Debt rises", ["debt"]), ("Nothing else", ["zebra"])], ["government", "filing"], ["insider news"]), ("Q2", False, [], [], [])]
    frame_ = spark.createDataFrame(a, f"engine string, question_id string, answer string, sources {sources}")
    known = spark.createDataFrame(g, "question_id string, valid boolean, facts array<struct<text:string,keywords:array<string>>>, required array<string>, penalties array<string>")
    got = {r.engine: r for r in gold.score(frame_, known).collect()}
    assert [got[k].score_status for k in "efghi"] == ["scored", "scored", "scoring_unavailable", "blocked_missing_gold", "blocked_invalid_gold"]
    assert (got["e"].facts_hit, got["e"].facts_total, got["e"].required_hit, got["e"].penalties_hit, len(got["e"].unsourced)) == (1, 2, 0, ["insider news"], 1) and got["f"].required_hit == 2
    strict = {r.engine: r for r in gold.score(frame_, known, strict=True).collect()}
    assert (strict["e"].facts_hit, strict["f"].required_hit, strict["f"].primary_sources) == (1, 1, 1)


def test_comparative_parts_and_reviews(spark):
    rows = [chunk("r", claim="rank fusion helps", relevance=0.9), chunk("c", claim="a cross-encoder reranker", relevance=0.8), chunk("o", claim="solar panels", relevance=0.95)]
    p = answers.comparative_parts(frame(spark, *rows)).first()
    assert (p.fusion_chunk, p.reranker_chunk, p.support) == ("r", "c", ["r", "c"]) and p.narrow


def test_versions_of_a_store(spark, tmp_path):
    t = stores.Table(spark, str(tmp_path / "store"), "source string, domain string, alpha double, beta double, observations long")
    seen = spark.createDataFrame([("s", "d", "government", "confirmed", 1)], "source string, domain string, source_type string, kind string, ord long")
    assert t.read().count() == 0
    for n in (1, 2, 3, 4):
        t.write(stores.updated_reliability(t.read(), seen))
        assert t.read().first().observations == n and len(t.folders()) <= 2
    assert t.read().first().alpha == pytest.approx(6 * 0.95 + 4)


def test_model_calls_repair_and_never_raise(spark):
    assert models.parse_output('say ```json\n[1, 2]\n``` ok') == [1, 2] and models.parse_output("none") is None and models.parse_output('x {"a": [1]} y') == {"a": [1]}
    tries: list[dict] = []

    def provider(asked: dict) -> str:
        if "error" in asked and asked["error"].startswith("missing") and asked["last"]:
            return '{"final_answer": "f", "cited_chunk_ids": []}'
        return '{"final_answer": "f"}'

    p = spark.createDataFrame([(1, "synthesis", "p")], "key long, task string, prompt string")
    got = models.call(p, provider, models.SCHEMAS["synthesis"], attempts=9).first()
    assert (got.attempts, got.ok, got.output.final_answer) == (2, True, "f") and not tries
    assert models._top_level(models.SCHEMAS["scoring"]) == [models.SCHEMAS["scoring"]]


def test_curated_documents_fall_back_to_all(spark):
    q = spark.createDataFrame([(1, "zebra", 3), (2, "owasp asvs verification", 2)], "query_id long, sub_query string, max_results int")
    got = curated.official(q).collect()
    assert [r.doc_id for r in got if r.query_id == 1] == ["sec-market-structure", "sec-edgar-access", "fed-fomc-calendar"] and [r.doc_id for r in got if r.query_id == 2][0] == "owasp-asvs"
    assert {r.id for r in curated.made_up(spark.createDataFrame([(1, "why")], "query_id long, query string")).collect()} == {"mock:cbo", "mock:academic", "mock:discussion"}


def test_heartbeat_frames_and_shapes(spark):
    e = traces.trace_shape(spark.createDataFrame([(1, 0, "weak", 40), (1, 1, "strong", 90)], "query_id long, round int, status string, quality long")).first()
    assert (e.rounds, e.first_status, e.last_status, e.quality) == (2, "weak", "strong", 90)
    t = traces.Trace(spark, "run")
    with t.stage("fetch"):
        pass
    assert t.frame().first().stage == "fetch"


def test_plans_without_unavailable_sources(spark):
    p = spark.createDataFrame([(1, [("a", ["core", "arxiv"], "temporal", 3), ("b", ["core"], "temporal", 3)])], f"query_id long, plan array<{planner.ROW}>")
    assert [r.target_sources for r in planner.sub_queries(planner.without(p, F.array(F.lit("core")))).collect()] == [["arxiv"]]


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["plugins", "list"], spark) == 0 and len(capsys.readouterr().out.splitlines()) == 14
    (tmp_path / "m.json").write_text(json.dumps({"id": "Bad Id", "label": ""}))
    assert cli.main(["plugins", "doctor", "--manifests", str(tmp_path / "m.json")], spark) == 1
    (tmp_path / "r").mkdir()
    (tmp_path / "r/a.json").write_text('{"results": [{"engine": "e", "question_id": "Q1"}]}')
    capsys.readouterr()
    assert cli.main(["compare", str(tmp_path / "r")], spark) == 0 and json.loads(capsys.readouterr().out)["engine"] == "e"
    c = cli.conf_from_env({"QUARRY_MODE": "quality", "QUARRY_TOKEN_BUDGET": "-1", "QUARRY_SOURCES": "arxiv, nope"})
    assert (c.mode, c.token_budget, c.preferred, c.max_rounds) == ("quality", 4000, ("arxiv",), 4) and cli.conf_from_env({"QUARRY_MODE": "odd"}).mode == "balanced"


def test_run_records_by_day(spark, tmp_path):
    runs = spark.createDataFrame([("a", "x" * 9), ("b", "y")], "run_id string, answer string")
    files.write_runs(runs, str(tmp_path / "runs"), longest=5)
    got = files.read_runs(spark, str(tmp_path / "runs"), "run_id string, answer string", run_id="a").collect()
    assert [(r.run_id, r.answer) for r in got] == [("a", "xxxxx")]


def test_gold_drafts_as_csv(spark, tmp_path):
    (tmp_path / "g.csv").write_text('question,section,id,text,keywords,weight\nQ1,Facts,f1,"a fact, whole",one; two,2\nQ1,sources,s1,government,,\nQ1,penalties,p1,insider news,,x\nQ2,sources,s1,news,,\n')
    g = {r.question_id: r for r in files.gold_of_records(files.read_gold_csv(spark, str(tmp_path / "g.csv"))).collect()}
    assert [tuple(f) for f in g["Q1"].facts] == [("a fact, whole", ["one", "two"])] and (g["Q1"].required, g["Q1"].penalties, g["Q1"].valid, g["Q2"].valid) == (["government"], ["insider news"], True, False)


def test_tools_and_an_own_source(spark):
    from examples import company_docs
    from quarry import facade

    docs = spark.createDataFrame([("a/b", "Oil outlook", "EIA short term energy outlook crude Brent forecast supply demand", None)], "path string, title string, body string, changed timestamp")
    items = company_docs.items(docs)
    assert items.columns == ["id", "ord", "source", "source_type", "url", "title", "author", "publish_date", "text", "summary"]
    known = spark.createDataFrame([("company_docs",), ("arxiv",)], "id string")
    assert facade.plugin_diagnostics(spark.createDataFrame([company_docs.MANIFEST], "id string, label string"), known).count() == 0
    asked = spark.createDataFrame([(1, "crude oil outlook demand")], "query_id long, query string")
    t = facade.Tools(asked, items.withColumn("source", F.lit("data_gov")).withColumn("source_type", F.lit("government")), facade.EngineConf(mode="fast"))
    assert [r.source for r in t.evidence().collect()] == ["data_gov"] and "[" in t.search().first().answer and t.trace().first().status
    assert t.sources().count() == 14 and set(cli.adapters(t)) == {"search", "evidence", "trace", "sources"}
    results = spark.createDataFrame([("core", True, 5), ("core", False, 7)], "source string, ok boolean, timing_ms long")
    assert tuple(t.source_health(results).first()) == ("core", 2, 1, 1, 12)
    costs = spark.createDataFrame([("fetch", "m", 5, 0.5), ("score", "m", 7, 0.25)], "stage string, model string, tokens long, cost double")
    assert {(r.stage, r.model): r.cost for r in t.cost(costs).collect()} == {(None, None): 0.75, ("fetch", None): 0.5, ("score", None): 0.25, (None, "m"): 0.75}


def test_vectors_are_compared_in_cells_without_a_join(spark):
    rng = np.random.default_rng(3)
    vectors = {i: rng.normal(size=8).round(2).tolist() for i in range(300)}
    vectors |= {7: vectors[50], 8: vectors[50], 9: [0.0] * 8, 10: None, 11: [1.0] * 5, 12: [None, *vectors[12][1:]], 100: vectors[150]}
    rows = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").repartition(4)

    def like(a, b):
        if not a or not b or len(a) != len(b) or None in a or None in b or not any(a) or not any(b):
            return 0.0
        x, y = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
        return float(x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)))

    asked = [i for i in vectors if i % 50 == 0]
    all_ = sorted((q, k, like(vectors[q], v)) for q in asked for k, v in vectors.items() if k != q)
    found = in_blocks(rows.filter("vec_id % 50 = 0"), rows, "vec_id", least=0.25, digits=5, block=2, part=50)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, found.collect()))
    assert [x[:2] for x in got] == [x[:2] for x in all_ if x[2] >= 0.25] and np.allclose([x[2] for x in got], [x[2] for x in all_ if x[2] >= 0.25], atol=6e-6)
    best = in_blocks(rows.filter("vec_id % 50 = 0"), rows, "vec_id", top=3, block=2, part=50)
    want = [x for q in asked for x in sorted((x for x in all_ if x[0] == q), key=lambda x: (-round(x[2], 6), x[1]))[:3]]
    assert sorted(map(tuple, best.select("q", "vec_id").collect())) == sorted(x[:2] for x in want)


def test_gains_in_cells_equal_those_in_one(spark):
    rng = random.Random(4)
    words = ["alpha", "bravo", "delta", "gamma", "sigma", "omega", "kappa"]
    rows = [(q, f"c{i}", None if i % 7 == 3 else " ".join(rng.sample(words, rng.randint(1, 6)))) for q in (1, 2) for i in range(23)] + [(3, "c1", "alpha"), (4, "c1", "alpha"), (4, "c2", "alpha bravo")]
    kept = {(q, c) for q, c, _ in rows if int(c[1:]) % 2 or q == 3}
    fixed = ", ".join(f"{v} AS {k}" for k, v in {"relevance": "0.8d", "weight": "0.5d", "freshness": "0.5d", "surprise": "0d", "source_type": "'x'", "stance": "'y'", "query_types": "array('none')", "required_types": "array('code')"}.items())
    df = spark.createDataFrame(rows, "query_id long, chunk_id string, claim string").selectExpr("*", *fixed.split(", "))
    selection = spark.createDataFrame([(q, c, "selected") for q, c in kept], "query_id long, chunk_id string, decision string")

    def like(a, b):
        a, b = set((a or "").split()), set((b or "").split())
        return len(a & b) / min(len(a), len(b)) if a and b else 0.0

    want = {}
    for q, c, said in rows:
        others = [like(said, s) for p, d, s in rows if p == q and d != c and (p, d) in kept]
        want[q, c] = int(0.4 * (max(0.05, 1 - max(others)) if others else 1.0) * 10000 + 0.5) / 10000
    for block in (2048, 4):
        assert {(r["query_id"], r["chunk_id"]): r["gain"] for r in assembly.final_gains(df, selection, block).collect()} == want


def test_chunks_move_once_for_gains(spark):
    """Selected chunks pass by the chunks of a cell in steps; neither side is dealt to cells of pairs of blocks."""
    import pyarrow as pa

    rng = random.Random(7)
    sets = [rng.sample(range(400), rng.randint(1, 12)) + [1000 + i % 3] for i in range(90)]
    part = lambda side, some: pa.RecordBatch.from_pydict({"query_id": [1] * len(some), "i": pa.array([0] * len(some), pa.int32()), "side": pa.array([side] * len(some), pa.int32()), "chunk_id": [f"c{i}" for i in some], "own": pa.array([sets[i] for i in some], pa.list_(pa.int64()))})
    told = pa.Table.from_batches(assembly._most_alike(iter([part(0, range(40)), part(0, range(40, 90)), part(1, range(0, 50, 2)), part(1, range(50, 90, 2))])))
    like = lambda a, b: len({*a} & {*b}) / min(len({*a}), len({*b}))
    assert told["chunk_id"].to_pylist() == [f"c{i}" for i in range(90)]
    assert told["like"].to_pylist() == [max(like(sets[i], sets[j]) for j in range(0, 90, 2) if j != i) for i in range(90)]
    fixed = ", ".join(f"{v} AS {k}" for k, v in {"relevance": "0.8d", "weight": "0.5d", "freshness": "0.5d", "surprise": "0d", "source_type": "'x'", "stance": "'y'", "query_types": "array('none')", "required_types": "array('code')"}.items())
    df = spark.createDataFrame([(1, "a", "alpha bravo"), (1, "b", "alpha delta")], "query_id long, chunk_id string, claim string").selectExpr("*", *fixed.split(", "))
    gains = assembly.final_gains(df, spark.createDataFrame([(1, "a", "selected")], "query_id long, chunk_id string, decision string"), 1)
    assert "CoGroup" not in gains._jdf.queryExecution().optimizedPlan().toString()
    assert {r["chunk_id"]: r["gain"] for r in gains.collect()} == {"a": 0.4, "b": 0.2}


def test_equal_sets_are_compared_once(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    base = [rng.sample(words, 25) for _ in range(6)]
    sets = [(q, f"{i:03}", x) for q in (1, 2) for i, x in enumerate([b[::-1] if k % 2 else b + b[:3] for b in base for k in range(5)] + [base[0][:-1], base[0][1:], [*base[1], "more"], [], [], None])]
    want = sorted((q, a, b, 1.0 if not x else len({*x} & {*y}) / len({*x} | {*y})) for q, a, x in sets for p, b, y in sets if p == q and a < b and x is not None and y is not None and (len({*x} & {*y}) >= 0.92 * len({*x} | {*y}) if x and y else not x and not y))
    rows = spark.createDataFrame(sets, "query_id long, chunk_id string, tokens array<string>")
    found = dedup.set_pairs(rows, 0.92)
    assert sorted(map(tuple, found.collect())) == want
    assert "xxhash64(own" in found._jdf.queryExecution().optimizedPlan().toString()


def test_all_pairs_of_documents_without_words(spark, tmp_path):
    """Two documents without words are as similar as equal ones: every pair of them, not only those with the first."""
    import duckdb

    from quarry.plans import catalog

    texts = ["...", "alpha bravo delta gamma", "a b", "", "alpha bravo gamma delta", "?"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = [(0, 2), (0, 3), (0, 5), (1, 4), (2, 3), (2, 5), (3, 5)]
    assert sorted((r.a, r.b) for r in catalog.queries()["j07_set_similarity"](spark, str(tmp_path)).collect()) == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(r[:2] for r in con.sql(catalog.oracle_sql()["j07_set_similarity"]).fetchall()) == want


def test_pairs_of_sets_do_not_carry_them(spark):
    """A set comes to a cell of its owner's pairs once, also when an owner has cells of few nodes; no pair holds two sets."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    base = [rng.sample(words, 40) for _ in range(3)]
    sets = [(q, f"{i:03}", rng.sample(b, 40 - rng.randint(0, 3)) + rng.sample(words, rng.randint(0, 2))) for q in (1, 2) for i, b in enumerate(base * 15)]
    like = lambda x, y: len({*x} & {*y}) / len({*x} | {*y})
    want = sorted((q, a, b, like(x, y)) for q, a, x in sets for p, b, y in sets if p == q and a < b and like(x, y) >= 0.92)
    rows = spark.createDataFrame(sets, "query_id long, chunk_id string, tokens array<string>")
    for block in (1024, 4):
        found = dedup.set_pairs(rows, 0.92, block=block)
        assert sorted(map(tuple, found.collect())) == want
        assert "array_intersect" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_task_tells_each_block_once(spark):
    """Beginnings of a block come once a task, not once a pair of blocks, and only one row's numbers are held at a time."""
    from quarry.operators import firsts

    bits = lambda *rows: bytearray(np.packbits(np.array(rows, bool)).tobytes())
    known = spark.createDataFrame([("g", 0, bits([1, 0], [0, 1]), 2, [7, 3]), ("g", 0, bits([0, 1], [0, 0]), 2, [9, 4])], "g string, block int, bits binary, n int, firsts array<long>").coalesce(1)
    assert [(r.g, r.block, r.firsts) for r in firsts._passed(known).collect()] == [("g", 0, [4, 3])]


def test_strict_scores_fold_gold_once_a_question(spark):
    """What is folded of gold stands below the join, and meaningful words are looked up in what both hold."""
    from quarry.operators import gold

    source = "array<struct<source_name:string,source_type:string,url:string,title:string,provenance:string>>"
    answers = spark.createDataFrame([("a", 1, "water water river bridge harbour", [])], f"engine string, question_id int, answer string, sources {source}")
    known = spark.createDataFrame([(1, True, [("water water river mountain", [])], [], ["Water water!", "harbour bridge river"])], "question_id int, valid boolean, facts array<struct<text:string,keywords:array<string>>>, required array<string>, penalties array<string>")
    scored = gold.score(answers, known, strict=True)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "own" in plan[plan.index("Join") :]
    row = scored.first()
    assert (row.facts_hit, row.facts_total, row.penalties_hit) == (1, 1, ["Water water!", "harbour bridge river"])


def test_costs_are_added_up_before_they_are_grouped_four_times(spark):
    """Only sums by stage, provider, model and source of price are multiplied for the groupings."""
    from quarry.operators import costs

    rows = [("s", "p", f"m{i % 2}", 1, 2, None if i == 3 else 0.5, i == 1, "unavailable" if i == 3 else "told") for i in range(4)]
    out = costs.summary(spark.createDataFrame(rows, "stage string, provider string, model string, prompt_tokens long, completion_tokens long, cost double, estimated boolean, pricing_source string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan.split("Expand")[-1].split("LogicalRDD")[0]
    assert {(r.kind, r.name): (r.calls, r.prompt_tokens, r.completion_tokens, r.cost, r.estimated, r.pricing_source) for r in out.collect()} == {
        ("all", None): (4, 4, 8, 1.5, True, "mixed"), ("stage", "s"): (4, 4, 8, 1.5, True, "mixed"), ("provider", "p"): (4, 4, 8, 1.5, True, "mixed"), ("model", "m0"): (2, 2, 4, 1.0, False, "told"), ("model", "m1"): (2, 2, 4, 0.5, True, "mixed"),
    }
