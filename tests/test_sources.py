from __future__ import annotations

import json
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from quarry.sources import connectors, files
from quarry.streaming import events

ROOT = Path(__file__).resolve().parents[1]


def test_recorded_source_never_raises(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"items": [{"id": 1, "full_name": "o/r", "html_url": "https://github.com/o/r", "description": "d", "owner": {"login": "o"}}]}))
    (tmp_path / "b.json").write_bytes(b"\xff\xfe\xff")
    got = files.recorded(spark, str(tmp_path))
    assert {(r.task, r.ok) for r in got.collect()} == {("a.json", True), ("b.json", False)}
    items = connectors.parse(got.filter("ok"), "github").collect()
    assert [(r.url, r.author) for r in items] == [("https://github.com/o/r", "o")]


def test_malformed_payload_is_a_row(spark):
    p = spark.createDataFrame([("t1", "not json"), ("t2", '{"items": []}')], "task string, payload string")
    assert {r.task: r.code for r in connectors.fetch(p, "github").collect()} == {"t1": "MALFORMED_PAYLOAD", "t2": None}


def test_gold_files(spark, tmp_path):
    good, bad = tmp_path / "g.json", tmp_path / "b.json"
    good.write_text(json.dumps({"questions": [{"id": "Q1", "question": "q", "atomic_facts": [{"id": "f", "text": "t", "keywords": ["k"], "weight": 1}], "required_sources": [], "penalize_if": []}]}))
    bad.write_text("{oops")
    assert [(r.id, r.error) for r in files.read_gold(spark, str(good)).collect()] == [("Q1", False)]
    assert [(r.id, r.error) for r in files.read_gold(spark, str(bad)).collect()] == [(None, True)]


def test_run_log_and_limit_before_filter(spark, tmp_path):
    runs = spark.createDataFrame([(i, i % 2 == 0, "x" * 3000, [0.1]) for i in range(6)], "finished long, ok boolean, content string, embedding array<double>")
    files.write_runs(runs, str(tmp_path / "runs"))
    back = spark.read.json(str(tmp_path / "runs"))
    assert "embedding" not in back.columns and back.agg(F.max(F.length("content"))).first()[0] == 2500
    assert sorted(r.finished for r in files.latest_runs(back, 3).collect()) == [4]


def test_stream_windows_are_a_subset_of_batch(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    batch = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    want = {tuple(r) for r in events.hourly(batch).select("hour", "event_type", "n").collect()}
    out = events.run_once(events.hourly(events.read_stream(spark, d)).drop("total"), "append", str(tmp_path / "c"))
    got = {tuple(r) for r in out.select("hour", "event_type", "n").collect()}
    assert got <= want and len(want) - len(got) < 20


def test_entry_works_without_the_llm_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "quarry"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    (tmp_path / "quarry").mkdir()
    for p in (ROOT / "quarry").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "quarry" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)
