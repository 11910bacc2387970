"""The shared folder in a session without any preset."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

CODE = """
from pyspark.sql import SparkSession
from quarry.shared import checkpointed, shared_dir
s = SparkSession.builder.master("local").config("spark.ui.enabled", "false").getOrCreate()
assert s.conf.get("spark.checkpoint.dir", None) is None
assert checkpointed(s.range(5)).count() == 5 and shared_dir(s) == shared_dir(s) == s.sparkContext.getCheckpointDir()
"""


def test_a_fresh_local_session_needs_no_preset_folder(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(Path(__file__).resolve().parents[1])}
    run = subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]


def test_retrieval_hands_items_to_python_in_small_batches(spark, tmp_path, monkeypatch):
    """An item carries 100 KB: 640 of them came in one batch of 64 MB."""
    import pyarrow as pa

    from quarry.operators import retrieval
    from quarry.plans.evidence import Evidence

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.range(640).selectExpr("concat('i', id) AS id", "'arxiv' AS source", "id AS ord", "repeat('0123456789', 10000) AS text").coalesce(1).write.parquet(f"{tmp_path}/items")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"query_id": [0], "ix": [0], "source": ["arxiv"], "item_id": ["i"], "shared": [b.nbytes]})

    monkeypatch.setattr(retrieval, "search", lambda tasks, items: items.select("text").mapInArrow(sizes, "query_id long, ix long, source string, item_id string, shared long"))
    before = spark.conf.get(key, None)
    e = Evidence(spark.createDataFrame([(1, "How much crude oil is produced?")], "query_id long, query string"), spark.read.parquet(f"{tmp_path}/items"))
    seen = [r["shared"] for r in e.hits.collect()]
    assert sum(seen) >= 64_000_000 and max(seen) <= 20_000_000 and spark.conf.get(key, None) == before


def test_batch_limit_of_nested_users_is_put_back(spark):
    from quarry.shared import arrow_batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    with arrow_batches(spark, 1 << 20):
        with arrow_batches(spark, 1 << 21):
            assert spark.conf.get(key) == str(1 << 20)
        assert spark.conf.get(key) == str(1 << 20)
    assert spark.conf.get(key, None) == before
    try:
        with arrow_batches(spark, 1 << 20):
            raise ValueError
    except ValueError:
        assert spark.conf.get(key, None) == before
