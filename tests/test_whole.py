"""Queries read their whole input: whatever comes late in a text or a table counts."""

from types import SimpleNamespace

import shelfmark.plans.all  # noqa: F401
from shelfmark.plans import registry


def _over(spark, **tables):
    """A catalogue of small tables given as (rows, schema)."""
    return SimpleNamespace(spark=spark, table=lambda name: spark.createDataFrame(*tables[name]))


def test_names_late_in_a_text_are_found(spark):
    c = _over(spark, documents=([(1, "low " * 1000 + "Zebrano"), (2, None)], "doc_id long, text string"))
    assert [(r.doc_id, r.name) for r in registry.QUERIES["name_detect"](c).collect()] == [(1, "Zebrano")]


def test_every_tag_is_counted(spark):
    rows = [(i, f"Name{i:04d}") for i in range(600)]
    c = _over(spark, documents=(rows, "doc_id long, text string"))
    assert [(r.tag, r.n) for r in registry.QUERIES["name_scan"](c).collect()] == [(f"name{i:04d}", 1) for i in range(600)]


def test_keys_that_return_after_months_are_enqueued_once(spark, tmp_path):
    days = ["2024-06-01", "2024-01-01", "2024-09-01", "2024-02-01"]  # in the order of the files
    for i, day in enumerate(days):
        rows = [(50 * (i if k else 0), k, day) for k in (0, 1)]
        events = spark.createDataFrame(rows + [(i, 2, day), (50, None, day)], "event_id long, user_id long, day string")
        events = events.selectExpr("event_id", "user_id", "cast(day AS timestamp) AS ts", "'click' AS event_type")
        events.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    got = registry.QUERIES["stream_enqueue"](SimpleNamespace(spark=spark, sf_dir=str(tmp_path))).collect()
    assert sorted(r.queue_key or "" for r in got) == ["", "q0-0", "q1-0", "q2-0", "q2-1", "q2-2", "q2-3"]
