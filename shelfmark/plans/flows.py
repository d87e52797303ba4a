"""Streaming flows run to their end over the events, held against their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.plans.lifecycle import _LABELLED
from shelfmark.plans.registry import query
from shelfmark.sources import filesystem
from shelfmark.streaming import flows


def _stream(c):
    rows = flows.read_stream(c.spark, f"{c.sf_dir}/events.parquet")
    return rows.select(F.col("event_id").alias("file_id"), F.col("user_id").alias("owner"), F.col("ts").cast("timestamp").alias("ts"), "event_type", F.concat(F.lit("q"), "user_id", F.lit("-"), F.col("event_id") % 50).alias("queue_key"))


@query("stream_sessions", f"WITH {_LABELLED} SELECT owner, n, first_us, last_us FROM ses WHERE n >= 5")
def stream_sessions(c):
    return flows.run_complete(flows.sessions(_stream(c)), flows.shared_folder(c.spark))


@query("stream_rate", "SELECT s AS start_us, count(*) AS n FROM (SELECT unnest([us - us % 43200000000, us - us % 43200000000 - 43200000000]) AS s FROM captures) GROUP BY 1")
def stream_rate(c):
    return flows.run_complete(flows.rates(_stream(c)), flows.shared_folder(c.spark))


@query("stream_enqueue", "SELECT DISTINCT queue_key FROM queue")
def stream_enqueue(c):
    return flows.run_distinct(_stream(c), flows.shared_folder(c.spark), "queue_key")


@query("run_loop", "SELECT file_id, state FROM (SELECT item_id AS file_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'complete' END AS state FROM queue JOIN captures ON file_id = item_id)")
def run_loop(c):
    process = lambda df: df.select("file_id", F.when(F.col("event_type") == "error", "failed").otherwise("complete").alias("state"))
    return flows.run_batches(_stream(c), flows.shared_folder(c.spark), process)


@query("index_append", "SELECT vec_id, len(embedding)::INT AS dim FROM embeddings")
def index_append(c):
    stream = flows.read_stream(c.spark, f"{c.sf_dir}/embeddings.parquet")
    return flows.run_append(stream.select("vec_id", F.size("embedding").alias("dim")), flows.shared_folder(c.spark))


@query("jsonl_log", "SELECT run_id, outcome FROM runs")
def jsonl_log(c):
    path = f"{flows.shared_folder(c.spark)}/log"
    filesystem.append_log(c.runs.where("run_id % 2 = 0").select("run_id", "outcome"), path)
    filesystem.append_log(c.runs.where("run_id % 2 = 1").select("run_id", "outcome"), path)
    return c.spark.read.schema("run_id bigint, outcome string").json(path)


@query("vector_index_io", "SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def vector_index_io(c):
    path = f"{flows.shared_folder(c.spark)}/index"
    c.table("embeddings").write.partitionBy("label").parquet(path)
    return c.spark.read.parquet(path).groupBy("label").agg(F.count("*").alias("n"))


@query("cooperative_stop", "SELECT count(*) AS rows, count(DISTINCT event_id) AS events, true AS stopped FROM events")
def cooperative_stop(c):
    """A flow that is asked to stop after its first batch, and started again."""
    folder = flows.shared_folder(c.spark)
    c.table("events").select("event_id").repartition(3, "event_id").write.parquet(f"{folder}/in")
    stop = flows.Stop(c.spark, folder)

    def first(df):
        stop.request()
        return df

    flow = lambda process: flows.run_batches(flows.read_stream(c.spark, f"{folder}/in"), folder, process)
    some = flow(first).select(F.count("*").alias("some"))
    some = c.spark.createDataFrame(some.collect(), "some long")  # one row, as it is now
    stop.clear()
    whole = flow(lambda df: df).agg(F.count("*").alias("rows"), F.count_distinct("event_id").alias("events"))
    return whole.join(F.broadcast(some), F.lit(True)).select("rows", "events", (F.col("some") < F.col("rows")).alias("stopped"))
