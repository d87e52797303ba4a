"""The incremental pipeline as Structured Streaming: every flow ends by itself once its
input is read (availableNow), and gives the table that it has written.

Sinks are folders of Parquet below the session's spark.checkpoint.dir, which executors
share; a run has its own, with its checkpoint beside the output, so that a flow that is
stopped goes on where it was when it is started with the same folder.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from shelfmark.sources import shared


def shared_folder(spark: SparkSession) -> str:
    """A new folder for one run, in the folder that executors share."""
    return f"{shared.base(spark)}/flow-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of a Parquet table, with the schema that the table has now."""
    schema = spark.read.parquet(path).schema
    path = f"{path[:-1]}[{path[-1]}]"  # as a pattern it may be one file as well as a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


class Stop:
    """A request to stop, as a file beside a flow's output. A flow obeys one that is as new as
    its own start, at the next batch, and takes no notice of an older one."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        at = spark._jvm.org.apache.hadoop.fs.Path
        self._path, self._out = at(f"{folder}/stop"), at(f"{folder}/out")
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())

    def request(self) -> None:
        self._fs.create(self._path, True).close()

    def clear(self) -> None:
        self._fs.delete(self._path, False)

    def has_output(self) -> bool:
        return self._fs.exists(self._out)

    def requested(self, since_ms: int) -> bool:
        return self._fs.exists(self._path) and self._fs.getFileStatus(self._path).getModificationTime() >= since_ms


def _watch(spark: SparkSession, write, folder: str) -> None:
    write.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def run_complete(stream: DataFrame, folder: str) -> DataFrame:
    """Run an aggregation in complete mode; the last batch's table is the result."""
    spark = stream.sparkSession
    write = stream.writeStream.outputMode("complete").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/out/batch={i}"))
    _watch(spark, write, folder)
    done = spark.read.parquet(f"{folder}/out")
    last = done.agg(F.max("batch")).first()[0]
    return done.where(F.col("batch") == last).drop("batch")


def run_append(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream that only adds rows into a Parquet sink, exactly once."""
    _watch(stream.sparkSession, stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out"), folder)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def run_batches(stream: DataFrame, folder: str, process: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame], bool] = lambda df: True, halt_after: int = 3) -> DataFrame:
    """Claim, process, verify and commit batch by batch; `halt_after` failures in a row stop it.

    A batch's folder is overwritten when the batch is run again, so a retry adds nothing. A
    flow that is asked to stop (:class:`Stop` of its folder) ends before its next batch, with
    what it has written; started anew with the same folder it goes on from there.
    """
    spark, failed, stopped = stream.sparkSession, 0, False
    stop, began = Stop(spark, folder), int(time.time() * 1000)

    def commit(df: DataFrame, i: int) -> None:
        nonlocal failed, stopped
        stopped = stop.requested(began)
        if stopped:
            raise InterruptedError("asked to stop")
        process(df).write.mode("overwrite").parquet(f"{folder}/out/batch={i}")
        failed = 0 if verify(df.sparkSession.read.parquet(f"{folder}/out/batch={i}")) else failed + 1
        if failed >= halt_after:
            raise RuntimeError(f"{failed} batches in a row failed their checks")

    try:
        _watch(spark, stream.writeStream.foreachBatch(commit), folder)
    except StreamingQueryException:
        if not stopped:
            raise
    if stopped and not stop.has_output():
        return process(spark.createDataFrame([], stream.schema)).limit(0)
    return spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/out")


def run_distinct(stream: DataFrame, folder: str, key: str) -> DataFrame:
    """Each key of a stream once, however late or far apart its rows come.

    A batch adds the keys that no earlier batch has written; its folder is overwritten when
    it is run again, and later folders don't count, so a retry adds nothing.
    """
    spark, schema = stream.sparkSession, stream.select(key).schema

    def add(df: DataFrame, i: int) -> None:
        new = df.select(key).dropDuplicates()
        if i:
            old = spark.read.schema(schema).parquet(*[f"{folder}/out/batch={k}" for k in range(i)])
            new = new.join(old, new[key].eqNullSafe(old[key]), "left_anti")
        new.write.mode("overwrite").parquet(f"{folder}/out/batch={i}")

    _watch(spark, stream.writeStream.foreachBatch(add), folder)
    return spark.read.parquet(f"{folder}/out").drop("batch")


def sessions(stream: DataFrame, gap: str = "10 hours", least: int = 5, late: str = "1 hour") -> DataFrame:
    """Sessions by owner of a stream with `ts`: owner, n, first_us, last_us."""
    grouped = stream.withWatermark("ts", late).groupBy("owner", F.session_window("ts", gap))
    counts = grouped.agg(F.count("*").alias("n"), F.min(F.unix_micros("ts")).alias("first_us"), F.max(F.unix_micros("ts")).alias("last_us"))
    return counts.where(F.col("n") >= least).drop("session_window")


def rates(stream: DataFrame, window: str = "1 day", slide: str = "12 hours") -> DataFrame:
    """Rows in sliding windows: start_us, n."""
    return stream.groupBy(F.window("ts", window, slide).alias("w")).agg(F.count("*").alias("n")).select(F.unix_micros(F.col("w.start")).alias("start_us"), "n")


class Heartbeat(StreamingQueryListener):
    """Keeps one line of JSON for each batch, as a progress log has them."""

    def __init__(self) -> None:
        self.lines: list[str] = []

    def onQueryStarted(self, event) -> None:
        self.lines.append(json.dumps({"event": "started", "id": str(event.id)}))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.lines.append(json.dumps({"event": "progress", "batch": p.batchId, "rows": p.numInputRows}))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.lines.append(json.dumps({"event": "ended", "id": str(event.id)}))
