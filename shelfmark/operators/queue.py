"""A durable work queue as functional updates of a table of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A failed item may be tried again while it was tried less often.
ATTEMPTS = 3


def enqueue(queue: DataFrame, new: DataFrame, key: str = "queue_key", order: str = "item_id") -> DataFrame:
    """Items that the queue doesn't know, one a key."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
    return first.join(queue.select(key), key, "left_anti")


def expire(queue: DataFrame, now_ns: int) -> DataFrame:
    """Leases that have run out go back to the queue."""
    over = (F.col("state") == "leased") & (F.col("expires_ns") <= now_ns)
    return queue.withColumn("state", F.when(over, "queued").otherwise(F.col("state")))


def claim(queue: DataFrame, drive: int, n: int, now_ns: int) -> DataFrame:
    """The first n queued paths of a drive, leased, with one attempt more."""
    free = expire(queue, now_ns).where((F.col("state") == "queued") & (F.col("drive_number") == drive))
    return free.orderBy("path").limit(n).withColumn("state", F.lit("leased")).withColumn("attempts", F.col("attempts") + 1)


def apply_transitions(queue: DataFrame, log: DataFrame) -> DataFrame:
    """Items after their latest logged action: complete, release, fail (with retryable), retry."""
    last = log.groupBy("item_id").agg(F.max(F.struct("at", "action", "retryable")).alias("l")).select("item_id", "l.action", "l.retryable")
    rows = queue.join(last, "item_id", "left")
    act = F.col("action")
    again = F.col("retryable") & (F.col("attempts") < ATTEMPTS)
    state = F.when(act == "complete", "complete").when(act.isin("release", "retry"), "queued").when(act == "fail", F.when(again, "queued").otherwise("failed")).otherwise(F.col("state"))
    attempts = F.when(act == "release", F.greatest(F.col("attempts") - 1, F.lit(0))).when(act == "retry", 0).otherwise(F.col("attempts"))
    return rows.withColumn("state", state).withColumn("attempts", attempts).drop("action", "retryable")


def retryable(attempts: Column) -> Column:
    return attempts < ATTEMPTS
