"""Where intermediate tables go, and connected components over an edge table."""

from __future__ import annotations

import ctypes
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.shipping import ship  # noqa: F401  operators take it from here


def folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir. Only where
    none is set and all tasks run in this process, a temporary one is made and set; a cluster
    without one gets a RuntimeError, since its machines share no temporary folder."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="shelfmark-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the folder that all executors share, and read from there."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(run):
    """`run`, a function of batches, that gives a reused worker's free memory back at its end."""

    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return tidied


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocked(rows: DataFrame, by: list[str], key: str, size: int) -> DataFrame:
    """`rows` dealt out so that every two rows of a group meet and no task holds a large group.

    Adds own, i and j. A group of up to `size` rows is the task (0, 0); a larger one is
    split by a hash of `key` into blocks of about that size, and a row of block b goes to
    the tasks of b with each block, itself included. Rows of the same block meet in each of
    their tasks; what counts pairs counts them where i = j.
    """
    n = F.count("*").over(Window.partitionBy(*by))
    rows = rows.withColumn("_n", n).withColumn("_n", F.ceil(F.col("_n") / size).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64(key), F.col("_n")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return rows.withColumn("i", F.least("own", "_other")).withColumn("j", F.greatest("own", "_other")).drop("_n", "_other")


def runs(batches, keys: int, columns: int):
    """Arrays of `columns` columns that hold whole runs of equal values in the first `keys`.

    Rows come in order of those. Holds one run besides a batch.
    """
    held = None
    for batch in batches:
        if not len(batch):
            continue
        now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(columns)]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now)]
        other = np.zeros(len(now[0]), bool)
        for x in now[:keys]:
            other |= x != x[-1]
        at = np.flatnonzero(other)
        last = int(at[-1]) + 1 if len(at) else 0
        if last:
            yield [x[:last] for x in now]
        held = [x[last:] for x in now]
    if held is not None:
        yield held


def begins(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for x in keys:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


class Forest:
    """Union-find over 64-bit ids; the smallest id of a tree is its root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while (p := up.get(x, x)) != r and x != r:
            up[x] = r
            x = p
        return r

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _thin(batches):
    """Of a batch's edges those that a spanning forest needs. Memory is one batch's."""
    for batch in batches:
        trees = Forest()
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        for x, y in zip(a, b):
            trees.join(x, y)
        nodes = list(trees.up)
        yield pa.record_batch([pa.array([trees.root(x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], EDGE)


def _is_stars(edges: DataFrame) -> bool:
    """Whether each b has one a, and no a is a b."""
    ends = edges.select(F.col("b").alias("x"), F.lit(1).alias("n")).union(edges.select(F.col("a"), F.lit(0)))
    by = ends.groupBy("x").agg(F.sum("n").alias("n"), F.min("n").alias("least"))
    return by.where("n > 1 OR (n = 1 AND least = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each id in `edges` (a, b) the smallest id it can reach.

    Alternating large-star and small-star steps, each an aggregation with partial sums and
    a join that adaptive execution can split; the number of rounds grows with the
    logarithm of the longest path. Every round is cut, so that a lost executor costs one
    round. Ids are not null. Rows may repeat; loops are ignored, so their ids are absent.
    """
    flat = edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    now = cut(flat.mapInArrow(_thin, "a long, b long").where("a <> b").distinct())
    while not _is_stars(now):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a AND b <> m").select(F.col("b").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("m <> v").select(F.col("m").alias("a"), F.col("v").alias("b")).union(low.select(F.col("m").alias("a"), F.col("u").alias("b")))
        now = cut(small.distinct())
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select(F.col("a"), F.col("a")).distinct())
