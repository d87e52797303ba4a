"""The folder that all executors share, and tables that are built once in it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@cache
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="shelfmark-")
    atexit.register(shutil.rmtree, path, True)
    return path


def base(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only where none is configured and all tasks run in
    this process it is a temporary folder; a cluster without one gets a RuntimeError."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_folder()


def state(tables: list[DataFrame]) -> str:
    """Digest of the files that tables are read from: their paths, sizes and times. No column is read."""
    m = F.col("_metadata")
    mark = F.xxhash64(m["file_path"], m["file_size"], m["file_modification_time"]).cast("decimal(38,0)")
    rows = [t.select(mark.alias("m")).agg(F.lit(i).alias("i"), F.count("*").alias("n"), F.sum("m").alias("s")) for i, t in enumerate(tables)]
    found = reduce(DataFrame.union, rows).collect()  # a row each
    return uuid.uuid5(uuid.NAMESPACE_OID, repr(sorted((r.i, r.n, str(r.s)) for r in found))).hex


def once(spark: SparkSession, path: str, build: Callable[[str], None]) -> str:
    """`path`, written by `build` if it isn't there. Two builders at once each write a folder
    of their own, and the first to be done names it `path`."""
    to = spark._jvm.org.apache.hadoop.fs.Path
    fs = to(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(to(path)):
        own = f"{path}.{uuid.uuid4().hex}"
        build(own)
        if fs.exists(to(path)) or not fs.rename(to(own), to(path)):
            fs.delete(to(own), True)
    return path
