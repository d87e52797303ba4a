"""Files as a source, and manifests, logs and sidecars as sinks."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text as T

# Extensions that are listed unless others are asked for.
EXTENSIONS = ("jpg", "jpeg", "png", "tif", "tiff", "psd")


def listed(files: DataFrame, extensions: tuple[str, ...], exclude: tuple[str, ...] = ()) -> DataFrame:
    """Of files with a relative_path and an extension those that a listing shows."""
    path = F.col("relative_path")
    out = files.where(F.lower("extension").isin(*extensions) & ~T.system_file(path))
    for pattern in exclude:
        out = out.where(~T.excluded(path, pattern))
    return out


def _inside(root: str):
    """Whether a path on a local disk is below `root` once links are followed."""
    top = os.path.realpath(root)

    @F.pandas_udf("boolean")
    def inside(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: os.path.realpath(p).startswith(top + os.sep))

    return inside


def enumerate_files(spark: SparkSession, root: str, extra: tuple[str, ...] = (), exclude: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """Files below a root: relative_path, extension, size_bytes, modified. Contents aren't read.

    A link that leads out of the root isn't followed; only local disks have links. With
    `most`, the first that many in order of path.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    path = F.regexp_replace("path", "^(file:)?/+", "/")
    relative = F.substr(path, F.lit(len(root.rstrip("/")) + 2))
    if "://" not in root:
        files = files.where(_inside(root)(path))
    out = files.select(relative.alias("relative_path"), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).alias("extension"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
    out = listed(out, (*EXTENSIONS, *(e.lower() for e in extra)), exclude).orderBy("relative_path")
    return out if most is None else out.limit(most)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A drive's identity document."""
    return spark.read.schema("drive_id string, drive_number int, friendly_name string, created_at string").option("multiLine", True).json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """One JSON object a line, added to what is there."""
    rows.write.mode("append").json(path)


def write_once(rows: DataFrame, path: str) -> None:
    """A text sink that leaves an existing one alone."""
    rows.write.mode("ignore").text(path)
