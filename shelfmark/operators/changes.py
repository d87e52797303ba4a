"""Change detection between snapshots, moved files, integrity verdicts and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def reconcile(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Catalogue rows against a listing: drive_number, relative_path, verdict.

    One full outer join on drive and path. `changed`: size or time differ and the row was
    complete, or a missing row is back; `missing`: not seen any more.
    """
    k = known.select("drive_number", "relative_path", F.col("status"), F.col("size_bytes").alias("ks"), F.col("mtime_ns").alias("km"))
    s = seen.select("drive_number", "relative_path", F.col("size_bytes").alias("ss"), F.col("mtime_ns").alias("sm"), F.lit(True).alias("here"))
    differs = (F.col("ks") != F.col("ss")) | (F.col("km") != F.col("sm"))
    verdict = (
        F.when(F.col("status").isNull(), "new")
        .when(F.col("here").isNull(), F.when(F.col("status") == "missing", "still_missing").otherwise("missing"))
        .when((F.col("status") == "missing") | ((F.col("status") == "complete") & differs), "changed")
        .otherwise("unchanged")
    )
    return k.join(s, ["drive_number", "relative_path"], "full_outer").select("drive_number", "relative_path", verdict.alias("verdict"))


def moved(missing: DataFrame, new: DataFrame) -> DataFrame:
    """New paths matched one to one with missing rows of equal drive and content."""
    number = lambda df, by: df.withColumn("_n", F.row_number().over(Window.partitionBy("drive_number", "content_hash").orderBy(by)))
    old = number(missing.select("drive_number", "content_hash", "file_id"), "file_id")
    now = number(new.select("drive_number", "content_hash", F.col("relative_path").alias("new_path")), "new_path")
    return old.join(now, ["drive_number", "content_hash", "_n"]).select("file_id", "new_path")


def integrity_verdict(stored: Column, found: Column, same_size: Column, same_time: Column) -> Column:
    """intact, edited or corrupt; a row that isn't found is missing."""
    return (
        F.when(found.isNull(), "missing")
        .when(stored.isNull() | (stored == found), "intact")
        .when(same_size & same_time, "corrupt")
        .otherwise("edited")
    )


def merge_versions(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The winning version of each key: an upsert as a projection."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
