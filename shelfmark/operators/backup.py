"""Snapshots of tables: written beside a manifest of counts and checksums, listed, pruned and restored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Snapshots that :func:`surplus` keeps.
KEEP = 7
MANIFEST = "name string, n bigint, checksum string"


def _facts(name: str, rows: DataFrame) -> DataFrame:
    """One row: name, n, checksum; the checksum is a sum over rows, so their order is free."""
    mark = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`").alias("c"))) for c in sorted(rows.columns)]).cast("decimal(38,0)")
    return rows.select(mark.alias("m")).agg(F.count("*").alias("n"), F.sum("m").cast("string").alias("checksum")).select(F.lit(name).alias("name"), "n", "checksum")


def create(tables: dict[str, DataFrame], path: str) -> None:
    """Write each table below `path`, then the manifest of what was written; one without it is no snapshot."""
    spark = next(iter(tables.values())).sparkSession
    for name, rows in tables.items():
        rows.write.parquet(f"{path}/{name}")
    written = [_facts(name, spark.read.parquet(f"{path}/{name}")) for name in tables]
    reduce(DataFrame.union, written).coalesce(1).write.json(f"{path}/manifest")


def manifests(spark: SparkSession, base: str) -> DataFrame:
    """The snapshots in a folder, one row a table: snapshot, name, n, checksum."""
    rows = spark.read.schema(MANIFEST).json(f"{base}/*/manifest")
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/manifest/[^/]*$", 1).alias("snapshot"), "*")


def surplus(snapshots: DataFrame, keep: int = KEEP) -> DataFrame:
    """Snapshots beyond the newest `keep`, by name, which begins with the time."""
    names = snapshots.select("snapshot").distinct()
    return names.join(names.orderBy(F.desc("snapshot")).limit(keep), "snapshot", "left_anti")


def restore(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a snapshot; ValueError where one has not the rows that the manifest names."""
    said = {r.name: r for r in spark.read.schema(MANIFEST).json(f"{path}/manifest").collect()}  # a row a table
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in said}
    for r in reduce(DataFrame.union, [_facts(*item) for item in tables.items()]).collect():
        if (r.n, r.checksum) != (said[r.name].n, said[r.name].checksum):
            raise ValueError(f"{r.name} is damaged")
    return tables
