"""Data-quality checks: each one is a count; together they are a report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check(name: str, wrong: DataFrame, bad: str = "fail") -> DataFrame:
    """One row: name, status, wrong. `wrong` holds the rows that break the rule."""
    n = wrong.agg(F.count("*").alias("wrong"))
    return n.select(F.lit(name).alias("name"), F.when(F.col("wrong") == 0, "pass").otherwise(bad).alias("status"), "wrong")


def measure(name: str, facts: DataFrame, good: str, bad: str = "fail") -> DataFrame:
    """As :func:`check`, of a table of one row that has to be `good`."""
    return check(name, facts.where(f"NOT coalesce({good}, false)"), bad)


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose key is set and not there in the parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")


def report(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, checks)


def rollup(results: DataFrame) -> DataFrame:
    """ok, has_halt and counts in words, for a report."""
    of = lambda s: F.count_if(F.col("status") == s)
    counts = results.agg(of("pass").alias("p"), of("warn").alias("w"), of("fail").alias("f"), of("halt").alias("h"))
    words = F.format_string("%d pass, %d warn, %d fail, %d halt", "p", "w", "f", "h")
    return counts.select(((F.col("f") == 0) & (F.col("h") == 0)).alias("ok"), (F.col("h") > 0).alias("has_halt"), words.alias("summary"))
