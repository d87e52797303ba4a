"""A query is a function of a catalogue; most have the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmark.sources.catalogue import VIEWS, Catalogue

QUERIES: dict[str, Callable[[Catalogue], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, with `sql`, its DuckDB text over the catalogue's views."""

    def take(f: Callable[[Catalogue], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            body = sql.strip()
            more = f",\n{body[5:]}" if body.startswith("WITH ") else f"\n{body}"
            ORACLES[name] = f"WITH {VIEWS.strip()}{more}"
        return f

    return take


def runnable(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: QUERIES[name](Catalogue(spark, sf_dir))
