"""Gap sessions over timestamped rows, and edits of sessions as functional updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Defaults: a gap of more than this ends a session; smaller sessions are strays.
GAP_HOURS, LEAST = 10, 5
MICROS = 3_600_000_000


def label_sessions(rows: DataFrame, ts: str = "ts", by: tuple[str, ...] = ("owner",), tie: str = "file_id", gap_hours: float = GAP_HOURS) -> DataFrame:
    """`rows` with a long `session` that counts from 0 within `by`.

    A session ends where the next row is more than the gap away; exactly the gap stays
    together. Rows without a time are left out. One shuffle by `by`.
    """
    order = Window.partitionBy(*by).orderBy(ts, tie)
    us = F.unix_micros(F.col(ts))
    starts = F.when(us - F.lag(us).over(order) > int(gap_hours * MICROS), 1).otherwise(0)
    rows = rows.where(F.col(ts).isNotNull()).withColumn("_new", starts)
    return rows.withColumn("session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def sessions(rows: DataFrame, ts: str = "ts", by: tuple[str, ...] = ("owner",), tie: str = "file_id", gap_hours: float = GAP_HOURS, least: int = LEAST) -> DataFrame:
    """One row per session of `least` rows or more: by, session, n, first_us, last_us."""
    grouped = label_sessions(rows, ts, by, tie, gap_hours).groupBy(*by, "session")
    bounds = grouped.agg(F.count("*").alias("n"), F.min(F.unix_micros(F.col(ts))).alias("first_us"), F.max(F.unix_micros(F.col(ts))).alias("last_us"))
    return bounds.where(F.col("n") >= least)


def report(rows: DataFrame, ts: str = "ts", latest: str = "latest", by: tuple[str, ...] = ("owner",), tie: str = "file_id", gap_hours: float = GAP_HOURS, least: int = LEAST, span_hours: float = 48) -> DataFrame:
    """What a proposal of sessions would do, in one row: sessions proposed, and rows that are
    grouped, skipped in small sessions, undated, or imprecise.

    A row whose time is only known to lie in a span of over `span_hours`, from `ts` to
    `latest`, is imprecise and takes no part in sessions; a null `latest` is an exact time.
    """
    wide = F.coalesce(F.unix_micros(F.col(latest)) - F.unix_micros(F.col(ts)) > int(span_hours * MICROS), F.lit(False))
    aside = rows.agg(F.count_if(F.col(ts).isNull()).alias("undated"), F.count_if(wide).alias("imprecise"))
    sizes = label_sessions(rows.where(~wide), ts, by, tie, gap_hours).groupBy(*by, "session").agg(F.count("*").alias("n"))
    big = F.col("n") >= least
    some = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    facts = sizes.agg(F.count_if(big).alias("proposed"), some(big).alias("grouped"), some(~big).alias("skipped"))
    return facts.join(F.broadcast(aside), F.lit(True))  # one row each


def split_points(rows: DataFrame, ts: str = "ts", by: tuple[str, ...] = ("owner", "session"), tie: str = "file_id", hours: float = 2.0) -> DataFrame:
    """Gaps of `hours` or more within a session: by, tie, gap_us, rows_after.

    rows_after counts rows at the boundary or later, ties included.
    """
    order = Window.partitionBy(*by).orderBy(ts)
    us = F.unix_micros(F.col(ts))
    after = Window.partitionBy(*by).orderBy(us).rangeBetween(0, Window.unboundedFollowing)
    gap = us - F.lag(us).over(Window.partitionBy(*by).orderBy(ts, tie))
    out = rows.withColumn("gap_us", gap).withColumn("rows_after", F.count("*").over(after))
    return out.where(F.col("gap_us") >= int(hours * MICROS)).select(*by, tie, "gap_us", "rows_after")


def split(rows: DataFrame, chosen: Column, at: Column, new_id: Column, session: str = "session", ts: str = "ts") -> DataFrame:
    """Rows of a chosen session from `at` on move to `new_id`."""
    return rows.withColumn(session, F.when(chosen & (F.col(ts) >= at), new_id).otherwise(F.col(session)))


def merge(members: DataFrame, source: Column, target: Column, session: str = "session", member: str = "file_id") -> DataFrame:
    """Members of `source` join `target`; a member of both stays once."""
    moved = members.withColumn(session, F.when(F.col(session) == source, target).otherwise(F.col(session)))
    return moved.dropDuplicates([session, member])


def bounds(members: DataFrame, by: tuple[str, ...], ts: str = "ts") -> DataFrame:
    """First and last time of each session, both from the earliest date."""
    return members.groupBy(*by).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n"))
