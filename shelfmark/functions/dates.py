"""Date inference and date text as Column expressions. Dates stay strings, as in the
catalogue: ranges compare by text, and only arithmetic parses them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_ymd(text: Column) -> Column:
    """ISO date of EXIF-like text; month and day default to 1, and only ranges are tested."""
    parts = F.split(F.replace(F.trim(text), F.lit(":"), F.lit("-")), "[-T ]")
    part = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit("1"))
    y, m, d = (F.when(part(i).rlike("^[0-9]{1,4}$"), part(i)).cast("int") for i in (1, 2, 3))
    good = y.between(1800, 2200) & m.between(1, 12) & d.between(1, 31)
    return F.when(good, F.format_string("%04d-%02d-%02d", y, m, d))


def is_iso_date(text: Column) -> Column:
    shaped = text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    return F.when(shaped, F.substring(text, 6, 2).cast("int").between(1, 12) & F.substring(text, 9, 2).cast("int").between(1, 31)).otherwise(False)


def normalise_range(first: Column, last: Column) -> Column:
    """(earliest, latest): a blank end is the same day, a reversed range is swapped."""
    last = F.when(F.length(F.trim(last)) > 0, last).otherwise(first)
    return F.struct(F.least(first, last).alias("earliest"), F.greatest(first, last).alias("latest"))


def parse_epoch(text: Column) -> Column:
    """Seconds since 1970 of a civil date, time only where 19 characters are there.

    A day that its month doesn't have counts on from the month's first."""
    day = F.when(F.substring(text, 1, 10).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.substring(text, 1, 10))
    y, m, d = (F.substring(day, a, n).cast("int") for a, n in ((1, 4), (6, 2), (9, 2)))
    good = m.between(1, 12) & d.between(1, 31)
    days = F.unix_date(F.date_add(F.make_date(F.when(good, y), m, F.lit(1)), d - 1)).cast("long")
    clock = F.when((F.length(text) >= 19) & F.substring(text, 12, 8).rlike("^[0-9]{2}:[0-9]{2}:[0-9]{2}$"), F.substring(text, 12, 2).cast("long") * 3600 + F.substring(text, 15, 2).cast("long") * 60 + F.substring(text, 18, 2).cast("long")).otherwise(0)
    return F.when(good, days * 86400 + clock)


def with_estimate(rows: DataFrame) -> DataFrame:
    """`rows` with earliest, latest, confidence and evidence by order of authority: the camera's
    date (capture), the date of digitising (digitised), a year in the name (name_year), and what
    kind of picture it is (scan, grey). Each date is parsed once, in a projection of its own."""
    rows = rows.withColumns({"_exact": parse_ymd(F.col("capture")), "_made": parse_ymd(F.col("digitised")), "_year": F.when(F.col("name_year").between(1900, 2100), F.col("name_year"))})
    exact, made, year, scan, grey = (F.col(c) for c in ("_exact", "_made", "_year", "scan", "grey"))
    made_year, lit = F.substring(made, 1, 4), F.lit
    answer = lambda a, b, c: F.struct(a.alias("earliest"), b.alias("latest"), F.lit(c).alias("confidence"))
    best = (
        F.when(exact.isNotNull(), answer(exact, exact, 0.95))
        .when(made.isNotNull() & scan, answer(lit("1900-01-01"), F.concat(made_year, lit("-12-31")), 0.25))
        .when(made.isNotNull(), answer(F.concat(made_year, lit("-01-01")), F.concat(made_year, lit("-12-31")), 0.5))
        .when(year.isNotNull(), answer(F.concat(year.cast("string"), lit("-01-01")), F.concat(year.cast("string"), lit("-12-31")), 0.55))
        .when(grey, answer(lit("1930-01-01"), lit("1979-12-31"), 0.20))
        .when(scan, answer(lit("1960-01-01"), lit("2005-12-31"), 0.18))
        .otherwise(answer(lit("1970-01-01"), lit("2025-12-31"), 0.10))
    )
    evidence = F.concat_ws(", ", F.when(exact.isNotNull(), "capture date"), F.when(made.isNotNull(), "digitised"), F.when(year.isNotNull(), "year in name"), F.when(grey, "grey"), F.when(scan, "scanned print"))
    rows = rows.withColumns({"_best": best, "evidence": evidence})
    return rows.withColumns({c: F.col("_best")[c] for c in ("earliest", "latest", "confidence")}).drop("_exact", "_made", "_year", "_best")


def describe(earliest: Column, latest: Column, confidence: Column, source: Column, confirmed: Column) -> Column:
    """A date in words that never shows an estimate as certain. source: capture, digitised or another."""
    first, last = F.substring(earliest, 1, 4), F.substring(latest, 1, 4)
    return (
        F.when(confirmed & (earliest == latest), F.concat(F.lit("Taken on "), earliest))
        .when(confirmed, F.concat(F.lit("Between "), earliest, F.lit(" and "), latest, F.lit(" (confirmed)")))
        .when(source == "capture", F.concat(F.lit("Taken on "), earliest))
        .when(source == "digitised", F.concat(F.lit("Digitised around "), last, F.lit("; original date unknown")))
        .when(earliest == latest, F.concat(F.lit("Around "), earliest))
        .when(confidence < 0.2, "Date uncertain")
        .otherwise(F.concat(F.lit("Likely taken between "), first, F.lit(" and "), last))
    )


def label(earliest: Column, latest: Column) -> Column:
    return F.when(earliest == latest, F.concat(F.lit("Around "), earliest)).otherwise(F.concat(F.lit("Likely between "), F.substring(earliest, 1, 4), F.lit(" and "), F.substring(latest, 1, 4)))


def age_minutes(stamp: Column, now: Column) -> Column:
    """Whole minutes since an RFC 3339 time; null for text that can't be read."""
    at = F.try_to_timestamp(stamp)
    return F.when(at.isNotNull(), F.floor((F.unix_timestamp(F.try_to_timestamp(now)) - F.unix_timestamp(at)) / 60))


def reconciled_status(status: Column, alive: Column, silent_minutes: Column) -> Column:
    """A run that says it is running, told by its process and its last sign of life."""
    return F.when(status != "running", status).when(~alive, "interrupted").when(silent_minutes >= 30, "stalled").otherwise("running")
