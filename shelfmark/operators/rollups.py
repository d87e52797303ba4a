"""Roll-ups over drives, tags, people and scans: one grouped plan for each question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def complete(files: DataFrame) -> DataFrame:
    """Rows that are searchable."""
    return files.where(F.col("status") == "complete")


def filled(text: Column) -> Column:
    """Neither null nor blank."""
    return text.isNotNull() & (F.length(F.trim(text)) > 0)


def top_per_group(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group in a given order, with their `rank` from 1."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def latest(rows: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """One row of each group, the first in a given order."""
    return top_per_group(rows, [by], order, 1).drop("rank")


def having_all(rows: DataFrame, key: str, member: str, wanted: list[str]) -> DataFrame:
    """Keys that have every wanted member; no members wanted gives no restriction."""
    if not wanted:
        return rows.select(key).distinct()
    have = rows.where(F.col(member).isin(wanted)).groupBy(key).agg(F.count_distinct(member).alias("n"))
    return have.where(F.col("n") == len(set(wanted))).select(key)


def drive_contents(drives: DataFrame, files: DataFrame, dates: DataFrame, tags: DataFrame, faces: DataFrame, top: int = 8) -> DataFrame:
    """One row per drive, drives without files included: counts, date range, top tags."""
    people = faces.groupBy("file_id").agg(F.count("*").alias("people"))
    facts = files.join(dates.select("file_id", "earliest", "latest"), "file_id", "left").join(people, "file_id", "left")
    good = F.col("status") == "complete"
    counts = facts.groupBy("drive_number").agg(
        F.count_if(good).alias("photo_count"),
        F.count_if(F.col("status") == "missing").alias("missing_count"),
        F.min(F.when(good, F.col("earliest"))).alias("earliest"),
        F.max(F.when(good, F.col("latest"))).alias("latest"),
        F.count_if(good & filled(F.col("text"))).alias("with_text_count"),
        F.sum(F.when(good, F.coalesce("people", F.lit(0))).otherwise(0)).alias("people_count"),
    )
    used = tags.where("tag_type <> 'person'").join(complete(files).select("file_id", "drive_number"), "file_id")
    best = top_per_group(used.groupBy("drive_number", "name").agg(F.count("*").alias("n")), ["drive_number"], [F.desc("n"), F.asc("name")], top)
    best = best.groupBy("drive_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), ",").alias("top_tags"))
    out = drives.select("drive_number", "name").join(counts, "drive_number", "left").join(best, "drive_number", "left")
    zero = {c: 0 for c in ("photo_count", "missing_count", "with_text_count", "people_count")}
    return out.fillna(zero).fillna({"top_tags": ""})


def summary_sentence(name: Column, count: Column, earliest: Column, latest: Column, tags: Column, online: Column, location: Column) -> Column:
    """A drive in words: name, count, years, first tags, where it is."""
    first, last = F.substring(earliest, 1, 4), F.substring(latest, 1, 4)
    years = F.when(first.isNull(), None).when(first == last, F.concat(F.lit("from "), first)).otherwise(F.concat(F.lit("from "), first, F.lit(" to "), last))
    few = F.array_join(F.slice(F.split(tags, ","), 1, 3), ", ")
    return F.concat_ws(
        ", ",
        F.concat(name, F.lit(": "), count.cast("string"), F.when(count == 1, " photograph").otherwise(" photographs")),
        years,
        F.when(tags != "", F.concat(F.lit("mostly "), few)),
        F.when(online, "connected").otherwise("not connected"),
        F.concat(F.lit("kept at "), location),
    )


def scan_stats(drives: DataFrame, files: DataFrame, faces: DataFrame, clusters: DataFrame, tags: DataFrame) -> DataFrame:
    """One row per drive: complete files and their bytes, faces, tags, distinct people."""
    place = files.select("file_id", "drive_number")
    counts = complete(files).groupBy("drive_number").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
    seen = faces.select("file_id", "cluster_id").join(place, "file_id").join(clusters.select("cluster_id", "person_id"), "cluster_id", "left")
    seen = seen.groupBy("drive_number").agg(F.count("*").alias("faces"), F.count_distinct("person_id").alias("people"))
    tagged = tags.select("file_id").join(place, "file_id").groupBy("drive_number").agg(F.count("*").alias("tags"))
    out = drives.select("drive_number").join(counts, "drive_number", "left").join(seen, "drive_number", "left").join(tagged, "drive_number", "left")
    return out.fillna(0).select("drive_number", "files", "bytes", "faces", "tags", "people")


def where_to_look(matches: DataFrame, drives: DataFrame) -> DataFrame:
    """One sentence for (drive_number, n): the drives, the one with the most, which to connect."""
    told = matches.join(drives.select("drive_number", "status", "location"), "drive_number")
    name = F.concat(F.lit("Drive "), F.col("drive_number").cast("string"))
    shown = F.concat(name, F.coalesce(F.concat(F.lit(" ("), "location", F.lit(")")), F.lit("")))
    order = [(-F.col("n")).alias("minus"), F.col("drive_number")]
    all_ = told.agg(
        F.transform(F.array_sort(F.collect_list("drive_number")), lambda x: x.cast("string")).alias("l"),
        F.min(F.struct(*order)).alias("best"),
        F.array_sort(F.collect_list(F.when(F.col("status") != "online", F.struct(*order, shown.alias("shown"))))).alias("off"),
    )
    l, n, off = F.col("l"), F.size("l"), F.col("off.shown")
    names = F.when(n == 1, F.concat(F.lit("Drive "), F.get(l, F.lit(0)))).otherwise(F.concat(F.lit("Drives "), F.array_join(F.slice(l, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.try_element_at(l, F.lit(-1))))
    most = F.when(n > 1, F.format_string(" Drive %s has the most (%s).", F.col("best.drive_number").cast("string"), (-F.col("best.minus")).cast("string")))
    connect = F.when(F.size(off) > 0, F.concat(F.lit(" Connect "), F.array_join(off, ", "), F.lit(" to open the originals.")))
    sentence = F.concat(F.lit("Found on "), names, F.lit("."), F.coalesce(most, F.lit("")), F.coalesce(connect, F.lit("")))
    return all_.select(F.when(n == 0, "Not found on any indexed drive.").otherwise(sentence).alias("sentence"))


def coverage(drives: DataFrame, files: DataFrame, runs: DataFrame) -> DataFrame:
    """How much of each drive is indexed, against its latest real scan."""
    counts = files.groupBy("drive_number").agg(F.count_if(F.col("status") == "complete").alias("complete"), F.count_if(F.col("status") == "failed").alias("failed"))
    last = latest(runs.where("mode <> 'dry_run'"), "drive_number", [F.desc("started"), F.desc("run_id")]).select("drive_number", F.col("files_discovered").alias("discovered"))
    out = drives.select("drive_number").join(counts, "drive_number", "left").join(last, "drive_number", "left").fillna(0)
    done, found = F.col("complete"), F.col("discovered")
    percent = F.when(found == 0, F.when(done > 0, 100.0).otherwise(0.0)).otherwise(F.least(done * 100.0 / found, F.lit(100.0)))
    out = out.withColumn("outstanding", F.greatest(found - done, F.lit(0))).withColumn("percent", F.round(percent, 6))
    return out.withColumn("can_unplug", (F.col("outstanding") == 0) & (done > 0))


def throughput(runs: DataFrame, default: float = 0.30) -> DataFrame:
    """Files a second over finished real runs: a ratio of sums, else the default."""
    ended = runs.where("mode <> 'dry_run' AND ended IS NOT NULL")
    rate = F.sum("files_done") / F.nullif(F.sum(F.col("ended") - F.col("started")), F.lit(0))
    return ended.agg(F.round(F.coalesce(rate, F.lit(default)), 9).alias("files_per_second"))


def compare_collections(files: DataFrame, collection: str = "drive_number", content: str = "content_hash") -> DataFrame:
    """Every pair of collections that share content: a, b, shared, a_total, b_total, overlap.

    One join on the content's hash instead of a comparison for each pair. A content that a
    great many collections share costs their pairs, which are rows of the result.
    """
    held = files.where(F.col(content).isNotNull()).select(collection, content).distinct()
    totals = held.groupBy(collection).agg(F.count("*").alias("total"))
    a, b = held.select(F.col(collection).alias("a"), content), held.select(F.col(collection).alias("b"), content)
    shared = a.join(b, content).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    out = shared.join(totals.select(F.col(collection).alias("a"), F.col("total").alias("a_total")), "a").join(totals.select(F.col(collection).alias("b"), F.col("total").alias("b_total")), "b")
    overlap = F.round(F.col("shared") * 100.0 / F.greatest("a_total", "b_total"), 6)
    return out.withColumn("overlap", overlap).withColumn("near_identical", (F.col("overlap") >= 95) & (F.col("shared") > 0))


def compare_two(files: DataFrame, a: int, b: int, collection: str = "drive_number", content: str = "content_hash") -> DataFrame:
    """Contents of two collections in one pass: shared, only_a, only_b, with their bytes."""
    if a == b:
        raise ValueError("a collection isn't compared with itself")
    flags = files.where(F.col(collection).isin(a, b) & F.col(content).isNotNull()).groupBy(content).agg(
        F.bool_or(F.col(collection) == a).alias("in_a"), F.bool_or(F.col(collection) == b).alias("in_b"), F.max("size_bytes").alias("size"))
    only_a, only_b = F.col("in_a") & ~F.col("in_b"), F.col("in_b") & ~F.col("in_a")
    size = lambda c: F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0))
    out = flags.agg(F.count_if(F.col("in_a") & F.col("in_b")).alias("shared"), F.count_if(F.col("in_a")).alias("a_total"), F.count_if(F.col("in_b")).alias("b_total"), F.count_if(only_a).alias("only_a"), F.count_if(only_b).alias("only_b"), size(only_a).alias("only_a_bytes"), size(only_b).alias("only_b_bytes"))
    most = F.greatest("a_total", "b_total")
    out = out.withColumn("overlap", F.round(F.when(most > 0, F.col("shared") * 100.0 / most).otherwise(0.0), 6))
    within = lambda x, y: f"Drive {x} is contained in drive {y}: everything on {x} is also on {y}, and {y} holds %d more."
    words = (
        F.when(F.col("shared") == 0, f"Drives {a} and {b} have nothing in common.")
        .when((F.col("only_a") == 0) & (F.col("only_b") == 0), F.format_string(f"Drives {a} and {b} are identical — same %d files.", "shared"))
        .when(F.col("only_b") == 0, F.format_string(within(b, a), "only_a"))
        .when(F.col("only_a") == 0, F.format_string(within(a, b), "only_b"))
        .otherwise(F.format_string(f"Drives {a} and {b} are %.1f%% identical: %d files in common, %d only on {a}, %d only on {b}.", F.col("shared") * 100.0 / most, "shared", "only_a", "only_b"))
    )
    return out.withColumn("sentence", words)
