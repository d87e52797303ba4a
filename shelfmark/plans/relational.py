"""Filters, joins, aggregates, sorts and set operations of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.operators import rollups as R
from shelfmark.plans.registry import query

SOME_TAGS = ["brand#1", "brand#2"]


@query("live_rows", "SELECT file_id, drive_number FROM files WHERE status = 'complete'")
def live_rows(c):
    return R.complete(c.files).select("file_id", "drive_number")


@query("filter_drive", "SELECT file_id, d.name FROM files f JOIN drives d USING (drive_number) WHERE d.drive_number = 6 AND f.status = 'complete'")
def filter_drive(c):
    return R.complete(c.files).join(c.drives.where("drive_number = 6").select("drive_number", "name"), "drive_number").select("file_id", "name")


_ALL = "SELECT file_id FROM file_tags WHERE name IN ('brand#1', 'brand#2') GROUP BY file_id HAVING count(DISTINCT name) = 2"


@query("filter_all_tags", f"SELECT file_id FROM files WHERE status = 'complete' AND file_id IN ({_ALL})")
def filter_all_tags(c):
    return R.complete(c.files).join(R.having_all(c.file_tags, "file_id", "name", SOME_TAGS), "file_id", "left_semi").select("file_id")


@query("filter_online", "SELECT file_id FROM files JOIN drives d USING (drive_number) WHERE d.status = 'online'")
def filter_online(c):
    return c.files.join(c.drives.where("status = 'online'"), "drive_number", "left_semi").select("file_id")


@query("filter_event", "SELECT file_id FROM files f WHERE EXISTS (SELECT 1 FROM captures e WHERE e.file_id = f.file_id AND e.event_type = 'click')")
def filter_event(c):
    return c.files.join(c.captures.where("event_type = 'click'"), "file_id", "left_semi").select("file_id")


@query("filter_client", "SELECT file_id FROM files f WHERE EXISTS (SELECT 1 FROM captures e JOIN people p ON p.person_id = e.owner % 12 WHERE e.file_id = f.file_id AND lower(p.name) = lower('person 3'))")
def filter_client(c):
    named = c.people.where(F.lower("name") == F.lower(F.lit("person 3"))).select("person_id")
    members = c.captures.withColumn("person_id", (F.col("owner") % 12).cast("int")).join(named, "person_id", "left_semi")
    return c.files.join(members, "file_id", "left_semi").select("file_id")


@query("post_filter", f"WITH top AS (SELECT file_id, drive_number FROM files ORDER BY size_bytes DESC, file_id LIMIT 200) SELECT file_id FROM top JOIN drives d USING (drive_number) WHERE d.status = 'online' AND file_id IN ({_ALL})")
def post_filter(c):
    top = c.files.orderBy(F.desc("size_bytes"), "file_id").limit(200).select("file_id", "drive_number")
    return top.join(c.drives.where("status = 'online'"), "drive_number", "left_semi").join(R.having_all(c.file_tags, "file_id", "name", SOME_TAGS), "file_id", "left_semi").select("file_id")


@query("escape_literal", "SELECT file_id FROM files WHERE relative_path <> 'it''s' AND extension = 'en'")
def escape_literal(c):
    return c.spark.sql("SELECT file_id FROM {files} WHERE relative_path <> :odd AND extension = :ext", args={"odd": "it's", "ext": "en"}, files=c.files)


@query("null_blank", "SELECT drive_number FROM drives WHERE location IS NOT NULL AND length(trim(location)) > 0")
def null_blank(c):
    return c.drives.where(R.filled(F.col("location"))).select("drive_number")


@query("recency_skip", "SELECT run_id FROM runs WHERE heartbeat IS NULL OR (1000000000 - heartbeat) / 86400.0 >= 365.5")
def recency_skip(c):
    return c.runs.where("heartbeat IS NULL OR (1000000000 - heartbeat) / 86400.0D >= 365.5D").select("run_id")


@query("dynamic_sql", "SELECT file_id FROM files WHERE drive_number = 3 AND extension = 'en' AND size_bytes >= 500")
def dynamic_sql(c):
    rows, wanted = c.files, {"drive_number": 3, "extension": "en", "size_bytes": None}
    for name, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows.where("size_bytes >= 500").select("file_id")


@query("equi_inner", "SELECT d.drive_number, t.name, count(*) AS n FROM file_tags t JOIN files f USING (file_id) JOIN drives d USING (drive_number) WHERE t.tag_type = 'object' GROUP BY 1, 2")
def equi_inner(c):
    tags = c.file_tags.where("tag_type = 'object'")
    return tags.join(c.files.select("file_id", "drive_number"), "file_id").join(c.drives.select("drive_number"), "drive_number").groupBy("drive_number", "name").agg(F.count("*").alias("n"))


@query("inner_5way", "SELECT DISTINCT p.name, d.drive_number FROM faces a JOIN clusters k USING (cluster_id) JOIN people p ON p.person_id = k.person_id JOIN files f USING (file_id) JOIN drives d ON d.drive_number = f.drive_number")
def inner_5way(c):
    rows = c.faces.select("cluster_id", "file_id").join(c.clusters.select("cluster_id", "person_id"), "cluster_id").join(c.people.select("person_id", "name"), "person_id")
    return rows.join(c.files.select("file_id", "drive_number"), "file_id").join(c.drives.select("drive_number"), "drive_number").select("name", "drive_number").distinct()


@query("left_outer", "SELECT f.file_id, d.name, e.earliest FROM files f JOIN drives d USING (drive_number) LEFT JOIN (SELECT * FROM dates WHERE confirmed) e USING (file_id)")
def left_outer(c):
    return c.files.join(c.drives.select("drive_number", "name"), "drive_number").join(c.dates.where("confirmed").select("file_id", "earliest"), "file_id", "left").select("file_id", "name", "earliest")


@query("left_outer_gallery", "SELECT a.face_id, k.status, p.name FROM faces a LEFT JOIN clusters k ON k.cluster_id = a.cluster_id AND k.status <> 'unnamed' LEFT JOIN people p ON p.person_id = k.person_id WHERE NOT a.is_ignored AND (k.status IS NULL OR k.status <> 'rejected')")
def left_outer_gallery(c):
    named = c.clusters.where("status <> 'unnamed'").select("cluster_id", "status", F.col("person_id").alias("pid"))
    rows = c.faces.where("NOT is_ignored").join(named, "cluster_id", "left").join(c.people.select(F.col("person_id").alias("pid"), "name"), "pid", "left")
    return rows.where(F.col("status").isNull() | (F.col("status") != "rejected")).select("face_id", "status", "name")


@query("semi_exists", "SELECT item_id FROM queue q WHERE EXISTS (SELECT 1 FROM queue x WHERE x.queue_key = q.queue_key AND x.state = 'failed' AND x.code = 3)")
def semi_exists(c):
    return c.queue.join(c.queue.where("state = 'failed' AND code = 3").select("queue_key"), "queue_key", "left_semi").select("item_id")


@query("anti_not_exists", "SELECT file_id FROM files f WHERE NOT EXISTS (SELECT 1 FROM captures e WHERE e.file_id = f.file_id AND e.event_type IN ('click', 'view'))")
def anti_not_exists(c):
    return c.files.join(c.captures.where("event_type IN ('click', 'view')"), "file_id", "left_anti").select("file_id")


@query("anti_not_in", "SELECT DISTINCT content_hash FROM files WHERE drive_number = 1 AND content_hash IS NOT NULL AND content_hash NOT IN (SELECT content_hash FROM files WHERE drive_number = 2 AND content_hash IS NOT NULL)")
def anti_not_in(c):
    have = c.files.where("content_hash IS NOT NULL")
    return have.where("drive_number = 1").join(have.where("drive_number = 2"), "content_hash", "left_anti").select("content_hash").distinct()


@query("scalar_subq_count", "SELECT drive_number, (SELECT count(*) FROM files f WHERE f.drive_number = d.drive_number) AS n FROM drives d")
def scalar_subq_count(c):
    counts = c.files.groupBy("drive_number").agg(F.count("*").alias("n"))
    return c.drives.select("drive_number").join(counts, "drive_number", "left").fillna(0)


@query("scalar_subq_top1", "SELECT drive_number, run_id FROM (SELECT *, row_number() OVER (PARTITION BY drive_number ORDER BY started DESC, run_id DESC) AS r FROM runs WHERE mode <> 'dry_run') WHERE r = 1")
def scalar_subq_top1(c):
    last = c.runs.where("mode <> 'dry_run'").groupBy("drive_number").agg(F.max(F.struct("started", "run_id")).alias("m"))
    return last.select("drive_number", "m.run_id")


@query("self_count", "SELECT face_id, CASE WHEN cluster_id IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY cluster_id) END AS n FROM faces")
def self_count(c):
    return c.faces.select("face_id", F.when(F.col("cluster_id").isNull(), 1).otherwise(F.count("*").over(Window.partitionBy("cluster_id"))).alias("n"))


_PAIRS = "SELECT a.drive_number AS a, b.drive_number AS b, count(*) AS shared FROM (SELECT DISTINCT drive_number, content_hash FROM files) a JOIN (SELECT DISTINCT drive_number, content_hash FROM files) b USING (content_hash) WHERE a.drive_number < b.drive_number GROUP BY 1, 2"


@query("pairwise_lt", _PAIRS)
def pairwise_lt(c):
    return R.compare_collections(c.files).select("a", "b", "shared")


_RECON = """WITH seen AS (SELECT drive_number, relative_path, CASE WHEN file_id % 7 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, mtime_ns FROM files WHERE file_id % 5 <> 0
  UNION ALL SELECT drive_number, 'new/' || relative_path, size_bytes, mtime_ns FROM files WHERE file_id % 50 = 0)
SELECT coalesce(f.relative_path, s.relative_path) AS relative_path, CASE WHEN f.relative_path IS NULL THEN 'new'
  WHEN s.relative_path IS NULL THEN CASE WHEN f.status = 'missing' THEN 'still_missing' ELSE 'missing' END
  WHEN f.status = 'missing' OR (f.status = 'complete' AND (f.size_bytes <> s.size_bytes OR f.mtime_ns <> s.mtime_ns)) THEN 'changed' ELSE 'unchanged' END AS verdict
FROM files f FULL JOIN seen s ON f.drive_number = s.drive_number AND f.relative_path = s.relative_path"""


def _seen(c):
    same = c.files.where("file_id % 5 <> 0").selectExpr("drive_number", "relative_path", "CASE WHEN file_id % 7 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes", "mtime_ns")
    return same.union(c.files.where("file_id % 50 = 0").selectExpr("drive_number", "concat('new/', relative_path)", "size_bytes", "mtime_ns"))


def _reconcile(c):
    from shelfmark.operators.changes import reconcile

    return reconcile(c.files, _seen(c)).select("relative_path", "verdict")


query("reconcile_outer", _RECON)(_reconcile)
query("rescan_reconcile", f"SELECT verdict, count(*) AS n FROM ({_RECON}) GROUP BY 1")(lambda c: _reconcile(c).groupBy("verdict").agg(F.count("*").alias("n")))


@query("drive_contents", """SELECT d.drive_number, d.name, coalesce(photo_count, 0) AS photo_count, coalesce(missing_count, 0) AS missing_count, earliest, latest, coalesce(with_text_count, 0) AS with_text_count, coalesce(people_count, 0) AS people_count, coalesce(top_tags, '') AS top_tags
FROM drives d LEFT JOIN (SELECT drive_number, count(*) FILTER (status = 'complete') AS photo_count, count(*) FILTER (status = 'missing') AS missing_count, min(earliest) FILTER (status = 'complete') AS earliest, max(latest) FILTER (status = 'complete') AS latest,
  count(*) FILTER (status = 'complete' AND length(trim(text)) > 0) AS with_text_count, coalesce(sum(people) FILTER (status = 'complete'), 0)::BIGINT AS people_count
  FROM files LEFT JOIN dates USING (file_id) LEFT JOIN (SELECT file_id, count(*) AS people FROM faces GROUP BY 1) USING (file_id) GROUP BY 1) USING (drive_number)
LEFT JOIN (SELECT drive_number, string_agg(name, ',' ORDER BY n DESC, name) AS top_tags FROM (SELECT drive_number, t.name, count(*) AS n, row_number() OVER (PARTITION BY drive_number ORDER BY count(*) DESC, t.name) AS r FROM file_tags t JOIN files f USING (file_id) WHERE tag_type <> 'person' AND f.status = 'complete' GROUP BY 1, 2) WHERE r <= 8 GROUP BY 1) USING (drive_number)""")
def drive_contents(c):
    return R.drive_contents(c.drives, c.files, c.dates, c.file_tags, c.faces)


@query("drive_summary_text", """WITH t AS (SELECT drive_number, count(*) AS n, min(substr(earliest, 1, 4)) AS a, max(substr(latest, 1, 4)) AS b FROM files LEFT JOIN dates USING (file_id) WHERE status = 'complete' GROUP BY 1)
SELECT d.drive_number, concat_ws(', ', d.name || ': ' || coalesce(n, 0) || CASE WHEN n = 1 THEN ' photograph' ELSE ' photographs' END, CASE WHEN a = b THEN 'from ' || a ELSE 'from ' || a || ' to ' || b END,
  'mostly ' || tags, CASE WHEN d.status = 'online' THEN 'connected' ELSE 'not connected' END, 'kept at ' || location) AS sentence FROM drives d LEFT JOIN t USING (drive_number)
LEFT JOIN (SELECT drive_number, string_agg(name, ', ' ORDER BY n DESC, name) AS tags FROM (SELECT drive_number, t.name, count(*) AS n FROM file_tags t JOIN files f USING (file_id) WHERE tag_type <> 'person' AND f.status = 'complete' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY drive_number ORDER BY count(*) DESC, t.name) <= 3) GROUP BY 1) USING (drive_number)""")
def drive_summary_text(c):
    rows = R.drive_contents(c.drives, c.files, c.dates, c.file_tags, c.faces).join(c.drives.select("drive_number", "status", "location"), "drive_number")
    return rows.select("drive_number", R.summary_sentence(F.col("name"), F.col("photo_count"), F.col("earliest"), F.col("latest"), F.col("top_tags"), F.col("status") == "online", F.col("location")).alias("sentence"))


@query("tag_cloud", "SELECT name, n FROM (SELECT name, count(*) AS n FROM file_tags JOIN files USING (file_id) WHERE status = 'complete' GROUP BY 1 ORDER BY n DESC, name LIMIT 12) ORDER BY lower(name)")
def tag_cloud(c):
    counts = c.file_tags.join(R.complete(c.files), "file_id", "left_semi").groupBy("name").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "name").limit(12).orderBy(F.lower("name"))


query("two_stage_sort", "SELECT name, n FROM (SELECT name, count(*) AS n FROM file_tags GROUP BY 1 ORDER BY n DESC, name LIMIT 7) ORDER BY lower(name)")(
    lambda c: c.file_tags.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(7).orderBy(F.lower("name"))
)


@query("drives_matching", "WITH hits AS (SELECT file_id, drive_number, filename, row_number() OVER (ORDER BY size_bytes DESC, file_id) AS r FROM files QUALIFY r <= 100) SELECT drive_number, count(*) AS n, list_aggregate(list_slice(list(filename ORDER BY r), 1, 3), 'string_agg', ',') AS sample FROM hits GROUP BY 1")
def drives_matching(c):
    hits = c.files.orderBy(F.desc("size_bytes"), "file_id").limit(100).select("drive_number", "filename", F.struct(-F.col("size_bytes"), "file_id").alias("r"))
    grouped = hits.groupBy("drive_number").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("r", "filename"))).alias("f"))
    return grouped.select("drive_number", "n", F.array_join(F.slice("f.filename", 1, 3), ",").alias("sample"))


@query("locate_matches", "SELECT file_id, coalesce(location, 'unknown') AS location FROM (SELECT * FROM files ORDER BY size_bytes DESC, file_id LIMIT 50) JOIN drives USING (drive_number)")
def locate_matches(c):
    top = c.files.orderBy(F.desc("size_bytes"), "file_id").limit(50)
    return top.join(c.drives.select("drive_number", "location"), "drive_number").select("file_id", F.coalesce("location", F.lit("unknown")).alias("location"))


@query("where_to_look", """WITH h AS (SELECT * FROM files ORDER BY size_bytes DESC, file_id LIMIT 9),
m AS (SELECT drive_number AS d, count(*) AS n, any_value(drives.status) = 'online' AS online, any_value(location) AS location FROM h JOIN drives USING (drive_number) GROUP BY 1),
x AS (SELECT list(d ORDER BY d) AS l, list(d ORDER BY n DESC, d)[1] AS best, max(n) AS most, list('Drive ' || d || CASE WHEN location IS NULL THEN '' ELSE ' (' || location || ')' END ORDER BY n DESC, d) FILTER (NOT online) AS off FROM m)
SELECT CASE WHEN l IS NULL THEN 'Not found on any indexed drive.' ELSE concat('Found on ', CASE WHEN len(l) = 1 THEN 'Drive ' || l[1] ELSE 'Drives ' || array_to_string(l[:-2], ', ') || ' and ' || l[-1] END, '.',
  CASE WHEN len(l) > 1 THEN ' Drive ' || best || ' has the most (' || most || ').' END, CASE WHEN off IS NOT NULL THEN ' Connect ' || array_to_string(off, ', ') || ' to open the originals.' END) END AS sentence FROM x""")
def where_to_look(c):
    hits = c.files.orderBy(F.desc("size_bytes"), "file_id").limit(9)
    return R.where_to_look(hits.groupBy("drive_number").agg(F.count("*").alias("n")), c.drives)


@query("drive_coverage", """WITH k AS (SELECT drive_number, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'failed') AS failed FROM files GROUP BY 1),
l AS (SELECT drive_number, files_discovered AS discovered FROM runs WHERE mode <> 'dry_run' QUALIFY row_number() OVER (PARTITION BY drive_number ORDER BY started DESC, run_id DESC) = 1),
o AS (SELECT d.drive_number, coalesce(complete, 0) AS complete, coalesce(failed, 0) AS failed, coalesce(discovered, 0) AS discovered FROM drives d LEFT JOIN k USING (drive_number) LEFT JOIN l USING (drive_number))
SELECT *, greatest(discovered - complete, 0) AS outstanding, round(CASE WHEN discovered = 0 THEN CASE WHEN complete > 0 THEN 100.0 ELSE 0.0 END ELSE least(complete * 100.0::DOUBLE / discovered, 100.0) END::DOUBLE, 6) AS percent, discovered <= complete AND complete > 0 AS can_unplug FROM o""")
def drive_coverage(c):
    return R.coverage(c.drives, c.files, c.runs)


@query("running_scans", "SELECT run_id, (1200000000 - coalesce(heartbeat, started)) // 60 AS silent_minutes, (1200000000 - coalesce(heartbeat, started)) // 60 >= 30 AS stale FROM runs WHERE outcome = 'running' AND mode <> 'dry_run'")
def running_scans(c):
    silent = F.floor((F.lit(1200000000) - F.coalesce("heartbeat", "started")) / 60)
    return c.runs.where("outcome = 'running' AND mode <> 'dry_run'").select("run_id", silent.alias("silent_minutes"), (silent >= 30).alias("stale"))


@query("estimate_indexing", """WITH r AS (SELECT round(coalesce(sum(files_done)::DOUBLE / nullif(sum(ended - started), 0), 0.3), 9) AS files_per_second FROM runs WHERE mode <> 'dry_run' AND ended IS NOT NULL)
SELECT files_per_second, round(100000 / files_per_second / 3600, 4) AS hours, 100000 / files_per_second / 3600 > 10 AS is_long FROM r""")
def estimate_indexing(c):
    hours = F.lit(100000) / F.col("files_per_second") / 3600
    return R.throughput(c.runs).select("files_per_second", F.round(hours, 4).alias("hours"), (hours > 10).alias("is_long"))


@query("scan_stats", """WITH f AS (SELECT drive_number, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM files WHERE status = 'complete' GROUP BY 1),
a AS (SELECT drive_number, count(*) AS faces, count(DISTINCT person_id) AS people FROM (SELECT f.drive_number, c.person_id FROM faces JOIN files f USING (file_id) LEFT JOIN clusters c USING (cluster_id)) GROUP BY 1),
t AS (SELECT drive_number, count(*) AS tags FROM file_tags JOIN files USING (file_id) GROUP BY 1)
SELECT drive_number, coalesce(files, 0) AS files, coalesce(bytes, 0)::BIGINT AS bytes, coalesce(faces, 0) AS faces, coalesce(tags, 0) AS tags, coalesce(people, 0) AS people FROM drives LEFT JOIN f USING (drive_number) LEFT JOIN a USING (drive_number) LEFT JOIN t USING (drive_number)""")
def scan_stats(c):
    return R.scan_stats(c.drives, c.files, c.faces, c.clusters, c.file_tags)


@query("scan_extensions", "SELECT coalesce(lower(extension), '?') AS extension, count(*) AS n, sum(size_bytes)::BIGINT AS bytes, count(DISTINCT drive_number) AS drives FROM files WHERE status = 'complete' GROUP BY 1")
def scan_extensions(c):
    return R.complete(c.files).groupBy(F.coalesce(F.lower("extension"), F.lit("?")).alias("extension")).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"), F.count_distinct("drive_number").alias("drives"))


@query("scan_recent", "SELECT file_id, tag FROM (SELECT file_id FROM files WHERE status = 'complete' ORDER BY ingest_seq DESC LIMIT 20) LEFT JOIN (SELECT file_id, name AS tag FROM file_tags QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY confidence DESC, name) = 1) USING (file_id)")
def scan_recent(c):
    best = R.latest(c.file_tags, "file_id", [F.desc("confidence"), F.asc("name")]).select("file_id", F.col("name").alias("tag"))
    return R.complete(c.files).orderBy(F.desc("ingest_seq")).limit(20).select("file_id").join(best, "file_id", "left")


@query("distinct_contents", "SELECT drive_number, count(DISTINCT content_hash) AS n FROM files GROUP BY 1")
def distinct_contents(c):
    return c.files.groupBy("drive_number").agg(F.count_distinct("content_hash").alias("n"))


@query("unique_totals", "SELECT count(*) AS n, coalesce(sum(s), 0)::BIGINT AS bytes FROM (SELECT content_hash, max(size_bytes) AS s FROM files WHERE content_hash IS NOT NULL GROUP BY 1)")
def unique_totals(c):
    return c.files.where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.max("size_bytes").alias("s")).agg(F.count("*").alias("n"), F.coalesce(F.sum("s"), F.lit(0)).alias("bytes"))


@query("clients", "SELECT min(name) AS client, count(*) AS n FROM captures JOIN people ON person_id = owner % 12 GROUP BY lower(name)")
def clients(c):
    rows = c.captures.withColumn("person_id", (F.col("owner") % 12).cast("int")).join(c.people, "person_id")
    return rows.groupBy(F.lower("name").alias("k")).agg(F.min("name").alias("client"), F.count("*").alias("n")).select("client", "n")


@query("relationships", "SELECT relationship, count(*) AS n FROM people WHERE relationship IS NOT NULL AND trim(relationship) <> '' GROUP BY 1")
def relationships(c):
    return c.people.where(R.filled(F.col("relationship"))).groupBy("relationship").agg(F.count("*").alias("n"))


@query("failure_reasons", "SELECT code, 'E' || code AS message, count(*) AS n, max(path) AS example FROM queue WHERE state = 'failed' GROUP BY 1, 2 ORDER BY n DESC, code LIMIT 20")
def failure_reasons(c):
    failed = c.queue.where("state = 'failed'").withColumn("message", F.concat(F.lit("E"), F.col("code")))
    return failed.groupBy("code", "message").agg(F.count("*").alias("n"), F.max("path").alias("example")).orderBy(F.desc("n"), "code").limit(20)


@query("queue_stats", "SELECT count(*) FILTER (state = 'queued') AS queued, count(*) FILTER (state = 'leased') AS leased, count(*) FILTER (state = 'complete') AS complete, count(*) FILTER (state = 'failed') AS failed, count(*) AS total, count(*) FILTER (state IN ('queued', 'leased')) = 0 AS drained FROM queue")
def queue_stats(c):
    of = lambda s: F.count_if(F.col("state") == s)
    counts = c.queue.agg(*[of(s).alias(s) for s in ("queued", "leased", "complete", "failed")], F.count("*").alias("total"))
    return counts.withColumn("drained", (F.col("queued") == 0) & (F.col("leased") == 0))


@query("people_counts", "SELECT p.person_id, count(a.face_id) FILTER (k.status = 'confirmed') AS confirmed, count(a.face_id) FILTER (k.status = 'suggested') AS suggested FROM people p LEFT JOIN clusters k ON k.person_id = p.person_id LEFT JOIN faces a ON a.cluster_id = k.cluster_id GROUP BY 1")
def people_counts(c):
    rows = c.faces.select("face_id", "cluster_id").join(c.clusters, "cluster_id").groupBy("person_id").agg(F.count_if(F.col("status") == "confirmed").alias("confirmed"), F.count_if(F.col("status") == "suggested").alias("suggested"))
    return c.people.select("person_id").join(rows, "person_id", "left").fillna(0)


@query("folders_for_person", "SELECT drive_number, coalesce(nullif(regexp_extract(relative_path, '^(.*)/[^/]*$', 1), ''), '.') AS folder, count(DISTINCT f.file_id) AS n FROM files f JOIN faces a USING (file_id) WHERE a.person_id = 3 GROUP BY 1, 2")
def folders_for_person(c):
    folder = F.coalesce(F.nullif(F.regexp_extract("relative_path", "^(.*)/[^/]*$", 1), F.lit("")), F.lit("."))
    return c.files.join(c.faces.where("person_id = 3"), "file_id", "left_semi").groupBy("drive_number", folder.alias("folder")).agg(F.count("*").alias("n"))


@query("prepare_review", "SELECT k.cluster_id, count(a.face_id) AS n FROM clusters k LEFT JOIN faces a USING (cluster_id) WHERE k.status = 'unnamed' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def prepare_review(c):
    return c.clusters.where("status = 'unnamed'").join(c.faces.select("cluster_id", "face_id"), "cluster_id", "left").groupBy("cluster_id").agg(F.count("face_id").alias("n")).orderBy(F.desc("n"), "cluster_id").limit(10)


@query("dominant_model", "SELECT person_id AS model_id, count(*) AS n FROM faces GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1")
def dominant_model(c):
    return c.faces.groupBy(F.col("person_id").alias("model_id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "model_id").limit(1)


@query("group_concat_tags", "SELECT f.file_id, coalesce(string_agg(t.name, ' ' ORDER BY t.name, t.tag_type), '') AS tags FROM files f LEFT JOIN file_tags t USING (file_id) GROUP BY 1")
def group_concat_tags(c):
    joined = c.file_tags.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "tag_type"))), lambda x: x["name"]), " ").alias("tags"))
    return c.files.select("file_id").join(joined, "file_id", "left").fillna("")


@query("embedding_health", "SELECT count(*) AS total, max(len(embedding)) AS dim, count(*) FILTER (len(embedding) <> 64) AS mismatched, count(*) FILTER (len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0) AS not_finite, (SELECT max(n) FROM (SELECT count(*) AS n FROM faces GROUP BY embedding)) AS most_identical FROM faces")
def embedding_health(c):
    odd = F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    facts = c.faces.select(F.xxhash64("embedding").alias("h"), F.size("embedding").alias("d"), odd.alias("odd"))
    by = facts.groupBy("h").agg(F.count("*").alias("n"), F.max("d").alias("d"), F.count_if(F.col("d") != 64).alias("m"), F.count_if("odd").alias("o"))
    return by.agg(F.sum("n").alias("total"), F.max("d").alias("dim"), F.sum("m").alias("mismatched"), F.sum("o").alias("not_finite"), F.max("n").alias("most_identical"))


@query("catalogue_counts", "SELECT 'files' AS what, status, count(*) AS n FROM files GROUP BY 2 UNION ALL SELECT 'clusters', status, count(*) FROM clusters GROUP BY 2 UNION ALL SELECT 'queue', state, count(*) FROM queue GROUP BY 2")
def catalogue_counts(c):
    of = lambda df, what, s: df.groupBy(F.lit(what).alias("what"), F.col(s).alias("status")).agg(F.count("*").alias("n"))
    return of(c.files, "files", "status").union(of(c.clusters, "clusters", "status")).union(of(c.queue, "queue", "state"))


_TWO = """WITH h AS (SELECT content_hash, bool_or(drive_number = 1) AS a, bool_or(drive_number = 2) AS b, max(size_bytes) AS s FROM files WHERE drive_number IN (1, 2) GROUP BY 1),
t AS (SELECT count(*) FILTER (a AND b) AS shared, count(*) FILTER (a) AS a_total, count(*) FILTER (b) AS b_total, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b, coalesce(sum(s) FILTER (a AND NOT b), 0)::BIGINT AS only_a_bytes, coalesce(sum(s) FILTER (b AND NOT a), 0)::BIGINT AS only_b_bytes FROM h)"""


@query("compare_drives", _TWO + " SELECT *, round(CASE WHEN greatest(a_total, b_total) > 0 THEN shared * 100.0::DOUBLE / greatest(a_total, b_total) ELSE 0 END, 6) AS overlap, CASE WHEN shared = 0 THEN 'Drives 1 and 2 have nothing in common.' WHEN only_a = 0 AND only_b = 0 THEN format('Drives 1 and 2 are identical — same {} files.', shared) WHEN only_b = 0 THEN format('Drive 2 is contained in drive 1: everything on 2 is also on 1, and 1 holds {} more.', only_a) WHEN only_a = 0 THEN format('Drive 1 is contained in drive 2: everything on 1 is also on 2, and 2 holds {} more.', only_b) ELSE format('Drives 1 and 2 are {:.1f}% identical: {} files in common, {} only on 1, {} only on 2.', shared * 100.0::DOUBLE / greatest(a_total, b_total), shared, only_a, only_b) END AS sentence FROM t")
def compare_drives(c):
    return R.compare_two(c.files, 1, 2)


query("compare_summary", _TWO + " SELECT round(shared * 100.0::DOUBLE / greatest(a_total, b_total), 6) AS overlap, shared * 100.0 / greatest(a_total, b_total) >= 95 AND shared > 0 AS near_identical FROM t")(
    lambda c: R.compare_two(c.files, 1, 2).select("overlap", ((F.col("overlap") >= 95) & (F.col("shared") > 0)).alias("near_identical"))
)


@query("intersect_contents", "SELECT count(*) AS shared FROM (SELECT content_hash FROM files WHERE drive_number = 1 INTERSECT SELECT content_hash FROM files WHERE drive_number = 2)")
def intersect_contents(c):
    of = lambda n: c.files.where(F.col("drive_number") == n).select("content_hash")
    return of(1).intersect(of(2)).agg(F.count("*").alias("shared"))


@query("only_in_a", "SELECT DISTINCT content_hash FROM files WHERE drive_number = 4 EXCEPT SELECT content_hash FROM files WHERE drive_number = 5")
def only_in_a(c):
    return c.files.where("drive_number = 4").select("content_hash").exceptAll(c.files.where("drive_number = 99").select("content_hash")).distinct().join(c.files.where("drive_number = 5"), "content_hash", "left_anti")


query("only_in_b", "SELECT DISTINCT content_hash FROM files WHERE drive_number = 5 EXCEPT SELECT content_hash FROM files WHERE drive_number = 4")(
    lambda c: c.files.where("drive_number = 5").join(c.files.where("drive_number = 4"), "content_hash", "left_anti").select("content_hash").distinct()
)


@query("find_near_identical", f"WITH p AS ({_PAIRS}), n AS (SELECT drive_number, count(DISTINCT content_hash) AS total FROM files GROUP BY 1) SELECT a, b, shared, x.total AS a_total, y.total AS b_total, round(shared * 100.0::DOUBLE / greatest(x.total, y.total), 6) AS overlap FROM p JOIN n x ON x.drive_number = a JOIN n y ON y.drive_number = b WHERE shared * 100.0 / greatest(x.total, y.total) >= 4 ORDER BY overlap DESC, a, b")
def find_near_identical(c):
    return R.compare_collections(c.files).where("overlap >= 4").drop("near_identical").orderBy(F.desc("overlap"), "a", "b")


@query("tag_dedupe", "SELECT file_id, name, tag_type, max(confidence) AS confidence FROM (SELECT * FROM file_tags UNION ALL SELECT file_id, name, tag_type, confidence / 2 FROM file_tags WHERE file_id % 2 = 0) GROUP BY 1, 2, 3")
def tag_dedupe(c):
    more = c.file_tags.where("file_id % 2 = 0").withColumn("confidence", F.col("confidence") / 2)
    return R.top_per_group(c.file_tags.select("file_id", "name", "tag_type", "confidence").union(more.select("file_id", "name", "tag_type", "confidence")), ["file_id", "name", "tag_type"], [F.desc("confidence")], 1).drop("rank")


@query("topk_per_group", "SELECT file_id, name, r AS rank FROM (SELECT file_id, name, row_number() OVER (PARTITION BY file_id ORDER BY confidence DESC, name, tag_type) AS r FROM file_tags) WHERE r <= 3")
def topk_per_group(c):
    return R.top_per_group(c.file_tags, ["file_id"], [F.desc("confidence"), F.asc("name"), F.asc("tag_type")], 3).select("file_id", "name", "rank")


@query("best_date_order", "SELECT file_id, row_number() OVER (ORDER BY earliest DESC NULLS LAST, file_id) AS place FROM files LEFT JOIN (SELECT * FROM dates WHERE confirmed) USING (file_id) QUALIFY place <= 100")
def best_date_order(c):
    rows = c.files.join(c.dates.where("confirmed").select("file_id", "earliest"), "file_id", "left").orderBy(F.desc_nulls_last("earliest"), "file_id").limit(100)
    return rows.select("file_id", F.row_number().over(Window.orderBy(F.desc_nulls_last("earliest"), "file_id")).alias("place"))


@query("limit_default", "SELECT file_id FROM files ORDER BY file_id LIMIT 100")
def limit_default(c):
    asked = 0
    return c.files.select("file_id").orderBy("file_id").limit(min(max(asked, 0) or 100, 5000))


@query("browse_unlimited", "SELECT file_id, relative_path FROM files WHERE file_id IN (SELECT file_id FROM file_tags WHERE name = 'brand#3')")
def browse_unlimited(c):
    return c.files.join(c.file_tags.where("name = 'brand#3'"), "file_id", "left_semi").select("file_id", "relative_path")


@query("sample_limit", "SELECT relative_path, count(*) OVER () > 20 AS truncated FROM (SELECT content_hash, min(relative_path) AS relative_path FROM files WHERE drive_number = 1 AND content_hash NOT IN (SELECT content_hash FROM files WHERE drive_number = 2) GROUP BY 1) ORDER BY relative_path LIMIT 20")
def sample_limit(c):
    only = c.files.where("drive_number = 1").join(c.files.where("drive_number = 2"), "content_hash", "left_anti").groupBy("content_hash").agg(F.min("relative_path").alias("relative_path"))
    first = only.select("relative_path").orderBy("relative_path").limit(21).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(1))))
    return first.orderBy("relative_path").limit(20).select("relative_path", (F.col("n") > 20).alias("truncated"))


@query("sweep_order", "SELECT run_id FROM runs ORDER BY heartbeat ASC NULLS FIRST, run_id LIMIT 50")
def sweep_order(c):
    return c.runs.orderBy(F.asc_nulls_first("heartbeat"), "run_id").limit(50).select("run_id")


@query("largest_first", "SELECT extension, count(*) AS n FROM files GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def largest_first(c):
    return c.files.groupBy("extension").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "extension").limit(3)
