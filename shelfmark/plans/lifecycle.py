"""Sessions and their edits, change detection, quality, reference data, the queue, and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.functions import text as T
from shelfmark.operators import backup as B
from shelfmark.operators import changes as C
from shelfmark.operators import quality as K
from shelfmark.operators import queue as Q
from shelfmark.operators import rollups as R
from shelfmark.operators import sessions as X
from shelfmark.plans.registry import query
from shelfmark.plans.relational import _seen
from shelfmark.streaming.flows import shared_folder

_LABELLED = """lab AS (SELECT *, sum(new) OVER (PARTITION BY owner ORDER BY us, file_id) AS session FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY owner ORDER BY us, file_id) > 36000000000 THEN 1 ELSE 0 END AS new FROM captures)),
ses AS (SELECT owner, session::BIGINT AS session, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM lab GROUP BY 1, 2)"""


@query("gap_sessions", f"WITH {_LABELLED} SELECT * FROM ses WHERE n >= 5")
def gap_sessions(c):
    return X.sessions(c.captures)


_PRECISE = _LABELLED.replace("FROM captures", "FROM captures WHERE event_type <> 'error' OR event_type IS NULL")


@query("propose_report", f"WITH {_PRECISE} SELECT count(*) FILTER (n >= 5) AS proposed, coalesce(sum(n) FILTER (n >= 5), 0)::BIGINT AS grouped, coalesce(sum(n) FILTER (n < 5), 0)::BIGINT AS skipped, (SELECT count(*) FROM captures WHERE ts IS NULL) AS undated, (SELECT count(*) FROM captures WHERE ts IS NOT NULL AND event_type = 'error') AS imprecise FROM ses")
def propose_report(c):
    # captures of one kind are known to three days, the others exactly
    days = F.when(F.col("event_type") == "error", F.expr("INTERVAL 72 HOURS")).otherwise(F.expr("INTERVAL 48 HOURS"))
    return X.report(c.captures.withColumn("latest", F.col("ts") + days))


@query("split_points", f"WITH {_LABELLED}, g AS (SELECT owner, session::BIGINT AS session, file_id, us - lag(us) OVER (PARTITION BY owner, session ORDER BY us, file_id) AS gap_us, count(*) OVER (PARTITION BY owner, session ORDER BY us RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rows_after FROM lab) SELECT * FROM g WHERE gap_us >= 7200000000")
def split_points(c):
    return X.split_points(X.label_sessions(c.captures))


@query("rate_window", "SELECT file_id, CASE WHEN n >= 2 AND us - first >= 3600000000 THEN round((n - 1) / ((us - first) / 3600000000.0::DOUBLE), 6) END AS per_hour FROM (SELECT file_id, us, count(*) OVER w AS n, min(us) OVER w AS first FROM captures WINDOW w AS (PARTITION BY owner ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW))")
def rate_window(c):
    us = F.unix_micros("ts")
    w = Window.partitionBy("owner").orderBy(us).rangeBetween(-86_400_000_000, 0)
    rows = c.captures.select("file_id", us.alias("us"), F.count("*").over(w).alias("n"), F.min(us).over(w).alias("first"))
    span = F.col("us") - F.col("first")
    return rows.select("file_id", F.when((F.col("n") >= 2) & (span >= 3_600_000_000), F.round((F.col("n") - 1) / (span / 3600000000.0), 6)).alias("per_hour"))


def _events(c):
    """Sessions of users as named events, with their members."""
    return X.label_sessions(c.captures)


@query("name_event", f"WITH {_LABELLED} SELECT owner, session, CASE WHEN session = 0 THEN 'First' END AS name, CASE WHEN session = 0 THEN 'named' ELSE 'proposed' END AS status FROM ses")
def name_event(c):
    named = F.col("session") == 0
    return _events(c).select("owner", "session").distinct().select("owner", "session", F.when(named, F.trim(F.lit(" First "))).alias("name"), F.when(named, "named").otherwise("proposed").alias("status"))


@query("merge_events", f"WITH {_LABELLED} SELECT owner, CASE WHEN session = 1 THEN 0 ELSE session END::BIGINT AS session, count(*) AS n FROM lab GROUP BY 1, 2")
def merge_events(c):
    merged = X.merge(_events(c).select("owner", "session", "file_id"), F.lit(1), F.lit(0))
    return merged.groupBy("owner", F.col("session").cast("long").alias("session")).agg(F.count("*").alias("n"))


@query("split_event", f"WITH {_LABELLED} SELECT owner, CASE WHEN session = 0 AND ts >= TIMESTAMP '2024-01-02' THEN -1 ELSE session END::BIGINT AS session, count(*) AS n FROM lab GROUP BY 1, 2")
def split_event(c):
    rows = X.split(_events(c), F.col("session") == 0, F.lit("2024-01-02").cast("timestamp"), F.lit(-1))
    return rows.groupBy("owner", F.col("session").cast("long").alias("session")).agg(F.count("*").alias("n"))


@query("assign_forget", f"WITH {_LABELLED} SELECT owner, CASE WHEN file_id % 10 = 0 THEN 7 ELSE session END::BIGINT AS session, count(*) AS n FROM lab WHERE session <> 2 GROUP BY 1, 2")
def assign_forget(c):
    rows = _events(c).where("session <> 2").withColumn("session", F.when(F.col("file_id") % 10 == 0, 7).otherwise(F.col("session")).cast("long"))
    return rows.groupBy("owner", "session").agg(F.count("*").alias("n"))


@query("refresh_bounds", f"WITH {_LABELLED} SELECT owner, session, first_us AS first, last_us AS last, n FROM ses")
def refresh_bounds(c):
    rows = X.label_sessions(c.captures).withColumn("us", F.unix_micros("ts"))
    return X.bounds(rows, ("owner", "session"), "us")


@query("list_events", f"WITH {_LABELLED} SELECT owner, session, n FROM ses ORDER BY n DESC, owner, session LIMIT 25")
def list_events(c):
    return X.sessions(c.captures, least=1).orderBy(F.desc("n"), "owner", "session").limit(25).select("owner", "session", "n")


@query("user_date_override", "SELECT file_id, CASE WHEN confirmed THEN earliest ELSE latest END AS kept FROM dates")
def user_date_override(c):
    old = c.dates.select("file_id", F.col("earliest").alias("kept"), "confirmed", F.lit(1).alias("version"))
    new = c.dates.select("file_id", F.col("latest").alias("kept"), F.lit(False).alias("confirmed"), F.lit(2).alias("version"))
    return C.merge_versions(old.union(new), ["file_id"], [F.desc("confirmed"), F.desc("version")]).select("file_id", "kept")


@query("bitrot_verdict", "SELECT file_id, CASE WHEN file_id % 5 = 0 THEN 'missing' WHEN file_id % 7 = 0 THEN CASE WHEN file_id % 2 = 0 THEN 'corrupt' ELSE 'edited' END ELSE 'intact' END AS verdict FROM files")
def bitrot_verdict(c):
    seen = c.files.where("file_id % 5 <> 0").selectExpr("file_id", "CASE WHEN file_id % 7 = 0 THEN reverse(content_hash) ELSE content_hash END AS found", "file_id % 2 = 0 AS same")
    rows = c.files.select("file_id", "content_hash").join(seen, "file_id", "left")
    return rows.select("file_id", C.integrity_verdict(F.col("content_hash"), F.col("found"), F.col("same"), F.lit(True)).alias("verdict"))


@query("verify_sweep", "SELECT run_id FROM runs WHERE heartbeat IS NULL OR 1000000000 - heartbeat >= 86400 ORDER BY heartbeat NULLS FIRST, run_id LIMIT 40")
def verify_sweep(c):
    return c.runs.where("heartbeat IS NULL OR 1000000000 - heartbeat >= 86400").orderBy(F.asc_nulls_first("heartbeat"), "run_id").limit(40).select("run_id")


_MOVED = """WITH o AS (SELECT file_id, drive_number, content_hash, row_number() OVER (PARTITION BY drive_number, content_hash ORDER BY file_id) AS n FROM files WHERE status = 'missing'),
m AS (SELECT drive_number, content_hash, 'new/' || relative_path AS new_path, row_number() OVER (PARTITION BY drive_number, content_hash ORDER BY 'new/' || relative_path) AS n FROM files WHERE file_id % 2 = 1)
SELECT file_id, new_path FROM o JOIN m USING (drive_number, content_hash, n)"""


def _moved(c):
    new = c.files.where("file_id % 2 = 1").select("drive_number", "content_hash", F.concat(F.lit("new/"), "relative_path").alias("relative_path"))
    return C.moved(c.files.where("status = 'missing'"), new)


query("moved_files", _MOVED)(_moved)
query("moved_file_match", f"SELECT count(*) AS n FROM ({_MOVED})")(lambda c: _moved(c).agg(F.count("*").alias("n")))


def _changed_originals(c):
    """Complete files that are there, of other size or time than the catalogue says."""
    here = _seen(c).select("drive_number", "relative_path", F.col("size_bytes").alias("s"), F.col("mtime_ns").alias("m"))
    return R.complete(c.files).select("drive_number", "relative_path", "size_bytes", "mtime_ns").join(here, ["drive_number", "relative_path"]).where("s <> size_bytes OR m <> mtime_ns")


def _identical_faces(c):
    """How many faces there are, and how many of them have the most frequent vector."""
    return c.faces.groupBy(F.xxhash64("embedding")).agg(F.count("*").alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.max("k").alias("same"))


def _checks(c):
    return [
        K.check("files_have_drives", K.orphans(c.files.select("drive_number"), c.drives, "drive_number")),
        K.check("tags_have_files", K.orphans(c.file_tags.select("file_id"), c.files, "file_id"), "warn"),
        K.check("complete_has_dates", R.complete(c.files).join(c.dates, "file_id", "left_anti")),
        K.check("complete_has_hash", R.complete(c.files).where("content_hash IS NULL")),
        K.check("faces_have_clusters", K.orphans(c.faces.select("cluster_id"), c.clusters, "cluster_id"), "halt"),
        K.check("queued_not_tried_often", c.queue.where("state = 'queued' AND attempts > 3"), "warn"),
        K.check("leased_has_lease", c.queue.where("state = 'leased' AND expires_ns IS NULL")),
        K.check("complete_has_no_lease", c.queue.where("state = 'complete' AND expires_ns IS NOT NULL")),
        K.check("failed_has_reason", c.queue.where("state = 'failed' AND code IS NULL")),
        K.check("failed_was_tried", c.queue.where("state = 'failed' AND attempts < 1")),
        K.check("originals_unchanged", _changed_originals(c), "halt"),
        K.check("outputs_contained", c.files.where(~T.contained(F.concat(F.lit("/app/"), "relative_path"), "/app")), "halt"),
        K.check("scans_alive", c.runs.where("outcome = 'running' AND mode <> 'dry_run' AND 1200000000 - coalesce(heartbeat, started) >= 1800"), "warn"),
        K.measure("throughput", R.throughput(c.runs), "files_per_second >= 0.1", "warn"),
        K.measure("free_space", c.files.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("used")), "1000000 - used >= 500000", "halt"),
        K.check("faces_finite", c.faces.where(F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))),
        K.measure("faces_one_size", c.faces.agg(F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi")), "hi IS NULL OR lo = hi"),
        K.measure("faces_differ", _identical_faces(c), "n < 5 OR same <= 0.9 * n", "warn"),
    ]


_CHECKS = """WITH k AS (SELECT 'files_have_drives' AS name, 'fail' AS bad, (SELECT count(*) FROM files WHERE drive_number NOT IN (SELECT drive_number FROM drives)) AS wrong
UNION ALL SELECT 'tags_have_files', 'warn', (SELECT count(*) FROM file_tags WHERE file_id NOT IN (SELECT file_id FROM files))
UNION ALL SELECT 'complete_has_dates', 'fail', (SELECT count(*) FROM files WHERE status = 'complete' AND file_id NOT IN (SELECT file_id FROM dates))
UNION ALL SELECT 'complete_has_hash', 'fail', (SELECT count(*) FROM files WHERE status = 'complete' AND content_hash IS NULL)
UNION ALL SELECT 'faces_have_clusters', 'halt', (SELECT count(*) FROM faces WHERE cluster_id NOT IN (SELECT cluster_id FROM clusters))
UNION ALL SELECT 'queued_not_tried_often', 'warn', (SELECT count(*) FROM queue WHERE state = 'queued' AND attempts > 3)
UNION ALL SELECT 'leased_has_lease', 'fail', (SELECT count(*) FROM queue WHERE state = 'leased' AND expires_ns IS NULL)
UNION ALL SELECT 'complete_has_no_lease', 'fail', (SELECT count(*) FROM queue WHERE state = 'complete' AND expires_ns IS NOT NULL)
UNION ALL SELECT 'failed_has_reason', 'fail', (SELECT count(*) FROM queue WHERE state = 'failed' AND code IS NULL)
UNION ALL SELECT 'failed_was_tried', 'fail', (SELECT count(*) FROM queue WHERE state = 'failed' AND attempts < 1)
UNION ALL SELECT 'originals_unchanged', 'halt', (SELECT count(*) FROM files WHERE status = 'complete' AND file_id % 5 <> 0 AND file_id % 7 = 0)
UNION ALL SELECT 'outputs_contained', 'halt', (SELECT count(*) FROM files WHERE list_contains(string_split(relative_path, '/'), '..'))
UNION ALL SELECT 'scans_alive', 'warn', (SELECT count(*) FROM runs WHERE outcome = 'running' AND mode <> 'dry_run' AND 1200000000 - coalesce(heartbeat, started) >= 1800)
UNION ALL SELECT 'throughput', 'warn', (SELECT count(*) FROM (SELECT coalesce(sum(files_done)::DOUBLE / nullif(sum(ended - started), 0), 0.3) AS v FROM runs WHERE mode <> 'dry_run' AND ended IS NOT NULL) WHERE v < 0.1)
UNION ALL SELECT 'free_space', 'halt', (SELECT count(*) FROM (SELECT coalesce(sum(size_bytes), 0) AS used FROM files) WHERE 1000000 - used < 500000)
UNION ALL SELECT 'faces_finite', 'fail', (SELECT count(*) FROM faces WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0)
UNION ALL SELECT 'faces_one_size', 'fail', (SELECT count(*) FROM (SELECT min(len(embedding)) AS lo, max(len(embedding)) AS hi FROM faces) WHERE lo <> hi)
UNION ALL SELECT 'faces_differ', 'warn', (SELECT count(*) FROM (SELECT sum(k) AS n, max(k) AS same FROM (SELECT count(*) AS k FROM faces GROUP BY embedding)) WHERE n >= 5 AND same > 0.9 * n)), r AS (SELECT name, CASE WHEN wrong = 0 THEN 'pass' ELSE bad END AS status, wrong FROM k)"""

query("verifier_suite", _CHECKS + " SELECT * FROM r")(lambda c: K.report(_checks(c)))
query("report_rollup", _CHECKS + " SELECT count(*) FILTER (status IN ('fail', 'halt')) = 0 AS ok, count(*) FILTER (status = 'halt') > 0 AS has_halt, concat(count(*) FILTER (status = 'pass'), ' pass, ', count(*) FILTER (status = 'warn'), ' warn, ', count(*) FILTER (status = 'fail'), ' fail, ', count(*) FILTER (status = 'halt'), ' halt') AS summary FROM r")(
    lambda c: K.rollup(K.report(_checks(c)))
)


@query("integrity_check", "SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 100 <> 7) GROUP BY 1")
def integrity_check(c):
    parents = c.table("orders").where("o_orderkey % 100 <> 7").select(F.col("o_orderkey").alias("k"))
    return K.orphans(c.table("lineitem").select(F.col("l_orderkey").alias("k")), parents, "k").groupBy("k").agg(F.count("*").alias("n"))


@query("compact", "SELECT doc_id, CASE WHEN length(text) > 8000 THEN 0 ELSE length(text) END AS kept FROM documents")
def compact(c):
    slim = F.when(F.char_length("text") > 8000, F.lit("")).otherwise(F.col("text"))
    return c.table("documents").select("doc_id", F.char_length(slim).alias("kept"))


@query("register_drive", "SELECT n::INT AS drive_number, n > 0 AND n NOT IN (SELECT drive_number FROM drives) AS accepted FROM range(-2, 30) t(n)")
def register_drive(c):
    asked = c.spark.range(-2, 30, 1, 1).select(F.col("id").cast("int").alias("drive_number"))
    free = asked.where("drive_number > 0").join(c.drives, "drive_number", "left_anti").select("drive_number", F.lit(True).alias("ok"))
    return asked.join(free, "drive_number", "left").select("drive_number", F.coalesce("ok", F.lit(False)).alias("accepted"))


@query("renumber_drive", "SELECT CASE WHEN drive_number = 99 THEN 50 ELSE drive_number END AS drive_number, name FROM drives")
def renumber_drive(c):
    taken = c.drives.where("drive_number = 50").limit(1).count()
    if taken:
        raise ValueError("drive 50 exists")
    return c.drives.select(F.when(F.col("drive_number") == 99, 50).otherwise(F.col("drive_number")).alias("drive_number"), "name")


@query("drive_details", "SELECT drive_number, CASE WHEN drive_number % 2 = 0 THEN NULL ELSE location END AS location, 'Wedding,family' AS categories FROM drives")
def drive_details(c):
    given = F.array(*map(F.lit, ("Wedding", " ", "wedding", "family ", "FAMILY")))
    clean = F.filter(F.transform(given, lambda x: F.trim(x)), lambda x: x != "")
    seen = F.aggregate(clean, F.array().cast("array<string>"), lambda s, x: F.when(F.exists(s, lambda y: F.lower(y) == F.lower(x)), s).otherwise(F.array_append(s, x)))
    asked = F.when(F.col("drive_number") % 2 == 0, F.lit("  "))
    location = F.when(asked.isNull(), F.col("location")).otherwise(F.nullif(F.trim(asked), F.lit("")))
    return c.drives.select("drive_number", location.alias("location"), F.array_join(seen, ",").alias("categories"))


@query("backup_relationship", "SELECT a.drive_number, b.name AS backup_of FROM drives a JOIN drives b ON b.drive_number = a.drive_number - 10")
def backup_relationship(c):
    of = c.drives.select((F.col("drive_number") + 10).alias("drive_number"), F.col("name").alias("backup_of"))
    return c.drives.select("drive_number").join(of, "drive_number")


@query("effective_status", "SELECT drive_number, CASE WHEN drive_number % 7 = 0 THEN 'retired' WHEN drive_number % 2 = 0 THEN 'online' ELSE 'offline' END AS status FROM drives")
def effective_status(c):
    mounted = c.drives.where("drive_number % 2 = 0").select("drive_number", F.lit(True).alias("here"))
    status = F.when(F.col("drive_number") % 7 == 0, "retired").otherwise(F.col("status"))
    seen = F.when(status.isin("online", "offline"), F.when(F.col("here"), "online").otherwise("offline")).otherwise(status)
    return c.drives.join(mounted, "drive_number", "left").select("drive_number", seen.alias("status"))


_GONE = "(SELECT file_id FROM files WHERE drive_number = 3)"


@query("drop_drive", " UNION ALL ".join(
    [f"SELECT '{t}' AS what, count(*) AS n FROM {t} WHERE drive_number <> 3 OR drive_number IS NULL" for t in ("drives", "files", "runs", "queue")] + [f"SELECT '{t}', count(*) FROM {t} WHERE file_id NOT IN {_GONE}" for t in ("file_tags", "dates", "faces")]
))
def drop_drive(c):
    """Rows left in each table that hangs on a drive, at once or by its files."""
    gone = c.files.where("drive_number = 3").select("file_id")
    left = {t: getattr(c, t).where("drive_number <> 3 OR drive_number IS NULL") for t in ("drives", "files", "runs", "queue")}
    left |= {t: getattr(c, t).join(gone, "file_id", "left_anti") for t in ("file_tags", "dates", "faces")}
    return reduce(lambda a, b: a.union(b), [rows.agg(F.lit(t).alias("what"), F.count("*").alias("n")) for t, rows in left.items()])


@query("upsert_tag", "SELECT DISTINCT substr(sha256(concat(name, chr(0), tag_type)), 1, 32) AS id, name, tag_type FROM file_tags")
def upsert_tag(c):
    from shelfmark.functions.vectors import path_key

    return c.file_tags.select("name", "tag_type").dropDuplicates().select(path_key(F.col("name"), F.col("tag_type")).alias("id"), "name", "tag_type")


@query("insert_face", "SELECT face_id, len(embedding)::INT AS dim FROM faces")
def insert_face(c):
    key = F.unhex(F.lit("00112233445566778899aabbccddeeff"))
    sealed = c.faces.select("face_id", F.aes_encrypt(F.to_json(F.struct("embedding")), key).alias("s"))
    back = F.from_json(F.aes_decrypt("s", key).cast("string"), "embedding array<float>")
    return sealed.select("face_id", F.size(back["embedding"]).alias("dim"))


@query("enqueue_idempotent", "SELECT queue_key, min(item_id) AS item_id FROM queue WHERE item_id % 2 = 1 AND queue_key NOT IN (SELECT queue_key FROM queue WHERE item_id % 2 = 0) GROUP BY 1")
def enqueue_idempotent(c):
    return Q.enqueue(c.queue.where("item_id % 2 = 0"), c.queue.where("item_id % 2 = 1")).select("queue_key", "item_id")


@query("claim_batch", "SELECT item_id, attempts + 1 AS attempts FROM queue WHERE drive_number = 6 AND (state = 'queued' OR (state = 'leased' AND expires_ns <= 20000)) ORDER BY path LIMIT 64")
def claim_batch(c):
    return Q.claim(c.queue, 6, 64, 20000).select("item_id", "attempts")


@query("lease_expiry", "SELECT CASE WHEN state = 'leased' AND expires_ns <= 20000 THEN 'queued' ELSE state END AS state, count(*) AS n FROM queue GROUP BY 1")
def lease_expiry(c):
    return Q.expire(c.queue, 20000).groupBy("state").agg(F.count("*").alias("n"))


@query("queue_transitions", "SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'complete' WHEN 1 THEN 'queued' WHEN 2 THEN 'queued' WHEN 3 THEN CASE WHEN item_id % 2 = 0 AND attempts < 3 THEN 'queued' ELSE 'failed' END ELSE state END AS state, CASE item_id % 5 WHEN 1 THEN greatest(attempts - 1, 0) WHEN 2 THEN 0 ELSE attempts END AS attempts FROM queue")
def queue_transitions(c):
    log = c.queue.where("item_id % 5 <> 4").select("item_id", F.lit(2).alias("at"), F.element_at(F.array(*map(F.lit, ("complete", "release", "retry", "fail"))), (F.col("item_id") % 5 + 1).cast("int")).alias("action"), (F.col("item_id") % 2 == 0).alias("retryable"))
    early = c.queue.select("item_id", F.lit(1).alias("at"), F.lit("fail").alias("action"), F.lit(False).alias("retryable")).where("item_id % 5 <> 4")
    return Q.apply_transitions(c.queue, log.union(early)).select("item_id", "state", "attempts")


@query("retry_policy", "SELECT item_id, attempts < 3 AS again FROM queue WHERE state = 'failed'")
def retry_policy(c):
    return c.queue.where("state = 'failed'").select("item_id", Q.retryable(F.col("attempts")).alias("again"))


@query("upsert_file", "SELECT file_id, CASE WHEN file_id % 3 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, status FROM files")
def upsert_file(c):
    old = c.files.select("file_id", "size_bytes", "status", F.lit(1).alias("version"))
    new = c.files.where("file_id % 3 = 0").select("file_id", (F.col("size_bytes") + 1).alias("size_bytes"), "status", F.lit(2).alias("version"))
    return C.merge_versions(old.union(new), ["file_id"], [F.desc("version")]).drop("version")


_OUT = "WITH a AS (SELECT file_id FROM files UNION SELECT file_id FROM dates) SELECT a.file_id, CASE WHEN f.file_id IS NULL OR f.status = 'missing' THEN 'missing' WHEN d.status = 'offline' THEN 'skipped_offline' WHEN a.file_id % 8 = 0 THEN 'skipped_existing' ELSE 'copied' END AS outcome, 'drive' || lpad(f.drive_number::VARCHAR, 2, '0') || '_' || filename AS target FROM a LEFT JOIN files f USING (file_id) LEFT JOIN drives d USING (drive_number)"


def _copy(c):
    asked = c.files.select("file_id").union(c.dates.select("file_id")).distinct()
    there = c.files.where("file_id % 4 = 0").select("file_id", F.expr("size_bytes + file_id % 8").alias("there"))  # of other size for half of them
    rows = asked.join(c.files.select("file_id", "status", "drive_number", "filename", "size_bytes"), "file_id", "left").join(there, "file_id", "left")
    rows = rows.join(c.drives.select("drive_number", F.col("status").alias("drive_status")), "drive_number", "left")
    outcome = F.when(F.col("status").isNull() | (F.col("status") == "missing"), "missing").when(F.col("drive_status") == "offline", "skipped_offline").when(F.col("there") == F.col("size_bytes"), "skipped_existing").otherwise("copied")
    return rows.select("file_id", outcome.alias("outcome"), F.concat(F.lit("drive"), F.lpad(F.col("drive_number").cast("string"), 2, "0"), F.lit("_"), "filename").alias("target"), "drive_number")


query("copy_out", _OUT)(lambda c: _copy(c).drop("drive_number"))
query("drives_to_connect", f"SELECT array_to_string(list_sort(list(DISTINCT drive_number)), ',') AS drives FROM ({_OUT}) JOIN files USING (file_id) WHERE outcome = 'skipped_offline'")(
    lambda c: _copy(c).where("outcome = 'skipped_offline'").agg(F.array_join(F.transform(F.array_sort(F.collect_set("drive_number")), lambda x: x.cast("string")), ",").alias("drives"))
)


_XMP_HEAD = '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:subject><rdf:Bag>'
_XMP_TEXT = '<dc:description><rdf:Alt><rdf:li xml:lang="x-default">', "</rdf:li></rdf:Alt></dc:description>"
_XMP_END = "</rdf:Description></rdf:RDF></x:xmpmeta>"


@query("xmp_sidecar", f"""WITH t AS (SELECT file_id, name, row_number() OVER (PARTITION BY file_id ORDER BY confidence DESC, name, tag_type) AS r FROM file_tags WHERE tag_type <> 'person'),
p AS (SELECT DISTINCT f.file_id, p.name FROM faces f JOIN clusters c USING (cluster_id) JOIN people p ON p.person_id = c.person_id WHERE c.status = 'confirmed' AND NOT f.is_false),
w AS (SELECT file_id, string_agg('<rdf:li>' || name || '</rdf:li>', '' ORDER BY r, name) AS items FROM (SELECT file_id, name, 0 AS r FROM p UNION ALL SELECT file_id, name, r FROM t WHERE r <= 20) GROUP BY 1)
SELECT file_id, '{_XMP_HEAD}' || coalesce(items, '') || '</rdf:Bag></dc:subject>' || CASE WHEN file_id % 2 = 0 THEN '{_XMP_TEXT[0]}' || filename || ' &amp; more{_XMP_TEXT[1]}' ELSE '' END || '{_XMP_END}' AS xml FROM files LEFT JOIN w USING (file_id)""")
def xmp_sidecar(c):
    """People that are confirmed, then the twenty surest other tags, and the description if there is one."""
    people = c.faces.where("NOT is_false").join(c.clusters.where("status = 'confirmed'").select("cluster_id", F.col("person_id").alias("p")), "cluster_id")
    people = people.join(c.people.select(F.col("person_id").alias("p"), "name"), "p").select("file_id", "name", F.lit(0).alias("rank")).distinct()
    top = R.top_per_group(c.file_tags.where("tag_type <> 'person'"), ["file_id"], [F.desc("confidence"), F.asc("name"), F.asc("tag_type")], 20)
    items = people.union(top.select("file_id", "name", "rank")).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("t"))
    rows = c.files.select("file_id", F.when(F.col("file_id") % 2 == 0, F.concat("filename", F.lit(" & more"))).alias("about")).join(items, "file_id", "left")
    body = F.coalesce(F.array_join(F.transform("t", lambda x: F.concat(F.lit("<rdf:li>"), T.xml_escape(x["name"]), F.lit("</rdf:li>"))), ""), F.lit(""))
    about = F.coalesce(F.concat(F.lit(_XMP_TEXT[0]), T.xml_escape(F.col("about")), F.lit(_XMP_TEXT[1])), F.lit(""))
    return rows.select("file_id", F.concat(F.lit(_XMP_HEAD), body, F.lit("</rdf:Bag></dc:subject>"), about, F.lit(_XMP_END)).alias("xml"))


@query("backup_snapshot", "SELECT 'files' AS name, (SELECT count(*) FROM files) AS n UNION ALL SELECT 'tags', (SELECT count(*) FROM file_tags) UNION ALL SELECT 'faces', (SELECT count(*) FROM faces) UNION ALL SELECT 'thumbnails_to_copy', (SELECT count(*) FROM files WHERE file_id % 4 = 0)")
def backup_snapshot(c):
    of = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("name"), "n")
    mirrored = c.files.where("file_id % 4 <> 0").select("file_id")
    return of(c.files, "files").union(of(c.file_tags, "tags")).union(of(c.faces, "faces")).union(of(c.files.join(mirrored, "file_id", "left_anti"), "thumbnails_to_copy"))


@query("backup_restore", "SELECT 's1' AS snapshot, 'drives' AS name, (SELECT count(*) FROM drives) AS n UNION ALL SELECT 's1', 'tags', (SELECT count(*) FROM file_tags) UNION ALL SELECT 's1', 'dates', (SELECT count(*) FROM dates)")
def backup_restore(c):
    """What a snapshot's tables hold once they are read back."""
    base = shared_folder(c.spark)
    B.create({"drives": c.drives, "tags": c.file_tags, "dates": c.dates}, f"{base}/s1")
    back = B.restore(c.spark, f"{base}/s1")
    counts = reduce(lambda a, b: a.union(b), [t.agg(F.lit(k).alias("name"), F.count("*").alias("n")) for k, t in back.items()])
    return B.manifests(c.spark, base).select("snapshot", "name").join(F.broadcast(counts), "name").select("snapshot", "name", "n")  # a row a table


@query("backup_prune", "SELECT run_id FROM runs QUALIFY row_number() OVER (PARTITION BY drive_number ORDER BY started DESC, run_id DESC) > 7")
def backup_prune(c):
    w = Window.partitionBy("drive_number").orderBy(F.desc("started"), F.desc("run_id"))
    return c.runs.withColumn("n", F.row_number().over(w)).where("n > 7").select("run_id")


_COUNTS = "drives, drives_online, files_total, files_complete, files_failed, files_missing, files_changed, thumbnails, visual_embeddings, faces, face_clusters, people_named".split(", ")


@query("diagnostics_sink", _CHECKS + """ SELECT (SELECT count(*) FROM drives) AS drives, (SELECT count(*) FROM drives WHERE status = 'online') AS drives_online, (SELECT count(*) FROM files) AS files_total, (SELECT count(*) FROM files WHERE status = 'complete') AS files_complete,
(SELECT count(*) FROM files WHERE status = 'failed') AS files_failed, (SELECT count(*) FROM files WHERE status = 'missing') AS files_missing, (SELECT count(*) FROM files WHERE status = 'changed') AS files_changed, (SELECT count(*) FROM files WHERE status = 'complete') AS thumbnails, (SELECT count(*) FROM embeddings) AS visual_embeddings,
(SELECT count(*) FROM faces) AS faces, (SELECT count(*) FROM clusters) AS face_clusters, (SELECT count(*) FROM people) AS people_named, string_agg(name || '=' || status, ',' ORDER BY name) AS checks, true AS redacted FROM r""")
def diagnostics_sink(c):
    """Counts and outcomes only: no name, path, date or text of the catalogue leaves it."""
    of = lambda s: F.count_if(F.col("status") == s)
    n = F.count("*")
    parts = [
        c.drives.agg(n.alias("drives"), of("online").alias("drives_online")),
        c.files.agg(n.alias("files_total"), *[of(s).alias(f"files_{s}") for s in ("complete", "failed", "missing", "changed")]),
        R.complete(c.files).agg(n.alias("thumbnails")), c.table("embeddings").agg(n.alias("visual_embeddings")), c.faces.agg(n.alias("faces")), c.clusters.agg(n.alias("face_clusters")), c.people.agg(n.alias("people_named")),
    ]
    outcomes = K.report(_checks(c)).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "name", "status"))), ",").alias("checks"))
    for part in parts:
        outcomes = outcomes.join(F.broadcast(part), F.lit(True))  # one row each
    path = f"{shared_folder(c.spark)}/diagnostics"
    outcomes.select(F.to_json(F.struct(*_COUNTS, "checks", F.lit(True).alias("redacted"))).alias("value")).write.text(path)
    return c.spark.read.schema(", ".join(f"{k} bigint" for k in _COUNTS) + ", checks string, redacted boolean").json(path)


@query("catalogue_read", "SELECT 'files' AS name, count(*) AS n FROM files UNION ALL SELECT 'dates', count(*) FROM dates UNION ALL SELECT 'faces', count(*) FROM faces UNION ALL SELECT 'drives', count(*) FROM drives")
def catalogue_read(c):
    of = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("name"), "n")
    return of(c.files, "files").union(of(c.dates, "dates")).union(of(c.faces, "faces")).union(of(c.drives, "drives"))


@query("volume_prefix_join", "SELECT d.name, v.path FROM drives d JOIN (SELECT root || '/sub' AS path FROM drives WHERE drive_number % 2 = 0) v ON v.path = d.root OR starts_with(v.path, d.root || '/')")
def volume_prefix_join(c):
    volumes = c.drives.where("drive_number % 2 = 0").select(F.concat("root", F.lit("/sub")).alias("path"))
    # every ancestor of a path is a key, so the prefix join is an equi-join
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    keys = volumes.select("path", F.explode(above).alias("root"))
    return c.drives.select("name", "root").join(keys, "root").select("name", "path")


query("prefix_join", "SELECT d.drive_number, count(*) AS n FROM drives d JOIN files f ON starts_with(f.relative_path, d.name || '/') GROUP BY 1")(
    lambda c: c.files.select(F.split_part("relative_path", F.lit("/"), F.lit(1)).alias("name")).join(c.drives.select("name", "drive_number"), "name").groupBy("drive_number").agg(F.count("*").alias("n"))
)


@query("identity_score", "SELECT drive_number, CASE WHEN drive_number % 5 = 0 THEN -1 ELSE CASE WHEN drive_number % 2 = 0 THEN 60 ELSE 0 END + CASE WHEN drive_number % 3 = 0 THEN 20 ELSE 0 END + 20 END AS score FROM drives")
def identity_score(c):
    seen = c.drives.selectExpr("drive_number", "drive_number % 2 = 0 AS manifest", "drive_number % 3 = 0 AS capacity", "drive_number % 5 <> 0 AS volume")
    add = F.when(F.col("manifest"), 60).otherwise(0) + F.when(F.col("capacity"), 20).otherwise(0) + 20
    return c.drives.select("drive_number").join(seen, "drive_number").select("drive_number", F.when(~F.col("volume"), -1).otherwise(add).alias("score"))


@query("moved_listing", "SELECT count(*) AS n FROM files WHERE file_id % 5 <> 0 OR file_id % 50 = 0")
def moved_listing(c):
    return _seen(c).agg(F.count("*").alias("n"))


query("dry_run", "SELECT file_id FROM files ORDER BY relative_path LIMIT 20")(lambda c: c.files.orderBy("relative_path").limit(20).select("file_id"))
