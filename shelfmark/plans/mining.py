"""Text mining, folder summaries, image features over arrays, and the queries' last lines."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from shelfmark.functions import mining as M
from shelfmark.functions import text as T
from shelfmark.operators import changes as C
from shelfmark.operators import queue as Q
from shelfmark.operators import rollups as R
from shelfmark.operators import search as S
from shelfmark.operators import sessions as X
from shelfmark.plans.lifecycle import _LABELLED
from shelfmark.plans.registry import query
from shelfmark.sources import filesystem
from shelfmark.streaming import flows

LEXICON = ["of the", "the", "und der", "de la", "on"]


@query("brand_detect")
def brand_detect(c):
    found = M.brands(LEXICON, ("on",))(F.col("text"))
    return c.table("documents").select("doc_id", F.array_join(found, ",").alias("brands"))


@query("name_detect")
def name_detect(c):
    found = M.names(("the", "of", "and", "der", "die", "la", "le", "el"))(F.col("text"))
    return c.table("documents").select("doc_id", F.explode(found).alias("name"))


@query("name_scan")
def name_scan(c):
    return name_detect(c).withColumn("tag", T.to_tag(F.col("name"))).groupBy("tag").agg(F.count_distinct("doc_id").alias("n")).orderBy(F.desc("n"), "tag")


@query("canonical", "SELECT person_id, replace(lower(name), ' ', '-') || '-and-co' AS tag FROM people")
def canonical(c):
    return c.people.select("person_id", T.canonical(F.concat("name", F.lit(" & Co."))).alias("tag"))


@query("plain_reason", "SELECT item_id, CASE code WHEN 0 THEN 'The drive was disconnected.' WHEN 1 THEN 'The file could not be read.' WHEN 2 THEN 'The file is not an image.' ELSE 'Something else went wrong (E' || code || ').' END AS reason FROM queue WHERE state = 'failed'")
def plain_reason(c):
    code = F.col("code")
    words = F.when(code == 0, "The drive was disconnected.").when(code == 1, "The file could not be read.").when(code == 2, "The file is not an image.")
    return c.queue.where("state = 'failed'").select("item_id", words.otherwise(F.concat(F.lit("Something else went wrong (E"), code, F.lit(")."))).alias("reason"))


_FOLDERS = """WITH f AS (SELECT f.file_id, split_part(relative_path, '/', 1) AS folder, earliest, coalesce(n, 0) AS n FROM files f LEFT JOIN dates USING (file_id) LEFT JOIN (SELECT file_id, count(*) AS n FROM faces GROUP BY 1) USING (file_id) WHERE f.status = 'complete'),
s AS (SELECT folder, count(*) AS photos, count(*) FILTER (n > 0) AS with_faces, sum(n)::BIGINT AS faces, min(earliest) AS first, max(earliest) AS last FROM f GROUP BY 1),
t AS (SELECT folder, name, tag_type, count(DISTINCT file_id) AS n FROM f JOIN file_tags USING (file_id) GROUP BY 1, 2, 3)"""


def _folders(c):
    counts = c.faces.groupBy("file_id").agg(F.count("*").alias("n"))
    rows = R.complete(c.files).join(c.dates.select("file_id", "earliest"), "file_id", "left").join(counts, "file_id", "left").fillna({"n": 0})
    return rows.select("file_id", T.folder_key(F.col("relative_path")).alias("folder"), "earliest", "n")


def _folder_facts(c):
    return _folders(c).groupBy("folder").agg(F.count("*").alias("photos"), F.count_if(F.col("n") > 0).alias("with_faces"), F.sum("n").alias("faces"), F.min("earliest").alias("first"), F.max("earliest").alias("last"))


query("folder_summaries", _FOLDERS + " SELECT * FROM s")(_folder_facts)


@query("classify_folder", _FOLDERS + """, g AS (SELECT folder, coalesce(max(n) FILTER (name = 'brand#1'), 0) AS scan, coalesce(max(n) FILTER (name = 'brand#2'), 0) AS bride, coalesce(max(n) FILTER (name = 'brand#3'), 0) AS wedding, coalesce(max(n) FILTER (name = 'brand#4'), 0) AS child, coalesce(max(n) FILTER (tag_type = 'object'), 0) AS object, coalesce(max(n) FILTER (tag_type = 'event'), 0) AS event, arg_min(name, (-n, name, tag_type)) AS top FROM t GROUP BY 1)
SELECT folder, CASE WHEN scan / photos >= 0.4 THEN 'scanned prints' WHEN bride / photos >= 0.08 OR wedding / photos >= 0.15 THEN 'wedding' WHEN with_faces / photos >= 0.3 AND child / photos >= 0.2 THEN 'children' WHEN with_faces / photos >= 0.6 AND faces * 2 <= with_faces * 3 THEN 'portraits' WHEN with_faces / photos < 0.2 AND object / photos >= 0.5 THEN 'products' WHEN with_faces / photos >= 0.5 AND event / photos >= 0.15 THEN 'event' WHEN with_faces / photos >= 0.5 THEN 'people' ELSE top END AS kind FROM s JOIN g USING (folder)""")
def classify_folder(c):
    tags = _folders(c).select("file_id", "folder").join(c.file_tags.select("file_id", "name", "tag_type"), "file_id").groupBy("folder", "name", "tag_type").agg(F.count_distinct("file_id").alias("n"))
    most = lambda cond: F.coalesce(F.max(F.when(cond, F.col("n"))), F.lit(0))
    kinds = {"scan": F.col("name") == "brand#1", "bride": F.col("name") == "brand#2", "wedding": F.col("name") == "brand#3", "child": F.col("name") == "brand#4", "object": F.col("tag_type") == "object", "event": F.col("tag_type") == "event"}
    grouped = tags.groupBy("folder").agg(*[most(v).alias(k) for k, v in kinds.items()], F.min_by("name", F.struct(-F.col("n"), "name", "tag_type")).alias("top"))
    share = lambda k: F.col(k) / F.col("photos")
    facts = _folder_facts(c).join(grouped, "folder")
    return facts.select("folder", M.classify(F.col("photos"), F.col("with_faces"), F.col("faces"), share, F.col("top")).alias("kind"))


def _pixels():
    part = lambda k: lambda i: ((F.col("file_id") * k + i * 13) % 256)
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.struct(part(7)(i).alias("r"), part(5)(i).alias("g"), part(3)(i).alias("b")))


@query("color_stats", "WITH p AS (SELECT file_id, (file_id * 7 + i * 13) % 256 AS r, (file_id * 5 + i * 13) % 256 AS g, (file_id * 3 + i * 13) % 256 AS b FROM files, range(16) t(i)) SELECT file_id, round(sum((r + g + b) / 3.0::DOUBLE) / 16, 6) AS mean, round(sum(CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b))::DOUBLE / greatest(r, g, b) ELSE 0 END) / 16, 6) AS saturation, count(*) FILTER (greatest(r, g, b) - least(r, g, b) <= 8) / 16.0 > 0.95 AS is_grey FROM p GROUP BY 1")
def color_stats(c):
    return c.files.select("file_id", M.colour_stats(_pixels()).alias("x")).select("file_id", "x.*")


@query("scan_artifacts", "WITH p AS (SELECT file_id, (file_id * 7 + i * 13) % 256 AS r, (file_id * 5 + i * 13) % 256 AS g, (file_id * 3 + i * 13) % 256 AS b FROM files, range(16) t(i) WHERE i NOT IN (5, 6, 9, 10)) SELECT file_id, round(avg((r + g + b) / 3.0::DOUBLE), 6) / 255 > 0.6 AND round(avg(CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b))::DOUBLE / greatest(r, g, b) ELSE 0 END), 6) < 0.5 AS is_scan FROM p GROUP BY 1")
def scan_artifacts(c):
    border = F.filter(F.transform(_pixels(), lambda p, i: F.struct(p["r"].alias("r"), p["g"].alias("g"), p["b"].alias("b"), i.alias("i"))), lambda p: ~p["i"].isin(5, 6, 9, 10))
    return c.files.select("file_id", M.scan_artifacts(border).alias("is_scan"))


@query("text_to_vector")
def text_to_vector(c):
    @F.pandas_udf("vector array<double>, coverage double")
    def embed(texts: pd.Series) -> pd.DataFrame:
        done = [M.render_words(t or "") for t in texts]
        return pd.DataFrame({"vector": [M.embed_grid(g) for g, _ in done], "coverage": [k for _, k in done]})

    words = F.element_at(F.array(*[F.lit(w) for w in ("sea at night", "oceans", "snow forest sky", "nothing", "")]), (F.col("file_id") % 5 + 1).cast("int"))
    return c.files.select("file_id", embed(words).alias("x")).select("file_id", F.size("x.vector").alias("dim"), F.round("x.coverage", 6).alias("coverage"))


@query("volume_list", "SELECT d.drive_number, d.root, drive_number % 2 = 0 AS mounted FROM drives d")
def volume_list(c):
    mounts = c.drives.where("drive_number % 2 = 0").select("root", F.lit(True).alias("m"))
    return c.drives.select("drive_number", "root").join(mounts, "root", "left").select("drive_number", "root", F.coalesce("m", F.lit(False)).alias("mounted"))


@query("drive_manifest", "SELECT name AS drive_id, drive_number, name AS friendly_name FROM drives")
def drive_manifest(c):
    path = f"{flows.shared_folder(c.spark)}/manifest"
    c.drives.select(F.col("name").alias("drive_id"), "drive_number", F.col("name").alias("friendly_name")).write.json(path)
    return c.spark.read.schema("drive_id string, drive_number int, friendly_name string").json(path)


@query("ensure_root", "SELECT DISTINCT drive_number, split_part(relative_path, '/', 1) AS relative_root FROM files")
def ensure_root(c):
    return c.files.select("drive_number", F.split_part("relative_path", F.lit("/"), F.lit(1)).alias("relative_root")).dropDuplicates()


@query("store_thumbnail", "SELECT file_id, CASE WHEN file_id % 2 = 0 THEN 2 ELSE 1 END AS version FROM files")
def store_thumbnail(c):
    old = c.files.select("file_id", F.lit(1).alias("version"))
    return C.merge_versions(old.union(c.files.where("file_id % 2 = 0").select("file_id", F.lit(2))), ["file_id"], [F.desc("version")])


@query("audit_append", "SELECT drive_number, 'registered' AS event FROM drives UNION ALL SELECT drive_number, 'renumbered' FROM drives WHERE drive_number = 99")
def audit_append(c):
    path = f"{flows.shared_folder(c.spark)}/audit"
    filesystem.append_log(c.drives.select("drive_number", F.lit("registered").alias("event")), path)
    filesystem.append_log(c.drives.where("drive_number = 99").select("drive_number", F.lit("renumbered").alias("event")), path)
    return c.spark.read.schema("drive_number int, event string").json(path)


@query("schema_migrate", "SELECT run_id, outcome, heartbeat, 6 AS version FROM runs")
def schema_migrate(c):
    steps = {5: ("registered_root", F.lit(None).cast("string")), 6: ("heartbeat", F.col("_beat"))}
    rows = c.runs.select("run_id", "outcome", F.col("heartbeat").alias("_beat")).withColumn("version", F.lit(4))
    for number in sorted(n for n in steps if n > 4):
        name, value = steps[number]
        rows = rows.withColumn(name, value).withColumn("version", F.lit(number))
    return rows.select("run_id", "outcome", "heartbeat", "version")


query("greedy_clusters")(lambda c: S.greedy_clusters(c.faces, 0.35, "person_id").select("face_id", "cluster"))
query("list_for_client", f"WITH {_LABELLED} SELECT session::BIGINT AS session, count(*) AS n FROM lab WHERE owner = 7 GROUP BY 1")(lambda c: X.label_sessions(c.captures).where("owner = 7").groupBy("session").agg(F.count("*").alias("n")))
query("next_proposal", f"WITH {_LABELLED} SELECT owner, session, n FROM ses ORDER BY n DESC, owner, session LIMIT 1")(lambda c: X.sessions(c.captures).orderBy(F.desc("n"), "owner", "session").limit(1).select("owner", "session", "n"))


def _log(c, action: str, retryable: bool = True):
    return c.queue.select("item_id", F.lit(1).alias("at"), F.lit(action).alias("action"), F.lit(retryable).alias("retryable"))


query("release", "SELECT item_id, 'queued' AS state, greatest(attempts - 1, 0) AS attempts FROM queue")(lambda c: Q.apply_transitions(c.queue, _log(c, "release")).select("item_id", "state", "attempts"))
query("complete", "SELECT item_id, 'complete' AS state FROM queue")(lambda c: Q.apply_transitions(c.queue, _log(c, "complete")).select("item_id", "state"))
query("fail", "SELECT item_id, CASE WHEN attempts < 3 THEN 'queued' ELSE 'failed' END AS state FROM queue")(lambda c: Q.apply_transitions(c.queue, _log(c, "fail")).select("item_id", "state"))
query("retry_failed", "SELECT item_id, CASE WHEN state = 'failed' AND code = 2 THEN 'queued' ELSE state END AS state, CASE WHEN state = 'failed' AND code = 2 THEN 0 ELSE attempts END AS attempts FROM queue")(
    lambda c: Q.apply_transitions(c.queue, _log(c, "retry").join(c.queue.where("state = 'failed' AND code = 2").select("item_id"), "item_id", "left_semi")).select("item_id", "state", "attempts")
)
query("requeue_changed", "SELECT item_id, CASE WHEN item_id % 4 = 0 THEN 'queued' ELSE state END AS state FROM queue")(
    lambda c: Q.apply_transitions(c.queue, _log(c, "retry").where("item_id % 4 = 0")).select("item_id", "state")
)


@query("heartbeat", "SELECT count(*) AS rows FROM captures")
def heartbeat(c):
    """The rows that a flow's progress reports add up to, from its own log."""
    beat = flows.Heartbeat()
    c.spark.streams.addListener(beat)
    stream = flows.read_stream(c.spark, f"{c.sf_dir}/events.parquet").select("event_id")
    flows.run_append(stream, flows.shared_folder(c.spark))
    c.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    c.spark.streams.removeListener(beat)
    lines = [json.loads(x) for x in beat.lines]
    return c.spark.createDataFrame([(sum(x.get("rows", 0) for x in lines),)], "rows long")


@query("progress_resume", "SELECT count(*) AS n, count(DISTINCT event_id) AS distinct_n FROM events")
def progress_resume(c):
    """The same flow started twice on one folder adds nothing the second time."""
    folder = flows.shared_folder(c.spark)
    for _ in range(2):
        out = flows.run_append(flows.read_stream(c.spark, f"{c.sf_dir}/events.parquet").select("event_id"), folder)
    return out.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("distinct_n"))
