"""The catalogue's tables as lazy DataFrames over a directory of Parquet tables.

A catalogue has numbered drives, files on them with tags, dates, text and vectors, faces
with clusters and people, scan runs and a work queue. The supplied tables hold no
photographs, so each catalogue table is derived from the one with the same shape:
documents stand for files, their sources for drives, orders for dates and scan runs,
line items and parts for tags, vectors for faces, and events for captures and queue items.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import fulltext
from shelfmark.shipping import ship
from shelfmark.sources import shared


class Catalogue:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        ship(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def files(self) -> DataFrame:
        return self.table("documents").selectExpr(
            "doc_id AS file_id",
            "cast(substr(source, 4) AS int) AS drive_number",
            "concat(source, '/', lang, '/shoot_', doc_id % 37, '/img_', doc_id, '.', lang) AS relative_path",
            "concat('img_', doc_id, '.', lang) AS filename",
            "lang AS extension",
            "n_chars AS size_bytes",
            "sha2(text, 256) AS content_hash",
            "CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 13 = 0 THEN 'failed' ELSE 'complete' END AS status",
            "(doc_id * 1000003) % 1000000007 AS mtime_ns",
            "doc_id AS ingest_seq",
            "text",
        )

    @cached_property
    def drives(self) -> DataFrame:
        """One row a source, and drive 99, which holds nothing."""
        named = self.table("documents").select("source").distinct().selectExpr("source AS name", "cast(substr(source, 4) AS int) AS drive_number")
        named = named.union(self.spark.range(1).selectExpr("'spare' AS name", "99 AS drive_number"))
        return named.selectExpr("drive_number", "name", "CASE drive_number % 3 WHEN 0 THEN 'offline' ELSE 'online' END AS status", "CASE WHEN drive_number % 4 = 0 THEN NULL ELSE concat('Shelf ', drive_number % 5) END AS location", "concat('/Volumes/', name) AS root")

    @cached_property
    def file_tags(self) -> DataFrame:
        parts = self.table("part").selectExpr("p_partkey AS l_partkey", "lower(p_brand) AS name", "CASE p_size % 7 WHEN 0 THEN 'person' WHEN 1 THEN 'event' ELSE 'object' END AS tag_type")
        items = self.table("lineitem").selectExpr("l_partkey", "l_orderkey AS file_id", "l_discount * 10 AS confidence")
        return items.join(parts, "l_partkey").groupBy("file_id", "name", "tag_type").agg(F.max("confidence").alias("confidence"))

    @cached_property
    def dates(self) -> DataFrame:
        return self.table("orders").selectExpr("o_orderkey AS file_id", "date_format(o_orderdate, 'yyyy-MM-dd') AS earliest", "date_format(o_orderdate + make_interval(0, 0, 0, cast(o_orderkey % 5 AS int)), 'yyyy-MM-dd') AS latest", "o_orderstatus = 'F' AS confirmed", "o_orderkey % 100 / 100.0D AS confidence")

    @cached_property
    def faces(self) -> DataFrame:
        return self.table("embeddings").selectExpr(
            "vec_id AS face_id", "vec_id AS file_id", "vec_id % 50 AS cluster_id", "vec_id % 3 = 0 AS confirmed", "label AS person_id",
            "((vec_id * 37) % 100) / 100.0D AS quality", "vec_id % 17 = 0 AS is_ignored", "vec_id % 19 = 0 AS is_false", "embedding",
        )

    @cached_property
    def clusters(self) -> DataFrame:
        return self.spark.range(0, 52, 1, 1).selectExpr("id AS cluster_id", "CASE WHEN id % 4 = 3 THEN NULL ELSE cast(id % 10 AS int) END AS person_id", "element_at(array('confirmed', 'suggested', 'rejected', 'unnamed'), cast(id % 4 AS int) + 1) AS status")

    @cached_property
    def people(self) -> DataFrame:
        return self.spark.range(0, 12, 1, 1).selectExpr("cast(id AS int) AS person_id", "concat(CASE WHEN id % 2 = 0 THEN 'Person ' ELSE 'PERSON ' END, id % 9) AS name", "CASE id % 4 WHEN 3 THEN NULL ELSE element_at(array('family', 'friend', 'client'), cast(id % 4 AS int) + 1) END AS relationship")

    @cached_property
    def captures(self) -> DataFrame:
        """Captured files with a time: id, owner, ts (timestamp), value."""
        return self.table("events").selectExpr("event_id AS file_id", "user_id AS owner", "cast(ts AS timestamp) AS ts", "value", "event_type", "props")

    @cached_property
    def runs(self) -> DataFrame:
        done = self.table("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("files_discovered"), F.count_if(F.col("l_linestatus") == "F").alias("files_done"))
        orders = self.table("orders").selectExpr(
            "o_orderkey AS run_id", "cast(o_custkey % 21 AS int) AS drive_number", "CASE WHEN o_custkey % 7 = 0 THEN 'dry_run' ELSE 'full' END AS mode", "unix_timestamp(cast(o_orderdate AS timestamp)) + o_orderkey AS started",
            "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS outcome", "cast(floor(o_totalprice / 100) AS bigint) AS seconds",
        )
        runs = orders.join(done, orders.run_id == done.l_orderkey, "left")
        return runs.selectExpr("run_id", "drive_number", "mode", "started", "CASE WHEN outcome <> 'running' THEN started + seconds END AS ended", "CASE WHEN run_id % 3 = 0 THEN NULL ELSE started + seconds div 2 END AS heartbeat", "outcome", "coalesce(files_discovered, 0) AS files_discovered", "coalesce(files_done, 0) AS files_done")

    @cached_property
    def queue(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id AS item_id", "cast(user_id % 20 AS int) AS drive_number", "concat('f/', user_id % 10, '/', event_id) AS path",
            "CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'complete' WHEN 'purchase' THEN 'leased' ELSE 'failed' END AS state",
            "cast(event_id % 5 AS int) AS attempts", "cast(floor(value * 1000) AS bigint) AS expires_ns", "cast(get_json_object(props, '$.k') AS int) % 6 AS code", "concat('q', user_id, '-', event_id % 50) AS queue_key",
        )

    @cached_property
    def searchable(self) -> DataFrame:
        """The fields that a text search reads, one row a file."""
        tags = self.file_tags.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_set("name")), " ").alias("tags"))
        return self.files.select("file_id", "filename", "relative_path", "text").join(tags, "file_id", "left")

    @cached_property
    def text_index(self) -> str:
        """The folder of the text index, built when its tables are searched first or have changed."""
        now = shared.state([self.table(name) for name in ("documents", "lineitem", "part")])
        build = lambda path: fulltext.build(self.searchable, "file_id", ["filename", "relative_path", "tags", "text"], path, fulltext.splits(self.table("documents")))
        return shared.once(self.spark, f"{shared.base(self.spark)}/fulltext-{now}", build)


#: The same tables for DuckDB, over views of the supplied tables.
VIEWS = """
files AS (SELECT doc_id AS file_id, substr(source, 4)::INT AS drive_number, concat(source, '/', lang, '/shoot_', doc_id % 37, '/img_', doc_id, '.', lang) AS relative_path,
  concat('img_', doc_id, '.', lang) AS filename, lang AS extension, n_chars AS size_bytes, sha256(text) AS content_hash,
  CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 13 = 0 THEN 'failed' ELSE 'complete' END AS status, (doc_id * 1000003) % 1000000007 AS mtime_ns, doc_id AS ingest_seq, text FROM documents),
drives AS (SELECT drive_number, name, CASE drive_number % 3 WHEN 0 THEN 'offline' ELSE 'online' END AS status, CASE WHEN drive_number % 4 = 0 THEN NULL ELSE concat('Shelf ', drive_number % 5) END AS location, '/Volumes/' || name AS root
  FROM (SELECT DISTINCT source AS name, substr(source, 4)::INT AS drive_number FROM documents UNION ALL SELECT 'spare', 99)),
file_tags AS (SELECT l_orderkey AS file_id, lower(p_brand) AS name, CASE p_size % 7 WHEN 0 THEN 'person' WHEN 1 THEN 'event' ELSE 'object' END AS tag_type, max(l_discount * 10) AS confidence
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
dates AS (SELECT o_orderkey AS file_id, strftime(o_orderdate, '%Y-%m-%d') AS earliest, strftime(o_orderdate + to_days((o_orderkey % 5)::INT), '%Y-%m-%d') AS latest, o_orderstatus = 'F' AS confirmed, o_orderkey % 100 / 100.0::DOUBLE AS confidence FROM orders),
faces AS (SELECT vec_id AS face_id, vec_id AS file_id, vec_id % 50 AS cluster_id, vec_id % 3 = 0 AS confirmed, label AS person_id, ((vec_id * 37) % 100) / 100.0::DOUBLE AS quality, vec_id % 17 = 0 AS is_ignored, vec_id % 19 = 0 AS is_false, list_transform(embedding, lambda x: x::DOUBLE) AS embedding FROM embeddings),
clusters AS (SELECT id AS cluster_id, CASE WHEN id % 4 = 3 THEN NULL ELSE (id % 10)::INT END AS person_id, ['confirmed', 'suggested', 'rejected', 'unnamed'][id % 4 + 1] AS status FROM range(52) t(id)),
people AS (SELECT id::INT AS person_id, concat(CASE WHEN id % 2 = 0 THEN 'Person ' ELSE 'PERSON ' END, id % 9) AS name, CASE WHEN id % 4 = 3 THEN NULL ELSE ['family', 'friend', 'client'][id % 4 + 1] END AS relationship FROM range(12) t(id)),
captures AS (SELECT event_id AS file_id, user_id AS owner, ts, epoch_us(ts) AS us, value, event_type, props FROM events),
runs AS (SELECT run_id, drive_number, mode, started, CASE WHEN outcome <> 'running' THEN started + seconds END AS ended, CASE WHEN run_id % 3 = 0 THEN NULL ELSE started + seconds // 2 END AS heartbeat, outcome, coalesce(d, 0) AS files_discovered, coalesce(f, 0) AS files_done FROM
  (SELECT o_orderkey AS run_id, (o_custkey % 21)::INT AS drive_number, CASE WHEN o_custkey % 7 = 0 THEN 'dry_run' ELSE 'full' END AS mode, epoch(o_orderdate)::BIGINT + o_orderkey AS started, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS outcome, floor(o_totalprice / 100)::BIGINT AS seconds FROM orders)
  LEFT JOIN (SELECT l_orderkey, count(*) AS d, count(*) FILTER (l_linestatus = 'F') AS f FROM lineitem GROUP BY 1) ON l_orderkey = run_id),
queue AS (SELECT event_id AS item_id, (user_id % 20)::INT AS drive_number, concat('f/', user_id % 10, '/', event_id) AS path, CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'complete' WHEN 'purchase' THEN 'leased' ELSE 'failed' END AS state,
  (event_id % 5)::INT AS attempts, floor(value * 1000)::BIGINT AS expires_ns, (props->>'$.k')::INT % 6 AS code, concat('q', user_id, '-', event_id % 50) AS queue_key FROM events)
"""
