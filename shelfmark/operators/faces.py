"""Edits of faces, their clusters and people, as functional updates: a log of edits is a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def own_cluster(face: Column) -> Column:
    """The cluster that a face gets when it is split off: negative, and its own."""
    return -1 - face


def edit(faces: DataFrame, log: DataFrame) -> DataFrame:
    """`faces` after the edits of `log` (face_id, at, action, target).

    move puts a face into the cluster `target`, split into one of its own, unlink into none;
    false does so as well and marks the detection, which no later edit takes back. Of a
    face's edits the one with the largest `at` tells its cluster. Edits of faces that aren't
    there do nothing. One shuffle on the face.
    """
    last = log.groupBy("face_id").agg(F.max_by(F.struct("action", "target"), "at").alias("_last"), F.bool_or(F.col("action") == "false").alias("_false"))
    rows = faces.join(last, "face_id", "left")
    action = F.col("_last.action")
    cluster = (
        F.when(action.isNull(), F.col("cluster_id"))
        .when(action == "move", F.col("_last.target"))
        .when(action == "split", own_cluster(F.col("face_id")))
    )
    return rows.withColumns({"cluster_id": cluster, "is_false": F.col("is_false") | F.coalesce("_false", F.lit(False))}).drop("_last", "_false")


def clusters_after(clusters: DataFrame, log: DataFrame, merged: dict[int, int] | None = None) -> DataFrame:
    """`clusters` with those that splits have opened, unnamed; clusters merged away say so."""
    gone = F.col("cluster_id").isin(*(merged or {}))
    kept = clusters.withColumn("status", F.when(gone, "merged").otherwise(F.col("status"))) if merged else clusters
    split = log.where("action = 'split'").select(own_cluster(F.col("face_id")).alias("cluster_id")).distinct()
    return kept.unionByName(split.withColumn("status", F.lit("unnamed")), allowMissingColumns=True)


def name_clusters(clusters: DataFrame, people: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters confirmed as the person that they are named after, and people with the new ones.

    `names` has cluster_id and name, one row a cluster. Names are trimmed and found without
    regard to case, the smallest person_id first; others open a person, numbered on from the largest in
    order of name. A blank or null name fails the job.
    """
    clean = F.trim("name")
    asked = names.select("cluster_id", F.when(F.length(clean) > 0, clean).otherwise(F.raise_error(F.lit("a person needs a name"))).alias("name"))
    asked = asked.withColumn("k", F.lower("name"))
    known = people.groupBy(F.lower("name").alias("k")).agg(F.min("person_id").alias("person_id"))
    new = asked.groupBy("k").agg(F.min("name").alias("name")).join(known, "k", "left_anti")
    largest = people.agg(F.coalesce(F.max("person_id"), F.lit(0)).alias("m"))
    number = (F.col("m") + F.row_number().over(Window.orderBy("k"))).cast("int")  # names typed by users
    new = new.join(F.broadcast(largest), F.lit(True)).select("k", number.alias("person_id"), "name")
    told = asked.join(known.unionByName(new.select("k", "person_id")), "k").select("cluster_id", F.col("person_id").alias("_p"))
    named = clusters.join(told, "cluster_id", "left")
    named = named.withColumns({"status": F.when(F.col("_p").isNotNull(), "confirmed").otherwise(F.col("status")), "person_id": F.coalesce("_p", "person_id")}).drop("_p")
    return named, people.unionByName(new.select("person_id", "name"), allowMissingColumns=True)
