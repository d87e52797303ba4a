"""Text search, vector search, fusion and entity resolution over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.functions import vectors as V
from shelfmark.functions.text import FOLD
from shelfmark.operators import faces as P
from shelfmark.operators import fulltext
from shelfmark.operators import rollups as R
from shelfmark.operators import search as S
from shelfmark.operators import vector_index
from shelfmark.plans.registry import query

ASKED = "of-the und erthth"
_TOK = f"list_filter(regexp_split_to_array(lower(translate(text, '{FOLD[0]}', '{FOLD[1]}')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def _vector(c, key: int) -> list[float]:
    row = c.table("embeddings").where(F.col("vec_id") == key).select("embedding").first()
    return [] if row is None else [float(x) for x in row[0]]


_BM = f"""WITH x AS (SELECT file_id, status, unnest([filename, relative_path, coalesce(tags, ''), coalesce(text, '')]) AS text FROM files LEFT JOIN (SELECT file_id, string_agg(DISTINCT name, ' ' ORDER BY name) AS tags FROM file_tags GROUP BY 1) USING (file_id)),
t AS (SELECT file_id, status, {_TOK} AS t FROM x),
k AS (SELECT file_id AS doc_id, any_value(status) AS status, sum(len(t))::INT AS len, sum(len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')))::INT AS a, sum(len(list_filter(t, lambda x: x = 'und')))::INT AS b, sum(len(list_filter(t, lambda x: x = 'erthth')))::INT AS c FROM t GROUP BY 1),
s AS (SELECT count(*) AS n, avg(len) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db, count(*) FILTER (c > 0) AS dc FROM k),
hits AS (SELECT doc_id, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2::DOUBLE / (a + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2::DOUBLE / (b + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean)) + ln(1 + (n - dc + 0.5) / (dc + 0.5)) * c * 2.2::DOUBLE / (c + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean)), 6) AS score FROM k, s WHERE a + b + c > 0 AND status = 'complete')"""


def _complete(c, hits):
    """Hits that are complete files, under the name doc_id."""
    return hits.withColumnRenamed("key", "doc_id").join(R.complete(c.files).select(F.col("file_id").alias("doc_id")), "doc_id", "left_semi")


@query("fts_match", _BM + " SELECT doc_id FROM hits")
def fts_match(c):
    return _complete(c, fulltext.found(c.spark, c.text_index, fulltext.phrases(ASKED)).select("key"))


@query("bm25", _BM + " SELECT doc_id, score FROM hits")
def bm25(c):
    return _complete(c, fulltext.bm25(c.spark, c.text_index, fulltext.phrases(ASKED)))


@query("rank_score", "WITH t AS (SELECT file_id, size_bytes FROM files ORDER BY size_bytes DESC, file_id LIMIT 100) SELECT file_id, round(CASE WHEN count(*) OVER () <= 1 THEN 1 ELSE 1 - (row_number() OVER (ORDER BY size_bytes DESC, file_id) - 1)::DOUBLE / count(*) OVER () END, 6) AS rank_score FROM t")
def rank_score(c):
    return S.ranked(c.files, "size_bytes", "file_id").select("file_id", F.round("rank_score", 6).alias("rank_score"))


_COS = "list_cosine_similarity(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 0))"


_ASK = "vec_id % 50 = 0"  # the stated query set
_EACH = """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query, v.vec_id, v.label, list_cosine_similarity(v.e, q.e) AS s FROM v, v q WHERE q.vec_id % 50 = 0)"""


def _nearest(c, k: int, others: bool = False, where: str = "true"):
    rows = c.table("embeddings")
    return vector_index.nearest(rows.where(where), rows.where(_ASK), k, others=others)


@query("vector_topk_exact", _EACH + " SELECT query, vec_id, round(s, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) <= 20")
def vector_topk_exact(c):
    return _nearest(c, 20).select("query", "vec_id", F.round("score", 6).alias("score"))


query("topk_vector", _EACH + " SELECT query, vec_id FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) <= 5")(lambda c: _nearest(c, 5).select("query", "vec_id"))


_Q8 = "list_transform(embedding, lambda x: round(x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * 127))"


_QUANT = f"""WITH q AS (SELECT vec_id, {_Q8} AS q FROM embeddings), s AS (SELECT o.vec_id AS query, q.vec_id, round(list_dot_product(q.q, o.q) / (sqrt(list_dot_product(q.q, q.q)) * sqrt(list_dot_product(o.q, o.q))), 6) AS score FROM q, q o WHERE o.vec_id % 50 = 0)"""


def _quantised(c, k: int):
    rows = c.table("embeddings")
    return vector_index.search_all(vector_index.build(rows), rows.where(_ASK), k)


@query("vector_topk_quantised", _QUANT + " SELECT query, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) <= 20")
def vector_topk_quantised(c):
    return _quantised(c, 20).select("query", "vec_id", "score")


@query("vector_index_build", f"SELECT vec_id, len(embedding) AS dim, sqrt(list_dot_product(q, q))::DOUBLE AS norm FROM (SELECT *, {_Q8} AS q FROM embeddings)".replace("sqrt(list_dot_product(q, q))::DOUBLE", "round(sqrt(list_dot_product(q, q)), 6)"))
def vector_index_build(c):
    rows = c.table("embeddings").select("vec_id", F.size("embedding").alias("dim"), V.quantise(F.col("embedding")).alias("q"))
    bounds = rows.agg(F.min("dim").alias("lo"), F.max("dim").alias("hi"))
    checked = rows.join(F.broadcast(bounds.where(F.assert_true(F.col("lo") == F.col("hi"), F.lit("mixed dimensions")).isNull())), F.lit(True))  # one row
    return checked.select("vec_id", "dim", F.round(F.sqrt(F.aggregate("q", F.lit(0), lambda s, x: s + x * x).cast("double")), 6).alias("norm"))


@query("vector_index_append", "SELECT vec_id, vec_id % 4 = 1 AS appended, md5(concat_ws(':', (SELECT count(*) FROM embeddings), (SELECT max(vec_id) FROM embeddings))) AS fingerprint FROM embeddings")
def vector_index_append(c):
    rows = c.table("embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 4 == 1, "2024-02-01").otherwise("2024-01-01").alias("created_at"))
    index, _ = vector_index.append_new(vector_index.build(rows.where("vec_id % 4 <> 1")), rows, "2024-02-01")
    state = F.broadcast(vector_index.fingerprint(index).select("fingerprint"))  # one row
    return index.select("vec_id", (F.col("vec_id") % 4 == 1).alias("appended")).join(state, F.lit(True))


@query("similar_to", _EACH + " SELECT query, vec_id FROM s WHERE query <> vec_id QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) <= 10")
def similar_to(c):
    return _nearest(c, 10, others=True).select("query", "vec_id")


@query("vector_search_filtered", _EACH + " SELECT query, vec_id FROM s WHERE label = 3 QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) <= 10")
def vector_search_filtered(c):
    return _nearest(c, 10, where="label = 3").select("query", "vec_id")


query("overfetch", f"WITH a AS (SELECT vec_id, label, {_COS} AS s FROM embeddings), t AS (SELECT * FROM a ORDER BY round(s, 6) DESC, vec_id LIMIT 200) SELECT vec_id FROM t WHERE label = 3 ORDER BY round(s, 6) DESC, vec_id LIMIT 10")(
    lambda c: V.top_k(c.table("embeddings"), _vector(c, 0), 200).join(c.table("embeddings").where("label = 3").select("vec_id"), "vec_id").orderBy(F.desc("score"), "vec_id").limit(10).select("vec_id")
)


_FUSE = _BM + f""", th AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS tp FROM hits QUALIFY tp < 50), tr AS (SELECT *, 1 - tp::DOUBLE / count(*) OVER () AS t FROM th),
vh AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY round({_COS}, 6) DESC, vec_id) - 1 AS vp FROM embeddings QUALIFY vp < 50), vr AS (SELECT *, 1 - vp::DOUBLE / count(*) OVER () AS v FROM vh)"""


@query("hybrid_search", _FUSE + " SELECT doc_id, round(least(coalesce(t * 0.6::DOUBLE, 0) + coalesce(v * (0.4::DOUBLE * 0.5), 0), 1), 6) AS score FROM tr FULL JOIN vr USING (doc_id) ORDER BY score DESC, tp NULLS LAST, vp NULLS LAST, doc_id LIMIT 60")
def hybrid_search(c):
    text = S.ranked(bm25(c), "score", "doc_id", 50)
    near = V.top_k(c.table("embeddings"), _vector(c, 0), 50).select(F.col("vec_id").alias("doc_id"), F.round("score", 6).alias("score"))
    return S.fuse(text, S.ranked(near, "score", "doc_id", 50), 0.5, "doc_id", 60)


query("fused_union", _FUSE + " SELECT doc_id, t IS NOT NULL AS by_text, v IS NOT NULL AS by_vector FROM tr FULL JOIN vr USING (doc_id)")(
    lambda c: S.ranked(bm25(c), "score", "doc_id", 50)
    .select("doc_id", F.lit(True).alias("t"))
    .join(V.top_k(c.table("embeddings"), _vector(c, 0), 50).select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("v")), "doc_id", "full_outer")
    .select("doc_id", F.col("t").isNotNull().alias("by_text"), F.col("v").isNotNull().alias("by_vector"))
)


@query("tag_browse", "SELECT f.file_id, f.filename FROM files f WHERE status = 'complete' AND file_id IN (SELECT file_id FROM file_tags WHERE name IN ('brand#1', 'brand#3') GROUP BY 1 HAVING count(DISTINCT name) = 2)")
def tag_browse(c):
    return R.complete(c.files).join(R.having_all(c.file_tags, "file_id", "name", ["brand#1", "brand#3"]), "file_id", "left_semi").select("file_id", "filename")


query("tag_count", "SELECT count(*) AS n FROM files WHERE status = 'complete' AND file_id IN (SELECT file_id FROM file_tags WHERE name IN ('brand#1', 'brand#3') GROUP BY 1 HAVING count(DISTINCT name) = 2)")(
    lambda c: tag_browse(c).agg(F.count("*").alias("n"))
)

LEXICON = {"sea": "water", "ocean": "water", "wave": "water", "tree": "forest", "forest": "forest", "data": "data", "report": "data"}
STOPWORDS = ["the", "a", "of", "and", "in", "on", "der", "die", "und", "la", "le", "de"]
PHRASES = {"black and white": "monochrome", "of the sea": "ocean"}
_LEX = "CASE " + " ".join(f"WHEN {{t}} = '{k}' THEN '{v}'" for k, v in LEXICON.items()) + " END"
_FOLDED = "replace(replace(lower(text), 'black and white', 'monochrome'), 'of the sea', 'ocean')"
_LEXICON = f"""WITH t AS (SELECT doc_id, list_filter(list_filter(regexp_split_to_array({_FOLDED}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), lambda x: x NOT IN ({', '.join(repr(w) for w in STOPWORDS)})) AS w FROM documents),
h AS (SELECT doc_id, w, list_filter(list_transform(w, lambda t: coalesce({_LEX.format(t='t')}, CASE WHEN suffix(t, 's') AND length(t) >= 4 THEN {_LEX.format(t='t[:-2]')} END)), lambda x: x IS NOT NULL) AS found FROM t)
SELECT doc_id, CASE WHEN len(w) > 0 THEN round(len(found)::DOUBLE / len(w), 6) ELSE 0.0 END::DOUBLE AS coverage, array_to_string(list_sort(list_distinct(found)), ',') AS matched FROM h"""


@query("query_lexicon", _LEXICON)
def query_lexicon(c):
    found = S.lexicon(F.col("text"), LEXICON, STOPWORDS, PHRASES)
    rows = c.table("documents").select("doc_id", found.alias("x"))
    return rows.select("doc_id", F.round("x.coverage", 6).alias("coverage"), F.array_join(F.array_sort("x.matched"), ",").alias("matched"))


_FACE = "SELECT a.face_id AS x, b.person_id, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS s FROM faces a JOIN faces b ON NOT a.confirmed AND b.confirmed"


def _split(c):
    return c.faces.where("NOT confirmed"), c.faces.where("confirmed")


@query("nearest_join", f"SELECT x AS face_id, max(s) AS score FROM ({_FACE}) GROUP BY 1 HAVING max(s) >= 0.3")
def nearest_join(c):
    return S.best_match(*_split(c), 0.3).select("face_id", "score")


@query("suggest_person", f"SELECT x AS face_id, s AS score, person_id FROM ({_FACE}) QUALIFY row_number() OVER (PARTITION BY x ORDER BY s DESC, person_id) = 1 AND s >= 0.3")
def suggest_person(c):
    return S.best_match(*_split(c), 0.3)


_ONE = f"SELECT x AS face_id, max(s) AS score FROM ({_FACE} AND b.person_id = 3) GROUP BY 1 HAVING max(s) >= 0.25"


@query("max_sim_join", _ONE)
def max_sim_join(c):
    open_, known = _split(c)
    return S.best_match(open_, known.where("person_id = 3"), 0.25).select("face_id", "score")


@query("suggest_for_person", f"SELECT cluster_id, count(*) AS faces, max(score) AS score FROM ({_ONE}) JOIN faces USING (face_id) GROUP BY 1")
def suggest_for_person(c):
    return max_sim_join(c).join(c.faces.select("face_id", "cluster_id"), "face_id").groupBy("cluster_id").agg(F.count("*").alias("faces"), F.max("score").alias("score"))


@query("pending_suggestions", "SELECT cluster_id, face_id, quality FROM faces JOIN clusters USING (cluster_id) WHERE status = 'suggested' QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY quality DESC, face_id) = 1")
def pending_suggestions(c):
    rows = c.faces.join(c.clusters.where("status = 'suggested'").select("cluster_id"), "cluster_id")
    return R.latest(rows, "cluster_id", [F.desc("quality"), F.asc("face_id")]).select("cluster_id", "face_id", "quality")


@query("gallery", "SELECT face_id, quality, count(*) OVER (PARTITION BY cluster_id) AS group_size FROM faces LEFT JOIN clusters USING (cluster_id) WHERE NOT is_false AND NOT is_ignored AND (status IS NULL OR status NOT IN ('rejected', 'suggested')) ORDER BY quality DESC, face_id LIMIT 60")
def gallery(c):
    rows = c.faces.where("NOT is_false AND NOT is_ignored").join(c.clusters.select("cluster_id", "status"), "cluster_id", "left").where("status IS NULL OR status NOT IN ('rejected', 'suggested')")
    return rows.withColumn("group_size", F.count("*").over(Window.partitionBy("cluster_id"))).orderBy(F.desc("quality"), "face_id").limit(60).select("face_id", "quality", "group_size")


@query("greedy_cluster")
def greedy_cluster(c):
    return S.greedy_clusters(c.faces, 0.35, "person_id")


query("greedy_clusters_sizes")(lambda c: S.greedy_clusters(c.faces, 0.35, "person_id").groupBy("person_id", "cluster").agg(F.count("*").alias("n")))


@query("cluster_threshold", "SELECT face_id, CASE WHEN person_id % 2 = 0 THEN 0.84 ELSE 0.92 END::DOUBLE AS threshold FROM faces")
def cluster_threshold(c):
    return c.faces.select("face_id", F.when(F.col("person_id") % 2 == 0, 0.84).otherwise(0.92).alias("threshold"))


@query("rebuild_keeps_confirmed", "SELECT face_id, CASE WHEN status = 'confirmed' THEN cluster_id END AS cluster_id FROM faces LEFT JOIN clusters USING (cluster_id)")
def rebuild_keeps_confirmed(c):
    return c.faces.select("face_id", "cluster_id").join(c.clusters.select("cluster_id", "status"), "cluster_id", "left").select("face_id", F.when(F.col("status") == "confirmed", F.col("cluster_id")).alias("cluster_id"))


@query("confirm_reject", "SELECT cluster_id, CASE WHEN status = 'confirmed' THEN status WHEN cluster_id % 2 = 0 THEN 'confirmed' ELSE 'rejected' END AS status FROM clusters")
def confirm_reject(c):
    return c.clusters.select("cluster_id", F.when(F.col("status") == "confirmed", F.col("status")).when(F.col("cluster_id") % 2 == 0, "confirmed").otherwise("rejected").alias("status"))


@query("rename_or_merge", "SELECT p.person_id, min(p.person_id) OVER (PARTITION BY lower(p.name)) AS keeps FROM people p")
def rename_or_merge(c):
    owner = c.people.groupBy(F.lower("name").alias("k")).agg(F.min("person_id").alias("keeps"))
    return c.people.withColumn("k", F.lower("name")).join(owner, "k").select("person_id", "keeps")


@query("merge_clusters", "SELECT cluster_id, count(*) AS n FROM (SELECT CASE WHEN cluster_id IN (4, 5) THEN 3 ELSE cluster_id END AS cluster_id FROM faces WHERE NOT is_false) GROUP BY 1")
def merge_clusters(c):
    return c.faces.where("NOT is_false").select(F.when(F.col("cluster_id").isin(4, 5), 3).otherwise(F.col("cluster_id")).alias("cluster_id")).groupBy("cluster_id").agg(F.count("*").alias("n"))


@query("delete_person", "SELECT cluster_id, CASE WHEN person_id <> 3 THEN person_id END AS person_id FROM clusters")
def delete_person(c):
    left = c.people.where("person_id <> 3").select("person_id", F.lit(True).alias("here"))
    return c.clusters.join(left, "person_id", "left").select("cluster_id", F.when(F.col("here"), F.col("person_id")).alias("person_id"))


@query("cluster_snapshot", "SELECT count(*) AS n, sum(face_id * 100 + cluster_id)::BIGINT AS mark FROM faces")
def cluster_snapshot(c):
    saved = c.faces.groupBy("cluster_id").agg(F.to_json(F.array_sort(F.collect_list(F.array("face_id", "cluster_id")))).alias("j"))
    back = saved.select(F.explode(F.from_json("j", "array<array<bigint>>")).alias("p"))
    return back.agg(F.count("*").alias("n"), F.sum(F.col("p")[0] * 100 + F.col("p")[1]).alias("mark"))


@query("vector_index_search", _QUANT + " SELECT query, vec_id, score, (row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id))::INT AS rank FROM s QUALIFY rank <= 10")
def vector_index_search(c):
    return _quantised(c, 10)


def _edits(c):
    """Every eleventh face is edited, in four ways, and every 22nd is moved before."""
    action = F.element_at(F.array(*map(F.lit, ("move", "split", "unlink", "false"))), (F.col("face_id") % 4 + 1).cast("int"))
    target = F.when(F.col("face_id") % 4 == 0, 7).cast("long").alias("target")
    late = c.faces.where("face_id % 11 = 0").select("face_id", F.lit(2).alias("at"), action.alias("action"), target)
    return late.union(c.faces.where("face_id % 22 = 0").select("face_id", F.lit(1), F.lit("move"), F.lit(9).cast("long")))


@query("face_edits", "SELECT face_id, CASE WHEN face_id % 11 <> 0 THEN cluster_id WHEN face_id % 4 = 0 THEN 7 WHEN face_id % 4 = 1 THEN -1 - face_id END::BIGINT AS cluster_id, is_false OR (face_id % 11 = 0 AND face_id % 4 = 3) AS is_false FROM faces")
def face_edits(c):
    return P.edit(c.faces, _edits(c)).select("face_id", "cluster_id", "is_false")


@query("clusters_after_edits", "SELECT cluster_id, CASE WHEN cluster_id IN (4, 5) THEN 'merged' ELSE status END AS status FROM clusters UNION ALL SELECT -1 - face_id, 'unnamed' FROM faces WHERE face_id % 11 = 0 AND face_id % 4 = 1")
def clusters_after_edits(c):
    return P.clusters_after(c.clusters, _edits(c), {4: 3, 5: 3}).select("cluster_id", "status")


def _named(c):
    names = c.clusters.where("cluster_id % 5 = 1").select("cluster_id", F.concat(F.lit(" pErson "), F.col("cluster_id") % 13, F.lit(" ")).alias("name"))
    return P.name_clusters(c.clusters, c.people, names)


_NAMED = """WITH k AS (SELECT lower(name) AS k, min(person_id) AS person_id FROM people GROUP BY 1), a AS (SELECT cluster_id, 'pErson ' || cluster_id % 13 AS name, 'person ' || cluster_id % 13 AS k FROM clusters WHERE cluster_id % 5 = 1),
n AS (SELECT k, min(name) AS name, ((SELECT max(person_id) FROM people) + row_number() OVER (ORDER BY k))::INT AS person_id FROM a WHERE k NOT IN (SELECT k FROM k) GROUP BY 1), o AS (SELECT k, person_id FROM k UNION ALL SELECT k, person_id FROM n)"""


@query("name_clusters", _NAMED + " SELECT c.cluster_id, coalesce(o.person_id, c.person_id) AS person_id, CASE WHEN a.k IS NULL THEN c.status ELSE 'confirmed' END AS status FROM clusters c LEFT JOIN a USING (cluster_id) LEFT JOIN o USING (k)")
def name_clusters(c):
    return _named(c)[0].select("cluster_id", "person_id", "status")


@query("people_created", _NAMED + " SELECT person_id, name FROM people UNION ALL SELECT person_id, name FROM n")
def people_created(c):
    return _named(c)[1].select("person_id", "name")
