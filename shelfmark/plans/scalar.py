"""Text, date, number and hash functions, each applied to a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import dates as D
from shelfmark.functions import mining
from shelfmark.functions import text as T
from shelfmark.functions import vectors as V
from shelfmark.plans.registry import query
from shelfmark.sources import filesystem

_DOC = "doc_id"


def _docs(c):
    return c.table("documents")


@query("fs_enumerate", "SELECT relative_path, extension FROM files WHERE extension IN ('en', 'de') AND relative_path NOT LIKE '%shoot_3%' ORDER BY relative_path")
def fs_enumerate(c):
    return filesystem.listed(c.files, ("en", "de"), ("shoot_3",)).select("relative_path", "extension").orderBy("relative_path")


@query("ext_filter", "SELECT page_id FROM pages WHERE lower(regexp_extract(url, '\\.([A-Za-z0-9]+)([?#].*)?$', 1)) IN ('html', 'htm')")
def ext_filter(c):
    return c.table("pages").where(F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)([?#].*)?$", 1)).isin("html", "htm")).select("page_id")


@query("glob_exclude", "SELECT file_id, regexp_matches(relative_path, 'src1.*en.*shoot_1') AS by_glob, contains(relative_path, 'shoot_2') AS by_text FROM files")
def glob_exclude(c):
    path = F.col("relative_path")
    return c.files.select("file_id", T.excluded(path, "src1*en*shoot_1*").alias("by_glob"), T.excluded(path, "shoot_2").alias("by_text"))


_SYSTEM = "concat(CASE file_id % 5 WHEN 0 THEN '__MACOSX/' WHEN 1 THEN '.Trashes/' ELSE 'a/' END, CASE file_id % 7 WHEN 0 THEN '._x' WHEN 1 THEN '.DS_Store' WHEN 2 THEN '.DS_Store2' ELSE 'x.jpg' END)"


@query("metadata_files", f"SELECT file_id, file_id % 5 IN (0, 1) OR file_id % 7 IN (0, 1) AS is_system FROM files WHERE length({_SYSTEM}) > 0")
def metadata_files(c):
    return c.files.select("file_id", T.system_file(F.expr(_SYSTEM)).alias("is_system"))


@query("path_containment", "SELECT file_id, file_id % 3 <> 0 AND file_id % 4 <> 0 AS safe FROM files")
def path_containment(c):
    path = F.expr("concat(CASE WHEN file_id % 3 = 0 THEN '/other/' ELSE '/root/' END, CASE WHEN file_id % 4 = 0 THEN '../' ELSE '..a/' END, filename)")
    return c.files.select("file_id", T.contained(path, "/root").alias("safe"))


@query("sanitize_fts", r"""SELECT doc_id, array_to_string(list_transform(list_filter(regexp_split_to_array(text, '[\t-\r \x{85}\p{Z}]+'), lambda w: regexp_matches(w, '[\p{L}\p{N}]')), lambda w: '"' || trim(regexp_replace(w, '[^\p{L}\p{N}]+', ' ', 'g')) || '"'), ' OR ') AS q FROM documents""")
def sanitize_fts(c):
    return _docs(c).select(_DOC, T.sanitize_query(F.col("text")).alias("q"))


@query("folder_key", "WITH p AS (SELECT file_id, extension, CASE file_id % 5 WHEN 0 THEN 'Pictures/desktop/' || extension || '/raw/x.jpg' WHEN 1 THEN 'x.jpg' WHEN 2 THEN 'Downloads/x.jpg' WHEN 3 THEN 'raw/' || relative_path ELSE relative_path END AS p FROM files) SELECT file_id, CASE file_id % 5 WHEN 0 THEN extension WHEN 1 THEN '(top of the drive)' WHEN 2 THEN '(top of the drive)' ELSE split_part(p, '/', 1) END AS folder FROM p")
def folder_key(c):
    path = F.expr("CASE file_id % 5 WHEN 0 THEN concat('Pictures/desktop/', extension, '/raw/x.jpg') WHEN 1 THEN 'x.jpg' WHEN 2 THEN 'Downloads/x.jpg' WHEN 3 THEN concat('raw/', relative_path) ELSE relative_path END")
    return c.files.select("file_id", T.folder_key(path).alias("folder"))


@query("month_phrase", "SELECT file_id, CASE WHEN substr(earliest, 1, 7) = substr(latest, 1, 7) THEN 'from ' || monthname(earliest::DATE) || ' ' || substr(earliest, 1, 4) WHEN substr(earliest, 1, 4) = substr(latest, 1, 4) THEN 'from ' || substr(earliest, 1, 4) ELSE 'from ' || substr(earliest, 1, 4) || ' to ' || substr(latest, 1, 4) END AS phrase FROM dates")
def month_phrase(c):
    return c.dates.select("file_id", T.month_phrase(F.col("earliest"), F.col("latest")).alias("phrase"))


@query("year_from_text", "WITH t AS (SELECT file_id, concat('scan1', file_id * 19, '_', 1850 + file_id % 300) AS s FROM files) SELECT file_id, (SELECT substr(s, i, 4)::INT FROM range(1, 30) r(i) WHERE regexp_matches(substr(s, i, 4), '^(19|20)[0-9][0-9]$') ORDER BY i LIMIT 1) AS year FROM t")
def year_from_text(c):
    return c.files.select("file_id", T.year_from_text(F.expr("concat('scan1', file_id * 19, '_', 1850 + file_id % 300)")).alias("year"))


@query("sql_like_nocase", "SELECT person_id, translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded FROM people")
def sql_like_nocase(c):
    return c.people.select("person_id", T.fold_nocase(F.col("name")).alias("folded"))


@query("fold_accents", f"SELECT doc_id, translate(text, '{T.ACCENTED}', '{T.PLAIN}') AS plain FROM documents")
def fold_accents(c):
    return _docs(c).select(_DOC, T.fold_accents(F.col("text")).alias("plain"))


_CASED = f"trim(regexp_replace(regexp_replace(translate(text, '{T.ACCENTED}', '{T.PLAIN_CASED}'), '[''’]', '', 'g'), '[^A-Za-z0-9]+', ' ', 'g'))"
_NORM = f"lower({_CASED})"


@query("normalise_with_case", f"SELECT doc_id, {_NORM} AS norm, regexp_replace(regexp_replace({_CASED}, '[^A-Z]', '0', 'g'), '[A-Z]', '1', 'g') AS mask FROM documents")
def normalise_with_case(c):
    return _docs(c).select(_DOC, T.normalise(F.col("text")).alias("norm"), T.case_mask(F.col("text")).alias("mask"))


@query("to_tag", f"SELECT doc_id, replace({_NORM}, ' ', '-') AS tag FROM documents")
def to_tag(c):
    return _docs(c).select(_DOC, T.to_tag(F.col("text")).alias("tag"))


@query("xml_escape", "SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS x FROM pages")
def xml_escape(c):
    return c.table("pages").select("page_id", T.xml_escape(F.col("html")).alias("x"))


@query("parse_size", "SELECT file_id, CASE file_id % 4 WHEN 0 THEN file_id WHEN 1 THEN file_id * 1024 WHEN 2 THEN file_id * 1073741824 ELSE NULL END AS bytes FROM files")
def parse_size(c):
    return c.files.select("file_id", T.parse_size(F.expr("CASE file_id % 4 WHEN 0 THEN concat(file_id, '') WHEN 1 THEN concat(file_id, ' kb') WHEN 2 THEN concat(file_id, 'GB') ELSE concat('-', file_id, 'GB') END")).alias("bytes"))


@query("human_bytes", "SELECT file_id, CASE WHEN s >= 1073741824 THEN floor(s / 1073741824)::BIGINT || ' GB' WHEN s >= 1048576 THEN floor(s / 1048576)::BIGINT || ' MB' WHEN s >= 1024 THEN floor(s / 1024)::BIGINT || ' KB' ELSE s || ' B' END AS size FROM (SELECT file_id, size_bytes * 997 AS s FROM files)")
def human_bytes(c):
    return c.files.select("file_id", T.human_bytes(F.col("size_bytes") * 997).alias("size"))


@query("photo_caption", "SELECT file_id, CASE WHEN file_id % 3 = 0 THEN 'Shoot' WHEN earliest = latest THEN '5 photographs on ' || earliest ELSE '5 photographs, ' || earliest || ' to ' || latest END AS caption FROM dates")
def photo_caption(c):
    name = F.expr("CASE WHEN file_id % 3 = 0 THEN 'Shoot' WHEN file_id % 3 = 1 THEN '  ' END")
    return c.dates.select("file_id", T.display_name(name, F.lit(5), F.col("earliest"), F.col("latest")).alias("caption"))


@query("scene_sentence", "WITH t AS (SELECT file_id, name, confidence, row_number() OVER (PARTITION BY file_id ORDER BY confidence DESC, name, tag_type) AS r FROM file_tags) SELECT file_id, coalesce(string_agg(name, ', ' ORDER BY r) FILTER (r <= 3 AND confidence >= 0.2), 'possibly ' || min(name) FILTER (r = 1)) AS sentence FROM t GROUP BY 1")
def scene_sentence(c):
    ranked = c.file_tags.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("minus"), "name", "tag_type"))).alias("t"))
    sure = F.transform(F.filter(F.slice("t", 1, 3), lambda x: x["minus"] <= -0.2), lambda x: x["name"])
    return ranked.select("file_id", F.when(F.size(sure) > 0, F.array_join(sure, ", ")).otherwise(F.concat(F.lit("possibly "), F.col("t")[0]["name"])).alias("sentence"))


@query("scene_place", "WITH l AS (SELECT p_partkey, lower(p_name) AS name, p_size / 50.0::DOUBLE AS confidence FROM part) SELECT p_partkey, CASE WHEN regexp_matches(name, 'indoor|room|furniture|kitchen|table|document|screenshot|food|wall|curtain|bed|chair') THEN confidence ELSE 0.0 END::DOUBLE AS indoor, CASE WHEN regexp_matches(name, 'outdoor|sky|beach|mountain|field|forest|garden|landscape|sea|ocean|snow|street|park|tree|plant|water|sunset') THEN confidence ELSE 0.0 END::DOUBLE AS outdoor FROM l")
def scene_place(c):
    label = F.array(F.struct(F.col("p_name").alias("name"), (F.col("p_size") / 50.0).alias("confidence")))
    return c.table("part").select("p_partkey", mining.place(label).alias("x")).select("p_partkey", "x.*")


_CAP = "CASE WHEN file_id % 2 = 0 THEN replace(earliest, '-', ':') || ' 10:11:12' END"


@query("estimate_date", """WITH x AS (SELECT file_id, earliest AS e, substr(earliest, 1, 4) AS y, 1890 + file_id % 300 AS fy, file_id % 2 = 0 AS cap, file_id % 3 = 0 AS dig, file_id % 5 = 0 AS scan, file_id % 7 = 0 AS grey FROM dates)
SELECT file_id, CASE WHEN cap THEN e WHEN dig AND scan THEN '1900-01-01' WHEN dig THEN y || '-01-01' WHEN fy BETWEEN 1900 AND 2100 THEN fy || '-01-01' WHEN grey THEN '1930-01-01' WHEN scan THEN '1960-01-01' ELSE '1970-01-01' END AS earliest,
CASE WHEN cap THEN e WHEN dig THEN y || '-12-31' WHEN fy BETWEEN 1900 AND 2100 THEN fy || '-12-31' WHEN grey THEN '1979-12-31' WHEN scan THEN '2005-12-31' ELSE '2025-12-31' END AS latest,
(CASE WHEN cap THEN 0.95 WHEN dig AND scan THEN 0.25 WHEN dig THEN 0.5 WHEN fy BETWEEN 1900 AND 2100 THEN 0.55 WHEN grey THEN 0.2 WHEN scan THEN 0.18 ELSE 0.1 END)::DOUBLE AS confidence,
concat_ws(', ', CASE WHEN cap THEN 'capture date' END, CASE WHEN dig THEN 'digitised' END, CASE WHEN fy BETWEEN 1900 AND 2100 THEN 'year in name' END, CASE WHEN grey THEN 'grey' END, CASE WHEN scan THEN 'scanned print' END) AS evidence FROM x""")
def estimate_date(c):
    dig = F.expr("CASE WHEN file_id % 3 = 0 THEN earliest END")
    rows = c.dates.select("file_id", F.expr(_CAP).alias("capture"), dig.alias("digitised"), F.expr("1890 + file_id % 300").alias("name_year"), F.expr("file_id % 5 = 0").alias("scan"), F.expr("file_id % 7 = 0").alias("grey"))
    return D.with_estimate(rows).select("file_id", "earliest", "latest", "confidence", "evidence")


@query("parse_ymd", "SELECT file_id, CASE file_id % 4 WHEN 0 THEN earliest WHEN 1 THEN substr(earliest, 1, 4) || '-01-01' WHEN 2 THEN '2001-02-30' END AS d FROM dates")
def parse_ymd(c):
    return c.dates.select("file_id", D.parse_ymd(F.expr("CASE file_id % 4 WHEN 0 THEN replace(earliest, '-', ':') WHEN 1 THEN substr(earliest, 1, 4) WHEN 2 THEN '2001:02:30 01:02:03' ELSE '2001-13-01' END")).alias("d"))


@query("is_iso_date", "SELECT file_id, file_id % 3 = 0 AS ok FROM dates")
def is_iso_date(c):
    return c.dates.select("file_id", D.is_iso_date(F.expr("CASE file_id % 3 WHEN 0 THEN earliest WHEN 1 THEN concat(earliest, 'T') ELSE '2001-00-10' END")).alias("ok"))


@query("normalise_range", "SELECT file_id, earliest, CASE WHEN file_id % 2 = 0 THEN earliest ELSE latest END AS latest FROM dates")
def normalise_range(c):
    x = D.normalise_range(F.expr("CASE WHEN file_id % 2 = 0 THEN earliest ELSE latest END"), F.expr("CASE WHEN file_id % 2 = 0 THEN ' ' ELSE earliest END"))
    return c.dates.select("file_id", x.alias("x")).select("file_id", "x.*")


@query("parse_epoch", "SELECT file_id, epoch(earliest::DATE)::BIGINT + CASE WHEN file_id % 2 = 0 THEN 3723 ELSE 0 END AS s FROM dates")
def parse_epoch(c):
    return c.dates.select("file_id", D.parse_epoch(F.expr("CASE WHEN file_id % 2 = 0 THEN concat(earliest, 'T01:02:03Z') ELSE earliest END")).alias("s"))


@query("describe_date", """SELECT file_id, CASE WHEN confirmed AND earliest = latest THEN concat('Taken on ', earliest) WHEN confirmed THEN concat('Between ', earliest, ' and ', latest, ' (confirmed)')
  WHEN file_id % 3 = 0 THEN concat('Taken on ', earliest) WHEN file_id % 3 = 1 THEN concat('Digitised around ', year(latest::DATE), '; original date unknown')
  WHEN earliest = latest THEN concat('Around ', earliest) WHEN confidence < 0.2 THEN 'Date uncertain' ELSE concat('Likely taken between ', year(earliest::DATE), ' and ', year(latest::DATE)) END AS words FROM dates""")
def describe_date(c):
    source = F.expr("element_at(array('capture', 'digitised', 'name'), cast(file_id % 3 AS int) + 1)")
    return c.dates.select("file_id", D.describe(F.col("earliest"), F.col("latest"), F.col("confidence"), source, F.col("confirmed")).alias("words"))


@query("age_minutes", "SELECT file_id, CASE WHEN file_id % 3 = 0 THEN NULL ELSE floor((epoch('2005-01-01'::TIMESTAMP) - epoch(earliest::TIMESTAMP) - 90) / 60)::BIGINT END AS m FROM dates")
def age_minutes(c):
    return c.dates.select("file_id", D.age_minutes(F.expr("CASE WHEN file_id % 3 = 0 THEN 'soon' ELSE concat(earliest, 'T00:01:30Z') END"), F.lit("2005-01-01T00:00:00Z")).alias("m"))


@query("reconciled_status", "SELECT run_id, CASE WHEN outcome <> 'running' THEN outcome WHEN run_id % 2 = 0 THEN 'interrupted' WHEN run_id % 60 >= 30 THEN 'stalled' ELSE 'running' END AS status FROM runs")
def reconciled_status(c):
    return c.runs.select("run_id", D.reconciled_status(F.col("outcome"), F.col("run_id") % 2 == 1, F.col("run_id") % 60).alias("status"))


@query("strftime_seconds", "SELECT run_id, ended - started AS seconds FROM runs WHERE ended IS NOT NULL")
def strftime_seconds(c):
    return c.runs.where("ended IS NOT NULL").select("run_id", (F.unix_timestamp(F.timestamp_seconds("ended")) - F.unix_timestamp(F.timestamp_seconds("started"))).alias("seconds"))


@query("date_label", "SELECT file_id, CASE WHEN earliest = latest THEN 'Around ' || earliest ELSE 'Likely between ' || substr(earliest, 1, 4) || ' and ' || substr(latest, 1, 4) END AS label FROM dates")
def date_label(c):
    return c.dates.select("file_id", D.label(F.col("earliest"), F.col("latest")).alias("label"))


@query("exif_date", "SELECT file_id, earliest AS d FROM dates")
def exif_date(c):
    return c.dates.select("file_id", F.regexp_replace(F.expr("concat(replace(earliest, '-', ':'), ' 10:00:00')"), "^([0-9]{4}):([0-9]{2}):([0-9]{2}).*$", "$1-$2-$3").alias("d"))


@query("cosine", "SELECT a.face_id, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS score FROM faces a, (SELECT embedding FROM faces WHERE face_id = 0) b")
def cosine(c):
    q = c.faces.where("face_id = 0").select(F.col("embedding").alias("q"))  # one row
    return c.faces.join(F.broadcast(q), F.lit(True)).select("face_id", F.round(V.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))


_Q8 = "list_transform(embedding, lambda x: greatest(least(round(x / sqrt(list_dot_product(embedding, embedding)) * 127), 127), -127)::INT)"


@query("quantise_i8", f"SELECT face_id, list_sum({_Q8})::BIGINT AS total, list_sum(list_transform({_Q8}, lambda x: abs(x)))::BIGINT AS size FROM faces")
def quantise_i8(c):
    q = c.faces.select("face_id", V.quantise(F.col("embedding")).alias("q"))
    total = lambda f: F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + f(x))
    return q.select("face_id", total(lambda x: x).alias("total"), total(F.abs).alias("size"))


@query("l2_normalise", "SELECT face_id, round(list_sum(list_transform(embedding, lambda x: abs(x))) / sqrt(list_dot_product(embedding, embedding)), 5) AS l1 FROM faces")
def l2_normalise(c):
    return c.faces.select("face_id", F.round(F.aggregate(V.l2_normalise(F.col("embedding")), F.lit(0.0), lambda s, x: s + F.abs(x)), 5).alias("l1"))


def _half(start: int) -> str:
    return f"('0x' || substr(content_hash, {start}, 8))::BIGINT"


@query("hamming64", f"SELECT file_id, CASE WHEN file_id % 9 = 0 THEN 64 ELSE (bit_count(xor({_half(1)}, {_half(17)})) + bit_count(xor({_half(9)}, {_half(25)})))::INT END AS d FROM files")
def hamming64(c):
    return c.files.select("file_id", V.hamming64(F.expr("CASE WHEN file_id % 9 = 0 THEN 'zz' ELSE substr(content_hash, 1, 16) END"), F.substring("content_hash", 17, 16)).alias("d"))


@query("dhash", None)
def dhash(c):
    return c.files.select("file_id", V.luma_hash(F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: (F.col("file_id") * (i + 3) * 37) % 256)).alias("h"))


@query("content_hash", "SELECT doc_id, sha256(text) AS h FROM documents")
def content_hash(c):
    return _docs(c).select(_DOC, F.sha2("text", 256).alias("h"))


@query("queue_key", "SELECT file_id, substr(sha256(concat(drive_number, chr(0), relative_path)), 1, 32) AS k FROM files")
def queue_key(c):
    return c.files.select("file_id", V.path_key(F.col("drive_number"), F.col("relative_path")).alias("k"))


@query("json_in", "SELECT file_id, name FROM file_tags WHERE name IN ('brand#1', 'brand#9')")
def json_in(c):
    return c.file_tags.where(F.array_contains(F.from_json(F.lit('["brand#1", "brand#9"]'), "array<string>"), F.col("name"))).select("file_id", "name")


@query("json_object", "SELECT doc_id, CASE WHEN length(text) > 4000 THEN '{\"_note\":\"left out\",\"size\":' || length(text) || '}' ELSE 'kept' END AS j FROM documents")
def json_object(c):
    n = F.char_length("text")
    return _docs(c).select(_DOC, F.when(n > 4000, F.to_json(F.struct(F.lit("left out").alias("_note"), n.alias("size")))).otherwise("kept").alias("j"))


@query("clamp01", "SELECT file_id, least(greatest(value / 10, 0.0), 1.0)::DOUBLE AS v FROM captures")
def clamp01(c):
    return c.captures.select("file_id", F.least(F.greatest(F.col("value") / 10, F.lit(0.0)), F.lit(1.0)).alias("v"))


@query("aes_seal", "SELECT file_id, content_hash AS opened FROM files")
def aes_seal(c):
    key = F.unhex(F.lit("00112233445566778899aabbccddeeff"))
    sealed = c.files.select("file_id", F.aes_encrypt(F.col("content_hash"), key, F.lit("GCM")).alias("sealed"))
    return sealed.select("file_id", F.aes_decrypt("sealed", key, F.lit("GCM")).cast("string").alias("opened"))


@query("exif_extract", "SELECT file_id, least(length(text), 256) AS n FROM files")
def exif_extract(c):
    tags = F.create_map(F.lit("Comment"), F.substring("text", 1, 256), F.lit("Empty"), F.lit(""))
    kept = F.map_filter(tags, lambda k, v: F.length(v) > 0)
    return c.files.select("file_id", F.char_length(kept["Comment"]).alias("n"))
