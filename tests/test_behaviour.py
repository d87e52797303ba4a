"""Small cases with known answers."""

import datetime as dt
import math
import os

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from shelfmark.functions import dates as D
from shelfmark.functions import mining
from shelfmark.functions import text as T
from shelfmark.functions import vectors as V
from shelfmark.operators import backup, changes, faces, fulltext, quality, queue, rollups, search, sessions, vector_index
from shelfmark.sources import shared
from shelfmark.streaming import flows


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def _captures(spark, stamps):
    rows = [(i, 1, s) for i, s in enumerate(stamps)]
    return spark.createDataFrame(rows, "file_id long, owner long, ts timestamp")


START = dt.datetime(2024, 6, 1, 13, 0)


def _every(n, minutes, start=START):
    return [start + dt.timedelta(minutes=minutes * i) for i in range(n)]


def test_two_shoots(spark):
    rows = _captures(spark, _every(20, 3) + _every(15, 3, START + dt.timedelta(days=14)))
    assert sorted(r.n for r in sessions.sessions(rows).collect()) == [15, 20]


def test_past_midnight_is_one_session(spark):
    rows = _captures(spark, _every(30, 20) + _every(5, 3, START + dt.timedelta(hours=11, minutes=15)))
    assert [r.n for r in sessions.sessions(rows).collect()] == [35]


def test_strays_are_left_out(spark):
    rows = _captures(spark, _every(20, 3) + _every(2, 3, START + dt.timedelta(days=9)))
    assert [r.n for r in sessions.sessions(rows).collect()] == [20]


@pytest.mark.parametrize("seconds,n", [(36000, 1), (36001, 2)])
def test_gap_is_strict(spark, seconds, n):
    rows = _captures(spark, [START, START + dt.timedelta(seconds=seconds)])
    assert sessions.sessions(rows, least=1).count() == n


def _files(spark, *drives):
    rows = [(d, h, 1000 + len(h)) for d, hashes in drives for h in hashes]
    return spark.createDataFrame(rows, "drive_number int, content_hash string, size_bytes long")


def test_identical_collections(spark):
    r = rollups.compare_two(_files(spark, (1, "abc"), (2, "abc")), 1, 2).first()
    assert (r.shared, r.only_a, r.only_b, r.overlap, r.sentence) == (3, 0, 0, 100.0, "Drives 1 and 2 are identical — same 3 files.")


def test_contained_collection(spark):
    many = [f"h{i}" for i in range(100)]
    r = rollups.compare_two(_files(spark, (1, many), (2, many[:10])), 1, 2).first()
    assert (r.overlap, r.sentence) == (10.0, "Drive 2 is contained in drive 1: everything on 2 is also on 1, and 1 holds 90 more.")


def test_copies_within_a_collection_count_once(spark):
    r = rollups.compare_two(_files(spark, (1, ["a", "a"]), (2, ["a"])), 1, 2).first()
    assert (r.a_total, r.overlap) == (1, 100.0)


def test_near_identical_pairs(spark):
    many = [f"h{i}" for i in range(100)]
    pairs = rollups.compare_collections(_files(spark, (1, many + ["x", "y"]), (2, many + ["z"]), (3, ["q"]))).collect()
    assert [(p.a, p.b, p.near_identical) for p in pairs] == [(1, 2, True)]


def test_same_collection_is_an_error(spark):
    with pytest.raises(ValueError):
        rollups.compare_two(_files(spark, (1, "a")), 1, 1)


@pytest.mark.parametrize("text,year", [("Xmas_1987_scan.jpg", 1987), ("IMG_20040101.jpg", 2004), ("120040101", 2004), ("none 3000", None)])
def test_year_from_text(spark, text, year):
    assert _one(spark, T.year_from_text(F.lit(text))) == year


@pytest.mark.parametrize("text,day", [("1998:06:14", "1998-06-14"), ("1998:06:14 10:00:00", "1998-06-14"), ("2001-02-30", "2001-02-30"), ("1998", "1998-01-01"), ("1998-13-01", None), ("", None)])
def test_parse_ymd(spark, text, day):
    assert _one(spark, D.parse_ymd(F.lit(text))) == day


def test_reversed_range_is_swapped(spark):
    assert tuple(_one(spark, D.normalise_range(F.lit("1998-12-01"), F.lit("1998-01-01")))) == ("1998-01-01", "1998-12-01")


def test_no_evidence_is_uncertain(spark):
    rows = spark.sql("SELECT cast(null AS string) AS capture, cast(null AS string) AS digitised, cast(null AS int) AS name_year, false AS scan, false AS grey")
    x = D.with_estimate(rows).first()
    assert x.confidence < 0.2
    assert _one(spark, D.describe(F.lit(x.earliest), F.lit(x.latest), F.lit(x.confidence), F.lit("none"), F.lit(False))) == "Date uncertain"


@pytest.mark.parametrize("text,seconds", [("1970-01-01", 0), ("2000-02-29T00:00:01Z", 951782401), ("1969-12-31", -86400), ("2001-02-30", 983491200), ("junk", None)])
def test_parse_epoch(spark, text, seconds):
    assert _one(spark, D.parse_epoch(F.lit(text))) == seconds


@pytest.mark.parametrize("q,out", [("likely-scan", '"likely scan"'), ("a -- b", '"a" OR "b"'), ("'; drop", '"drop"'), ("", ""), ("café 結婚 a-b", '"café" OR "結婚" OR "a b"'), ("x\u00a0y", '"x" OR "y"')])
def test_sanitize(spark, q, out):
    assert _one(spark, T.sanitize_query(F.lit(q))) == out


@pytest.mark.parametrize("path,key", [("DCIM/Wedding/raw/x.jpg", "DCIM"), ("x.jpg", "(top of the drive)"), ("raw/x.jpg", "raw"), ("raw/Wedding/x.jpg", "raw"), ("Pictures/Desktop/Shoot/edits/x.jpg", "Shoot"), ("Users/x.jpg", "(top of the drive)"), ("Shoot/Pictures/x.jpg", "Shoot")])
def test_folder_key(spark, path, key):
    assert _one(spark, T.folder_key(F.lit(path))) == key


@pytest.mark.parametrize("text,n", [("20GB", 20 * 2**30), ("1.5 kb", 1536), ("-1GB", None), ("x", None), ("7", 7)])
def test_parse_size(spark, text, n):
    assert _one(spark, T.parse_size(F.lit(text))) == n


@pytest.mark.parametrize("a,b,d", [("0" * 16, "f" * 16, 64), ("0" * 16, "0" * 15 + "1", 1), ("zz", "0" * 16, 64)])
def test_hamming(spark, a, b, d):
    assert _one(spark, V.hamming64(F.lit(a), F.lit(b))) == d


def test_cosine_of_odd_vectors(spark):
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert _one(spark, V.cosine(arr(1, 0), arr(1, 0, 0))) == 0.0
    assert _one(spark, V.cosine(arr(0, 0), arr(1, 0))) == 0.0
    assert abs(_one(spark, V.cosine(arr(3, 4), arr(3, 4))) - 1) < 1e-12
    assert _one(spark, V.quantise(arr(3, -4))) == [76, -102]


def test_integrity_verdicts(spark):
    rows = spark.createDataFrame([("a", "a", True, True), (None, "b", True, True), ("a", "b", False, True), ("a", "b", True, True), ("a", None, None, None)], "s string, f string, z boolean, t boolean")
    got = [r.v for r in rows.select(changes.integrity_verdict(F.col("s"), F.col("f"), F.col("z"), F.col("t")).alias("v")).collect()]
    assert got == ["intact", "intact", "edited", "corrupt", "missing"]


def test_moved_files_match_one_to_one(spark):
    old = spark.createDataFrame([(1, "h", 10), (1, "h", 11)], "drive_number int, content_hash string, file_id long")
    new = spark.createDataFrame([(1, "h", "z"), (1, "h", "a"), (1, "h", "m")], "drive_number int, content_hash string, relative_path string")
    assert {(r.file_id, r.new_path) for r in changes.moved(old, new).collect()} == {(10, "a"), (11, "m")}


def test_release_refunds_and_retry_resets(spark):
    items = spark.createDataFrame([(1, "leased", 0), (2, "leased", 2), (3, "leased", 3), (4, "failed", 3)], "item_id long, state string, attempts int")
    log = spark.createDataFrame([(1, 1, "release", False), (2, 1, "fail", True), (3, 1, "fail", True), (4, 1, "retry", False)], "item_id long, at int, action string, retryable boolean")
    got = {r.item_id: (r.state, r.attempts) for r in queue.apply_transitions(items, log).collect()}
    assert got == {1: ("queued", 0), 2: ("queued", 2), 3: ("failed", 3), 4: ("queued", 0)}


def test_measured_throughput_replaces_the_default(spark):
    schema = "mode string, started long, ended long, files_done long"
    assert rollups.throughput(spark.createDataFrame([("full", 0, 32400, 3600)], schema)).first()[0] == 0.111111111
    assert rollups.throughput(spark.createDataFrame([("dry_run", 0, 10, 10)], schema)).first()[0] == 0.30


def test_report_halts(spark):
    rows = spark.createDataFrame([("a", "pass"), ("b", "halt")], "name string, status string")
    assert tuple(quality.rollup(rows).first()) == (False, True, "1 pass, 0 warn, 0 fail, 1 halt")


def test_phrase_needs_neighbouring_tokens(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Red, fox!"), (2, "red old fox"), (3, None)], "id int, text string")
    fulltext.build(rows, "id", ["text"], str(tmp_path / "i"))
    assert [r.key for r in fulltext.found(spark, str(tmp_path / "i"), fulltext.phrases("RED-fox")).collect()] == [1]


def test_greedy_clusters_follow_key_order(spark):
    rows = spark.createDataFrame([(1, 2, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (1, 3, [0.0, 1.0])], "b int, k long, v array<double>")
    got = {r.k: r.cluster for r in search.greedy_clusters(rows, 0.9, "b", "k", "v").collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_top_k_is_planned_as_one(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    plan = V.top_k(rows, [1.0] * 64, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "MapInArrow" in plan and "CartesianProduct" not in plan


def test_filters_reach_the_scan(spark, sf_dir):
    from shelfmark.sources.catalogue import Catalogue

    plan = Catalogue(spark, sf_dir).captures.where("event_type = 'click'").select("file_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in plan and "props" not in plan.split("ReadSchema")[1]


def test_enumerate_files(spark, tmp_path):
    from shelfmark.sources.filesystem import enumerate_files

    for name in ("a/x.JPG", "a/._x.jpg", "b/y.txt", "c/z.tif", "__MACOSX/q.jpg"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    got = [r.relative_path for r in enumerate_files(spark, str(tmp_path), extra=("txt",), exclude=("c/*z",)).collect()]
    assert got == ["a/x.JPG", "b/y.txt"]


@pytest.mark.parametrize("text,found", [("Red Bull and bull", ["red bull"]), ("apple pie", []), ("an Apple a day", []), ("an APPLE a day", ["apple"]), ("coca cola zero, Cola", ["coca cola"])])
def test_brands(text, found):
    from shelfmark.functions.mining import find_brands

    assert find_brands(text, ["red bull", "apple", "coca cola", "bull market"], frozenset(["apple"])) == found


@pytest.mark.parametrize("text,found", [("The Smith Wedding. Bob", ["Smith Wedding"]), ("in The Garden", ["Garden"]), ("NASA Logo Of The", ["Logo"]), ("", [])])
def test_names(text, found):
    from shelfmark.functions.mining import find_names

    assert find_names(text, frozenset(["the", "of", "in"])) == found


def test_words_become_a_vector():
    from shelfmark.functions.mining import embed_grid, render_words

    grid, part = render_words("oceans at night")
    assert part == pytest.approx(2 / 3) and len(embed_grid(grid)) == 65
    assert render_words("")[1] == 0.0


def test_engines_fall_back_and_later_ones_win(spark):
    from shelfmark.functions.engines import Engine, Registry

    lengths = Engine("lengths", "1", 0.5, lambda s: s.str.len().fillna(0).astype(int))
    registry = Registry(lengths)
    rows = spark.createDataFrame([("abc",), (None,)], "t string")
    first = rows.select(registry.analyse("caption", F.col("t"), "long").alias("r")).select("r.*").collect()
    assert [(r.value, r.model_id) for r in first] == [(3, "lengths"), (0, "lengths")]
    registry.register("caption", Engine("a", "1", 0.9, lambda s: s.fillna("") + "!"))
    registry.register("caption", Engine("b", "2", 0.9, lambda s: s.fillna("") + "?"))
    again = rows.select(registry.analyse("caption", F.col("t"), "string").alias("r")).select("r.*").collect()
    assert [(r.value, r.model_version) for r in again] == [("abc?", "2"), ("?", "2")]


def test_accents_and_capitals(spark):
    assert _one(spark, T.fold_accents(F.lit("Éléonore Škoda ñ"))) == "eleonore skoda ñ"
    assert _one(spark, T.normalise(F.lit("  MOËT & Chandon's Ñ1 "))) == "moet chandons 1"
    assert _one(spark, T.case_mask(F.lit("  MOËT & Chandon's Ñ1 "))) == "111101000000000"[:15]


def test_ambiguous_brands_are_in_capitals():
    from shelfmark.functions.mining import find_brands

    odd = frozenset(["apple", "moet"])
    assert find_brands("An Apple a day", ["apple"], odd) == []
    assert find_brands("an APPLE, MOËT", ["apple", "moet"], odd) == ["apple", "moet"]
    assert find_brands("Moët Citroen", ["Citroën"], odd) == ["Citroën"]


@pytest.mark.parametrize("args,words", [
    (("2001-01-01", "2001-01-01", 0.9, "name", True), "Taken on 2001-01-01"),
    (("2001-01-01", "2002-01-01", 0.9, "capture", True), "Between 2001-01-01 and 2002-01-01 (confirmed)"),
    (("2001-01-01", "2001-01-01", 0.9, "capture", False), "Taken on 2001-01-01"),
    (("1900-01-01", "2004-12-31", 0.2, "digitised", False), "Digitised around 2004; original date unknown"),
    (("2001-01-01", "2001-01-01", 0.1, "name", False), "Around 2001-01-01"),
    (("1970-01-01", "2025-12-31", 0.1, "name", False), "Date uncertain"),
    (("1987-01-01", "1988-12-31", 0.5, "name", False), "Likely taken between 1987 and 1988"),
])
def test_describe(spark, args, words):
    assert _one(spark, D.describe(*map(F.lit, args))) == words


def test_a_flow_stops_when_asked_and_goes_on(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "flow")
    spark.range(30).repartition(3).write.parquet(source)
    stop = flows.Stop(spark, folder)
    stop.request()
    os.utime(tmp_path / "flow" / "stop", (0, 0))  # a request of an earlier run is none of this one's

    def asks(df):
        stop.request()
        return df

    flow = lambda process: flows.run_batches(flows.read_stream(spark, source), folder, process).count()
    assert 0 < flow(asks) < 30
    stop.clear()
    assert flow(lambda df: df) == 30


def test_a_broken_flow_says_so(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    with pytest.raises(StreamingQueryException, match="failed their checks"):
        flows.run_batches(flows.read_stream(spark, str(tmp_path / "in")), str(tmp_path / "flow"), lambda df: df, lambda df: False, halt_after=1)


def test_report_sets_imprecise_rows_aside(spark):
    rows = [(i, 1, s, s + dt.timedelta(hours=h)) for i, (s, h) in enumerate(zip(_every(8, 10), (0, 48, 49, 0, 0, 0, 0, 0)))]
    rows += [(8, 2, START, None), (9, 2, None, None)]
    got = sessions.report(spark.createDataFrame(rows, "file_id long, owner long, ts timestamp, latest timestamp")).first()
    assert got.asDict() == {"proposed": 1, "grouped": 7, "skipped": 1, "undated": 1, "imprecise": 1}


def test_face_edits(spark):
    table = spark.createDataFrame([(i, 1, False) for i in range(5)], "face_id long, cluster_id long, is_false boolean")
    log = [(0, 1, "false", None), (0, 2, "move", 3), (1, 2, "split", None), (1, 1, "unlink", None), (2, 1, "unlink", None), (9, 1, "move", 2)]
    log = spark.createDataFrame(log, "face_id long, at int, action string, target long")
    got = {r.face_id: (r.cluster_id, r.is_false) for r in faces.edit(table, log).collect()}
    assert got == {0: (3, True), 1: (-2, False), 2: (None, False), 3: (1, False), 4: (1, False)}


def test_clusters_are_named(spark):
    clusters = spark.createDataFrame([(1, None, "suggested"), (2, None, "unnamed"), (3, 5, "confirmed")], "cluster_id long, person_id int, status string")
    people = spark.createDataFrame([(5, "Ada", "friend")], "person_id int, name string, relationship string")
    names = spark.createDataFrame([(1, " ADA "), (2, "Bo")], "cluster_id long, name string")
    named, known = faces.name_clusters(clusters, people, names)
    assert sorted(map(tuple, named.select("cluster_id", "person_id", "status").collect())) == [(1, 5, "confirmed"), (2, 6, "confirmed"), (3, 5, "confirmed")]
    assert sorted((r.person_id, r.name) for r in known.collect()) == [(5, "Ada"), (6, "Bo")]
    with pytest.raises(Exception, match="needs a name"):
        faces.name_clusters(clusters, people, spark.createDataFrame([(1, " ")], names.schema))[0].collect()


def test_a_damaged_snapshot_is_not_restored(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, `x.y` string")
    for name in ("t1", "t2", "t3"):
        backup.create({"rows": rows}, f"{tmp_path}/{name}")
    assert sorted(map(tuple, backup.restore(spark, f"{tmp_path}/t1")["rows"].collect()), key=str) == [(1, "a"), (2, None)]
    assert sorted(r.snapshot for r in backup.manifests(spark, str(tmp_path)).collect()) == ["t1", "t2", "t3"]
    assert [r.snapshot for r in backup.surplus(backup.manifests(spark, str(tmp_path)), 2).collect()] == ["t1"]
    rows.where("id = 1").write.mode("overwrite").parquet(f"{tmp_path}/t1/rows")
    with pytest.raises(ValueError, match="rows is damaged"):
        backup.restore(spark, f"{tmp_path}/t1")


def test_place_of_a_scene(spark):
    labels = lambda *x: F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).alias("confidence")) for n, c in x])
    assert _one(spark, mining.place(labels(("Blue Sky", 0.4), ("skyline", 0.7), ("bedroom", 0.2), ("cat", 0.9)))) == (0.2, 0.7)
    assert _one(spark, mining.place(labels(("cat", 0.9)))) == (0.0, 0.0)


def test_text_search(spark, tmp_path):
    rows = [(1, "Café at the sea", "IMG_7.jpg"), (2, "the", "sea.jpg"), (3, None, "CAFE\u0301.jpg"), (4, "", ""), (5, "the the the sea", "x"), (6, "結婚 sea the", None)]
    fulltext.build(spark.createDataFrame(rows, "id long, text string, name string"), "id", ["text", "name"], str(tmp_path / "i"))
    find = lambda q: sorted(r.key for r in fulltext.found(spark, str(tmp_path / "i"), fulltext.phrases(q)).collect())
    assert find("cafe") == find("CAFÉ") == find("Cafe\u0301") == [1, 3] and find("sea jpg") == [1, 2, 3, 5, 6]
    assert find("the-sea") == [1, 5]  # side by side in one field
    assert find("the.the the-the-the") == [5] and find("結婚") == [6] and find("- ?") == []
    score = {r.key: r.score for r in fulltext.bm25(spark, str(tmp_path / "i"), ["the sea"]).collect()}
    length = lambda n: 1.2 * (0.25 + 0.75 * n / (20 / 6))  # noqa: E731  (20 tokens in 6 documents)
    assert score == {k: pytest.approx(math.log(1 + 4.5 / 2.5) * 2.2 / (1 + length(n)), abs=1e-6) for k, n in ((1, 7), (5, 5))}
    assert fulltext.bm25(spark, str(tmp_path / "i"), []).collect() == []


def test_tables_are_built_once_for_their_state(spark, tmp_path):
    table, made, seen = str(tmp_path / "t"), [], []
    build = lambda path: (made.append(path), spark.range(1).write.parquet(path))
    for n in (5, 6):
        spark.range(n).write.mode("overwrite").parquet(table)
        for _ in range(2):
            seen.append(shared.once(spark, f"{tmp_path}/{shared.state([spark.read.parquet(table)])}", build))
    assert len(made) == 2 and seen[0] == seen[1] != seen[2] == seen[3]


def test_lexicon(spark):
    read = lambda t: _one(spark, search.lexicon(F.lit(t), {"sea": "water", "ocean": "water", "gas": "gas"}, ["the"], {"of the sea": "ocean"}))
    assert read("The seas and gas") == (2 / 3, ["water", "gas"])
    assert read("queen OF THE SEA") == (0.5, ["water"])
    assert read("the") == (0.0, []) and read("ga s") == (0.0, [])


def test_links_out_of_the_root_are_not_followed(spark, tmp_path):
    from shelfmark.sources import filesystem

    root, other = tmp_path / "root", tmp_path / "other"
    (root / "in").mkdir(parents=True)
    other.mkdir()
    for f in (root / "in" / "a.jpg", other / "b.jpg"):
        f.write_bytes(b"x")
    (root / "out").symlink_to(other)
    (root / "c.jpg").symlink_to(other / "b.jpg")
    (root / "again").symlink_to(root / "in")
    assert {r.relative_path for r in filesystem.enumerate_files(spark, str(root)).collect()} == {"in/a.jpg", "again/a.jpg"}


def test_where_to_look(spark):
    from shelfmark.operators import rollups

    drives = spark.createDataFrame([(1, "online", None), (5, "offline", "Drawer 2"), (6, "offline", None)], "drive_number int, status string, location string")
    tell = lambda rows: rollups.where_to_look(spark.createDataFrame(rows, "drive_number int, n long"), drives).first()[0]
    assert tell([(1, 2), (5, 9), (6, 2)]) == "Found on Drives 1, 5 and 6. Drive 5 has the most (9). Connect Drive 5 (Drawer 2), Drive 6 to open the originals."
    assert tell([(1, 2)]) == "Found on Drive 1." and tell([]) == "Not found on any indexed drive."


def _vectors(spark, n=90):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(6)], "2024-01-01" if i < 60 else "2024-02-01") for i in range(n)]
    return spark.createDataFrame(rows + [(1000, None, "2024-02-01"), (1001, [0.0] * 6, "2024-02-01"), (1002, [1.0], "2024-02-01")], "vec_id long, embedding array<double>, created_at string")


def test_nearest_takes_all_queries_in_blocks(spark, monkeypatch):
    rows = _vectors(spark)
    vectors = {r.vec_id: np.array(r.embedding) for r in rows.collect() if r.vec_id < 1000}
    want = {}
    for q, v in vectors.items():
        scored = sorted((-float(x @ v / np.linalg.norm(x) / np.linalg.norm(v)), k) for k, x in vectors.items() if k != q)
        want[q] = [k for _, k in scored[:4]]
    monkeypatch.setattr(vector_index, "QUERIES", 25)
    got: dict = {}
    for r in sorted(vector_index.nearest(rows, rows, 4, others=True).collect(), key=lambda r: (r["query"], r["rank"])):
        got.setdefault(r["query"], []).append(r.vec_id)
    assert {k: v for k, v in got.items() if k < 1000} == want and set(got) == set(want)


def test_index_grows_or_is_built_anew(spark):
    rows = _vectors(spark).where("vec_id < 1000")
    index = vector_index.build(rows.where("vec_id < 60"))
    grown, anew = vector_index.append_new(index, rows, "2024-02-01")
    assert not anew and grown.count() == 90
    left, anew = vector_index.append_new(grown, rows.where("vec_id <> 5"), "2024-02-01")
    assert anew and left.count() == 89
    assert vector_index.fingerprint(grown).first().fingerprint != vector_index.fingerprint(left).first().fingerprint
