from pyspark.sql import functions as F

from lodestar.functions import codecs, describe, vocab
from lodestar.functions import text as tx
from lodestar.operators import index, interpret, recommend, search


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first().r


def test_stems_meet_their_plurals(spark):
    table = {"horses": "horse", "glasses": "glass", "glass": "glass", "boxes": "box", "churches": "church", "berries": "berry", "men": "man", "buses": "bus", "gas": "gas", "thes": "the", "ties": "tie"}
    for word, want in table.items():
        assert one(spark, word, tx.stem) == want, word


def test_tokens_of_odd_texts(spark):
    assert one(spark, "The Horses & ye élan 7 42nd", tx.tokens) == ["horse", "ye", "lan", "42nd"]
    assert one(spark, "", tx.tokens) == [] and one(spark, "  नम 🐘 the", tx.tokens) == []
    assert one(spark, "a b", lambda c: tx.bigrams(tx.words(c))) == ["a b"] and one(spark, "a", lambda c: tx.bigrams(tx.words(c))) == []


def clips(spark):
    rows = [("a", "Old horse market", "horses and carts"), ("b", "Horse", "a fair"), ("c", "Market carts", ""), ("d", "the of", None), ("e", "Talks about a horse", "")]
    return spark.createDataFrame(rows, "id string, title string, text string")


def test_index_counts_titles_three_times_and_leaves_out_empty_documents(spark):
    built = index.build(clips(spark))
    assert {r.id: r.len for r in built.docs.collect()} == {"a": 11, "b": 4, "c": 6, "e": 6}
    assert built.stats.first().n_docs == 4


def test_search_requires_relaxes_and_ranks(spark):
    built = index.build(clips(spark))
    asked = spark.createDataFrame([(1, "horse market"), (2, "the of"), (3, "horses horses"), (4, "zzz"), (5, None)], "query_id int, query string")
    got = search.search(asked, built, clips(spark), 10).orderBy("query_id", "rank").collect()
    by = {q: [r.id for r in got if r.query_id == q] for q in (1, 2, 3, 4, 5)}
    assert by[1][0] == "a" and set(by[1]) == {"a", "b", "c", "e"} and by[2] == by[4] == by[5] == []
    assert by[3][0] == "b" and by[3][-1] in ("a", "e")
    counts = {r.query_id: r.n for r in search.count_matches(asked, built, clips(spark)).collect()}
    assert counts == {1: 4, 2: 0, 3: 3, 4: 0, 5: 0}


def test_written_index_is_read_back_or_refused(spark, tmp_path):
    path = str(tmp_path / "ix")
    assert index.load(spark, path, 5) is None
    opened = index.open_or_build(spark, path, clips(spark))
    assert opened.terms.count() == index.build(clips(spark)).terms.count()
    assert index.load(spark, path, 5) is not None and index.load(spark, path, 6) is None


def test_codecs_round_trip_and_never_raise(spark):
    q = ("city", "craft")
    df = spark.createDataFrame([({"city": " Old fort~ & lake é ", "craft": ""},), ({},)], "a map<string,string>")
    back = df.select(codecs.decode_share(codecs.encode_share(F.col("a"), q), q).alias("s"), codecs.decode_cookie(codecs.encode_cookie(F.col("a")), q).alias("c")).collect()
    assert back[0].s == {"city": "Old fort  & lake é"} and back[0].c == {"city": "Old fort~ & lake é"} and back[1].s == back[1].c == {}
    bad = spark.createDataFrame([("%%%",), ("Nn4",), ("",), (None,), ("x" * 3000,), ("/////w",)], "t string")
    for r in bad.select(codecs.decode_share(F.col("t"), q).alias("s"), codecs.decode_cookie(F.col("t"), q).alias("c")).collect():
        assert (r.s or {}) == {} and (r.c or {}) == {}


def test_titles_and_blurbs(spark):
    assert one(spark, "SG 12 | Boats at Goa, HD | x", describe.clean_title) == "Boats at Goa"
    assert one(spark, "x" * 39, describe.blurb) is None and one(spark, "y" * 300, describe.blurb).endswith("…")


def test_greedy_runs_do_not_overlap(spark):
    places = spark.createDataFrame([("nd", "New Delhi", "Delhi"), ("d", "Delhi", "Delhi")], "id string, name string, state string")
    aliases = spark.createDataFrame([("dilli", "d")], "alias string, place_id string")
    words = interpret.dictionary(spark, places, aliases)
    asked = spark.createDataFrame([(1, "place", "New Delhi and Dilli boats!"), (2, "topic", "Delhi boats"), (3, "place", ""), (4, "place", None)], "answer_id int, kind string, answer string")
    got = {r.answer_id: r for r in interpret.interpret(asked, words).collect()}
    assert got[1].places == ["nd", "d"] and got[1].subjects == ["boats"] and got[2].places == [] and got[2].structured
    assert got[3].terms == [] and not got[3].structured and got[4].places == []


def test_diverse_take_is_bounded_and_without_repeats():
    rows = [(f"c{i}", f"boats at the lake {i}", "p", "t") for i in range(20)] + [("x", "fort walls", None, None), ("y", "", None, None)]
    got = recommend.diverse_take(rows, 5, {"c0"}, "boats")
    assert len(got) == len(set(got)) == 5 and "c0" not in got and "x" in got
    assert recommend.diverse_take([], 5, set(), "") == []


def test_keyword_rule_covers_every_subject():
    assert {s for s, _ in vocab.subject_keywords()} == set(vocab.SUBJECTS)


def test_feed_reaches_clips_behind_many_alike_ones(spark):
    n = 1300
    rows = [(f"a{i:04}", "boats lake", "p", "2020-01-01") for i in range(n)] + [(f"b{i}", f"boats lake {w} evening", "p", f"2020-02-0{i + 1}") for i, w in enumerate(("potters", "camels", "weavers"))]
    rows += [(f"c{i}", f"a much longer title about {w}", "q", None) for i, w in enumerate(("temples", "glaciers", "deserts", "orchards", "monsoons", "railways"))]
    df = spark.createDataFrame(rows, "id string, title string, place_id string, uploaded_at string")
    df = df.withColumn("text", F.lit("")).withColumn("subjects", F.array().cast("array<string>")).withColumn("home", F.lit(True))
    places = spark.createDataFrame([("p", "Pier", "S", "East"), ("q", "Quay", "S", "East")], "id string, name string, state string, region string")
    none, words = [], "array<string>"
    asks = spark.createDataFrame(
        [(k, "zzqq", "zzqq", none, none, none, ["East"], None, None, None) for k in (1, 2)],
        f"ask_id int, answer string, query string, places {words}, states {words}, subjects {words}, regions {words}, c_subjects {words}, c_words {words}, c_not {words}",
    )
    found = recommend.candidates(asks, index.build(df), df, places, search.protected_words(places), questions=2)
    order = sorted(rows, key=lambda r: (len(r[1]), r[0]))
    ranks = {r[0]: k + 1 for k, r in enumerate(order)}
    kept = found.collect()
    assert all(ranks[r.id] == r.ord for r in kept) and len(kept) == 2 * (11 + 3 + 6)
    pools = found.join(df.select("id", "title", "place_id", "uploaded_at"), "id").select(F.lit(1).alias("user_id"), F.col("ask_id").alias("at"), F.lit("zzqq").alias("query"), "ord", "id", "title", "place_id", "uploaded_at")
    got = {(r.at, r.slot): (r.id, r.more) for r in recommend.picks(pools).collect()}
    used = set()
    for at in (1, 2):
        want = recommend.diverse_take(order, 5, used, "zzqq")
        used.update(want)
        assert [got[at, slot] for slot in range(5)] == [(i, True) for i in want]
    assert any(i.startswith("c") for i in used)


def test_collisions_do_not_shorten_a_result(spark):
    rows = [(f"k{i:04}", "Kailash Kher", "") for i in range(900)] + [(f"m{i}", "A long walk around the holy mount Kailash in early winter", "") for i in range(5)]
    df = spark.createDataFrame(rows, "id string, title string, text string")
    asked = spark.createDataFrame([(1, "kailash")], "query_id int, query string")
    got = search.search(asked, index.build(df), df, 60).orderBy("rank").collect()
    assert [(r.rank, r.id) for r in got] == [(i + 1, f"m{i}") for i in range(5)]
