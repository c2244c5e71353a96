from pyspark.sql import functions as F

from lodestar.operators import dedupe

IDS = "log_id long, video_id string, fetched_at int, extra string"


def test_ids_are_found_inside_dirty_fields(spark):
    rows = [("abcDEF123_-",), (" abcDEF123_-\t",), ("﻿abcDEF123_-",), ('"abcDEF123_-"',), ("abcdef123_-",), ("abcDEF123_-x",), ("  ",), ("​",), (None,)]
    got = [r.i for r in spark.createDataFrame(rows, "v string").select(dedupe.clean_id(F.col("v")).alias("i")).collect()]
    assert got == ["abcDEF123_-"] * 4 + ["abcdef123_-", "abcDEF123_-x", None, None, None]


def test_one_row_of_each_id_stays_and_null_ids_all_stay(spark):
    rows = [(5, "a", 1, "x"), (3, "a", 2, "y"), (9, "b", 1, "z"), (1, None, 1, "n"), (2, None, 1, "n"), (4, "", 1, "e")]
    df = spark.createDataFrame(rows, IDS)
    key = dedupe.clean_id(F.col("video_id"))
    assert sorted(r.log_id for r in dedupe.dropped(df, key, "log_id").collect()) == [5]
    assert sorted(r.log_id for r in dedupe.keep_one(df, key, "log_id").collect()) == [1, 2, 3, 4, 9]
    by_time = dedupe.keep_one(df, key, "log_id", [F.col("fetched_at")])
    assert sorted(r.log_id for r in by_time.collect()) == [1, 2, 4, 5, 9]
    assert by_time.columns == df.columns


def test_ties_hot_ids_and_empty_tables(spark):
    hot = spark.range(3000).select(F.col("id").alias("log_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("video_id"), F.lit(1).alias("fetched_at"))
    kept = dedupe.keep_one(hot, dedupe.clean_id(F.col("video_id")), "log_id", [F.col("fetched_at")])
    assert kept.count() == 2001 and kept.where("video_id = 'hot'").first().log_id == 0
    empty = spark.createDataFrame([], IDS)
    assert dedupe.keep_one(empty, dedupe.clean_id(F.col("video_id")), "log_id").count() == 0
    assert dedupe.dropped(empty, dedupe.clean_id(F.col("video_id")), "log_id").count() == 0


def test_the_choice_stays_a_hash_aggregation_and_orders_like_a_struct(spark):
    rows = [(5, "a", None, "x"), (3, "a", 2, "y"), (9, "b", -7, "z"), (8, "b", 4, "n"), (-2, "c", 1, "n"), (-1, "c", 1, "e"), (7, "d", None, "e"), (6, "d", None, "e")]
    df = spark.createDataFrame(rows, IDS).withColumn("time", F.timestamp_micros(F.col("fetched_at")).cast("timestamp_ntz"))
    for order in (None, [F.col("fetched_at")], [F.col("time")]):
        stay = dedupe.keepers(df, F.col("video_id"), "log_id", order)
        plan = stay._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan
        assert sorted(r.log_id for r in stay.collect()) == ([-2, 3, 5 + 1, 8] if order is None else [-2, 3, 6, 9])


def test_row_ids_of_other_types_and_orders(spark):
    df = spark.createDataFrame([("r2", "a", "2"), ("r1", "a", "1"), ("r3", None, "0")], "row string, id string, t string")
    assert [r.row for r in dedupe.keepers(df, F.col("id"), "row").collect()] == ["r1"]
    assert [r.row for r in dedupe.keepers(df, F.col("id"), "row", [F.col("t")]).collect()] == ["r1"]
