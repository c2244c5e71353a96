import itertools

import numpy as np

from lodestar.operators import spatial

PLACES = "place_id string, lat double, lng double, loc string"


def brute(rows, metres):
    good = {(i, a, o) for i, a, o, *_ in rows if i is not None and a is not None and o is not None and -90 <= a <= 90 and -180 <= o <= 180 and not (a == 0 and o == 0)}
    return {(min(x[0], y[0]), max(x[0], y[0])) for x, y in itertools.combinations(sorted(good), 2) if x[0] != y[0] and spatial.great_circle_m(x[1], x[2], y[1], y[2]) <= metres}


def pairs(spark, rows, metres, **tuning):
    df = spark.createDataFrame([(*r, "x") for r in rows], PLACES)
    got = [(r.id_a, r.id_b) for r in spatial.near_pairs(df, "place_id", "lat", "lng", metres, **tuning).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_pairs_match_brute_force_with_small_leaves_and_chunks(spark):
    rng = np.random.default_rng(1)
    lat = np.concatenate([rng.uniform(-80, 80, 150), 20 + rng.normal(0, 0.004, 250)])
    lng = np.concatenate([rng.uniform(-180, 180, 150), 75 + rng.normal(0, 0.004, 250)])
    rows = [(f"p{i}", float(a), float(o)) for i, (a, o) in enumerate(zip(lat, lng))]
    want = brute(rows, 250)
    assert len(want) > 100
    assert pairs(spark, rows, 250, leaf=20, chunk=15) == want


def test_poles_date_line_bad_rows_and_copies(spark):
    rows = [
        ("a", 89.9999, 10.0), ("b", 89.9999, -170.0), ("c", 10.0, 179.9995), ("d", 10.0, -179.9995), ("e", 10.0, 180.0), ("f", 0.0, 0.0), ("g", 0.0, 0.0005), ("h", 0.0005, 0.0),
        ("i", None, 1.0), ("j", float("nan"), 1.0), ("k", 91.0, 1.0), ("l", 5.0, 5.0), ("m", 5.0, 5.0), ("l", 5.0, 5.0), (None, 5.0, 5.0), ("n", 5.0, 181.0), ("o", -90.0, 0.0), ("p", -90.0, 90.0),
    ]
    got = pairs(spark, rows, 250)
    assert got == {("a", "b"), ("c", "d"), ("c", "e"), ("d", "e"), ("g", "h"), ("l", "m"), ("o", "p")}


def test_no_rows_no_pairs_and_regions(spark):
    assert pairs(spark, [], 250) == set()
    points = spark.createDataFrame([("a", 10.2, 179.9), ("b", 10.2, -179.9), ("c", 12.0, 0.0), ("d", None, 1.0)], "id string, lat double, lng double")
    boxes = spark.createDataFrame([("r", 9.0, 11.0, 179.0, -179.0), ("s", 11.5, 12.0, -1.0, 0.0)], "region_id string, lat0 double, lat1 double, lng0 double, lng1 double")
    assert {tuple(r) for r in spatial.in_region(points, boxes).collect()} == {("a", "r"), ("b", "r"), ("c", "s")}


def test_regions_match_brute_force_over_dense_leaves_and_the_date_line(spark):
    import random

    from lodestar.operators import spatial

    rng = random.Random(6)
    points = [(f"p{i}", rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(300)] + [(f"h{i}", 10 + i * 1e-7, 20.0) for i in range(200)]
    points += [("none", None, 1.0), ("nan", float("nan"), 1.0), ("zero", 0.0, 0.0), (None, 5.0, 5.0), ("edge", 12.0, 22.0), ("east", 1.0, 180.0), ("p0", *points[0][1:])]
    boxes = [(i, a, b, a + rng.uniform(0, 40), min(180.0, b + rng.uniform(0, 60))) for i in range(60) for a, b in [(rng.uniform(-90, 60), rng.uniform(-180, 170))]]
    boxes += [(100, 8.0, 18.0, 12.0, 22.0), (101, -20.0, 170.0, 20.0, -170.0), (102, 5.0, 1.0, 4.0, 2.0), (103, None, 1.0, 4.0, 2.0)]
    ok = [(i, a, b) for i, a, b in set(points) if i and a is not None and a == a and (a, b) != (0, 0)]
    inside = lambda b, w, e: w <= b <= e if w <= e else b >= w or b <= e
    want = {(i, r) for i, a, b in ok for r, s, w, n, e in boxes if s is not None and s <= a <= n and inside(b, w, e)}
    p = spark.createDataFrame(points, "id string, lat double, lng double")
    r = spark.createDataFrame(boxes, "region_id int, lat0 double, lng0 double, lat1 double, lng1 double")
    got = [tuple(x) for x in spatial.in_region(p, r, leaf=20, chunk=15).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert spatial.in_region(p.limit(0), r).count() == 0 and spatial.in_region(p, r.limit(0)).count() == 0
