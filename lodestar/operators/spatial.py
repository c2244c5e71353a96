"""Points near other points or inside regions (problem 4).

A quadtree over longitude and latitude is grown on the driver from a bounded sample, so that its leaves hold about the
same number of points each; points are replicated over leaf borders by the search distance, every leaf is joined on its
own by a bulk-loaded R-tree, and candidates are refined by the exact great-circle distance. A pair is reported only by
the leaf that holds the location of its first member, so nothing is reported twice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.session import broadcast_if_small, cut

EARTH_M = 6_371_000.0
#: Sampled points on the driver, points that a leaf should hold, and the finest level (cells of about 10 m).
SAMPLE, LEAF, DEPTH = 200_000, 4_000, 22
#: Home points of a leaf beyond which it is probed in several tasks.
CHUNK = 20_000


class Quadtree:
    """Leaves of a quadtree over [-180, 180) x [-90, 90], as sorted Morton ranges at the finest level."""

    def __init__(self, lat: np.ndarray, lng: np.ndarray, per_leaf: float, depth: int = DEPTH):
        self.depth = depth
        codes = np.sort(self.morton(lat, lng))
        starts, stack = [], [(0, 0)]
        while stack:
            start, level = stack.pop()
            span = 1 << 2 * (depth - level)
            n = np.searchsorted(codes, start + span) - np.searchsorted(codes, start)
            if n > per_leaf and level < depth:
                stack += [(start + k * (span >> 2), level + 1) for k in range(3, -1, -1)]
            else:
                starts.append(start)
        self.starts = np.array(starts, dtype=np.int64)

    def grid(self, lat: np.ndarray, lng: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = 1 << self.depth
        x = np.clip(np.floor((lng + 180.0) / 360.0 * n), 0, n - 1).astype(np.int64)
        y = np.clip(np.floor((lat + 90.0) / 180.0 * n), 0, n - 1).astype(np.int64)
        return x, y

    def interleave(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int64)
        for b in range(self.depth):
            out |= ((x >> b) & 1) << (2 * b) | ((y >> b) & 1) << (2 * b + 1)
        return out

    def morton(self, lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
        return self.interleave(*self.grid(lat, lng))

    def leaf(self, lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, self.morton(lat, lng), side="right") - 1

    def boxes(self) -> np.ndarray:
        """(x0, y0, x1, y1) of each leaf on the finest grid, ends included."""
        ends = np.append(self.starts[1:], 1 << 2 * self.depth)
        side = np.sqrt((ends - self.starts).astype(np.float64)).round().astype(np.int64)
        x, y = np.zeros_like(self.starts), np.zeros_like(self.starts)
        for b in range(self.depth):
            x |= ((self.starts >> (2 * b)) & 1) << b
            y |= ((self.starts >> (2 * b + 1)) & 1) << b
        return np.stack([x, y, x + side - 1, y + side - 1], axis=1).astype(np.float64)


class RTree:
    """Sort-tile-recursive bulk-loaded R-tree over boxes; probes are answered for all queries of a level at once."""

    def __init__(self, boxes: np.ndarray, fan: int = 16):
        n = len(boxes)
        slices = max(1, math.ceil(math.sqrt(n / fan)))
        cx, cy = boxes[:, 0] + boxes[:, 2], boxes[:, 1] + boxes[:, 3]
        by_x = np.argsort(cx, kind="stable")
        band = np.empty(n, dtype=np.int64)
        band[by_x] = np.arange(n) * slices // max(n, 1)
        self.order = np.lexsort((cy, band))
        self.fan, self.levels = fan, [boxes[self.order]]
        while len(self.levels[-1]) > fan:
            below = self.levels[-1]
            at = np.arange(0, len(below), fan)
            self.levels.append(np.concatenate([np.minimum.reduceat(below[:, :2], at), np.maximum.reduceat(below[:, 2:], at)], axis=1))

    def probe(self, q: np.ndarray, most: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, entry) index arrays of overlapping boxes, in parts of bounded size."""
        step = 4096
        for lo in range(0, len(q), step):
            part = np.arange(lo, min(lo + step, len(q)))
            top = self.levels[-1]
            todo = [(len(self.levels) - 1, np.repeat(part, len(top)), np.tile(np.arange(len(top)), len(part)))]
            while todo:
                level, qi, node = todo.pop()
                b, w = self.levels[level][node], q[qi]
                hit = (b[:, 0] <= w[:, 2]) & (b[:, 2] >= w[:, 0]) & (b[:, 1] <= w[:, 3]) & (b[:, 3] >= w[:, 1])
                qi, node = qi[hit], node[hit]
                if not len(qi):
                    continue
                if level == 0:
                    yield qi, self.order[node]
                    continue
                kids = node[:, None] * self.fan + np.arange(self.fan)
                ok = kids < len(self.levels[level - 1])
                qi, node = np.repeat(qi, ok.sum(1)), kids[ok]
                for at in range(0, len(qi), most):
                    todo.append((level - 1, qi[at : at + most], node[at : at + most]))


def great_circle_m(lat1, lng1, lat2, lng2):  # noqa: ANN001, ANN201
    """Haversine distance in metres on the 6,371 km sphere; stable for small distances."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lng2 - lng1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(1.0, a)))


def reach(lat: np.ndarray, metres: float) -> tuple[float, np.ndarray]:
    """Half height and half width in degrees of a box that holds the circle around a point; 180 near a pole."""
    d = metres / EARTH_M * (1 + 1e-9) + 1e-12
    s = np.sin(d) / np.maximum(np.cos(np.radians(lat)), 1e-300)
    wide = np.where((np.abs(lat) + np.degrees(d) >= 90) | (s >= 1), 180.0, np.degrees(np.arcsin(np.clip(s, 0, 1))))
    return math.degrees(d), wide


def query_boxes(lat: np.ndarray, lng: np.ndarray, metres: float) -> tuple[np.ndarray, np.ndarray]:
    """Boxes (lng0, lat0, lng1, lat1) around points and the index of each box's point: two where the date line cuts one."""
    dy, dx = reach(lat, metres)
    i = np.arange(len(lat))
    box = np.stack([lng - dx, np.maximum(lat - dy, -90), lng + dx, np.minimum(lat + dy, 90)], axis=1)
    box[dx >= 180, 0], box[dx >= 180, 2] = -180, 180
    east, west = (dx < 180) & (box[:, 2] > 180), (dx < 180) & (box[:, 0] < -180)
    out = np.concatenate([box, box[east] - [360, 0, 360, 0], box[west] + [360, 0, 360, 0]])
    return out, np.concatenate([i, i[east], i[west]])


def usable(lat: Column, lng: Column) -> Column:
    """True for a location that is not null, NaN, out of range, or exactly 0, 0."""
    ok = (~F.isnan(lat)) & (~F.isnan(lng)) & lat.between(-90, 90) & lng.between(-180, 180) & ~((lat == 0) & (lng == 0))
    return F.coalesce(ok, F.lit(False))


def _sample(points: DataFrame, n_points: int, size: int) -> pd.DataFrame:
    """At most about `size` points, chosen by a hash of the location: the same points whichever task holds them."""
    if n_points > size:
        points = points.where(F.pmod(F.xxhash64("lat", "lng"), F.lit(1 << 30)) < int((1 << 30) * size / n_points))
    return points.select("lat", "lng").toPandas()


def near_locations(locations: DataFrame, metres: float, sample: int = SAMPLE, leaf: int = LEAF, chunk: int = CHUNK) -> DataFrame:
    """Pairs (loc_a, loc_b; loc_a < loc_b) of distinct usable locations (loc, lat, lng) within `metres`."""
    spark = locations.sparkSession
    locations = cut(locations.select("loc", "lat", "lng"))
    n = locations.count()
    seen = _sample(locations, n, sample)
    tree = Quadtree(seen.lat.to_numpy(), seen.lng.to_numpy(), max(1.0, leaf * len(seen) / max(n, 1)))
    boxes = RTree(tree.boxes())
    shared = spark.sparkContext.broadcast((tree, boxes))  # bounded by the sample, not by the data

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, leaves = shared.value
        for p in parts:
            lat, lng = p.lat.to_numpy(), p.lng.to_numpy()
            home = tree.leaf(lat, lng)
            yield pd.DataFrame({"leaf": home, "home": True, "loc": p["loc"], "lat": lat, "lng": lng})
            around, point = query_boxes(lat, lng, metres)
            x0, y0 = tree.grid(around[:, 1], around[:, 0])
            x1, y1 = tree.grid(around[:, 3], around[:, 2])
            for qi, at in leaves.probe(np.stack([x0, y0, x1, y1], axis=1).astype(np.float64)):
                i = point[qi]
                other = at != home[i]
                pairs = np.unique(np.stack([i[other], at[other]], axis=1), axis=0)
                i, at = pairs[:, 0], pairs[:, 1]
                yield pd.DataFrame({"leaf": at, "home": False, "loc": p["loc"].to_numpy()[i], "lat": lat[i], "lng": lng[i]})

    placed = locations.mapInPandas(place, "leaf long, home boolean, loc long, lat double, lng double").distinct()
    # a leaf of many points (a dense spot finer than the grid, or one that the sample missed) is probed in several tasks
    parts = cut(
        placed.where("home").groupBy("leaf").count().select("leaf", F.ceil(F.col("count") / chunk).cast("int").alias("parts")).where("parts > 1")
    )
    placed = placed.join(broadcast_if_small(parts, 24), "leaf", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    mine = F.pmod(F.xxhash64("loc"), F.col("parts")).cast("int")
    spread = placed.withColumn("mine", mine).select(
        "leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "home", "mine", "loc", "lat", "lng"
    )

    def join(g: pd.DataFrame) -> pd.DataFrame:
        lat, lng, loc = g.lat.to_numpy(), g.lng.to_numpy(), g["loc"].to_numpy()
        asks = np.flatnonzero(g.home.to_numpy() & (g.mine.to_numpy() == g.part.to_numpy()))
        around, point = query_boxes(lat[asks], lng[asks], metres)
        found = [np.empty((0, 2), dtype=np.int64)]
        if len(asks):
            for qi, e in RTree(np.stack([lng, lat, lng, lat], axis=1)).probe(around):
                a = asks[point[qi]]
                ok = loc[a] < loc[e]
                a, e = a[ok], e[ok]
                ok = great_circle_m(lat[a], lng[a], lat[e], lng[e]) <= metres
                found.append(np.stack([loc[a[ok]], loc[e[ok]]], axis=1))
        # a point on the date line can be met by both boxes of one circle
        return pd.DataFrame(np.unique(np.concatenate(found), axis=0), columns=["loc_a", "loc_b"])

    return spread.groupBy("leaf", "part").applyInPandas(join, "loc_a long, loc_b long")


def near_pairs(df: DataFrame, id_col: str, lat: str, lng: str, metres: float, **tuning: int) -> DataFrame:
    """(id_a, id_b; id_a < id_b) of different ids at most `metres` apart along a great circle, each pair once.

    Rows without an id or a usable location (null, NaN, out of range, exactly 0, 0) never count; repeated rows count
    once; an id with several locations is near if any of them is; ids at the same spot are near. Points that share a
    location are joined as one and expanded at the end, so no task meets a spot's copies squared before the result does.
    An empty table gives an empty result; other columns are ignored.
    """
    a, o = F.col(lat).cast("double"), F.col(lng).cast("double")
    points = cut(
        df.select(F.col(id_col).alias("id"), (a + 0.0).alias("lat"), (o + 0.0).alias("lng"))
        .where(F.col("id").isNotNull() & usable(F.col("lat"), F.col("lng")))
        .distinct()
    )
    where = cut(points.select("lat", "lng").distinct().withColumn("loc", F.monotonically_increasing_id()))
    pairs = near_locations(where, metres, **tuning)
    at = cut(points.join(where, ["lat", "lng"]).select("id", "loc"))
    left = at.select(F.col("id").alias("x"), F.col("loc").alias("loc_a"))
    right = at.select(F.col("id").alias("y"), F.col("loc").alias("loc_b"))
    apart = pairs.join(left, "loc_a").join(right, "loc_b").select("x", "y")
    same = left.join(right, F.col("loc_a") == F.col("loc_b")).where("x < y").select("x", "y")
    return (
        apart.where("x <> y").unionByName(same).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
    )


def _spans(regions: DataFrame) -> DataFrame:
    """(region_id, w, s, e, n) boxes; two for one that crosses the date line (lng0 > lng1)."""
    west, east = F.col("lng0"), F.col("lng1")
    one = F.array(F.struct(west.alias("w"), east.alias("e")))
    two = F.array(F.struct(west.alias("w"), F.lit(180.0).alias("e")), F.struct(F.lit(-180.0).alias("w"), east.alias("e")))
    whole = regions.where("region_id is not null and lat0 <= lat1 and lng0 is not null and lng1 is not null")
    return whole.select("region_id", F.col("lat0").alias("s"), F.col("lat1").alias("n"), F.explode(F.when(west <= east, one).otherwise(two)).alias("x")).select("region_id", "x.w", "s", "x.e", "n")


def in_region(points: DataFrame, regions: DataFrame, sample: int = SAMPLE, leaf: int = LEAF, chunk: int = CHUNK) -> DataFrame:
    """(id, region_id): the boxes (region_id, lat0, lng0, lat1, lng1) that hold each usable point (id, lat, lng).

    The same quadtree as for near points: a box is replicated to the leaves that it touches, each leaf's boxes form an
    R-tree that its points probe, and the comparison with the borders is exact. A point lies in one leaf only, so nothing
    is reported twice. A leaf of many points is probed in several tasks. Repeated rows count once; rows without an id or a
    usable location, and boxes without borders, never count; empty tables give an empty result.
    """
    spark = points.sparkSession
    points = cut(points.select("id", F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng")).where(F.col("id").isNotNull() & usable(F.col("lat"), F.col("lng"))).distinct())
    n = points.count()
    seen = _sample(points, n, sample)
    tree = Quadtree(seen.lat.to_numpy(), seen.lng.to_numpy(), max(1.0, leaf * len(seen) / max(n, 1)))
    shared = spark.sparkContext.broadcast((tree, RTree(tree.boxes())))  # bounded by the sample, not by the data
    of_point, of_region = (d.schema[c].dataType.simpleString() for d, c in ((points, "id"), (regions, "region_id")))

    def homes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, _ = shared.value
        for p in parts:
            yield pd.DataFrame({"leaf": tree.leaf(p.lat.to_numpy(), p.lng.to_numpy()), "id": p["id"], "lat": p.lat, "lng": p.lng})

    def touched(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, leaves = shared.value
        for p in parts:
            x0, y0 = tree.grid(p.s.to_numpy(), p.w.to_numpy())
            x1, y1 = tree.grid(p.n.to_numpy(), p.e.to_numpy())
            for box, at in leaves.probe(np.stack([x0, y0, x1, y1], axis=1).astype(np.float64)):
                own = p.iloc[box]
                yield pd.DataFrame({"leaf": at, "region_id": own.region_id.to_numpy(), **{k: own[k].to_numpy() for k in "wsen"}})

    placed = points.mapInPandas(homes, f"leaf long, id {of_point}, lat double, lng double")
    boxes = _spans(regions).mapInPandas(touched, f"leaf long, region_id {of_region}, w double, s double, e double, n double")
    parts = placed.groupBy("leaf").count().select("leaf", F.ceil(F.col("count") / chunk).cast("int").alias("parts")).where("parts > 1")
    parts = broadcast_if_small(cut(parts), 24)
    placed = placed.join(parts, "leaf", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    boxes = boxes.join(parts, "leaf", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")

    def join(own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        lat, lng = own.lat.to_numpy(), own.lng.to_numpy()
        found = [pd.DataFrame({"id": own["id"].iloc[:0], "region_id": held.region_id.iloc[:0]})]
        if len(own) and len(held):
            for i, k in RTree(held[list("wsen")].to_numpy()).probe(np.stack([lng, lat, lng, lat], axis=1)):
                found.append(pd.DataFrame({"id": own["id"].to_numpy()[i], "region_id": held.region_id.to_numpy()[k]}))
        return pd.concat(found).drop_duplicates()

    return placed.groupBy("leaf", "part").cogroup(boxes.groupBy("leaf", "part")).applyInPandas(join, f"id {of_point}, region_id {of_region}")
