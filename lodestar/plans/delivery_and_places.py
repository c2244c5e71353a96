"""Queries p4 and p5: nearby places, and messages delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import dedupe, spatial
from lodestar.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different places at most 250 m apart."""
    pairs = spatial.near_pairs(table(spark, sf_dir, "places"), "place_id", "lat", "lng", 250.0)
    return pairs.select(F.col("id_a").alias("place_id_a"), F.col("id_b").alias("place_id_b"))


def p4_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of one degree around each gazetteer entry that holds each usable place."""
    places = table(spark, sf_dir, "places").select(F.col("place_id").alias("id"), "lat", "lng").where("id is not null").distinct()
    around = table(spark, sf_dir, "gazetteer").select(
        F.col("place_key").alias("region_id"),
        *[(F.col("lat") + d).alias(f"lat{i}") for i, d in enumerate((-0.5, 0.5))],
        *[(F.col("lng") + d).alias(f"lng{i}") for i, d in enumerate((-0.5, 0.5))],
    )
    return spatial.in_region(places, around).select(F.col("id").alias("place_id"), F.col("region_id").alias("place_key"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the crawl log to drop, so that each video keeps its smallest log_id: the log is numbered as it was delivered."""
    return dedupe.dropped(table(spark, sf_dir, "youtube_items"), dedupe.clean_id(F.col("video_id")), "log_id")


def p5_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawl log with one row of each video: the first fetched, then the smallest log_id (null times come last)."""
    items = table(spark, sf_dir, "youtube_items")
    kept = dedupe.keep_one(items, dedupe.clean_id(F.col("video_id")), "log_id", [F.col("fetched_at")])
    return kept.select("log_id", "video_id", "title", "playlist_title", "channel_title")


_VIDEO = r"""CASE WHEN regexp_matches(video_id, '(^|[^A-Za-z0-9_-])[A-Za-z0-9_-]{11}($|[^A-Za-z0-9_-])')
  THEN regexp_extract(video_id, '(^|[^A-Za-z0-9_-])([A-Za-z0-9_-]{11})($|[^A-Za-z0-9_-])', 2)
  ELSE nullif(trim(video_id), '') END"""

_SPOTS = "SELECT DISTINCT place_id, lat, lng FROM places WHERE place_id IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lng) AND lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 AND NOT (lat = 0 AND lng = 0)"

QUERIES = {"p4_found": p4_found, "p4_regions": p4_regions, "p5_found": p5_found, "p5_kept": p5_kept}
SQL = {
    "p4_found": f"""WITH s AS ({_SPOTS})
SELECT DISTINCT a.place_id AS place_id_a, b.place_id AS place_id_b FROM s a JOIN s b ON a.place_id < b.place_id
WHERE 2 * 6371000 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2)
  + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))) <= 250""",
    "p4_regions": f"""WITH s AS ({_SPOTS})
SELECT DISTINCT s.place_id, g.place_key FROM s JOIN gazetteer g
  ON s.lat BETWEEN g.lat - 0.5 AND g.lat + 0.5 AND s.lng BETWEEN g.lng - 0.5 AND g.lng + 0.5""",
    "p5_found": f"""WITH v AS (SELECT log_id, {_VIDEO} AS id FROM youtube_items)
SELECT log_id FROM v WHERE id IS NOT NULL AND log_id <> (SELECT min(w.log_id) FROM v w WHERE w.id = v.id)""",
    "p5_kept": f"""WITH v AS (SELECT *, {_VIDEO} AS id FROM youtube_items)
SELECT log_id, video_id, title, playlist_title, channel_title FROM v
QUALIFY id IS NULL OR row_number() OVER (PARTITION BY id ORDER BY fetched_at NULLS LAST, log_id) = 1""",
}
