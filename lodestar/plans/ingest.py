"""Queries of the batch pipeline from the crawl log to clips and places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.functions import vocab
from lodestar.operators import archive, dedupe, etl
from lodestar.plans.delivery_and_places import _VIDEO
from lodestar.plans.text_search import _ARCH, _clips
from lodestar.session import cut, table



def _video():  # noqa: ANN202
    return dedupe.clean_id(F.col("video_id"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every log row as an item; its log_id is the id."""
    log = table(spark, sf_dir, "youtube_items")
    return log.select(F.col("log_id").alias("id"), "title", "description", F.col("playlist_title").alias("playlist"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.place_names(table(spark, sf_dir, "gazetteer"), table(spark, sf_dir, "place_aliases"))


def _keywords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(vocab.subject_keywords(), "subject string, keyword string")


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = etl.with_zones(_items(spark, sf_dir))
    return z.select("id", "prose", F.array_join("hashtags", " ").alias("hashtags"), "tail")


def _zoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's zones, written once, as tags and texts read them apart."""
    return cut(etl.with_zones(_items(spark, sf_dir)).drop("description", "tail"))


def place_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = etl.place_candidates(_zoned(spark, sf_dir), _names(spark, sf_dir))
    return found.select("id", "source", "place_key", "locative", "origin").distinct()


def best_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.best_place(etl.place_candidates(_zoned(spark, sf_dir), _names(spark, sf_dir)))


def subject_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.subject_scores(_zoned(spark, sf_dir), _keywords(spark))


def subject_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = etl.subject_tags(subject_scores(spark, sf_dir))
    return tags.select("id", F.array_join("subjects", ", ").alias("subjects"))


def extract_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = etl.with_zones(_items(spark, sf_dir))
    return z.select("id", etl.year_of(F.col("title"), F.col("prose")).alias("year")).where("year is not null")


def reject_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("id", etl.rejected_by(F.col("title")).alias("rule")).where("rule is not null")


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = etl.fresh_items(table(spark, sf_dir, "youtube_items"), _video(), table(spark, sf_dir, "tombstones"))
    return etl.classified(items, table(spark, sf_dir, "gazetteer"), table(spark, sf_dir, "place_aliases"), _keywords(spark))


def ingest_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship batch: the log's first rows, zoned, placed, tagged, dated and admitted."""
    made = etl.admitted(_all(spark, sf_dir))
    return made.select("id", "title", "text", "place_id", F.array_join("subjects", ", ").alias("subjects"), "year", "uploaded_at")


def ingest_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.diagnostics(_all(spark, sf_dir))


def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.report(table(spark, sf_dir, "youtube_items"), _video(), _all(spark, sf_dir), table(spark, sf_dir, "tombstones"))


def used_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = etl.used_places(etl.admitted(_all(spark, sf_dir)), table(spark, sf_dir, "gazetteer"))
    return used.select("place_key", "country", "kind")


def tombstone_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = etl.fresh_items(table(spark, sf_dir, "youtube_items"), _video(), table(spark, sf_dir, "tombstones"))
    return items.select("id", "log_id")


def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive's clips, without the dead, overlaid with the log's fresh titles."""
    dead = table(spark, sf_dir, "tombstones").select(F.col("video_id").alias("id"))
    fresh = etl.fresh_items(table(spark, sf_dir, "youtube_items"), _video(), table(spark, sf_dir, "tombstones")).select("id", "title", "uploaded_at")
    return etl.merge(_clips(spark, sf_dir).select("id", "title", "uploaded_at"), fresh, dead)


def roundrobin_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.round_robin(_clips(spark, sf_dir), 200)


def known_video_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.known_ids(table(spark, sf_dir, "youtube_items"), _video())


def incremental_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New ids of the listing, newest first, until 100 ids of the archive have passed in a row."""
    log = table(spark, sf_dir, "youtube_items").select((-F.col("log_id")).alias("at"), _video().alias("id")).where("id is not null")
    return etl.until_known_run(log, _clips(spark, sf_dir), 100)


def backfill_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = etl.known_ids(table(spark, sf_dir, "youtube_items"), _video())
    return etl.backfill_batches(asked, _clips(spark, sf_dir))


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips that the log does not hold are gone; tombstones that it holds live again."""
    alive = etl.known_ids(table(spark, sf_dir, "youtube_items"), _video())
    return etl.reconcile(_clips(spark, sf_dir), alive, table(spark, sf_dir, "tombstones").select(F.col("video_id").alias("id")))


def pending_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "playlist_resolved")
    return etl.pending_playlists(lists, lists.where("place_id is not null"))


def gazetteer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gazetteer's states and cities overlaid with the published places as a world list."""
    cols = ["name", "district", "state", "country", "region", "terrain", "lat", "lng"]
    g = table(spark, sf_dir, "gazetteer").withColumnsRenamed({"place_name": "name", "state_name": "state"})
    world = archive.places_of(table(spark, sf_dir, "places")).select(*cols)
    made = etl.gazetteer_of(g.where("kind = 'state'").select(*cols), g.where("kind = 'city'").select(*cols), world)
    return made.select("place_key", "kind", "name", "district", "terrain", F.round("lat", 6).alias("lat"))


def export_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the log's fields, read as a spreadsheet export (the id column, else a link in the description), that the
    archive does not hold."""
    rows = table(spark, sf_dir, "youtube_items").select(F.col("log_id").alias("n"), F.col("video_id").alias("id"), F.col("description").alias("link"), "title")
    return etl.export_ids(rows, _clips(spark, sf_dir))["missing"].select("id", "n")


def export_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "youtube_items").select(F.col("log_id").alias("n"), F.col("video_id").alias("id"), F.col("description").alias("link"), "title")
    return etl.export_ids(rows, _clips(spark, sf_dir))["counts"]


_TRIM = r"[\s\v\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}\x{001C}-\x{001F}]+"
_ZONES = rf"""ln AS (SELECT log_id AS id, i, regexp_replace(line, '^{_TRIM}|{_TRIM}$', '', 'g') AS line FROM (
  SELECT log_id, unnest(string_split(coalesce(description, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(description, ''), chr(10)), 1) AS i FROM youtube_items)),
tg AS (SELECT *, regexp_extract_all(line, '#[\p{{L}}\p{{N}}_]+') AS tags FROM ln WHERE line <> ''),
mk AS (SELECT *, len(tags) > 0 AND length(array_to_string(tags, '')) > length(line) * 0.5 AS is_tag FROM tg),
fs AS (SELECT id, min(i) FILTER (is_tag) AS f FROM mk GROUP BY 1),
zn AS (SELECT y.log_id AS id, y.title, y.playlist_title AS playlist,
  coalesce(string_agg(line, ' ' ORDER BY i) FILTER (NOT is_tag AND (f IS NULL OR i < f)), '') AS prose,
  coalesce(list_transform(flatten(list(tags ORDER BY i) FILTER (is_tag)), lambda t: lower(t[2:])), []) AS hashtags,
  coalesce(string_agg(line, ' ' ORDER BY i) FILTER (NOT is_tag AND i > f), '') AS tail
  FROM youtube_items y LEFT JOIN mk ON mk.id = y.log_id LEFT JOIN fs ON fs.id = y.log_id GROUP BY 1, 2, 3)"""
# sentences end at . ! ? and white space; RE2 has no look-behind, so the break is marked first
_SENT = r"array_to_string(string_split(regexp_replace(prose, '([.!?])[ \t\n\f\r\v]+', '\1' || chr(1), 'g'), chr(1))[1:2], ' ')"
_CAND = f"""nm AS (SELECT alias AS name, a.place_key, kind, '0' || alias AS seq FROM place_aliases a JOIN gazetteer g ON g.place_key = a.place_key
  UNION ALL SELECT place_key, place_key, kind, '1' || place_key FROM gazetteer),
src AS (SELECT id, 'playlist' AS source, lower(coalesce(playlist, '')) AS t FROM zn UNION ALL SELECT id, 'title', lower(coalesce(title, '')) FROM zn
  UNION ALL SELECT id, 'prose', lower({_SENT}) FROM zn),
us AS (SELECT DISTINCT t FROM src),
mt AS (SELECT t, name, place_key, kind, seq, string_split_regex(t, '\\b' || name || '\\b')[1] AS pre FROM us JOIN nm ON contains(t, name) AND regexp_matches(t, '\\b' || name || '\\b')),
cx AS (SELECT *, string_split_regex(trim(regexp_replace(right(pre, 24), '[^a-z\\s]', ' ', 'g')), '\\s+')[-1] AS last FROM mt),
hs AS (SELECT id, unnest(hashtags) AS tag, generate_subscripts(hashtags, 1) - 1 AS ix FROM zn),
hn AS (SELECT name, arg_min(place_key, seq) AS place_key, arg_min(kind, seq) AS kind FROM nm GROUP BY 1),
cand AS (SELECT id, source, place_key, kind, coalesce(last IN ({tx.sql_list(vocab.LOCATIVE)}), false) AS locative, coalesce(last IN ({tx.sql_list(vocab.ORIGIN)}), false) AS origin, seq
  FROM src JOIN cx ON cx.t = src.t
  UNION ALL SELECT id, 'hashtag', place_key, kind, false, false, printf('%09d', min(ix)) FROM hs JOIN hn ON hn.name = hs.tag GROUP BY 1, 3, 4)"""
_BEST = """bp AS (SELECT id, place_key, source FROM cand QUALIFY row_number() OVER (PARTITION BY id ORDER BY CASE WHEN locative THEN 0 WHEN origin THEN 2 ELSE 1 END,
  CASE WHEN kind = 'city' THEN 0 ELSE 1 END, CASE source WHEN 'playlist' THEN 0 WHEN 'hashtag' THEN 1 WHEN 'title' THEN 2 ELSE 3 END, seq, place_key) = 1)"""
_KW = ", ".join(f"('{s}', '{k}')" for s, k in vocab.subject_keywords())
_SUBJ = f"""kw AS (SELECT * FROM (VALUES {_KW}) v(subject, keyword)),
ut AS (SELECT DISTINCT lower(coalesce(title, '')) AS t FROM zn UNION SELECT DISTINCT lower(prose) FROM zn),
ct AS (SELECT t, subject, keyword, len(regexp_extract_all(t, '\\b' || keyword || '\\b')) AS n FROM ut, kw WHERE contains(t, keyword)),
sp AS (SELECT id, subject, 3 * n AS s FROM zn JOIN ct ON ct.t = lower(coalesce(title, '')) UNION ALL SELECT id, subject, 2 * least(n, 3) FROM zn JOIN ct ON ct.t = lower(prose)
  UNION ALL SELECT id, subject, 3 FROM (SELECT id, unnest(hashtags) AS tag FROM zn), kw WHERE contains(tag, replace(keyword, ' ', ''))),
ss AS (SELECT id, subject, sum(s)::BIGINT AS score FROM sp GROUP BY 1, 2 HAVING sum(s) > 0),
st AS (SELECT id, list(subject ORDER BY score DESC, list_position([{tx.sql_list(vocab.SUBJECTS)}], subject))[1:3] AS subjects FROM ss WHERE score >= 4 GROUP BY 1)"""
_YEAR = r"TRY_CAST(nullif(regexp_extract(coalesce(title, '') || ' ' || prose, '\b(19[3-9]\d|20[0-2]\d)\b', 1), '') AS INTEGER)"
_REJ = r"CASE WHEN regexp_matches(title, '(?i)^\s*(?:private|deleted) video\s*$') THEN 'unavailable video' END"
_FRESH = f"""lg AS (SELECT *, {_VIDEO} AS vid FROM youtube_items WHERE title <> ''),
fr AS (SELECT vid, min(log_id) AS log_id FROM lg WHERE vid IS NOT NULL GROUP BY 1),
al AS (SELECT fr.vid, fr.log_id FROM fr WHERE vid NOT IN (SELECT video_id FROM tombstones WHERE video_id IS NOT NULL))"""
_ALL = f"""{_ZONES}, {_CAND}, {_BEST}, {_SUBJ}, {_FRESH},
ac AS (SELECT al.vid AS id, y.title, prose, {_REJ.replace('title', 'y.title')} AS rejected, CASE WHEN rejected IS NULL THEN bp.place_key END AS place_id,
  CASE WHEN rejected IS NULL THEN coalesce(st.subjects, []) ELSE [] END AS subjects, {_YEAR.replace('title', 'y.title').replace('prose', 'zn.prose')} AS year, y.published_at AS uploaded_at
  FROM al JOIN youtube_items y ON y.log_id = al.log_id JOIN zn ON zn.id = al.log_id LEFT JOIN bp ON bp.id = al.log_id LEFT JOIN st ON st.id = al.log_id)"""

_EXPORT = r"""x AS (SELECT log_id AS n, coalesce(CASE WHEN regexp_full_match(video_id, '[A-Za-z0-9_-]{11}') THEN video_id END,
  nullif(regexp_extract(description, '(?:v=|youtu\.be/|/shorts/|/video/)([A-Za-z0-9_-]{11})(?:[^A-Za-z0-9_-]|$)', 1), '')) AS id FROM youtube_items)"""

QUERIES = {
    f.__name__: f
    for f in (
        zones, place_candidates, best_place, subject_scores, subject_tags, extract_year, reject_rules, ingest_clips, ingest_diagnostics, ingest_report,
        used_places, tombstone_antijoin, merge_upsert, roundrobin_slice, known_video_ids, incremental_sync, backfill_batches, reconcile, pending_playlists, gazetteer_merge, export_missing, export_counts,
    )
}
SQL = {
    "zones": f"WITH {_ZONES} SELECT id, prose, array_to_string(hashtags, ' ') AS hashtags, tail FROM zn",
    "place_candidates": f"WITH {_ZONES}, {_CAND} SELECT DISTINCT id, source, place_key, locative, origin FROM cand",
    "best_place": f"WITH {_ZONES}, {_CAND}, {_BEST} SELECT id, place_key, source FROM bp",
    "subject_scores": f"WITH {_ZONES}, {_SUBJ} SELECT id, subject, score FROM ss",
    "subject_tags": f"WITH {_ZONES}, {_SUBJ} SELECT id, array_to_string(subjects, ', ') AS subjects FROM st",
    "extract_year": f"WITH {_ZONES} SELECT id, {_YEAR} AS year FROM zn WHERE year IS NOT NULL",
    "reject_rules": f"SELECT log_id AS id, {_REJ} AS rule FROM youtube_items WHERE rule IS NOT NULL",
    "ingest_clips": f"""WITH {_ALL} SELECT id, title, left(prose, 800) AS text, place_id, array_to_string(subjects, ', ') AS subjects, year, uploaded_at FROM ac
WHERE rejected IS NULL AND (place_id IS NOT NULL OR len(subjects) > 0)""",
    "ingest_diagnostics": f"""WITH {_ALL} SELECT id, title, rejected AS why FROM ac WHERE rejected IS NOT NULL UNION ALL SELECT id, title, 'no place' FROM ac WHERE rejected IS NULL AND place_id IS NULL
UNION ALL SELECT id, title, 'no subject' FROM ac WHERE rejected IS NULL AND len(subjects) = 0""",
    "ingest_report": f"""WITH {_ALL} SELECT (SELECT count(*) FROM lg WHERE vid IS NOT NULL) AS log_rows, (SELECT count(*) FROM fr) AS ids, (SELECT count(*) FROM lg WHERE vid IS NOT NULL) - (SELECT count(*) FROM fr) AS duplicates,
(SELECT count(*) FROM fr WHERE vid IN (SELECT video_id FROM tombstones)) AS departed, count(*) FILTER (rejected IS NOT NULL) AS rejected,
count(*) FILTER (ac.rejected IS NULL AND place_id IS NULL) AS no_place, count(*) FILTER (ac.rejected IS NULL AND len(subjects) = 0) AS no_subject,
count(*) FILTER (ac.rejected IS NULL AND (place_id IS NOT NULL OR len(subjects) > 0)) AS matched FROM ac""",
    "used_places": f"""WITH {_ALL} SELECT place_key, coalesce(country, 'India') AS country, kind FROM gazetteer WHERE place_key IN (SELECT place_id FROM ac WHERE rejected IS NULL)""",
    "tombstone_antijoin": f"WITH {_FRESH} SELECT vid AS id, log_id FROM al",
    "merge_upsert": f"""WITH {_ARCH}, {_FRESH}, b AS (SELECT id, title, uploaded_at FROM arch WHERE id NOT IN (SELECT video_id FROM tombstones WHERE video_id IS NOT NULL)),
f AS (SELECT al.vid AS id, y.title, y.published_at AS uploaded_at FROM al JOIN youtube_items y ON y.log_id = al.log_id)
SELECT coalesce(f.id, b.id) AS id, CASE WHEN f.id IS NULL THEN b.title ELSE f.title END AS title, CASE WHEN f.id IS NULL THEN b.uploaded_at ELSE f.uploaded_at END AS uploaded_at,
CASE WHEN f.id IS NULL THEN 'kept' WHEN b.id IS NULL THEN 'new' ELSE 'replaced' END AS state FROM f FULL JOIN b ON f.id = b.id""",
    "roundrobin_slice": f"""WITH {_ARCH}, r AS (SELECT id, place_id, left(text, 300) AS text, row_number() OVER (PARTITION BY place_id ORDER BY id)::INTEGER AS round FROM arch
  WHERE place_id IS NOT NULL AND len(subjects) > 0 AND length(text) > 120),
f AS (SELECT *, min(id) OVER (PARTITION BY place_id) AS first FROM r) SELECT id, place_id, round, text FROM f ORDER BY round, first, id LIMIT 200""",
    "known_video_ids": f"SELECT DISTINCT {_VIDEO} AS id FROM youtube_items WHERE id IS NOT NULL",
    "incremental_sync": f"""WITH {_ARCH}, p AS (SELECT -log_id AS at_, {_VIDEO} AS id FROM youtube_items), s AS (SELECT at_, p.id, p.id IN (SELECT id FROM arch) AS seen FROM p WHERE p.id IS NOT NULL),
i AS (SELECT *, sum(CASE WHEN seen THEN 0 ELSE 1 END) OVER (ORDER BY at_) AS island FROM s), l AS (SELECT *, sum(CASE WHEN seen THEN 1 ELSE 0 END) OVER (PARTITION BY island ORDER BY at_) AS n FROM i)
SELECT at_ AS at, id FROM l WHERE NOT seen AND at_ <= coalesce((SELECT min(at_) FROM l WHERE n >= 100), at_)""",
    "backfill_batches": f"""WITH {_ARCH}, t AS (SELECT DISTINCT {_VIDEO} AS id FROM youtube_items), u AS (SELECT id FROM t WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM arch))
SELECT ceil(row_number() OVER (ORDER BY id) / 50)::BIGINT AS batch, id FROM u""",
    "reconcile": f"""WITH {_ARCH}, a AS (SELECT DISTINCT {_VIDEO} AS id FROM youtube_items) SELECT id, 'dead' AS state FROM arch WHERE id NOT IN (SELECT id FROM a WHERE id IS NOT NULL)
UNION ALL SELECT DISTINCT video_id, 'revived' FROM tombstones WHERE video_id IN (SELECT id FROM a)""",
    "export_missing": f"WITH {_ARCH}, {_EXPORT} SELECT id, min(n) AS n FROM x WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM arch) GROUP BY 1",
    "export_counts": f"WITH {_EXPORT} SELECT count(*) AS rows, count(*) - count(id) AS bad, count(DISTINCT id) AS ids, count(id) - count(DISTINCT id) AS duplicates FROM x",
    "gazetteer_merge": r"""WITH g AS (SELECT place_name AS name, district, state_name AS state, country, region, terrain, lat, lng, kind, CASE kind WHEN 'state' THEN 0 ELSE 1 END AS level FROM gazetteer
UNION ALL SELECT name, district, state, country, region, terrain, lat, lng, CASE WHEN name = country OR name = state THEN 'state' ELSE 'city' END, 2 FROM (
  SELECT place_id, place_name AS name, district, state_name AS state, coalesce(country, 'India') AS country, region, terrain, lat, lng FROM places WHERE place_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY place_name NULLS LAST, district NULLS LAST) = 1)),
k AS (SELECT *, regexp_replace(lower(trim(name)), '\s+', ' ', 'g') AS place_key FROM g)
SELECT place_key, kind, name, district, terrain, round(lat, 6) AS lat FROM k QUALIFY row_number() OVER (PARTITION BY place_key ORDER BY level DESC, coalesce(name, '') DESC, coalesce(state, '') DESC,
  coalesce(district, '') DESC, coalesce(terrain, '') DESC, coalesce(region, '') DESC, coalesce(country, '') DESC, coalesce(lat, -999) DESC, coalesce(lng, -999) DESC) = 1""",
    "pending_playlists": """SELECT count(*) AS playlists, coalesce(sum(item_count), 0)::BIGINT AS items, ceil(coalesce(sum(item_count), 0) / 50)::BIGINT AS units
FROM playlist_resolved WHERE item_count > 0 AND place_id IS NULL""",
}
