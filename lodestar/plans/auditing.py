"""Queries of the audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.functions import vocab
from lodestar.operators import audit, dedupe, etl, index, search
from lodestar.plans.delivery_and_places import _VIDEO
from lodestar.plans.ingest import _CAND, _ZONES, _names
from lodestar.plans.text_search import _ARCH, _PLAIN, _TOP, _batch, _clips, _opened
from lodestar.session import table

RULES = [("numbered", r"(?i)\b(?:part|take) \d+\b"), ("camera", r"(?i)\b(?:shot|pan|view|frame|close-up|time-lapse)\b"), ("animals", r"(?i)\b(?:goats?|egrets?|bulbuls?|otters?)\b")]
ORDINARY = ("how", "why", "from", "the", "tea", "old", "sunlit", "golden")
WANTED = [("boats", ["ferry", "boat"], []), ("wool at dusk", ["shawls", "blankets"], ["dusk"]), ("none", ["zzzz"], [])]
JUDGED = [(1, ["wooden|toys"], []), (2, ["carpenters"], ["dusk"]), (6, ["slow pan"], []), (7, ["stonecutters"], []), (14, ["zzzz"], [])]


def _titles(spark, sf_dir):  # noqa: ANN001, ANN202
    return table(spark, sf_dir, "youtube_items").where("title is not null").select(F.col("log_id").alias("id"), "title")


def seeded_sample(spark, sf_dir):  # noqa: ANN001, ANN201
    return audit.seeded_sample(_clips(spark, sf_dir).select("id", "title"), [F.col("id")], 100, 42).select("pos", "id")


def classify_rules(spark, sf_dir):  # noqa: ANN001, ANN201
    c = audit.classify(F.col("title"), RULES, ORDINARY)
    return _titles(spark, sf_dir).select("id", c.alias("c")).select("id", "c.bucket")


def bucket_estimates(spark, sf_dir):  # noqa: ANN001, ANN201
    """Buckets of a seeded sample of 200 titles, extrapolated to all of them."""
    titles = _titles(spark, sf_dir)
    picked = audit.seeded_sample(titles, [F.col("id")], 200, 43).select(audit.classify(F.col("title"), RULES, ORDINARY).alias("c"))
    n = picked.groupBy("c.bucket").agg(F.count("*").alias("n"))
    return audit.extrapolated(n, 200, titles.count())


def keyword_counts(spark, sf_dir):  # noqa: ANN001, ANN201
    words = spark.createDataFrame([(k,) for _, k in vocab.subject_keywords()], "keyword string").distinct()
    return audit.keyword_counts(_titles(spark, sf_dir).withColumnRenamed("title", "text"), words)


def proper_noun_bigrams(spark, sf_dir):  # noqa: ANN001, ANN201
    return audit.proper_nouns(_titles(spark, sf_dir), table(spark, sf_dir, "gazetteer").select(F.col("place_key").alias("name")))


def playlist_titles(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "youtube_items").where("playlist_title is not null").groupBy("playlist_title").agg(F.count("*").alias("n"))


def playlist_resolvable(spark, sf_dir):  # noqa: ANN001, ANN201
    """Which playlist titles name a place exactly."""
    t = table(spark, sf_dir, "playlist_resolved").where("title is not null")
    zoned = t.select(F.col("playlist_id").alias("id"), "title", F.lit("").alias("prose"), F.lit(None).cast("string").alias("playlist"), F.array().cast("array<string>").alias("hashtags"))
    best = etl.best_place(etl.place_candidates(zoned, _names(spark, sf_dir)))
    return zoned.select("id").join(best.select("id", "place_key"), "id", "left").select("id", F.col("place_key").isNotNull().alias("resolvable"))


def _kinds(spark, sf_dir):  # noqa: ANN001, ANN202
    return table(spark, sf_dir, "places").where("place_id is not null").select("place_id", F.when(F.col("place_name") == F.col("state_name"), "state").otherwise("city").alias("kind")).distinct()


def granularity(spark, sf_dir):  # noqa: ANN001, ANN201
    return audit.granularity(_clips(spark, sf_dir), _kinds(spark, sf_dir))


def usable_thresholds(spark, sf_dir):  # noqa: ANN001, ANN201
    return audit.usable_thresholds(_clips(spark, sf_dir), (1, 2, 5, 20, 50, 100, 500))


def top_places(spark, sf_dir):  # noqa: ANN001, ANN201
    return audit.top_places(_clips(spark, sf_dir))


def decade_histogram(spark, sf_dir):  # noqa: ANN001, ANN201
    return audit.decades(_clips(spark, sf_dir))


def substring_search(spark, sf_dir):  # noqa: ANN001, ANN201
    return audit.substring_search(_clips(spark, sf_dir), WANTED)


def length_median(spark, sf_dir):  # noqa: ANN001, ANN201
    return audit.length_shape(table(spark, sf_dir, "youtube_items").select("log_id", F.col("description").alias("text")))


def zone_attribution(spark, sf_dir):  # noqa: ANN001, ANN201
    items = table(spark, sf_dir, "youtube_items").select(F.col("log_id").alias("id"), "title", "description", F.col("playlist_title").alias("playlist"))
    return audit.zone_attribution(etl.with_zones(items), _names(spark, sf_dir))


def first_log_rows(spark, sf_dir):  # noqa: ANN001, ANN201
    return audit.first_rows(_clips(spark, sf_dir), table(spark, sf_dir, "youtube_items"), dedupe.clean_id(F.col("video_id")))


def extractor_comparison(spark, sf_dir):  # noqa: ANN001, ANN201
    """Exact names in titles against exact names in playlists; the truth is the entered place of the playlist."""
    lists = table(spark, sf_dir, "playlist_resolved")
    known = table(spark, sf_dir, "gazetteer").select(F.col("place_key").alias("place_id"))
    truth = lists.join(known, "place_id", "left_semi").select(F.col("playlist_id").alias("id"), "place_id")
    a = lists.select(F.col("playlist_id").alias("id"), tx.normalise(F.col("title")).alias("place_id")).join(known, "place_id", "left_semi")
    last = lists.select(F.col("playlist_id").alias("id"), F.regexp_extract(tx.normalise(F.col("title")), r"(\S+)$", 1).alias("place_id"))
    return audit.compare_extractors(truth, a, last.join(known, "place_id", "left_semi"))


def fallback_checks(spark, sf_dir):  # noqa: ANN001, ANN201
    """Clips without a place, without text, and with a title of another script."""
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return _clips(spark, sf_dir).agg(
        F.count("*").alias("clips"), one(F.col("place_id").isNull()).alias("no_place"), one(F.col("text") == "").alias("no_text"),
        one(F.rlike("title", F.lit(r"[^\x00-\x7F]"))).alias("not_ascii"),
    )


def precision_at_k(spark, sf_dir):  # noqa: ANN001, ANN201
    built, clips = _opened(spark, sf_dir)
    ranked = search.search(_batch(spark), built, clips, 20, demote=False, phrases=False)
    return audit.precision_at(spark, ranked, clips, JUDGED)


#: Lists of the classifier of whole titles, for this archive.
WHOLE = {
    "refused": ("private video", "deleted video"), "formats": ("time-lapse", "interview", "close-up"), "figures": ("musicians", "dancers"), "abroad": ("harbour", "fog"),
    "regions": ("valley", "delta"), "festivals": ("harvest", "mela", "market day"), "kinds": ("egret", "bulbul", "goat", "otter", "bus", "kingfisher"),
    "ordinary": ("how", "why", "from", "the", "tea", "old", "golden", "part", "sunlit"),
}


def classify_whole_titles(spark, sf_dir):  # noqa: ANN001, ANN201
    return _titles(spark, sf_dir).select("id", audit.classify_whole(F.col("title"), **WHOLE).alias("c")).select("id", "c.bucket", "c.found")


def shape_of_sample(spark, sf_dir):  # noqa: ANN001, ANN201
    """The shape of the descriptions of a hundred rows of the log, drawn by seed."""
    rows = table(spark, sf_dir, "youtube_items").where("description is not null").select(F.col("log_id").alias("id"), F.col("description").alias("text"))
    return audit.length_shape(audit.seeded_sample(rows, [F.col("id")], 100, 42).select("id", "text"))


def _candidates(spark, sf_dir):  # noqa: ANN001, ANN202
    items = table(spark, sf_dir, "youtube_items").select(F.col("log_id").alias("id"), "title", "description", F.col("playlist_title").alias("playlist"))
    return etl.place_candidates(etl.with_zones(items), _names(spark, sf_dir))


def leakage_dump(spark, sf_dir):  # noqa: ANN001, ANN201
    """A seeded sample of rows whose playlist names another place than their title, with both."""
    return audit.seeded_sample(audit.disagreements(_candidates(spark, sf_dir)), [F.col("id")], 40, 7).select("id", "one", "other")


def origin_dump(spark, sf_dir):  # noqa: ANN001, ANN201
    """A seeded sample of mentions that say where something came from, not where it was shot."""
    told = _candidates(spark, sf_dir).where("origin").select("id", "source", "place_key").distinct()
    return audit.seeded_sample(told, [F.col("id"), F.col("source"), F.col("place_key")], 40, 7).select("id", "source", "place_key")


_FUNCS = (
    classify_whole_titles, shape_of_sample, leakage_dump, origin_dump, seeded_sample, classify_rules, bucket_estimates, keyword_counts, proper_noun_bigrams, playlist_titles, playlist_resolvable, granularity, usable_thresholds, top_places,
    decade_histogram, substring_search, length_median, zone_attribution, first_log_rows, extractor_comparison, fallback_checks, precision_at_k,
)
QUERIES = {f.__name__: f for f in _FUNCS}
_PATTERNS = [p for _, p in RULES]
_KWS = ", ".join(sorted({f"('{k}')" for _, k in vocab.subject_keywords()}))
# the generator and the first n distinct positions below the size of a pool (pos, n of rows in `sz`); needs WITH RECURSIVE
def _drawn(n: int, seed: int, order: str = "id") -> str:
    return f"""mb(i, st, v) AS (SELECT 0, {seed}::HUGEINT, 0::HUGEINT UNION ALL SELECT i + 1, s1, xor(t2, t2 // 16384) FROM (SELECT i, s1, xor(t1, (t1 + (xor(t1, t1 // 128) * (t1 | 61)) % 4294967296) % 4294967296) AS t2
  FROM (SELECT i, s1, (xor(s1, s1 // 32768) * (s1 | 1)) % 4294967296 AS t1 FROM (SELECT i, (st + 1831565813) % 4294967296 AS s1 FROM mb WHERE i < {n * 40})))),
dr AS (SELECT floor(v::DOUBLE / 4294967296.0 * (SELECT count(*) FROM pool))::BIGINT AS pos, min(i) AS i FROM mb WHERE i > 0 GROUP BY 1 ORDER BY 2 LIMIT {n}),
pk AS (SELECT p.* FROM (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS pos FROM pool) p JOIN dr ON dr.pos = p.pos)"""


_ODD = f"""list_filter(string_split_regex(title, '[^\\p{{L}}\\p{{N}}''’-]+'), lambda w: regexp_matches(w, '^\\p{{Lu}}\\p{{L}}{{2,}}$') AND lower(w) NOT IN ({tx.sql_list(ORDINARY)}))"""
_CLASS = f"""CASE WHEN regexp_matches(title, '{_PATTERNS[0]}') THEN 'numbered' WHEN regexp_matches(title, '{_PATTERNS[1]}') THEN 'camera' WHEN regexp_matches(title, '{_PATTERNS[2]}') THEN 'animals'
  WHEN len({_ODD}) > 0 THEN 'gap' ELSE 'none' END"""


def _first_of(words: tuple[str, ...], tail: str = "") -> str:
    return f"list_filter([{tx.sql_list(words)}], lambda w: regexp_matches(title, '(?i)\\b' || w || '{tail}\\b'))[1]"


_BP = """(PARTITION BY id ORDER BY CASE WHEN locative THEN 0 WHEN origin THEN 2 ELSE 1 END, CASE WHEN kind = 'city' THEN 0 ELSE 1 END,
  CASE source WHEN 'playlist' THEN 0 WHEN 'hashtag' THEN 1 WHEN 'title' THEN 2 ELSE 3 END, seq, place_key) = 1"""
_LEVELS = (("all", ""), ("no playlist", "'playlist'"), ("no hashtag", "'playlist', 'hashtag'"), ("prose only", "'playlist', 'hashtag', 'title'"))
_KIND_SQL = f"(w IN ({tx.sql_list(WHOLE['kinds'])}) OR regexp_replace(w, 's$', '') IN ({tx.sql_list(WHOLE['kinds'])}) OR regexp_replace(w, 'es$', '') IN ({tx.sql_list(WHOLE['kinds'])}))"
SQL = {
    "classify_whole_titles": f"""WITH t AS (SELECT log_id AS id, title, list_filter(string_split_regex(title, '[^\\p{{L}}\\p{{N}}''’-]+')[2:], lambda w: regexp_matches(w, '^[A-Z][a-z'']{{2,}}$')) AS cap FROM youtube_items WHERE title IS NOT NULL),
h AS (SELECT *, {', '.join(f"{_first_of(WHOLE[k])} AS {k}" for k in ('refused', 'formats', 'figures', 'abroad', 'regions', 'festivals'))}, {_first_of(WHOLE['kinds'], '(?:s|es)?')} AS thing,
  list_filter(cap, lambda x: lower(x) NOT IN ({tx.sql_list(WHOLE['ordinary'])}) AND NOT {_KIND_SQL.replace('(w IN', '(lower(x) IN').replace('(w,', '(lower(x),')})[1] AS place FROM t)
SELECT id, CASE WHEN refused IS NOT NULL OR formats IS NOT NULL THEN 'reject' WHEN figures IS NOT NULL THEN 'ambiguous' WHEN abroad IS NOT NULL THEN 'gap-2b' WHEN regions IS NOT NULL THEN 'region'
  WHEN festivals IS NOT NULL THEN 'festival' WHEN place IS NOT NULL THEN 'gap-2a' WHEN thing IS NOT NULL OR len(cap) = 0 THEN 'subject' ELSE 'ambiguous' END AS bucket,
  coalesce(refused, formats, figures, abroad, regions, festivals, place, thing) AS found FROM h""",
    "seeded_sample": f"WITH RECURSIVE {_ARCH}, pool AS (SELECT id FROM arch), {_drawn(100, 42)} SELECT pos, id FROM pk",
    "bucket_estimates": f"""WITH RECURSIVE pool AS (SELECT log_id AS id, title FROM youtube_items WHERE title IS NOT NULL), {_drawn(200, 43)},
b AS (SELECT {_CLASS} AS bucket FROM pk) SELECT bucket, count(*) AS n, round(count(*) / 200, 6) AS share, round(count(*) / 200 * (SELECT count(*) FROM pool))::BIGINT AS estimate FROM b GROUP BY 1""",
    "shape_of_sample": f"""WITH RECURSIVE pool AS (SELECT log_id AS id, description AS t FROM youtube_items WHERE description IS NOT NULL), {_drawn(100, 42)}, s AS (SELECT t, length(t) AS n FROM pk)
SELECT count(*) AS rows, min(n)::INTEGER AS least, max(n)::INTEGER AS greatest, count(*) FILTER (regexp_matches(t, 'https?://')) AS links, count(*) FILTER (regexp_matches(t, '#[\\p{{L}}\\p{{N}}_]+')) AS hashtags,
list(n ORDER BY n)[(count(*) // 2 + 1)::BIGINT]::INTEGER AS median FROM s""",
    "leakage_dump": f"""WITH RECURSIVE {_ZONES}, {_CAND}, ti AS (SELECT id, place_key FROM cand WHERE source = 'title' QUALIFY row_number() OVER {_BP}), pi AS (SELECT id, place_key FROM cand WHERE source = 'playlist' QUALIFY row_number() OVER {_BP}),
pool AS (SELECT ti.id, ti.place_key AS one, pi.place_key AS other FROM ti JOIN pi ON pi.id = ti.id WHERE ti.place_key <> pi.place_key), {_drawn(40, 7)} SELECT id, one, other FROM pk""",
    "origin_dump": f"WITH RECURSIVE {_ZONES}, {_CAND}, pool AS (SELECT DISTINCT id, source, place_key FROM cand WHERE origin), {_drawn(40, 7, 'id, source, place_key')} SELECT id, source, place_key FROM pk",
    "zone_attribution": f"WITH {_ZONES}, {_CAND} " + " UNION ALL ".join(
        f"SELECT '{level}' AS level, source, count(*) AS n FROM (SELECT * FROM cand {f'WHERE source NOT IN ({gone})' if gone else ''} QUALIFY row_number() OVER {_BP}) GROUP BY 2" for level, gone in _LEVELS
    ),
    "first_log_rows": f"WITH {_ARCH}, l AS (SELECT log_id, {_VIDEO} AS id FROM youtube_items) SELECT id, min(log_id) AS log_id FROM l WHERE id IN (SELECT id FROM arch) GROUP BY 1",
    "playlist_resolvable": """WITH nm AS (SELECT alias AS name FROM place_aliases a JOIN gazetteer g ON g.place_key = a.place_key UNION SELECT place_key FROM gazetteer)
SELECT playlist_id AS id, EXISTS (SELECT 1 FROM nm WHERE contains(lower(title), name) AND regexp_matches(lower(title), '\\b' || name || '\\b')) AS resolvable FROM playlist_resolved WHERE title IS NOT NULL""",
    "proper_noun_bigrams": """WITH t AS (SELECT string_split_regex(title, '\\s+') AS w FROM youtube_items WHERE title IS NOT NULL), u AS (SELECT unnest(w[2:]) AS a, unnest(list_concat(w[3:], [NULL])) AS b FROM t),
k AS (SELECT a, b, regexp_matches(a, '^[A-Z][a-z]{2,}$') AS x, coalesce(regexp_matches(b, '^[A-Z][a-z]{2,}$'), false) AS y FROM u),
p AS (SELECT a AS phrase, 1 AS words FROM k WHERE x UNION ALL SELECT a || ' ' || b, 2 FROM k WHERE x AND y)
SELECT phrase, words, count(*) AS n FROM p WHERE lower(phrase) NOT IN (SELECT place_key FROM gazetteer) GROUP BY 1, 2 HAVING count(*) >= 3""",
    "extractor_comparison": r"""WITH n AS (SELECT playlist_id AS id, place_id, trim(regexp_replace(lower(title), '[^\p{L}\p{N}]+', ' ', 'g')) AS t FROM playlist_resolved), g AS (SELECT place_key FROM gazetteer),
r AS (SELECT place_id AS t, CASE WHEN n.t IN (SELECT * FROM g) THEN n.t END AS a, CASE WHEN regexp_extract(n.t, '(\S+)$', 1) IN (SELECT * FROM g) THEN regexp_extract(n.t, '(\S+)$', 1) END AS b FROM n WHERE place_id IN (SELECT * FROM g)),
o AS (SELECT *, coalesce(a = t, false) AS x, coalesce(b = t, false) AS y FROM r)
SELECT count(a) AS a_given, count(*) FILTER (x) AS a_right, count(b) AS b_given, count(*) FILTER (y) AS b_right, count(*) FILTER (a IS NOT NULL AND NOT x AND (y OR b IS NULL)) AS fixed,
count(*) FILTER (x AND NOT y) AS lost, count(*) FILTER (a IS NOT NULL AND NOT x AND b IS NOT NULL AND NOT y) AS still_wrong, round(count(*) FILTER (x) / nullif(count(a), 0), 6) AS a_precision,
round(count(*) FILTER (y) / nullif(count(b), 0), 6) AS b_precision FROM o""",
    "precision_at_k": f"""{_PLAIN}, top AS ({_TOP}), w AS (SELECT top.query_id, title || ' ' || text AS whole FROM top JOIN arch ON arch.id = top.id),
jd AS (SELECT query_id, CASE query_id {' '.join(f"WHEN {i} THEN " + ' AND '.join([f"regexp_matches(whole, '(?i){m}')" for m in must] + [f"NOT regexp_matches(whole, '(?i){m}')" for m in no]) for i, must, no in JUDGED)} END AS ok FROM w),
c AS (SELECT query_id, count(*) AS hits, count(*) FILTER (ok) AS right_ FROM jd GROUP BY 1)
SELECT i AS query_id, coalesce(hits, 0) AS hits, coalesce(right_, 0) AS "right", round(CASE WHEN hits > 0 THEN right_ / hits ELSE 0 END, 6) AS precision FROM (VALUES {', '.join(f'({i})' for i, _, _ in JUDGED)}) v(i) LEFT JOIN c ON c.query_id = i""",
    "classify_rules": f"""WITH t AS (SELECT log_id AS id, title, list_filter(string_split_regex(title, '[^\\p{{L}}\\p{{N}}''’-]+'), lambda w: regexp_matches(w, '^\\p{{Lu}}\\p{{L}}{{2,}}$')
  AND lower(w) NOT IN ({tx.sql_list(ORDINARY)})) AS odd FROM youtube_items WHERE title IS NOT NULL)
SELECT id, CASE WHEN regexp_matches(title, '{_PATTERNS[0]}') THEN 'numbered' WHEN regexp_matches(title, '{_PATTERNS[1]}') THEN 'camera' WHEN regexp_matches(title, '{_PATTERNS[2]}') THEN 'animals'
  WHEN len(odd) > 0 THEN 'gap' ELSE 'none' END AS bucket FROM t""",
    "keyword_counts": f"""WITH k AS (SELECT * FROM (VALUES {_KWS}) v(keyword)), t AS (SELECT ' ' || array_to_string({tx.sql_words('title')}, ' ') || ' ' AS t FROM youtube_items WHERE title IS NOT NULL)
SELECT keyword, count(t) AS n FROM k LEFT JOIN t ON contains(t, ' ' || keyword || ' ') GROUP BY 1""",
    "playlist_titles": "SELECT playlist_title, count(*) AS n FROM youtube_items WHERE playlist_title IS NOT NULL GROUP BY 1",
    "granularity": f"""WITH {_ARCH}, k AS (SELECT DISTINCT place_id, CASE WHEN place_name = state_name THEN 'state' ELSE 'city' END AS kind FROM places WHERE place_id IS NOT NULL)
SELECT coalesce(kind, 'none') AS kind, count(*) AS n, round(count(*) / (SELECT count(*) FROM arch), 6) AS share FROM arch LEFT JOIN k ON k.place_id = arch.place_id GROUP BY 1""",
    "usable_thresholds": f"""WITH {_ARCH}, p AS (SELECT place_id, count(*) AS n FROM arch WHERE place_id IS NOT NULL AND len(subjects) > 0 GROUP BY 1)
SELECT k AS least, count(n) AS places FROM (VALUES (1), (2), (5), (20), (50), (100), (500)) v(k) LEFT JOIN p ON n >= k GROUP BY 1""",
    "top_places": f"""WITH {_ARCH}, n AS (SELECT place_id, count(*) FILTER (len(subjects) > 0) AS usable, count(year) AS with_year FROM arch WHERE place_id IS NOT NULL GROUP BY 1),
t AS (SELECT *, row_number() OVER (ORDER BY usable DESC, place_id)::INTEGER AS rank FROM n QUALIFY rank <= 100), u AS (SELECT place_id, unnest(subjects) AS s FROM arch WHERE place_id IS NOT NULL),
c AS (SELECT place_id, s, count(*) AS k FROM u GROUP BY 1, 2), l AS (SELECT place_id, list(s ORDER BY k DESC, s) AS s FROM c GROUP BY 1)
SELECT rank, t.place_id, usable, with_year, s[1] AS subject_1, s[2] AS subject_2, s[3] AS subject_3 FROM t LEFT JOIN l ON l.place_id = t.place_id""",
    "decade_histogram": f"WITH {_ARCH} SELECT (year // 10 * 10)::INTEGER AS decade, count(*) AS n FROM arch WHERE year IS NOT NULL GROUP BY 1",
    "substring_search": f"""WITH {_ARCH}, h AS (SELECT id, lower(title || ' ' || text) AS h FROM arch), m AS (SELECT 'boats' AS label, id FROM h WHERE contains(h, 'ferry') OR contains(h, 'boat')
UNION ALL SELECT 'wool at dusk', id FROM h WHERE (contains(h, 'shawls') OR contains(h, 'blankets')) AND contains(h, 'dusk'))
SELECT label, row_number() OVER (PARTITION BY label ORDER BY id)::INTEGER AS rank, id, count(*) OVER (PARTITION BY label) AS total FROM m QUALIFY rank <= 10""",
    "length_median": r"""WITH t AS (SELECT description AS t, length(description) AS n FROM youtube_items WHERE description IS NOT NULL)
SELECT count(*) AS rows, min(n)::INTEGER AS least, max(n)::INTEGER AS greatest, count(*) FILTER (regexp_matches(t, 'https?://')) AS links, count(*) FILTER (regexp_matches(t, '#[\p{L}\p{N}_]+')) AS hashtags,
list(n ORDER BY n)[(count(*) // 2 + 1)::BIGINT]::INTEGER AS median FROM t""",
    "fallback_checks": f"""WITH {_ARCH} SELECT count(*) AS clips, count(*) FILTER (place_id IS NULL) AS no_place, count(*) FILTER (text = '') AS no_text,
count(*) FILTER (regexp_matches(title, '[^\\x00-\\x7F]')) AS not_ascii FROM arch""",
}
