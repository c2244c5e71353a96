"""Queries of the load-time checks and of browsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.functions import vocab
from lodestar.operators import archive, browse, index, search
from lodestar.plans.text_search import _ARCH, _INDEX, _PLAIN, BATCH, _batch, _clips, _opened, full_sql
from lodestar.session import table

#: Titles of unplaced clips that look distant, for this archive.
DISTANT, SIGNAL = r"(?i)\b(?:dusk|harbour|fog)\b", r"(?i)\bmarket\b"


#: Rows that break the rules: a lost place, a strange tag, a placeholder with a video's id, and all of these.
PLANTED = [("planted-1", "nowhere-at-all", ["boats"], False), ("planted-2", None, ["boats", "nonsense"], False), ("planted-3", None, [], True), ("SEED_4", None, [], True), ("planted-5", "nowhere-at-all", ["odd"], True)]


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.places_of(table(spark, sf_dir, "places"))


def _home(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.home_clips(_clips(spark, sf_dir), _places(spark, sf_dir), distant=DISTANT, signal=SIGNAL)


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    built, clips = _opened(spark, sf_dir)
    return search.matched(_batch(spark), built, clips, demote=False)


def dedupe_first(spark, sf_dir):  # noqa: ANN001, ANN201
    return _clips(spark, sf_dir).select("id", "title", "place_id", F.array_join("subjects", "|").alias("subjects"), "year")


def duplicate_count(spark, sf_dir):  # noqa: ANN001, ANN201
    return archive.duplicates(archive.clips_of(table(spark, sf_dir, "clips")))


def integrity_violations(spark, sf_dir):  # noqa: ANN001, ANN201
    """Rows that break a rule, those of the archive and a few planted ones of each kind."""
    own = _clips(spark, sf_dir).select("id", "place_id", "subjects", "is_placeholder")
    planted = spark.createDataFrame(PLANTED, "id string, place_id string, subjects array<string>, is_placeholder boolean")
    return archive.violations(own.unionByName(planted), _places(spark, sf_dir))


def coverage_map(spark, sf_dir):  # noqa: ANN001, ANN201
    m = archive.coverage_map(_clips(spark, sf_dir))
    return m.select("place_id", F.explode("coverage").alias("subject", "n"))


def clips_by_place(spark, sf_dir):  # noqa: ANN001, ANN201
    return archive.clips_by_place(_clips(spark, sf_dir))


def covered_places(spark, sf_dir):  # noqa: ANN001, ANN201
    return archive.covered_places(_clips(spark, sf_dir), _places(spark, sf_dir), 2)


def ordered_lookup(spark, sf_dir):  # noqa: ANN001, ANN201
    """Lists of a visitor, each the first fifty ids of an upload month from the last, looked up in order, misses left out."""
    months = _clips(spark, sf_dir).select(F.substring("uploaded_at", 1, 7).alias("list_id"), "id").where("list_id is not null")
    months = months.withColumn("n", F.row_number().over(Window.partitionBy("list_id").orderBy(F.desc("id")))).where("n <= 50")
    lists = months.groupBy("list_id").agg(F.sort_array(F.collect_list("id"), asc=False).alias("ids")).withColumn("ids", F.concat(F.array(F.lit("missing")), "ids"))
    return archive.lookup(lists, _clips(spark, sf_dir).select("id", "title")).select("list_id", F.col("at").cast("int").alias("pos"), "id", "title")


def home_flags(spark, sf_dir):  # noqa: ANN001, ANN201
    return _home(spark, sf_dir).select("id", "home")


def home_first_page(spark, sf_dir):  # noqa: ANN001, ANN201
    return archive.home_first(_home(spark, sf_dir), 2, 50).select("id", "home")


def subject_page(spark, sf_dir):  # noqa: ANN001, ANN201
    return browse.subject_page(_home(spark, sf_dir), "boats", 6, 12)


def subject_counts(spark, sf_dir):  # noqa: ANN001, ANN201
    return browse.subject_counts(_clips(spark, sf_dir))


def clips_for_place(spark, sf_dir):  # noqa: ANN001, ANN201
    return browse.clips_for_place(_clips(spark, sf_dir), 10)


def related_clips(spark, sf_dir):  # noqa: ANN001, ANN201
    """Seeds are the clips whose id hashes to two given digits, against all clips."""
    built, clips = _opened(spark, sf_dir)
    seeds = clips.where(F.substring(F.md5("id"), 1, 2).isin("00", "01", "02"))
    return browse.related(seeds, clips, built)


def facets_subject(spark, sf_dir):  # noqa: ANN001, ANN201
    tagged = _found(spark, sf_dir).join(_clips(spark, sf_dir).select("id", "subjects"), "id")
    return browse.facets(tagged, F.explode("subjects"), 8)


def facets_place(spark, sf_dir):  # noqa: ANN001, ANN201
    placed = _found(spark, sf_dir).join(_clips(spark, sf_dir).select("id", "place_id"), "id")
    return browse.facets(placed, F.col("place_id"), 6)


def facet_filter(spark, sf_dir):  # noqa: ANN001, ANN201
    tagged = _found(spark, sf_dir).join(_clips(spark, sf_dir).select("id", "subjects"), "id")
    return tagged.where(F.array_contains("subjects", "boats")).select("query_id", "id")


TYPED_PAGES = ("0", "-5", "abc", "1e9", "1.5", "Infinity", "NaN", "2", "", "7")


def paging_clamp(spark, sf_dir):  # noqa: ANN001, ANN201
    total = _clips(spark, sf_dir).agg(F.count("*").alias("total"))
    typed = spark.createDataFrame([(p,) for p in TYPED_PAGES], "typed string").crossJoin(total)
    return typed.select("typed", browse.page_number(F.col("typed"), F.col("total")).alias("page"))


def hero_paging(spark, sf_dir):  # noqa: ANN001, ANN201
    per = _clips(spark, sf_dir).select(F.explode("subjects").alias("subject")).groupBy("subject").agg(F.count("*").alias("total"))
    pages = per.withColumn("page", F.explode(F.array(*[F.lit(i) for i in (0, 1, 2, 9)]))).withColumn("h", browse.hero_page(F.col("page"), F.col("total")))
    return pages.select("subject", "page", "h.first", "h.rows", "h.last")


def place_profile(spark, sf_dir):  # noqa: ANN001, ANN201
    return browse.place_profile(_clips(spark, sf_dir))


def elsewhere(spark, sf_dir):  # noqa: ANN001, ANN201
    covered = archive.covered_places(_clips(spark, sf_dir), _places(spark, sf_dir), 1)
    return browse.elsewhere(covered, "kasravipara-yard-1").select("place_id", "usable")


def places_by_country(spark, sf_dir):  # noqa: ANN001, ANN201
    return browse.places_by_country(_places(spark, sf_dir))


def suggestion_vocabulary(spark, sf_dir):  # noqa: ANN001, ANN201
    return browse.suggestion_vocabulary(_places(spark, sf_dir), table(spark, sf_dir, "place_aliases"))


TYPED_STARTS = ("ba", "KHEL", "gaon", "x", "Tushodih", "an")


def autocomplete(spark, sf_dir):  # noqa: ANN001, ANN201
    typed = spark.createDataFrame([(t,) for t in TYPED_STARTS], "typed string")
    return browse.autocomplete(typed, suggestion_vocabulary(spark, sf_dir))


def other_subjects(spark, sf_dir):  # noqa: ANN001, ANN201
    return browse.other_subjects(browse.subject_counts(_clips(spark, sf_dir)), "boats")


def country_lists(spark, sf_dir):  # noqa: ANN001, ANN201
    places = _places(spark, sf_dir)
    return browse.country_lists(archive.covered_places(_clips(spark, sf_dir), places, 1), places)


def place_covers(spark, sf_dir):  # noqa: ANN001, ANN201
    """One clip for the tile of each of the 96 places with the most clips, the best establishing subject first, none twice."""
    clips = _clips(spark, sf_dir)
    most = clips.where("place_id is not null").groupBy("place_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "place_id").limit(96)
    most = most.withColumn("tile", F.row_number().over(Window.orderBy(F.desc("n"), "place_id"))).select("place_id", "tile")  # at most 96 rows
    top = browse.clips_for_place(clips.join(F.broadcast(most.select("place_id")), "place_id", "left_semi"), 24).join(clips.select("id", "subjects"), "id").join(F.broadcast(most), "place_id")
    rank = F.array(*[F.lit(s) for s in vocab.ESTABLISHING])
    worth = F.array_min(F.filter(F.transform("subjects", lambda s: F.array_position(rank, s)), lambda p: p > 0))
    tiles = top.select(F.lit(1).alias("page"), "tile", F.col("rank").alias("at"), "id", worth.cast("double").alias("worth"))
    return browse.greedy_picks(tiles).select("tile", "id")


def subject_covers(spark, sf_dir):  # noqa: ANN001, ANN201
    """One clip for the tile of each subject, one whose title shows it if there is one, none twice."""
    tile = F.array_position(F.array(*[F.lit(s) for s in vocab.SUBJECTS]), F.col("subject")).cast("int")
    tiles = browse.subject_candidates(_home(spark, sf_dir)).select(F.lit(1).alias("page"), tile.alias("tile"), F.col("rank").alias("at"), "id", "worth")
    return browse.greedy_picks(tiles).select("tile", "id")


def rails(spark, sf_dir):  # noqa: ANN001, ANN201
    """Rows of up to twelve search hits at home, none shown twice on the page."""
    built, clips = _opened(spark, sf_dir)
    home = _home(spark, sf_dir).where("home").select("id")
    found = search.search(_batch(spark), built, clips, 60).join(home, "id", "left_semi")
    tiles = found.select(F.lit(1).alias("page"), F.col("query_id").alias("tile"), F.col("rank").alias("at"), "id", F.lit(None).cast("double").alias("worth"))
    return browse.greedy_picks(tiles, 12).select("tile", "slot", "id")


def watch_page(spark, sf_dir):  # noqa: ANN001, ANN201
    """What stands beside a clip: eight related ones and eight more of its first subject; for the seeds of related_clips.
    The row of picks for the visitor is that of feed without the clip itself."""
    built, clips = _opened(spark, sf_dir)
    seeds = clips.where(F.substring(F.md5("id"), 1, 2).isin("00", "01", "02"))
    near = browse.related(seeds, clips, built, 8).select("seed", F.lit("next").alias("rail"), "rank", "id")
    return near.unionByName(browse.more_like(seeds, _home(spark, sf_dir)).select("seed", F.lit("more").alias("rail"), "rank", "id"))


def backdrop(spark, sf_dir):  # noqa: ANN001, ANN201
    """The first hit of every query."""
    built, clips = _opened(spark, sf_dir)
    return search.search(_batch(spark), built, clips, 1).select("query_id", "id")


_PL = """pl AS (SELECT place_id AS id, place_name AS name, district, state_name AS state, coalesce(country, 'India') AS country, region, terrain, lat, lng FROM places
  WHERE place_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY place_name NULLS LAST, district NULLS LAST) = 1)"""
_DIST = DISTANT.replace("(?i)", "")
_HOME = f"""{_ARCH}, {_PL}, pn AS (SELECT DISTINCT array_to_string({tx.sql_words('name')}, ' ') AS phrase FROM pl WHERE country = 'India' AND length(name) >= 5),
hm AS (SELECT arch.*, CASE WHEN place_id IS NULL THEN NOT regexp_matches(title, '(?i){_DIST}') OR regexp_matches(title, '{SIGNAL}')
    OR EXISTS (SELECT 1 FROM pn WHERE contains(' ' || array_to_string({tx.sql_words('title')}, ' ') || ' ', ' ' || phrase || ' '))
  ELSE coalesce(country = 'India', false) END AS home FROM arch LEFT JOIN pl ON pl.id = arch.place_id)"""
_KEPT = f"{_PLAIN}, kx AS (SELECT kept.*, subjects, place_id FROM kept JOIN arch ON arch.id = kept.id)"
_SPEAK = tx.sql_any("title", vocab.SPEAKING)
_VOCAB = "place_names AS (SELECT name AS word FROM pl WHERE country = 'India' UNION SELECT state FROM pl WHERE country = 'India' UNION SELECT upper(alias[1]) || alias[2:] FROM place_aliases)"

# picks tile after tile: the least worth among candidates (tile, pos, id, worth) not used yet, else the first of them, else the first
_GREEDY_ONE = """l AS (SELECT tile, list(id ORDER BY worth, pos) FILTER (worth IS NOT NULL) AS w, list(id ORDER BY pos) AS a FROM o GROUP BY 1),
g(tile, used, id) AS (SELECT 0, []::VARCHAR[], NULL::VARCHAR UNION ALL
  SELECT p.tile, list_append(p.used, p.id), p.id FROM (SELECT l.tile, used, coalesce(list_filter(w, lambda x: NOT list_contains(used, x))[1], list_filter(a, lambda x: NOT list_contains(used, x))[1], a[1]) AS id
    FROM g JOIN l ON l.tile = g.tile + 1) p)"""

_NAMES = (
    dedupe_first, duplicate_count, integrity_violations, coverage_map, clips_by_place, covered_places, ordered_lookup, home_flags, home_first_page,
    subject_page, subject_counts, clips_for_place, related_clips, facets_subject, facets_place, facet_filter, paging_clamp, hero_paging, place_profile,
    elsewhere, other_subjects, places_by_country, country_lists, suggestion_vocabulary, autocomplete, place_covers, subject_covers, rails, watch_page, backdrop,
)
QUERIES = {f.__name__: f for f in _NAMES}
SQL = {
    "dedupe_first": f"WITH {_ARCH} SELECT id, title, place_id, array_to_string(subjects, '|') AS subjects, year FROM arch",
    "duplicate_count": "SELECT count(*) AS rows, count(DISTINCT clip_id) AS ids, count(*) - count(DISTINCT clip_id) AS duplicates FROM clips WHERE clip_id IS NOT NULL",
    "integrity_violations": f"""WITH {_ARCH.replace('arch AS', 'own AS', 1)}, {_PL}, arch AS (SELECT id, place_id, subjects, is_placeholder FROM own UNION ALL
  SELECT * FROM (VALUES {', '.join(f"('{i}', {repr(p) if p else 'NULL'}, {t!r}::VARCHAR[], {h})" for i, p, t, h in PLANTED)}) v(id, place_id, subjects, is_placeholder))
SELECT id, 'place' AS rule FROM arch WHERE place_id IS NOT NULL AND place_id NOT IN (SELECT id FROM pl)
UNION ALL SELECT id, 'subject' FROM arch WHERE len(list_filter(subjects, lambda s: s NOT IN ({tx.sql_list(vocab.SUBJECTS)}))) > 0
UNION ALL SELECT id, 'placeholder' FROM arch WHERE is_placeholder AND NOT starts_with(id, 'SEED_')""",
    "coverage_map": f"WITH {_ARCH}, s AS (SELECT place_id, unnest(subjects) AS subject FROM arch WHERE place_id IS NOT NULL) SELECT place_id, subject, count(*) AS n FROM s GROUP BY 1, 2",
    "clips_by_place": f"WITH {_ARCH} SELECT place_id, count(*) AS n, min(id) AS first_id FROM arch WHERE place_id IS NOT NULL GROUP BY 1",
    "covered_places": f"""WITH {_ARCH}, {_PL} SELECT place_id, name, count(*) FILTER (len(subjects) > 0) AS usable FROM arch JOIN pl ON pl.id = arch.place_id
WHERE name <> state GROUP BY 1, 2 HAVING usable >= 2""",
    "ordered_lookup": f"""WITH {_ARCH} SELECT left(uploaded_at, 7) AS list_id, row_number() OVER (PARTITION BY left(uploaded_at, 7) ORDER BY id DESC)::INTEGER AS pos, id, title
FROM arch WHERE uploaded_at IS NOT NULL QUALIFY pos <= 50""",
    "home_flags": f"WITH {_HOME} SELECT id, home FROM hm",
    "home_first_page": f"WITH {_HOME} SELECT id, home FROM hm ORDER BY home DESC, id LIMIT 50 OFFSET 50",
    "subject_page": f"WITH {_HOME}, o AS (SELECT id, home FROM hm WHERE list_contains(subjects, 'boats')) SELECT id, home, (SELECT count(*) FROM o) AS total FROM o ORDER BY home DESC, id LIMIT 12 OFFSET 6",
    "subject_counts": f"""WITH {_ARCH}, s AS (SELECT unnest(subjects) AS subject FROM arch), n AS (SELECT subject, count(*) AS n FROM s WHERE subject IN ({tx.sql_list(vocab.SUBJECTS)}) GROUP BY 1)
SELECT subject, n, row_number() OVER (ORDER BY n DESC, list_position([{tx.sql_list(vocab.SUBJECTS)}], subject))::INTEGER AS rank FROM n""",
    "clips_for_place": f"""WITH {_ARCH} SELECT place_id, row_number() OVER (PARTITION BY place_id ORDER BY {_SPEAK}::INTEGER, length(title) DESC, id)::INTEGER AS rank, id,
count(*) OVER (PARTITION BY place_id) AS total FROM arch WHERE place_id IS NOT NULL QUALIFY rank <= 10""",
    "related_clips": f"""WITH {_INDEX}, sd AS (SELECT * FROM arch WHERE left(md5(id), 2) IN ('00', '01', '02')),
sw AS (SELECT DISTINCT id AS seed, unnest(list_filter({tx.sql_words('title')}, lambda x: length(x) > 2 AND x NOT IN ({tx.sql_list(vocab.STOPWORDS)}))) AS word FROM sd),
w1 AS (SELECT DISTINCT word, {tx.sql_stem('word')} AS s1 FROM sw), w2 AS (SELECT word, {tx.sql_tokens('s1')} AS ts FROM w1),
w3 AS (SELECT word, CASE WHEN len(ts) = 0 THEN 1.0 ELSE (SELECT least(1.6, greatest(0.35, ln(1 + (n_docs - coalesce(max(df), 0) + 0.5) / (coalesce(max(df), 0) + 0.5)) / 4.5)) FROM stats LEFT JOIN terms ON term = ts[1] GROUP BY n_docs) END AS r FROM w2),
po AS (SELECT sd.id AS seed, a.id, a.title, length(a.text) AS long, len(list_intersect(a.subjects, sd.subjects)) AS sh FROM sd JOIN arch a ON a.id <> sd.id AND
  CASE WHEN sd.place_id IS NOT NULL THEN a.place_id = sd.place_id ELSE list_has_any(a.subjects, sd.subjects) END),
sc AS (SELECT po.seed, po.id, long, round(coalesce(sum(CASE WHEN contains(lower(po.title), sw.word) THEN r END), 0) + 0.25 * any_value(sh), 6) AS score
  FROM po LEFT JOIN sw ON sw.seed = po.seed LEFT JOIN w3 ON w3.word = sw.word GROUP BY 1, 2, 3)
SELECT seed, row_number() OVER (PARTITION BY seed ORDER BY score DESC, long DESC, id)::INTEGER AS rank, id, score FROM sc QUALIFY rank <= 6""",
    "facets_subject": f"""{_KEPT}, v AS (SELECT query_id, unnest(subjects) AS value, score, id FROM kx), t AS (SELECT query_id, value, count(*) AS n, min((-score, id)) AS first FROM v GROUP BY 1, 2)
SELECT query_id, value, n FROM t QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, first, value) <= 8""",
    "facets_place": f"""{_KEPT}, t AS (SELECT query_id, place_id AS value, count(*) AS n, min((-score, id)) AS first FROM kx WHERE place_id IS NOT NULL GROUP BY 1, 2)
SELECT query_id, value, n FROM t QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, first, value) <= 6""",
    "facet_filter": f"{_KEPT} SELECT query_id, id FROM kx WHERE list_contains(subjects, 'boats')",
    "paging_clamp": f"""WITH {_ARCH}, t AS (SELECT * FROM (VALUES {', '.join(f"('{p}')" for p in TYPED_PAGES)}) v(typed)), d AS (SELECT typed, TRY_CAST(typed AS DOUBLE) AS n FROM t)
SELECT typed, least(greatest(1, ceil((SELECT count(*) FROM arch) / 24)), greatest(1, floor(CASE WHEN n IS NULL OR isnan(n) THEN 1 ELSE n END)))::INTEGER AS page FROM d""",
    "hero_paging": f"""WITH {_ARCH}, s AS (SELECT unnest(subjects) AS subject FROM arch), n AS (SELECT subject, count(*) AS total FROM s GROUP BY 1),
p AS (SELECT subject, total, page, greatest(1, ceil((total - 1) / 23))::INTEGER AS last FROM n, (VALUES (0), (1), (2), (9)) v(page)), q AS (SELECT *, least(greatest(page, 1), last) AS k FROM p)
SELECT subject, page, CASE WHEN k = 1 THEN 0 ELSE 1 + (k - 1) * 23 END AS first, CASE WHEN k = 1 THEN 24 ELSE 23 END AS rows, last FROM q""",
    "place_profile": f"""WITH {_ARCH}, s AS (SELECT place_id, unnest(subjects) AS subject FROM arch WHERE place_id IS NOT NULL), n AS (SELECT place_id, subject, count(*) AS n FROM s GROUP BY 1, 2)
SELECT place_id, subject, n, row_number() OVER (PARTITION BY place_id ORDER BY n DESC, subject)::INTEGER AS rank FROM n QUALIFY rank <= 8""",
    "elsewhere": f"""WITH {_ARCH}, {_PL}, c AS (SELECT place_id, count(*) FILTER (len(subjects) > 0) AS usable FROM arch JOIN pl ON pl.id = arch.place_id WHERE name <> state GROUP BY 1 HAVING usable >= 1)
SELECT place_id, usable FROM c WHERE place_id <> 'kasravipara-yard-1' ORDER BY usable DESC, place_id LIMIT 12""",
    "places_by_country": f"WITH {_PL}, n AS (SELECT country, count(*) AS n FROM pl GROUP BY 1) SELECT country, n, row_number() OVER (ORDER BY country <> 'India', n DESC, country)::INTEGER AS rank FROM n",
    "suggestion_vocabulary": f"WITH {_PL}, {_VOCAB} SELECT word FROM place_names WHERE word IS NOT NULL",
    "autocomplete": f"""WITH {_PL}, {_VOCAB}, t AS (SELECT * FROM (VALUES {', '.join(f"('{p}')" for p in TYPED_STARTS)}) v(typed))
SELECT typed, row_number() OVER (PARTITION BY typed ORDER BY CASE WHEN starts_with(lower(word), lower(typed)) THEN 0 ELSE 1 END, word)::INTEGER AS rank, word
FROM place_names, t WHERE length(typed) >= 2 AND contains(lower(word), lower(typed)) AND lower(word) <> lower(typed) QUALIFY rank <= 6""",
    "backdrop": f"WITH {full_sql(BATCH, 1)} SELECT query_id, id FROM ranked",
    "other_subjects": f"""WITH {_ARCH}, s AS (SELECT unnest(subjects) AS subject FROM arch), n AS (SELECT subject, count(*) AS n FROM s WHERE subject IN ({tx.sql_list(vocab.SUBJECTS)}) GROUP BY 1)
SELECT subject, n FROM n WHERE subject <> 'boats' ORDER BY n DESC, list_position([{tx.sql_list(vocab.SUBJECTS)}], subject) LIMIT 12""",
    "country_lists": f"""WITH {_ARCH}, {_PL}, c AS (SELECT place_id, country, count(*) FILTER (len(subjects) > 0) AS usable FROM arch JOIN pl ON pl.id = arch.place_id WHERE name <> state GROUP BY 1, 2 HAVING usable >= 1),
n AS (SELECT country, row_number() OVER (ORDER BY country <> 'India', count(*) DESC, country)::INTEGER AS country_rank FROM c GROUP BY 1)
SELECT country, country_rank, row_number() OVER (PARTITION BY country ORDER BY usable DESC, place_id)::INTEGER AS at, place_id, usable FROM c JOIN n USING (country)""",
    "place_covers": f"""WITH RECURSIVE {_ARCH}, m AS (SELECT place_id, row_number() OVER (ORDER BY count(*) DESC, place_id)::INTEGER AS tile FROM arch WHERE place_id IS NOT NULL GROUP BY 1 QUALIFY tile <= 96),
o AS (SELECT tile, id, row_number() OVER (PARTITION BY tile ORDER BY {_SPEAK}::INTEGER, length(title) DESC, id) AS pos,
  list_min(list_filter(list_transform(subjects, lambda x: list_position([{tx.sql_list(vocab.ESTABLISHING)}], x)), lambda p: p > 0)) AS worth FROM arch JOIN m ON m.place_id = arch.place_id QUALIFY pos <= 24),
{_GREEDY_ONE} SELECT tile, id FROM g WHERE tile > 0""",
    "subject_covers": f"""WITH RECURSIVE {_HOME}, u AS (SELECT id, title, home, unnest(subjects) AS s FROM hm),
f AS (SELECT *, list_position([{tx.sql_list(vocab.SUBJECTS)}], s) AS sp, row_number() OVER (PARTITION BY s ORDER BY NOT home, id) AS pos FROM u WHERE s IN ({tx.sql_list(vocab.SUBJECTS)}) QUALIFY pos <= 60),
nu AS (SELECT sp, row_number() OVER (ORDER BY sp)::INTEGER AS tile FROM f GROUP BY 1),
o AS (SELECT tile, id, pos, CASE WHEN len(list_filter(list_transform(string_split(s, ' '), lambda w: regexp_replace(w, 's$', '')), lambda w: length(w) > 2 AND contains(lower(title), w))) > 0 THEN 0 END AS worth
  FROM f JOIN nu ON nu.sp = f.sp), {_GREEDY_ONE} SELECT sp::INTEGER AS tile, id FROM g JOIN nu ON nu.tile = g.tile""",
    "rails": f"""WITH RECURSIVE {full_sql(BATCH, 60)}, {_HOME.replace(_ARCH + ', ', '', 1)},
h AS (SELECT query_id, list(ranked.id ORDER BY rank) AS ids FROM ranked JOIN hm ON hm.id = ranked.id AND home GROUP BY 1),
t AS (SELECT q.query_id AS tile, coalesce(ids, []) AS ids FROM q LEFT JOIN h ON h.query_id = q.query_id),
g(tile, used, own) AS (SELECT 0, []::VARCHAR[], []::VARCHAR[] UNION ALL
  SELECT t.tile, list_concat(used, list_filter(ids, lambda x: NOT list_contains(used, x))[1:12]), list_filter(ids, lambda x: NOT list_contains(used, x))[1:12] FROM g JOIN t ON t.tile = g.tile + 1),
e AS (SELECT tile, unnest(own) AS id, generate_subscripts(own, 1) - 1 AS slot FROM g) SELECT tile, slot::INTEGER AS slot, id FROM e""",
}
SQL["watch_page"] = f"""WITH nx AS ({SQL['related_clips'].replace('rank <= 6', 'rank <= 8')}), {_HOME},
u AS (SELECT id, home, unnest(subjects) AS s FROM hm), f AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY NOT home, id) AS r FROM u QUALIFY r <= 20),
m AS (SELECT sd.id AS seed, f.id, row_number() OVER (PARTITION BY sd.id ORDER BY r)::INTEGER AS rank FROM arch sd JOIN f ON f.s = sd.subjects[1] AND f.id <> sd.id WHERE left(md5(sd.id), 2) IN ('00', '01', '02') QUALIFY rank <= 8)
SELECT seed, 'next' AS rail, rank, id FROM nx UNION ALL SELECT seed, 'more', rank, id FROM m"""
