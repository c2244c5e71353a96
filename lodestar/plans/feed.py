"""Queries of interpretation, recommendation, descriptions and codecs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import codecs, describe
from lodestar.functions import text as tx
from lodestar.functions import vocab
from lodestar.operators import index, interpret, recommend, search
from lodestar.plans.browsing import _HOME, _PL, _home, _places
from lodestar.plans.text_search import _ARCH, _INDEX, _clips, _opened, full_sql
from lodestar.session import cut, table

# (user, question, kind, answer, implied subjects, context subjects, context words, context stop words)
ANSWERS = [
    (1, 1, "place", "Rudimbaganj boats", None, None, None, None), (1, 2, "topic", "wooden toys and brass lamps", None, None, None, None),
    (1, 3, "topic", "potters", None, ["crafts", "village"], ["potter"], ["quarter"]), (2, 1, "region", "North India hills", None, None, None, None),
    (2, 2, "topic", "fishermen, kite makers / musicians", None, None, None, None), (2, 3, "open", "the old fort near the river in winter fog", ["fort"], None, None, None),
    (3, 1, "place", "zzqq", None, None, None, None), (3, 2, "topic", "", None, None, None, None), (4, 1, "state", "tushanagar", None, None, None, None),
    (4, 2, "topic", "betel leaves", None, None, None, None), (5, 1, "place", "Belkegiri & Moripur", None, None, None, None), (5, 4, "topic", "deserts lakes snow", None, None, None, None),
]
SIGNALS = [
    (5, ["kasravipara-yard-1", "nowhere"], ["Moripur"], ["South"], ["desert"], ["boats"]), (1, [], ["Rudimbaganj", "Moripur"], ["North"], ["delta"], ["boats", "fort"]), (2, [], [], ["South", "Northeast"], ["hills", "plateau"], ["music"]),
    (3, [], [], [], [], []), (4, [], ["Tushanagar"], [], [], ["birds", "old town", "lake"]),
]


def _answers(spark):  # noqa: ANN001, ANN202
    rows = [(u * 100 + q, *r) for r in ANSWERS for u, q in [r[:2]]]
    return spark.createDataFrame(rows, "answer_id int, user_id int, at int, kind string, answer string, implies array<string>, c_subjects array<string>, c_words array<string>, c_not array<string>")


def _words(spark, sf_dir):  # noqa: ANN001, ANN202
    aliases = table(spark, sf_dir, "place_aliases").select("alias", F.col("place_key").alias("place_id"))
    return interpret.dictionary(spark, _places(spark, sf_dir), aliases)


def normalise(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "playlist_resolved").where("title is not null").select("playlist_id", tx.normalise(F.col("title")).alias("plain"))


def ngram_dictionary(spark, sf_dir):  # noqa: ANN001, ANN201
    """Runs of words of playlist titles that are gazetteer names."""
    names = table(spark, sf_dir, "gazetteer").select(F.col("place_key").alias("phrase"))
    titles = table(spark, sf_dir, "playlist_resolved").where("title is not null").select("playlist_id", F.split(tx.normalise(F.col("title")), " ").alias("w"))
    runs = titles.select("playlist_id", F.explode(tx.ngrams(F.col("w"), 4)).alias("g")).select("playlist_id", "g.start", "g.size", "g.phrase")
    return runs.join(names, "phrase", "left_semi").select("playlist_id", "start", "size", "phrase")


def greedy_match(spark, sf_dir):  # noqa: ANN001, ANN201
    s = interpret.interpret(_answers(spark), _words(spark, sf_dir))
    return s.select("answer_id", *[F.array_join(k, "|").alias(k) for k in ("places", "states", "regions", "terrains", "subjects", "terms", "understood")], "structured")


def user_signals(spark, sf_dir):  # noqa: ANN001, ANN201
    a = _answers(spark)
    s = interpret.of_users(interpret.interpret(a, _words(spark, sf_dir)), a)
    return s.select("user_id", F.array_join("states", "|").alias("states"), F.array_join("subjects", "|").alias("subjects"), F.array_join("spoken", "|").alias("spoken"), interpret.is_empty().alias("empty"))


def entity_split(spark, sf_dir):  # noqa: ANN001, ANN201
    titles = table(spark, sf_dir, "playlist_resolved").where("title is not null")
    return titles.select("playlist_id", F.array_join(interpret.split_entities(F.col("title")), " ; ").alias("parts"))


def word_aliases(spark, sf_dir):  # noqa: ANN001, ANN201
    aliases = F.create_map(F.lit("river"), F.lit("nadi"), F.lit("birds"), F.lit("pakshi"))
    titles = table(spark, sf_dir, "playlist_resolved").where("title is not null")
    return titles.select("playlist_id", interpret.apply_aliases(F.col("title"), aliases).alias("aliased"))


def place_weight(spark, sf_dir):  # noqa: ANN001, ANN201
    return recommend.place_weights(_clips(spark, sf_dir))


def _signals(spark):  # noqa: ANN001, ANN202
    return spark.createDataFrame(SIGNALS, "user_id int, places array<string>, states array<string>, regions array<string>, terrains array<string>, subjects array<string>")


def structural_score(spark, sf_dir):  # noqa: ANN001, ANN201
    return recommend.structural_scores(_signals(spark), _clips(spark, sf_dir), _places(spark, sf_dir)).select("user_id", "id", "score")


def _home_scores(spark, sf_dir):  # noqa: ANN001, ANN202
    home = _home(spark, sf_dir)
    return recommend.structural_scores(_signals(spark), _clips(spark, sf_dir), _places(spark, sf_dir)).join(home.where("home").select("id"), "id", "left_semi")


def place_tally(spark, sf_dir):  # noqa: ANN001, ANN201
    return recommend.tally(_home_scores(spark, sf_dir), F.col("place_id"), 10, 2)


def subject_tally(spark, sf_dir):  # noqa: ANN001, ANN201
    return recommend.tally(_home_scores(spark, sf_dir), F.explode("subjects"), 8)


BOOSTED = [(1, "wooden toys"), (1, "potters"), (2, "betel leaves")]


def thin_pages(spark, sf_dir):  # noqa: ANN001, ANN201
    """Users whose page would hold fewer than three clips of nine points or more."""
    picked = _home_scores(spark, sf_dir).where("score >= 9").select("user_id", "id")
    return recommend.thin(_signals(spark).withColumn("terms", F.array().cast("array<string>")), picked)


def text_boost(spark, sf_dir):  # noqa: ANN001, ANN201
    built, clips = _opened(spark, sf_dir)
    terms = spark.createDataFrame(BOOSTED, "user_id int, term string")
    return recommend.text_boosts(terms, built, clips)


def context_filter(spark, sf_dir):  # noqa: ANN001, ANN201
    arr = lambda *w: F.array(*[F.lit(x) for x in w])
    clips = _clips(spark, sf_dir)
    return clips.where(recommend.in_context(F.col("title"), F.col("subjects"), arr("crafts", "village"), arr("potter", "weav"), arr("quarter", "fog"))).select("id")


def rank_by_answer(spark, sf_dir):  # noqa: ANN001, ANN201
    """Clips by the summed rarity of two words in their titles; the ten best."""
    built, clips = _opened(spark, sf_dir)
    rare = index.term_rarity(spark.createDataFrame([("potters",), ("dusk",)], "phrase string"), built)
    weights = rare.agg(F.sort_array(F.collect_list(F.struct(F.col("phrase").alias("word"), "rarity"))).alias("weights"))
    scored = clips.select("id", "title").crossJoin(F.broadcast(weights)).select("id", "title", recommend.answer_score(F.col("title"), F.col("weights")).alias("score"))
    return scored.orderBy(F.desc("score"), F.length("title"), "id").limit(10).select("id", "score")


def interleaved(spark, sf_dir):  # noqa: ANN001, ANN201
    """The clips of two subjects in turn, in archive order."""
    tags = _clips(spark, sf_dir).select("id", F.explode("subjects").alias("s")).where(F.col("s").isin("boats", "fort"))
    lists = interpret.ranked_within(tags, "s", [F.col("id")], "ord").select(F.lit(1).alias("answer_id"), F.when(F.col("s") == "boats", 0).otherwise(1).alias("list_no"), "ord", "id")
    return recommend.interleave(lists)


def shoot_similarity(spark, sf_dir):  # noqa: ANN001, ANN201
    """Pairs of clips of one upload day and how alike their titles are."""
    c = _clips(spark, sf_dir).where("uploaded_at is not null").select("id", "title", "place_id", F.substring("uploaded_at", 1, 10).alias("uploaded_at"))
    d = c.select(F.col("id").alias("id_b"), F.col("title").alias("title_b"), F.col("place_id").alias("place_b"), "uploaded_at")
    same = F.coalesce(F.col("place_id") == F.col("place_b"), F.lit(False))
    pairs = c.join(d, "uploaded_at").where("id < id_b")
    return pairs.select("id", "id_b", F.round(recommend.shoot_similarity(F.col("title"), F.col("title_b"), same), 6).alias("alike"))


def _asks(spark, sf_dir):  # noqa: ANN001, ANN202
    """One ask for each entity of each answer, with its own signals."""
    a = _answers(spark).where("trim(answer) <> ''")
    parts = a.select("*", F.posexplode(interpret.split_entities(F.col("answer"))).alias("part", "entity"))
    parts = parts.withColumn("ask_id", F.col("answer_id") * 100 + F.col("part"))
    s = interpret.interpret(parts.select(F.col("ask_id").alias("answer_id"), "kind", F.col("entity").alias("answer")), _words(spark, sf_dir)).withColumnRenamed("answer_id", "ask_id")
    longest = F.aggregate("terms", F.lit(""), lambda x, t: F.when(F.length(t) > F.length(x), t).otherwise(x))
    own = parts.select("ask_id", "answer_id", "user_id", "at", "part", F.col("entity").alias("answer"), F.col("answer").alias("whole"), "c_subjects", "c_words", "c_not")
    return own.join(s.select("ask_id", "places", "states", "subjects", "regions", longest.alias("longest")), "ask_id").withColumn("query", F.when(F.col("longest") != "", F.col("longest")).otherwise(F.col("answer")))


def feed(spark, sf_dir):  # noqa: ANN001, ANN201
    """Five clips for each answer of each user, with the reason."""
    built, clips = _opened(spark, sf_dir)
    home, places = cut(_home(spark, sf_dir)), cut(_places(spark, sf_dir))
    asks, protected = _asks(spark, sf_dir), search.protected_words(_places(spark, sf_dir))
    asks = cut(asks)
    questions = asks.groupBy("user_id").agg(F.countDistinct("at").alias("n")).agg(F.max("n").alias("n")).first().n or 1
    found = recommend.candidates(asks, built, home, places, protected, search.variants(spark), questions=questions)
    lists = found.join(asks.select("ask_id", "answer_id", "part"), "ask_id").select("answer_id", F.col("part").alias("list_no"), "ord", "id")
    pools = recommend.interleave(lists).join(asks.select("answer_id", "user_id", "at", F.col("whole").alias("query")).distinct(), "answer_id")
    pools = pools.join(clips.select("id", "title", "place_id", "uploaded_at", "subjects"), "id")
    picked = recommend.picks(pools.select("user_id", "at", "query", "ord", "id", "title", "place_id", "uploaded_at"))
    answers = _answers(spark)
    why = recommend.needles(answers.select(F.col("answer_id").alias("ask_id"), "answer"), built, protected).withColumnRenamed("ask_id", "answer_id")
    s = interpret.interpret(answers, _words(spark, sf_dir)).select("answer_id", "places", F.col("subjects").alias("own"))
    full = picked.join(answers.select("answer_id", "user_id", "at", F.coalesce("c_subjects", F.array().cast("array<string>")).alias("context")), ["user_id", "at"])
    full = full.join(why, "answer_id").join(s, "answer_id").join(clips.select("id", "title", "place_id", "subjects"), "id")
    reason = recommend.reason(F.col("title"), F.col("place_id"), F.col("subjects"), F.col("needles"), F.col("places"), F.col("own"), F.col("context"))
    return full.select("user_id", "at", "slot", "id", "more", reason.alias("reason"))


def summaries(spark, sf_dir):  # noqa: ANN001, ANN201
    a = _answers(spark)
    return recommend.summary(interpret.of_users(interpret.interpret(a, _words(spark, sf_dir)), a), _places(spark, sf_dir))


def clean_titles(spark, sf_dir):  # noqa: ANN001, ANN201
    titles = table(spark, sf_dir, "youtube_items").where("title is not null").select("log_id", "title")
    cleaned = describe.clean_title(F.col("title"))
    return titles.select("log_id", cleaned.alias("cleaned"))


def clip_cards(spark, sf_dir):  # noqa: ANN001, ANN201
    return describe.cards(_clips(spark, sf_dir), _places(spark, sf_dir))


def blurbs(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", describe.blurb(F.col("text")).alias("blurb"))


QUESTIONS = ("city", "craft", "season")


def _coded(spark, sf_dir):  # noqa: ANN001, ANN202
    t = table(spark, sf_dir, "playlist_resolved").where("title is not null").select("playlist_id", "title", "channel_title")
    answers = F.create_map(F.lit("city"), F.col("title"), F.lit("season"), F.coalesce("channel_title", F.lit("")))
    return t.withColumn("answers", answers)


def share_codec(spark, sf_dir):  # noqa: ANN001, ANN201
    """Titles through the share text and back."""
    t = _coded(spark, sf_dir).withColumn("back", codecs.decode_share(codecs.encode_share(F.col("answers"), QUESTIONS), QUESTIONS))
    return t.select("playlist_id", F.try_element_at("back", F.lit("city")).alias("city"), F.try_element_at("back", F.lit("season")).alias("season"))


def cookie_codec(spark, sf_dir):  # noqa: ANN001, ANN201
    """Titles through the cookie and back."""
    t = _coded(spark, sf_dir).withColumn("back", codecs.decode_cookie(codecs.encode_cookie(F.col("answers")), QUESTIONS))
    return t.select("playlist_id", F.try_element_at("back", F.lit("city")).alias("city"), F.try_element_at("back", F.lit("season")).alias("season"))


def slugs(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = [("Street-Food",), ("old%20town",), ("BOATS",), ("nothing",), ("%zz",)]
    return spark.createDataFrame(rows, "slug string").select("slug", codecs.subject_of_slug(F.col("slug"), vocab.SUBJECTS).alias("subject"))


_SIG = ", ".join(f"({u}, {p!r}::VARCHAR[], {s!r}::VARCHAR[], {r!r}::VARCHAR[], {t!r}::VARCHAR[], {j!r}::VARCHAR[])" for u, p, s, r, t, j in SIGNALS)
_SCORE = f"""pw AS (SELECT place_id, round(least(1.6, greatest(0.6, ln(1 + (SELECT count(*) FROM arch) / count(*)) / 3.6)), 6) AS weight FROM arch WHERE place_id IS NOT NULL GROUP BY 1),
sg AS (SELECT * FROM (VALUES {_SIG}) v(user_id, s_places, s_states, s_regions, s_terrains, s_subjects)),
cs AS (SELECT user_id, arch.id, arch.place_id, subjects, round(CASE WHEN pl.id IS NOT NULL AND list_contains(s_places, arch.place_id) THEN 7.0 * pw.weight WHEN list_contains(s_states, pl.state) THEN 5.0 WHEN list_contains(s_regions, pl.region) THEN 2.0 ELSE 0.0 END
  + CASE WHEN list_contains(s_terrains, terrain) THEN 3.0 ELSE 0.0 END + 4.0 * len(list_intersect(subjects, s_subjects)), 6) AS score
  FROM arch LEFT JOIN pl ON pl.id = arch.place_id LEFT JOIN pw ON pw.place_id = arch.place_id CROSS JOIN sg)"""
_HS = f"WITH {_HOME}, {_SCORE}, hs AS (SELECT cs.* FROM cs JOIN hm ON hm.id = cs.id WHERE home AND score > 0)"
_NORM = r"trim(regexp_replace(lower(title), '[^\p{L}\p{N}]+', ' ', 'g'))"

_US = r"[\s\v\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_US}+|{_US}+$', '', 'g')"


def _sql_clean(title: str) -> str:
    """CTEs c1 to c4 over t (log_id, title): c4 (log_id, cleaned)."""
    t = title
    for p in vocab.TITLE_JUNK:
        t = f"regexp_replace({t}, '{p}', ' ', 'g')"
    return rf"""c1 AS (SELECT *, {t} AS t1 FROM t), c2 AS (SELECT *, list_filter(list_transform(string_split(t1, '|'), lambda p: {_sql_trim('p')}), lambda p: p <> '') AS ps FROM c1),
c3 AS (SELECT *, CASE WHEN contains(t1, '|') AND len(ps) > 0 THEN list_filter(ps, lambda p: length(p) = list_max(list_transform(ps, lambda x: length(x))))[1] ELSE t1 END AS t3 FROM c2),
c4 AS (SELECT * EXCLUDE (t1, ps, t3), {_sql_trim(f"regexp_replace(regexp_replace(regexp_replace(t3, '{_US}{{2,}}', ' ', 'g'), '{_US}+([,.:;])', chr(92) || '1', 'g'), '^(?:{_US}|[-–—:,.])+|(?:{_US}|[-–—:,])+$', '', 'g')")} AS cleaned FROM c3)"""


_PARTS = rf"""p0 AS (SELECT playlist_id, title, list_filter(list_transform(string_split_regex(title, '(?i){_US}*(?:,|/|&|\band\b){_US}*'), lambda p: {_sql_trim('p')}), lambda p: len({tx.sql_meaningful('p')}) > 0) AS ps
  FROM playlist_resolved WHERE title IS NOT NULL)"""
_BLURB = r"""b1 AS (SELECT id, text, {t} AS t FROM {src}), b2 AS (SELECT *, left(t, 240) AS h FROM b1), b3 AS (SELECT *, CASE WHEN contains(h, '. ') THEN length(h) - instr(reverse(h), ' .') - 1 ELSE -1 END AS stop FROM b2),
b4 AS (SELECT id, CASE WHEN length(t) < 40 THEN NULL WHEN length(t) <= 240 THEN t WHEN stop > 90 THEN left(h, stop + 1) ELSE regexp_replace(h, '{us}+$', '') || '…' END AS blurb FROM b3)"""
_BLURB = _BLURB.replace("{t}", _sql_trim("regexp_replace(text, '" + vocab.BOILERPLATE + "', '')")).replace("{us}", _US)
_FOREIGN = r"[^\p{Latin}\p{N}\p{P}\p{Z}]"
_CARDS = f"""t AS (SELECT arch.id, title, text, subjects, name, state, district, country FROM arch LEFT JOIN pl ON pl.id = arch.place_id), {_sql_clean('title')},
d1 AS (SELECT *, CASE {' '.join(f"WHEN subjects[1] = '{k}' THEN '{v}'" for k, v in vocab.SUBJECT_PHRASES.items())} ELSE 'Archive footage' END AS sp FROM c4),
d2 AS (SELECT *, coalesce(contains(lower(cleaned), lower(name)) OR contains(lower(cleaned), lower(state)) OR coalesce(contains(lower(cleaned), lower(district)), false)
    OR (length(left(lower(name), 6)) >= 5 AND contains(lower(cleaned), left(lower(name), 6))), false) AS named,
  len(list_filter(string_split_regex(cleaned, '{_US}+'), lambda w: length(w) > 1)) > 0 AND (regexp_matches(cleaned, '{_FOREIGN}') OR regexp_matches(cleaned, '[a-z]{{3}}')) AS fit FROM d1),
d3 AS (SELECT *, CASE WHEN NOT fit THEN CASE WHEN name IS NULL THEN sp ELSE sp || ' in ' || name END
  WHEN NOT regexp_matches(cleaned, '{_FOREIGN}') AND name IS NOT NULL AND NOT named THEN regexp_replace(cleaned, '[.,;:!?]+$', '') || ', in ' || name ELSE cleaned END AS s FROM d2),
d4 AS (SELECT *, upper(s[1]) || s[2:] AS sentence FROM d3), d5 AS (SELECT *, contains(lower(sentence), lower(name)) AS said FROM d4),
d6 AS (SELECT id, sentence, CASE WHEN name IS NULL THEN NULL WHEN country IS NOT NULL AND country <> '' AND country <> 'India'
  THEN CASE WHEN name = country THEN CASE WHEN NOT said THEN country END WHEN said THEN country ELSE name || ', ' || country END
  ELSE CASE WHEN said THEN CASE WHEN name <> state THEN state END WHEN name = state THEN state ELSE name || ', ' || state END END AS location FROM d5)"""

_FUNCS = (
    normalise, ngram_dictionary, greedy_match, user_signals, entity_split, word_aliases, place_weight, structural_score, place_tally, subject_tally, thin_pages, text_boost,
    context_filter, rank_by_answer, interleaved, shoot_similarity, feed, summaries, clean_titles, clip_cards, blurbs, share_codec, cookie_codec, slugs,
)
QUERIES = {f.__name__: f for f in _FUNCS}
SQL = {
    "normalise": f"SELECT playlist_id, {_NORM} AS plain FROM playlist_resolved WHERE title IS NOT NULL",
    "ngram_dictionary": f"""WITH t AS (SELECT playlist_id, string_split({_NORM}, ' ') AS w FROM playlist_resolved WHERE title IS NOT NULL),
g AS (SELECT playlist_id, i::INTEGER AS start, k::INTEGER AS size, array_to_string(w[i + 1 : i + k], ' ') AS phrase FROM t, unnest(range(1, 5)) a(k), unnest(range(0, len(w))) b(i) WHERE i + k <= len(w))
SELECT playlist_id, start, size, phrase FROM g WHERE phrase IN (SELECT place_key FROM gazetteer)""",
    "entity_split": f"""WITH {_PARTS} SELECT playlist_id, CASE WHEN len(ps) > 1 THEN array_to_string(list_filter(ps, lambda p, i: list_position(ps, p) = i), ' ; ') ELSE title END AS parts FROM p0""",
    "word_aliases": """SELECT playlist_id, array_to_string(list_transform(regexp_extract_all(title, '[A-Za-z]+|[^A-Za-z]+'), lambda p: CASE lower(p) WHEN 'river' THEN 'nadi' WHEN 'birds' THEN 'pakshi' ELSE p END), '') AS aliased
FROM playlist_resolved WHERE title IS NOT NULL""",
    "clean_titles": f"WITH t AS (SELECT log_id, title FROM youtube_items WHERE title IS NOT NULL), {_sql_clean('title')} SELECT log_id, cleaned FROM c4",
    "clip_cards": f"WITH {_ARCH}, {_PL}, {_CARDS}, {_BLURB.replace('{src}', 'arch')} SELECT d6.id, sentence, location, blurb FROM d6 JOIN b4 ON b4.id = d6.id",
    "text_boost": f"""WITH {full_sql([(i, q) for i, (_, q) in enumerate(BOOSTED)], 120)},
n AS (SELECT query_id, count(*) AS hits FROM ranked GROUP BY 1),
w AS (SELECT query_id, max(ln(1 + (n_docs - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5))) AS w FROM q0 LEFT JOIN terms ON terms.term = q0.term CROSS JOIN stats GROUP BY 1),
u AS (SELECT * FROM (VALUES {', '.join(f"({i}, {u})" for i, (u, _) in enumerate(BOOSTED))}) v(query_id, user_id))
SELECT user_id, id, round(least(2.0, sum((1 - (rank - 1) / hits) * least(1.6, greatest(0.35, w / 4.5)))), 6) AS boost FROM ranked JOIN n USING (query_id) JOIN w USING (query_id) JOIN u USING (query_id) GROUP BY 1, 2""",
    "rank_by_answer": f"""WITH {_INDEX}, w AS (SELECT * FROM (VALUES ('potters'), ('dusk')) v(word)), r AS (SELECT word, {tx.sql_tokens('word')}[1] AS t FROM w),
x AS (SELECT word, least(1.6, greatest(0.35, ln(1 + (n_docs - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) / 4.5)) AS rarity FROM r LEFT JOIN terms ON terms.term = t CROSS JOIN stats)
SELECT id, round((SELECT coalesce(sum(rarity), 0) FROM x WHERE contains(lower(title), word)), 6) AS score FROM arch ORDER BY score DESC, length(title), id LIMIT 10""",
    "place_weight": f"""WITH {_ARCH} SELECT place_id, round(least(1.6, greatest(0.6, ln(1 + (SELECT count(*) FROM arch) / count(*)) / 3.6)), 6) AS weight FROM arch WHERE place_id IS NOT NULL GROUP BY 1""",
    "structural_score": f"WITH {_ARCH}, {_PL}, {_SCORE} SELECT user_id, id, score FROM cs WHERE score > 0",
    "place_tally": f"""{_HS}, t AS (SELECT user_id, place_id AS value, count(*) AS n, min((-score, id)) AS first FROM hs WHERE place_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT user_id, value, n FROM t QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first, value) <= 10""",
    "subject_tally": f"""{_HS}, u AS (SELECT user_id, unnest(subjects) AS value, score, id FROM hs), t AS (SELECT user_id, value, count(*) AS n, min((-score, id)) AS first FROM u GROUP BY 1, 2)
SELECT user_id, value, n FROM t QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first, value) <= 8""",
    "thin_pages": f"""{_HS}, n AS (SELECT user_id, count(*) AS n FROM hs WHERE score >= 9 GROUP BY 1)
SELECT sg.user_id, len(s_places) + len(s_states) + len(s_regions) + len(s_terrains) + len(s_subjects) = 0 OR coalesce(n, 0) < 3 AS thin FROM sg LEFT JOIN n ON n.user_id = sg.user_id""",
    "context_filter": f"""WITH {_ARCH} SELECT id FROM arch WHERE NOT regexp_matches(title, '(?i)\\b(quarter|fog)') AND (list_has_any(subjects, ['crafts', 'village']) OR regexp_matches(title, '(?i)\\b(potter|weav)'))""",
    "interleaved": f"""WITH {_ARCH}, s AS (SELECT id, unnest(subjects) AS s FROM arch), l AS (SELECT id, CASE s WHEN 'boats' THEN 0 ELSE 1 END AS list_no, row_number() OVER (PARTITION BY s ORDER BY id) AS o
  FROM s WHERE s IN ('boats', 'fort')), f AS (SELECT id, min((o, list_no)) AS k FROM l GROUP BY 1) SELECT 1 AS answer_id, row_number() OVER (ORDER BY k, id)::INTEGER AS ord, id FROM f""",
    "shoot_similarity": f"""WITH {_ARCH}, m AS (SELECT id, place_id, left(uploaded_at, 10) AS uploaded_at, list_distinct({tx.sql_meaningful('title')}) AS w FROM arch WHERE uploaded_at IS NOT NULL)
SELECT a.id, b.id AS id_b, round(CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0 ELSE least(1.0, len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))
  + CASE WHEN a.place_id = b.place_id THEN 0.1 ELSE 0 END) END, 6) AS alike FROM m a JOIN m b ON a.uploaded_at = b.uploaded_at AND a.id < b.id""",
    "blurbs": r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?is)\s*(?:This (?:footage|video) is part of|The collection comprises)\b.*$', ''),
  '^[\s\v\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+|[\s\v\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, t, left(t, 240) AS h FROM t), s AS (SELECT *, CASE WHEN contains(h, '. ') THEN length(h) - instr(reverse(h), ' .') - 1 ELSE -1 END AS stop FROM h)
SELECT doc_id, CASE WHEN length(t) < 40 THEN NULL WHEN length(t) <= 240 THEN t WHEN stop > 90 THEN left(h, stop + 1) ELSE rtrim(h, ' ' || chr(10) || chr(13) || chr(9) || chr(160)) || '…' END AS blurb FROM s""",
    "share_codec": """SELECT playlist_id, nullif(left(trim(replace(left(trim(title), 120), '~', ' ')), 120), '') AS city, nullif(left(trim(channel_title), 120), '') AS season FROM playlist_resolved WHERE title IS NOT NULL""",
    "cookie_codec": """SELECT playlist_id, nullif(left(trim(title), 120), '') AS city, nullif(left(trim(channel_title), 120), '') AS season FROM playlist_resolved WHERE title IS NOT NULL""",
    "slugs": "SELECT * FROM (VALUES ('Street-Food', 'street food'), ('old%20town', 'old town'), ('BOATS', 'boats'), ('nothing', NULL), ('%zz', NULL)) v(slug, subject)",
}
