"""Queries over the inverted index and the ranked search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.functions import vocab
from lodestar.operators import archive, index, search
from lodestar.session import checkpoint_dir, shared_folder, table

#: A batch of searches; some are misspelt, over-specified, common or empty.
BATCH = [
    (1, "wooden toys"), (2, "Carpenters of the goods yard"), (3, "kite makers polishing brass lamps before sunrise"), (4, "the of and"),
    (5, "fishermun netss"), (6, "Slow pan"), (7, "stonecutters"), (8, "betel leaves market day harvest temple"), (9, "interviews with grandmothers"),
    (10, "mandir mosque masjid"), (11, ""), (12, "salt pans salt pans"), (13, "buffalos"), (14, "zzzzqq"), (15, "railway bridge at dusk"),
]


def _opened(spark: SparkSession, sf_dir: str) -> tuple[index.Index, DataFrame]:
    """The written index of the archive and its clips, built if they are not there."""
    return index.opened(table(spark, sf_dir, "clips"), lambda raw: archive.first_clips(archive.clips_of(raw)), shared_folder(spark))


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.first_clips(archive.clips_of(table(spark, sf_dir, "clips")))


def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index built from the raw archive, written, and read back: its statistics."""
    folder = f"{checkpoint_dir(spark)}/built"
    index.save(index.build(_clips(spark, sf_dir)), folder, "built")
    found = index.load(spark, folder, "built")
    assert found is not None and index.load(spark, folder, "another") is None
    counts = found.postings.agg(F.count("*").alias("read_postings"), F.sum("tf").alias("read_tf"))
    return found.stats.select("n_docs", "n_terms", "n_postings").crossJoin(counts).crossJoin(found.terms.agg(F.sum("cf").alias("read_cf")))


def _batch(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BATCH, "query_id int, query string")


def tokens_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clips(spark, sf_dir).select("id", F.size(tx.tokens(F.col("title"))).alias("in_title"), F.size(tx.tokens(F.col("text"))).alias("in_text"))


def stem_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _clips(spark, sf_dir).select(F.explode(tx.content_words(F.concat_ws(" ", "title", "text"))).alias("word")).distinct()
    return words.select("word", tx.stem(F.col("word")).alias("stem"))


def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.build(_clips(spark, sf_dir)).terms


def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.build(_clips(spark, sf_dir)).docs


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.build(_clips(spark, sf_dir)).postings


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = index.build(_clips(spark, sf_dir)).stats
    return s.select("n_docs", F.round("avg_len", 6).alias("avg_len"), "n_terms", "n_postings")


def term_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = _batch(spark).select(F.col("query").alias("phrase"))
    return index.term_rarity(phrases, _opened(spark, sf_dir)[0]).select("phrase", F.round("rarity", 6).alias("rarity"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain ranking: no repair, spellings, demotion or phrases."""
    built, clips = _opened(spark, sf_dir)
    return search.search(_batch(spark), built, clips, 20, demote=False, phrases=False)


def bm25_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    built, clips = _opened(spark, sf_dir)
    return search.search(_batch(spark), built, clips, 20, spellings=search.variants(spark), demote=False, phrases=False)


def spell_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = _opened(spark, sf_dir)[0]
    protected = search.protected_words(archive.places_of(table(spark, sf_dir, "places")))
    typed = spark.createDataFrame([(w,) for w in TYPED], "term string")
    return search.repairs(typed, built.terms, protected)


TYPED = ("fishermun", "carpentrs", "stonecuter", "grandmothes", "marigold", "buffallo", "railwya", "mornng", "templ", "kit", "harvst", "sunrice", "bazar", "bulockss")


def match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched positions of every document before the relaxation."""
    clips = _clips(spark, sf_dir)
    return search.scores(search.query_terms(_batch(spark)), index.build(clips), None).select("query_id", "id", "matches")


def required_relaxation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each query keeps and the fewest terms that one of them satisfies."""
    terms = search.query_terms(_batch(spark))
    found = search.relaxed(search.scores(terms, _opened(spark, sf_dir)[0], None), terms)
    return found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("matches").alias("least"))


def phrase_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    built, clips = _opened(spark, sf_dir)
    return search.search(_batch(spark), built, clips, 20, demote=False)


def talking_head_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "youtube_items").where("title is not null").select("log_id", "title")
    more = spark.createDataFrame(SPEAKING_PROBES, "log_id long, title string")
    return titles.unionByName(more).where(search.speaking(F.col("title"))).select("log_id")


SPEAKING_PROBES = [
    (-1, "A potter talks about clay"), (-2, "Asha: My first kiln"), (-3, "Press meet at the fort"), (-4, "Talking Heads of stone"), (-5, "Interviewers wanted"),
    (-6, "Meera Rao: the film and the river"), (-7, "Chandni Chowk: busy market morning"), (-8, "Co-stars at dusk"), (-9, "A music launch by the lake"),
]


def talking_head_demote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries whose people speaking to the camera would be moved down."""
    batch = _batch(spark)
    return search.demoted_queries(batch, search.query_terms(batch), _opened(spark, sf_dir)[0])


def count_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    built, clips = _opened(spark, sf_dir)
    return search.count_matches(_batch(spark), built, clips)


def collision_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one-word queries and titles that stay, with rules for this archive."""
    asked = spark.createDataFrame([(1, "kingfishers"), (2, "Potters"), (3, "potters quarter")], "query_id int, query string")
    titles = _clips(spark, sf_dir).select("id", "title", "text")
    rules = ((r"(?i)^kingfishers$", r"(?i)kingfishers\s+at"), (r"(?i)^potters$", r"(?i)potters\s+quarter\b"))
    return search.not_colliding(titles.crossJoin(F.broadcast(asked)), rules).select("query_id", "id")


def search_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search as a user meets it: repair, spellings, relaxation, demotion, phrases, collisions."""
    built, clips = _opened(spark, sf_dir)
    protected = search.protected_words(archive.places_of(table(spark, sf_dir, "places")))
    found = search.search(_batch(spark), built, clips, 60, protected, search.variants(spark))
    return found.withColumn("score", F.round("score", 4))


#: One-word searches whose commonest titles a rule leaves out.
COLLIDING = [(1, "potters"), (2, "Kingfishers "), (3, "dusk"), (4, "potters dusk")]
COLLIDING_RULES = ((r"(?i)^potters$", r"(?i)potters\s+(?:[a-m]|quarter\b)"), (r"(?i)^kingfishers$", r"(?i)kingfishers\s+at"), (r"(?i)^dusk$", r"(?i)\bat\s+dusk"))


def search_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches of which the rules leave out most hits: all others come out, however far down they stood."""
    built, clips = _opened(spark, sf_dir)
    asked = spark.createDataFrame(COLLIDING, "query_id int, query string")
    return search.search(asked, built, clips, 60, rules=COLLIDING_RULES)


_ARCH = """arch AS (SELECT clip_id AS id, coalesce(title, '') AS title, coalesce(text, '') AS text, place_id, coalesce(subjects, []) AS subjects,
  shot_year AS year, uploaded_at, is_placeholder FROM clips WHERE clip_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY uploaded_at NULLS LAST, coalesce(title, ''), coalesce(text, ''), place_id NULLS LAST,
    shot_year NULLS LAST, array_to_string(coalesce(subjects, []), '|')) = 1)"""
_INDEX = f"""{_ARCH},
occ AS (SELECT id, unnest({tx.sql_tokens('title')}) AS term, 3 AS w FROM arch UNION ALL SELECT id, unnest({tx.sql_tokens('text')}) AS term, 1 AS w FROM arch),
post AS (SELECT id, term, sum(w)::INTEGER AS tf FROM occ GROUP BY 1, 2),
docs AS (SELECT id, sum(tf)::BIGINT AS len FROM post GROUP BY 1),
terms AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY 1),
stats AS (SELECT count(*) AS n_docs, avg(len) AS avg_len FROM docs)"""
_VALUES = ", ".join(f"({i}, '{q}')" for i, q in BATCH)
_QUERY = f"""q AS (SELECT * FROM (VALUES {_VALUES}) v(query_id, query)),
qt AS (SELECT query_id, unnest(t) AS term, generate_subscripts(t, 1) AS ix FROM (SELECT query_id, {tx.sql_tokens('query')} AS t FROM q))"""
_VARIANTS = """va AS (SELECT term, variant FROM (VALUES {rows}) v(term, variant)),
qv AS (SELECT query_id, ix, coalesce(variant, qt.term) AS term FROM qt LEFT JOIN va ON va.term = qt.term)"""
_SCORED = """sc AS (SELECT query_id, p.id, ix, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * len / avg_len)))) AS s
  FROM {qt} qq JOIN terms t ON t.term = qq.term JOIN post p ON p.term = qq.term JOIN docs d ON d.id = p.id CROSS JOIN stats GROUP BY 1, 2, 3),
found AS (SELECT query_id, id, round(sum(s), 6) AS score, count(*) AS matches FROM sc GROUP BY 1, 2),
req AS (SELECT query_id, CASE WHEN count(*) <= 2 THEN count(*) ELSE ceil(count(*) * 0.6)::BIGINT END AS required FROM qt GROUP BY 1),
need AS (SELECT query_id, coalesce(max(k) FILTER (n >= 8), 1) AS need FROM (
    SELECT req.query_id, k, (SELECT count(*) FROM found f WHERE f.query_id = req.query_id AND f.matches >= k) AS n
    FROM req, unnest(range(1, required + 1)) u(k)) GROUP BY 1),
kept AS (SELECT found.* FROM found JOIN need ON need.query_id = found.query_id WHERE matches >= need)"""


def _variant_rows() -> str:
    stem = lambda w: vocab.IRREGULAR.get(w) or (
        w[:-3] + "y" if len(w) > 4 and w.endswith("ies") else w[:-2] if len(w) > 4 and w.endswith("sses") else w if w.endswith("ss")
        else w[:-1] if len(w) > 3 and w.endswith("s") else w
    )
    groups: dict[str, list[str]] = {}
    for a, c in vocab.SYNONYMS.items():
        own = groups.setdefault(stem(c), [stem(c)])
        if stem(a) not in own:
            own.append(stem(a))
    member = {m: own for own in groups.values() for m in own}
    return ", ".join(f"('{m}', '{v}')" for m, own in member.items() for v in own)


_PLAIN = f"WITH {_INDEX}, {_QUERY}, {_SCORED.format(qt='qt')}"
_TOP = "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank, id, score FROM kept QUALIFY rank <= 20"


def full_sql(rows: list[tuple[int, str]], limit: int, repair: bool = False, spellings: bool = False, rules: tuple[tuple[str, str], ...] = vocab.COLLISIONS) -> str:
    """CTEs of a whole search, the last being ranked (query_id, rank, id, score)."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quoted(q)})" for i, q in rows)
    typed = f"""q AS (SELECT * FROM (VALUES {values}) v(query_id, query)),
q0 AS (SELECT query_id, unnest(t) AS term, generate_subscripts(t, 1) AS ix FROM (SELECT query_id, {tx.sql_tokens('query')} AS t FROM q)),
pw AS (SELECT DISTINCT unnest({tx.sql_words('name')}) AS w FROM (SELECT place_name AS name FROM places UNION ALL SELECT unnest([{tx.sql_list(vocab.SUBJECTS)}]))),
ow AS (SELECT t.term, coalesce((SELECT df FROM terms x WHERE x.term = t.term), 0) AS own, coalesce((SELECT df FROM terms x WHERE x.term = {tx.sql_stem('t.term')}), 0) AS sdf
  FROM (SELECT DISTINCT term FROM q0) t),
rc AS (SELECT ow.term, x.term AS word, x.df, levenshtein(ow.term, x.term) AS d FROM ow JOIN terms x ON left(x.term, 2) = left(ow.term, 2) AND x.term <> ow.term
  WHERE {repair} AND length(ow.term) >= 4 AND greatest(own, sdf) <= 3 AND ow.term NOT IN (SELECT w FROM pw WHERE length(w) >= 4) AND length(x.term) >= 4 AND x.df >= greatest(8, 8 * own)),
rp AS (SELECT term, word FROM rc WHERE d <= CASE WHEN length(term) >= 7 THEN 2 ELSE 1 END QUALIFY row_number() OVER (PARTITION BY term ORDER BY df / d DESC, word) = 1),
qt AS (SELECT query_id, ix, coalesce(word, q0.term) AS term FROM q0 LEFT JOIN rp ON rp.term = q0.term)"""
    spelt = _VARIANTS.format(rows=_variant_rows() if spellings else "('', '')")
    clash = " OR ".join(f"(regexp_matches(trim(query), {quoted(a)}) AND regexp_matches(title || ' ' || text, {quoted(b)}))" for a, b in rules)
    return f"""{_INDEX}, {typed}, {spelt}, {_SCORED.format(qt='qv')},
da AS (SELECT query_id, ix, {tx.sql_tokens('term')} AS t FROM qt),
du AS (SELECT query_id, ix, unnest(t) AS term FROM da UNION ALL SELECT query_id, ix, NULL FROM da WHERE len(t) = 0),
dr AS (SELECT query_id, ix, coalesce(least(1.6, greatest(0.35, max(CASE WHEN du.term IS NOT NULL THEN ln(1 + (n_docs - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) END) / 4.5)), 1.0) AS r
  FROM du LEFT JOIN terms ON terms.term = du.term CROSS JOIN stats GROUP BY 1, 2),
dn AS (SELECT q.query_id FROM q JOIN (SELECT query_id FROM dr GROUP BY 1 HAVING max(r) < 1.15) m ON m.query_id = q.query_id WHERE NOT {tx.sql_any('query', (vocab.ASKS_SPEAKING,))}),
al AS (SELECT kept.query_id, query, kept.id, title, CASE WHEN kept.query_id IN (SELECT query_id FROM dn) AND {tx.sql_any('title', vocab.SPEAKING)} THEN round(score * 0.3, 6) ELSE score END AS score
  FROM kept JOIN q ON q.query_id = kept.query_id JOIN arch ON arch.id = kept.id WHERE NOT ({clash})),
bs AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS base, {tx.sql_words('query')} AS qw FROM al),
bo AS (SELECT *, CASE WHEN base <= 400 THEN round(score * (1 + 0.35 * len(list_filter(range(1, len(qw)), lambda i: contains(lower(title), qw[i] || ' ' || qw[i + 1])))), 6) ELSE score END AS s FROM bs),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY base > 400, s DESC, base)::INTEGER AS rank, id, s AS score FROM bo QUALIFY rank <= {limit})"""


_TYPED = ", ".join(f"('{w}')" for w in TYPED)
_PROBES = ", ".join(f"({i}, '{t}')" for i, t in SPEAKING_PROBES)

QUERIES = {
    f.__name__: f
    for f in (
        index_build, tokens_per_doc, stem_table, term_df, doc_lengths, postings, index_stats, term_rarity, bm25_topk, bm25_synonyms, spell_repair, match_counts,
        required_relaxation, phrase_promotion, talking_head_titles, talking_head_demote, count_matches, collision_filter, search_full, search_collisions,
    )
}
SQL = {
    "tokens_per_doc": f"WITH {_ARCH} SELECT id, len({tx.sql_tokens('title')})::INTEGER AS in_title, len({tx.sql_tokens('text')})::INTEGER AS in_text FROM arch",
    "stem_table": f"WITH {_ARCH}, w AS (SELECT DISTINCT unnest({tx.sql_content(chr(39).join(['title || ', ' ', ' || text']))}) AS word FROM arch) SELECT word, {tx.sql_stem('word')} AS stem FROM w",
    "index_build": f"""WITH {_INDEX} SELECT n_docs, (SELECT count(*) FROM terms) AS n_terms, (SELECT count(*) FROM post) AS n_postings, (SELECT count(*) FROM post) AS read_postings,
(SELECT sum(least(tf, 65535))::BIGINT FROM post) AS read_tf, (SELECT sum(cf)::BIGINT FROM terms) AS read_cf FROM stats""",
    "term_df": f"WITH {_INDEX} SELECT term, df, cf FROM terms",
    "doc_lengths": f"WITH {_INDEX} SELECT id, len FROM docs",
    "postings": f"WITH {_INDEX} SELECT term, id, least(tf, 65535)::INTEGER AS tf FROM post",
    "index_stats": f"WITH {_INDEX} SELECT n_docs, round(avg_len, 6) AS avg_len, (SELECT count(*) FROM terms) AS n_terms, (SELECT count(*) FROM post) AS n_postings FROM stats",
    "term_rarity": f"""WITH {_INDEX}, {_QUERY},
r AS (SELECT query_id, max(ln(1 + (n_docs - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5))) AS w FROM qt LEFT JOIN terms ON terms.term = qt.term CROSS JOIN stats GROUP BY 1)
SELECT query AS phrase, round(coalesce(least(1.6, greatest(0.35, w / 4.5)), 1.0), 6) AS rarity FROM q LEFT JOIN r ON r.query_id = q.query_id""",
    "bm25_topk": f"{_PLAIN} {_TOP}",
    "bm25_synonyms": f"WITH {_INDEX}, {_QUERY}, {_VARIANTS.format(rows=_variant_rows())}, {_SCORED.format(qt='qv')} {_TOP}",
    "spell_repair": f"""WITH {_INDEX}, t AS (SELECT * FROM (VALUES {_TYPED}) v(term)),
pw AS (SELECT DISTINCT unnest({tx.sql_words('name')}) AS w FROM (SELECT place_name AS name FROM places UNION ALL SELECT unnest([{tx.sql_list(vocab.SUBJECTS)}]))),
own AS (SELECT t.term, coalesce((SELECT df FROM terms x WHERE x.term = t.term), 0) AS own,
  coalesce((SELECT df FROM terms x WHERE x.term = {tx.sql_stem('t.term')}), 0) AS sdf FROM t),
c AS (SELECT own.term, x.term AS word, x.df, levenshtein(own.term, x.term) AS d FROM own JOIN terms x ON left(x.term, 2) = left(own.term, 2) AND x.term <> own.term
  WHERE length(own.term) >= 4 AND greatest(own, sdf) <= 3 AND own.term NOT IN (SELECT w FROM pw WHERE length(w) >= 4) AND length(x.term) >= 4 AND x.df >= greatest(8, 8 * own))
SELECT term, word AS repaired FROM c WHERE d <= CASE WHEN length(term) >= 7 THEN 2 ELSE 1 END QUALIFY row_number() OVER (PARTITION BY term ORDER BY df / d DESC, word) = 1""",
    "match_counts": f"{_PLAIN} SELECT query_id, id, matches FROM found",
    "required_relaxation": f"{_PLAIN} SELECT query_id, count(*) AS n, min(matches) AS least FROM kept GROUP BY 1",
    "phrase_promotion": f"""{_PLAIN},
b AS (SELECT kept.*, row_number() OVER (PARTITION BY kept.query_id ORDER BY score DESC, kept.id) AS base, title, {tx.sql_words('query')} AS qw
  FROM kept JOIN q ON q.query_id = kept.query_id JOIN arch ON arch.id = kept.id),
p AS (SELECT *, CASE WHEN base <= 400 THEN round(score * (1 + 0.35 * len(list_filter(range(1, len(qw)), lambda i: contains(lower(title), qw[i] || ' ' || qw[i + 1])))), 6) ELSE score END AS s FROM b)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY base > 400, s DESC, base)::INTEGER AS rank, id, s AS score FROM p QUALIFY rank <= 20""",
    "talking_head_titles": f"""SELECT log_id FROM (SELECT log_id, title FROM youtube_items WHERE title IS NOT NULL UNION ALL SELECT * FROM (VALUES {_PROBES}) v(log_id, title))
WHERE {tx.sql_any('title', vocab.SPEAKING)}""",
    "talking_head_demote": f"""WITH {_INDEX}, {_QUERY}, a AS (SELECT query_id, ix, {tx.sql_tokens('term')} AS t FROM qt),
u AS (SELECT query_id, ix, unnest(t) AS term FROM a UNION ALL SELECT query_id, ix, NULL FROM a WHERE len(t) = 0),
r AS (SELECT query_id, ix, coalesce(least(1.6, greatest(0.35, max(CASE WHEN u.term IS NOT NULL THEN ln(1 + (n_docs - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) END) / 4.5)), 1.0) AS r
  FROM u LEFT JOIN terms ON terms.term = u.term CROSS JOIN stats GROUP BY 1, 2)
SELECT q.query_id FROM q JOIN (SELECT query_id FROM r GROUP BY 1 HAVING max(r) < 1.15) m ON m.query_id = q.query_id WHERE NOT {tx.sql_any('query', (vocab.ASKS_SPEAKING,))}""",
    "count_matches": f"{_PLAIN} SELECT q.query_id, count(kept.id) AS n FROM q LEFT JOIN kept ON kept.query_id = q.query_id GROUP BY 1",
    "search_full": f"WITH {full_sql(BATCH, 60, True, True)} SELECT query_id, rank, id, round(score, 4) AS score FROM ranked",
    "search_collisions": f"WITH {full_sql(COLLIDING, 60, rules=COLLIDING_RULES)} SELECT query_id, rank, id, score FROM ranked",
    "collision_filter": f"""WITH {_ARCH}, a AS (SELECT * FROM (VALUES (1, 'kingfishers'), (2, 'Potters'), (3, 'potters quarter')) v(query_id, query))
SELECT query_id, id FROM a, arch WHERE NOT (regexp_matches(query, '(?i)^kingfishers$') AND regexp_matches(title || ' ' || text, '(?i)kingfishers\\s+at'))
  AND NOT (regexp_matches(query, '(?i)^potters$') AND regexp_matches(title || ' ' || text, '(?i)potters\\s+quarter\\b'))""",
}
