"""Batched ranked search: a table of queries in, ranked rows out, whatever their number.

Query terms are repaired, expanded to their spellings, joined to the postings and summed by document with partial
aggregation. Rankings are cut by row_number() <= k, which Spark applies on the map side before its shuffle (window group
limit), so a query that hits a third of all documents ships k rows a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.functions import vocab
from lodestar.operators.index import Index, idf, rarity_of

K1, B = 1.5, 0.75
ENOUGH, WINDOW, BONUS, PENALTY, SPECIFIC = 8, 400, 0.35, 0.3, 1.15


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, at, term): the tokens of (query_id, query), repeats kept, numbered from 0."""
    return queries.select("query_id", F.posexplode(tx.tokens(F.coalesce("query", F.lit("")))).alias("at", "term"))


def protected_words(names: DataFrame, subjects: tuple[str, ...] = vocab.SUBJECTS) -> DataFrame:
    """(term): words of four or more letters of the place names (name) and subjects, never repaired."""
    spark = names.sparkSession
    tags = spark.createDataFrame([(s,) for s in subjects], "name string")
    split = names.select("name").unionByName(tags).select(F.explode(tx.words(F.col("name"))).alias("term"))
    return split.where(F.length("term") >= 4).distinct()


def repairs(words: DataFrame, terms: DataFrame, protected: DataFrame) -> DataFrame:
    """(term, repaired) for those of words (term) that are likely misspelt.

    Likely: four or more letters, itself and its stem in at most 3 documents, not protected. Candidates share the first
    two letters, stand in 8 documents and 8 times as many as the word, at most one edit away (two from seven letters);
    the largest df / distance wins, then the first by name. The common prefix is the join key.
    """
    df = terms.select("term", "df")
    one = words.select("term").distinct()
    own = one.join(df, "term", "left").withColumn("stem", tx.stem(F.col("term")))
    own = own.join(df.select(F.col("term").alias("stem"), F.col("df").alias("stem_df")), "stem", "left")
    unknown = own.where((F.length("term") >= 4) & (F.greatest(F.coalesce("df", F.lit(0)), F.coalesce("stem_df", F.lit(0))) <= 3))
    unknown = unknown.join(protected.select("term"), "term", "left_anti").select("term", F.coalesce("df", F.lit(0)).alias("own"), F.substring("term", 1, 2).alias("head"))
    pool = df.where((F.length("term") >= 4) & (F.col("df") >= 8)).select(F.col("term").alias("word"), "df", F.substring("term", 1, 2).alias("head"))
    most = F.when(F.length("term") >= 7, 2).otherwise(1)
    near = unknown.join(pool, "head").where((F.col("word") != F.col("term")) & (F.abs(F.length("word") - F.length("term")) <= most))
    near = near.withColumn("d", F.levenshtein("term", "word", 2))
    good = near.where((F.col("d") > 0) & (F.col("d") <= most) & (F.col("df") >= F.greatest(8 * F.col("own"), F.lit(8))))
    return good.groupBy("term").agg(F.min_by("word", F.struct((-F.col("df") / F.col("d")).alias("s"), F.col("word"))).alias("repaired"))


def variants(spark, synonyms: dict[str, str] = vocab.SYNONYMS) -> DataFrame:  # noqa: ANN001
    """(term, variant) of stems that are one word spelt in several ways; a word of two groups keeps the later group."""
    rows = spark.createDataFrame([(i, a, c) for i, (a, c) in enumerate(synonyms.items())], "i int, alias string, canonical string")
    rows = [(r.i, r.a, r.c) for r in rows.select("i", tx.stem(F.col("alias")).alias("a"), tx.stem(F.col("canonical")).alias("c")).orderBy("i").collect()]
    groups: dict[str, list[str]] = {}
    for _, a, c in rows:
        own = groups.setdefault(c, [c])
        if a not in own:
            own.append(a)
    member: dict[str, list[str]] = {m: own for own in groups.values() for m in own}
    return spark.createDataFrame([(m, v) for m, own in member.items() for v in own], "term string, variant string")


def scores(terms: DataFrame, index: Index, spellings: DataFrame | None, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, score, matches) of query terms (query_id, at, term): BM25 summed over terms and their spellings;
    matches counts the term positions that a document satisfies."""
    if spellings is not None:
        terms = terms.join(F.broadcast(spellings), "term", "left").withColumn("term", F.coalesce("variant", "term")).drop("variant")
    weighed = terms.join(index.terms.select("term", "df"), "term").crossJoin(F.broadcast(index.stats.select("n_docs", "avg_len")))
    hits = weighed.join(index.postings, "term").join(index.docs, "id")
    damped = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    per_term = hits.groupBy("query_id", "id", "at").agg(F.sum(idf(F.col("df"), F.col("n_docs")) * damped).alias("s"))
    return per_term.groupBy("query_id", "id").agg(F.round(F.sum("s"), 6).alias("score"), F.count("*").alias("matches"))


def relaxed(found: DataFrame, terms: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """The rows of found that satisfy the largest number of terms, up to the required, that `enough` documents do; else one.

    Required are all of one or two terms, else 60 % rounded up. One pass: a histogram of match counts by query and its
    running sum from the top.
    """
    n = F.col("n_terms")
    required = terms.groupBy("query_id").agg(F.count("*").alias("n_terms")).select("query_id", F.when(n <= 2, n).otherwise(F.ceil(n * 0.6)).alias("required"))
    hist = found.groupBy("query_id", "matches").agg(F.count("*").alias("n"))
    down = Window.partitionBy("query_id").orderBy(F.desc("matches"))
    reach = hist.withColumn("n", F.sum("n").over(down)).join(required, "query_id")
    need = reach.where((F.col("n") >= enough) | (F.col("matches") == 1)).groupBy("query_id", "required").agg(
        F.max(F.when(F.col("n") >= enough, F.least("matches", "required"))).alias("most")
    )
    need = required.join(need.drop("required"), "query_id", "left").select("query_id", F.coalesce("most", F.lit(1)).alias("need"))
    return found.join(need, "query_id").where(F.col("matches") >= F.col("need")).drop("need")


def demoted_queries(queries: DataFrame, terms: DataFrame, index: Index, asks: str = vocab.ASKS_SPEAKING) -> DataFrame:
    """(query_id) of the queries that name nothing rare and do not ask for people speaking."""
    again = terms.select("query_id", "at", F.explode_outer(tx.tokens(F.col("term"))).alias("term"))
    known = again.join(index.terms.select("term", "df"), "term", "left").crossJoin(F.broadcast(index.stats.select("n_docs")))
    weight = F.max(F.when(F.col("term").isNotNull(), idf(F.coalesce("df", F.lit(0)), F.col("n_docs"))))
    rare = known.groupBy("query_id", "at").agg(rarity_of(weight).alias("rarity")).groupBy("query_id").agg(F.max("rarity").alias("rarity"))
    plain = rare.where(F.col("rarity") < SPECIFIC)
    return queries.where(~tx.any_pattern(F.coalesce("query", F.lit("")), (asks,))).join(plain, "query_id", "left_semi").select("query_id")


def speaking(title: Column) -> Column:
    """Whether a title is about people speaking to the camera."""
    return tx.any_pattern(title, vocab.SPEAKING)


def phrase_bonus(query: Column, title: Column, bonus: float = BONUS) -> Column:
    """1 + bonus for every pair of adjacent words of the query that the title holds."""
    pairs = tx.bigrams(tx.words(query))
    return 1 + bonus * F.size(F.filter(pairs, lambda p: F.contains(F.lower(title), p)))


def matched(queries: DataFrame, index: Index, clips: DataFrame, protected: DataFrame | None = None, spellings: DataFrame | None = None, demote: bool = True) -> DataFrame:
    """(query_id, query, id, title, text, score, matches): all documents that answer each query, unranked."""
    terms = query_terms(queries)
    if protected is not None:
        fixed = repairs(terms, index.terms, protected)
        terms = terms.join(fixed, "term", "left").select("query_id", "at", F.coalesce("repaired", "term").alias("term"))
    found = relaxed(scores(terms, index, spellings), terms)
    found = found.join(queries.select("query_id", "query"), "query_id").join(clips.select("id", "title", "text"), "id")
    if demote:
        down = demoted_queries(queries, terms, index).withColumn("down", F.lit(True))
        lower = F.coalesce("down", F.lit(False)) & speaking(F.col("title"))
        found = found.join(down, "query_id", "left").withColumn("score", F.when(lower, F.round(F.col("score") * PENALTY, 6)).otherwise(F.col("score"))).drop("down")
    return found


def not_colliding(found: DataFrame, rules: tuple[tuple[str, str], ...] = vocab.COLLISIONS) -> DataFrame:
    """Leaves out documents that hold a personal name which a one-word query does not mean."""
    whole = F.concat_ws(" ", "title", F.coalesce("text", F.lit("")))
    clash = F.lit(False)
    for bare, personal in rules:
        clash = clash | (F.rlike(tx.js_trim(F.col("query")), F.lit(bare)) & F.rlike(whole, F.lit(tx.ascii_borders(personal))))
    return found.where(~clash)


def search(
    queries: DataFrame, index: Index, clips: DataFrame, limit: int = 60, protected: DataFrame | None = None,
    spellings: DataFrame | None = None, demote: bool = True, phrases: bool = True, rules: tuple[tuple[str, str], ...] = vocab.COLLISIONS,
) -> DataFrame:
    """(query_id, rank, id, score): the best `limit` documents of each (query_id, query), by score, then id.

    Within the first 400, titles that keep the query's words together are moved up. Queries without terms have no rows.
    clips (id, title, text) must have unique ids.
    """
    # rules meet one-word queries only, which have no phrases: leaving rows out before the cut is leaving them out of all hits
    found = not_colliding(matched(queries, index, clips, protected, spellings, demote), rules)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    top = found.withColumn("base", F.row_number().over(order)).where(F.col("base") <= max(limit, WINDOW) + (WINDOW if phrases else 0))
    if phrases:
        boosted = F.when(F.col("base") <= WINDOW, F.round(F.col("score") * phrase_bonus(F.col("query"), F.col("title")), 6)).otherwise(F.col("score"))
        top = top.withColumn("score", boosted)
    order = Window.partitionBy("query_id").orderBy(F.col("base") > WINDOW, F.desc("score"), "base")
    ranked = top.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= limit).select("query_id", "rank", "id", "score")


def count_matches(queries: DataFrame, index: Index, clips: DataFrame, protected: DataFrame | None = None, spellings: DataFrame | None = None) -> DataFrame:
    """(query_id, n): how many documents each query reaches; 0 for queries without terms."""
    found = not_colliding(matched(queries, index, clips, protected, spellings, demote=False))
    return queries.select("query_id").join(found.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").fillna(0, ["n"])
