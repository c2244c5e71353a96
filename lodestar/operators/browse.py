"""Faceted browse, counts, pages, related items, suggestions, and the order-dependent picks of covers and rails."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.functions import vocab
from lodestar.operators.index import Index, idf, rarity_of
from lodestar.operators.search import speaking


def subject_page(clips: DataFrame, subject: str, offset: int = 0, limit: int = 24) -> DataFrame:
    """(id, home, total): a page of the clips (with `home`) that carry a subject, home first over the whole set."""
    own = clips.where(F.array_contains("subjects", subject)).select("id", "home")
    page = own.orderBy(F.when(F.col("home"), 0).otherwise(1), "id").offset(offset).limit(limit)
    return page.crossJoin(own.agg(F.count("*").alias("total")))


def subject_counts(clips: DataFrame, subjects: tuple[str, ...] = vocab.SUBJECTS) -> DataFrame:
    """(subject, n, rank): clips of each subject of the vocabulary that has any; ties in the order of the vocabulary."""
    n = clips.select(F.explode("subjects").alias("subject")).where(F.col("subject").isin(*subjects)).groupBy("subject").agg(F.count("*").alias("n"))
    at = F.array_position(F.array(*[F.lit(s) for s in subjects]), F.col("subject"))
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), at)))  # at most one row a subject


def clips_for_place(clips: DataFrame, limit: int = 60) -> DataFrame:
    """(place_id, rank, id, total): of every place, footage before people speaking, longer titles first."""
    placed = clips.where("place_id is not null")
    order = Window.partitionBy("place_id").orderBy(speaking(F.col("title")).cast("int"), F.desc(F.length("title")), "id")
    top = placed.select("place_id", "id", F.row_number().over(order).alias("rank")).where(F.col("rank") <= limit)
    return top.join(placed.groupBy("place_id").agg(F.count("*").alias("total")), "place_id")


def word_weights(words: DataFrame, index: Index) -> DataFrame:
    """words (word) with the rarity of their stem."""
    one = words.select("word").distinct().withColumn("term", tx.stem(F.col("word")))
    # a stem is stemmed again, as any phrase is
    again = one.withColumn("t", F.explode_outer(tx.tokens(F.col("term"))))
    known = again.join(index.terms.select(F.col("term").alias("t"), "df"), "t", "left").crossJoin(F.broadcast(index.stats.select("n_docs")))
    weight = F.max(F.when(F.col("t").isNotNull(), idf(F.coalesce("df", F.lit(0)), F.col("n_docs"))))
    return known.groupBy("word").agg(rarity_of(weight).alias("rarity"))


def related(seeds: DataFrame, clips: DataFrame, index: Index, limit: int = 6) -> DataFrame:
    """(seed, rank, id, score): clips like each seed clip: of its place, or if it has none with a subject of it.

    The score sums the rarity of the seed's title words found in the title, and 0.25 a shared subject; then the longer
    text, then the id. Seeds are few against the clips; the joins are by place and by subject.
    """
    own = seeds.select(F.col("id").alias("seed"), F.col("title").alias("seed_title"), "place_id", F.col("subjects").alias("seed_subjects"))
    kept = F.array_distinct(F.filter(tx.words(F.col("seed_title")), lambda w: (F.length(w) > 2) & ~w.isin(*vocab.STOPWORDS)))
    words = own.select("seed", F.explode(kept).alias("word"))
    weighed = words.join(word_weights(words, index), "word").groupBy("seed").agg(F.sort_array(F.collect_list(F.struct("word", "rarity"))).alias("weights"))
    own = own.join(weighed, "seed", "left")
    others = clips.select("id", "title", F.length("text").alias("long"), "place_id", "subjects")
    placed = own.where("place_id is not null").join(others, "place_id").drop("place_id")
    tagged = own.where("place_id is null").drop("place_id").withColumn("s", F.explode("seed_subjects"))
    tagged = tagged.join(others.withColumn("s", F.explode("subjects")).drop("place_id"), "s").drop("s").dropDuplicates(["seed", "id"])
    pool = placed.unionByName(tagged).where("id <> seed")
    held = F.filter(F.coalesce("weights", F.array().cast("array<struct<word:string,rarity:double>>")), lambda w: F.contains(F.lower("title"), w["word"]))
    score = F.aggregate(held, F.lit(0.0), lambda a, w: a + w["rarity"]) + 0.25 * F.size(F.array_intersect("subjects", "seed_subjects"))
    order = Window.partitionBy("seed").orderBy(F.desc("score"), F.desc("long"), "id")
    ranked = pool.select("seed", "id", "long", F.round(score, 6).alias("score")).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= limit).select("seed", "rank", "id", "score")


def facets(found: DataFrame, column: Column, most: int) -> DataFrame:
    """(query_id, value, n): the `most` commonest values over all rows (query_id, id, score) of a search; ties go to the
    value whose best row ranks first."""
    first = F.min(F.struct((-F.col("score")).alias("s"), F.col("id").alias("i")))
    tally = found.withColumn("value", column).where("value is not null").groupBy("query_id", "value").agg(F.count("*").alias("n"), first.alias("first"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "first", "value"))
    return tally.withColumn("rank", rank).where(F.col("rank") <= most).select("query_id", "value", "n")


def page_number(typed: Column, total: Column, size: int = 24) -> Column:
    """A typed page as a whole number from 1 to the last page; anything that is no number is 1."""
    last = F.greatest(F.lit(1), F.ceil(total / size)).cast("double")
    n = typed.try_cast("double")
    n = F.when(F.isnan(n) | n.isNull(), 1.0).otherwise(n)
    return F.least(last, F.greatest(F.lit(1.0), F.when(F.abs(n) < 1e15, F.floor(F.when(F.abs(n) < 1e15, n).otherwise(0.0)).cast("double")).otherwise(n))).cast("int")


def hero_page(page: Column, total: Column) -> Column:
    """struct(first, rows, last): offset and rows of a page whose first holds 24 rows and the others 23."""
    last = F.greatest(F.lit(1), F.ceil((total - 1) / 23)).cast("int")
    now = F.least(F.greatest(page, F.lit(1)), last)
    return F.struct(F.when(now == 1, 0).otherwise(1 + (now - 1) * 23).cast("int").alias("first"), F.when(now == 1, 24).otherwise(23).alias("rows"), last.alias("last"))


def place_profile(clips: DataFrame, most: int = 8) -> DataFrame:
    """(place_id, subject, n, rank): the commonest subjects of each place."""
    n = clips.where("place_id is not null").select("place_id", F.explode("subjects").alias("subject")).groupBy("place_id", "subject").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("place_id").orderBy(F.desc("n"), "subject"))).where(F.col("rank") <= most)


def elsewhere(covered: DataFrame, place_id: str, most: int = 12) -> DataFrame:
    """The other covered places, most usable clips first."""
    return covered.where(F.col("place_id") != place_id).orderBy(F.desc("usable"), "place_id").limit(most)


def other_subjects(counts: DataFrame, subject: str, most: int = 12) -> DataFrame:
    """(subject, n): the other subjects of subject_counts, the commonest first."""
    return counts.where(F.col("subject") != subject).orderBy("rank").limit(most).select("subject", "n")


def places_by_country(places: DataFrame, home: str = "India") -> DataFrame:
    """(country, n, rank): countries by number of places, home first."""
    n = places.groupBy("country").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.col("country") != home, F.desc("n"), "country")))  # one row a country


def country_lists(covered: DataFrame, places: DataFrame, home: str = "India") -> DataFrame:
    """(country, country_rank, at, place_id, usable): the covered places of each country, most usable first; countries as in
    places_by_country. Rows instead of one list a country, so a country may have any number of places."""
    own = covered.join(places.select(F.col("id").alias("place_id"), "country"), "place_id")
    ranks = places_by_country(own, home).select("country", F.col("rank").alias("country_rank"))
    at = F.row_number().over(Window.partitionBy("country").orderBy(F.desc("usable"), "place_id"))
    return own.withColumn("at", at).join(ranks, "country").select("country", "country_rank", "at", "place_id", "usable")


def subject_candidates(clips: DataFrame, subjects: tuple[str, ...] = vocab.SUBJECTS, most: int = 60) -> DataFrame:
    """(subject, rank, id, worth): the first clips (with `home`) of each subject, those at home first; worth is 0 if the
    title holds a word of the subject in the singular, else null: what greedy_picks needs to choose covers."""
    own = clips.select("id", "title", "home", F.explode("subjects").alias("subject")).where(F.col("subject").isin(*subjects))
    order = Window.partitionBy("subject").orderBy(F.when(F.col("home"), 0).otherwise(1), "id")
    first = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    stems = F.filter(F.transform(F.split("subject", r"\s+"), lambda w: F.regexp_replace(w, "s$", "")), lambda w: F.length(w) > 2)
    shown = F.exists(stems, lambda w: F.contains(F.lower("title"), w))
    return first.select("subject", "rank", "id", F.when(shown, 0.0).alias("worth"))


def more_like(seeds: DataFrame, clips: DataFrame, most: int = 8, searched: int = 20) -> DataFrame:
    """(seed, rank, id): of the first `searched` clips (with `home`) of each seed's first subject, those at home first, the
    first `most` others. A subject's first clips are worked out once for all seeds."""
    own = clips.select("id", "home", F.explode("subjects").alias("subject"))
    order = Window.partitionBy("subject").orderBy(F.when(F.col("home"), 0).otherwise(1), "id")
    first = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= searched)
    met = seeds.select(F.col("id").alias("seed"), F.get("subjects", F.lit(0)).alias("subject")).join(first, "subject").where("seed <> id")
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy("rank"))).where(F.col("rank") <= most).select("seed", "rank", "id")


def suggestion_vocabulary(places: DataFrame, aliases: DataFrame, home: str = "India") -> DataFrame:
    """(word): names and states of places at home, and aliases with a capital, each once."""
    own = places.where(F.col("country") == home)
    capital = F.concat(F.upper(F.substring("alias", 1, 1)), F.expr("substring(alias, 2)"))
    return own.select(F.col("name").alias("word")).unionByName(own.select(F.col("state").alias("word"))).unionByName(aliases.select(capital.alias("word"))).where("word is not null").distinct()


def autocomplete(typed: DataFrame, words: DataFrame, most: int = 6) -> DataFrame:
    """(typed, rank, word): up to six suggestions for what was typed (two characters or more): words that begin with it,
    then words that hold it; the word itself is none."""
    asked = typed.select("typed", F.lower(F.trim("typed")).alias("t")).where(F.length("t") >= 2).distinct()
    met = words.select("word", F.lower("word").alias("l")).crossJoin(F.broadcast(asked)).where(F.contains("l", F.col("t")) & (F.col("l") != F.col("t")))
    order = Window.partitionBy("typed").orderBy(F.when(F.startswith("l", F.col("t")), 0).otherwise(1), "word")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("typed", "rank", "word")


def greedy_picks(tiles: DataFrame, take: int = 1) -> DataFrame:
    """(tile, slot, id): `take` ids of each tile in the order of tiles, none twice on the page.

    tiles has (page, tile, at, id, worth): candidates in order with a rank to minimise (null: none). With take 1 the least
    worth among unused candidates wins, else the first unused, else the first; otherwise the first unused in order.
    Each pick depends on those before it, so a page, a few hundred candidates, is one group; pages are spread.
    """

    def run(page: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        out = []
        for tile, own in page.sort_values(["tile", "at"]).groupby("tile", sort=True):
            free = own[~own["id"].isin(used)]
            if take > 1:
                picked = free["id"].drop_duplicates().head(take).tolist()
            else:
                ranked = free[free["worth"].notna()]
                if len(ranked):
                    picked = [ranked.loc[ranked["worth"].idxmin(), "id"]]
                else:
                    picked = [free["id"].iloc[0] if len(free) else own["id"].iloc[0]]
            used.update(picked)
            out += [(page["page"].iloc[0], tile, slot, i) for slot, i in enumerate(picked)]
        return pd.DataFrame(out, columns=["page", "tile", "slot", "id"])

    return tiles.groupBy("page").applyInPandas(run, "page int, tile int, slot int, id string")
