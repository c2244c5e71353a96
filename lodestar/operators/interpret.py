"""Free-text answers read by dictionaries: greedy longest-first runs of words, never overlapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.functions import vocab

MOST_WORDS, MOST_TERMS = 4, 24


def dictionary(spark: SparkSession, places: DataFrame, aliases: DataFrame, subject_words: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(phrase, region, state_alias, place_id, state, terrains, subjects): one row for each known phrase.

    Place names win over state names, those over aliases (alias, place_id); places of one name give the first id.
    """
    subject_words = subject_words if subject_words is not None else vocab.subject_words()
    name = places.select(tx.normalise(F.col("name")).alias("phrase"), F.col("id").alias("place_id"), F.lit(None).cast("string").alias("state"), F.lit(0).alias("level"))
    state = places.select(tx.normalise(F.col("state")).alias("phrase"), F.lit(None).cast("string").alias("place_id"), "state", F.lit(1).alias("level"))
    alias = aliases.select(tx.normalise(F.col("alias")).alias("phrase"), "place_id", F.lit(None).cast("string").alias("state"), F.lit(2).alias("level"))
    known = name.unionByName(state).unionByName(alias).where("phrase <> ''")
    spots = known.groupBy("phrase").agg(F.min_by(F.struct("place_id", "state"), F.struct("level", "place_id", "state")).alias("p")).select("phrase", "p.place_id", "p.state")
    words = sorted({*vocab.REGION_PHRASES, *vocab.STATE_PHRASES, *vocab.TERRAIN_PHRASES, *subject_words})
    rows = [
        (w, vocab.REGION_PHRASES.get(w), vocab.STATE_PHRASES.get(w), list(vocab.TERRAIN_PHRASES[w]) if w in vocab.TERRAIN_PHRASES else None,
         list(subject_words[w]) if w in subject_words else None) for w in words
    ]
    fixed = spark.createDataFrame(rows, "phrase string, region string, state_alias string, terrains array<string>, subjects array<string>")
    return spots.join(fixed, "phrase", "full_outer").select("phrase", "region", "state_alias", "place_id", "state", "terrains", "subjects")


def _fold(candidates: Column) -> Column:
    """Accepted candidates (size, start, ...) of a list in order, each taken unless a word of it is used."""
    start = F.struct(F.array().cast("array<int>").alias("used"), F.slice(candidates, 1, 0).alias("taken"))

    def step(acc: Column, c: Column) -> Column:
        span = F.sequence(c["start"], c["start"] + c["size"] - 1)
        free = ~F.arrays_overlap(acc["used"], span)
        return F.struct(
            F.when(free, F.concat(acc["used"], span)).otherwise(acc["used"]).alias("used"),
            F.when(free, F.concat(acc["taken"], F.array(c))).otherwise(acc["taken"]).alias("taken"),
        )

    return F.aggregate(candidates, start, step)


def interpret(answers: DataFrame, words: DataFrame) -> DataFrame:
    """answers (answer_id, kind, answer) with the signals of each: places, states, regions, terrains, subjects, terms,
    understood, structured.

    A run of one to four words counts if it is a region, else a state alias, else a place (in answers of the kind 'topic'
    only if it is the whole answer), else a terrain (not in topics) or a subject. Longest runs first, then from the left.
    Answers are short texts, so the list of an answer's candidates is bounded by its words. Blank answers give empty
    signals.
    """
    split = answers.select("answer_id", "kind", F.filter(F.split(tx.normalise(F.coalesce("answer", F.lit(""))), " "), lambda w: w != "").alias("w"))
    runs = split.select("answer_id", "kind", F.size("w").alias("n"), F.explode(tx.ngrams(F.col("w"), MOST_WORDS)).alias("g"))
    met = runs.select("answer_id", "kind", "n", "g.start", "g.size", "g.phrase").join(words, "phrase")
    topic = F.col("kind") == "topic"
    spot = (F.col("place_id").isNotNull() | F.col("state").isNotNull()) & ~(topic & (F.col("size") < F.col("n")))
    level = (
        F.when(F.col("region").isNotNull(), "region").when(F.col("state_alias").isNotNull(), "alias").when(spot, "place")
        .when((F.col("terrains").isNotNull() & ~topic) | F.col("subjects").isNotNull(), "words")
    )
    met = met.withColumn("level", level).where("level is not null")
    none = F.array().cast("array<string>")
    one = lambda c, ok: F.when(ok & c.isNotNull(), F.array(c)).otherwise(none)
    at = lambda x: F.col("level") == x
    meaning = F.struct(
        (-F.col("size")).alias("order"), "start", "size", "phrase", one(F.col("region"), at("region")).alias("regions"),
        F.concat(one(F.col("state_alias"), at("alias")), one(F.col("state"), at("place"))).alias("states"), one(F.col("place_id"), at("place")).alias("places"),
        F.when(at("words") & ~topic, F.coalesce("terrains", none)).otherwise(none).alias("terrains"),
        F.when(at("words"), F.coalesce("subjects", none)).otherwise(none).alias("subjects"),
        one(F.col("phrase"), at("words") & F.col("subjects").isNotNull()).alias("terms"),
    )
    listed = met.groupBy("answer_id").agg(F.sort_array(F.collect_list(meaning)).alias("c"))
    read = split.join(listed, "answer_id", "left").withColumn("f", F.when(F.col("c").isNotNull(), _fold(F.col("c"))))
    taken, used = F.col("f.taken"), F.coalesce(F.col("f.used"), F.array().cast("array<int>"))
    gather = lambda k: F.coalesce(F.array_distinct(F.flatten(F.transform(taken, lambda t: t[k]))), none)
    left = F.filter("w", lambda w, i: ~F.array_contains(used, i) & (F.length(w) > 2) & ~w.isin(*vocab.ANSWER_STOP))
    rest = F.when(F.size(left) > 0, F.array(F.array_join(left, " "))).otherwise(none)
    whole = F.when(F.size("w").between(2, 3), F.array(F.array_join("w", " "))).otherwise(none)
    said = F.coalesce(F.flatten(F.transform(taken, lambda t: t["terms"])), none)
    return read.select(
        "answer_id", *[gather(k).alias(k) for k in ("places", "states", "regions", "terrains", "subjects")],
        F.slice(F.array_distinct(F.concat(said, rest, whole)), 1, MOST_TERMS).alias("terms"),
        F.coalesce(F.array_distinct(F.transform(taken, lambda t: t["phrase"])), none).alias("understood"), F.col("c").isNotNull().alias("structured"),
    )


def of_users(signals: DataFrame, answers: DataFrame) -> DataFrame:
    """One row of signals a user, over their answers in the order of questions (answers: answer_id, user_id, at, answer,
    implies); spoken lists the answers that no dictionary read."""
    keys = ("places", "states", "regions", "terrains", "subjects", "terms", "understood")
    every = answers.join(signals, "answer_id")
    every = every.withColumn("subjects", F.concat("subjects", F.coalesce("implies", F.array().cast("array<string>"))))
    spoken = F.when(~F.col("structured") & (F.trim("answer") != ""), F.array(F.trim("answer"))).otherwise(F.array().cast("array<string>"))
    rows = F.sort_array(F.collect_list(F.struct("at", *keys, spoken.alias("spoken"))))
    out = every.groupBy("user_id").agg(rows.alias("r"))
    all_of = lambda k: F.array_distinct(F.flatten(F.transform("r", lambda x: x[k])))
    return out.select("user_id", *[(F.slice(all_of(k), 1, MOST_TERMS) if k == "terms" else all_of(k)).alias(k) for k in (*keys, "spoken")])


def is_empty(s: str = "") -> Column:
    """Whether nothing usable was found; what was merely said does not count."""
    return F.greatest(*[F.size(s + k) for k in ("places", "states", "regions", "terrains", "subjects", "terms")]) == 0


def split_entities(answer: Column) -> Column:
    """Parts of an answer between commas, slashes, & and 'and' that carry a meaningful word; a single part is the answer."""
    parts = F.transform(F.split(answer, tx.ascii_borders(r"(?i)(?U)\s*(?:,|/|&|\band\b)\s*").replace("(?i)(?U)", "(?iU)"), -1), tx.js_trim)
    kept = F.filter(parts, lambda p: F.size(tx.meaningful(p)) > 0)
    return F.when(F.size(kept) > 1, F.array_distinct(kept)).otherwise(F.array(answer))


def apply_aliases(answer: Column, aliases: Column) -> Column:
    """Each run of letters replaced by its alias in a map keyed in lower case, the rest kept."""
    parts = F.regexp_extract_all(answer, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(aliases, F.lower(p)), p)), "")


def ranked_within(df: DataFrame, by: str, order: list[Column], column: str = "rank") -> DataFrame:
    return df.withColumn(column, F.row_number().over(Window.partitionBy(by).orderBy(*order)))
