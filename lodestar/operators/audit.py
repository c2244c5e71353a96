"""Data-quality analytics: seeded samples, rule classes, counts, histograms, extractor and ranking evaluation."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import text as tx


def mulberry32(seed: int):  # noqa: ANN201
    """The 32-bit generator mulberry32: a function that gives numbers in [0, 1)."""
    state = seed & 0xFFFFFFFF

    def imul(a: int, b: int) -> int:
        return (a * b) & 0xFFFFFFFF

    def draw() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = imul(state ^ (state >> 15), state | 1)
        t ^= (t + imul(t ^ (t >> 7), t | 61)) & 0xFFFFFFFF
        return ((t ^ (t >> 14)) & 0xFFFFFFFF) / 4294967296

    return draw


def sample_positions(n: int, pool: int, seed: int) -> list[int]:
    """n distinct positions of a pool (all of a smaller one), sorted."""
    draw, out = mulberry32(seed), set()
    while len(out) < min(n, pool):
        out.add(int(draw() * pool))
    return sorted(out)


def seeded_sample(df: DataFrame, order: list[Column], n: int, seed: int) -> DataFrame:
    """n rows of df, by positions in its total order from the seeded generator, with their position `pos` from 0."""
    from lodestar.operators.archive import numbered

    placed = numbered(df, order).withColumn("pos", F.col("pos") - 1)
    wanted = df.sparkSession.createDataFrame([(p,) for p in sample_positions(n, df.count(), seed)], "pos long")  # at most n rows
    return placed.join(F.broadcast(wanted), "pos")


def classify(title: Column, rules: list[tuple[str, str]], ordinary: tuple[str, ...], gap: str = "gap", rest: str = "none") -> Column:
    """struct(bucket, found): the first rule (bucket, pattern) that the title meets; else `gap` with its first capitalised
    word that is not ordinary; else `rest`."""
    words = F.split(title, r"[^\p{L}\p{N}'’-]+", -1)
    odd = F.filter(words, lambda w: F.rlike(w, F.lit(r"^\p{Lu}\p{L}{2,}$")) & ~F.lower(w).isin(*ordinary))
    first = F.get(odd, F.lit(0))
    bucket, found = F.when(first.isNotNull(), gap).otherwise(rest), first
    for name, pattern in reversed(rules):
        p = tx.ascii_borders(pattern)
        hit = F.rlike(title, F.lit(p))
        bucket = F.when(hit, name).otherwise(bucket)
        found = F.when(hit, F.regexp_extract(title, p, 0)).otherwise(found)
    return F.struct(bucket.alias("bucket"), found.alias("found"))


def _named(title: Column, words: tuple[str, ...], tail: str = "") -> Column:
    """The first of the words, in their order, that the title holds whole, case aside; null without one."""
    hit = lambda w: F.rlike(title, F.lit(tx.ascii_borders(rf"(?i)\b{re.escape(w)}{tail}\b")))
    return F.coalesce(*[F.when(hit(w), F.lit(w)) for w in words], F.lit(None).cast("string"))


def classify_whole(
    title: Column, refused: tuple[str, ...], formats: tuple[str, ...], figures: tuple[str, ...], abroad: tuple[str, ...], regions: tuple[str, ...],
    festivals: tuple[str, ...], kinds: tuple[str, ...], ordinary: tuple[str, ...],
) -> Column:
    """struct(bucket, found) of a title in seven buckets.

    Lists are tried on the whole title before single words are: refused titles and formats give 'reject', figures
    'ambiguous', places abroad 'gap-2b', regions 'region', festivals 'festival'. Then the first capitalised word behind the
    first, no ordinary word and no kind of thing (in the singular or plural), gives 'gap-2a'. What is left is 'subject' if
    it names a kind or has no capitalised word, else 'ambiguous'.
    """
    lists = (("reject", refused), ("reject", formats), ("ambiguous", figures), ("gap-2b", abroad), ("region", regions), ("festival", festivals))
    lower = lambda words: [w.lower() for w in words]
    words = F.split(title, r"[^\p{L}\p{N}'’-]+", -1)
    capital = F.filter(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda w: F.rlike(w, F.lit(r"^[A-Z][a-z']{2,}$")))
    kind = lambda w: w.isin(*lower(kinds)) | F.regexp_replace(w, "s$", "").isin(*lower(kinds)) | F.regexp_replace(w, "es$", "").isin(*lower(kinds))
    place = F.get(F.filter(capital, lambda w: ~F.lower(w).isin(*lower(ordinary)) & ~kind(F.lower(w))), F.lit(0))
    thing = _named(title, kinds, "(?:s|es)?")
    steps = [(bucket, _named(title, own)) for bucket, own in lists if own] + [("gap-2a", place), ("subject", thing)]
    bucket, found = F.when(F.size(capital) == 0, "subject").otherwise("ambiguous"), F.lit(None).cast("string")
    for name, hit in reversed(steps):
        bucket, found = F.when(hit.isNotNull(), name).otherwise(bucket), F.coalesce(hit, found)
    return F.struct(bucket.alias("bucket"), found.alias("found"))


def disagreements(found: DataFrame, one: str = "title", other: str = "playlist") -> DataFrame:
    """(id, one, other): rows whose best place (found: candidates of places) in one zone is another than in the other."""
    from lodestar.operators.etl import best_place

    a, b = (best_place(found.where(F.col("source") == z)).select("id", F.col("place_key").alias(k)) for z, k in ((one, "one"), (other, "other")))
    return a.join(b, "id").where("one <> other")


def keyword_counts(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """(keyword, n): rows (id, text) that hold each keyword (keyword) as whole words; 0 for those that none holds."""
    from lodestar.operators.etl import runs_of

    runs = texts.select("id", tx.words(F.col("text")).alias("w")).select("id", F.explode(runs_of(F.col("w"), keywords, "keyword")).alias("g"))
    n = runs.select("id", F.col("g.phrase").alias("keyword")).join(keywords, "keyword", "left_semi").distinct().groupBy("keyword").agg(F.count("*").alias("n"))
    return keywords.select("keyword").distinct().join(n, "keyword", "left").fillna(0, ["n"])


def extrapolated(counts: DataFrame, sampled: int, pool: int) -> DataFrame:
    """counts (bucket, n) with the share of the sample and the estimated count of the pool."""
    share = F.col("n") / sampled
    return counts.withColumn("share", F.round(share, 6)).withColumn("estimate", F.round(share * pool).cast("long"))


def proper_nouns(titles: DataFrame, known: DataFrame, least: int = 3) -> DataFrame:
    """(phrase, words, n): capitalised words, and pairs of neighbours, not at the start of a title (id, title), that no
    known name (name) is, in at least `least` places."""
    w = titles.select("id", F.split(F.col("title"), r"\s+").alias("w"))
    capital = lambda c: F.rlike(c, F.lit(r"^[A-Z][a-z]{2,}$"))
    # every word but the first, with its follower
    later = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.get("w", i).alias("x"), F.get("w", i + 1).alias("y"))))
    one = F.transform(F.filter(later, lambda p: capital(p["x"])), lambda p: F.struct(p["x"].alias("phrase"), F.lit(1).alias("words")))
    two = F.filter(later, lambda p: capital(p["x"]) & F.coalesce(capital(p["y"]), F.lit(False)))
    both = F.concat(one, F.transform(two, lambda p: F.struct(F.concat_ws(" ", p["x"], p["y"]).alias("phrase"), F.lit(2).alias("words"))))
    found = w.where(F.size("w") > 1).select(F.explode(both).alias("p")).groupBy("p.phrase", "p.words").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return found.join(known.select(F.lower("name").alias("k")).distinct(), F.lower("phrase") == F.col("k"), "left_anti")


def granularity(clips: DataFrame, kinds: DataFrame) -> DataFrame:
    """(kind, n, share) of clips by the kind (place_id, kind) of their place; 'none' for those without."""
    n = clips.join(kinds, "place_id", "left").groupBy(F.coalesce("kind", F.lit("none")).alias("kind")).agg(F.count("*").alias("n"))
    return n.crossJoin(clips.agg(F.count("*").alias("total"))).select("kind", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def usable_thresholds(clips: DataFrame, levels: tuple[int, ...] = (5, 20, 50, 100, 500)) -> DataFrame:
    """(least, places): places with at least so many clips that have a subject."""
    per = clips.where(F.col("place_id").isNotNull() & (F.size("subjects") > 0)).groupBy("place_id").agg(F.count("*").alias("n"))
    cols = [F.coalesce(F.sum((F.col("n") >= k).cast("long")), F.lit(0)).alias(f"n{k}") for k in levels]
    row = F.array(*[F.struct(F.lit(k).alias("least"), F.col(f"n{k}").alias("places")) for k in levels])
    return per.agg(*cols).select(F.explode(row).alias("r")).select("r.least", "r.places")


def top_places(clips: DataFrame, most: int = 100) -> DataFrame:
    """(rank, place_id, usable, with_year, subject_1..3): the places with the most usable clips."""
    own = clips.where("place_id is not null")
    n = own.groupBy("place_id").agg(F.sum((F.size("subjects") > 0).cast("long")).alias("usable"), F.sum(F.col("year").isNotNull().cast("long")).alias("with_year"))
    top = n.orderBy(F.desc("usable"), "place_id").limit(most).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("usable"), "place_id")))  # at most `most` rows
    tags = own.select("place_id", F.explode("subjects").alias("subject")).groupBy("place_id", "subject").agg(F.count("*").alias("k"))
    best = tags.groupBy("place_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("k")).alias("k"), "subject"))), 1, 3).alias("s"))
    out = top.join(best, "place_id", "left")
    return out.select("rank", "place_id", "usable", "with_year", *[F.get("s", F.lit(i))["subject"].alias(f"subject_{i + 1}") for i in range(3)])


def decades(clips: DataFrame) -> DataFrame:
    """(decade, n) of clips with a year."""
    return clips.where("year is not null").groupBy((F.floor(F.col("year") / 10) * 10).cast("int").alias("decade")).agg(F.count("*").alias("n"))


def substring_search(clips: DataFrame, wanted: list[tuple[str, list[str], list[str]]], most: int = 10) -> DataFrame:
    """(label, rank, id, total): clips whose title or text holds any keyword of (label, keywords, places) and, if places are
    given, any of those; the first `most` in archive order."""
    hay = F.lower(F.concat_ws(" ", "title", "text"))
    any_of = lambda ws: reduce(lambda a, b: a | b, [F.contains(hay, F.lit(w.lower())) for w in ws])
    labels = F.filter(F.array(*[F.when(any_of(k) & (any_of(p) if p else F.lit(True)), F.lit(label)) for label, k, p in wanted]), lambda x: x.isNotNull())
    met = clips.select("id", F.explode(labels).alias("label"))
    top = met.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("id"))).where(F.col("rank") <= most)
    return top.join(met.groupBy("label").agg(F.count("*").alias("total")), "label").select("label", "rank", "id", "total")


def length_shape(texts: DataFrame) -> DataFrame:
    """One row: rows, least, upper median and greatest length of texts (id, text), and how many hold a link or a hashtag.

    The median is the element at floor(n / 2) of the sorted lengths, found from the histogram of lengths.
    """
    rows = texts.where("text is not null").select(F.length("text").alias("n"), F.rlike("text", F.lit("https?://")).alias("link"), F.rlike("text", F.lit(r"#[\p{L}\p{N}_]+")).alias("tag"))
    shape = rows.agg(F.count("*").alias("rows"), F.min("n").alias("least"), F.max("n").alias("greatest"), F.coalesce(F.sum(F.col("link").cast("long")), F.lit(0)).alias("links"), F.coalesce(F.sum(F.col("tag").cast("long")), F.lit(0)).alias("hashtags"))
    hist = rows.groupBy("n").agg(F.count("*").alias("k")).withColumn("upto", F.sum("k").over(Window.orderBy("n")))  # one row a length
    median = hist.crossJoin(F.broadcast(shape.select("rows"))).where(F.col("upto") > F.floor(F.col("rows") / 2)).agg(F.min("n").alias("median"))
    return shape.crossJoin(median)


def zone_attribution(zoned: DataFrame, names: DataFrame) -> DataFrame:
    """(source, n): from which zone each row's best place comes, and from which it comes with the better zones taken away."""
    from lodestar.operators.etl import best_place, place_candidates

    found = place_candidates(zoned, names)
    out = None
    for level, gone in (("all", ()), ("no playlist", ("playlist",)), ("no hashtag", ("playlist", "hashtag")), ("prose only", ("playlist", "hashtag", "title"))):
        part = best_place(found.where(~F.col("source").isin(*gone)) if gone else found).groupBy("source").agg(F.count("*").alias("n")).withColumn("level", F.lit(level))
        out = part if out is None else out.unionByName(part)
    return out


def first_rows(wanted: DataFrame, log: DataFrame, id_col: Column) -> DataFrame:
    """(id, log_id): the first log row of each wanted id."""
    return log.select(id_col.alias("id"), "log_id").join(wanted.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("log_id").alias("log_id"))


def compare_extractors(truth: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """One row for two extractions (id, place_id) against the truth (id, place_id; null: none): precision of each, and the
    rows that b fixed, lost and left wrong."""
    side = lambda d, n: d.select("id", F.col("place_id").alias(n))
    all_ = side(truth, "t").join(side(a, "a"), "id", "left").join(side(b, "b"), "id", "left")
    ok = lambda c: F.coalesce(F.col(c) == F.col("t"), F.lit(False))
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    given = lambda c: F.col(c).isNotNull()
    row = all_.agg(
        one(given("a")).alias("a_given"), one(ok("a")).alias("a_right"), one(given("b")).alias("b_given"), one(ok("b")).alias("b_right"),
        one(given("a") & ~ok("a") & (ok("b") | ~given("b"))).alias("fixed"), one(ok("a") & ~ok("b")).alias("lost"), one(given("a") & ~ok("a") & given("b") & ~ok("b")).alias("still_wrong"),
    )
    ratio = lambda x: F.round(F.col(f"{x}_right") / F.nullif(F.col(f"{x}_given"), F.lit(0)), 6).alias(f"{x}_precision")
    return row.select("*", ratio("a"), ratio("b"))


def precision_at(spark: SparkSession, ranked: DataFrame, clips: DataFrame, rules: list[tuple[int, list[str], list[str]]], k: int = 20) -> DataFrame:
    """(query_id, hits, right, precision) of ranked results (query_id, rank, id): right is a text that meets every `must`
    pattern and no `must_not`; a query without hits scores 0."""
    t = spark.createDataFrame(rules, "query_id int, must array<string>, must_not array<string>")
    whole = F.concat_ws(" ", "title", "text")
    met = F.forall("must", lambda p: F.rlike(F.col("whole"), F.concat(F.lit("(?i)"), p))) & ~F.exists("must_not", lambda p: F.rlike(F.col("whole"), F.concat(F.lit("(?i)"), p)))
    judged = ranked.where(F.col("rank") <= k).join(clips.select("id", whole.alias("whole")), "id").join(t, "query_id").select("query_id", met.alias("ok"))
    n = judged.groupBy("query_id").agg(F.count("*").alias("hits"), F.sum(F.col("ok").cast("long")).alias("right"))
    out = t.select("query_id").join(n, "query_id", "left").fillna(0, ["hits", "right"])
    return out.withColumn("precision", F.round(F.when(F.col("hits") > 0, F.col("right") / F.col("hits")).otherwise(0.0), 6))
