"""Load-time operators over clips and places: first-wins dedupe, integrity, coverage, lookups, the home predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.functions import vocab

#: What decides which of several rows with one id came first, where the archive has no line numbers.
FIRST = ("uploaded_at", "title", "text", "place_id", "year")


def clips_of(raw: DataFrame) -> DataFrame:
    """The archive's rows by their own names: id, title, text, place_id, subjects, year, uploaded_at, is_placeholder."""
    return raw.select(
        F.col("clip_id").alias("id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"), "place_id",
        F.coalesce("subjects", F.array().cast("array<string>")).alias("subjects"), F.col("shot_year").alias("year"), "uploaded_at", "is_placeholder",
    )


def places_of(raw: DataFrame) -> DataFrame:
    """The places, one row each: id, name, district, state, country, region, terrain, lat, lng."""
    named = raw.select(
        F.col("place_id").alias("id"), F.col("place_name").alias("name"), "district", F.col("state_name").alias("state"),
        F.coalesce("country", F.lit("India")).alias("country"), "region", "terrain", "lat", "lng",
    )
    return first_by_id(named, [F.col("name"), F.col("district")])


def first_by_id(df: DataFrame, order: list[Column]) -> DataFrame:
    """The first row of each id in the given order (nulls last); rows without an id are left out.

    min_by over a struct aggregates on the map side, so an id with very many rows is no hot task.
    """
    key = F.struct(*[x for c in order for x in (c.isNull(), c)], F.xxhash64(*[F.col(c) for c in df.columns if c != "id"]))
    rest = [c for c in df.columns if c != "id"]
    return df.where("id is not null").groupBy("id").agg(F.min_by(F.struct(*rest), key).alias("r")).select("id", *[F.col("r")[c].alias(c) for c in rest])


def first_clips(clips: DataFrame) -> DataFrame:
    """One row of each clip id, the first by FIRST and then by its subjects."""
    return first_by_id(clips, [*[F.col(c) for c in FIRST], F.array_join("subjects", "|")])


def duplicates(df: DataFrame) -> DataFrame:
    """(rows, ids, duplicates): rows with an id that are not the first of it."""
    return df.where("id is not null").agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids")).withColumn("duplicates", F.col("rows") - F.col("ids"))


def violations(clips: DataFrame, places: DataFrame, subjects: tuple[str, ...] = vocab.SUBJECTS) -> DataFrame:
    """(id, rule): clips whose place is unknown, with a tag outside the vocabulary, or placeholders without the SEED_ id."""
    known = places.select(F.col("id").alias("place_id")).where("place_id is not null").distinct()
    lost = clips.where("place_id is not null").join(known, "place_id", "left_anti").select("id", F.lit("place").alias("rule"))
    allowed = F.array(*[F.lit(s) for s in subjects])
    strange = clips.where(F.exists("subjects", lambda s: ~F.array_contains(allowed, s))).select("id", F.lit("subject").alias("rule"))
    odd = clips.where(F.col("is_placeholder") & ~F.startswith("id", F.lit("SEED_"))).select("id", F.lit("placeholder").alias("rule"))
    return lost.unionByName(strange).unionByName(odd)


def check(clips: DataFrame, places: DataFrame) -> None:
    """Raise ValueError if the archive breaks a rule."""
    bad = violations(clips, places).limit(5).collect()
    if bad:
        raise ValueError("archive rules broken: " + ", ".join(f"{r.id} ({r.rule})" for r in bad))


def coverage(clips: DataFrame) -> DataFrame:
    """(place_id, subject, n): clips of each place by subject; unplaced clips are left out."""
    return clips.where("place_id is not null").select("place_id", F.explode("subjects").alias("subject")).groupBy("place_id", "subject").agg(F.count("*").alias("n"))


def coverage_map(clips: DataFrame) -> DataFrame:
    """(place_id, coverage): the same as a map by subject."""
    pairs = F.sort_array(F.collect_list(F.struct("subject", "n")))
    return coverage(clips).groupBy("place_id").agg(F.map_from_entries(pairs).alias("coverage"))


def clips_by_place(clips: DataFrame) -> DataFrame:
    """(place_id, n, first_id): the groups of the placed clips."""
    return clips.where("place_id is not null").groupBy("place_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def lookup(wanted: DataFrame, df: DataFrame) -> DataFrame:
    """Rows of df for lists (list_id, ids), in the lists' order with their place `at`; unknown ids are left out."""
    return wanted.select("list_id", F.posexplode("ids").alias("at", "id")).join(df, "id")


def is_town(name: Column, state: Column) -> Column:
    """A place below the level of a state."""
    return name != state


def covered_places(clips: DataFrame, places: DataFrame, least: int = 20) -> DataFrame:
    """(place_id, name, usable): towns with at least `least` clips that have a subject."""
    usable = clips.where("place_id is not null").groupBy("place_id").agg(F.sum((F.size("subjects") > 0).cast("long")).alias("usable"))
    towns = places.where(is_town(F.col("name"), F.col("state"))).select(F.col("id").alias("place_id"), "name")
    return usable.where(F.col("usable") >= least).join(towns, "place_id").select("place_id", "name", "usable")


def home_clips(clips: DataFrame, places: DataFrame, country: str = "India", distant: str = vocab.DISTANT, signal: str = vocab.HOME_SIGNAL) -> DataFrame:
    """clips with `home`: a placed clip by its place's country (a lost place is not home); an unplaced one is home unless
    its title looks distant, and then only if it holds the home signal or the name of a place at home of five letters."""
    at = places.select(F.col("id").alias("place_id"), "country")
    title = F.col("title")
    far = F.col("place_id").isNull() & F.rlike(title, F.lit(tx.ascii_borders(distant)))
    names = places.where((F.col("country") == country) & (F.length("name") >= 5)).select(F.array_join(tx.words(F.col("name")), " ").alias("phrase")).where("phrase <> ''").distinct()
    most = max(1, names.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 1)
    runs = clips.where(far).select("id", tx.words(title).alias("w")).select("id", F.explode(tx.ngrams(F.col("w"), most)).alias("g")).select("id", F.col("g.phrase").alias("phrase"))
    named = runs.join(names, "phrase", "left_semi").select("id").distinct().withColumn("named", F.lit(True))
    signalled = F.rlike(title, F.lit(tx.ascii_borders(signal))) | F.coalesce("named", F.lit(False))
    home = F.when(F.col("place_id").isNull(), F.when(~far, True).otherwise(signalled)).otherwise(F.coalesce(F.col("country") == country, F.lit(False)))
    return clips.join(at, "place_id", "left").join(named, "id", "left").withColumn("home", home).drop("country", "named")


def home_first(clips: DataFrame, page: int, size: int) -> DataFrame:
    """A page (from 1) of clips with `home`, those at home first, then by id: a top-k, never a full sort to the driver."""
    order = [F.when(F.col("home"), 0).otherwise(1), F.col("id")]
    return clips.orderBy(*order).offset((page - 1) * size).limit(size)


def numbered(df: DataFrame, order: list[Column], column: str = "pos") -> DataFrame:
    """df with a dense position from 1 in the given total order, without one task that holds all rows.

    A range partitioning sorts the parts among themselves; the parts' counts, one row a task, give each its offset.
    """
    from lodestar.session import cut

    sorted_ = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__in", F.monotonically_increasing_id()))
    part = F.shiftright("__in", 33)
    sizes = sorted_.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    offsets = sizes.withColumn("__off", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = sorted_.withColumn("__part", part).join(F.broadcast(offsets.drop("__n")), "__part")
    return out.withColumn(column, F.col("__off") + F.col("__in").bitwiseAND((1 << 33) - 1) + 1).drop("__in", "__part", "__off")
