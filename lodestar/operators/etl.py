"""From the crawl log to clips: zones, places, tags, years, rejection, merge, reports, and the demo slice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.functions import vocab
from lodestar.session import cut

#: What a hashtag is, and the longest text that a clip keeps.
HASHTAG, MOST_TEXT = r"#[\p{L}\p{N}_]+", 800


def first_sentences(prose: Column, n: int = 2) -> Column:
    """The first n sentences, joined by a space."""
    return F.array_join(F.slice(F.split(prose, r"(?<=[.!?])\s+", -1), 1, n), " ")


def with_zones(items: DataFrame) -> DataFrame:
    """items (id, title, description, playlist, ...) with prose, hashtags and tail.

    prose holds the trimmed lines before the first hashtag line, hashtags the tags without # in lower case, tail the other
    lines after it. A hashtag line is more than half hashtags by length; blank lines are left out; null is empty. Lines,
    marks and the first mark are columns of their own, so each line is trimmed and searched once.
    """
    trimmed = F.filter(F.transform(F.split(F.coalesce("description", F.lit("")), "\n", -1), tx.js_trim), lambda x: x != "")
    tagged = F.transform("__lines", lambda x: F.struct(x.alias("line"), F.when(F.contains(x, F.lit("#")), F.regexp_extract_all(x, F.lit(HASHTAG), 0)).otherwise(F.array().cast("array<string>")).alias("tags")))
    is_tag = lambda s: (F.size(s["tags"]) > 0) & (F.length(F.array_join(s["tags"], "")) > F.length(s["line"]) * 0.5)
    staged = items.withColumn("__lines", trimmed).withColumn("__lines", tagged).withColumn("__hash", F.transform("__lines", is_tag))
    staged = staged.withColumn("__first", F.array_position("__hash", True))
    n = F.when(F.col("__first") > 0, F.col("__first") - 1).otherwise(F.size("__lines")).cast("int")
    mark = lambda i: F.get(F.col("__hash"), i)
    rest = F.filter("__lines", lambda s, i: (F.col("__first") > 0) & (i >= F.col("__first")) & ~mark(i))
    tags = F.flatten(F.transform(F.filter("__lines", lambda s, i: mark(i)), lambda s: s["tags"]))
    return staged.select(
        *[F.col(c) for c in items.columns], F.array_join(F.slice(F.col("__lines.line"), F.lit(1), n), " ").alias("prose"),
        F.transform(tags, lambda t: F.lower(F.substring(t, F.lit(2), F.length(t)))).alias("hashtags"), F.array_join(F.transform(rest, lambda s: s["line"]), " ").alias("tail"),
    )


def place_names(gazetteer: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, place_key, kind, seq): aliases, then names, in the order in which ties are broken; lost targets left out."""
    known = gazetteer.select("place_key", "kind")
    named = aliases.join(known, "place_key").select(F.col("alias").alias("name"), "place_key", "kind", F.concat(F.lit("0"), "alias").alias("seq"))
    return named.unionByName(known.select(F.col("place_key").alias("name"), "place_key", "kind", F.concat(F.lit("1"), "place_key").alias("seq")))


#: Phrases of a list that may be written into the plan as a set.
SET_PHRASES = 5_000


def runs_of(words: Column, phrases: DataFrame, column: str = "phrase") -> Column:
    """tx.ngrams of a column of words, as long as the longest phrase of a list (of words joined by a space).

    If the list, counted, is short, runs that are none of its phrases are dropped by a set inside the plan before they
    become rows; the join with the list that follows gives the same either way.
    """
    size = phrases.agg(F.count("*").alias("n"), F.max(F.size(F.split(column, " "))).alias("most")).first()
    runs = tx.ngrams(words, max(1, size.most or 1))
    if size.n > SET_PHRASES:
        return runs
    known = sorted({r[0] for r in phrases.select(column).where(F.col(column).isNotNull()).collect()})
    return F.filter(runs, lambda g: g["phrase"].isin(*known)) if known else F.slice(runs, 1, 0)


def place_candidates(zoned: DataFrame, names: DataFrame) -> DataFrame:
    """(id, source, place_key, kind, locative, origin, seq): every name found in hashtags, playlist, title and the first
    two sentences of the prose, once a text, with the kind of word before it.

    Runs of words are joined to the names by equality, and only those that meet are checked by the whole-word pattern.
    """
    tags = zoned.select("id", F.posexplode("hashtags").alias("at", "name"))
    # an alias wins over a name of the same spelling
    one = names.groupBy("name").agg(F.min_by(F.struct("place_key", "kind"), "seq").alias("n")).select("name", "n.place_key", "n.kind")
    by_tag = tags.join(one, "name").groupBy("id", "place_key", "kind").agg(F.min("at").alias("at"))
    by_tag = by_tag.select("id", F.lit("hashtag").alias("source"), "place_key", "kind", F.lit(False).alias("locative"), F.lit(False).alias("origin"), F.format_string("%09d", "at").alias("seq"))

    texts = F.array(*[F.struct(F.lit(s).alias("source"), F.lower(F.coalesce(c, F.lit(""))).alias("text")) for s, c in
                      (("playlist", F.col("playlist")), ("title", F.col("title")), ("prose", first_sentences(F.col("prose"))))])
    long = zoned.select("id", F.explode(texts).alias("t")).select("id", "t.source", "t.text")
    long = long.withColumn("w", tx.words(F.col("text")))
    keyed = names.withColumn("phrase", F.array_join(tx.words(F.col("name")), " ")).where("phrase <> ''")
    found = F.array_distinct(F.transform(runs_of(F.col("w"), keyed), lambda g: g["phrase"]))
    runs = long.select("id", "source", "text", F.explode(found).alias("phrase"))
    met = runs.join(keyed, "phrase")
    pattern = F.concat(F.lit(r"(?<![a-z0-9_])\Q"), F.col("name"), F.lit(r"\E(?![a-z0-9_])"))
    met = met.withColumn("at", F.regexp_instr("text", pattern)).where("at > 0")
    before = F.substring("text", F.greatest(F.lit(1), F.col("at") - 24), F.least(F.lit(24), F.col("at") - 1))
    last = F.element_at(F.split(F.trim(F.regexp_replace(before, r"[^a-z\s]", " ")), r"\s+"), -1)
    return met.withColumn("last", last).select(
        "id", "source", "place_key", "kind", F.col("last").isin(*vocab.LOCATIVE).alias("locative"), F.col("last").isin(*vocab.ORIGIN).alias("origin"), "seq"
    ).unionByName(by_tag)


def best_place(candidates: DataFrame) -> DataFrame:
    """(id, place_key, source): the best candidate of each id: position words, city before state, source, then order."""
    where = F.when(F.col("locative"), 0).when(F.col("origin"), 2).otherwise(1)
    kind = F.when(F.col("kind") == "city", 0).otherwise(1)
    source = F.when(F.col("source") == "playlist", 0).when(F.col("source") == "hashtag", 1).when(F.col("source") == "title", 2).otherwise(3)
    key = F.struct(where, kind, source, F.col("seq"), F.col("place_key"))
    return candidates.groupBy("id").agg(F.min_by(F.struct("place_key", "source"), key).alias("b")).select("id", "b.place_key", "b.source")


def _plain_words(c: Column) -> Column:
    """Words of [a-z0-9_] in which only neighbours with exactly one space between them are adjacent."""
    parted = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9_ ]+| {2,}", " | "), r"^ | $", "")
    return F.filter(F.split(parted, " "), lambda w: w != "")


def subject_scores(zoned: DataFrame, keywords: DataFrame) -> DataFrame:
    """(id, subject, score): 3 for a keyword in the title, 3 for a tag that holds it, 2 for each of up to 3 in the prose.

    keywords has (subject, keyword). The words of a row are counted once and met with the keywords by equality.
    """
    count = lambda w, z: F.transform(runs_of(F.col(w), keywords, "keyword"), lambda g: F.struct(g["phrase"].alias("keyword"), F.lit(z).alias("zone")))
    worded = zoned.select("id", _plain_words(F.col("title")).alias("wt"), _plain_words(F.col("prose")).alias("wp"))
    found = worded.select("id", F.explode(F.concat(count("wt", "t"), count("wp", "p"))).alias("g")).select("id", "g.keyword", "g.zone")
    met = found.join(keywords, "keyword").groupBy("id", "subject", "keyword").agg(
        F.sum((F.col("zone") == "t").cast("long")).alias("t"), F.sum((F.col("zone") == "p").cast("long")).alias("p")
    )
    worded = met.select("id", "subject", (F.col("t") * 3 + F.least("p", F.lit(3)) * 2).alias("score"))
    tags = zoned.select("id", F.explode("hashtags").alias("tag"))
    squeezed = keywords.select("subject", F.regexp_replace("keyword", r"\s+", "").alias("squeezed"))
    # a tag that holds a keyword has a run of letters that is one: runs of the keywords' lengths meet them by equality
    lengths = [r[0] for r in squeezed.select(F.length("squeezed")).where("squeezed <> ''").distinct().collect()]  # at most the longest keyword
    cut_out = lambda n: F.when(F.length("tag") >= n, F.transform(F.sequence(F.lit(1), F.length("tag") - n + 1), lambda i: F.substring(F.col("tag"), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    parts = F.array_distinct(F.concat(F.array().cast("array<string>"), *[cut_out(n) for n in sorted(lengths)]))
    holds = tags.select("tag").distinct().select("tag", F.explode(parts).alias("squeezed")).join(squeezed, "squeezed")
    holds = holds.groupBy("tag", "subject").agg((F.count("*") * 3).alias("score"))
    tagged = tags.join(holds, "tag").select("id", "subject", "score")
    return worded.unionByName(tagged).groupBy("id", "subject").agg(F.sum("score").alias("score"))


def subject_tags(scores: DataFrame, subjects: tuple[str, ...] = vocab.SUBJECTS, least: int = 4, most: int = 3) -> DataFrame:
    """(id, subjects): the best `most` subjects with at least `least` points; ties in the order of the vocabulary."""
    rank = F.array_position(F.array(*[F.lit(s) for s in subjects]), F.col("subject"))
    listed = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), rank.alias("r"), F.col("subject").alias("subject"))))
    kept = scores.where(F.col("score") >= least).groupBy("id").agg(F.slice(listed, 1, most).alias("best"))
    return kept.select("id", F.transform("best", lambda b: b["subject"]).alias("subjects"))


def year_of(title: Column, prose: Column) -> Column:
    """The first year from 1930 to 2029 that stands as a word of its own, else null."""
    found = F.regexp_extract(F.concat_ws(" ", F.coalesce(title, F.lit("")), prose), r"(?<![A-Za-z0-9_])(19[3-9]\d|20[0-2]\d)(?![A-Za-z0-9_])", 1)
    return F.nullif(found, F.lit("")).cast("int")


def rejected_by(title: Column, rules: tuple[tuple[str, str], ...] = vocab.REJECTED) -> Column:
    """The name of the first rule that refuses the title, else null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(F.rlike(title, F.lit(pattern)), name).otherwise(out)
    return out


def fresh_items(log: DataFrame, id_col: Column, tombstones: DataFrame) -> DataFrame:
    """The log's first row of each id that has a title, without the dead: (id, log_id, title, description, playlist,
    uploaded_at)."""
    from lodestar.operators.dedupe import keepers

    named = log.withColumn("id", id_col).where("id is not null and title is not null and title <> ''")
    stay = keepers(named, F.col("id"), "log_id").withColumnRenamed("log_id", "stay")
    first = named.join(stay, F.col("log_id") == F.col("stay"), "left_semi")
    alive = first.join(tombstones.select(F.col("video_id").alias("id")).where("id is not null").distinct(), "id", "left_anti")
    return alive.select("id", "log_id", "title", "description", F.col("playlist_title").alias("playlist"), F.col("published_at").alias("uploaded_at"))


def classified(items: DataFrame, gazetteer: DataFrame, aliases: DataFrame, keywords: DataFrame) -> DataFrame:
    """items with prose, rejected, place_id, place_source, subjects and year; nothing is left out yet."""
    zoned = cut(with_zones(items).withColumn("rejected", rejected_by(F.col("title"))))  # read by places, tags and the result
    open_ = zoned.where("rejected is null")
    place = best_place(place_candidates(open_, place_names(gazetteer, aliases))).select("id", F.col("place_key").alias("place_id"), F.col("source").alias("place_source"))
    tags = subject_tags(subject_scores(open_, keywords))
    out = zoned.join(place, "id", "left").join(tags, "id", "left").withColumn("subjects", F.coalesce("subjects", F.array().cast("array<string>")))
    return out.withColumn("year", year_of(F.col("title"), F.col("prose")))


def admitted(all_: DataFrame) -> DataFrame:
    """The clips: rows that are not rejected and have a place or a subject, with the first 800 characters of prose."""
    ok = all_.where((F.col("rejected").isNull()) & (F.col("place_id").isNotNull() | (F.size("subjects") > 0)))
    return ok.select("id", "title", F.substring("prose", 1, MOST_TEXT).alias("text"), "place_id", "subjects", "year", "uploaded_at", F.lit(False).alias("is_placeholder"))


def diagnostics(all_: DataFrame) -> DataFrame:
    """(id, title, why): rejected rows by rule, rows without a place, rows without a subject; a row may have two."""
    open_ = all_.where("rejected is null")
    return (
        all_.where("rejected is not null").select("id", "title", F.col("rejected").alias("why"))
        .unionByName(open_.where("place_id is null").select("id", "title", F.lit("no place").alias("why")))
        .unionByName(open_.where(F.size("subjects") == 0).select("id", "title", F.lit("no subject").alias("why")))
    )


def used_places(clips: DataFrame, gazetteer: DataFrame, country: str = "India") -> DataFrame:
    """The gazetteer's entries that a clip uses."""
    return gazetteer.join(clips.select(F.col("place_id").alias("place_key")).where("place_key is not null").distinct(), "place_key", "left_semi").withColumn("country", F.coalesce("country", F.lit(country)))


def merge(base: DataFrame, fresh: DataFrame, dead: DataFrame) -> DataFrame:
    """base without the dead, rows of the same id replaced by fresh ones, new ones added; `carried` says which.

    A full outer join by id: a shuffle of both sides by a unique key.
    """
    cols = [c for c in base.columns if c != "id"]
    left = base.join(dead.select("id").distinct(), "id", "left_anti").select("id", F.struct(*cols).alias("b"))
    right = fresh.select("id", F.struct(*cols).alias("f"))
    both = left.join(right, "id", "full_outer").withColumn("r", F.coalesce("f", "b"))
    state = F.when(F.col("f").isNull(), "kept").when(F.col("b").isNull(), "new").otherwise("replaced")
    return both.select("id", *[F.col("r")[c].alias(c) for c in cols], state.alias("state"))


def refuse_shrinking(merged: DataFrame, base: DataFrame, dead: DataFrame) -> None:
    """Raise if the merge lost rows that it had to carry over."""
    carried = base.join(dead.select("id").distinct(), "id", "left_anti").count()
    if merged.count() < carried:
        raise ValueError(f"the merge would leave fewer than the {carried} rows carried over")


def report(log: DataFrame, id_col: Column, all_: DataFrame, dead: DataFrame) -> DataFrame:
    """One row of counts: log rows with an id and title, distinct ids, duplicates, departed, rejected, no_place, no_subject, matched."""
    named = log.withColumn("id", id_col).where("id is not null and title is not null and title <> ''")
    counts = named.agg(F.count("*").alias("log_rows"), F.countDistinct("id").alias("ids"))
    gone = named.select("id").distinct().join(dead.select(F.col("video_id").alias("id")), "id", "left_semi").agg(F.count("*").alias("departed"))
    open_ = F.col("rejected").isNull()
    none = F.size("subjects") == 0
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    kinds = all_.agg(
        one(~open_).alias("rejected"), one(open_ & F.col("place_id").isNull()).alias("no_place"), one(open_ & none).alias("no_subject"),
        one(open_ & (F.col("place_id").isNotNull() | ~none)).alias("matched"),
    )
    return counts.withColumn("duplicates", F.col("log_rows") - F.col("ids")).crossJoin(gone).crossJoin(kinds)


def round_robin(clips: DataFrame, n: int, most_text: int = 300, least_text: int = 120) -> DataFrame:
    """(id, place_id, round, text): n clips with a place, a subject and enough text, one of each place in turn.

    Only n rows of a place can be taken, so the window keeps at most n of each, on the map side first.
    """
    fit = clips.where((F.col("place_id").isNotNull()) & (F.size("subjects") > 0) & (F.length("text") > least_text))
    turn = F.row_number().over(Window.partitionBy("place_id").orderBy("id"))
    rounds = fit.select("id", "place_id", F.substring("text", 1, most_text).alias("text")).withColumn("round", turn).where(F.col("round") <= n)
    first = rounds.groupBy("place_id").agg(F.min("id").alias("first"))
    return rounds.join(first, "place_id").orderBy("round", "first", "id").limit(n).select("id", "place_id", "round", "text")


def export_ids(rows: DataFrame, known: DataFrame) -> dict[str, DataFrame]:
    """Ids of a spreadsheet export (n, id, link, title): the id column if it is one, else the link's.

    ids: (id, title, n) of the first row of each; counts: one row of rows, bad and duplicates; missing: ids not known.
    """
    own = F.when(F.rlike("id", F.lit(r"\A[A-Za-z0-9_-]{11}\z")), F.col("id"))
    linked = F.nullif(F.regexp_extract("link", r"(?:v=|youtu\.be/|/shorts/|/video/)([A-Za-z0-9_-]{11})(?![A-Za-z0-9_-])", 1), F.lit(""))
    parsed = rows.withColumn("found", F.coalesce(own, linked))
    first = parsed.where("found is not null").groupBy("found").agg(F.min_by(F.struct("title", "n"), "n").alias("r")).select(F.col("found").alias("id"), "r.title", "r.n")
    counts = parsed.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.col("found").isNull().cast("long")), F.lit(0)).alias("bad"), F.countDistinct("found").alias("ids"))
    counts = counts.withColumn("duplicates", F.col("rows") - F.col("bad") - F.col("ids"))
    return {"ids": first, "counts": counts, "missing": first.join(known.select("id"), "id", "left_anti")}


def gazetteer_of(states: DataFrame, cities: DataFrame, world: DataFrame) -> DataFrame:
    """One gazetteer from three lists (name, district, state, country, region, terrain, lat, lng); a later list wins a key.

    The key is the name in lower case with single spaces; a name of the world list that is its country or state is a state.
    """
    slug = F.regexp_replace(F.lower(tx.js_trim(F.col("name"))), r"\s+", " ")
    w_kind = F.when((F.col("name") == F.col("country")) | (F.col("name") == F.col("state")), "state").otherwise("city")
    parts = [(states, F.lit("state"), 0), (cities, F.lit("city"), 1), (world, w_kind, 2)]
    rows = [d.withColumn("kind", k).withColumn("place_key", slug).withColumn("level", F.lit(n)) for d, k, n in parts]
    both = rows[0].unionByName(rows[1]).unionByName(rows[2])
    rest = [c for c in both.columns if c not in ("place_key", "level")]
    # two entries of one list: the greater by its columns
    order = ["level", *[F.coalesce(c, F.lit("")) for c in ("name", "state", "district", "terrain", "region", "country")], *[F.coalesce(c, F.lit(-999.0)) for c in ("lat", "lng")]]
    best = both.groupBy("place_key").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select("place_key", *[F.col("r")[c].alias(c) for c in rest])


# ---- crawl bookkeeping ----


def known_ids(log: DataFrame, id_col: Column) -> DataFrame:
    """(id): the distinct ids of the log."""
    return log.select(id_col.alias("id")).where("id is not null").distinct()


def until_known_run(pages: DataFrame, known: DataFrame, run: int = 100) -> DataFrame:
    """The new rows of a newest-first listing (at, id), read until `run` known ids in a row have passed.

    No task sees the whole listing: rows are numbered by ranges, and new rows fall into buckets of `run` positions. Between
    a bucket's last new row and the first of the next bucket lies the only gap that can be long enough; where the next
    bucket is empty, it is. Position 0 stands for the start.
    """
    from lodestar.operators.archive import numbered

    placed = numbered(pages, [F.col("at"), F.col("id")])
    new = placed.join(known.select("id").distinct(), "id", "left_anti")
    at = new.select("pos").unionByName(new.sparkSession.createDataFrame([(0,)], "pos long"))
    ends = at.groupBy(F.floor(F.col("pos") / run).alias("bucket")).agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    after = ends.select((F.col("bucket") - 1).alias("bucket"), F.col("first").alias("following"))
    gaps = ends.join(after, "bucket", "left").where(F.col("following").isNull() | (F.col("following") - F.col("last") > run))
    return new.crossJoin(F.broadcast(gaps.agg(F.min("last").alias("stop")))).where("pos <= stop").select("at", "id")


def backfill_batches(asked: DataFrame, known: DataFrame, size: int = 50) -> DataFrame:
    """(batch, id): ids asked for and not known, in batches of `size` in the order of their hashes.

    The batch follows from the position inside a hash range, so no task orders all ids.
    """
    from lodestar.operators.archive import numbered

    todo = asked.select("id").where("id is not null").distinct().join(known.select("id"), "id", "left_anti")
    return numbered(todo, [F.col("id")]).select(F.ceil(F.col("pos") / size).cast("long").alias("batch"), "id")


def reconcile(known: DataFrame, alive: DataFrame, dead: DataFrame) -> DataFrame:
    """(id, state): known ids that are gone ('dead'), and old tombstones that live again ('revived')."""
    gone = known.select("id").distinct().join(alive.select("id"), "id", "left_anti").withColumn("state", F.lit("dead"))
    back = dead.select("id").distinct().join(alive.select("id"), "id", "left_semi").withColumn("state", F.lit("revived"))
    return gone.unionByName(back)


def pending_playlists(lists: DataFrame, done: DataFrame) -> DataFrame:
    """(playlists, items, units): lists that are not done and hold items, and the calls of 50 items that they need."""
    todo = lists.where("item_count > 0").join(done.select("playlist_id"), "playlist_id", "left_anti")
    out = todo.agg(F.count("*").alias("playlists"), F.coalesce(F.sum("item_count"), F.lit(0)).alias("items"))
    return out.withColumn("units", F.ceil(F.col("items") / 50).cast("long"))
