"""One-sentence descriptions, location lines and blurbs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.functions import vocab

#: Any sign that is no Latin letter, digit, punctuation or space.
FOREIGN = r"[^\p{IsLatin}\p{N}\p{P}\p{Z}]"


def clean_title(title: Column, junk: tuple[str, ...] = vocab.TITLE_JUNK) -> Column:
    """The title without noise; of a title with bars the longest part, the first of equals."""
    t = title
    for p in junk:
        t = F.regexp_replace(t, tx.ascii_borders(p), " ")
    parts = F.filter(F.transform(F.split(t, r"\|", -1), tx.js_trim), lambda p: p != "")
    longest = F.aggregate(parts, F.lit(""), lambda a, p: F.when(F.length(p) > F.length(a), p).otherwise(a))
    t = F.when(F.contains(t, F.lit("|")) & (F.size(parts) > 0), longest).otherwise(t)
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)\s{2,}", " "), r"(?U)\s+([,.:;])", "$1")
    return tx.js_trim(F.regexp_replace(t, r"(?U)^[\s\-–—:,.]+|[\s\-–—:,]+$", ""))


def usable(t: Column) -> Column:
    """Whether a cleaned title reads as a sentence: a word of two signs, and another script or three lower-case letters."""
    worded = F.size(F.filter(F.split(t, r"(?U)\s+"), lambda w: F.length(w) > 1)) > 0
    return worded & (F.rlike(t, F.lit(FOREIGN)) | F.rlike(t, F.lit("[a-z]{3}")))


def mentions(t: Column, name: Column, state: Column, district: Column) -> Column:
    """Whether a text names a place, its state or district, or begins a word like the place does (six letters)."""
    hay, prefix = F.lower(t), F.substring(F.lower(name), 1, 6)
    hit = F.contains(hay, F.lower(name)) | F.contains(hay, F.lower(state)) | F.coalesce(F.contains(hay, F.lower(district)), F.lit(False))
    return F.coalesce(hit | ((F.length(prefix) >= 5) & F.contains(hay, prefix)), F.lit(False))


def capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


def described(clips: DataFrame) -> DataFrame:
    """clips (title, subjects, and name, state, district, country of the place or nulls) with `sentence` and `location`."""
    t = clips.withColumn("cleaned", clean_title(F.col("title")))
    phrases = F.create_map(*[F.lit(x) for pair in vocab.SUBJECT_PHRASES.items() for x in pair])
    subject = F.coalesce(F.try_element_at(phrases, F.get("subjects", F.lit(0))), F.lit("Archive footage"))
    placed = F.col("name").isNotNull()
    template = F.when(placed, F.concat(subject, F.lit(" in "), F.col("name"))).otherwise(subject)
    latin = ~F.rlike("cleaned", F.lit(FOREIGN))
    appended = F.concat(F.regexp_replace("cleaned", "[.,;:!?]+$", ""), F.lit(", in "), F.col("name"))
    named = mentions(F.col("cleaned"), F.col("name"), F.col("state"), F.col("district"))
    own = F.when(latin & placed & ~named, appended).otherwise(F.col("cleaned"))
    t = t.withColumn("sentence", capital(F.when(usable(F.col("cleaned")), own).otherwise(template)))
    return t.withColumn("location", location(F.col("sentence"), F.col("name"), F.col("state"), F.col("country"))).drop("cleaned")


def location(sentence: Column, name: Column, state: Column, country: Column, home: str = "India") -> Column:
    """The line under a sentence: what it does not say of the place yet; null if nothing is left."""
    said = F.contains(F.lower(sentence), F.lower(name))
    far = F.when(name == country, F.when(~said, country)).when(said, country).otherwise(F.concat(name, F.lit(", "), country))
    near = F.when(said, F.when(name != state, state)).when(name == state, state).otherwise(F.concat(name, F.lit(", "), state))
    return F.when(name.isNull(), None).when(country.isNotNull() & (country != "") & (country != home), far).otherwise(near)


def blurb(text: Column, limit: int = 240) -> Column:
    """Prose without the shared tail: null below 40 characters, else cut after the last full sentence or with an ellipsis."""
    t = tx.js_trim(F.regexp_replace(text, vocab.BOILERPLATE, ""))
    head = F.substring(t, 1, limit)
    back = F.instr(F.reverse(head), " .")
    stop = F.when(back > 0, F.length(head) - back - 1).otherwise(-1)
    cut = F.when(stop > 90, F.substring(head, F.lit(1), stop + 1)).otherwise(F.concat(F.regexp_replace(head, r"(?U)[\s\x{FEFF}]+$", ""), F.lit("…")))
    return F.when(F.length(t) < 40, None).when(F.length(t) <= limit, t).otherwise(cut)


def cards(clips: DataFrame, places: DataFrame) -> DataFrame:
    """(id, sentence, location, blurb): what a tile shows; clips without a known place have no location."""
    at = places.select(F.col("id").alias("place_id"), "name", "state", "district", "country")
    return described(clips.join(at, "place_id", "left")).select("id", "sentence", "location", blurb(F.col("text")).alias("blurb"))
