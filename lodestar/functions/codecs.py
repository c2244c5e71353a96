"""Cookie, share and slug codecs as column expressions; decoding never raises, bad input gives nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION, MOST_ANSWER, MOST_SHARE = 7, 120, 2000


def _cut(c: Column) -> Column:
    return F.substring(F.trim(c), 1, MOST_ANSWER)


def _answers(pairs: Column, questions: tuple[str, ...]) -> Column:
    """A map of the known questions' answers, trimmed and cut, blank ones left out."""
    known = F.array(*[F.lit(q) for q in questions])
    kept = F.filter(pairs, lambda e: F.array_contains(known, e["key"]) & e["value"].isNotNull() & (F.trim(e["value"]) != ""))
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"], _cut(e["value"]).alias("value"))))


def encode_cookie(answers: Column, version: int = VERSION) -> Column:
    """Percent-encoded JSON {v, a} of a map of answers."""
    json = F.to_json(F.struct(F.lit(version).alias("v"), answers.alias("a")))
    out = F.regexp_replace(F.url_encode(json), r"\+", "%20")
    for coded, plain in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def decode_cookie(cookie: Column, questions: tuple[str, ...], version: int = VERSION) -> Column:
    """The answers of a cookie; an empty map for another version, a broken text or null."""
    json = F.try_url_decode(F.regexp_replace(cookie, r"\+", "%2B"))
    parsed = F.from_json(json, "v int, a map<string,string>")
    none = F.create_map().cast("map<string,string>")
    good = (parsed["v"] == version) & parsed["a"].isNotNull()
    return F.when(good, _answers(F.map_entries(parsed["a"]), questions)).otherwise(none)


def encode_share(answers: Column, questions: tuple[str, ...], version: int = VERSION) -> Column:
    """version~answer~answer..., blanks at the end left out, in URL-safe base64 without padding."""
    listed = F.array_join(F.array(*[F.coalesce(F.replace(_cut(F.try_element_at(answers, F.lit(q))), F.lit("~"), F.lit(" ")), F.lit("")) for q in questions]), "~")
    plain = F.regexp_replace(F.concat(F.lit(f"{version}~"), listed), "~+$", "")
    return F.regexp_replace(F.translate(F.base64(F.encode(plain, "UTF-8")), "+/\r\n", "-_"), "=+$", "")


def decode_share(share: Column, questions: tuple[str, ...], version: int = VERSION) -> Column:
    """The answers of a share text; an empty map for one that is too long, of another version, broken or null."""
    safe = F.translate(F.trim(share), "-_", "+/")
    padded = F.rpad(safe, (F.ceil(F.length(safe) / 4) * 4).cast("int"), F.lit("="))
    raw = F.try_to_binary(padded, F.lit("base64"))
    plain = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    parts = F.split(plain, "~", -1)
    pairs = F.array(*[F.struct(F.lit(q).alias("key"), F.get(parts, F.lit(i + 1)).alias("value")) for i, q in enumerate(questions)])
    good = (F.length(share) <= MOST_SHARE) & (F.get(parts, F.lit(0)) == str(version))
    return F.when(good, _answers(pairs, questions)).otherwise(F.create_map().cast("map<string,string>"))


def subject_of_slug(slug: Column, subjects: tuple[str, ...]) -> Column:
    """The subject that a URL part names, in any case and coding, else null."""
    word = F.lower(F.replace(F.try_url_decode(slug), F.lit("-"), F.lit(" ")))
    return F.when(word.isin(*subjects), word)
