"""Column expressions over text: tokens, stems, normal forms, n-grams. All stay in the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions import vocab

#: An ASCII word border; the JVM's own \b counts letters of other scripts as word characters.
ASCII_BORDER = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def ascii_borders(pattern: str) -> str:
    """The pattern with every \\b meaning a border of ASCII words."""
    return pattern.replace(r"\b", ASCII_BORDER)


def js_trim(c: Column) -> Column:
    """Trim all Unicode white space."""
    return F.regexp_replace(c, r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")


def words(c: Column) -> Column:
    """Lower-case runs of a-z and 0-9, in order."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")


def stem(t: Column) -> Column:
    """The singular form of a lower-case word by suffix rules; short words and -ss words stay."""
    irregular = F.create_map(*[F.lit(x) for pair in vocab.IRREGULAR.items() for x in pair])
    n = F.length(t)
    cut = lambda k: F.substring(t, F.lit(1), n - k)
    regular = (
        F.when((n > 4) & F.endswith(t, F.lit("ies")), F.concat(cut(3), F.lit("y")))
        .when((n > 4) & F.endswith(t, F.lit("sses")), cut(2))
        .when(F.endswith(t, F.lit("ss")), t)
        .when((n > 4) & F.rlike(t, F.lit("(x|z|ch|sh)es$")), cut(2))
        .when((n > 3) & F.endswith(t, F.lit("s")), cut(1))
        .otherwise(t)
    )
    return F.coalesce(F.try_element_at(irregular, t), regular)


def content_words(c: Column, stop: tuple[str, ...] = vocab.STOPWORDS) -> Column:
    """Words of two or more letters that are no stop words, unstemmed."""
    return F.filter(words(c), lambda w: (F.length(w) > 1) & ~w.isin(*stop))


def tokens(c: Column, stop: tuple[str, ...] = vocab.STOPWORDS) -> Column:
    """The index terms of a text: content words, then stemmed; order and repeats are kept."""
    return F.transform(content_words(c, stop), stem)


def meaningful(c: Column, noise: tuple[str, ...] = vocab.TITLE_NOISE) -> Column:
    """Words of three or more letters that carry evidence."""
    return F.filter(words(c), lambda w: (F.length(w) > 2) & ~w.isin(*noise))


def normalise(c: Column) -> Column:
    """Lower case, letters and digits of any script kept, the rest single spaces."""
    kept = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")
    return F.trim(kept)


def bigrams(w: Column) -> Column:
    """Adjacent pairs of an array of words, joined by a space."""
    n = F.size(w)
    made = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))
    return F.when(n >= 2, made).otherwise(F.array().cast("array<string>"))


def ngrams(w: Column, most: int) -> Column:
    """Structs (start, size, phrase) of all runs of 1 to most words, longest first, then from the left.

    w should be a column of its own: an expression would be worked out again for every run.
    """

    def of(k: int) -> Column:
        run = lambda i: F.struct(i.alias("start"), F.lit(k).alias("size"), F.array_join(F.slice(w, i + 1, k), " ").alias("phrase"))
        made = F.transform(F.sequence(F.lit(0), F.size(w) - k), run)
        return F.when(F.size(w) >= k, made).otherwise(F.array().cast("array<struct<start:int,size:int,phrase:string>>"))

    return F.concat(*[of(k) for k in range(most, 0, -1)])


def word_start(title: Column, word: str) -> Column:
    """Whether a word of the title begins with `word`, case aside."""
    return F.rlike(title, F.lit(r"(?i)" + ASCII_BORDER + re.escape(word)))


def any_pattern(c: Column, patterns: tuple[str, ...]) -> Column:
    """Whether any of the patterns is found in c."""
    return reduce(lambda a, b: a | b, [F.rlike(c, F.lit(ascii_borders(p))) for p in patterns], F.lit(False))


def count_of(w: Column, most: int | None = None) -> Column:
    """(value, count) of an array's values is left to aggregation; this is its size or 0 for null."""
    return F.coalesce(F.size(w), F.lit(0)) if most is None else F.least(F.coalesce(F.size(w), F.lit(0)), F.lit(most))


# ---- the same expressions in DuckDB, for the oracles ----


def sql_list(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sql_stem(t: str) -> str:
    irregular = " ".join(f"WHEN {t} = '{k}' THEN '{v}'" for k, v in vocab.IRREGULAR.items())
    return (
        f"CASE {irregular} WHEN length({t}) > 4 AND suffix({t}, 'ies') THEN {t}[:-4] || 'y' WHEN length({t}) > 4 AND suffix({t}, 'sses') THEN {t}[:-3] "
        f"WHEN suffix({t}, 'ss') THEN {t} WHEN length({t}) > 4 AND regexp_matches({t}, '(x|z|ch|sh)es$') THEN {t}[:-3] "
        f"WHEN length({t}) > 3 AND suffix({t}, 's') THEN {t}[:-2] ELSE {t} END"
    )


def sql_words(c: str) -> str:
    return f"list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda x: x <> '')"


def sql_content(c: str) -> str:
    return f"list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda x: length(x) > 1 AND x NOT IN ({sql_list(vocab.STOPWORDS)}))"


def sql_tokens(c: str) -> str:
    return f"list_transform({sql_content(c)}, lambda t: {sql_stem('t')})"


def sql_meaningful(c: str) -> str:
    return f"list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda x: length(x) > 2 AND x NOT IN ({sql_list(vocab.TITLE_NOISE)}))"


def sql_any(c: str, patterns: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, '{p.replace(chr(39), chr(39) * 2)}')" for p in patterns) + ")"
