"""Lines repeated across one source's documents, found and removed (problem 2).

Lines are the same if their letters are. Each is hashed to 128 bits in the JVM; a row's distinct hashes are counted by
source and hash with partial aggregation, so a hot line leaves each task as one row. The lines above the thresholds are
few (a source cannot have more of them than mean lines per row / share), are written to the checkpoint folder and counted.
If they are small, every row gets its source's list by broadcast and drops the lines in place, and no text is shuffled;
else single lines are joined by source and hash under salts, so that a line of a third of all rows is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.session import BROADCAST_BYTES, cut

#: Bytes of a frequent line in a broadcast, and salts of a line where its rows are shuffled.
LINE_BYTES, SALTS = 64, 32


def letters(line: Column) -> Column:
    """The lower-cased Unicode letters of a line, all else left out."""
    return F.regexp_replace(F.lower(line), r"\P{L}+", "")


def _hashes(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))


def frequent_lines(
    df: DataFrame, source: str, text: str, min_letters: int = 12, min_rows: int = 5, min_share: float = 0.08
) -> DataFrame:
    """(src, h1, h2): the lines in at least min_rows rows and min_share of their source's rows with a text.

    Rows with a null source or text are left out; a line counts once a row; shorter lines never count.
    """
    rows = df.select(F.col(source).alias("src"), F.col(text).alias("text")).where("src is not null and text is not null")
    totals = rows.groupBy("src").agg(F.count("*").alias("total"))
    keys = F.filter(F.transform(F.split("text", "\n", -1), letters), lambda x: F.length(x) >= min_letters)
    per_row = rows.select("src", F.explode(F.array_distinct(F.transform(keys, _hashes))).alias("h"))
    counted = per_row.groupBy("src", "h.h1", "h.h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_rows)
    return counted.join(totals, "src").where(F.col("n") >= min_share * F.col("total")).select("src", "h1", "h2")


def _listed(df: DataFrame, source: str, frequent: DataFrame) -> DataFrame:
    """df with `__lines`, the frequent lines of its source or null, by broadcast."""
    lists = frequent.groupBy(F.col("src").alias(source)).agg(F.collect_list(F.struct("h1", "h2")).alias("__lines"))
    return df.join(F.broadcast(lists), source, "left")


def keyed_lines(text: Column) -> Column:
    """Structs (line, key, h) of a text's lines: as written, its letters, and their hashes."""
    keyed = F.transform(F.split(text, "\n", -1), lambda x: F.struct(x.alias("line"), letters(x).alias("key")))
    return F.transform(keyed, lambda s: F.struct(s["line"].alias("line"), s["key"].alias("key"), _hashes(s["key"]).alias("h")))


def _is_small(frequent: DataFrame) -> bool:
    return frequent.count() * LINE_BYTES <= BROADCAST_BYTES


def _removable(df: DataFrame, frequent: DataFrame, small: bool, row_id: str, source: str, text: str, min_letters: int) -> DataFrame:
    rows = df.select(F.col(row_id).alias("row_id"), F.col(source).alias("src"), F.col(text).alias("text")).where("src is not null and text is not null")
    if small:
        rows = _listed(rows, "src", frequent).where("__lines is not null")
    lines = (
        rows.select("row_id", "src", *(["__lines"] if small else []), F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
        .withColumn("key", letters(F.col("line"))).where(F.length("key") >= min_letters)
    )
    lines = lines.select("row_id", "src", (F.col("at") + 1).alias("line_no"), _hashes(F.col("key")).alias("h"), *(["__lines"] if small else []))
    if small:
        hit = lines.where(F.array_contains("__lines", F.col("h")))
    else:
        salt = F.pmod(F.xxhash64("row_id", "line_no"), F.lit(SALTS)).cast("int").alias("salt")
        salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hit = lines.select("row_id", "src", "line_no", "h.h1", "h.h2", salt).join(salted, ["src", "h1", "h2", "salt"], "left_semi")
    return hit.select(F.col("row_id").alias(row_id), "line_no")


def removable(df: DataFrame, row_id: str, source: str, text: str, min_letters: int = 12, **limits: float) -> DataFrame:
    """(row_id, line_no): every line to be removed, numbered from 1. An empty table gives no rows."""
    frequent = cut(frequent_lines(df, source, text, min_letters, **limits))
    return _removable(df, frequent, _is_small(frequent), row_id, source, text, min_letters)


def without_frequent(df: DataFrame, row_id: str, source: str, text: str, min_letters: int = 12, **limits: float) -> DataFrame:
    """df with `text` rebuilt without the repeated lines; row_id must be unique.

    A text that loses all its lines becomes empty, a null one stays null; the other lines keep their order and ends.
    """
    frequent = cut(frequent_lines(df, source, text, min_letters, **limits))
    if _is_small(frequent):
        stay = F.filter("__keyed", lambda s: (F.length(s["key"]) < min_letters) | ~F.array_contains(F.col("__lines"), s["h"]))
        rebuilt = F.array_join(F.transform(stay, lambda s: s["line"]), "\n")
        keyed = F.when(F.col("__lines").isNotNull(), keyed_lines(F.col(text)))
        out = _listed(df, source, frequent).withColumn("__keyed", keyed).withColumn(text, F.when(F.col("__keyed").isNull(), F.col(text)).otherwise(rebuilt))
        return out.select(*df.columns)
    out = _removable(df, frequent, False, row_id, source, text, min_letters).groupBy(row_id).agg(F.collect_set("line_no").alias("__out"))
    numbered = F.transform(F.split(F.col(text), "\n", -1), lambda x, i: F.struct((i + 1).alias("no"), x.alias("line")))
    kept = F.filter(numbered, lambda x: ~F.array_contains(F.col("__out"), x["no"]))
    rebuilt = F.when(F.col("__out").isNull(), F.col(text)).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))
    return df.join(out, row_id, "left").withColumn(text, rebuilt).select(*df.columns)
