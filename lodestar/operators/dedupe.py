"""Exactly one copy of each message that was delivered at least once (problem 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A video id: 11 characters of this class, standing alone in the field.
VIDEO_ID = r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{11})(?![A-Za-z0-9_-])"


def clean_id(raw: Column, pattern: str = VIDEO_ID) -> Column:
    """The id inside a dirty field: what the pattern finds; a field without one counts as its own trimmed text, a blank
    one as null."""
    found = F.regexp_extract(raw, pattern, 1)
    bare = F.regexp_replace(raw, r"(?U)^[\s\x{FEFF}\x{200B}]+|[\s\x{FEFF}\x{200B}]+$", "")
    return F.when(found != "", found).otherwise(F.nullif(bare, F.lit("")))


#: Where a row without a time of delivery stands: after every real one. Times and positions lie below.
LAST = 5 * 10**18


def delivery_key(delivered: Column, tie: Column) -> Column:
    """struct(delivered, tie) packed into one number of 38 digits that orders the same, nulls of delivered last.

    A number of fixed width can be updated in place in an aggregation buffer, which keeps min_by in its hash form; a struct
    would make Spark sort. delivered is a whole number below LAST, tie any long.
    """
    wide = "decimal(20,0)"
    return F.coalesce(delivered.cast("long"), F.lit(LAST)).cast(wide) * F.lit(str(1 << 64)).cast(wide) + tie.cast("long").cast(wide)


def micros(time: Column) -> Column:
    """Microseconds since 1970 of a time without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), time.cast("timestamp_ntz"))


def _key(df: DataFrame, row_id: str, order: list[Column] | None) -> Column:
    row = F.col(row_id)
    whole = ("tinyint", "smallint", "int", "bigint")
    tie = row if df.schema[row_id].dataType.simpleString() in whole else F.xxhash64(row)
    if order is None:
        return delivery_key(row, row) if tie is row else F.struct(row)
    if len(order) == 1:
        kind = df.select(order[0]).schema[0].dataType.simpleString()
        if kind in whole:
            return delivery_key(order[0], tie)
        if kind.startswith("timestamp"):
            return delivery_key(micros(order[0]), tie)
    return F.struct(*order, row)  # other orders take the slower, sorting form


def keepers(df: DataFrame, id_col: Column, row_id: str, order: list[Column] | None = None) -> DataFrame:
    """(row_id) of the one row of each id that stays: the first delivered, ties broken by row_id.

    `order` is the time or position of delivery, null last; without it row_id itself is, as in a log numbered in the order
    of delivery. Hash aggregation by id: min_by over the pair (delivery, row_id), packed, with partial aggregation on the
    map side, so a hot id leaves each task as one row and needs no salting. Rows without an id are no copies of one
    another; they are not in the result.
    """
    named = df.select(id_col.alias("__id"), F.col(row_id), _key(df, row_id, order).alias("__key"))
    return named.where(F.col("__id").isNotNull() & F.col(row_id).isNotNull()).groupBy("__id").agg(F.min_by(row_id, "__key").alias(row_id)).select(row_id)


def keep_one(df: DataFrame, id_col: Column, row_id: str, order: list[Column] | None = None) -> DataFrame:
    """All columns of the rows that stay: one of each id, and every row whose id is null.

    row_id must be unique; rows repeated with the same row_id all stay or all go. Null row ids never stay for an id.
    An empty table gives an empty one. Only ids are shuffled for the choice; the rows join it by their unique row_id,
    which has no hot keys.
    """
    stay = keepers(df, id_col, row_id, order).withColumnRenamed(row_id, "__stay")
    named = df.withColumn("__id", id_col)
    with_id = named.where("__id is not null").join(stay, F.col(row_id) == F.col("__stay"), "left_semi")
    return with_id.unionByName(named.where("__id is null")).drop("__id")


def dropped(df: DataFrame, id_col: Column, row_id: str, order: list[Column] | None = None) -> DataFrame:
    """(row_id) of the rows that go, the complement of keep_one. Narrow: no payload is shuffled."""
    stay = keepers(df, id_col, row_id, order).withColumnRenamed(row_id, "__stay")
    return (
        df.select(id_col.alias("__id"), row_id)
        .where("__id is not null")
        .select(row_id)
        .join(stay, F.col(row_id) == F.col("__stay"), "left_anti")
    )
