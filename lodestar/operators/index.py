"""The inverted index as four tables: docs, postings, terms, stats; built, written, read back or rebuilt."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.session import cut

VERSION = 1
TITLE_WEIGHT, MOST_TF = 3, 65535


@dataclass
class Index:
    """docs (id, len), postings (term, id, tf), terms (term, df, cf), stats (one row: n_docs, avg_len, n_terms, n_postings)."""

    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame


def weighted_terms(clips: DataFrame, title_weight: int = TITLE_WEIGHT) -> DataFrame:
    """(id, term, tf): occurrences, a title's counted title_weight times. Rows without an id or a term are left out.

    Both texts are exploded as one array, so the table is read once and shuffled once.
    """
    weigh = lambda c, w: F.transform(tx.tokens(F.coalesce(c, F.lit(""))), lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))
    both = F.concat(weigh(F.col("title"), title_weight), weigh(F.col("text"), 1))
    found = clips.where("id is not null").select("id", F.explode(both).alias("t"))
    return found.groupBy("id", "t.term").agg(F.sum("t.w").cast("int").alias("tf"))


def build(clips: DataFrame, title_weight: int = TITLE_WEIGHT) -> Index:
    """Index clips (id, title, text). Documents without terms are not counted; lengths are unclamped, postings clamped."""
    counted = weighted_terms(clips, title_weight)
    docs = counted.groupBy("id").agg(F.sum("tf").alias("len"))
    postings = counted.select("term", "id", F.least("tf", F.lit(MOST_TF)).alias("tf"))
    terms = counted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    sizes = docs.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    stats = sizes.crossJoin(terms.agg(F.count("*").alias("n_terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("n_postings")))
    return Index(docs, postings, terms, stats)


def warmed(index: Index) -> Index:
    """The index on the shared checkpoint folder, for several searches of one session."""
    return Index(*(cut(t) for t in (index.docs, index.postings, index.terms, index.stats)))


def fingerprint(rows: DataFrame) -> str:
    """A name of a table's contents: its rows, their number and the sum and xor of their hashes, in one narrow pass."""
    h = F.xxhash64(*[F.col(c) for c in rows.columns])
    r = rows.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return f"{r.n}-{r.x & (1 << 64) - 1:x}-{int(r.s) & (1 << 64) - 1:x}"


def save(index: Index, path: str, archive_size: int | str) -> None:
    """Write the index; postings are ranged and sorted by term, so that a reader of few terms skips row groups.
    archive_size is the size or fingerprint of the archive."""
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    index.postings.repartitionByRange("term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
    index.terms.write.mode("overwrite").parquet(f"{path}/terms")
    marked = index.stats.withColumn("version", F.lit(VERSION)).withColumn("archive_size", F.lit(str(archive_size)))
    marked.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")  # last: an index without it does not count


def load(spark: SparkSession, path: str, archive_size: int | str) -> Index | None:
    """The written index, or None if it is absent, of another version, of another archive or unreadable."""
    try:
        stats = spark.read.parquet(f"{path}/stats")
        row = stats.first()
        if row is None or row.version != VERSION or row.archive_size != str(archive_size):
            return None
        docs, postings, terms = (spark.read.parquet(f"{path}/{t}") for t in ("docs", "postings", "terms"))
        return Index(docs, postings, terms, stats.drop("version", "archive_size"))
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e) or "parquet" in str(e).lower():
            return None
        raise


def open_or_build(spark: SparkSession, path: str, clips: DataFrame) -> Index:
    """The index at path if it fits the clips, else a new one, written there."""
    n = clips.count()
    found = load(spark, path, n)
    if found is None:
        save(build(clips), path, n)
        found = load(spark, path, n)
        assert found is not None
    return found


def opened(raw: DataFrame, clips_of_raw, folder: str) -> tuple[Index, DataFrame]:  # noqa: ANN001
    """(index, clips) of the raw archive rows, both written under `folder` by their fingerprint and read back.

    The first call builds: clips_of_raw(raw) gives the clips. Later calls, of any session, scan the raw rows once for the
    fingerprint and open the files. Index files without their last part do not count, so a broken build is done again.
    """
    spark, mark = raw.sparkSession, fingerprint(raw)
    path = f"{folder}/lodestar-index/{mark}"
    found = load(spark, path, mark)
    if found is None:
        clips_of_raw(raw).write.mode("overwrite").parquet(f"{path}/clips")
        save(build(spark.read.parquet(f"{path}/clips")), path, mark)
        found = load(spark, path, mark)
        assert found is not None
    return found, spark.read.parquet(f"{path}/clips")


def idf(df: Column, n_docs: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def rarity_of(weight: Column) -> Column:
    """A bounded multiplier from the largest idf of a phrase; null (no token) is 1."""
    return F.coalesce(F.least(F.lit(1.6), F.greatest(F.lit(0.35), weight / 4.5)), F.lit(1.0))


def term_rarity(phrases: DataFrame, index: Index) -> DataFrame:
    """phrases (phrase, ...) with `rarity`: that of its rarest token; 1 without tokens; an unknown token has df 0."""
    one = phrases.select("phrase").distinct()
    parts = one.select("phrase", F.explode(tx.tokens(F.col("phrase"))).alias("term"))
    known = parts.join(index.terms.select("term", "df"), "term", "left").crossJoin(F.broadcast(index.stats.select("n_docs")))
    best = known.groupBy("phrase").agg(F.max(idf(F.coalesce("df", F.lit(0)), F.col("n_docs"))).alias("w"))
    return phrases.join(best, "phrase", "left").withColumn("rarity", rarity_of(F.col("w"))).drop("w")
