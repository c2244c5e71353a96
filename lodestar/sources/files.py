"""File sources and sinks: archive JSON, JSON lines, CSV, Parquet, compressed packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM = T.StructType([
    T.StructField("snippet", T.StructType([
        T.StructField("title", T.StringType()), T.StructField("description", T.StringType()), T.StructField("publishedAt", T.StringType()),
        T.StructField("resourceId", T.StructType([T.StructField("videoId", T.StringType())])),
    ])),
    T.StructField("playlistTitle", T.StringType()),
])
CLIP = "id string, title string, text string, placeId string, subjects array<string>, year int, uploadedAt string, isPlaceholder boolean"
PLACE = "id string, name string, district string, state string, country string, region string, terrain string, lat double, lng double"
ARCHIVE = f"source string, places array<struct<{PLACE.replace(' string', ': string').replace(' double', ': double')}>>, clips array<struct<{CLIP.replace(' string', ': string').replace(' array', ': array').replace(' int,', ': int,').replace(' boolean', ': boolean')}>>"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_archive(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, str]:
    """(clips, places, source) of one archive document; the plain file wins over path.gz; FileNotFoundError without either."""
    for candidate in (path, f"{path}.gz"):
        if _exists(spark, candidate):
            whole = spark.read.schema(ARCHIVE).option("multiLine", True).json(candidate)
            row = whole.select("source").first()
            clips = whole.select(F.posexplode("clips").alias("pos", "c")).select("pos", "c.*")
            return clips, whole.select(F.explode("places").alias("p")).select("p.*"), row.source if row else ""
    raise FileNotFoundError(path)


def read_log(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The crawl log of JSON lines: blank and torn lines are left out; limit counts parsed rows."""
    rows = spark.read.schema(T.StructType([*ITEM.fields, T.StructField("_torn", T.StringType())])).option("columnNameOfCorruptRecord", "_torn").json(path)
    good = rows.where("_torn is null and snippet is not null").drop("_torn")
    return good.limit(limit) if limit is not None else good


def append_log(items: DataFrame, path: str) -> None:
    """Append items to the log as new files of JSON lines."""
    items.write.mode("append").json(path)


def flat_items(log: DataFrame) -> DataFrame:
    """(video_id, title, description, published_at, playlist_title) of nested items."""
    return log.select(
        F.col("snippet.resourceId.videoId").alias("video_id"), F.col("snippet.title").alias("title"), F.col("snippet.description").alias("description"),
        F.col("snippet.publishedAt").alias("published_at"), F.col("playlistTitle").alias("playlist_title"),
    )


def write_archive(clips: DataFrame, places: DataFrame, diagnostics: DataFrame, path: str, compression: str = "gzip") -> None:
    """Clips, places and the three kinds of diagnostics as compressed JSON lines, diagnostics by kind."""
    clips.write.mode("overwrite").option("compression", compression).json(f"{path}/clips")
    places.write.mode("overwrite").option("compression", compression).json(f"{path}/places")
    diagnostics.write.mode("overwrite").partitionBy("why").option("compression", compression).json(f"{path}/unmatched")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with every field quoted and quotes doubled."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What write_csv wrote."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def read_tombstones(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, checked_at) of a tombstone document {checkedAt, note, ids}."""
    doc = spark.read.schema("checkedAt string, note string, ids array<string>").option("multiLine", True).json(path)
    return doc.select(F.explode("ids").alias("video_id"), F.col("checkedAt").alias("checked_at"))


def migrate_state(state: DataFrame, default: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(state, items): an old crawl state that holds its items inline is split into the state row and the items' rows."""
    if "items" not in state.columns:
        return state, state.select(F.lit(None).cast("string").alias("item")).limit(0)
    return state.drop("items"), state.select(F.explode("items").alias("item"))


STATE = "pageToken string, count long, donePlaylists array<string>, backfillCursor long, reconciledAt string"


def save_state(spark: SparkSession, path: str, **state: object) -> None:
    """Write the crawl state (fields of STATE) as one JSON row, beside the one before until it is complete."""
    spark.createDataFrame([tuple(state.get(f.split()[0]) for f in STATE.split(", "))], STATE).coalesce(1).write.mode("overwrite").json(path)


def load_state(spark: SparkSession, path: str, log_path: str | None = None) -> dict[str, object]:
    """The crawl state; a fresh one, {count: 0}, if it is absent or unreadable. An old state with its items inline is
    migrated: they are appended to the log at log_path, unless there is one, and only token and count stay."""
    if not _exists(spark, path):
        return {"count": 0}
    state = spark.read.option("multiLine", True).json(path)
    if "items" in state.columns:
        items = migrate_state(state)[1].select("item.*")
        if log_path and not _exists(spark, log_path):
            append_log(items, log_path)
        token = state.first()["pageToken"] if "pageToken" in state.columns else None
        return {"pageToken": token, "count": items.count()}
    row = spark.read.schema(STATE).option("multiLine", True).option("mode", "PERMISSIVE").json(path).first()
    out = {k: v for k, v in (row.asDict() if row else {}).items() if v is not None}
    return {"count": 0, **out}


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """(subject, keyword) of a CSV with these two columns: a vocabulary for the tagger in place of the rule-made one."""
    return read_csv(spark, path, "subject string, keyword string").where("subject is not null and keyword is not null").select("subject", F.lower(F.trim("keyword")).alias("keyword")).where("keyword <> ''").distinct()
