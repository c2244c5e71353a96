"""Incremental ingest as Structured Streaming: new log files in, one row of each id out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.dedupe import clean_id

LOG = "log_id long, batch_id long, video_id string, title string, description string, published_at string, playlist_title string, channel_title string, fetched_at timestamp"


def log_stream(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """The growing log of Parquet files as a stream."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def within_watermark(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """The stream without repeats of an id that arrive within `late` of one another; state is dropped behind the watermark.

    Rows without an id or a time are not told apart and are left to the batch path.
    """
    known = stream.withColumn("id", clean_id(F.col("video_id"))).where("id is not null and fetched_at is not null")
    return known.withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(["id"])


def per_window(stream: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, channel_title, n) deliveries by window and channel."""
    timed = stream.where("fetched_at is not null").withWatermark("fetched_at", late)
    return timed.groupBy(F.window("fetched_at", width), "channel_title").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "channel_title", "n")


#: Parts of the table of first rows, by the hash of the id; a micro-batch rewrites only those that it touches.
BUCKETS = 64


def upsert_first(batch: DataFrame, target: str, id_col: Column, buckets: int = BUCKETS) -> None:
    """Merge a micro-batch into the table of first rows at `target`: the least log_id of an id stays, whatever the order in
    which files arrive.

    The table is split into buckets by the hash of the id. A batch writes new versions (b<bucket>/v<n>) of the buckets that
    it touches, reads no others, and then one small manifest of the versions in force; the manifest decides, so a failed
    write leaves the state before it, and a repeated batch gives the same rows again. Versions that no manifest of the last
    two names are deleted.
    """
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
    fresh = batch.withColumn("id", id_col).where("id is not null").withColumn("bucket", bucket)
    touched = sorted(r.bucket for r in fresh.select("bucket").distinct().collect())  # at most `buckets` rows
    if not touched:
        return
    number, now = manifest(spark, target)
    old = [f"{target}/b{b}/v{now[b]}" for b in touched if b in now]
    both = fresh.unionByName(spark.read.parquet(*old).withColumn("bucket", bucket)) if old else fresh
    rest = [c for c in both.columns if c not in ("id", "log_id", "bucket")]
    merged = both.groupBy("bucket", "id").agg(F.min_by(F.struct("log_id", *rest), "log_id").alias("r")).select("bucket", "id", "r.*")
    staged = f"{target}/staged-{number + 1}"
    merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(staged)
    fs, path = _files(spark, target)
    for b in touched:
        fs.delete(path(f"{target}/b{b}/v{number + 1}"), True)
        fs.mkdirs(path(f"{target}/b{b}"))
        fs.rename(path(f"{staged}/bucket={b}"), path(f"{target}/b{b}/v{number + 1}"))
    fs.delete(path(staged), True)
    state = spark.createDataFrame([(b, number + 1 if b in touched else v) for b, v in {**dict.fromkeys(touched, 0), **now}.items()], "bucket int, version int")
    state.coalesce(1).write.mode("overwrite").parquet(f"{target}/manifest/m{number + 1}")
    for b in touched:  # the version before stays for readers of the last manifest
        for s in fs.listStatus(path(f"{target}/b{b}")):
            name = s.getPath().getName()
            if name[1:].isdigit() and int(name[1:]) < now.get(b, 0):
                fs.delete(s.getPath(), True)
    for n in _numbers(spark, target):
        if n < number:
            fs.delete(path(f"{target}/manifest/m{n}"), True)


def _files(spark: SparkSession, target: str):  # noqa: ANN202
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(target).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _numbers(spark: SparkSession, target: str) -> list[int]:
    """Numbers of the complete manifests."""
    fs, path = _files(spark, target)
    if not fs.exists(path(f"{target}/manifest")):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path(f"{target}/manifest")) if fs.exists(path(s.getPath(), "_SUCCESS"))]
    return sorted(int(n[1:]) for n in names if n[1:].isdigit())


def manifest(spark: SparkSession, target: str) -> tuple[int, dict[int, int]]:
    """(number, version by bucket) of the newest complete manifest; (0, {}) without one."""
    numbers = _numbers(spark, target)
    if not numbers:
        return 0, {}
    return numbers[-1], {r.bucket: r.version for r in spark.read.parquet(f"{target}/manifest/m{numbers[-1]}").collect()}


def current(spark: SparkSession, target: str) -> tuple[int, DataFrame] | None:
    """(number, table) of the newest complete state, or None."""
    number, now = manifest(spark, target)
    return (number, spark.read.parquet(*[f"{target}/b{b}/v{v}" for b, v in sorted(now.items())])) if now else None


def run_upsert(spark: SparkSession, path: str, target: str, checkpoint: str, files_a_batch: int = 100) -> DataFrame:
    """Read all log files that are new since the last run, merge them, and return the table of first rows."""
    id_col = clean_id(F.col("video_id"))
    query = (
        log_stream(spark, path, files_a_batch).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda batch, _: upsert_first(batch, target, id_col)).start()
    )
    query.awaitTermination()
    now = current(spark, target)
    return now[1] if now else spark.createDataFrame([], f"id string, {LOG}")
