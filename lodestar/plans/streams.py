"""Queries that run the streaming path over a log table and give its result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestar.plans.delivery_and_places import _VIDEO
from lodestar.session import checkpoint_dir, table
from lodestar.streaming import ingest


def stream_dedupe_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rows of each video by the stream; the log table is replayed as files in the shared folder."""
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    table(spark, sf_dir, "youtube_items").repartition(3, "log_id").write.parquet(f"{base}/log")
    return ingest.run_upsert(spark, f"{base}/log", f"{base}/first", f"{base}/offsets", files_a_batch=1).select("id", "log_id")


QUERIES = {"stream_dedupe_upsert": stream_dedupe_upsert}
SQL = {"stream_dedupe_upsert": f"WITH v AS (SELECT log_id, {_VIDEO} AS id FROM youtube_items) SELECT id, min(log_id) AS log_id FROM v WHERE id IS NOT NULL GROUP BY 1"}
