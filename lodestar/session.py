"""Session set-up and the few helpers that touch cluster state (checkpoints, size-checked broadcasts)."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its counted rows, each of the given width, stay below this.
BROADCAST_BYTES = 16 << 20


def build_session(app: str = "lodestar", cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the engine expects; on a cluster the submitter's settings win."""
    base = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors, once a session, so that their Python workers find it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_lodestar_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="lodestar-code-")  # the driver serves the file from here until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "lodestar.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(at, n), os.path.relpath(os.path.join(at, n), os.path.dirname(root)))
    sc.addPyFile(path)
    sc._lodestar_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; a single file and a folder of files read alike."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where that is unset and all runs on
    this machine. On a cluster without it there is no safe place, so RuntimeError."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "lodestar-checkpoints")


def checkpoint_dir(spark: SparkSession) -> str:
    """This session's own folder under the shared one, where cut() writes."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
        # what a session has cut is of no use to another
        atexit.register(_remove, spark, sc._jsc.sc().getCheckpointDir().get())
    return sc._jsc.sc().getCheckpointDir().get()


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001, S110  the session may have ended with the folder
        pass


def cut(df: DataFrame) -> DataFrame:
    """Write a frame to the shared checkpoint folder and go on from the files.

    Cuts the lineage, so that a lost executor costs a re-read and not a re-run.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark df for broadcast if its counted rows times row_bytes stay within limit; else leave the join to be shuffled.

    df should come from cut(), as it is counted here and read again by the join.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df
