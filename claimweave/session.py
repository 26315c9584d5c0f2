"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", memory)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Temporary folders of local sessions without spark.checkpoint.dir, by application: the setting can't be changed while a session runs.
LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see (spark.checkpoint.dir); where that is unset, a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = LOCAL.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="spark-")
        LOCAL[spark.sparkContext.applicationId] = folder
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Whether an execution's shuffle files are deleted at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A side of at most this many rows of one long is broadcast (72 MB with overhead); beyond it the join is shuffled.
FEW_ROWS = 1_500_000

#: What materialize() has written, by application.
WRITTEN: dict[str, list[str]] = {}


def clean(spark: SparkSession) -> int:
    """Delete what materialize() has written in this application; for a caller that has stored the results which depend on it (and calls projection.forget() too)."""
    jvm, paths = spark._jvm, WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(paths)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder as Parquet and read it again.

    The copy outlives lost executors, and iterative plans stay short. The shuffle files of the write go with its end; without the
    setting they stay until the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*written: DataFrame) -> None:
    """Delete what materialize() has written for these, once nothing that is still to be computed reads them."""
    for df in written:
        spark, files = df.sparkSession, df.inputFiles()
        folder = files[0].rpartition("/")[0] if files else ""
        known = WRITTEN.get(spark.sparkContext.applicationId, [])
        for path in [p for p in known if folder and folder.endswith("/" + p.rpartition("/")[2])]:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            known.remove(path)


def few(side: DataFrame) -> DataFrame:
    """The side, one number a row and written, with a broadcast hint if it has at most FEW_ROWS rows."""
    return F.broadcast(side) if side.count() <= FEW_ROWS else side


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Send at most so many rows at once to Python workers, unless the session says otherwise: of long texts, Spark's default of
    10,000 rows takes hundreds of MB in each worker, and as much beside the heap of its executor."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))
