"""Session construction and table loading shared by every query."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def build_session(app: str = "corpuscle", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects; on a cluster spark-submit supplies its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(os.environ.get("CORPUSCLE_PARTITIONS", 8)))
        .config("spark.driver.memory", os.environ.get("CORPUSCLE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark so that any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where none is set, one of its own in local mode, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_corpuscle_scratch", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark._corpuscle_scratch = tempfile.mkdtemp(prefix="corpuscle-")
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    """Removes a scratch table when the driver ends, through the file system that holds it."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone already; the folder is scratch space
        pass


def scratch(df: DataFrame) -> DataFrame:
    """Cuts the lineage: df is written to the shared folder as a table and read back, so that its size is known and its columns stay prunable. The table goes when the driver ends."""
    path = f"{shared_folder(df.sparkSession)}/scratch-{uuid.uuid4().hex}"
    atexit.register(_remove, df.sparkSession, path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """Cuts the lineage of what many plans start from: a reliable checkpoint in the shared folder, which keeps the rows' partitioning, so that groups and joins by its key need no shuffle, and the size that Spark has planned with."""
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    if getattr(spark, "_corpuscle_checkpoints", None) is None:  # a folder of this application alone
        spark._corpuscle_checkpoints = context.getCheckpointDir()
        atexit.register(_remove, spark, spark._corpuscle_checkpoints)
    return df.checkpoint()


@contextmanager
def small_broadcasts(spark: SparkSession, most: int = 1 << 20) -> Iterator[None]:
    """What is written inside broadcasts tables of this many bytes at most, unless it is told to. Spark goes by the compressed size of a shuffle, and the driver holds every table that several joins of a large plan broadcast at once."""
    before = {key: spark.conf.get(key, None) for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    try:
        for key, value in before.items():
            if value is None or size(value) > most:
                spark.conf.set(key, str(most))
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
