"""Session settings the jobs are written for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # checkpointed intermediates go when nothing refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # sessions are merged inside each map partition before they are shuffled,
    # so one very active key does not arrive row by row in a single task
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
}


def build_session(app: str = "quotelens", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints: the cluster's own setting where there is one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="quotelens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/quotelens-{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Write an intermediate result that several later steps read to the shared checkpoint folder, as columns.

    Lost executors read it again instead of recomputing the whole lineage; later steps read only the columns they need.
    """
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that must not be broadcast.

    Spark judges a side by the size of its files. Rows that an explode has spread, or strings that Parquet keeps in a
    dictionary, are many times larger in memory, and a broadcast passes them through the driver.
    """
    return df.hint("merge")


def new_folder(spark: SparkSession) -> str:
    """A folder of its own among the intermediates of this application."""
    return f"{_folder(spark)}/{uuid.uuid4().hex}"


def clear_intermediates(spark: SparkSession) -> None:
    """Delete what :func:`cut` has written for this application; call it when its results are no longer read."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
