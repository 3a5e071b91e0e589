"""Session construction and shared scratch locations.

Lineage is cut with tables written under
the cluster's shared ``spark.checkpoint.dir``.  The setting is read from the
running session; only when it is unset (local tests) is a private directory
chosen.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FALLBACK: dict[str, str] = {}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "millrate") -> SparkSession:
    """A session configured for the ledger jobs (AQE on, UTC, no UI).

    Memory and, unless given, the number of shuffle partitions stay as the
    cluster or spark-submit sets them.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Only a session on a local master may go without the setting (tests); it
    then gets a private temporary folder.  On a cluster an unset folder is an
    error: a folder of one machine is not seen by the others.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        key = sc.applicationId
        if key not in _LOCAL_FALLBACK:
            _LOCAL_FALLBACK[key] = tempfile.mkdtemp(prefix="millrate-ckpt-")
        configured = _LOCAL_FALLBACK[key]
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path (a URI if the setting is one) under the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def hadoop_path(spark: SparkSession, path: str):
    """(path, its file system) of Hadoop's API: any store that Spark reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_bytes(spark: SparkSession, path: str) -> int:
    target, fs = hadoop_path(spark, path)
    return fs.getContentSummary(target).getLength()


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a written table through the file system that holds it."""
    target, fs = hadoop_path(spark, path)
    fs.delete(target, True)


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet under the shared folder and read again: column
    pruning works on it and :func:`drop_table` removes it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove the files of a table that :func:`cut_lineage` wrote."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove_path(df.sparkSession, path)
