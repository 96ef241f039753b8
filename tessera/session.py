"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every tessera job relies on.  UTC keeps month/week keys stable;
# AQE re-plans joins and coalesces small shuffle partitions at run time and
# splits skewed join partitions.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Remove reliable checkpoint files once their DataFrame is garbage-collected.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "tessera", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with tessera's settings.

    On a cluster leave ``master`` unset and size ``shuffle_partitions`` to
    the data (about 128-256 MB of shuffle per partition); AQE coalesces
    what turns out smaller.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    for k in ("spark.sql.session.timeZone",):
        spark.conf.set(k, conf[k])
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    Read from ``spark.checkpoint.dir`` (what the cluster names).  Only when
    it is unset in local mode -- local runs and tests -- a fresh local folder
    is created; on a cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/object store): "
                               "executors must be able to read checkpoints and staged tables")
        configured = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def stage_path(spark: SparkSession, name: str) -> str:
    """A new location under the checkpoint folder; no call returns an earlier one."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def write_stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> str:
    """Write ``df`` as parquet to a new staging path and return the path."""
    path = stage_path(df.sparkSession, name)
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def stage_table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as parquet under the checkpoint folder and read it back.

    Used to cut lineage (model inputs, stream sources); the written table
    survives executor loss.  Every call writes a path of its own, so a staged
    table is never stale and never rewritten under a reader; hold the returned
    frame to use it again.  The job's owner empties the checkpoint folder.
    """
    return df.sparkSession.read.parquet(write_stage(df, name, partition_by))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists in its file system.  Errors of the file system
    are raised, so that an unreadable path is never taken for an absent one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
