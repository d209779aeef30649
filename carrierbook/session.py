"""Spark session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on.  Time zone is pinned so that date ranges and
# receipt dates do not depend on the machine; AQE re-plans joins and coalesces
# shuffle partitions at run time and splits skewed join partitions.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Also where an aggregate on the join's key follows and the split adds a shuffle (case replay).
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# What every query sets in the session that it is given.  Spark takes these sizes of the compressed bytes of a shuffle or a
# file, and the ledger's rows are several times as large in memory: tables under 10 MB were broadcasts of 74 MB in live_cases
# and 141 MB in delete_effects, and 39 MB read by a task of live_cases went with 1,174 MB of its memory (6 x sf0.1).
QUERY_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "1m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "1m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64m",
}


def set_query_conf(spark: SparkSession) -> None:
    for name, value in QUERY_CONF.items():
        spark.conf.set(name, value)


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "carrierbook", extra: dict | None = None,
                  input_bytes: int | None = None) -> SparkSession:
    """Create (or reuse) a session with the library's base settings.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the
    cluster manager supplies the master.  AQE merges shuffle partitions up to
    the advisory size but never adds any, so state the size of the input in
    ``input_bytes``: shuffles then begin with one partition per 128 MB.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if not (master or "").startswith("local"):
        # On a cluster, coalesce shuffle partitions to the advisory size (not
        # to the default parallelism), so partition counts follow data volume.
        conf["spark.sql.adaptive.coalescePartitions.parallelismFirst"] = "false"
        conf["spark.sql.adaptive.advisoryPartitionSizeInBytes"] = "128m"
        if input_bytes:
            conf["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(max(200, input_bytes >> 27))
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, making sure the context uses it.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that is read
    from the session.  Only a local-mode session (tests) may fall back to a
    fresh folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="carrierbook-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def reliable_checkpoint(df):
    """Cut lineage with a reliable (shared-folder) checkpoint; never a local one."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "tables", name)


def worker_imports(spark: SparkSession) -> None:
    """Let Python workers import this package.

    A cluster gets it as every job's code, by ``--py-files``.  Workers of a local master run on this
    machine and only need its path.
    """
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if context.master.startswith("local") and root not in context.environment.get("PYTHONPATH", "").split(os.pathsep):
        context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, context.environment.get("PYTHONPATH")]))


def _file_system(spark: SparkSession, place: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def path_exists(spark: SparkSession, place: str) -> bool:
    """Whether a file or folder exists, on any store Spark can open; a failing store raises."""
    store, path = _file_system(spark, place)
    return store.exists(path)


def sub_folders(spark: SparkSession, place: str) -> list[str]:
    """The names of the folders in a folder; none where it does not exist."""
    store, path = _file_system(spark, place)
    if not store.exists(path):
        return []
    return [s.getPath().getName() for s in store.listStatus(path) if s.isDirectory()]
