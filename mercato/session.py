"""Spark session defaults and the shared checkpoint folder.

On a cluster the session is created by the platform and already names a
shared ``spark.checkpoint.dir``; we only read it.  A private folder is made
only when the setting is absent (local runs and tests).
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job in this library relies on: UTC wall clock (the test
# tables are TIMESTAMP_NTZ and the oracle is tz-naive), adaptive execution for
# runtime broadcast / partition coalescing / skew splitting, no web UI.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # AQE sizes reducers from measured map output: aim for ~256 MB each and
    # split any partition 5x (and > 512 MB) above the median as skewed
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # checkpoint files of intermediates are removed once nothing refers to them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app_name: str = "mercato",
                  shuffle_partitions: int | None = None,
                  extra_conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    try:
        spark.sparkContext.setLogLevel("ERROR")
    except Exception:  # Spark Connect
        pass
    checkpoint_dir(spark)
    return spark


def _private_dir(master: str) -> str:
    """A folder of this machine, for sessions whose only machine this is."""
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all "
                           "executors share")
    return tempfile.mkdtemp(prefix="mercato-ckpt-")


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder that the session names.  Only a
    local session without one gets a private folder; on a cluster a missing
    setting is an error, since a machine's own disk is not shared."""
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server owns the checkpoint folder
        path = spark.conf.get("spark.checkpoint.dir", None)
        return path or _private_dir(spark.conf.get("spark.master", "connect"))
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        path = _private_dir(sc.master)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def apply_runtime_conf(spark: SparkSession) -> None:
    """Set this library's SQL defaults on a running session, leaving alone
    whatever its creator has set."""
    try:
        own = {k for k, _ in spark.sparkContext.getConf().getAll()}
    except Exception:  # Spark Connect
        own = set()
    for k, v in DEFAULT_CONF.items():
        if k.startswith("spark.sql.") and k not in own:
            try:
                spark.conf.set(k, v)
            except Exception:  # static setting: keep the session's value
                pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder (for streaming
    checkpoints, registry tables and other job state that must survive the
    loss of an executor)."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def materialize(df):
    """Write ``df`` once to the shared checkpoint folder and continue from the
    written copy: cuts the lineage of an intermediate that several later
    steps read, so it is neither re-planned nor recomputed per reader, and a
    lost executor does not replay its whole history.  (Reliable checkpoint,
    never a local one.)"""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df):
    """``df`` written as a Parquet table in the shared checkpoint folder and
    read again.  Unlike a checkpoint, whose rows are stored whole and not
    compressed, readers take only the columns they need, Spark knows how small
    a small table is, and the copy carries no constraints of the plan that
    made it, which over many rounds cost the driver more time and memory than
    the rounds themselves.  The tables stay until the folder is cleared."""
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once, for Python functions that
    run there (as ``--py-files`` would)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="mercato-package-")      # the driver serves it from here
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "mercato"), "zip",
                                     os.path.dirname(here), os.path.basename(here)))
    _SHIPPED.add(sc.applicationId)


_SHIPPED: set[str] = set()
