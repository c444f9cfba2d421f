"""Session helpers: one place for the settings the operators assume."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_SCRATCH: list[str] = []  # scratch paths of this application
_TABLES: list[str] = []   # catalog names of scratch tables

# Settings every caseflow job relies on.  Timestamps are naive UTC
# (TIMESTAMP_NTZ), so the session zone must not shift them when a
# TIMESTAMP_LTZ sneaks in from a source.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # delete checkpoint files once their DataFrames are garbage-collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, app: str = "caseflow",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the caseflow defaults.

    On a cluster pass ``master=None`` and let spark-submit decide.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session.  Only where it is unset
    and the master is this machine (tests) do we create a folder of our own;
    on a cluster a machine-local folder would lose data, so that raises.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all "
                             "executors share")
        conf_dir = tempfile.mkdtemp(prefix="caseflow-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder.  It is deleted
    when the application ends or by :func:`release_scratch`."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/caseflow-{name}-{uuid.uuid4().hex[:12]}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    _SCRATCH.append(path)
    return path


def scratch_table(spark: SparkSession, name: str) -> tuple[str, str]:
    """A fresh table name and a scratch path for its files."""
    path = scratch_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    _TABLES.append(table)
    return table, path


def release_scratch(spark: SparkSession) -> int:
    """Delete the scratch paths handed out so far (and forget the tables over
    them); the number of them.  Call it once the results that read them are
    written."""
    n = 0
    while _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS `{_TABLES.pop()}`")
    while _SCRATCH:
        target = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        n += bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True))
    return n


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


__all__ = ["get_session", "ensure_checkpoint_dir", "scratch_path", "scratch_table", "release_scratch",
           "shuffle_partitions", "DEFAULT_CONF"]
