"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on. AQE re-plans joins from runtime sizes
# (a shuffle measured below the broadcast threshold becomes a broadcast
# join) and splits skewed shuffle partitions.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Starting points for a large cluster (100 TB inputs): shuffle partitions
# start high and AQE coalesces them to ~256 MB; scans split at 256 MB; a
# partition 5x the median and above 256 MB counts as skewed and is split.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
}


def get_spark(master: str | None = None, app: str = "pulseframe",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the defaults above.

    On a cluster ``master`` is left to spark-submit; locally pass
    ``local[N]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if not master or not master.startswith("local"):
        conf.update(CLUSTER_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


# Bytes of a batch that goes to a Python worker. Spark's own limit is of rows, so
# that a batch of 10,000 texts takes their size several times over, in the JVM's
# buffers and in the worker, for every running task.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_MB = 4


def bound_batches(spark: SparkSession) -> None:
    """Limit batches by bytes, where the session sets no lower limit."""
    if int(spark.conf.get(BATCH_BYTES).rstrip("b")) > BATCH_MB << 20:
        spark.conf.set(BATCH_BYTES, str(BATCH_MB << 20))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names shared storage and is used as given.
    Only when it is unset (local tests) is a scratch folder created.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="pulseframe-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name)


def ship_package(spark: SparkSession) -> None:
    """Make ``pulseframe`` importable in Python workers on every executor.

    Operators that run Python inside tasks (``applyInPandas``,
    ``mapInPandas``) reference this package's functions. The package is
    zipped once per session into the shared checkpoint folder and added with
    ``addPyFile``, which ships it to every executor.
    """
    bound_batches(spark)
    if spark.conf.get("pulseframe.shipped", "false") == "true":
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    base = ensure_checkpoint_dir(spark)
    if "://" in base and not base.startswith("file:"):
        # Shared storage is not a local path: build the code archive on the
        # driver; addPyFile serves it to the executors (as --py-files does).
        target = tempfile.mkdtemp(prefix="pulseframe-pyfiles-")
    else:
        target = os.path.join(base.replace("file://", "").replace("file:", ""),
                              f"pyfiles-{os.getpid()}-{id(spark)}")
        os.makedirs(target, exist_ok=True)
    zpath = os.path.join(target, "pulseframe.zip")
    with zipfile.ZipFile(zpath, "w") as z:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    spark.sparkContext.addPyFile(zpath)
    spark.conf.set("pulseframe.shipped", "true")
