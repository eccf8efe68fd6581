"""Stream scoring with versioned, periodically refitted detectors.

Each micro-batch (in ``foreachBatch``):
1. is stored in the history table (its own ``_batch=<id>`` folder, so a
   re-run replaces it);
2. is scored with the newest saved detector version (``<model_dir>/v=<n>``)
   and written to the output table, again one folder per batch;
3. advances a durable row counter (a folder for each batch); when the count passes another multiple
   of ``every_rows``, a new detector is fitted on the history table and
   saved as the next version. Later batches read that version.

Scoring never refits from the rows of one batch; every batch reads exactly
one version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulseframe.plans.bundle import _exists, is_complete
from pulseframe.streaming.activity_stream import count_before, write_count


def _versions(spark: SparkSession, model_dir: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(model_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    out = []
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if name.startswith("v=") and name[2:].isdigit() and is_complete(spark, st.getPath().toString()):
            out.append(int(name[2:]))
    return sorted(out)


def latest_version(spark: SparkSession, model_dir: str) -> int | None:
    v = _versions(spark, model_dir)
    return v[-1] if v else None


def batch_state(spark: SparkSession, counter: str, batch_id: int, newest: int) -> tuple[int, int]:
    """(version to score the batch with, rows of the batches before it)."""
    path = f"{counter}_version/_batch={batch_id}"
    if not _exists(spark, path + "/_SUCCESS"):
        spark.createDataFrame([(newest,)], "v long").coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).first()["v"], count_before(spark, counter, batch_id)


def score_and_refit(stream: DataFrame, model_dir: str, history: str, out: str, checkpoint: str,
                    every_rows: int, make_detector: Callable[[], object],
                    trigger: dict | None = None) -> StreamingQuery:
    """Start the query. ``model_dir`` must already hold a fitted version
    (``AnomalyDetector.save(spark, f"{model_dir}/v=0")``)."""
    from pulseframe.plans.detector import AnomalyDetector

    spark = stream.sparkSession
    counter = checkpoint.rstrip("/") + "_rowcount"
    if latest_version(spark, model_dir) is None:
        raise FileNotFoundError(f"no fitted version under {model_dir}")

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{history.rstrip('/')}/_batch={batch_id}")
        # The version a batch was first scored with is kept, so a replay
        # scores it with the same one.
        v, before = batch_state(spark, counter, batch_id, latest_version(spark, model_dir))
        det = AnomalyDetector.load(spark, f"{model_dir}/v={v}")
        det.transform(batch).write.mode("overwrite").parquet(f"{out.rstrip('/')}/_batch={batch_id}")
        total = before + spark.read.parquet(f"{history.rstrip('/')}/_batch={batch_id}").count()
        if total // every_rows > before // every_rows:
            # A replay fits on the batches up to its own, as the first run did.
            seen = spark.read.parquet(history).where(F.col("_batch") <= batch_id).drop("_batch")
            new = make_detector().fit(seen)
            new.save(spark, f"{model_dir}/v={v + 1}", overwrite=True)
        write_count(spark, counter, batch_id, total)

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"processingTime": "10 seconds"})).start()
