"""Snippet features on live traces, and the job that only computes new snippets."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from depthline.operators.relational import missing_keys
from depthline.sources.store import path_exists


def snippet_rms(
    samples: DataFrame, time: str, keys: Sequence[str], value: str, duration: str, watermark: str | None = None
) -> DataFrame:
    """RMS and count per key and tumbling window; the same plan serves batch and stream.

    With a watermark a stream emits each window once, when it is closed, and
    its state does not outgrow the delay.
    """
    timed = samples.withColumn(time, F.col(time).cast("timestamp"))
    if watermark:
        timed = timed.withWatermark(time, watermark)
    v = F.col(value).cast("double")
    return (
        timed.groupBy(F.window(time, duration).alias("_w"), *keys)
        .agg(F.sqrt(F.avg(v * v)).alias("rms"), F.count(F.lit(1)).alias("n"))
        .select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys, "rms", "n")
    )


def write_closed_windows(features: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows to a table; each is written exactly once."""
    return (
        features.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def compute_new_snippets(
    requests: DataFrame, path: str, checkpoint: str, compute: Callable[[DataFrame], DataFrame], keys: Sequence[str]
) -> StreamingQuery:
    """For each batch of requested keys, compute and append those not stored yet.

    A batch writes to a folder of its own, named after the checkpoint and the
    batch number, and replaces it when it is retried. It does not count its own
    earlier attempt as stored, so a retry leaves each snippet exactly once.
    """
    run_name = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        wanted = batch.select(*keys).distinct()
        if path_exists(spark, path):
            own = (F.col("run") == run_name) & (F.col("batch") >= batch_id)
            wanted = missing_keys(wanted, spark.read.parquet(path).filter(~own), keys)
        compute(wanted).write.mode("overwrite").parquet(f"{path}/run={run_name}/batch={batch_id}")

    return (
        requests.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
