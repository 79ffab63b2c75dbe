"""The two jobs a user runs: features of recordings, and regions of features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depthline.operators import learn as L
from depthline.operators import relational as R
from depthline.plans import features as J
from depthline.sources import sinks, store

MODES = ("features", "inference", "both")


def recording_features(
    traces: DataFrame,
    channels: DataFrame,
    root: str,
    t_start: float = 0.0,
    duration: float | None = None,
    trajectories: DataFrame | None = None,
    requested: Sequence[str] | None = None,
    chunk_samples: dict[str, int] | None = None,
    **options,
) -> DataFrame:
    """Compute, store and return the features of all recordings in `traces`.

    traces: `schemas.TRACE_SCHEMA` rows with bands `ap` and `lf`. Channel rows,
    with target coordinates where there are trajectories, are stored once.
    """
    ap, lf = (traces.filter(F.col("band") == band) for band in ("ap", "lf"))
    out = J.compute_windows(
        ap, lf, store.recordings_of(traces), channels, t_start, duration, chunk_samples, requested=requested, store=root, **options
    )
    if trajectories is not None:
        channels = J.add_target_coordinates(channels, trajectories)
    sinks.write_if_absent(channels, f"{root}/channels.parquet")
    return out


def region_probabilities(
    features: DataFrame, channels: DataFrame, model_root: str, path: str | None = None, n_folds: int = 5, denoise: bool = True
) -> DataFrame:
    """`(fold, pid, snippet, channel, class_index, class_id, proba, predicted_index)` by every fold's model.

    `snippet` is there if the features have it.

    Smoothing needs position and quality of the channels, so they are joined
    first; channels without a label count as good.
    """
    spark = features.sparkSession
    models, metas = sinks.load_folds(spark, model_root, n_folds)
    extra = [c for c in channels.columns if c not in features.columns]
    rows = features.join(channels.select("pid", "channel", *extra), ["pid", "channel"])
    rows = rows.na.fill(0, ["labels"]) if "labels" in rows.columns else rows.withColumn("labels", F.lit(0))
    scored = L.infer_regions(rows, models, metas, denoise=denoise)
    long = L.long_probabilities(scored, [c for c in scored.columns if c != "probas"], metas[0]["CLASSES"])
    if path is None:
        return long
    sinks.write_predictions(long, path)
    return spark.read.parquet(path)


def probability_profile(probabilities: DataFrame, channels: DataFrame, classes: Sequence) -> dict[str, DataFrame]:
    """What a depth plot shows: cumulative shares, entropies per fold and their mean."""
    keys = [k for k in ("fold", "pid", "snippet", "channel") if k in probabilities.columns]
    depth = channels.select("pid", "channel", "axial_um")
    entropy = R.mean_entropy(probabilities, keys, "proba", len(classes)).join(depth, ["pid", "channel"])
    shares = R.cumulative_share(probabilities, keys, "class_id", "proba", classes, "cumulative")
    return {
        "cumulative": shares.join(depth, ["pid", "channel"]),
        "entropy": entropy,
        "mean_entropy": R.depth_aggregate(entropy, [*keys[1:], "axial_um"], ["entropy"]),
    }


def run(
    spark: SparkSession,
    mode: str,
    root: str,
    traces: DataFrame | None = None,
    channels: DataFrame | None = None,
    model_root: str | None = None,
    **options,
) -> DataFrame:
    """Features, regions, or one after the other; results are stored under `root`."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    features = None
    if mode != "inference":
        if traces is None or channels is None:
            raise ValueError("features need traces and channels")
        features = recording_features(traces, channels, root, **options)
        features.write.mode("overwrite").parquet(f"{root}/features.parquet")
    if mode == "features":
        return features
    if model_root is None:
        raise ValueError("inference needs a model")
    if not store.path_exists(spark, f"{root}/features.parquet"):
        raise ValueError(f"no features under {root}; compute them first")
    features = spark.read.parquet(f"{root}/features.parquet")
    channels = channels if channels is not None else spark.read.parquet(f"{root}/channels.parquet")
    return region_probabilities(features, channels, model_root, f"{root}/predictions.parquet")
