"""Modelling tables built from the feature store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthline.functions.columns import amplitude_db, log_count, nulled_infinities, ratio
from depthline.operators import relational as R
from depthline.schemas import CLUSTER_MEANS

MAPPINGS = ("Cosmos", "Beryl", "Allen")

# Measures of the depth table; those of clusters are in `schemas`.
CLUSTER_FIRSTS = ["acronym", "atlas_id"]
RAW_MEANS = [
    "alpha_mean",
    "alpha_std",
    "spike_count",
    "cloud_x_std",
    "cloud_y_std",
    "cloud_z_std",
    "peak_trace_idx",
    "peak_time_idx",
    "peak_val",
    "trough_time_idx",
    "trough_val",
    "tip_time_idx",
    "tip_val",
    "rms_ap",
    "rms_lf",
    "psd_delta",
    "psd_theta",
    "psd_alpha",
    "psd_beta",
    "psd_gamma",
    "x",
    "y",
    "z",
]
RAW_FIRSTS = ["acronym", "atlas_id", "histology"]


def prepare_voltage(df: DataFrame, mapping: str, region_map: DataFrame, regions: DataFrame) -> DataFrame:
    """Infinities become NULL; the requested hierarchy level is added."""
    if mapping not in MAPPINGS:
        raise ValueError(f"mapping must be one of {MAPPINGS}")
    df = nulled_infinities(df)
    return df if mapping == "Allen" else R.remap_regions(df, region_map, regions, mapping, "Allen_id", mapping)


def voltage_table(
    voltage: DataFrame,
    channels: DataFrame,
    region_map: DataFrame,
    regions: DataFrame,
    mapping: str = "Cosmos",
    complete_only: bool = True,
) -> DataFrame:
    """Features joined to channels, remapped, and free of incomplete rows."""
    if mapping not in MAPPINGS:
        raise ValueError(f"mapping must be one of {MAPPINGS}")
    joined = R.join_channels(voltage, channels).withColumnsRenamed(
        {"atlas_id": "Allen_id", "acronym": "Allen_acronym"}
    )
    out = prepare_voltage(joined, mapping, region_map, regions).withColumn("pids", F.col("pid"))
    return R.drop_incomplete(out) if complete_only else out


def modelling_table(
    voltage: DataFrame,
    channels: DataFrame,
    region_map: DataFrame,
    regions: DataFrame,
    excluded: Sequence[str] = ("void", "root"),
) -> DataFrame:
    """Complete rows with coarse region ids, decibels, log counts and ratios."""
    df = R.drop_incomplete(R.join_channels(voltage, channels))
    for mapping in ("Cosmos", "Beryl"):
        prefix = mapping.lower()
        df = R.remap_regions(df, region_map, regions, mapping, "atlas_id", prefix).drop(f"{prefix}_acronym")
    df = R.exclude_regions(df, "cosmos_id", regions, excluded)
    peak_to_trough = ratio("peak_val", "trough_val")
    return df.withColumns(
        {
            "rms_ap": amplitude_db("rms_ap"),
            "rms_lf": amplitude_db("rms_lf"),
            "spike_count_log": log_count("spike_count"),
            "peak_to_trough_ratio": peak_to_trough,
            "peak_to_trough_ratio_log": F.ln(peak_to_trough),
            "peak_to_trough_duration": F.col("trough_time_secs") - F.col("peak_time_secs"),
        }
    )


def depth_table(raw: DataFrame, clusters: DataFrame, channels: DataFrame) -> DataFrame:
    """Raw and cluster measures per `(pid, axial_um)` where both exist.

    Names both sides share get the suffixes `_raw` and `_cluster`.
    """
    shared = [c for c in RAW_MEANS + RAW_FIRSTS if c in CLUSTER_MEANS + CLUSTER_FIRSTS]
    return join_depths(
        R.join_channels(raw, channels),
        clusters,
        keys=["pid", "axial_um"],
        raw_means={c: f"{c}_raw" if c in shared else c for c in RAW_MEANS},
        raw_firsts={c: f"{c}_raw" if c in shared else c for c in RAW_FIRSTS},
        raw_order=["channel"],
        cluster_means={c: f"{c}_cluster" if c in shared else c for c in CLUSTER_MEANS},
        cluster_firsts={c: f"{c}_cluster" if c in shared else c for c in CLUSTER_FIRSTS},
        cluster_order=["cluster_id"],
    )


def join_depths(
    raw: DataFrame,
    clusters: DataFrame,
    keys: Sequence[str],
    raw_means,
    raw_firsts,
    raw_order,
    cluster_means,
    cluster_firsts,
    cluster_order,
) -> DataFrame:
    """Aggregate both sides to the keys first, then join the small results.

    Both aggregates leave their output partitioned on the keys, so the join
    adds no shuffle of its own.
    """
    by_channel = R.depth_aggregate(raw, keys, raw_means, raw_firsts, raw_order)
    by_cluster = R.depth_aggregate(clusters, keys, cluster_means, cluster_firsts, cluster_order)
    return by_channel.join(by_cluster, list(keys))


def predictions_by_depth(
    channels: DataFrame, predictions: DataFrame, keys: Sequence[str] = ("pid",), klass: str = "class_index", proba: str = "proba"
) -> DataFrame:
    """Mean probability of each class at each depth of a probe, the observations of a decoder.

    Long predictions, with a row for each class of a channel, get their depth from
    the channel table. Channels without a prediction, and predictions of unknown
    channels, are left out.
    """
    placed = channels.select(*keys, "channel", "axial_um").join(predictions, [*keys, "channel"])
    return R.depth_aggregate(placed, [*keys, "axial_um", klass], [proba])


def depth_profile(
    df: DataFrame, features: Sequence[str], keys: Sequence[str] = ("pid",), depth: str = "axial_um"
) -> DataFrame:
    """Depth means of each feature and their z-scores within the probe."""
    means = R.depth_aggregate(df, [*keys, depth], features)
    return R.zscored(means, list(keys), list(features))


def features_for_display(meta_features: Sequence[str], hidden: int = 4) -> list[str]:
    """The model's features without the trailing position columns."""
    return list(meta_features)[: len(meta_features) - hidden]


def depth_extent(df: DataFrame, keys: Sequence[str] = ("pid",), depth: str = "axial_um") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(depth).alias("depth_min"), F.max(depth).alias("depth_max"))
