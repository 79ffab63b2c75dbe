"""Geometry: radius joins, track interpolation, voxel lookup, probe smoothing."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depthline.functions import kernels as K
from depthline.functions.columns import voxel_index
from depthline.operators.ordered import range_block, surrounding
from depthline.operators.relational import null_unless_good, shared_columns
from depthline.schemas import DENOISED_GROUPS, RAW_FEATURES_SCHEMA, feature_columns

RECORDING = ("pid", "snippet")


def channels_in_reach(
    centres: DataFrame,
    sites: DataFrame,
    radius_um: float,
    keys: Sequence[str] = RECORDING,
    carry: Sequence[str] = (),
    key_extra: Sequence[str] = (),
) -> DataFrame:
    """Sites within a radius (inclusive) of each centre, on the same probe.

    A depth bucket of one radius turns the range condition into an equi-join:
    a centre looks into its own bucket and the two next to it.
    """
    bucket = F.floor(F.col("axial_um") / F.lit(float(radius_um)))
    left = centres.select(*keys, "channel", *key_extra, F.col("lateral_um").alias("_x"), F.col("axial_um").alias("_y")).withColumn(
        "_bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("_y") / F.lit(float(radius_um))) + d))
    )
    right = sites.select(
        *keys,
        bucket.alias("_bucket"),
        F.col("channel").alias("neighbour"),
        F.col("lateral_um").alias("nb_lateral_um"),
        F.col("axial_um").alias("nb_axial_um"),
        *[F.col(c).alias(f"nb_{c}") for c in carry],
    )
    distance = F.hypot(F.col("nb_lateral_um") - F.col("_x"), F.col("nb_axial_um") - F.col("_y"))
    return (
        left.join(right, [*keys, "_bucket"])
        .withColumn("distance", distance)
        .filter(F.col("distance") <= radius_um)
        .drop("_bucket", "_x", "_y")
    )


def radius_neighbours(sites: DataFrame, radius_um: float = 200.0, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Per channel, the channels in reach (itself included) in ascending order."""
    pairs = channels_in_reach(sites, sites, radius_um, keys)
    return pairs.groupBy(*keys, "channel").agg(
        F.sort_array(F.collect_list(F.struct("neighbour", "nb_lateral_um", "nb_axial_um"))).alias("_n")
    ).select(
        *keys,
        "channel",
        F.transform("_n", lambda s: s.neighbour).alias("neighbours"),
        F.transform(
            "_n", lambda s: F.array(s.nb_lateral_um.cast("double"), s.nb_axial_um.cast("double"), F.lit(0.0))
        ).alias("coordinates"),
    )


def waveform_coordinates(
    events: DataFrame, sites: DataFrame, radius_um: float = 200.0, keys: Sequence[str] = RECORDING
) -> DataFrame:
    """Attach to each event the channels in reach of its channel and their (x, y, 0)."""
    return events.join(radius_neighbours(sites, radius_um, keys), [*keys, "channel"], "left")


def interpolate_track(
    points: DataFrame,
    knots: DataFrame,
    keys: Sequence[str],
    distance: str,
    values: Sequence[str],
    block_width: float,
) -> DataFrame:
    """Piecewise-linear values of a track at the points; clamped past its ends.

    Knots and points are merged and each point takes the knot before and after
    it, so nothing is multiplied out; keys are cut into blocks of
    `block_width` along the distance. Where knots coincide the last one counts.
    """
    extra = [c for c in points.columns if c not in keys and c != distance]
    knot = F.struct(F.col(distance).alias("d"), *[F.col(v).cast("double").alias(v) for v in values])
    marks = knots.filter(F.col(distance).isNotNull()).select(
        *keys, distance, F.lit(0).alias("_kind"), knot.alias("_knot"), *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in extra]
    )
    asked = points.select(
        *keys, distance, F.lit(1).alias("_kind"), F.lit(None).cast(marks.schema["_knot"].dataType).alias("_knot"), *extra
    )
    placed = surrounding(
        marks.unionByName(asked), keys, [distance, "_kind", "_knot"], range_block(distance, block_width), "_knot", "_k0", "_k1"
    ).filter("_kind = 1")
    share = F.try_divide(F.col(distance) - F.col("_k0.d"), F.col("_k1.d") - F.col("_k0.d"))
    lerp = [
        F.coalesce(
            F.col(f"_k0.{v}") + (F.col(f"_k1.{v}") - F.col(f"_k0.{v}")) * share, F.col(f"_k0.{v}"), F.col(f"_k1.{v}")
        ).alias(v)
        for v in values
    ]
    return placed.select(*keys, distance, *extra, *lerp)


def voxel_labels(
    points: DataFrame,
    volume: DataFrame,
    axes: Sequence[tuple[str, str, float, float, int]],
    label: str = "label",
) -> DataFrame:
    """Label of the clipped voxel each point falls in.

    axes: (point column, volume column, origin, spacing, size). One equi-join
    on the voxel; voxels absent from the volume give NULL.
    """
    placed = points.withColumns({v: voxel_index(p, origin, spacing, size) for p, v, origin, spacing, size in axes})
    on = [v for _, v, *_ in axes]
    return placed.join(volume.select(*on, label), on, "left")


def relabel_below_surface(
    volume: DataFrame,
    surface: DataFrame,
    column_keys: Sequence[str],
    depth: str,
    hull: str,
    label: str,
    void,
    new_label,
) -> DataFrame:
    """Void voxels at or past the hull of their column become `new_label`.

    The running mask along a column is a comparison with one depth per column,
    hence an equi-join and no window.
    """
    inside = F.coalesce(F.col(depth) >= F.col("_hull"), F.lit(False)) & (F.col(label) == F.lit(void))
    joined = volume.join(surface.select(*column_keys, F.col(hull).alias("_hull")), list(column_keys), "left")
    return joined.withColumn(label, F.when(inside, F.lit(new_label)).otherwise(F.col(label))).drop("_hull")


def surface_of(volume: DataFrame, column_keys: Sequence[str], depth: str | Column, marker: Column) -> DataFrame:
    """Least depth per column where `marker` holds."""
    d = F.col(depth) if isinstance(depth, str) else depth
    return volume.filter(marker).groupBy(*column_keys).agg(F.min(d).alias("hull"))


def fill_plane(df: DataFrame, features: Sequence[str], keys: Sequence[str] = RECORDING) -> DataFrame:
    """Every place of a probe's site grid (`axial_um`, `lateral_um`) with all features known.

    The grid has each depth with each lateral position that a site of the probe
    has. Channels not labelled 0, and NULL or NaN values, are gaps: between known
    sites they get the linear interpolation on the sites' triangulation,
    elsewhere the nearest site's value. A feature without a known value is NULL.
    A group is one probe, whose sites are bounded by the hardware.
    """
    names = list(features)
    columns = [*keys, "axial_um", "lateral_um"]
    masked = null_unless_good(df.withColumns({n: F.col(n).cast("double") for n in names}), names).select(*columns, *names)
    schema = T.StructType([*masked.select(*columns).schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        xs, col = np.unique(pdf["lateral_um"].to_numpy(float), return_inverse=True)
        ys, row = np.unique(pdf["axial_um"].to_numpy(float), return_inverse=True)
        out = {k: pdf[k].iloc[0] for k in keys}
        out |= {"axial_um": np.repeat(ys, xs.size), "lateral_um": np.tile(xs, ys.size)}
        seen: dict = {}
        for n in names:
            grid = np.full((ys.size, xs.size), np.nan)
            grid[row, col] = pdf[n].to_numpy(float)
            out[n] = K.fill_grid(grid, xs, ys, seen).ravel()
        return pd.DataFrame(out)

    return masked.groupBy(*keys).applyInPandas(fill, schema)


def denoise_features(
    df: DataFrame, features: Sequence[str] | None = None, fac: float = 1.0, keys: Sequence[str] = RECORDING
) -> DataFrame:
    """Total-variation smoothing of every feature over the site grid of each probe.

    Channels not labelled 0 are discarded and filled from the triangulation of
    the others. A
    group is one probe: its sites are bounded by the hardware. All features of
    the probe are handled in one call, so the table is shuffled once.
    """
    names = shared_columns(df, feature_columns(DENOISED_GROUPS)) if features is None else list(features)
    declared = {f.name: f for f in RAW_FEATURES_SCHEMA.fields}
    as_double = {n: F.col(n).cast(declared[n].metadata.get("denoise_as", "double") if n in declared else "double") for n in names}
    masked = null_unless_good(df.withColumns(as_double), names)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in masked.schema.fields])

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["lateral_um"].to_numpy(float), pdf["axial_um"].to_numpy(float)
        seen: dict = {}  # most features of a probe have their gaps at the same sites
        return pdf.assign(**{n: K.smooth_on_grid(pdf[n].to_numpy(float), x, y, fac, seen) for n in names})

    return masked.groupBy(*keys).applyInPandas(smooth, schema)
