"""From traces to one feature row per channel, for all recordings in one job."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthline.functions.columns import affine, clipped, tilted_angles
from depthline.operators import signal as G
from depthline.operators.relational import first_by_preference, outer_merge
from depthline.operators.spatial import interpolate_track
from depthline.plans import recordings as whole
from depthline.schemas import FEATURE_SETS, checked_sets
from depthline.session import materialise
from depthline.sources import sinks
from depthline.sources.store import checked_windows, time_windows

RECORDING = ("pid", "snippet")


def unfit_recordings(ap: DataFrame, lf: DataFrame, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Snippets whose bands differ in channels, lack a layout, or have no rate."""

    def shape(df: DataFrame, band: str) -> DataFrame:
        placed = F.col("lateral_um").isNotNull() & F.col("axial_um").isNotNull()
        return df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias(f"n_{band}"), F.count_if(placed).alias(f"placed_{band}"), F.min("fs").alias(f"fs_{band}")
        )

    both = shape(ap, "ap").join(shape(lf, "lf"), list(keys), "full")
    fit = (
        (F.col("n_ap") == F.col("n_lf"))
        & (F.col("n_ap") == F.col("placed_ap"))
        & (F.col("n_lf") == F.col("placed_lf"))
        & (F.col("fs_ap") > 0)
        & (F.col("fs_lf") > 0)
    )
    return both.filter(~F.coalesce(fit, F.lit(False)))


def with_quality_labels(df: DataFrame, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Add computed labels where the frame has none.

    One small row per channel comes out of a pass over all traces, so the
    labels are written once for both bands to use.
    """
    if "labels" in df.columns:
        return df
    labels = materialise(G.quality_labels(df, keys=keys).select(*keys, "channel", "labels"), "labels")
    return df.join(labels, [*keys, "channel"])


def feature_sets(
    ap: DataFrame,
    lf: DataFrame,
    requested: Sequence[str] | None = None,
    fs_ap: float = 30_000.0,
    bands: Mapping[str, tuple[float, float]] | None = None,
    q: int = 10,
    before: int = 42,
    detection: Mapping | None = None,
    destriped: bool = False,
    write_once: bool = False,
    keys: Sequence[str] = RECORDING,
    waveform_sink: Callable[[DataFrame, DataFrame], None] | None = None,
) -> dict[str, DataFrame]:
    """Name -> features of each requested set: `lf`, `csd`, `ap`, `waveforms`.

    Traces are destriped first unless they are already. Two sets read each
    band; `write_once` stores the destriped traces in the shared folder rather
    than computing them for each.
    """
    sets = checked_sets(requested)
    needs_ap, needs_lf = {"ap", "waveforms"} & set(sets), {"lf", "csd"} & set(sets)
    if not destriped:
        labelled = with_quality_labels(ap, keys)
        labels = labelled.select(*keys, "channel", "labels")
        ap = G.destripe(labelled, keys=keys) if needs_ap else ap
        if needs_lf:
            lf = G.destripe(lf.drop("labels").join(labels, [*keys, "channel"]), keys=keys)
        if write_once:
            ap = materialise(ap, "ap") if len(needs_ap) > 1 else ap
            lf = materialise(lf, "lf") if len(needs_lf) > 1 else lf
    makers = {
        "lf": lambda: G.lf_features(lf, bands, keys=keys),
        "csd": lambda: G.csd_features(lf, bands, q, keys=keys),
        "ap": lambda: G.ap_features(ap, keys),
        "waveforms": lambda: G.waveform_features(ap, fs_ap, before, keys, waveform_sink, **(detection or {})),
    }
    return {name: makers[name]() for name in sets}


def compute_features(
    ap: DataFrame,
    lf: DataFrame,
    requested: Sequence[str] | None = None,
    store: str | None = None,
    keys: Sequence[str] = RECORDING,
    save_waveforms: bool = False,
    **options,
) -> DataFrame:
    """All sets, merged on the channel.

    With a `store`, computed sets are written there, in place of stored rows of
    the same `keys`, and sets that were not requested are taken from it for
    these keys where they exist. All sets are computed in one
    job, in which those of a band share its shuffles, and then stored. With
    `save_waveforms` the waveforms of the events go there too.
    """
    if save_waveforms:
        if store is None:
            raise ValueError("waveforms are saved to a store")
        options["waveform_sink"] = lambda waveforms, events: sinks.write_waveforms(waveforms, events, store)
    return merged_sets(feature_sets(ap, lf, requested, keys=keys, **options), store, keys)


def merged_sets(found: Mapping[str, DataFrame], store: str | None = None, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Computed sets merged on the channel, and stored where there is a `store`; see `compute_features`."""
    on = [*keys, "channel"]
    if store is None:
        return outer_merge(list(found.values()), on)
    spark = next(iter(found.values())).sparkSession
    marked = [df.withColumn(f"_has_{name}", F.lit(True)) for name, df in found.items()]
    merged = materialise(outer_merge(marked, on), "features")
    for name, df in found.items():
        sinks.write_features(merged.filter(f"_has_{name}").select(df.columns), store, name, mode="overwrite")
    wanted = merged.select(*keys).distinct()
    earlier = [
        df.join(wanted, list(keys), "left_semi")
        for name in FEATURE_SETS
        if name not in found and (df := sinks.read_features(spark, store, name, merged)) is not None
    ]
    return outer_merge([merged.drop(*[f"_has_{name}" for name in found]), *earlier], on)


def compute_windows(
    ap_chunks: DataFrame,
    lf_chunks: DataFrame,
    recordings: DataFrame,
    channels: DataFrame,
    t_start: float = 0.0,
    duration: float | None = None,
    chunk_samples: Mapping[str, int] | None = None,
    lf_latency: int = 3,
    frame_samples: Mapping[str, int] | None = None,
    store: str | None = None,
    requested: Sequence[str] | None = None,
    **options,
) -> DataFrame:
    """Features of one time window of every recording, in one job.

    Without a duration each recording is used to its end, as far as both bands
    reach, in frames of `frame_samples` (see `plans.recordings`). Raises when a
    recording cannot serve the window. The low band starts `lf_latency` samples
    later than the high band.
    """
    sizes = chunk_samples or {"ap": 30_000, "lf": 2_500}
    windows = (
        recordings.select("pid").distinct().withColumn("duration", F.lit(float(duration)))
        if duration is not None
        else usable_durations(recordings, t_start)
    ).withColumns({"t_start": F.lit(float(t_start)), "snippet": F.lit(window_number(t_start, duration)).cast("bigint")})
    checked_windows(windows.select("pid", "t_start", "duration"), recordings)
    layout = channels.select("pid", "channel", *[c for c in ("lateral_um", "axial_um", "labels") if c in channels.columns])

    def window(chunks: DataFrame, band: str, latency: int) -> DataFrame:
        return time_windows(chunks, windows, sizes[band], latency).join(layout, ["pid", "channel"])

    if duration is None:
        lengths = frame_samples or {"ap": 90_000, "lf": 7_500}
        q, before = options.get("q", 10), options.get("before", 42)
        if lengths["lf"] % q:
            raise ValueError(f"frames of the low band must be a multiple of {q} samples")
        halo_ap, halo_lf = whole.halo_of(q, before, **(options.get("detection") or {}))
        # The low band ends `lf_latency` samples earlier than the usable duration.
        low = windows.join(lf_chunks.select("pid", "fs").distinct(), "pid")
        low = low.withColumn("duration", F.col("duration") - F.lit(lf_latency) / F.col("fs"))
        ap = whole.frames(ap_chunks, windows, lengths["ap"], halo_ap).join(layout, ["pid", "channel"])
        lf = whole.frames(lf_chunks, low, lengths["lf"], halo_lf, lf_latency).join(layout, ["pid", "channel"])
        if options.pop("save_waveforms", False):
            raise ValueError("waveforms are saved for windows with a duration")
        options.pop("write_once", None)
        numbered = windows.select("pid", "snippet")
        sets = whole.whole_sets(ap, lf, requested, **options)
        return merged_sets({name: numbered.join(df, "pid") for name, df in sets.items()}, store)
    return compute_features(
        window(ap_chunks, "ap", 0), window(lf_chunks, "lf", lf_latency), requested=requested, store=store, **options
    )


#: Stands for the duration of a window that goes to the end of its recording.
_TO_THE_END = 2**31 - 1


def window_number(t_start: float, duration: float | None) -> int:
    """The snippet number of a time window: its start and duration in milliseconds side by side.

    Equal windows have equal numbers, so that stored sets of one window meet, and others have others.
    """
    start = round(t_start * 1000)
    length = _TO_THE_END if duration is None else round(duration * 1000)
    if not 0 <= start < 2**31 or not 0 <= length <= _TO_THE_END - (duration is not None):
        raise ValueError("start and duration must lie between 0 and 24 days")
    return start << 31 | length


def usable_durations(recordings: DataFrame, t_start: float) -> DataFrame:
    """`(pid, duration)` both bands can serve from `t_start`."""
    return recordings.groupBy("pid").agg((F.min(F.col("ns") / F.col("fs")) - F.lit(float(t_start))).alias("duration"))


# ---------------------------------------------------------------- target coordinates


def chosen_trajectories(trajectories: DataFrame, preferred: str = "Micro-manipulator") -> DataFrame:
    """Per probe the trajectory of the preferred provenance, else the first."""
    columns = ["provenance", "x", "y", "z", "depth", "theta", "phi"]
    return first_by_preference(trajectories, ["pid"], F.col("provenance") == preferred, ["pos"], columns)


def track_knots(
    trajectories: DataFrame,
    tilt_deg: float = -5.0,
    frame: Mapping[str, tuple[float, float, float, float]] | None = None,
) -> DataFrame:
    """Two knots per probe, from the tip (distance 0) up to the entry (`depth`).

    The direction is tilted first. `frame` gives, per axis, the scale, offset
    and limits that take a position to the target frame.
    """
    theta, phi = tilted_angles("theta", "phi", tilt_deg)
    t, p, d = F.radians("_theta"), F.radians("_phi"), F.col("depth")
    tip = {
        "x": F.col("x") - d * F.sin(t) * F.cos(p),
        "y": F.col("y") - d * F.sin(t) * F.sin(p),
        "z": F.col("z") - d * F.cos(t),
    }

    def framed(axis: str, value: Column) -> Column:
        if not frame or axis not in frame:
            return value.cast("double")
        scale, offset, low, high = frame[axis]
        return clipped(affine(value, scale, offset), low, high)

    def knot(distance: Column, at: Mapping[str, Column]) -> Column:
        return F.struct(distance.cast("double").alias("axial_um"), *[framed(a, at[a]).alias(f"{a}_target") for a in "xyz"])

    turned = trajectories.withColumns({"_theta": theta, "_phi": phi})
    return turned.select("pid", F.inline(F.array(knot(F.lit(0.0), tip), knot(d, {a: F.col(a) for a in "xyz"}))))


def add_target_coordinates(
    channels: DataFrame,
    trajectories: DataFrame,
    preferred: str = "Micro-manipulator",
    tilt_deg: float = -5.0,
    frame: Mapping | None = None,
    block_um: float = 10_000.0,
) -> DataFrame:
    """Add x/y/z_target to channels by interpolating along the probe's track."""
    needed = {"channels": ("pid", "axial_um"), "trajectories": ("pid", "provenance", "pos", "x", "y", "z", "depth", "theta", "phi")}
    for name, df in (("channels", channels), ("trajectories", trajectories)):
        absent = [c for c in needed[name] if c not in df.columns]
        if absent:
            raise ValueError(f"{name} lacks {absent}")
    knots = track_knots(chosen_trajectories(trajectories, preferred), tilt_deg, frame)
    return interpolate_track(
        channels.withColumn("axial_um", F.col("axial_um").cast("double")),
        knots,
        ["pid"],
        "axial_um",
        ["x_target", "y_target", "z_target"],
        block_um,
    )


def default_channels(depths: DataFrame, n_channels: int = 384) -> DataFrame:
    """Number the sites of probes that come without channel ids, by position."""
    counts = depths.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != n_channels)
    wrong = counts.limit(5).collect()
    if wrong:
        raise ValueError(f"channel ids are needed unless a probe has {n_channels} sites: {[r['pid'] for r in wrong]}")
    packed = depths.groupBy("pid").agg(F.sort_array(F.collect_list("axial_um")).alias("_d"))
    return packed.select("pid", F.posexplode("_d").alias("channel", "axial_um"))


