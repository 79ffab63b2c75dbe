"""Per-channel signal features.

Input frames hold one row per `(pid, snippet, channel)` with the samples of
that window as an array. A snippet is a time window of one probe, so a group
`(pid, snippet)` holds at most the channels of a probe times the window, while
a probe with very many recordings spreads over its snippets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depthline.functions import arrays as A
from depthline.functions import kernels as K
from depthline.functions.columns import known, power_db
from depthline.operators.relational import channel_event_features
from depthline.operators.spatial import channels_in_reach
from depthline.schemas import BANDS
from depthline.session import materialise

RECORDING = ("pid", "snippet")


def rms_by_channel(df: DataFrame, name: str = "rms", keys: Sequence[str] = RECORDING) -> DataFrame:
    return df.select(*keys, "channel", A.rms("samples").alias(name))


def rms_over_chunks(chunks: DataFrame, keys: Sequence[str], name: str = "rms") -> DataFrame:
    """RMS of a channel whose samples lie in several chunks: sums and counts are merged."""
    parts = chunks.select(*keys, A.sum_of_squares("samples").alias("_ss"), F.size("samples").alias("_n"))
    return parts.groupBy(*keys).agg(F.sqrt(F.try_divide(F.sum("_ss"), F.sum("_n").cast("double"))).alias(name))


def spectrum(df: DataFrame, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Long `(frequency, density)` per channel."""
    density = df.select(*keys, "channel", "fs", F.size("samples").alias("_n"), K.periodogram("samples", "fs").alias("_p"))
    return density.select(*keys, "channel", "fs", "_n", F.posexplode("_p").alias("k", "density")).select(
        *keys, "channel", "k", (F.col("k") * F.col("fs") / F.col("_n")).alias("frequency"), "density"
    )


def lf_features(
    df: DataFrame,
    bands: Mapping[str, tuple[float, float]] | None = None,
    suffix: str = "",
    fs: str = "fs",
    keys: Sequence[str] = RECORDING,
) -> DataFrame:
    """`rms_lf` and the power of each band in dB; no shuffle."""
    bands = dict(BANDS if bands is None else bands)
    summary = K.spectral_summary(bands)
    out = df.select(*keys, "channel", summary("samples", fs).alias("_s"))
    return out.select(
        *keys,
        "channel",
        F.col("_s")[0].alias(f"rms_lf{suffix}"),
        *[power_db(F.col("_s")[i + 1]).alias(f"psd_{band}{suffix}") for i, band in enumerate(bands)],
    )


def summed_spectra(df: DataFrame, bands: Mapping[str, tuple[float, float]], keys: Sequence[str]) -> DataFrame:
    """`rms` and the mean power of each band of traces that lie in several rows.

    Sums of squares and numbers of samples are added; spectra are averaged over
    the rows with their numbers of samples as weights, without those that are
    too short for the band.
    """
    sums = df.select(*keys, "channel", K.spectral_sums(bands)("samples", "fs").alias("_s")).filter("_s is not null")
    n = F.col("_s")[0]
    powers = []
    for i, band in enumerate(bands):
        power = known(F.col("_s")[2 + i])
        powers.append(F.try_divide(F.sum(power), F.sum(F.when(power.isNotNull(), n))).alias(band))
    last = 2 + len(bands)
    return sums.groupBy(*keys, "channel").agg(
        F.sqrt(F.try_divide(F.sum(F.col("_s")[1]), F.sum(n))).alias("rms"),
        *powers,
        F.sum(F.col("_s")[last]).alias("_high"),
        F.sum(F.col("_s")[last + 1]).alias("_power"),
    )


def decimate(df: DataFrame, q: int) -> DataFrame:
    """Low-pass and keep every q-th sample. `fs` keeps its value; see `csd_features`."""
    return df.withColumn("samples", K.decimator(q)("samples"))


def current_source_density(df: DataFrame, sigma: float = 1.0 / 3.0, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Second spatial difference of whole sample arrays along each column of sites.

    The window holds one column of one probe; arrays are not exploded. The end
    sites copy their neighbour; a column of fewer than three sites gives NULL.
    """
    column = Window.partitionBy(*keys, "lateral_um")
    along = column.orderBy("axial_um")
    spaced = df.withColumn("samples", A.doubles("samples")).withColumn("_gap", F.lead("axial_um").over(along) - F.col("axial_um"))
    spacing = F.percentile("_gap", 0.5).over(column)
    above, below = F.lag("samples").over(along), F.lead("samples").over(along)
    inner = F.zip_with(
        F.zip_with("_above", "_below", lambda a, b: a + b), "samples", lambda s, x: F.col("_scale") * (s - 2.0 * x)
    )
    return (
        spaced.withColumns({"_above": above, "_below": below, "_dx": spacing})
        .withColumn("_scale", F.lit(sigma) / (F.col("_dx") * F.col("_dx")))
        .withColumn("_csd", F.when(F.col("_above").isNotNull() & F.col("_below").isNotNull(), inner))
        .withColumn("samples", F.coalesce("_csd", F.lead("_csd").over(along), F.lag("_csd").over(along)))
        .drop("_gap", "_above", "_below", "_dx", "_scale", "_csd")
    )


def csd_features(
    df: DataFrame,
    bands: Mapping[str, tuple[float, float]] | None = None,
    q: int = 10,
    compat: bool = False,
    keys: Sequence[str] = RECORDING,
) -> DataFrame:
    """Band powers of the current source density of the decimated signal.

    With `compat` the spectra are scaled by the rate before decimation.
    """
    density = current_source_density(decimate(df, q), keys=keys)
    rate = F.col("fs") if compat else F.col("fs") / F.lit(float(q))
    return lf_features(density.withColumn("fs", rate), bands, suffix="_csd", keys=keys)


def banded_covariance(
    df: DataFrame, half_width: int = 8, block: int = 64, parts: Sequence[str] = (), keys: Sequence[str] = RECORDING
) -> DataFrame:
    """`(keys, channel, products)`: dot products with channels 0..half_width further on.

    Channels are cut into blocks and each block takes along only the next
    `half_width` channels, so a trace is shuffled 1 + half_width/block times
    instead of once per neighbour, and a group never exceeds
    `block + half_width` traces. `parts` names columns (a chunk) over which the
    products are summed afterwards.
    """
    own = F.floor(F.col("channel") / F.lit(block)).cast("int")
    lent = F.when((F.col("channel") % block < half_width) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    placed = df.select(*keys, *parts, "channel", "samples", F.explode(lent).alias("_home"))
    key_fields = [df.schema[k] for k in [*keys, *parts]]
    schema = T.StructType(
        key_fields
        + [T.StructField("channel", T.IntegerType()), T.StructField("products", T.ArrayType(T.DoubleType()))]
    )
    names = [*keys, *parts]

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("channel")
        channels = pdf["channel"].to_numpy()
        v = np.stack([np.asarray(s, dtype=float) for s in pdf["samples"]])
        owned = channels // block == pdf["_home"].iat[0]
        rows = K.banded_products(channels, v, half_width)[owned]
        return pdf.loc[owned, names].assign(channel=channels[owned].astype("int32"), products=list(rows))

    out = placed.groupBy(*names, "_home").applyInPandas(products, schema)
    if not parts:
        return out
    long = out.select(*keys, "channel", F.posexplode("products").alias("k", "p"))
    summed = long.groupBy(*keys, "channel", "k").agg(F.sum("p").alias("p"))
    return summed.groupBy(*keys, "channel").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("k", "p"))), lambda s: s.p).alias("products")
    )


def neighbour_covariance(banded: DataFrame, keys: Sequence[str] = RECORDING, half_width: int = 8) -> DataFrame:
    """Long `(keys, channel, neighbour, multiplicity, cov)` over offsets -half_width..half_width.

    `banded` must come from `banded_covariance` with the same half width.

    Offsets that leave the array are reflected at its ends; one that reflects
    a channel onto itself is left out. `multiplicity` is the number of offsets
    that lead from the channel to the neighbour, so the reflection needs no
    further join on traces.
    """
    sizes = banded.groupBy(*keys).agg((F.max("channel") + 1).alias("nc"))
    pairs = (
        banded.select(*keys, "channel", F.posexplode("products").alias("k", "cov"))
        .filter(known("cov").isNotNull())
        .withColumn("half", F.lit(half_width))
    )
    there = F.struct(F.col("channel").alias("c"), (F.col("channel") + F.col("k")).alias("nb"))
    back = F.struct((F.col("channel") + F.col("k")).alias("c"), F.col("channel").alias("nb"))
    ends = F.when(F.col("k") > 0, F.array(there, back)).otherwise(F.array(there))
    both = pairs.select(*keys, "half", "cov", F.inline(ends)).join(sizes, list(keys))
    apart = F.col("c") != F.col("nb")
    at_start = apart & (F.col("nb") >= 1) & (F.col("c") + F.col("nb") <= F.col("half"))
    at_end = (
        apart
        & (F.col("nb") <= F.col("nc") - 2)
        & (2 * (F.col("nc") - 1) - F.col("c") - F.col("nb") <= F.col("half"))
    )
    times = F.lit(1) + F.when(at_start, 1).otherwise(0) + F.when(at_end, 1).otherwise(0)
    return both.select(
        *keys, F.col("c").alias("channel"), F.col("nb").alias("neighbour"), times.alias("multiplicity"), "cov", "nc"
    )


def correlation_ratio(
    df: DataFrame, keys: Sequence[str] = RECORDING, parts: Sequence[str] = (), half_width: int = 8
) -> DataFrame:
    """Mean covariance with the neighbours over the variance, per channel.

    NULL where the array has fewer than `half_width + 5` channels (13), too few to reflect.
    """
    cov = neighbour_covariance(banded_covariance(df, half_width, parts=parts, keys=keys), keys, half_width)
    own = F.max(F.when(F.col("channel") == F.col("neighbour"), F.col("cov")))
    mean = F.sum(F.col("cov") * F.col("multiplicity")) / F.sum("multiplicity")
    return cov.groupBy(*keys, "channel").agg(
        F.when(F.max("nc") >= half_width + 5, F.try_divide(mean, own)).alias("cor_ratio")
    )


def ap_features(df: DataFrame, keys: Sequence[str] = RECORDING) -> DataFrame:
    """`rms_ap` and `cor_ratio`; the layout is required to order the channels."""
    absent = [c for c in ("lateral_um", "axial_um") if c not in df.columns]
    if absent:
        raise ValueError(f"layout columns {absent} are required")
    return rms_by_channel(df, "rms_ap", keys).join(correlation_ratio(df, keys), [*keys, "channel"])


def quality_labels(
    df: DataFrame,
    dead_below: float = 0.1,
    noisy_above: float = 5.0,
    high_share: float = 0.5,
    outside_below: float = 0.1,
    keys: Sequence[str] = RECORDING,
    parts: Sequence[str] = (),
) -> DataFrame:
    """Channel labels: 0 good, 1 dead, 2 noisy, 3 outside.

    Dead and noisy compare the RMS with the probe's median and the share of
    high-frequency power; outside is the unbroken run of uncorrelated channels
    at the top. `parts` names columns (a frame) over which a trace is cut; sums
    over them give the measures of the whole.
    """
    if parts:
        summed = summed_spectra(df, {}, keys)
        measures = summed.select(*keys, "channel", "rms", F.coalesce(F.try_divide("_high", "_power"), F.lit(0.0)).alias("high"))
    else:
        measures = df.select(*keys, "channel", K.spectral_summary({})("samples", "fs").alias("_s")).select(
            *keys, "channel", F.col("_s")[0].alias("rms"), F.col("_s")[1].alias("high")
        )
    banded = banded_covariance(df, half_width=1, parts=parts, keys=keys)
    # products[1] of channel c-1 is its covariance with c.
    previous = banded.select(
        *keys, (F.col("channel") + 1).alias("channel"), known(F.col("products")[1]).alias("_with_prev")
    )
    joined = (
        measures.join(banded.select(*keys, "channel", F.col("products")[0].alias("_own")), [*keys, "channel"])
        .join(previous, [*keys, "channel"], "left")
        .withColumn("neighbour_ratio", F.try_divide("_with_prev", "_own"))
    )
    probe = Window.partitionBy(*keys)
    from_top = probe.orderBy(F.col("channel").desc()).rowsBetween(Window.unboundedPreceding, 0)
    correlated = F.when(F.coalesce(F.col("neighbour_ratio") < outside_below, F.lit(False)), 0).otherwise(1)
    middle = F.col("_median")
    return (
        joined.withColumn("_median", F.percentile("rms", 0.5).over(probe))
        .withColumn("_run", F.max(correlated).over(from_top))
        .select(
            *keys,
            "channel",
            "rms",
            "high",
            "neighbour_ratio",
            F.when(F.col("rms") < dead_below * middle, 1)
            .when((F.col("high") > high_share) | (F.col("rms") > noisy_above * middle), 2)
            .when(F.col("_run") == 0, 3)
            .otherwise(0)
            .alias("labels"),
        )
    )


def fill_bad_channels(df: DataFrame, radius_um: float = 60.0, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Replace traces of bad channels by the inverse-distance mean of good neighbours.

    A bad channel without a good neighbour in reach keeps its trace.
    """
    bad = df.filter(F.coalesce(F.col("labels") != 0, F.lit(True)))
    good = df.filter(F.col("labels") == 0)
    near = channels_in_reach(bad, good, radius_um, keys, carry=("samples",)).filter("distance > 0")
    weighted = near.groupBy(*keys, "channel").agg(
        F.collect_list(F.struct((1.0 / F.col("distance")).alias("w"), F.col("nb_samples").alias("x"))).alias("_near")
    )
    weight = F.aggregate("_near", F.lit(0.0), lambda acc, s: acc + s.w)
    empty = F.transform(F.col("_near")[0].x, lambda _: F.lit(0.0))
    total = F.aggregate("_near", empty, lambda acc, s: F.zip_with(acc, s.x, lambda a, v: a + s.w * v))
    filled = (
        weighted.withColumn("_w", weight)
        .withColumn("_t", total)
        .select(*keys, "channel", A.scaled("_t", 1.0 / F.col("_w")).alias("_filled"))
    )
    return (
        df.join(filled, [*keys, "channel"], "left")
        .withColumn("samples", F.coalesce("_filled", A.doubles("samples")))
        .drop("_filled")
    )


def median_reference(df: DataFrame, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Subtract the per-sample median over the channels of a snippet."""
    schema = T.StructType(
        [T.StructField(f.name, T.ArrayType(T.DoubleType())) if f.name == "samples" else f for f in df.schema.fields]
    )

    def referenced(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack([np.asarray(s, dtype=float) for s in pdf["samples"]])
        return pdf.assign(samples=list(v - np.median(v, axis=0)))

    return df.groupBy(*keys).applyInPandas(referenced, schema)


def destripe(df: DataFrame, radius_um: float = 60.0, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Fill bad channels, then remove the common median."""
    return median_reference(fill_bad_channels(df, radius_um, keys), keys)


# ---------------------------------------------------------------- events


def candidate_events(
    df: DataFrame, threshold: float = 5.0, reach: int = 20, keys: Sequence[str] = RECORDING, level: str | None = None
) -> DataFrame:
    """Samples whose |x|/rms reaches the threshold and is the largest within +-reach.

    `level` names a column with the RMS to use, where the samples are a part of a trace.
    """
    schema = T.StructType(
        [df.schema[k] for k in keys]
        + [df.schema[c] for c in ("channel", "lateral_um", "axial_um")]
        + [T.StructField("sample", T.IntegerType())]
        + [T.StructField(c, T.DoubleType()) for c in ("z", "ptp")]
    )
    fixed = [*keys, "channel", "lateral_um", "axial_um"]

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, x in K.equal_lengths(pdf["samples"]):
                given = None if level is None else pdf[level].to_numpy(dtype=float)[at]
                row, sample, z, ptp = K.peaks_over(x, threshold, reach, given)
                yield pdf[fixed].iloc[at[row]].assign(sample=sample, z=z, ptp=ptp)

    return df.select(*fixed, "samples", *([level] if level else [])).mapInPandas(found, schema)


def strongest_events(
    events: DataFrame, radius_um: float = 150.0, reach: int = 20, keys: Sequence[str] = RECORDING
) -> DataFrame:
    """Drop events with a larger one within the radius and +-reach samples.

    The lower channel wins ties. Events meet only in equal time and depth
    buckets, so the comparison is an equi-join. They are few next to the
    traces and are written once, so that the traces are not read for each side.
    """
    events = materialise(events, "candidates")
    tick, step = F.floor(F.col("sample") / F.lit(reach + 1)), F.floor(F.col("axial_um") / F.lit(radius_um))
    narrow = events.select(*keys, "channel", "sample", "lateral_um", "axial_um", F.abs("z").alias("size"))
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    left = (
        narrow.withColumn("_t", F.explode(F.transform(around, lambda d: tick + d)))
        .withColumn("_a", F.explode(F.transform(around, lambda d: step + d)))
    )
    right = narrow.select(
        *keys,
        tick.alias("_t"),
        step.alias("_a"),
        F.col("channel").alias("o_channel"),
        F.col("sample").alias("o_sample"),
        F.col("lateral_um").alias("o_x"),
        F.col("axial_um").alias("o_y"),
        F.col("size").alias("o_size"),
    )
    beaten = (F.col("o_size") > F.col("size")) | (
        (F.col("o_size") == F.col("size")) & (F.col("o_channel") < F.col("channel"))
    )
    close = (F.abs(F.col("o_sample") - F.col("sample")) <= reach) & (
        F.hypot(F.col("o_x") - F.col("lateral_um"), F.col("o_y") - F.col("axial_um")) <= radius_um
    )
    losers = left.join(right, [*keys, "_t", "_a"]).filter(beaten & close).select(*keys, "channel", "sample").distinct()
    return events.join(losers, [*keys, "channel", "sample"], "left_anti")


def event_waveforms(
    events: DataFrame,
    traces: DataFrame,
    radius_um: float = 150.0,
    before: int = 42,
    length: int = 121,
    keys: Sequence[str] = RECORDING,
) -> DataFrame:
    """One row per event and channel in reach, with the samples about the event.

    The windows wanted from a channel are first gathered into one array, so
    each trace takes part in a single join and is not copied per event. Windows
    that leave the snippet are padded with zeros.
    """
    sites = traces.select(*keys, "channel", "lateral_um", "axial_um")
    pairs = channels_in_reach(
        events.select(*keys, "channel", "sample", "lateral_um", "axial_um"), sites, radius_um, keys, key_extra=("sample",)
    )
    wanted = pairs.groupBy(*keys, F.col("neighbour").alias("channel")).agg(
        F.collect_list(F.struct(F.col("channel").alias("event_channel"), "sample")).alias("_wanted")
    )
    start = lambda e: e.sample - F.lit(before)
    cut = F.transform(
        "_wanted",
        lambda e: F.struct(
            e.event_channel.alias("event_channel"),
            e.sample.alias("sample"),
            F.concat(
                F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), -start(e))),
                A.doubles(
                    F.slice("samples", F.greatest(F.lit(0), start(e)) + 1, F.lit(length) - F.greatest(F.lit(0), -start(e)))
                ),
                F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), start(e) + F.lit(length) - F.size("samples"))),
            ).alias("waveform"),
        ),
    )
    return (
        traces.select(*keys, "channel", "lateral_um", "axial_um", "samples")
        .join(wanted, [*keys, "channel"])
        .select(*keys, F.col("channel").alias("neighbour"), "lateral_um", "axial_um", F.inline(cut))
        .withColumnRenamed("event_channel", "channel")
    )


def located_events(waveforms: DataFrame, reach: int = 20, before: int = 42, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Amplitude-weighted location, size and own waveform of each event."""
    near = A.window_of("waveform", F.lit(max(before - reach, 0)), F.lit(2 * reach + 1 + min(before - reach, 0)))
    sized = waveforms.withColumn("_ptp", F.array_max(near) - F.array_min(near))
    own = F.col("neighbour") == F.col("channel")
    weight = F.sum("_ptp")
    return sized.groupBy(*keys, "channel", "sample").agg(
        F.max(F.when(own, F.col("_ptp"))).alias("ptp"),
        F.try_divide(F.sum(F.col("_ptp") * F.col("lateral_um")), weight).alias("xloc"),
        F.try_divide(F.sum(F.col("_ptp") * F.col("axial_um")), weight).alias("yloc"),
        F.lit(0.0).alias("zloc"),
        F.max(F.when(own, F.col("_ptp"))).alias("alpha"),
        F.max(F.when(own, F.col("waveform"))).alias("waveform"),
    )


def detect_events(
    df: DataFrame,
    threshold: float = 5.0,
    radius_um: float = 150.0,
    reach: int = 20,
    before: int = 42,
    length: int = 121,
    keys: Sequence[str] = RECORDING,
) -> tuple[DataFrame, DataFrame]:
    """`(events, waveforms)` of all traces."""
    kept = strongest_events(candidate_events(df, threshold, reach, keys), radius_um, reach, keys)
    waveforms = event_waveforms(kept, df, radius_um, before, length, keys)
    return located_events(waveforms, reach, before, keys), waveforms


def event_shapes(events: DataFrame, fs: float, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Events with an id and the shape of their own waveform."""
    return events.withColumn("spike_id", F.concat_ws("_", *keys, "channel", "sample")).withColumn(
        "_shape", A.waveform_shape("waveform", fs)
    ).select(*events.columns, "spike_id", "_shape.*")


def waveform_features(
    df: DataFrame,
    fs: float,
    before: int = 42,
    keys: Sequence[str] = RECORDING,
    sink: Callable[[DataFrame, DataFrame], None] | None = None,
    **detection,
) -> DataFrame:
    """The 14 waveform features of every channel that has events.

    A `sink` is given the waveforms and the events, which are then written once
    for it and for the features.
    """
    events, waveforms = detect_events(df, before=before, keys=keys, **detection)
    if sink is not None:
        events = materialise(events, "events")
        sink(waveforms, events)
    return channel_event_features(event_shapes(events, fs, keys), [*keys, "channel"], fs, before)
