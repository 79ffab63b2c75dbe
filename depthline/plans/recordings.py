"""Features of whole recordings of any length, frame by frame.

A recording is cut into frames of a few seconds. A frame carries the samples
around it that filters and events reach for (its halo), so what is computed at
its own samples is what one window over the whole recording gives. Frames are
summed up: squares and products are added, spectra averaged, events gathered.
No group holds more than the channels of a probe times two frames and a halo.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthline.functions.columns import power_db, sample_index
from depthline.operators import signal as G
from depthline.operators.relational import channel_event_features
from depthline.schemas import BANDS, checked_sets
from depthline.session import materialise

FRAME = ("pid", "frame")


def frames(chunks: DataFrame, spans: DataFrame, frame_samples: int, halo: int, latency: int = 0) -> DataFrame:
    """`(pid, frame, channel, fs, lead, core, samples)` of the spans `(pid, t_start, duration)` of recordings.

    `samples` holds the frame and up to `halo` samples on both sides, `lead` of
    them before the frame's own `core`. The rest at the end of a span belongs to
    its last frame, which is shorter than two; a span shorter than a frame is
    one. Only the chunks of the spans are shuffled, each to the frames that it touches.
    """
    begin = sample_index("fs", "t_start", latency)
    spanned = chunks.join(spans.select("pid", "t_start", "duration"), "pid").withColumn("_begin", begin)
    spanned = spanned.withColumn("_ns", (F.col("fs") * F.col("duration")).cast("bigint"))
    size = F.lit(frame_samples).cast("bigint")
    count = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("_ns") / size))

    def frame_of(place: Column) -> Column:
        return F.least(F.greatest(F.floor(place / size), F.lit(0).cast("bigint")), count - 1)

    # Places are counted from the start of the span.
    placed = spanned.withColumn("_at", F.col("n0") - F.col("_begin")).withColumn("_to", F.col("_at") + F.size("samples"))
    placed = placed.filter((F.col("_to") > 0) & (F.col("_at") < F.col("_ns")))
    touched = F.explode(F.sequence(frame_of(F.col("_at") - halo), frame_of(F.col("_to") - 1 + halo)))
    cut = placed.withColumn("frame", touched)
    start = F.col("frame") * size
    stop = F.when(F.col("frame") == count - 1, F.col("_ns")).otherwise(start + size)
    cut = cut.withColumn("_start", start).withColumn("_stop", stop)
    first = F.greatest(F.col("_at"), F.col("_start") - halo, F.lit(0))
    last = F.least(F.col("_to"), F.col("_stop") + halo, F.col("_ns"))
    piece = F.slice("samples", (first - F.col("_at") + 1).cast("int"), F.greatest(F.lit(0), last - first).cast("int"))
    pieces = cut.select(*FRAME, "channel", "fs", "_start", "_stop", F.struct("n0", piece.alias("part")).alias("_piece"))
    return pieces.groupBy(*FRAME, "channel").agg(
        F.first("fs").alias("fs"),
        F.least(F.first("_start"), F.lit(halo)).cast("int").alias("lead"),
        (F.first("_stop") - F.first("_start")).cast("int").alias("core"),
        F.flatten(F.transform(F.sort_array(F.collect_list("_piece")), lambda s: s.part)).alias("samples"),
    )


def own_samples(framed: DataFrame, q: int = 1) -> DataFrame:
    """Frames without their halos; `q` is the factor by which the samples were decimated."""
    lead, core = F.floor(F.col("lead") / q).cast("int"), F.ceil(F.col("core") / q).cast("int")
    return framed.withColumn("samples", F.slice("samples", lead + 1, core))


def whole_sets(
    ap: DataFrame,
    lf: DataFrame,
    requested: Sequence[str] | None = None,
    fs_ap: float = 30_000.0,
    bands: Mapping[str, tuple[float, float]] | None = None,
    q: int = 10,
    before: int = 42,
    detection: Mapping | None = None,
    destriped: bool = False,
) -> dict[str, DataFrame]:
    """Name -> features per `(pid, channel)` of framed traces with a layout (`lateral_um`, `axial_um`).

    RMS, correlation ratio, labels and events are those of the whole recording;
    band powers are means of the frames' spectra. Frames have to be a multiple
    of `q` long, with the halos of `halo_of`.
    """
    sets = checked_sets(requested)
    bands = dict(BANDS if bands is None else bands)
    found: dict[str, DataFrame] = {}
    if not destriped:
        if "labels" not in ap.columns:
            labels = G.quality_labels(own_samples(ap), keys=["pid"], parts=["frame"]).select("pid", "channel", "labels")
            labels = materialise(labels, "labels")
            ap = ap.join(labels, ["pid", "channel"])
            lf = lf.drop("labels").join(labels, ["pid", "channel"])
        ap, lf = G.destripe(ap, keys=FRAME), G.destripe(lf, keys=FRAME)

    def powers(df: DataFrame, suffix: str) -> DataFrame:
        summed = G.summed_spectra(df, bands, ["pid"])
        return summed.select(
            "pid", "channel", F.col("rms").alias(f"rms_lf{suffix}"), *[power_db(b).alias(f"psd_{b}{suffix}") for b in bands]
        )

    if "lf" in sets:
        found["lf"] = powers(own_samples(lf), "")
    if "csd" in sets:
        density = G.current_source_density(own_samples(G.decimate(lf, q), q), keys=FRAME)
        rates = density.withColumn("fs", F.col("fs") / F.lit(float(q)))
        known = powers(rates.filter("samples is not null"), "_csd")
        found["csd"] = lf.select("pid", "channel").distinct().join(known, ["pid", "channel"], "left")
    if {"ap", "waveforms"} & set(sets):
        ap = materialise(ap, "frames")  # read for levels, products, events and waveforms
        levels = G.rms_over_chunks(own_samples(ap), ["pid", "channel"], "rms_ap")
    if "ap" in sets:
        ratio = G.correlation_ratio(own_samples(ap), ["pid"], parts=["frame"])
        found["ap"] = levels.join(ratio, ["pid", "channel"])
    if "waveforms" in sets:
        found["waveforms"] = _events(ap.join(levels, ["pid", "channel"]), fs_ap, before, **(detection or {}))
    return found


def halo_of(q: int, before: int, reach: int = 20, length: int = 121, **_) -> tuple[int, int]:
    """Halos in samples of the high and the low band: what events and their neighbours reach, and the filter's half."""
    return max(2 * reach + 1, before, length - before), 10 * q


def _events(
    ap: DataFrame, fs: float, before: int, threshold: float = 5.0, radius_um: float = 150.0, reach: int = 20, length: int = 121
) -> DataFrame:
    """Waveform features of all events; an event belongs to the frame that holds its sample."""
    candidates = G.candidate_events(ap, threshold, reach, FRAME, level="rms_ap")
    strongest = G.strongest_events(candidates, radius_um, reach, FRAME)
    cores = ap.select(*FRAME, "channel", "lead", "core")
    inside = (F.col("sample") >= F.col("lead")) & (F.col("sample") < F.col("lead") + F.col("core"))
    own = strongest.join(cores, [*FRAME, "channel"]).filter(inside).drop("lead", "core")
    waveforms = G.event_waveforms(own, ap, radius_um, before, length, FRAME)
    located = G.located_events(waveforms, reach, before, FRAME)
    return channel_event_features(G.event_shapes(located, fs, FRAME), ["pid", "channel"], fs, before)
