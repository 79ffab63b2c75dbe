"""Scalar column functions: built-in expressions that stay in codegen, but for `next_fast_length`."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def known(x) -> Column:
    """NaN as NULL, so that aggregates skip it."""
    return F.nanvl(_c(x).cast("double"), F.lit(None).cast("double"))


def nulled_infinities(df: DataFrame) -> DataFrame:
    """Replace +-inf by NULL in every floating column."""
    floating = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            F.when(F.abs(F.col(f.name)) == F.lit(float("inf")), None).otherwise(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, floating)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def power_db(x) -> Column:
    """10*log10; NULL for values that are not positive."""
    return F.lit(10.0) * F.log10(_c(x))


def amplitude_db(x) -> Column:
    """20*log10; NULL for values that are not positive."""
    return F.lit(20.0) * F.log10(_c(x))


def log_count(x) -> Column:
    return F.log10(_c(x) + F.lit(1.0))


def entropy_term(p) -> Column:
    """-p*log2(p), with 0 at p = 0."""
    p = _c(p)
    return F.when(p > 0, -p * F.log2(p)).otherwise(F.lit(0.0))


def ratio(a, b) -> Column:
    """|a/b|; NULL when b is 0."""
    return F.abs(F.try_divide(_c(a).cast("double"), _c(b).cast("double")))


def cosine_taper(x, low: float, high: float) -> Column:
    """0 below `low`, 1 above `high`, a raised cosine between."""
    x = _c(x)
    ramp = (F.lit(1.0) - F.cos(F.lit(3.141592653589793) * (x - F.lit(low)) / F.lit(high - low))) / F.lit(2.0)
    return F.when(x <= low, F.lit(0.0)).when(x >= high, F.lit(1.0)).otherwise(ramp)


def band_weight(frequency, low: float, high: float) -> Column:
    """Weight of a frequency in a band: raised cosine about the band centre.

    The half-width is the width of the band, so the kernel leaks past the edges.
    """
    centre, width = (low + high) / 2.0, high - low
    return cosine_taper(-F.abs(_c(frequency) - F.lit(centre)), -width, 0.0)


def sample_index(fs, t0, latency: int = 0) -> Column:
    """First sample of a window that starts at `t0`; truncated, not rounded."""
    return (_c(fs) * _c(t0) + F.lit(float(latency))).cast("bigint")


def base_name(path) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def short_hash(text, length: int) -> Column:
    return F.substring(F.md5(_c(text).cast("binary")), 1, length)


def probe_key(pid, source_path) -> Column:
    """The probe id, or a hash of the recording's file name where it has none."""
    return F.coalesce(_c(pid).cast("string"), short_hash(base_name(source_path), 12))


def snippet_key(pid, t_start, duration) -> Column:
    """`probe_{pid}_{start}_{duration}` with fixed-width decimals."""
    return F.concat(
        F.lit("probe_"),
        F.coalesce(_c(pid).cast("string"), F.lit("None")),
        F.lit("_"),
        F.format_string("%08.1f", _c(t_start).cast("double")),
        F.lit("_"),
        F.format_string("%04.1f", _c(duration).cast("double")),
    )


def smooth_lengths(limit: int) -> list[int]:
    """All numbers up to `limit` whose only prime factors are 2, 3 and 5."""
    found = []
    p2 = 1
    while p2 <= limit:
        p23 = p2
        while p23 <= limit:
            p235 = p23
            while p235 <= limit:
                found.append(p235)
                p235 *= 5
            p23 *= 3
        p2 *= 2
    return sorted(found)


LONGEST = 2**62


@cache
def _all_smooth() -> np.ndarray:
    """Every 5-smooth number up to `LONGEST`, in order: some ten thousand."""
    return np.array(smooth_lengths(LONGEST), np.int64)


@F.arrow_udf(T.LongType())
def _next_smooth(n: pa.Array) -> pa.Array:
    lengths = n.fill_null(0).to_numpy()
    fit = (lengths >= 1) & (lengths <= LONGEST)
    at = np.searchsorted(_all_smooth(), np.where(fit, lengths, 1))
    return pa.array(_all_smooth()[at], mask=~fit)


def next_fast_length(n) -> Column:
    """The least 5-smooth number that is not below `n`, for any whole `n` from 1 to 2^62; NULL for others.

    A binary search in the table of all 5-smooth numbers, an Arrow batch at a time.
    """
    return _next_smooth(_c(n).cast("bigint"))


def tilted_angles(theta_deg, phi_deg, tilt_deg: float = -5.0) -> tuple[Column, Column]:
    """Spherical angles after rotating the direction about the x axis, in degrees."""
    t, p, a = F.radians(_c(theta_deg)), F.radians(_c(phi_deg)), F.radians(F.lit(float(tilt_deg)))
    ux, uy, uz = F.sin(t) * F.cos(p), F.sin(t) * F.sin(p), F.cos(t)
    vy = uy * F.cos(a) - uz * F.sin(a)
    vz = uy * F.sin(a) + uz * F.cos(a)
    unit = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), vz))
    return F.degrees(F.acos(unit)), F.degrees(F.atan2(vy, ux))


def affine(x, scale: float, offset: float) -> Column:
    return _c(x) * F.lit(float(scale)) + F.lit(float(offset))


def clipped(x, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _c(x)))


def voxel_index(x, origin: float, spacing: float, size: int) -> Column:
    """Nearest voxel along one axis, clipped to the volume."""
    return clipped(F.floor((_c(x) - F.lit(origin)) / F.lit(spacing) + F.lit(0.5)), 0, size - 1).cast("int")


def json_flag_is(column, path: str, value: str) -> Column:
    return F.coalesce(F.get_json_object(_c(column), path) == F.lit(value), F.lit(False))


def contains_ignoring_case(column, text: str) -> Column:
    return F.lower(_c(column)).contains(text.lower())


def structs(names: Sequence[str]) -> Column:
    return F.struct(*[F.col(n) for n in names])


def rounded(x, places: int = 4) -> Column:
    """Round half up, nudged off decimal ties so that other engines agree."""
    unit = 10.0**places
    return F.floor(_c(x) * F.lit(unit) + F.lit(0.5 + 1e-5)) / F.lit(unit)
