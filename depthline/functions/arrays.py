"""Array-column expressions for short signals; they run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from depthline.functions import kernels as K
from depthline.functions.columns import _c


def doubles(x) -> Column:
    return _c(x).cast("array<double>")


def sum_of_squares(x) -> Column:
    return F.aggregate(doubles(x), F.lit(0.0), lambda acc, v: acc + v * v)


def rms(x) -> Column:
    """Root mean square of an array; NULL for an empty one."""
    return F.sqrt(F.try_divide(sum_of_squares(x), F.size(_c(x)).cast("double")))


def dot(x, y) -> Column:
    return F.aggregate(F.zip_with(doubles(x), doubles(y), lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def scaled(x, factor) -> Column:
    factor = _c(factor)
    return F.transform(_c(x), lambda v: v * factor)


def window_of(x, start, length) -> Column:
    """`length` samples from the 0-based `start`; shorter at the end of the array."""
    return F.slice(_c(x), _c(start).cast("int") + 1, _c(length).cast("int"))


def waveform_shape(waveform, fs, recovery_offset: int = 5) -> Column:
    """Struct column of the waveform's shape; see `kernels.waveform_shape`."""
    fs = F.lit(float(fs)) if isinstance(fs, (int, float)) else _c(fs)
    return K.waveform_shape(recovery_offset)(_c(waveform), fs)
