"""Small numpy kernels for Arrow batches; Spark partitions and groups the work."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def power_spectrum(x: np.ndarray, fs: float) -> np.ndarray:
    """One-sided density of mean-removed rows: 2|X|^2/(fs N), edges not doubled."""
    n = x.shape[-1]
    spectrum = np.fft.rfft(x - x.mean(axis=-1, keepdims=True), axis=-1)
    density = (spectrum.real**2 + spectrum.imag**2) / (fs * n)
    density[..., 1 : (n + 1) // 2] *= 2.0
    return density


def band_weights(n: int, fs: float, bands: Mapping[str, tuple[float, float]]) -> np.ndarray:
    """Unit-sum weights, one column per band: a raised cosine of half-width `high - low`."""
    f = np.fft.rfftfreq(n, 1.0 / fs)
    columns = []
    for low, high in bands.values():
        reach = np.clip(1.0 - np.abs(f - (low + high) / 2.0) / (high - low), 0.0, 1.0)
        w = (1.0 - np.cos(np.pi * reach)) / 2.0
        columns.append(w / w.sum() if w.sum() > 0 else np.full(f.size, np.nan))
    return np.stack(columns, axis=1) if columns else np.empty((f.size, 0))


def equal_lengths(samples: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and stacked rows of the arrays of each length; missing and empty ones are left out."""
    lengths = samples.map(lambda s: 0 if s is None else len(s)).to_numpy()
    for length in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == length)
        yield at, np.stack([np.asarray(samples.iat[i], dtype=float) for i in at])


def slices_of_equal_length(arrays: pd.Series, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As `equal_lengths` for whole numbers, at most `rows` at a time."""
    for at, x in equal_lengths(arrays):
        for first in range(0, len(at), rows):
            yield at[first : first + rows], x[first : first + rows].astype(int)


def _equal_shapes(samples: pd.Series, fs: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """As `equal_lengths`, and of one sampling rate."""
    rates = fs.to_numpy(dtype=float)
    for at, x in equal_lengths(samples):
        for rate in np.unique(rates[at]):
            same = rates[at] == rate
            yield at[same], x[same], float(rate)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def periodogram(samples: pd.Series, fs: pd.Series) -> pd.Series:
    out = np.empty(len(samples), dtype=object)
    for at, x, rate in _equal_shapes(samples, fs):
        for i, row in zip(at, power_spectrum(x, rate)):
            out[i] = row
    return pd.Series(out)


def spectral_summary(bands: Mapping[str, tuple[float, float]], high_from: float = 0.8):
    """Arrow function `(samples, fs) -> [rms, power of each band, high share]`.

    Only a handful of numbers leave the worker, not the spectrum. Band powers
    are linear; the high share is the power above `high_from` * Nyquist.
    """
    bands = dict(bands)

    @F.pandas_udf("array<double>")
    def summary(samples: pd.Series, fs: pd.Series) -> pd.Series:
        out = np.empty(len(samples), dtype=object)
        for at, x, rate in _equal_shapes(samples, fs):
            density = power_spectrum(x, rate)
            high = np.fft.rfftfreq(x.shape[1], 1.0 / rate) > high_from * rate / 2.0
            total = density.sum(axis=1)
            share = np.divide(density[:, high].sum(axis=1), total, out=np.zeros_like(total), where=total > 0)
            rms = np.sqrt((x * x).mean(axis=1))
            rows = np.column_stack([rms, density @ band_weights(x.shape[1], rate, bands), share])
            for i, row in zip(at, rows):
                out[i] = row
        return pd.Series(out)

    return summary


def spectral_sums(bands: Mapping[str, tuple[float, float]], high_from: float = 0.8):
    """Arrow function `(samples, fs) -> [n, sum of squares, n * power of each band, n * high power, n * power]`.

    Sums over the parts of a recording give its RMS, and means of its parts'
    spectra. A part that is too short for a band has NaN there.
    """
    bands = dict(bands)

    @F.pandas_udf("array<double>")
    def sums(samples: pd.Series, fs: pd.Series) -> pd.Series:
        out = np.empty(len(samples), dtype=object)
        for at, x, rate in _equal_shapes(samples, fs):
            n = x.shape[1]
            density = power_spectrum(x, rate)
            high = np.fft.rfftfreq(n, 1.0 / rate) > high_from * rate / 2.0
            powers = density @ band_weights(n, rate, bands)
            rows = [np.full(len(at), n), (x * x).sum(axis=1), n * powers, n * density[:, high].sum(axis=1), n * density.sum(axis=1)]
            for i, row in zip(at, np.column_stack(rows)):
                out[i] = row
        return pd.Series(out)

    return sums


def low_pass(q: int) -> np.ndarray:
    """Hamming-windowed sinc of 20q+1 taps, cut at 1/q of Nyquist, unit sum."""
    m = np.arange(-10 * q, 10 * q + 1)
    taps = np.sinc(m / q) * (0.54 + 0.46 * np.cos(np.pi * m / (10 * q)))
    return taps / taps.sum()


def decimator(q: int):
    """Arrow function that low-passes (zero phase, zeros outside) and keeps every q-th sample."""
    taps = low_pass(q)
    half = 10 * q

    @F.pandas_udf("array<double>")
    def decimated(samples: pd.Series) -> pd.Series:
        def one(s):
            padded = np.pad(np.asarray(s, dtype=float), half)
            return np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1)[::q] @ taps

        return samples.map(one, na_action="ignore")

    return decimated


def peaks_over(x: np.ndarray, threshold: float, reach: int, level: np.ndarray | None = None):
    """`(row, sample, z, ptp)` of samples of |x|/level >= threshold that lead within +-reach; the level is the RMS unless given."""
    level = np.sqrt((x * x).mean(axis=1)) if level is None else level
    size = np.abs(x)
    row, sample = np.nonzero((size >= threshold * level[:, None]) & (level[:, None] > 0))
    offsets = np.arange(-reach, reach + 1)
    place = sample[:, None] + offsets[None, :]
    outside = (place < 0) | (place >= x.shape[1])
    near = np.where(outside, np.nan, x[row[:, None], np.clip(place, 0, x.shape[1] - 1)])
    if row.size:
        lead = size[row, sample] >= np.nanmax(np.abs(near), axis=1)
        row, sample, near = row[lead], sample[lead], near[lead]
    ptp = np.nanmax(near, axis=1) - np.nanmin(near, axis=1) if row.size else np.empty(0)
    return row, sample.astype("int32"), x[row, sample] / level[row], ptp


def waveform_shape(recovery_offset: int = 5):
    """Arrow function `(waveform, fs) -> struct` of peak, tip, trough, recovery and slopes.

    The peak is the first sample of largest magnitude. The tip and the trough
    are the extrema of the opposite sense up to and from the peak. The recovery
    point lies `recovery_offset` samples after the trough, or at the end.
    Slopes are value over index differences, in units per second; missing where
    two points coincide.
    """
    points = ("peak", "tip", "trough", "recovery")
    slopes = {
        "depolarisation_slope": ("peak", "tip"),
        "repolarisation_slope": ("trough", "peak"),
        "recovery_slope": ("recovery", "trough"),
    }
    fields = [T.StructField(f"{p}_{k}", t) for p in points for k, t in (("time_idx", T.IntegerType()), ("val", T.DoubleType()))]
    schema = T.StructType(fields + [T.StructField(c, T.DoubleType()) for c in (*slopes, "invert_sign_peak")])

    @F.pandas_udf(schema)
    def shape(waveform: pd.Series, fs: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({f.name: pd.array([None] * len(waveform), dtype="Int32" if f.name.endswith("idx") else "Float64") for f in schema.fields})
        for rows, w in equal_lengths(waveform):
            order = np.arange(w.shape[1])[None, :]
            pick = np.arange(len(rows))
            index = {"peak": np.abs(w).argmax(axis=1)}
            sign = np.where(w[pick, index["peak"]] > 0, 1.0, -1.0)
            upright = w * sign[:, None]
            index["tip"] = np.where(order <= index["peak"][:, None], upright, np.inf).argmin(axis=1)
            index["trough"] = np.where(order >= index["peak"][:, None], upright, np.inf).argmin(axis=1)
            index["recovery"] = np.minimum(index["trough"] + recovery_offset, w.shape[1] - 1)
            value = {p: w[pick, index[p]] for p in points}
            for p in points:
                out.loc[rows, f"{p}_time_idx"] = index[p]
                out.loc[rows, f"{p}_val"] = value[p]
            for name, (late, early) in slopes.items():
                steps = index[late] - index[early]
                apart = steps != 0
                rate = (value[late] - value[early])[apart] / steps[apart] * fs.to_numpy(float)[rows][apart]
                out.loc[rows[apart], name] = rate
            out.loc[rows, "invert_sign_peak"] = -sign
        return out

    return shape


def total_variation(image: np.ndarray, weight: float, max_iter: int = 200, tol: float = 2e-4) -> np.ndarray:
    """Minimise 0.5*|u-f|^2 + weight*TV(u) by dual projection (Chambolle 2004).

    Stops once that sum changes by `tol` of itself or less, or after `max_iter`
    steps; both are part of the definition.
    """
    if not weight > 0:
        return image.copy()
    step = 0.25
    dual = np.zeros((2, *image.shape))
    energy_before = None
    u = image
    for _ in range(max_iter):
        divergence = np.zeros_like(image)
        divergence[:-1] += dual[0][:-1]
        divergence[1:] -= dual[0][:-1]
        divergence[:, :-1] += dual[1][:, :-1]
        divergence[:, 1:] -= dual[1][:, :-1]
        u = image - weight * divergence
        gradient = np.zeros_like(dual)
        gradient[0][:-1] = np.diff(u, axis=0)
        gradient[1][:, :-1] = np.diff(u, axis=1)
        length = np.sqrt((gradient**2).sum(axis=0))
        energy = 0.5 * ((u - image) ** 2).sum() + weight * length.sum()
        if energy_before is not None and abs(energy_before - energy) <= tol * max(energy_before, 1e-300):
            break
        energy_before = energy
        scale = step / weight
        dual = (dual - scale * gradient) / (1.0 + scale * length)
    return u


#: Points of the plane that are placed in a triangulation at a time.
_PLACED_AT_ONCE = 256


def _least_corners(px: np.ndarray, py: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point (x, y), three sites and their weights; weight on a site number of n or more is outside the hull.

    The Delaunay triangle of a point has, of all triangles of sites around it,
    the least weighted sum of squared distances; the sums of squared site numbers
    decide between sites on one circle. That is a linear programme in three
    corners. All points start in a triangle far outside and change one corner at
    a time; corners outside count before anything else.
    """
    n = px.size
    centre_x, centre_y = (px.min() + px.max()) / 2, (py.min() + py.max()) / 2
    far = 8 * (np.hypot(np.ptp(px), np.ptp(py)) + np.hypot(x - centre_x, y - centre_y).max(initial=0.0) + 1.0)
    sx = np.concatenate([px - centre_x, far * np.array([-1.0, 1.0, 0.0])])
    sy = np.concatenate([py - centre_y, far * np.array([-1.0, -1.0, 1.0])])
    number = np.arange(n + 3, dtype=float)
    outside = (number >= n).astype(float)
    # Sites have no distance cost outside, where the first cost decides.
    costs = [outside, np.where(outside > 0, 0.0, sx**2 + sy**2), np.where(outside > 0, 0.0, number**2)]
    scales = [1.0, max(1.0, float(costs[1].max())), max(1.0, float(costs[2].max()))]
    gx, gy = x - centre_x, y - centre_y
    corner = np.tile(np.arange(n, n + 3), (x.size, 1))
    sites = np.stack([np.ones(n + 3), sx, sy])
    open_ = np.arange(x.size)
    weight = np.zeros((x.size, 3))
    for turn in range(50 * (n + 3)):
        basis = np.stack([np.ones((open_.size, 3)), sx[corner[open_]], sy[corner[open_]]], axis=1)
        inverse = np.linalg.inv(basis)
        weight[open_] = np.einsum("mij,mj->mi", inverse, np.stack([np.ones(open_.size), gx[open_], gy[open_]], axis=1))
        tied = np.ones((open_.size, n + 3), bool)
        better = np.zeros((open_.size, n + 3), bool)
        worth = np.zeros((open_.size, n + 3))
        for cost, scale in zip(costs, scales):
            plane = np.einsum("mi,mij->mj", cost[corner[open_]], inverse) @ sites
            gain = (cost[None, :] - plane) / scale
            found = tied & (gain < -1e-9)
            worth = np.where(found & ~better, gain, worth)
            better |= found
            tied &= np.abs(gain) <= 1e-9
            if better.any(axis=1).all():
                break
            better_rows = better.any(axis=1)
            tied[better_rows] = False  # a cost that can be lowered comes before the next one
        busy = better.any(axis=1)
        open_, inverse, better, worth = open_[busy], inverse[busy], better[busy], worth[busy]
        if not open_.size:
            break
        # The best change at first; later the first one, which never runs in a circle.
        enter = worth.argmin(axis=1) if turn < 4 * n + 20 else better.argmax(axis=1)
        move = np.einsum("mij,jm->mi", inverse, sites[:, enter])
        held = np.maximum(weight[open_], 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(move > 1e-12, held / move, np.inf)
        least = ratio.min(axis=1, keepdims=True)
        among = np.where(ratio <= least + 1e-12, corner[open_], n + 3)
        corner[open_, among.argmin(axis=1)] = enter
    return corner, weight


def plane_weights(px: np.ndarray, py: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sites and weights (three for each point) of linear interpolation on the Delaunay triangulation of the sites.

    Outside the hull all weight is on the nearest site, the first of equals.
    """
    sites, weights = np.zeros((x.size, 3), np.int64), np.zeros((x.size, 3))
    for a in range(0, x.size, _PLACED_AT_ONCE):
        part = slice(a, a + _PLACED_AT_ONCE)
        corner, weight = _least_corners(px, py, x[part], y[part])
        weight = np.where(np.abs(weight) < 1e-9, 0.0, weight)
        beyond = ((corner >= px.size) & (weight > 0)).any(axis=1)
        if beyond.any():
            distance = np.hypot(y[part][beyond, None] - py[None, :], x[part][beyond, None] - px[None, :])
            corner[beyond] = distance.argmin(axis=1)[:, None]
            weight[beyond] = (1.0, 0.0, 0.0)
        sites[part], weights[part] = np.where(corner >= px.size, 0, corner), weight
    return sites, weights


def fill_grid(values: np.ndarray, xs: np.ndarray, ys: np.ndarray, seen: dict | None = None) -> np.ndarray:
    """Fill NaNs of a (depth, lateral) grid over the plane.

    Places between known sites get the linear interpolation on the sites'
    triangulation, others the nearest site's value. Sites are numbered by depth,
    then lateral position. `seen` keeps the weights of a pattern of gaps for the
    next grid that has the same.
    """
    known = ~np.isnan(values)
    gaps = np.argwhere(~known)
    if not gaps.size or not known.any():
        return values.copy()
    key = known.tobytes()
    if seen is None or key not in seen:
        at = np.argwhere(known)
        found = plane_weights(xs[at[:, 1]], ys[at[:, 0]], xs[gaps[:, 1]], ys[gaps[:, 0]])
        if seen is not None:
            seen[key] = found
    else:
        found = seen[key]
    filled = values.copy()
    filled[gaps[:, 0], gaps[:, 1]] = (values[known][found[0]] * found[1]).sum(axis=1)
    return filled


def smooth_on_grid(feature: np.ndarray, x: np.ndarray, y: np.ndarray, fac: float, seen: dict | None = None) -> np.ndarray:
    """Total-variation smoothing of one feature of one probe; NaNs are filled first."""
    xs, col = np.unique(x, return_inverse=True)
    ys, row = np.unique(y, return_inverse=True)
    grid = np.full((ys.size, xs.size), np.nan)
    grid[row, col] = feature
    if np.isnan(feature).all():
        return feature
    filled = fill_grid(grid, xs, ys, seen)
    smoothed = total_variation(filled, float(np.median(np.abs(filled))) * fac)
    return smoothed[row, col]


def banded_products(channels: np.ndarray, v: np.ndarray, half_width: int) -> np.ndarray:
    """Dot products of each row with the rows 0..half_width channels further on; NaN where absent."""
    out = np.full((channels.size, half_width + 1), np.nan)
    for k in range(half_width + 1):
        at = np.searchsorted(channels, channels + k)
        ok = (at < channels.size) & (channels[np.minimum(at, channels.size - 1)] == channels + k)
        out[ok, k] = np.einsum("ij,ij->i", v[ok], v[at[ok]])
    return out


#: Log probabilities are whole numbers of this part of a nat, so that sums are the same in every order.
LOG_UNIT = 2**36
#: The score of what cannot be; sums that hold it are cut back to it.
NEVER = -(2**60)


def whole_logs(p: np.ndarray) -> np.ndarray:
    """Logarithms as whole multiples of 1/`LOG_UNIT`; `NEVER` for 0."""
    p = np.asarray(p, dtype=float)
    with np.errstate(divide="ignore"):
        logs = np.log(p)
    return np.where(p > 0, np.rint(np.where(p > 0, logs, 0.0) * LOG_UNIT), NEVER).astype(np.int64)


def _levelled(scores: np.ndarray, axes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Scores less their maximum over `axes`, and that maximum (0 where nothing is possible)."""
    top = scores.max(axis=axes, keepdims=True)
    top = np.where(top < NEVER // 2, 0, top)
    return np.where(scores < NEVER // 2, NEVER, scores - top), top


def viterbi(emission: np.ndarray, transition: np.ndarray, start: np.ndarray, observed: np.ndarray, log: bool = False):
    """Best state path of one or many observed sequences of equal length.

    observed: (..., n). start: (..., K). Returns (path, score). The first state
    wins ties. In log space scores are sums of `whole_logs`, exact in any
    order, and the score returned is a log probability.
    """
    observed = np.asarray(observed, dtype=int)
    single = observed.ndim == 1
    obs = np.atleast_2d(observed)
    runs, n = obs.shape
    if log:
        e, t, s = whole_logs(emission), whole_logs(transition), whole_logs(start)
        first = np.broadcast_to(s, (runs, e.shape[0]))
        path, score = np.empty((runs, n), dtype=np.int32), np.empty(runs)
        for i in range(0, runs, _PATHS_AT_ONCE):
            part = slice(i, i + _PATHS_AT_ONCE)
            path[part], score[part] = _log_paths(e, t, first[part], obs[part])
        return (path[0], float(score[0])) if single else (path, score)
    e, t, s = (np.asarray(a, dtype=float) for a in (emission, transition, start))
    mu = np.broadcast_to(s, (runs, e.shape[0])) * e[:, obs[:, 0]].T
    back = np.empty((n, runs, e.shape[0]), dtype=np.int32)
    for i in range(1, n):
        reach = mu[:, :, None] * t[None, :, :]
        back[i] = reach.argmax(axis=1)
        mu = reach.max(axis=1) * e[:, obs[:, i]].T
    path = np.empty((runs, n), dtype=np.int32)
    path[:, -1] = mu.argmax(axis=1)
    score = mu[np.arange(runs), path[:, -1]]
    for i in range(n - 1, 0, -1):
        path[:, i - 1] = back[i][np.arange(runs), path[:, i]]
    return (path[0], float(score[0])) if single else (path, score)


def _best_step(mu: np.ndarray, log_t: np.ndarray, floor: bool) -> tuple[np.ndarray, np.ndarray]:
    """(K, rows): the best score with which each state is reached, and the first state that gives it."""
    best = mu[0][None, :] + log_t[0][:, None]
    if floor:
        np.maximum(best, NEVER, out=best)
    source = np.zeros(best.shape, np.int16)
    for i in range(1, len(log_t)):
        reach = mu[i][None, :] + log_t[i][:, None]
        if floor:
            np.maximum(reach, NEVER, out=reach)
        np.copyto(source, i, where=reach > best)
        np.maximum(best, reach, out=best)
    return best, source


#: Steps after which scores are levelled where nothing is impossible: 16 of them stay far from the limits of 64 bits.
_LEVEL_EVERY = 16
#: Paths whose scores of one step stay in a core's cache.
_PATHS_AT_ONCE = 4096


def _possible(*scores: np.ndarray) -> bool:
    return all(x.min(initial=0) > NEVER // 2 for x in scores)


def _log_paths(log_e, log_t, log_s, obs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best paths of rows of equal length and their log probabilities.

    Only the scores of each step are kept. The walk back looks for the state
    that gave the score, for the states of the path alone.
    """
    runs, n = obs.shape
    seen = np.ascontiguousarray(obs.T)
    scores = np.empty((n, len(log_t), runs), np.int64)
    scores[0], total = _levelled(log_s.T + log_e[:, seen[0]], (0,))
    whole = _possible(log_t, log_e)
    floors = np.ones(n, bool)
    for i in range(1, n):
        mu = scores[i - 1]
        floors[i] = floors[i - 1] and not (whole and _possible(mu))
        best = mu[0][None, :] + log_t[0][:, None]
        for j in range(1, len(log_t)):
            np.maximum(best, mu[j][None, :] + log_t[j][:, None], out=best)
        if floors[i]:
            np.maximum(best, NEVER, out=best)
        best += log_e[:, seen[i]]
        if floors[i] or i % _LEVEL_EVERY == 0:
            best, top = _levelled(best, (0,))
            total = total + top
        scores[i] = best
    best = scores[-1].max(axis=0)
    path = np.empty((n, runs), np.int32)
    path[-1] = scores[-1].argmax(axis=0)
    for i in range(n - 1, 0, -1):
        reach = np.take(log_t, path[i], axis=1) + scores[i - 1]
        if floors[i]:
            np.maximum(reach, NEVER, out=reach)
        top, state = reach[0].copy(), np.zeros(runs, np.int32)
        for j in range(1, len(log_t)):
            np.copyto(state, j, where=reach[j] > top)
            np.maximum(top, reach[j], out=top)
        path[i - 1] = state
    return path.T, np.where(best < NEVER // 2, -np.inf, (best + total[0]) / LOG_UNIT)


def log_forward(log_e, log_t, log_s, obs: np.ndarray, entry: np.ndarray, fresh: np.ndarray):
    """Scores at the end, the links of each step, and what was taken off the scores, for rows of equal length.

    `entry` holds the scores before the first observation; `fresh` rows start
    from the start probabilities instead. All are whole numbers. The states come
    first inside, so that each operation runs along all rows.
    """
    runs, n = obs.shape
    seen = np.ascontiguousarray(obs.T)
    back = np.zeros((n, log_e.shape[0], runs), dtype=np.int16)
    best, source = _best_step(np.ascontiguousarray(entry.T), log_t, False)
    back[0] = np.where(fresh[None, :], 0, source)
    start = log_s.T if log_s.ndim == 2 else log_s[:, None]
    mu, total = _levelled(np.where(fresh[None, :], start, best) + log_e[:, seen[0]], (0,))
    whole, floor = _possible(log_t, log_e), True
    for i in range(1, n):
        floor = floor and not (whole and _possible(mu))
        best, back[i] = _best_step(mu, log_t, floor)
        mu = best + log_e[:, seen[i]]
        if floor or i % _LEVEL_EVERY == 0 or i == n - 1:
            mu, top = _levelled(mu, (0,))
            total = total + top
    return np.ascontiguousarray(mu.T), back.transpose(0, 2, 1), total[0]


def log_span(log_e, log_t, obs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, K, K): best scores from the state before a chunk to the state at its end, and what was taken off."""
    seen = np.ascontiguousarray(obs.T)
    m, total = _levelled(log_t[:, :, None] + log_e[:, seen[0]][None], (0, 1))
    for i in range(1, len(seen)):
        best = m[:, 0, None, :] + log_t[0][None, :, None]
        for j in range(1, len(log_t)):
            np.maximum(best, m[:, j, None, :] + log_t[j][None, :, None], out=best)
        m, top = _levelled(best + log_e[:, seen[i]][None], (0, 1))
        total = total + top
    return np.ascontiguousarray(m.transpose(2, 0, 1)), total[0, 0]


#: Numbers that a step of a chain works on at once.
_CHAIN_CELLS = 2_000_000


def max_plus(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products of each row's score matrices (rows, K, K), or vectors (rows, K) and matrices, and what was taken off."""
    rows, k = len(b), b.shape[-1]
    left = a.reshape(rows, -1, k)
    out, off = np.empty(left.shape, np.int64), np.empty(rows, np.int64)
    step = max(1, _CHAIN_CELLS // (left.shape[1] * k * k))
    for i in range(0, rows, step):
        part = slice(i, i + step)
        out[part], top = _levelled((left[part, :, :, None] + b[part, None]).max(axis=2), (1, 2))
        off[part] = top[:, 0, 0]
    return out.reshape(a.shape), off


def followers(first: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the rows that follow another one of their run, the second of every run, then the third, and so on."""
    at = np.arange(len(first))
    rank = at - np.maximum.accumulate(np.where(first, at, 0))
    order = np.argsort(rank, kind="stable")
    ends = np.cumsum(np.bincount(rank))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        yield order[a:b]


def running_products(first: np.ndarray, m: np.ndarray, off: np.ndarray, carried: tuple | None):
    """Products of each run's matrices up to each row, and what was taken off; a run may go on from `carried`."""
    total, taken = m.copy(), off.astype(float)
    if not first[0]:
        total[:1], top = max_plus(carried[0][None], m[:1])
        taken[0] += carried[1] + top[0]
    for at in followers(first):
        total[at], top = max_plus(total[at - 1], m[at])
        taken[at] += taken[at - 1] + top
    return total, taken


def running_maps(first: np.ndarray, maps: np.ndarray, carried: np.ndarray | None) -> np.ndarray:
    """Each run's maps of states put together up to each row; a run may go on from `carried`."""
    total = maps.copy()
    if not first[0]:
        total[0] = maps[0][carried]
    for at in followers(first):
        total[at] = np.take_along_axis(maps[at], total[at - 1], axis=1)
    return total


def walk_back(back: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Paths that end in `end`, and the state before the first observation."""
    n, runs, _ = back.shape
    rows = np.arange(runs)
    path = np.empty((runs, n), dtype=np.int32)
    state = end
    for i in range(n - 1, -1, -1):
        path[:, i] = state
        state = back[i][rows, state]
    return path, state
