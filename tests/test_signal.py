import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from depthline.functions import kernels as K
from depthline.operators import signal as G
from depthline.operators import spatial as X
from depthline.plans import features as J
from depthline.schemas import BANDS

NC, NS, FS = 40, 200, 500.0
LATERAL = [43.0, 11.0, 59.0, 27.0]


def layout(nc):
    i = np.arange(nc)
    return np.array(LATERAL)[i % 4], 20.0 * (i // 2)


def frame(spark, v, fs=FS, labels=None, pid="p"):
    x, y = layout(len(v))
    rows = [
        (pid, 0, i, float(x[i]), float(y[i]), fs, [float(s) for s in v[i]], None if labels is None else labels[i])
        for i in range(len(v))
    ]
    df = spark.createDataFrame(
        rows,
        "pid string, snippet int, channel int, lateral_um double, axial_um double, fs double, samples array<double>, labels int",
    )
    return df if labels is not None else df.drop("labels")


def by_channel(df, column):
    return np.array([r[column] for r in sorted(df.select("channel", column).collect(), key=lambda r: r["channel"])], dtype=float)


@pytest.fixture(scope="module")
def v():
    rng = np.random.default_rng(0)
    return np.cumsum(rng.normal(size=(NC, NS)), axis=0) + rng.normal(size=(NC, NS))


def mirrored_ratio(v, half=8):
    """Mean product with the neighbours at each offset over the own one; offsets past an end turn back there."""
    nc = len(v)
    out = []
    for c in range(nc):
        products = []
        for offset in range(-half, half + 1):
            other = abs(c + offset)
            other = min(other, 2 * (nc - 1) - other)
            if offset == 0 or other != c:
                products.append(float(np.dot(v[c], v[other])))
        out.append(np.mean(products) / float(np.dot(v[c], v[c])))
    return np.array(out)


@pytest.mark.parametrize("nc,block", [(13, 64), (40, 64), (40, 16), (33, 9)])
def test_correlation_ratio(spark, nc, block):
    v = np.random.default_rng(nc).normal(size=(nc, 50))
    df = frame(spark, v)
    cov = G.neighbour_covariance(G.banded_covariance(df, block=block))
    own = F.max(F.when(F.col("channel") == F.col("neighbour"), F.col("cov")))
    ratio = cov.groupBy("channel").agg((F.sum(F.col("cov") * F.col("multiplicity")) / F.sum("multiplicity") / own).alias("r"))
    assert np.allclose(by_channel(ratio, "r"), mirrored_ratio(v))
    assert np.allclose(by_channel(G.correlation_ratio(df), "cor_ratio"), mirrored_ratio(v))


def test_identical_channels_have_ratio_one_and_few_channels_none(spark):
    same = np.tile(np.random.default_rng(1).normal(size=30), (20, 1))
    assert np.allclose(by_channel(G.correlation_ratio(frame(spark, same)), "cor_ratio"), 1.0)
    few = G.correlation_ratio(frame(spark, same[:12]))
    assert few.filter("cor_ratio IS NOT NULL").count() == 0


def test_covariance_over_chunks_is_the_covariance_of_the_whole(spark, v):
    parts = None
    for c in range(4):
        piece = frame(spark, v[:, c * 50 : (c + 1) * 50]).withColumn("chunk", F.lit(c))
        parts = piece if parts is None else parts.unionByName(piece)
    whole = by_channel(G.correlation_ratio(frame(spark, v)), "cor_ratio")
    assert np.allclose(by_channel(G.correlation_ratio(parts, parts=("chunk",)), "cor_ratio"), whole)
    rms = G.rms_over_chunks(parts, ["channel"])
    assert np.allclose(by_channel(rms, "rms"), np.sqrt((v**2).mean(axis=1)))


def test_parseval_and_rms(spark, v):
    df = frame(spark, v)
    total = G.spectrum(df).groupBy("channel").agg((F.sum("density") * FS / NS).alias("power"))
    assert np.allclose(by_channel(total, "power"), v.var(axis=1))
    assert np.allclose(by_channel(G.lf_features(df), "rms_lf"), np.sqrt((v**2).mean(axis=1)))


def test_band_power_of_a_tone_and_custom_bands(spark):
    t = np.arange(1000) / 500.0
    tone = np.sin(2 * np.pi * 10 * t)[None, :]
    out = G.lf_features(frame(spark, tone), {"low": (8.0, 12.0), "high": (100.0, 120.0)}).first()
    assert out["psd_low"] > out["psd_high"] + 40
    assert set(G.lf_features(frame(spark, tone)).columns) >= {f"psd_{b}" for b in BANDS}


@pytest.mark.parametrize("q", [2, 5, 10])
def test_decimation_equals_direct_sum(spark, v, q):
    got = G.decimate(frame(spark, v[:2]), q).orderBy("channel").collect()
    taps, half = K.low_pass(q), 10 * q
    assert taps.sum() == pytest.approx(1.0)
    for row, x in zip(got, v):
        want = [
            sum(taps[m + half] * x[k * q - m] for m in range(-half, half + 1) if 0 <= k * q - m < NS) for k in range(-(-NS // q))
        ]
        assert np.allclose(row["samples"], want)


def test_source_density_of_a_parabola(spark):
    x, y = layout(NC)
    v = np.repeat((3.0 * y**2)[:, None], 4, axis=1)
    got = G.current_source_density(frame(spark, v)).collect()
    assert all(np.allclose(r["samples"], 6.0 / 3.0) for r in got)


def test_csd_rate_and_compat(spark, v):
    df = frame(spark, v)
    a, b = (G.csd_features(df, q=2, compat=c) for c in (False, True))
    assert np.allclose(by_channel(a, "rms_lf_csd"), by_channel(b, "rms_lf_csd"))
    assert not np.allclose(by_channel(a, "psd_delta_csd"), by_channel(b, "psd_delta_csd"))


def test_quality_labels(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(30, 1)) * 0 + np.cumsum(rng.normal(size=(1, 400)), axis=1) + 0.05 * rng.normal(size=(30, 400))
    v[3] *= 0.001  # dead
    v[7] = v[7] * 20  # loud
    v[11] = np.where(np.arange(400) % 2, 30.0, -30.0)  # all at Nyquist
    v[27:] = rng.normal(size=(3, 400)).cumsum(axis=1) * np.array([[1.0], [-1.0], [1.0]])
    labels = by_channel(G.quality_labels(frame(spark, v)), "labels")
    assert labels[3] == 1 and labels[7] == 2 and labels[11] == 2
    cov = v @ v.T
    run = True
    for c in range(29, -1, -1):
        run = run and c > 0 and cov[c, c - 1] / cov[c, c] < 0.1
        if labels[c] in (0, 3):
            assert (labels[c] == 3) == run


def test_destripe_against_numpy(spark, v):
    labels = [0] * NC
    labels[5], labels[6], labels[20] = 1, 2, None
    got = {r["channel"]: np.array(r["samples"]) for r in G.destripe(frame(spark, v, labels=labels)).collect()}
    x, y = layout(NC)
    filled = v.copy()
    for b in (5, 6, 20):
        d = np.hypot(x - x[b], y - y[b])
        near = [g for g in range(NC) if labels[g] == 0 and 0 < d[g] <= 60]
        filled[b] = sum(v[g] / d[g] for g in near) / sum(1 / d[g] for g in near)
    want = filled - np.median(filled, axis=0)
    assert np.allclose(np.stack([got[c] for c in range(NC)]), want)


def test_bad_channel_without_neighbours_keeps_its_trace(spark, v):
    labels = [1] * NC
    got = G.fill_bad_channels(frame(spark, v, labels=labels))
    assert np.allclose(np.stack([r["samples"] for r in got.orderBy("channel").collect()]), v)


def planted(rng):
    v = 0.01 * rng.normal(size=(NC, 600))
    shape = np.array([0.2, -1.0, 0.5, 0.1])
    for channel, at, size in ((10, 100, 1.0), (30, 300, 2.0), (12, 400, 1.5), (2, 590, 1.0)):
        v[channel, at : at + 4] += size * shape
        v[channel + 1, at : at + 4] += 0.5 * size * shape
    return v


def test_events_are_found_once_and_located(spark):
    v = planted(np.random.default_rng(9))
    events, waveforms = G.detect_events(frame(spark, v), threshold=8.0, radius_um=60.0, reach=10, before=20, length=50)
    found = {(r["channel"], r["sample"]): r for r in events.collect()}
    assert set(found) == {(10, 101), (30, 301), (12, 401), (2, 591)}
    x, y = layout(NC)
    for (channel, sample), r in found.items():
        assert len(r["waveform"]) == 50
        assert r["alpha"] == r["ptp"] > 0
        assert abs(r["yloc"] - y[channel]) < 30 and r["zloc"] == 0.0
    near = waveforms.filter("channel = 10 AND sample = 101").collect()
    assert {r["neighbour"] for r in near} == set(np.flatnonzero(np.hypot(x - x[10], y - y[10]) <= 60).tolist())
    padded = waveforms.filter("channel = 2 AND neighbour = 2").first()["waveform"]
    assert padded[-1] == 0.0 and np.allclose(padded[:29], v[2, 571:600])


def test_one_feature_row_per_channel_with_events(spark):
    v = planted(np.random.default_rng(9))
    out = G.waveform_features(frame(spark, v), FS, before=20, threshold=8.0, radius_um=60.0, reach=10, length=50)
    rows = {r["channel"]: r for r in out.collect()}
    assert set(rows) == {2, 10, 12, 30}
    r = rows[30]
    assert r["spike_count"] == 1 and r["polarity"] == -1.0 and r["peak_time_secs"] == 0.0
    assert r["trough_time_secs"] == pytest.approx(1 / FS) and r["peak_val"] == pytest.approx(-2.0, abs=0.1)


def test_waveform_shape_of_a_known_waveform(spark):
    from depthline.functions import arrays as A

    df = spark.createDataFrame([([0.0, 1.0, -4.0, 2.0, 0.5],), ([0.0, 0.0, 3.0, 3.0, -1.0],), ([5.0],)], "w array<double>")
    a, b, c = (r["s"] for r in df.select(A.waveform_shape("w", 10.0, 1).alias("s")).collect())
    assert (a["peak_time_idx"], a["tip_time_idx"], a["trough_time_idx"], a["recovery_time_idx"]) == (2, 1, 3, 4)
    assert (a["peak_val"], a["trough_val"], a["recovery_val"], a["invert_sign_peak"]) == (-4.0, 2.0, 0.5, 1.0)
    assert a["depolarisation_slope"] == -50.0 and a["repolarisation_slope"] == 60.0 and a["recovery_slope"] == -15.0
    assert b["peak_time_idx"] == 2 and b["tip_time_idx"] == 0 and b["trough_time_idx"] == 4 and b["invert_sign_peak"] == -1.0
    assert c["depolarisation_slope"] is None and c["recovery_time_idx"] == 0


def test_total_variation_invariants():
    flat = np.full((6, 4), 3.0)
    assert np.allclose(K.total_variation(flat, 2.0), flat)
    rng = np.random.default_rng(0)
    f = np.where(np.arange(30)[:, None] < 15, 0.0, 5.0) + rng.normal(size=(30, 4))
    u = K.total_variation(f, 1.0)
    assert u.mean() == pytest.approx(f.mean())

    def objective(w):
        g = np.zeros((2, *w.shape))
        g[0][:-1], g[1][:, :-1] = np.diff(w, axis=0), np.diff(w, axis=1)
        return 0.5 * ((w - f) ** 2).sum() + np.sqrt((g**2).sum(axis=0)).sum()

    assert objective(u) < objective(f)
    long_run = K.total_variation(f, 1.0, max_iter=20_000, tol=0.0)
    assert objective(u) <= objective(long_run) * 1.02
    for _ in range(50):
        assert objective(long_run) <= objective(long_run + 0.05 * rng.normal(size=f.shape))
    assert np.array_equal(K.total_variation(f, 0.0), f)


def test_denoise_fills_bad_channels_and_keeps_other_columns(spark):
    v = np.ones((NC, 4))
    labels = [0] * NC
    labels[4] = 1
    df = frame(spark, v, labels=labels).withColumns(
        {"rms_ap": F.when(F.col("channel") == 4, 999.0).otherwise(2.0), "spike_count": F.lit(3).cast("long"), "keep": F.col("channel")}
    )
    out = X.denoise_features(df).orderBy("channel").collect()
    assert np.allclose([r["rms_ap"] for r in out], 2.0)
    assert np.allclose([r["spike_count"] for r in out], 3.0)
    assert [r["keep"] for r in out] == list(range(NC))


def plainly_placed(px, py, x, y):
    """Weights of one point by trying all triangles: least weighted squared distance, then least squared numbers."""
    best = None
    for i, j, k in itertools.combinations(range(px.size), 3):
        whole = (px[j] - px[i]) * (py[k] - py[i]) - (px[k] - px[i]) * (py[j] - py[i])
        if whole == 0:
            continue
        a = ((px[j] - x) * (py[k] - y) - (px[k] - x) * (py[j] - y)) / whole
        b = ((px[k] - x) * (py[i] - y) - (px[i] - x) * (py[k] - y)) / whole
        w = np.array([a, b, 1 - a - b])
        if w.min() < -1e-12:
            continue
        at = np.array([i, j, k])
        key = (round(w @ ((px[at] - x) ** 2 + (py[at] - y) ** 2), 6), round(w @ at**2, 6))
        if best is None or key < best[0]:
            best = key, at, w
    if best is None:
        return np.array([np.hypot(py - y, px - x).argmin()]), np.ones(1)
    return best[1], best[2]


@pytest.mark.parametrize("seed", range(6))
def test_gaps_of_the_plane_against_all_triangles(seed):
    rng = np.random.default_rng(seed)
    x, y = layout(24) if seed % 2 else (np.tile([0.0, 16.0, 32.0], 8), np.repeat(np.arange(8) * 20.0, 3))
    keep = rng.random(24) < 0.6
    order = np.lexsort((x[keep], y[keep]))
    px, py, value = x[keep][order], y[keep][order], rng.normal(size=keep.sum())
    gx, gy = (g.ravel() for g in np.meshgrid(np.unique(x), np.unique(y)))
    sites, weights = K.plane_weights(px, py, gx, gy)
    for got, w, at in zip(sites, weights, zip(gx, gy)):
        want, v = plainly_placed(px, py, *at)
        assert value[got] @ w == pytest.approx(value[want] @ v, abs=1e-9)


def test_gaps_by_hand():
    # The point lies in the triangle of (0, 0), (4, 0) and (0, 4): 1/2, 1/4, 1/4.
    sites, weights = K.plane_weights(np.array([0.0, 4.0, 0.0]), np.array([0.0, 0.0, 4.0]), np.array([1.0, 9.0]), np.array([1.0, 1.0]))
    assert np.array([10.0, 20.0, 40.0])[sites[0]] @ weights[0] == pytest.approx(20.0)
    assert sites[1, weights[1] > 0].tolist() == [1]  # outside: the nearest
    line, w = K.plane_weights(np.zeros(3), np.array([0.0, 20.0, 40.0]), np.array([0.0, 5.0]), np.array([15.0, 39.0]))
    assert np.array([0.0, 4.0, 9.0])[line[0]] @ w[0] == pytest.approx(3.0)  # sites on one line
    assert line[1, w[1] > 0].tolist() == [2]
    assert np.isnan(K.fill_grid(np.full((2, 2), np.nan), np.arange(2.0), np.arange(2.0))).all()


def test_radius_neighbours_against_brute_force(spark):
    sites = frame(spark, np.ones((NC, 2)))
    x, y = layout(NC)
    for r in X.radius_neighbours(sites, 45.0).collect():
        assert r["neighbours"] == np.flatnonzero(np.hypot(x - x[r["channel"]], y - y[r["channel"]]) <= 45.0).tolist()
        assert r["coordinates"][0][2] == 0.0


def test_features_from_raw_traces(spark, v, tmp_path):
    ap = lf = frame(spark, v)
    detection = {"threshold": 3.0, "radius_um": 60.0, "reach": 5, "length": 40}
    out = J.compute_features(ap, lf, ["lf", "ap"], store=str(tmp_path / "s"), detection=detection, fs_ap=FS)
    assert out.count() == NC and {"rms_lf", "psd_lfp", "rms_ap", "cor_ratio"} <= set(out.columns)
    later = J.compute_features(ap, lf, ["waveforms"], store=str(tmp_path / "s"), detection=detection, fs_ap=FS, before=10)
    assert later.count() == NC and {"rms_lf", "cor_ratio", "spike_count"} <= set(later.columns)
    stamped = spark.read.parquet(str(tmp_path / "s" / "lf_features.parquet"))
    assert stamped.filter("features_version IS NULL OR package_version IS NULL").count() == 0
    with pytest.raises(ValueError):
        J.compute_features(ap, lf, ["nope"])
    with pytest.raises(ValueError):
        G.ap_features(ap.drop("axial_um"))
    labels = G.quality_labels(ap)
    bad = [r["channel"] for r in labels.filter("labels <> 0").collect()]
    x, y = layout(NC)
    filled = v.copy()
    for b in bad:
        d = np.hypot(x - x[b], y - y[b])
        near = [g for g in range(NC) if g not in bad and 0 < d[g] <= 60]
        if near:
            filled[b] = sum(v[g] / d[g] for g in near) / sum(1 / d[g] for g in near)
    clean = filled - np.median(filled, axis=0)
    assert np.allclose(by_channel(out, "rms_ap"), np.sqrt((clean**2).mean(axis=1)))


def test_unfit_recordings(spark, v):
    ap = frame(spark, v)
    assert J.unfit_recordings(ap, ap).count() == 0
    assert J.unfit_recordings(ap, ap.filter("channel < 10")).count() == 1
    assert J.unfit_recordings(ap.withColumn("fs", F.lit(0.0)), ap).count() == 1
    assert J.unfit_recordings(ap.withColumn("axial_um", F.lit(None).cast("double")), ap).count() == 1
