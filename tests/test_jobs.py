import numpy as np
import pytest
from pyspark.sql import functions as F

from depthline.operators import learn as L
from depthline.plans import features as F_
from depthline.plans import jobs
from depthline.plans import recordings as whole_plans
from depthline.sources import sinks, store

NC = 20


@pytest.fixture(scope="module")
def traces(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    rng = np.random.default_rng(0)
    out = None
    for pid, seconds in (("a", 3), ("b", 2)):
        for band, fs in (("ap", 300), ("lf", 100)):
            path = root / f"{pid}.{band}.bin"
            rng.integers(-200, 200, (fs * seconds, NC + 1)).astype("<i2").tofile(path)
            one = store.read_flat_recording(spark, str(path), pid, band, float(fs), NC + 1, 1, chunk_samples=64)
            out = one if out is None else out.unionByName(one)
    path = str(root / "traces")
    out.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def channels(spark):
    rows = [(p, i, float((43, 11, 59, 27)[i % 4]), 20.0 * (i // 2)) for p in "ab" for i in range(NC)]
    return spark.createDataFrame(rows, "pid string, channel int, lateral_um double, axial_um double")


SIZES = {"ap": 64, "lf": 64}


def test_windows_of_a_table_equal_literal_windows(spark, traces):
    ap = traces.filter("band = 'ap'")
    windows = spark.createDataFrame([("a", 0, 0.5, 1.0), ("a", 1, 1.2, 0.3), ("b", 0, 0.5, 1.0)], "pid string, snippet int, t_start double, duration double")
    got = {(r["pid"], r["snippet"], r["channel"]): r["samples"] for r in store.time_windows(ap, windows, 64, 3).collect()}
    for snippet, t, d in ((0, 0.5, 1.0), (1, 1.2, 0.3)):
        for r in store.time_window(ap.filter("pid = 'a'"), 300.0, t, d, 64, 3).collect():
            assert got[("a", snippet, r["channel"])] == r["samples"]
    assert len(got) == 3 * NC


def test_whole_recordings_equal_one_window(spark, traces, channels):
    """Frames with halos add up to what one window over the whole recording gives, labels and destriping included."""
    ap, lf = (traces.filter(f"band = '{b}'") for b in ("ap", "lf"))
    rows = [(p, b, fs * n, float(fs), NC + 1, 1) for p, n in (("a", 3), ("b", 2)) for b, fs in (("ap", 300), ("lf", 100))]
    recordings = spark.createDataFrame(rows, "pid string, band string, ns long, fs double, nc int, nsync int")
    detection = {"threshold": 3.0, "radius_um": 60.0, "reach": 5, "length": 40}
    common = dict(chunk_samples=SIZES, lf_latency=0, q=2, fs_ap=300.0, before=10, detection=detection)
    whole = F_.compute_windows(ap, lf, recordings, channels, frame_samples={"ap": 70, "lf": 40}, **common)
    got = {(r["pid"], r["channel"]): r for r in whole.collect()}
    one = F_.compute_windows(ap, lf, recordings, channels, frame_samples={"ap": 10_000, "lf": 10_000}, **common)
    single = {(r["pid"], r["channel"]): r for r in one.collect()}
    window = F_.compute_windows(ap, lf, recordings.filter("pid = 'b'"), channels.filter("pid = 'b'"), duration=2.0, **common)
    cut = {(r["pid"], r["channel"]): r for r in window.collect()}

    def same(x, y):
        return x is y is None or x == pytest.approx(y, rel=1e-9, abs=1e-12)

    assert len(got) == len(single) == 2 * NC
    for key, r in got.items():
        for name in r.asDict():
            if name.startswith("psd"):
                assert r[name] is not None
            elif name not in ("pid", "snippet", "channel"):
                assert same(r[name], single[key][name]), (key, name)
    for key, r in cut.items():  # one frame is one window, spectra included
        for name in set(r.asDict()) - {"pid", "snippet", "channel"}:
            assert same(single[key][name], r[name]), (key, name)
    framed = whole_plans.frames(ap, recordings.filter("band = 'ap'").selectExpr("pid", "0.1D t_start", "ns / fs - 0.1 duration"), 70, 25)
    rows = framed.selectExpr("pid", "channel", "frame", "lead", "core", "size(samples) n").collect()
    assert max(r["n"] for r in rows) < 2 * 70 + 2 * 25 and {r["lead"] for r in rows} == {0, 25}
    assert sum(r["core"] for r in rows) == NC * (870 + 570)


def test_recordings_to_regions(spark, traces, channels, tmp_path):
    root = str(tmp_path / "out")
    tracks = spark.createDataFrame(
        [(p, "Planned", 0, 1.0, 2.0, 3.0, 4000.0, 10.0, 20.0) for p in "ab"],
        "pid string, provenance string, pos int, x double, y double, z double, depth double, theta double, phi double",
    )
    features = jobs.run(
        spark, "features", root, traces, channels, t_start=0.1, trajectories=tracks, requested=["lf", "ap", "csd"], chunk_samples=SIZES, q=2
    )
    assert features.count() == 2 * NC
    assert {"rms_lf", "psd_lfp_csd", "cor_ratio"} <= set(features.columns)
    stored = spark.read.parquet(f"{root}/channels.parquet")
    assert stored.count() == 2 * NC and "z_target" in stored.columns
    with pytest.raises(ValueError):
        jobs.run(spark, "inference", root)
    with pytest.raises(ValueError):
        jobs.run(spark, "nothing", root)
    with pytest.raises(ValueError):
        jobs.run(spark, "features", root)
    with pytest.raises(ValueError):
        jobs.recording_features(traces, channels, root, 0.0, 60.0, chunk_samples=SIZES)

    rows = spark.read.parquet(f"{root}/features.parquet").withColumns({"fold": F.col("channel") % 5, "region": F.col("channel") % 2 + 7})
    trained = L.train_folds(rows, ["rms_lf", "rms_ap"], "region", ["pid", "channel"], trees=3, depth=2)
    meta = {**trained.meta, "VINTAGE": "v", "REGION_MAP": "Cosmos"}
    for i, model in enumerate(trained.models):
        sinks.save_model(spark, str(tmp_path / "models"), model, meta, sinks.fold_name(i), "fixed")
    found = jobs.run(spark, "inference", root, channels=channels, model_root=str(tmp_path / "models" / "v_Cosmos_fixed"))
    assert found.count() == 5 * 2 * NC * 2
    profile = jobs.probability_profile(found, channels, [7, 8])
    assert profile["entropy"].count() == 5 * 2 * NC and profile["mean_entropy"].count() == 2 * NC
    top = profile["cumulative"].filter("class_id = 8").agg(F.min("cumulative"), F.max("cumulative")).first()
    assert top[0] == pytest.approx(1.0) and top[1] == pytest.approx(1.0)


def test_stored_sets_of_other_probes_and_windows_stay(spark, traces, channels, tmp_path):
    from depthline.plans import features as J

    root = str(tmp_path / "store")
    one = lambda pid, t, sets: jobs.recording_features(
        traces.filter(F.col("pid") == pid), channels.filter(F.col("pid") == pid), root, t, 0.5, requested=sets, chunk_samples=SIZES, q=2
    )
    one("a", 0.1, ["lf"]).count()
    one("b", 0.1, ["lf"]).count()
    one("a", 0.9, ["lf"]).count()
    stored = lambda: sorted(map(str, sinks.read_features(spark, root, "lf").collect()))
    before = stored()
    assert len(before) == 3 * NC
    out = one("a", 0.1, ["ap"])
    rows = out.select("pid", "snippet").distinct().collect()
    assert [(r["pid"], r["snippet"]) for r in rows] == [("a", J.window_number(0.1, 0.5))]
    assert out.filter("rms_lf is not null and rms_ap is not null").count() == NC and stored() == before
    one("a", 0.1, ["lf"]).count()  # again: nothing is doubled
    assert len(stored()) == 3 * NC
