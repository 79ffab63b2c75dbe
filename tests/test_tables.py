import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depthline import schemas as S
from depthline.functions import columns as C
from depthline.operators import anatomy as B
from depthline.operators import relational as R
from depthline.plans import features as J
from depthline.plans import tables as P


def test_feature_set_sizes_and_order():
    assert len(S.feature_columns("all")) == 33
    assert S.feature_columns(["raw_ap"]) == ["rms_ap", "cor_ratio"]
    assert len(S.feature_columns()) == 23
    assert S.feature_columns(["localisation", "unknown"]) == []


def test_requested_sets():
    assert S.checked_sets(None) == ["lf", "csd", "ap", "waveforms"]
    assert S.checked_sets(["ap", "lf"]) == ["lf", "ap"]
    with pytest.raises(ValueError):
        S.checked_sets(["lf", "nope"])


KEYS = [
    ("test_pid", None, 300.0, 5.0, "test_pid", "probe_test_pid_000300.0_05.0"),
    (None, "/path/to/test_ap.cbin", 100.5, 25.0, None, "probe_None_000100.5_25.0"),
    ("test_pid", None, 123.456, 7.89, "test_pid", "probe_test_pid_000123.5_07.9"),
    ("test_pid", None, 0.0, 100.0, "test_pid", "probe_test_pid_000000.0_100.0"),
    ("test_pid", None, 0.0, 0.0, "test_pid", "probe_test_pid_000000.0_00.0"),
    ("test_pid", None, 999999.9, 9999.9, "test_pid", "probe_test_pid_999999.9_9999.9"),
]


def test_output_keys(spark):
    import hashlib

    df = spark.createDataFrame([k[:4] for k in KEYS], "pid string, path string, t double, d double")
    rows = df.select(C.probe_key("pid", "path").alias("p"), C.snippet_key("pid", "t", "d").alias("s")).collect()
    for row, (*_, probe, snippet) in zip(rows, KEYS):
        assert row["s"] == snippet
        assert row["p"] == (probe or hashlib.md5(b"test_ap.cbin").hexdigest()[:12])


def test_scalar_functions(spark):
    df = spark.createDataFrame([(0.0, 2.0, 0.0), (100.0, -4.0, 2.0)], "a double, b double, c double")
    rows = df.select(
        C.power_db("a").alias("db"), C.amplitude_db("a").alias("amp"), C.entropy_term("a").alias("h"), C.ratio("b", "c").alias("r"),
        C.sample_index(F.lit(2500.0), F.lit(0.0005), 3).alias("i"), C.next_fast_length(F.lit(7)).alias("n7"),
        C.next_fast_length(F.lit(1)).alias("n1"), C.next_fast_length(F.lit(1000)).alias("n1000"),
        C.next_fast_length(F.lit(257)).alias("n257"),
    ).collect()
    assert rows[0]["db"] is None and rows[0]["h"] == 0.0 and rows[0]["r"] is None
    assert rows[1]["db"] == 20.0 and rows[1]["amp"] == 40.0 and rows[1]["r"] == 2.0
    assert rows[0]["i"] == 4
    assert (rows[0]["n7"], rows[0]["n1"], rows[0]["n1000"], rows[0]["n257"]) == (8, 1, 1000, 270)


def test_next_fast_length_everywhere(spark):
    from depthline.sources.store import fast_length

    n = spark.range(1, 3000).select("id", C.next_fast_length("id").alias("m")).collect()
    assert all(r["m"] == fast_length(r["id"]) for r in n)


def test_taper_is_the_kernel_of_the_spectrum(spark):
    from depthline.functions.kernels import band_weights

    f = np.fft.rfftfreq(500, 1 / 500.0)
    df = spark.createDataFrame([(float(x),) for x in f], "f double")
    for low, high in S.BANDS.values():
        w = np.array([r["w"] for r in df.select(C.band_weight("f", low, high).alias("w")).collect()])
        assert np.allclose(w / w.sum(), band_weights(500, 500.0, {"x": (low, high)})[:, 0])


def test_tilt_without_tilt_is_identity(spark):
    df = spark.createDataFrame([(10.0, 30.0), (80.0, -120.0)], "t double, p double")
    t, p = C.tilted_angles("t", "p", 0.0)
    for r in df.select("t", "p", t.alias("t2"), p.alias("p2")).collect():
        assert r["t2"] == pytest.approx(r["t"]) and r["p2"] == pytest.approx(r["p"])


def test_schema_violations_and_coercion(spark):
    df = spark.createDataFrame([("0", "1.5", "0.1"), ("1", "x", None), ("2", "3", "nan")], "channel string, rms_ap string, cor_ratio string")
    bad = {r["column"]: r["n_bad"] for r in S.violations(df, S.AP_SCHEMA).collect()}
    assert bad == {"rms_ap": 1, "cor_ratio": 2}
    with pytest.raises(ValueError):
        S.validate(df, S.AP_SCHEMA)
    good = S.validate(df.filter("channel = '0'"), S.AP_SCHEMA)
    assert good.schema["rms_ap"].dataType == T.DoubleType() and good.first()["rms_ap"] == 1.5
    with pytest.raises(ValueError):
        S.validate(df.drop("rms_ap"), S.AP_SCHEMA)


def test_verify_tables(spark):
    keyed = spark.createDataFrame([("a", 1), ("a", 2)], "pid string, channel int")
    S.verify_tables(keyed, keyed)
    with pytest.raises(ValueError):
        S.verify_tables(keyed.unionByName(keyed), keyed)
    with pytest.raises(ValueError):
        S.verify_tables(keyed, keyed.drop("channel"))


def _random_table(names, firsts, n, key, rng):
    out = {c: rng.normal(size=n) for c in names}
    for c in firsts:
        out[c] = [None if rng.random() < 0.3 else f"{c}{i}" if c != "atlas_id" else i for i in range(n)]
    out["pid"] = rng.choice(["a", "b"], n)
    out[key] = np.arange(n)
    return pd.DataFrame(out)


def test_depth_table_against_pandas(spark):
    rng = np.random.default_rng(0)
    position = ["x", "y", "z"]
    raw = _random_table([c for c in P.RAW_MEANS if c not in position], ["histology"], 60, "channel", rng)
    raw.loc[3:9, "rms_ap"] = np.nan
    channels = _random_table([*position], ["acronym", "atlas_id"], 60, "channel", rng)
    channels["pid"] = raw["pid"]
    channels["axial_um"] = 20.0 * (np.arange(60) // 4)
    clusters = _random_table(P.CLUSTER_MEANS, P.CLUSTER_FIRSTS, 80, "cluster_id", rng)
    clusters["axial_um"] = 20.0 * rng.integers(0, 18, 80)
    frames = [spark.createDataFrame(d.astype(object).where(d.notna(), None), _schema(d)) for d in (raw, clusters, channels)]
    got = P.depth_table(*frames)
    measures = [c for c in got.columns if c not in ("pid", "axial_um")]
    assert len(measures) == 46
    got = got.toPandas().set_index(["pid", "axial_um"]).sort_index()
    left = raw.merge(channels, on=["pid", "channel"]).sort_values("channel").groupby(["pid", "axial_um"])
    right = clusters.sort_values("cluster_id").groupby(["pid", "axial_um"])
    want_left = left.agg({**{c: "mean" for c in P.RAW_MEANS}, **{c: "first" for c in P.RAW_FIRSTS}})
    want_right = right.agg({**{c: "mean" for c in P.CLUSTER_MEANS}, **{c: "first" for c in P.CLUSTER_FIRSTS}})
    want = want_left.join(want_right, how="inner", lsuffix="_raw", rsuffix="_cluster").sort_index()
    assert list(got.index) == list(want.index)
    for c in measures:
        if want[c].dtype == object:
            assert [x if isinstance(x, str) else None for x in got[c]] == [x if isinstance(x, str) else None for x in want[c]]
        else:
            assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True)


def _schema(d):
    kinds = {"pid": "string", "channel": "int", "cluster_id": "bigint", "atlas_id": "bigint"}
    return ", ".join(
        f"{c} {kinds.get(c) or ('string' if d[c].dtype == object else 'double')}" for c in d.columns
    )


REGIONS = [(1, "A"), (2, "B"), (10, "root"), (11, "X"), (997, "void")]
MAPS = [(1, "Cosmos", 11), (2, "Cosmos", 10), (3, "Cosmos", 997), (1, "Beryl", 1), (2, "Beryl", 2)]


def test_modelling_and_voltage_tables(spark):
    regions = spark.createDataFrame(REGIONS, "id bigint, acronym string")
    maps = spark.createDataFrame(MAPS, "source_id bigint, mapping string, target_id bigint")
    columns = "pid string, channel int, rms_ap double, rms_lf double, spike_count bigint, peak_val double, trough_val double, peak_time_secs double, trough_time_secs double"
    voltage = spark.createDataFrame(
        [("p", 0, 10.0, 100.0, 9, -4.0, 2.0, 0.1, 0.3), ("p", 1, 1.0, 1.0, 0, 1.0, 0.0, 0.0, 0.0), ("p", 2, float("inf"), 1.0, 0, 1.0, 1.0, 0.0, 0.0), ("p", 3, 1.0, 1.0, 0, 1.0, 1.0, 0.0, 0.0)],
        columns,
    )
    channels = spark.createDataFrame([("p", 0, 1, "A"), ("p", 1, 1, "A"), ("p", 2, 1, "A"), ("p", 3, 2, "B")], "pid string, channel int, atlas_id bigint, acronym string")
    rows = {r["channel"]: r for r in P.modelling_table(voltage, channels, maps, regions).collect()}
    assert set(rows) == {0, 1, 2}
    assert (rows[0]["rms_ap"], rows[0]["rms_lf"], rows[0]["spike_count_log"]) == (20.0, 40.0, 1.0)
    assert rows[0]["peak_to_trough_ratio"] == 2.0 and rows[0]["peak_to_trough_duration"] == pytest.approx(0.2)
    assert rows[1]["peak_to_trough_ratio"] is None and rows[0]["cosmos_id"] == 11 and rows[0]["beryl_id"] == 1
    table = P.voltage_table(voltage, channels, maps, regions)
    assert {r["channel"]: r["Cosmos_acronym"] for r in table.collect()} == {0: "X", 1: "X", 3: "root"}
    assert "Allen_id" in P.voltage_table(voltage, channels, maps, regions, "Allen").columns
    with pytest.raises(ValueError):
        P.voltage_table(voltage, channels, maps, regions, "Other")


def test_mode_ties_and_top_class(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("a", 2), ("a", 1), ("b", 3)], "k string, s int")
    assert {(r["k"], r["state"], r["n"]) for r in R.modes(df, ["k"], "s").collect()} == {("a", 1, 2), ("b", 3, 1)}
    p = spark.createDataFrame([("a", 0, 0.4), ("a", 1, 0.4), ("a", 2, 0.2)], "k string, c int, p double")
    assert R.top_class(p, ["k"], "c", "p", "top").first()["top"] == 0


def test_confusion_rows_sum_to_one_and_are_filled(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "t int, p int")
    got = {(r["t"], r["p"]): (r["n"], r["share"]) for r in R.confusion_matrix(df, "t", "p", [0, 1, 2]).collect()}
    assert len(got) == 9 and got[(0, 1)] == (1, 0.5) and got[(1, 0)] == (0, 0.0)
    assert got[(2, 0)] == (0, None)


def test_cumulative_shares_end_at_one(spark):
    df = spark.createDataFrame([("a", "x", 0.25), ("a", "z", 0.75)], "k string, c string, p double")
    rows = sorted(map(tuple, R.cumulative_share(df, ["k"], "c", "p", ["x", "y", "z"], "cum").collect()))
    assert rows == [("a", "x", 0.25, 0.25), ("a", "y", 0.0, 0.25), ("a", "z", 0.75, 1.0)]
    assert R.mean_entropy(df, ["k"], "p", 3).first()["entropy"] == pytest.approx((0.5 + 0.75 * np.log2(4 / 3)) / 3)


def test_sorting_places_nan(spark):
    df = spark.createDataFrame([(2.0,), (float("nan"),), (1.0,)], "v double")
    assert [r["v"] for r in R.sorted_features(df, "v").collect()][:2] == [1.0, 2.0]
    assert np.isnan(R.sorted_features(df, "v", ascending=False).first()["v"])


def test_target_coordinates(spark):
    track = [("p", "Planned", 0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0), ("p", "Micro-manipulator", 1, 1000.0, 2000.0, 3000.0, 4000.0, 0.0, 0.0)]
    tracks = spark.createDataFrame(track, "pid string, provenance string, pos int, x double, y double, z double, depth double, theta double, phi double")
    channels = spark.createDataFrame([("p", i, float(d)) for i, d in enumerate(np.linspace(0, 1000, 10))], "pid string, channel int, axial_um double")
    rows = sorted(J.add_target_coordinates(channels, tracks, tilt_deg=0.0).collect(), key=lambda r: r["channel"])
    assert len(rows) == 10
    assert [r["z_target"] for r in rows] == pytest.approx([-1000.0 + d for d in np.linspace(0, 1000, 10)])
    assert all(r["x_target"] == pytest.approx(1000.0) and r["y_target"] == pytest.approx(2000.0) for r in rows)
    tilted = J.add_target_coordinates(channels, tracks).filter("channel = 0").first()
    assert tilted["y_target"] != pytest.approx(2000.0)
    framed = J.add_target_coordinates(channels, tracks, tilt_deg=0.0, frame={"z": (1.0, 0.0, -500.0, 500.0)})
    assert framed.filter("channel = 0").first()["z_target"] == -500.0
    with pytest.raises(ValueError):
        J.add_target_coordinates(channels.drop("axial_um"), tracks)
    with pytest.raises(ValueError):
        J.add_target_coordinates(channels, tracks.drop("theta"))


def test_default_channel_ids(spark):
    df = spark.createDataFrame([("p", float(20 * i)) for i in range(384)], "pid string, axial_um double")
    rows = J.default_channels(df).collect()
    assert [r["channel"] for r in sorted(rows, key=lambda r: r["axial_um"])] == list(range(384))
    with pytest.raises(ValueError):
        J.default_channels(df.limit(10))


def test_regions_voids_and_transitions(spark):
    regions = spark.createDataFrame(
        [(i, f"r{i}", f"R{i}", [0, 0, 0], 1, 0, i) for i in range(1, 14)],
        "id bigint, name string, acronym string, rgb array<int>, level int, parent bigint, ord int",
    )
    maps = spark.createDataFrame([(i, "Cosmos", i) for i in range(1, 14)] + [(-1, "Sided", -1), (1, "Sided", 1)], "source_id bigint, mapping string, target_id bigint")
    more, wide, positions = B.add_region(regions, maps, B.VOID_FLUID)
    assert positions == (13, 14) and more.count() == 15
    mapped = {(r["mapping"], r["source_id"]): r["target_id"] for r in wide.filter("abs(source_id) = 2000").collect()}
    assert mapped == {("Cosmos", 2000): 2000, ("Cosmos", -2000): 2000, ("Sided", 2000): 2000, ("Sided", -2000): -2000}
    with pytest.raises(ValueError):
        B.add_region(more, wide, B.VOID_FLUID)

    rng = np.random.default_rng(1)
    label = rng.integers(0, 14, (3, 4, 30))
    cells = [(a, m, d, int(label[a, m, d])) for a in range(3) for m in range(4) for d in range(30)]
    volume = spark.createDataFrame(cells, "ap int, ml int, dv int, label int")
    surface = spark.createDataFrame([(a, m, 5) for a in range(3) for m in range(4) if (a, m) != (0, 0)], "ap int, ml int, hull_dv int")
    filled = B.assign_voids(volume, surface, 2000)
    want = label.copy()
    hull = np.zeros_like(label, dtype=bool)
    hull[:, :, 5:] = True
    hull[0, 0] = False
    want[(label == 0) & hull] = 2000
    assert {(r["ap"], r["ml"], r["dv"]): r["label"] for r in filled.collect()} == {
        (a, m, d): int(want[a, m, d]) for a in range(3) for m in range(4) for d in range(30)
    }
    counts, seen = B.region_transitions(volume, maps, regions, slab=7)
    expected = {}
    for a in range(3):
        for m in range(4):
            for d in range(29):
                up, low = int(label[a, m, d]), int(label[a, m, d + 1])
                if up and low:
                    expected[(up, low)] = expected.get((up, low), 0) + 1
    assert {(r["from_state"], r["to_state"]): r["n"] for r in counts.collect()} == expected
    assert len(B.region_ids(maps, "Cosmos")) == 13 and seen.count() == 13


def test_usable_durations_and_display_features(spark):
    recordings = spark.createDataFrame([("p", "ap", 900, 30.0), ("p", "lf", 50, 2.5)], "pid string, band string, ns bigint, fs double")
    assert J.usable_durations(recordings, 4.0).first()["duration"] == 16.0
    assert P.features_for_display(["a", "b", "x", "y", "z", "o"]) == ["a", "b"]
    assert recordings.groupBy().agg(F.count("*")).first()[0] == 2


def test_fast_lengths_have_no_cap(spark):
    def plain(n):
        best = None
        for j in range(40):
            for k in range(28):
                m = 3**j * 5**k
                while m < n:
                    m *= 2
                best = m if best is None else min(best, m)
        return best

    values = [1, 2, 7, 11, 97, 10_000_001, 20_000_000, 2**40 + 1, 3**20 * 5**9 + 1, 2**61 + 12345]
    rows = spark.createDataFrame([(v,) for v in values], "n long").select("n", C.next_fast_length("n").alias("m")).collect()
    assert {r["n"]: r["m"] for r in rows} == {v: plain(v) for v in values}
    assert spark.range(1).select(C.next_fast_length(F.lit(0)).alias("m")).first()["m"] is None
