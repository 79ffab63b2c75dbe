import json

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from depthline.operators import learn as L
from depthline.sources import sinks, store
from depthline.streaming import snippets as T


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(path)


def test_feature_store_fallbacks(spark, tmp_path):
    root = str(tmp_path / "2024_W50")
    keyed = "pid string, channel int, v double"
    write(spark, f"{root}/raw_ephys_features.pqt", [("a", 1, 1.0)], keyed)
    write(spark, f"{root}/channels.pqt", [("a", 1, 1.0)], keyed)
    write(spark, f"{root}/probes.pqt", [("a",)], "pid string")
    tables = store.load_revision(spark, str(tmp_path), "2024_W50", verify=True)
    assert tables["clusters"].count() == 0 and "firing_rate" in tables["clusters"].columns
    assert tables["voltage"].first()["v"] == 1.0
    write(spark, f"{root}/raw_ephys_features_denoised.pqt", [("a", 1, 2.0)], keyed)
    assert store.load_tables(spark, root)["voltage"].first()["v"] == 2.0
    with pytest.raises(FileNotFoundError):
        store.load_revision(spark, str(tmp_path), "absent")


def test_probe_sets(spark, tmp_path):
    assert store.read_pid_sets(spark).filter("set_name = 'benchmark'").count() == 13
    write(spark, str(tmp_path / "sets"), [("mine", "p")], "set_name string, pid string")
    assert store.read_pid_sets(spark, str(tmp_path / "sets")).count() == 14


def test_catalogues(spark):
    rows = [
        ("1", "My_Wide_01", 40, "FMR1", "{}", '{"IS_MOCK": false}'),
        ("2", "my_wide_01", 50, "FMR1", "{}", '{"IS_MOCK": false}'),
        ("3", "my_wide_01", 40, "FMR1", '{"qc": "CRITICAL"}', '{"IS_MOCK": false}'),
        ("4", "my_wide_01", 40, "XX", '{"extended_qc": {"tracing_exists": true}}', '{"IS_MOCK": true}'),
        ("5", "my_wide_01", 40, "XX", '{"extended_qc": {"tracing_exists": true}}', '{"IS_MOCK": false}'),
    ]
    df = spark.createDataFrame(rows, "id string, project string, qc int, subject string, json string, session_json string")
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(store.wide_catalogue(df, "my_wide")) == ["1", "5"]
    assert ids(store.wide_catalogue(df, "my_wide", traced_only=True)) == ["5"]
    assert ids(store.line_catalogue(df, "MY_WIDE")) == ["1"]


@pytest.fixture(scope="module")
def recording(tmp_path_factory):
    data = np.random.default_rng(0).integers(-500, 500, (1000, 5)).astype("<i2")
    path = tmp_path_factory.mktemp("rec") / "x.bin"
    data.tofile(path)
    return str(path), data


def test_flat_recording_and_windows(spark, recording):
    path, data = recording
    traces = store.read_flat_recording(spark, path, "p", "ap", 100.0, 5, 1, chunk_samples=64).cache()
    assert traces.count() == 4 * 16
    cut = store.time_window(traces, 100.0, 1.0, 1.9, 64, latency=3)
    rows = {r["channel"]: r["samples"] for r in cut.collect()}
    assert store.fast_length(190) == 192
    for c in range(4):
        assert rows[c] == data[103 : 103 + 192, c].tolist()
    assert store.time_window(traces, 100.0, 0.0, 1.0, 64, channels=2).count() == 2
    with pytest.raises(ValueError):
        store.time_window(traces, 100.0, -1.0, 1.0, 64)
    whole = store.cut_snippets(traces, 300).collect()
    assert len(whole) == 4 * 4
    for r in whole:
        assert r["samples"] == data[r["snippet"] * 300 : (r["snippet"] + 1) * 300, r["channel"]].tolist()
    meta = store.recordings_of(traces).first()
    assert (meta["ns"], meta["nc"]) == (1000, 4)
    with pytest.raises(RuntimeError):
        store.read_flat_recording(spark, "/nonexistent/file.bin", "p", "ap", 100.0, 5)


def test_window_condition_reaches_the_scan(spark, recording, tmp_path):
    path, _ = recording
    out = str(tmp_path / "traces")
    sinks.write_traces(store.read_flat_recording(spark, path, "p", "ap", 100.0, 5, 1, 64), out)
    cut = store.time_window(spark.read.parquet(out).filter("pid = 'p' AND band = 'ap'"), 100.0, 1.0, 1.0, 64, channels=2)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(chunk" in plan and "LessThan(channel" in plan
    assert "PartitionFilters: [isnotnull(pid" in plan and cut.count() == 2


def test_windows_a_recording_cannot_serve(spark):
    recordings = spark.createDataFrame([("a", "ap", 1000, 10.0, 5, 1), ("b", "ap", 1000, 10.0, 1, 1)], "pid string, band string, ns bigint, fs double, nc int, nsync int")
    requests = spark.createDataFrame([("a", 0.0, 100.0), ("a", 0.1, 100.0), ("a", -1.0, 1.0), ("b", 0.0, 1.0), ("c", 0.0, 1.0)], "pid string, t_start double, duration double")
    reasons = sorted(r["reason"] for r in store.invalid_windows(requests, recordings).collect())
    assert reasons == ["beyond the end", "negative start", "no channels", "no recording"]
    with pytest.raises(ValueError):
        store.checked_windows(requests, recordings)
    assert store.checked_windows(requests.limit(1), recordings).count() == 1


def test_recording_with_cached_channels(spark):
    computed = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 1.0)], "pid string, channel int, axial_um double")
    cached = spark.createDataFrame([("a", 0, 9.0, 2)], "pid string, channel int, axial_um double, labels int")
    merged = {r["pid"]: (r["axial_um"], r["labels"]) for r in store.with_channels(computed, cached).collect()}
    assert merged == {"a": (9.0, 2), "b": (1.0, None)}
    assert store.with_channels(computed, None) is computed
    traces = spark.createDataFrame([("a", 0, [1.0]), ("b", 0, [2.0])], "pid string, channel int, samples array<double>")
    assert store.recording_traces(traces, computed, "a").count() == 1


def test_flat_matrices_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    m = {g: rng.integers(0, 50, (7, 11)) for g in ("a", "b")}
    rows = [(g, i, j, int(x[i, j])) for g, x in m.items() for i in range(7) for j in range(11) if x[i, j]]
    counts = spark.createDataFrame(rows, "g string, cluster_id int, bin int, n bigint")
    written = sinks.write_flat_matrices(counts, str(tmp_path), "g", 7, 11)
    assert {r["bytes"] for r in written.collect()} == {7 * 11 * 4}
    for g, x in m.items():
        got = store.read_flat_matrix(spark, str(tmp_path / f"{g}.bin"), 7, rows_per_task=3).collect()
        assert len(got) == 77 and all(x[r["cluster_id"], r["bin"]] == r["n"] for r in got)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 1, 0, 2.0)], "pid string, snippet int, channel int, rms_lf double")
    root = str(tmp_path)
    assert sinks.read_features(spark, root, "lf") is None
    sinks.write_features(df, root, "lf")
    assert sinks.read_features(spark, root, "lf").count() == 2
    sinks.write_if_absent(df, f"{root}/channels")
    sinks.write_if_absent(df.unionByName(df), f"{root}/channels")
    assert spark.read.parquet(f"{root}/channels").count() == 2
    waves = df.withColumn("sample", F.lit(7)).withColumn("neighbour", F.explode(F.array(F.lit(4), F.lit(3))))
    waves = waves.withColumn("waveform", F.array(F.col("neighbour").cast("double"), F.lit(1.0)))
    sinks.write_waveforms(waves, df, f"{root}/none", save=False)
    assert not store.path_exists(spark, f"{root}/none")
    for _ in range(2):  # a repeated run doubles nothing
        sinks.write_waveforms(waves, df, f"{root}/w")
        waveforms, events = sinks.read_waveforms(spark, f"{root}/w")
        rows = waveforms.orderBy("snippet").collect()
        assert [(r["pid"], r["snippet"], r["sample"], r["neighbours"], r["waveform"]) for r in rows] == [
            ("a", i, 7, [3, 4], [[3.0, 1.0], [4.0, 1.0]]) for i in (0, 1)
        ]
        assert waveforms.schema["waveform"].dataType.elementType.elementType.typeName() == "float" and events.count() == 2
    preds = df.withColumn("fold", F.lit(0))
    sinks.write_predictions(preds, f"{root}/p")
    assert spark.read.parquet(f"{root}/p").count() == 2


def test_many_windows_make_few_files(spark, tmp_path):
    """10,000 windows of two probes: tens of files; a window is found by folder and statistics; others stay when it is replaced."""
    import os

    root, path = str(tmp_path), tmp_path / "lf_features.parquet"
    df = spark.range(80_000).selectExpr(
        "concat('p', id % 2) pid", "cast(id div 8 as int) snippet", "cast(id % 8 div 2 as int) channel", "cast(id as double) rms_lf"
    )
    sinks.write_features(df, root, "lf")
    listing = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    before = listing()
    assert len(before) <= 40
    one = sinks.read_features(spark, root, "lf", pid="p1", snippet=5000)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "snippets#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "EqualTo(snippet,5000)" in plan and "EqualTo(pid,p1)" in plan
    assert one.count() == 4 and one.select(F.input_file_name()).distinct().count() == 1
    again = df.filter("pid = 'p1' and snippet = 5000").withColumn("rms_lf", F.lit(-1.0))
    for _ in range(2):
        sinks.write_features(again, root, "lf", mode="overwrite")
    assert sinks.read_features(spark, root, "lf").count() == 80_000
    assert sinks.read_features(spark, root, "lf").filter("rms_lf = -1").count() == 4
    after = listing()
    assert sum(after.get(f) == t for f, t in before.items()) >= len(before) - 3  # one folder is new


def test_reuse_or_compute(spark):
    wanted = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "pid string, snippet int")
    existing = spark.createDataFrame([("a", 0, 5.0), ("z", 0, 7.0)], "pid string, snippet int, v double")
    asked = []

    def compute(keys):
        asked.extend(map(tuple, keys.collect()))
        return keys.withColumn("v", F.lit(1.0))

    got = sorted(map(tuple, sinks.reuse_or_compute(wanted, existing, compute).collect()))
    assert got == [("a", 0, 5.0), ("a", 1, 1.0), ("b", 0, 1.0)] and sorted(asked) == [("a", 1), ("b", 0)]
    assert sinks.reuse_or_compute(wanted, None, compute).count() == 3


@pytest.fixture(scope="module")
def trained(spark):
    rng = np.random.default_rng(0)
    rows = [(f"p{i // 10}", i % 10, i % 3, float(i % 3 + 0.2 * rng.normal()), float(rng.normal())) for i in range(300)]
    df = spark.createDataFrame(rows, "pid string, channel int, region int, f0 double, f1 double")
    folds = L.grouped_folds(df, "pid", 5)
    joined = df.join(folds, "pid")
    return joined, folds, L.train_folds(joined, ["f0", "f1"], "region", ["pid", "channel"], trees=5, depth=3)


def test_folds_are_whole_groups_of_equal_size(spark, trained):
    _, folds, _ = trained
    rows = folds.collect()
    assert len({r["pid"] for r in rows}) == len(rows) == 30
    assert sorted(np.bincount([r["fold"] for r in rows])) == [6] * 5
    again = {r["pid"]: r["fold"] for r in folds.collect()}
    assert again == {r["pid"]: r["fold"] for r in rows}
    seven = spark.range(7).withColumnRenamed("id", "pid")
    sizes = np.bincount([r["fold"] for r in L.grouped_folds(seven, "pid", 5).collect()])
    assert sizes.tolist() == np.bincount(np.floor(np.arange(7) / 7 * 5).astype(int)).tolist()


def test_training_predicts_every_row_once(trained):
    df, _, result = trained
    rows = result.predictions.collect()
    assert len(rows) == df.count() and result.classes == [0, 1, 2]
    assert np.mean([r["region"] == r["predicted"] for r in rows]) > 0.9
    assert all(sum(r["probas"]) == pytest.approx(1.0) for r in rows)


def test_a_class_missing_from_training_raises(trained):
    df, _, _ = trained
    lonely = df.withColumn("region", F.when((F.col("fold") == 0) & (F.col("region") == 2), 9).otherwise(F.col("region")))
    with pytest.raises(ValueError):
        L.train_folds(lonely, ["f0", "f1"], "region", ["pid", "channel"])


def test_models_are_stored_and_infer(spark, trained, tmp_path):
    df, _, result = trained
    meta = {**result.meta, "VINTAGE": "2024_W50", "REGION_MAP": "Cosmos", "ACCURACY": 0.9}
    for i, model in enumerate(result.models):
        folder = sinks.save_model(spark, str(tmp_path), model, meta, sinks.fold_name(i))
    root, fold = folder.rsplit("/", 1)
    assert fold == "FOLD04" and root.rsplit("/", 1)[1].startswith("2024_W50_Cosmos_") and len(root.rsplit("_", 1)[1]) == 8
    models, metas = sinks.load_folds(spark, root)
    assert metas[0]["FEATURES"] == ["f0", "f1"] and json.dumps(metas[0])
    rows = df.withColumns({"axial_um": F.col("channel") * 20.0, "lateral_um": F.lit(1.0), "labels": F.lit(0)})
    out = L.infer_regions(rows, models, metas, denoise=False).collect()
    assert len(out) == 5 * df.count()
    assert all(int(np.argmax(r["probas"])) == r["predicted_index"] for r in out)
    smoothed = L.infer_regions(rows.withColumnRenamed("f0", "rms_ap"), models, [{**m, "FEATURES": ["rms_ap", "f1"]} for m in metas])
    assert smoothed.count() == 5 * df.count()
    long = L.long_probabilities(L.infer_regions(rows, models, metas, denoise=False), ["fold", "pid", "channel"], result.classes)
    assert long.count() == 15 * df.count()
    assert Vectors.dense([1.0])[0] == 1.0


def test_stream_equals_batch_on_closed_windows(spark, tmp_path):
    events = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) as ts, id % 3 as channel, cast(id as double) as v from range(4000)")
    src = str(tmp_path / "src")
    for i in range(4):
        events.filter(F.floor(F.col("v") / 1000) == i).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(src)
    live = T.snippet_rms(stream, "ts", ["channel"], "v", "5 minutes", "1 hour")
    T.write_closed_windows(live, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch = T.snippet_rms(events, "ts", ["channel"], "v", "5 minutes")
    got = sorted(map(tuple, spark.read.schema(live.schema).parquet(str(tmp_path / "out")).collect()))
    closed = batch.filter("window_end <= timestamp'2024-01-01 00:06:39'")
    want = sorted(map(tuple, closed.collect()))
    assert len(want) == 3 and [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want]) and [g[4] for g in got] == [w[4] for w in want]


def test_only_new_snippets_are_computed(spark, tmp_path):
    src, out = str(tmp_path / "req"), str(tmp_path / "out")
    seen = []

    def compute(keys):
        seen.append(sorted(r["k"] for r in keys.collect()))
        return keys.withColumn("v", F.col("k") * 2)

    def run(name):
        stream = spark.readStream.schema("k bigint").parquet(src)
        T.compute_new_snippets(stream, out, str(tmp_path / name), compute, ["k"]).awaitTermination()

    spark.range(3).withColumnRenamed("id", "k").coalesce(1).write.parquet(src)
    run("one")
    spark.range(1, 5).withColumnRenamed("id", "k").coalesce(1).write.mode("append").parquet(src)
    run("one")
    run("two")
    assert seen == [[0, 1, 2], [3, 4], []]
    assert sorted(r["v"] for r in spark.read.parquet(out).collect()) == [0, 2, 4, 6, 8]
