import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from depthline.operators import ordered as O
from depthline.operators.quantiles import exact_quantiles, from_order_numbers, order_numbers, quantiles_of
from depthline.operators.spatial import interpolate_track


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = [("hot", int(t), int(i), float(v)) for i, (t, v) in enumerate(zip(rng.integers(0, 500, 1000), rng.normal(size=1000)))]
    data += [(k, int(t), 5000 + i, float(v)) for i, (k, t, v) in enumerate(zip("abcdefghij" * 5, rng.integers(0, 500, 50), rng.normal(size=50)))]
    return spark.createDataFrame(data, "k string, t int, id int, v double").repartition(5).cache()


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_ordered_operators_equal_plain_windows(rows, width):
    block = O.range_block("t", width)
    order = ["t", "id"]
    w = Window.partitionBy("k").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col("id") % 5 == 0, F.col("v"))
    want = rows.withColumn("known", known).select(
        "id",
        (F.row_number().over(w) - 1).alias("i"),
        F.lead("v").over(w).alias("nxt"),
        F.sum("id").over(upto).alias("total"),
        F.last("known", ignorenulls=True).over(upto).alias("before"),
        F.first("known", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    )
    a = O.dense_index(rows, ["k"], order, block, "i").select("id", F.col("i").cast("int").alias("i"))
    b = O.next_value(rows, ["k"], order, block, {"v": "nxt"}).select("id", "nxt")
    c = O.running_total(rows, ["k"], order, block, "id", "total").select("id", "total")
    d = O.surrounding(rows.withColumn("known", known), ["k"], order, block, "known", "before", "after").select("id", "before", "after")
    got = a.join(b, "id").join(c, "id").join(d, "id").select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_numbers_without_a_key(spark):
    """Ranges are numbered one after the other, ties and NULL first, and no window takes the whole table."""
    rng = np.random.default_rng(3)
    rows = [(None if x < 4 else int(x), i) for i, x in enumerate(rng.integers(0, 40, 3000))] + [(41, 9000)] * 3
    df = spark.createDataFrame(rows, "v int, id int").repartition(7)
    got = O.dense_index(df, [], ["v", "id"], None, "i")
    assert sorted((r["i"], r["v"] is not None, r["v"] or 0, r["id"]) for r in got.collect()) == [
        (i, *r) for i, r in enumerate(sorted((v is not None, v or 0, i) for v, i in rows))
    ]
    for part in got._jdf.queryExecution().optimizedPlan().toString().split("\n"):
        assert "Window [" not in part or "_group" in part
    assert O.dense_index(df.limit(0), [], ["v"], None, "i").collect() == []


def test_rows_without_a_place_have_blocks(spark):
    rows = [("a", None if i % 3 else i, i) for i in range(900)] + [("b", None, i) for i in range(50)] + [("b", 3, None), ("b", None, None)]
    df = spark.createDataFrame(rows, "k string, place int, id int").repartition(5)
    order = Window.partitionBy("k").orderBy("place", "id")
    want = df.withColumn("i", (F.row_number().over(order) - 1).cast("long"))
    got = O.dense_index(df, ["k"], ["place", "id"], [O.range_block("place", 64), O.range_block("id", 64)], "i")
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("kind", ["normal", "ties", "outlier", "signs"])
def test_quantiles_are_exact(spark, kind):
    rng = np.random.default_rng(7)
    v = {
        "normal": rng.normal(size=3001),
        "ties": rng.integers(0, 4, 3001).astype(float),
        "outlier": np.r_[rng.normal(size=3000), 1e12],
        "signs": np.r_[np.zeros(700), -np.zeros(700), np.full(800, -1e-300), rng.normal(size=800) * 10.0 ** rng.integers(-200, 200, 800)],
    }[kind]
    data = [("a", float(x)) for x in v] + [("b", float(x)) for x in v[:11]] + [("a", float("nan")), ("a", None)]
    df = spark.createDataFrame(data, "k string, v double")
    probs = [0.0, 0.05, 0.5, 0.95, 1.0]
    for keys in (["k"], []):
        got = {(r["k"] if keys else None, r["prob"]): r["quantile"] for r in exact_quantiles(df, keys, "v", probs).collect()}
        groups = {"a": v, "b": v[:11]} if keys else {None: np.r_[v, v[:11]]}
        for key, x in groups.items():
            for p in probs:
                assert got[(key, p)] == pytest.approx(np.quantile(x, p), rel=1e-12, abs=1e-12)


def test_order_numbers():
    v = np.array([-np.inf, -1e308, -2.0, -1.0, -5e-324, 0.0, 5e-324, 1.0, 1.5, 1e308, np.inf])
    n = order_numbers(v)
    assert (np.diff(n) > 0).all() and np.array_equal(from_order_numbers(n), v)
    assert order_numbers(np.array([-0.0])) == order_numbers(np.array([0.0]))


def test_quantiles_of_several_columns(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=500), rng.integers(0, 9, 500).astype(float)
    rows = [(int(i % 3), float(x), float(y), None) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "k int, a double, b double, never double")
    got = {(r["k"], r["feature"]): r["quantile"] for r in quantiles_of(df, ["k"], ["a", "b", "never"], [0.3]).collect()}
    assert got.keys() == {(k, f) for k in range(3) for f in "ab"}  # a column without values has no rows
    for (k, f), v in got.items():
        assert v == pytest.approx(np.quantile({"a": a, "b": b}[f][k::3], 0.3), rel=1e-12)


def test_track_interpolation_equals_numpy(spark):
    rng = np.random.default_rng(2)
    d = np.sort(rng.uniform(0, 100, 30))
    v = rng.normal(size=30)
    at = rng.uniform(-10, 110, 200)
    knots = spark.createDataFrame([("a", float(x), float(y)) for x, y in zip(d, v)], "k string, d double, v double")
    points = spark.createDataFrame([("a", float(x), i) for i, x in enumerate(at)] + [("none", 1.0, -1)], "k string, d double, id int")
    for width in (3.0, 1e6):
        out = {r["id"]: r["v"] for r in interpolate_track(points, knots, ["k"], "d", ["v"], width).collect()}
        assert out.pop(-1) is None
        assert np.allclose([out[i] for i in range(200)], np.interp(at, d, v))


def test_blocks_of_time(spark):
    df = spark.sql("select timestamp'2024-01-01 00:59:59.999' a, timestamp'2024-01-01 01:00:00' b, timestamp'1969-12-31 23:59:59' c")
    r = df.select(*[O.time_block(c, 3600).alias(c) for c in "abc"]).first()
    assert r["b"] - r["a"] == 1 and r["c"] == -1
    assert not math.isnan(r["a"])


def test_a_hot_key_spreads_over_partitions(spark):
    """A third of all rows in one key: no partition of the result holds anything like it."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 997)).alias("k"),
        F.col("id").alias("t"),
        F.rand(1).alias("v"),
    )
    # No broadcasts, as at scale: on this little data Spark would broadcast the rows themselves.
    settings = {
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    saved = {c: spark.conf.get(c) for c in settings}
    for c, value in settings.items():
        spark.conf.set(c, value)
    try:
        block = O.range_block("t", 500)
        for out in (
            O.dense_index(df, ["k"], ["t"], block, "x"),
            O.next_value(df, ["k"], ["t"], block, {"v": "x"}),
            O.running_total(df, ["k"], ["t"], block, "v", "x"),
        ):
            # The new column is used, so that its window is not pruned from the plan.
            per_task = out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.max("x"))
            sizes = [r["n"] for r in per_task.collect()]
            assert sum(sizes) == 30_000 and max(sizes) < 0.15 * 30_000
    finally:
        for c, value in saved.items():
            spark.conf.set(c, value)


def test_rows_without_an_order_value_stay(spark):
    from depthline.operators import ordered as O

    rows = [("a", None, 1.0), ("a", 5, None), ("a", 99, 3.0), ("b", None, None)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    block = O.range_block("t", 10)
    index = {(r["k"], r["t"]): r["i"] for r in O.dense_index(df, ["k"], ["t"], block, "i").collect()}
    assert index == {("a", None): 0, ("a", 5): 1, ("a", 99): 2, ("b", None): 0}
    near = {(r["k"], r["t"]): (r["x"], r["y"]) for r in O.surrounding(df, ["k"], ["t"], block, "v", "x", "y").collect()}
    assert near["a", 5] == (1.0, 3.0) and near["b", None] == (None, None)
