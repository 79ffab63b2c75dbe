import numpy as np
import pytest
from pyspark.sql import Row

from depthline.functions import kernels as K
from depthline.operators import sequence as Q
from depthline.operators.ordered import range_block
from pyspark.sql import functions as F

# The model, observations, path and probability that the decoder has to give.
MODEL = Q.HiddenMarkov(
    emission=np.array([[0.1, 0.9], [0.3, 0.7], [0.5, 0.5]]),
    transition=np.array([[0.1, 0.2, 0.7], [0.1, 0.1, 0.8], [0.5, 0.4, 0.1]]),
    start=np.array([0.1, 0.3, 0.6]),
)


def brute_force(model, obs):
    """Best path by trying all of them."""
    import itertools

    best, score = None, -1.0
    for path in itertools.product(range(3), repeat=len(obs)):
        p = model.start[path[0]] * model.emission[path[0], obs[0]]
        for i in range(1, len(obs)):
            p *= model.transition[path[i - 1], path[i]] * model.emission[path[i], obs[i]]
        if p > score:
            best, score = list(path), p
    return best, score


def test_golden_path_by_expression_and_by_kernel(spark):
    df = spark.createDataFrame([Row(k=1, observed=[1, 1, 0, 1])])
    row = Q.viterbi_by_expression(df, "observed", MODEL).first()
    assert row["path"] == [2, 0, 2, 0] and row["probability"] == 0.0212625
    row = Q.decode_sequences(df, "observed", MODEL).first()
    assert row["path"] == [2, 0, 2, 0] and row["score"] == 0.0212625


@pytest.mark.parametrize("n", [1, 2, 5, 7])
def test_kernel_against_all_paths(n):
    rng = np.random.default_rng(n)
    for _ in range(20):
        obs = rng.integers(0, 2, n)
        path, score = K.viterbi(MODEL.emission, MODEL.transition, MODEL.start, obs)
        want, best = brute_force(MODEL, obs)
        assert score == pytest.approx(best, rel=1e-12)
        p = MODEL.start[path[0]] * MODEL.emission[path[0], obs[0]]
        for i in range(1, n):
            p *= MODEL.transition[path[i - 1], path[i]] * MODEL.emission[path[i], obs[i]]
        assert p == pytest.approx(best, rel=1e-12)


def log_score(model, path, obs):
    total = np.log(model.start[path[0]]) + np.log(model.emission[path[0], obs[0]])
    for i in range(1, len(obs)):
        total += np.log(model.transition[path[i - 1], path[i]]) + np.log(model.emission[path[i], obs[i]])
    return total


def test_long_sequences_decode_as_short_ones(spark):
    """A sequence of many chunks and chain groups gives the path of one pass."""
    rng = np.random.default_rng(5)
    model = Q.HiddenMarkov(
        emission=rng.dirichlet(np.ones(4), 3), transition=rng.dirichlet(np.ones(3), 3), start=rng.dirichlet(np.ones(3))
    )
    lengths = {"hot": 1203, "b": 9, "c": 1, "d": 20, "e": 21}
    rows = [(key, i, int(rng.integers(0, 4))) for key, n in lengths.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k string, at int, o int")
    got = Q.decode(df, ["k"], ["at"], "o", model, range_block("at", 50), chunk=10, fan=7).collect()
    assert len(got) == len(rows)
    for key, n in lengths.items():
        obs = np.array([o for k, _, o in rows if k == key])
        path, score = K.viterbi(model.emission, model.transition, model.start, obs, log=True)
        mine = {r["position"]: (r["state"], r["log_score"]) for r in got if r["k"] == key}
        # Equal factors in another order tie up to rounding, so compare the scores of the paths.
        assert log_score(model, [mine[i][0] for i in range(n)], obs) == pytest.approx(log_score(model, path, obs), rel=1e-12)
        assert mine[0][1] == pytest.approx(score, rel=1e-9)
    for r in Q.decode(df, ["k"], ["at"], "o", model, range_block("at", 50), chunk=5000).collect():
        obs = np.array([o for k, _, o in rows if k == r["k"]])
        path, score = K.viterbi(model.emission, model.transition, model.start, obs, log=True)
        assert r["state"] == path[r["position"]] and r["log_score"] == pytest.approx(score)


def test_states_do_not_depend_on_the_chunk(spark):
    """A model with very many ties: the same states for every chunk, those of one pass."""
    even = Q.HiddenMarkov(np.full((4, 4), 0.2) + np.eye(4) * 0.2, np.full((4, 4), 0.25), np.full(4, 0.25))
    torn = Q.HiddenMarkov(np.full((4, 4), 0.25), np.array([[0, 0.5, 0, 0.5], [0.5, 0, 0.5, 0]] * 2), np.array([0.5, 0.5, 0, 0]))
    rng = np.random.default_rng(2)
    rows = [(key, i, int(rng.integers(0, 4))) for key, n in {"a": 700, "b": 64, "c": 1, "d": 65}.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k string, at int, o int")
    for model in (even, torn):
        want = {}
        for key in "abcd":
            path, score = K.viterbi(model.emission, model.transition, model.start, [o for k, _, o in rows if k == key], log=True)
            want |= {(key, i): (int(state), round(score, 6)) for i, state in enumerate(path)}
        for chunk, fan in ((8, 3), (64, 1024), (4096, 1024)):
            got = Q.decode(df, ["k"], ["at"], "o", model, range_block("at", 50), chunk, fan).collect()
            assert {(r["k"], r["position"]): (r["state"], round(r["log_score"], 6)) for r in got} == want


def test_golden_path_in_chunks(spark):
    df = spark.createDataFrame([("g", i, o) for i, o in enumerate([1, 1, 0, 1])], "k string, at int, o int")
    for chunk in (1, 2, 4096):
        got = Q.decode(df, ["k"], ["at"], "o", MODEL, range_block("at", 50), chunk, 2).orderBy("position").collect()
        assert [r["state"] for r in got] == [2, 0, 2, 0] and np.exp(got[0]["log_score"]) == pytest.approx(0.0212625)


def test_draws_depend_on_key_run_and_place_alone(spark):
    rng = np.random.default_rng(3)
    profiles = _profiles(spark, rng.dirichlet(np.ones(3), 6))
    model = Q.HiddenMarkov(np.eye(3) * 0.7 + 0.1, np.eye(3) * 0.4 + 0.2, np.ones(3) / 3)
    for method in ("one_way", "two_ways"):
        runs = [sorted(map(tuple, Q.sampled_histogram(profiles, ["pid"], model, 150, n, method).collect())) for n in (7, 50, 150)]
        assert runs[0] == runs[1] == runs[2]
    numbers = Q.drawn(77, 1, np.arange(4000), np.arange(20)) / 2.0**32
    assert abs(numbers.mean() - 0.5) < 0.01 and np.abs(np.corrcoef(numbers.T) - np.eye(20)).max() < 0.07
    assert np.array_equal(Q.drawn(77, 1, np.arange(10, 20), np.arange(20)), Q.drawn(77, 1, np.arange(4000), np.arange(20))[10:20])


def test_model_must_be_stochastic():
    with pytest.raises(ValueError):
        Q.HiddenMarkov(MODEL.emission, MODEL.transition * 2, MODEL.start)


def _profiles(spark, p):
    rows = [("a", float(d), c, float(v)) for d, row in enumerate(p) for c, v in enumerate(row)]
    df = spark.createDataFrame(rows, "pid string, depth double, c int, p double")
    return Q.packed_profiles(df, ["pid"], "depth", "c", "p", [0, 1, 2])


@pytest.mark.parametrize("method", ["one_way", "two_ways"])
def test_sampled_histogram(spark, method):
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.ones(3), 6)
    model = Q.HiddenMarkov(np.eye(3) * 0.7 + 0.1, np.eye(3) * 0.4 + 0.2, np.ones(3) / 3)
    run = lambda: Q.sampled_histogram(_profiles(spark, p), ["pid"], model, 200, 60, method).collect()
    got = run()
    per_depth = {}
    for r in got:
        per_depth[r["depth"]] = per_depth.get(r["depth"], 0) + r["n"]
    assert per_depth == {float(d): 200 for d in range(6)}
    assert sorted(map(tuple, got)) == sorted(map(tuple, run()))


def test_certain_profile_keeps_its_path(spark):
    p = np.eye(3)[[0, 0, 1, 2, 2]]
    model = Q.HiddenMarkov(np.eye(3) * 0.97 + 0.01, np.eye(3) * 0.4 + 0.2, np.ones(3) / 3)
    got = Q.sampled_histogram(_profiles(spark, p), ["pid"], model, 40, 40).collect()
    assert {(r["depth"], r["state"], r["n"]) for r in got} == {(0.0, 0, 40), (1.0, 0, 40), (2.0, 1, 40), (3.0, 2, 40), (4.0, 2, 40)}


def test_sampling_follows_the_profile():
    p = np.array([[0.2, 0.5, 0.3], [0.0, 0.0, 0.0]])
    u = np.array([[0.1, 0.1], [0.2, 0.5], [0.69, 0.9], [0.71, 0.99]])
    assert Q._sampled(p, u)[:, 0].tolist() == [0, 1, 1, 2]
    assert set(Q._sampled(p, u)[:, 1]) <= {0, 1, 2}


def test_transitions_respect_the_mask_and_the_direction(spark):
    df = spark.createDataFrame(
        [("a", 0, 1, True), ("a", 1, 1, True), ("a", 2, 2, False), ("a", 3, 2, True), ("a", 4, 1, True), ("b", 0, 2, True)],
        "k string, at int, s int, ok boolean",
    )
    counts = Q.transition_counts(df, ["k"], ["at"], "s", range_block("at", 2), F.col("ok"))
    assert sorted(map(tuple, counts.collect())) == [(1, 1, 1), (2, 1, 1)]
    up = Q.transition_matrix(counts, [1, 2], reverse=True)
    assert sorted(map(tuple, up.collect())) == [(1, 1, 1, 0.5), (1, 2, 1, 0.5), (2, 1, 0, None), (2, 2, 0, None)]


def test_many_short_sequences_share_their_tasks(spark):
    """Chains run over sorted partitions: a sequence of few chunks costs no Python group of its own."""
    rng = np.random.default_rng(8)
    model = Q.HiddenMarkov(rng.dirichlet(np.ones(4), 3), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(3)))
    rows = [(key, i, int(rng.integers(0, 4))) for key in range(300) for i in range(1 + key % 23)]
    df = spark.createDataFrame(rows, "k long, at int, o int")
    out = Q.decode(df, ["k"], ["at"], "o", model, range_block("at", 50), chunk=4, fan=3)
    assert "InPandas" not in out._jdf.queryExecution().toString()
    found = {(r["k"], r["position"]): (r["state"], r["log_score"]) for r in out.collect()}
    assert len(found) == len(rows)
    for key in range(300):
        path, score = K.viterbi(model.emission, model.transition, model.start, [o for k, _, o in rows if k == key], log=True)
        assert [found[key, i][0] for i in range(len(path))] == path.tolist()
        assert found[key, 0][1] == pytest.approx(score, rel=1e-9)


def test_runs_of_many_profiles_are_drawn_together():
    keys, runs, places = np.array([7, 7, 2**32 - 1]), np.array([0, 5, 3]), np.arange(9)
    together = Q.drawn(keys, 12345, runs, places)
    for i, key in enumerate(keys.tolist()):
        assert np.array_equal(together[i], Q.drawn(key, 12345, runs[i : i + 1], places)[0])
