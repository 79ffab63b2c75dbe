"""Queries on state sequences, anatomy, the classifier, sources and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from depthline.functions import columns as C
from depthline.operators import anatomy as B
from depthline.operators import learn as L
from depthline.operators import relational as R
from depthline.operators import sequence as Q
from depthline.operators import spatial as X
from depthline.operators.ordered import next_value, time_block
from depthline.plans import standins as S
from depthline.plans import tables as P
from depthline.plans.registry import query, r

# The states of the event stream, in class order.
STATES = ["click", "error", "purchase", "signup", "view"]
# Ordered operators cut a key into blocks of a minute: a third of all rows in one
# key then still spreads over every minute of the record.
BLOCK_SECONDS = 60
ORDER = ["ts", "event_id"]
STATE_SQL = "['click', 'error', 'purchase', 'signup', 'view']"
PAIRS_SQL = """
pairs AS (SELECT from_state, to_state, count(*) AS n FROM (
  SELECT event_type AS from_state, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS to_state FROM events)
  WHERE to_state IS NOT NULL GROUP BY ALL)
"""


def _transitions(spark, sf_dir, valid=None):
    return Q.transition_counts(S.events(spark, sf_dir), ["user_id"], ORDER, "event_type", time_block("ts", BLOCK_SECONDS), valid)


@query(
    "transition_counts",
    """
SELECT from_state, to_state, count(*) AS n, sum(count(*)) OVER (PARTITION BY from_state)::BIGINT AS occurrences FROM (
  SELECT from_state, lead(from_state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS to_state FROM (
    SELECT *, CASE WHEN value >= 1 THEN event_type END AS from_state FROM events))
WHERE from_state IS NOT NULL AND to_state IS NOT NULL GROUP BY from_state, to_state
""",
)
def transition_counts(spark, sf_dir):
    counts = _transitions(spark, sf_dir, F.col("value") >= 1)
    upper = Window.partitionBy("from_state")
    return counts.withColumn("occurrences", F.sum("n").over(upper))


@query(
    "transition_matrix",
    f"WITH {PAIRS_SQL} SELECT from_state, to_state, n, {r('n / sum(n) OVER (PARTITION BY from_state)', 6)} AS p FROM pairs",
)
def transition_matrix(spark, sf_dir):
    return Q.transition_matrix(_transitions(spark, sf_dir), STATES).withColumn("p", C.rounded("p", 6))


@query(
    "transition_matrix_reversed",
    f"WITH {PAIRS_SQL} SELECT to_state AS from_state, from_state AS to_state, n, {r('n / sum(n) OVER (PARTITION BY to_state)', 6)} AS p FROM pairs",
)
def transition_matrix_reversed(spark, sf_dir):
    return Q.transition_matrix(_transitions(spark, sf_dir), STATES, reverse=True).withColumn("p", C.rounded("p", 6))


@query(
    "start_probabilities",
    f"WITH {PAIRS_SQL} SELECT from_state AS state, sum(n)::BIGINT AS n, {r('sum(n) / sum(sum(n)) OVER ()', 6)} AS p FROM pairs GROUP BY 1",
)
def start_probabilities(spark, sf_dir):
    return R.normalised(Q.occurrences(_transitions(spark, sf_dir)), [], "n", "p").withColumn("p", C.rounded("p", 6))


@query(
    "region_transitions",
    """
WITH v AS (SELECT label AS ap, CAST(vec_id % 3 AS INTEGER) AS ml, vec_id AS dv, label * 2 + CAST(embedding[1] > 0 AS INTEGER) AS label, embedding[2] > -0.2 AS mask FROM embeddings),
m AS (SELECT v.*, CASE WHEN mask THEN n_regionkey + 100 END AS region_id FROM v LEFT JOIN nation ON v.label = n_nationkey)
SELECT from_state, to_state, count(*) AS n FROM (
  SELECT region_id AS from_state, lead(region_id) OVER (PARTITION BY ap, ml ORDER BY dv) AS to_state FROM m)
WHERE from_state IS NOT NULL AND to_state IS NOT NULL GROUP BY ALL
""",
)
def region_transitions(spark, sf_dir):
    region_map, regions = S.region_tables(spark, sf_dir)
    volume = S.table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("ap"),
        (F.col("vec_id") % 3).cast("int").alias("ml"),
        F.col("vec_id").alias("dv"),
        (F.col("label") * 2 + (F.get("embedding", 0) > 0).cast("int")).alias("label"),
        (F.get("embedding", 1) > F.lit(-0.2).cast("double")).alias("mask"),
    )
    return B.region_transitions(volume, region_map, regions, "Cosmos", "mask", slab=65536)[0]


@query(
    "void_relabel",
    """
WITH h AS (SELECT user_id, min(ts) AS hull FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT event_id, user_id, CASE WHEN event_type = 'view' AND ts >= hull THEN 'void_fluid' ELSE event_type END AS event_type
FROM events LEFT JOIN h USING (user_id)
""",
)
def void_relabel(spark, sf_dir):
    ev = S.events(spark, sf_dir).select("event_id", "user_id", "ts", "event_type")
    surface = X.surface_of(ev, ["user_id"], "ts", F.col("event_type") == "error")
    out = X.relabel_below_surface(ev, surface, ["user_id"], "ts", "hull", "event_type", "view", "void_fluid")
    return out.select("event_id", "user_id", "event_type")


@query(
    "append_region",
    """
SELECT CAST(id AS BIGINT) AS id, acronym, ord, CAST(source.target_id AS BIGINT) AS cosmos_id FROM (
  SELECT n_nationkey AS id, n_name AS acronym, n_nationkey AS ord FROM nation
  UNION ALL SELECT 2000, 'void_fluid', 25 UNION ALL SELECT -2000, 'void_fluid', 25)
LEFT JOIN (SELECT n_nationkey AS source_id, n_regionkey + 100 AS target_id FROM nation UNION ALL SELECT 2000, 2000 UNION ALL SELECT -2000, 2000) source
ON id = source.source_id
""",
)
def append_region(spark, sf_dir):
    region_map, _ = S.region_tables(spark, sf_dir)
    regions = S.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("acronym"), F.col("n_nationkey").alias("ord")
    )
    wide_map = region_map.select(F.col("source_id").cast("long").alias("source_id"), "mapping", F.col("target_id").cast("long").alias("target_id"))
    new = {k: B.VOID_FLUID[k] for k in ("id", "acronym")}
    regions, wide_map, _ = B.add_region(regions, wide_map, new)
    cosmos = wide_map.filter("mapping = 'Cosmos'").select(F.col("source_id").alias("id"), F.col("target_id").alias("cosmos_id"))
    return regions.join(cosmos, "id", "left")


def _predicted(spark, sf_dir):
    ev = S.events(spark, sf_dir)
    pairs = next_value(ev.select("user_id", *ORDER, "event_type"), ["user_id"], ORDER, time_block("ts", BLOCK_SECONDS), {"event_type": "predicted"})
    return pairs.filter(F.col("predicted").isNotNull())


PREDICTED_SQL = """
pr AS (SELECT * FROM (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS predicted FROM events)
       WHERE predicted IS NOT NULL)
"""


@query(
    "confusion_matrix",
    f"""WITH {PREDICTED_SQL} SELECT event_type, predicted, count(*) AS n,
{r('count(*) / sum(count(*)) OVER (PARTITION BY event_type)', 6)} AS share FROM pr GROUP BY event_type, predicted""",
)
def confusion_matrix(spark, sf_dir):
    out = R.confusion_matrix(_predicted(spark, sf_dir), "event_type", "predicted", STATES)
    return out.withColumn("share", C.rounded("share", 6))


@query(
    "accuracy",
    f"WITH {PREDICTED_SQL} SELECT user_id, {r('avg(CAST(event_type = predicted AS INTEGER))', 6)} AS accuracy, count(*) AS n FROM pr GROUP BY 1",
)
def accuracy(spark, sf_dir):
    out = R.accuracy(_predicted(spark, sf_dir), "event_type", "predicted", ["user_id"])
    return out.withColumn("accuracy", C.rounded("accuracy", 6))


def _shares(spark, sf_dir, keys):
    ev = S.events(spark, sf_dir).withColumn("hour", F.hour("ts"))
    counts = ev.groupBy(*keys, "event_type").agg(F.count(F.lit(1)).alias("n"))
    return R.normalised(counts, keys, "n", "p")


@query(
    "cumulative_proba",
    f"""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
g AS (SELECT user_id, t.event_type FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest({STATE_SQL}) AS event_type) t),
p AS (SELECT user_id, event_type, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY user_id) AS p FROM g LEFT JOIN c USING (user_id, event_type))
SELECT user_id, event_type, {r('p', 6)} AS p, {r('sum(p) OVER (PARTITION BY user_id ORDER BY event_type)', 6)} AS cumulative FROM p
""",
)
def cumulative_proba(spark, sf_dir):
    out = R.cumulative_share(_shares(spark, sf_dir, ["user_id"]), ["user_id"], "event_type", "p", STATES, "cumulative")
    return out.withColumns({"p": C.rounded("p", 6), "cumulative": C.rounded("cumulative", 6)})


@query(
    "entropy_profile",
    f"""
WITH p AS (SELECT user_id, event_type, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM events GROUP BY user_id, event_type)
SELECT user_id, {r('sum(-p * log2(p)) / 5', 6)} AS entropy FROM p GROUP BY 1
""",
)
def entropy_profile(spark, sf_dir):
    out = R.mean_entropy(_shares(spark, sf_dir, ["user_id"]), ["user_id"], "p", len(STATES))
    return out.withColumn("entropy", C.rounded("entropy", 6))


@query(
    "fold_mean",
    f"""
WITH f AS (SELECT user_id, event_id % 5 AS fold, event_type, count(*) / sum(count(*)) OVER (PARTITION BY user_id, event_id % 5) AS p FROM events GROUP BY user_id, event_id % 5, event_type)
SELECT k.user_id, c.event_type, {r('coalesce(sum(p), 0) / any_value(k.k)', 6)} AS p
FROM (SELECT user_id, count(DISTINCT fold) AS k FROM f GROUP BY 1) k
CROSS JOIN (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS event_type) c
LEFT JOIN f ON f.user_id = k.user_id AND f.event_type = c.event_type GROUP BY ALL
""",
)
def fold_mean(spark, sf_dir):
    counts = S.events(spark, sf_dir).groupBy("user_id", (F.col("event_id") % 5).alias("fold"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    shares = R.normalised(counts, ["user_id", "fold"], "n", "p")
    filled = R.cumulative_share(shares, ["user_id", "fold"], "event_type", "p", STATES, "_c")
    return R.depth_aggregate(filled, ["user_id", "event_type"], ["p"]).withColumn("p", C.rounded("p", 6))


@query(
    "top_class",
    """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT DISTINCT ON (user_id) user_id, event_type AS top FROM c ORDER BY user_id, n DESC, event_type
""",
)
def top_class(spark, sf_dir):
    return R.top_class(_shares(spark, sf_dir, ["user_id"]), ["user_id"], "event_type", "p", "top")


@query(
    "depth_predictions",
    f"""
WITH n AS (SELECT user_id AS pid, hour(ts) AS channel, event_type, count(*) AS n FROM events GROUP BY ALL),
predictions AS (SELECT pid, channel, event_type, n / sum(n) OVER (PARTITION BY pid, channel) AS p FROM n),
channels AS (SELECT DISTINCT user_id AS pid, hour(ts) AS channel, CAST(20 * (hour(ts) // 2) AS DOUBLE) AS axial_um FROM events WHERE hour(ts) <> 5)
SELECT pid, axial_um, event_type, {r('avg(p)', 6)} AS p FROM predictions JOIN channels USING (pid, channel) GROUP BY ALL
""",
)
def depth_predictions(spark, sf_dir):
    """Class shares per user (probe) and hour (channel) joined with the channels' depths, two to a depth and one unknown."""
    predictions = _shares(spark, sf_dir, ["user_id", "hour"]).withColumnsRenamed({"user_id": "pid", "hour": "channel"})
    hours = S.events(spark, sf_dir).select(F.col("user_id").alias("pid"), F.hour("ts").alias("channel")).distinct()
    channels = hours.filter("channel <> 5").withColumn("axial_um", F.floor(F.col("channel") / 2).cast("double") * 20)
    out = P.predictions_by_depth(channels, predictions, klass="event_type", proba="p")
    return out.withColumn("p", C.rounded("p", 6))


@query(
    "state_mode",
    """
WITH c AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT DISTINCT ON (user_id, day) user_id, CAST(day AS VARCHAR) AS day, event_type AS state, n FROM c ORDER BY user_id, c.day, n DESC, event_type
""",
)
def state_mode(spark, sf_dir):
    ev = S.events(spark, sf_dir).withColumn("day", F.to_date("ts").cast("string"))
    return R.modes(ev, ["user_id", "day"], "event_type")


@query(
    "state_histogram",
    f"""SELECT CAST(hour(ts) AS INTEGER) AS depth, event_type AS state, count(*) AS n,
{r('count(*) / sum(count(*)) OVER (PARTITION BY hour(ts))', 6)} AS share FROM events GROUP BY hour(ts), event_type""",
)
def state_histogram(spark, sf_dir):
    counts = S.events(spark, sf_dir).groupBy(F.hour("ts").alias("depth"), F.col("event_type").alias("state")).agg(F.count(F.lit(1)).alias("n"))
    return R.normalised(counts, ["depth"], "n", "share").withColumn("share", C.rounded("share", 6))


@query(
    "inverse_cdf",
    """
WITH p AS (SELECT event_type, count(*) / sum(count(*)) OVER () AS p FROM events GROUP BY 1),
c AS (SELECT event_type, sum(p) OVER (ORDER BY event_type) AS c FROM p)
SELECT event_id, min(CASE WHEN c.c > e.u THEN c.event_type END) AS drawn
FROM (SELECT event_id, (event_id * 7919 % 100003) / 100003.0::DOUBLE AS u FROM events) e, c GROUP BY 1
""",
)
def inverse_cdf(spark, sf_dir):
    ev = S.events(spark, sf_dir)
    counts = ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    cells = R.cumulative_share(
        R.normalised(counts, [], "n", "p").withColumn("whole", F.lit(0)), ["whole"], "event_type", "p", STATES, "c"
    )
    lookup = cells.agg(F.sort_array(F.collect_list(F.struct("c", "event_type")))).scalar()
    u = (F.col("event_id") * 7919 % 100003) / F.lit(100003.0)
    return ev.select("event_id", u.alias("u"), lookup.alias("_cells")).select(
        "event_id", Q.drawn_class("_cells", "u").alias("drawn")
    )


# A hidden-Markov model over the five states. Observation is the event type.
STAY = 0.6
EMISSION = np.full((5, 5), 0.08) + np.eye(5) * (0.68 - 0.08)
TRANSITION = np.full((5, 5), (1 - STAY) / 4) + np.eye(5) * (STAY - (1 - STAY) / 4)
START = np.array([0.3, 0.1, 0.2, 0.15, 0.25])


def _model() -> Q.HiddenMarkov:
    # Small unequal terms keep best paths unique, so engines cannot part on ties.
    i, j = np.indices((5, 5))
    t = TRANSITION + ((i * 5 + j) * 37 % 23) * 1e-3
    e = EMISSION + ((i * 5 + j) * 29 % 31) * 1e-3
    return Q.HiddenMarkov(e / e.sum(axis=1, keepdims=True), t / t.sum(axis=1, keepdims=True), START)


MODEL_SQL = """
t0 AS (SELECT i, j, CASE WHEN i = j THEN 0.6 ELSE 0.1 END + ((i * 5 + j) * 37 % 23) * 0.001 AS v FROM range(0, 5) a(i), range(0, 5) b(j)),
tm AS (SELECT i, j, CAST(v AS DOUBLE) / sum(CAST(v AS DOUBLE)) OVER (PARTITION BY i) AS v FROM t0),
e0 AS (SELECT i, j, CASE WHEN i = j THEN 0.68 ELSE 0.08 END + ((i * 5 + j) * 29 % 31) * 0.001 AS v FROM range(0, 5) a(i), range(0, 5) b(j)),
em AS (SELECT i, j, CAST(v AS DOUBLE) / sum(CAST(v AS DOUBLE)) OVER (PARTITION BY i) AS v FROM e0),
st AS (SELECT * FROM (VALUES (0, 0.3), (1, 0.1), (2, 0.2), (3, 0.15), (4, 0.25)) x(j, v))
"""


def _whole(p: str) -> str:
    """SQL of `kernels.whole_logs`; the model has no zeros."""
    return f"CAST(round(ln({p}) * 68719476736) AS BIGINT)"


def _viterbi_sql(obs: str, start: str = "SELECT DISTINCT k, j, v FROM ob, st") -> str:
    """Log-space decoding of `ob(k, pos, o)` by a recursive query; gives `path(k, pos, state)`.

    Scores are whole numbers; of equal ones the least state counts.
    """
    return f"""
{MODEL_SQL}, {obs}, begin AS ({start}), lt AS (SELECT i, j, {_whole('v')} AS v FROM tm), le AS (SELECT i, j, {_whole('v')} AS v FROM em),
last AS (SELECT k, max(pos) AS last FROM ob GROUP BY 1),
fwd AS (
  SELECT ob.k, 0::BIGINT AS pos, begin.j AS state, {_whole('begin.v::DOUBLE')} + le.v AS mu, -1 AS back
  FROM ob JOIN begin USING (k) JOIN le ON le.i = begin.j AND le.j = ob.o WHERE pos = 0
  UNION ALL
  SELECT k, pos, state, max(mu) AS mu, arg_max(back, mu * 8 - back) AS back FROM (
    SELECT fwd.k, ob.pos, lt.j AS state, fwd.mu + lt.v + le.v AS mu, fwd.state AS back
    FROM fwd JOIN ob ON ob.k = fwd.k AND ob.pos = fwd.pos + 1 JOIN lt ON lt.i = fwd.state JOIN le ON le.i = lt.j AND le.j = ob.o)
  GROUP BY k, pos, state),
best AS (SELECT fwd.k, arg_max(state, mu * 8 - state) AS state, max(mu) / 68719476736.0::DOUBLE AS score, any_value(last) AS last
  FROM fwd JOIN last ON fwd.k = last.k AND fwd.pos = last.last GROUP BY 1),
path AS (
  SELECT k, last AS pos, state FROM best
  UNION ALL
  SELECT path.k, path.pos - 1, fwd.back FROM path JOIN fwd ON fwd.k = path.k AND fwd.pos = path.pos AND fwd.state = path.state WHERE path.pos > 0)
"""


@query(
    "viterbi_path",
    "WITH RECURSIVE "
    + _viterbi_sql(
        f"""ob AS (SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
        list_position({STATE_SQL}, event_type) - 1 AS o FROM events)"""
    )
    + f" SELECT k AS user_id, pos AS position, path.state, {r('score')} AS log_score FROM path JOIN best USING (k)",
)
def viterbi_path(spark, sf_dir):
    ev = S.events(spark, sf_dir).select("user_id", *ORDER, L.class_position("event_type", STATES).cast("int").alias("o"))
    # Small chunks, so that every sequence has several of them.
    out = Q.decode(ev, ["user_id"], ORDER, "o", _model(), time_block("ts", BLOCK_SECONDS), chunk=32)
    return out.withColumn("log_score", C.rounded("log_score"))


@query(
    "hmm_path",
    "WITH RECURSIVE "
    + _viterbi_sql(
        f"""ob AS (SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS pos,
        list_position({STATE_SQL}, state) - 1 AS o FROM (
          SELECT DISTINCT ON (user_id, day) user_id, day, event_type AS state FROM (
            SELECT user_id, CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL)
          ORDER BY user_id, day, n DESC, event_type))"""
    )
    + f""" SELECT k AS user_id, string_agg(path.state::INTEGER::VARCHAR, ',' ORDER BY pos) AS path, {r('any_value(score)')} AS score
FROM path JOIN best USING (k) GROUP BY 1""",
)
def hmm_path(spark, sf_dir):
    """Decode the most frequent state of each day (depth) of each user (probe)."""
    ev = S.events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    daily = R.modes(ev, ["user_id", "day"], "event_type").withColumn("o", L.class_position("state", STATES).cast("int"))
    out = Q.decode_sequences(Q.packed_sequences(daily, ["user_id"], ["day"], "o"), "observed", _model(), log=True)
    return out.select(
        "user_id",
        F.array_join(F.transform("path", lambda s: s.cast("string")), ",").alias("path"),
        C.rounded("score").alias("score"),
    )


def _mixed_sql(x: str) -> str:
    """SQL of `sequence._mixed` for a UBIGINT below 2^32."""
    one = f"((xor({x}, {x} >> 16) * 2246822507) & 4294967295)"
    two = "((xor(a, a >> 13) * 3266489909) & 4294967295)"
    return f"list_transform(list_transform([{one}], lambda a: {two}), lambda b: xor(b, b >> 16))[1]"


@query(
    "hmm_sampled",
    "WITH RECURSIVE "
    + _viterbi_sql(
        f"""sh AS (SELECT user_id, hour(ts) AS hour, list_position({STATE_SQL}, event_type) - 1 AS s, count(*) AS n FROM events GROUP BY ALL),
dense AS (SELECT d.user_id, d.hour, j AS s, coalesce(n, 0) AS n FROM (SELECT DISTINCT user_id, hour FROM sh) d
  CROSS JOIN range(0, 5) q(j) LEFT JOIN sh ON sh.user_id = d.user_id AND sh.hour = d.hour AND sh.s = q.j),
cum AS (SELECT user_id, hour, s, sum(n) OVER (PARTITION BY user_id, hour ORDER BY s) / sum(n) OVER (PARTITION BY user_id, hour)::DOUBLE AS c,
               n / sum(n) OVER (PARTITION BY user_id, hour)::DOUBLE AS p FROM dense),
deep AS (SELECT user_id, hour, row_number() OVER (PARTITION BY user_id ORDER BY hour) - 1 AS pos FROM (SELECT DISTINCT user_id, hour FROM sh)),
keyed AS (SELECT user_id, {_mixed_sql("xor(('0x' || substr(md5(user_id::VARCHAR), 1, 8))::UBIGINT, 12345::UBIGINT)")} AS h
          FROM (SELECT DISTINCT user_id FROM sh)),
runs AS (SELECT user_id, run, {_mixed_sql("((h + run::UBIGINT) & 4294967295)")} AS h FROM keyed, range(0, 1000) r(run)),
draws AS (SELECT user_id, run, pos, hour, {_mixed_sql("((h + pos::UBIGINT) & 4294967295)")} / 4294967296.0::DOUBLE AS u
          FROM runs JOIN deep USING (user_id)),
ob AS (SELECT user_id * 1000 + run AS k, pos, least(count(*) FILTER (WHERE u >= c), 4) AS o
       FROM draws JOIN cum USING (user_id, hour) GROUP BY user_id, run, pos)""",
        "SELECT user_id * 1000 + run AS k, s AS j, p AS v FROM runs JOIN deep USING (user_id) JOIN cum USING (user_id, hour) WHERE pos = 0 AND p > 0",
    )
    + """, counts AS (SELECT k // 1000 AS user_id, hour::DOUBLE AS depth, state::INTEGER AS state, count(*) AS n
  FROM path JOIN deep ON deep.user_id = k // 1000 AND deep.pos = path.pos GROUP BY ALL)
SELECT user_id, depth, state, n, floor(n / sum(n) OVER (PARTITION BY user_id, depth)::DOUBLE * 1e6 + 0.5) / 1e6 AS share,
       first(state) OVER (PARTITION BY user_id, depth ORDER BY n DESC, state) AS mode FROM counts""",
)
def hmm_sampled(spark, sf_dir):
    """Sampled decoding of class shares per user (probe) and hour (depth), with the default number of runs."""
    shares = _shares(spark, sf_dir, ["user_id", "hour"])
    profiles = Q.packed_profiles(shares, ["user_id"], "hour", "event_type", "p", STATES)
    counts = Q.sampled_histogram(profiles, ["user_id"], _model())
    histogram = R.normalised(counts, ["user_id", "depth"], "n", "share").withColumn("share", C.rounded("share", 6))
    mode = R.modes_of_counts(counts, ["user_id", "depth"], "state", "mode").drop("n")
    return histogram.join(mode, ["user_id", "depth"])


def _training_rows(spark, sf_dir):
    rows = S.table(spark, sf_dir, "embeddings").withColumn("pid", F.floor(F.col("vec_id") / 20))
    folds = L.grouped_folds(rows, "pid", 5)
    return rows.join(folds, "pid").select(
        "pid", F.col("vec_id").alias("channel"), "label", "fold", *[F.get("embedding", i).cast("double").alias(f"x{i}") for i in range(64)]
    )


@query("train_infer_folds")
def train_infer_folds(spark, sf_dir):
    """Grouped-fold training, then inference by every fold's model; invariants in the tests."""
    rows = _training_rows(spark, sf_dir)
    result = L.train_folds(rows, [f"x{i}" for i in range(64)], "label", ["pid", "channel"])
    scored = L.infer_regions(rows, result.models, [result.meta] * 5, denoise=False)
    held = result.predictions.select("pid", "channel", F.col("fold").alias("held_out_fold"), "label", "predicted")
    return L.long_probabilities(scored, ["fold", "pid", "channel", "predicted_index"], result.classes).join(
        held, ["pid", "channel"]
    )

