"""State sequences: neighbour counts, most likely paths and sampled paths."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depthline.functions import kernels as K
from depthline.operators.ordered import dense_index, next_value
from depthline.operators.relational import dense_counts, normalised
from depthline.session import materialise

# ---------------------------------------------------------------- neighbour counts


def transition_counts(
    states: DataFrame, keys: Sequence[str], order: Sequence[str], state: str, block: Column, valid: Column | None = None
) -> DataFrame:
    """`(from_state, to_state, n)` over adjacent rows of each column.

    Adjacent means adjacent in the full column: rows that fail `valid` break a
    pair, they are not skipped.
    """
    checked = states.select(*keys, *order, F.when(valid, F.col(state)).alias("from_state") if valid is not None else F.col(state).alias("from_state"))
    pairs = next_value(checked, keys, order, block, {"from_state": "to_state"})
    known = F.col("from_state").isNotNull() & F.col("to_state").isNotNull()
    return pairs.filter(known).groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))


def occurrences(counts: DataFrame) -> DataFrame:
    """Pairs per upper state: `(state, n)`."""
    return counts.groupBy(F.col("from_state").alias("state")).agg(F.sum("n").alias("n"))


def transition_matrix(counts: DataFrame, classes: Sequence, reverse: bool = False) -> DataFrame:
    """Zero-filled row shares; `reverse` counts the pairs bottom-up."""
    if reverse:
        counts = counts.select(F.col("to_state").alias("from_state"), F.col("from_state").alias("to_state"), "n")
    return normalised(dense_counts(counts, "from_state", "to_state", "n", classes), ["from_state"], "n", "p")


@dataclass(frozen=True)
class HiddenMarkov:
    """Emission (K, M), transition (K, K) and start (K) probabilities; K is small."""

    emission: np.ndarray
    transition: np.ndarray
    start: np.ndarray

    def __post_init__(self):
        k = self.transition.shape[0]
        if self.transition.shape != (k, k) or self.emission.shape[0] != k or self.start.shape != (k,):
            raise ValueError("emission, transition and start disagree on the number of states")
        for name in ("transition", "emission"):
            if abs(getattr(self, name).sum(axis=1).mean() - 1.0) > 1e-9:
                raise ValueError(f"{name} rows must sum to 1")

    @property
    def reversed(self) -> "HiddenMarkov":
        up = self.transition.T
        total = up.sum(axis=1, keepdims=True)
        return HiddenMarkov(self.emission, np.divide(up, total, out=np.full_like(up, 1.0 / len(up)), where=total > 0), self.start)


def matrix_of(table: DataFrame, row: str, column: str, value: str, rows: Sequence, columns: Sequence) -> np.ndarray:
    """A dense matrix of a pair table over two short class lists."""
    out = np.zeros((len(rows), len(columns)))
    at_row, at_col = ({c: i for i, c in enumerate(names)} for names in (rows, columns))
    wanted = table.filter(F.col(row).isin(list(rows)) & F.col(column).isin(list(columns)))
    for r in wanted.select(row, column, value).collect():
        out[at_row[r[0]], at_col[r[1]]] = r[2]
    return out


# ---------------------------------------------------------------- most likely paths


def viterbi_by_expression(sequences: DataFrame, observed: str, model: HiddenMarkov) -> DataFrame:
    """Paths and linear probabilities with array expressions only.

    Suits short sequences; `decode` is the one for volume.
    """
    k = model.transition.shape[0]
    states = range(k)

    def number(v) -> Column:
        return F.lit(float(v))

    def emitted(o: Column) -> list[Column]:
        return [F.element_at(F.array(*[number(v) for v in model.emission[j]]), o.cast("int") + 1) for j in states]

    head = emitted(F.element_at(F.col(observed), 1))
    first = F.array(*[number(model.start[j]) * head[j] for j in states])
    no_steps = F.array(F.array(*[F.lit(0) for _ in states]))

    def step(acc: Column, o: Column) -> Column:
        reach = [[acc.mu[i] * number(model.transition[i, j]) for i in states] for j in states]
        best = [F.array_max(F.array(*reach[j])) for j in states]
        source = [F.array_position(F.array(*reach[j]), best[j]).cast("int") - 1 for j in states]
        seen = emitted(o)
        return F.struct(
            F.array(*[best[j] * seen[j] for j in states]).alias("mu"),
            F.concat(acc.back, F.array(F.array(*source))).alias("back"),
        )

    rest = F.slice(F.col(observed), 2, F.greatest(F.lit(0), F.size(observed) - 1))
    run = F.aggregate(rest, F.struct(first.alias("mu"), no_steps.alias("back")), step)
    forward = sequences.withColumn("_run", run).withColumn("probability", F.array_max("_run.mu"))
    last = F.array_position(F.col("_run.mu"), F.col("probability")).cast("int") - 1
    links = F.reverse(F.slice(F.col("_run.back"), 2, F.greatest(F.lit(0), F.size("_run.back") - 1)))
    walk = F.aggregate(links, F.array(last), lambda path, link: F.concat(F.array(F.element_at(link, path[0] + 1)), path))
    return forward.withColumn("path", walk).drop("_run")


def _grouped_by_length(observed: pd.Series) -> Iterator[np.ndarray]:
    lengths = observed.map(len).to_numpy()
    for n in np.unique(lengths):
        if n > 0:
            yield np.flatnonzero(lengths == n)


def path_function(model: HiddenMarkov, log: bool):
    """Arrow function from an array of observations to `(path, score)`."""

    @F.pandas_udf("path array<int>, score double")
    def paths(observed: pd.Series) -> pd.DataFrame:
        path = np.empty(len(observed), dtype=object)
        score = np.full(len(observed), np.nan)
        for at in _grouped_by_length(observed):
            found, value = K.viterbi(
                model.emission, model.transition, model.start, np.stack([observed.iat[i] for i in at]), log
            )
            score[at] = value
            for i, p in zip(at, found):
                path[i] = p
        return pd.DataFrame({"path": path, "score": score})

    return paths


def decode_sequences(sequences: DataFrame, observed: str, model: HiddenMarkov, log: bool = False) -> DataFrame:
    """Add `path` and `score` to rows that hold a whole sequence as an array."""
    return sequences.withColumn("_d", path_function(model, log)(F.col(observed))).select(
        *sequences.columns, "_d.path", "_d.score"
    )


def packed_sequences(df: DataFrame, keys: Sequence[str], order: Sequence[str], observed: str) -> DataFrame:
    """One array per key, in order. Meant for keys of bounded length, as the
    depths of one probe are; use `decode` for sequences of any length."""
    return df.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(*order, observed))), lambda s: s[observed]).alias("observed")
    )


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, k, k)


def _lists(rows: np.ndarray) -> pa.Array:
    """A list column with a row's numbers in each."""
    width = int(np.prod(rows.shape[1:]))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * width, pa.int32()), pa.array(rows.ravel()))


def _with_columns(batch: pa.RecordBatch, kept: Sequence[str], **more: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *more.values()], [*kept, *more])


def decode(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    observed: str,
    model: HiddenMarkov,
    block: Column,
    chunk: int = 4096,
    fan: int = 1024,
) -> DataFrame:
    """`(keys, position, state, log_score)` for sequences of any length, exact.

    A sequence is cut into chunks of at most `chunk` observations and no task
    holds more than one chunk:

    1. each chunk is summed up as a (K, K) matrix of best log scores from the
       state before it to the state at its end;
    2. the matrices are chained by max-plus products (two levels of at most
       `fan` and the rest), to give the scores with which each chunk is entered;
    3. with those scores each chunk runs the usual recursion and reports, per
       end state, the state it came from;
    4. these small maps are chained from the end, to give the end state;
    5. each chunk walks back from its end state.

    Scores are whole numbers, so a product is the same however it is put
    together: of equal paths, the one with the least state at the end, and then
    at each place before it, is found for every `chunk` and `fan`. There is one
    plan for all lengths; sequences of one chunk have no matrices to chain. The
    chunks, products, entry scores and maps are written once, as later steps read
    them several times. Chains run over sorted partitions, many sequences at a
    time, so that short ones cost no group of their own.
    """
    k = model.transition.shape[0]
    log_e, log_t, log_s = (K.whole_logs(a) for a in (model.emission, model.transition, model.start))
    key_fields = [df.schema[c] for c in keys]
    placed = dense_index(df.select(*keys, *order, observed), keys, order, block, "_pos")
    # Decoding is heavy for its bytes: name the partitions so that they are not merged by size.
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = materialise(
        placed.withColumn("_chunk", F.floor(F.col("_pos") / chunk).cast("long"))
        .repartition(spread, *keys, "_chunk")
        .groupBy(*keys, "_chunk")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("_pos", observed))), lambda s: s[observed].cast("int")).alias("_obs")),
        "chunks",
    )
    last = chunks.groupBy(*keys).agg(F.max("_chunk").alias("_last"))
    chunks = chunks.join(last, list(keys))

    def entry_rows(entry: pd.Series, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fresh = np.array([entry.iat[i] is None for i in at])
        rows = [np.zeros(k, np.int64) if new else np.asarray(entry.iat[i], np.int64) for i, new in zip(at, fresh)]
        return np.stack(rows), fresh

    def summaries(obs: pd.Series, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, off = np.empty((len(obs), k, k), np.int64), np.zeros(len(obs))
        for at, o in K.slices_of_equal_length(obs):
            new, later = at[fresh[at]], at[~fresh[at]]
            if len(new):
                mu, _, off[new] = K.log_forward(log_e, log_t, log_s, o[fresh[at]], np.zeros((len(new), k), np.int64), np.ones(len(new), dtype=bool))
                out[new] = mu[:, None, :]
            if len(later):
                out[later], off[later] = K.log_span(log_e, log_t, o[~fresh[at]])
        return out, off

    # 1-2: only sequences of several chunks need the chain.
    names = list(keys)
    matrix_schema = T.StructType(
        [
            *key_fields,
            T.StructField("_chunk", T.LongType()),
            T.StructField("_m", T.ArrayType(T.LongType())),
            T.StructField("_off", T.DoubleType()),
        ]
    )

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in batches:
            if not batch.num_rows:
                continue
            first = batch["_first"].to_numpy(zero_copy_only=False)
            if "_obs" in batch.schema.names:
                m, off = summaries(batch["_obs"].to_pandas(), batch["_chunk"].to_numpy() == 0)
            else:
                m, off = _matrix(batch["_m"], k), batch["_off"].to_numpy()
            m, off = K.running_products(first, m, off, carried)
            carried = m[-1], off[-1]
            yield _with_columns(batch, [*names, "_chunk"], _m=_lists(m), _off=pa.array(off))

    group = F.floor(F.col("_chunk") / fan).cast("long")
    inner = chunks.filter("_chunk < _last").withColumns({"_group": group, "_first": F.col("_chunk") % fan == 0})
    within = materialise(
        inner.repartition(spread, *keys, "_group").sortWithinPartitions(*keys, "_chunk").mapInArrow(products, matrix_schema), "products"
    )
    full = within.filter(F.col("_chunk") % fan == fan - 1).withColumn("_first", F.col("_chunk") == fan - 1)
    across = full.repartition(spread, *keys).sortWithinPartitions(*keys, "_chunk").mapInArrow(products, matrix_schema)
    ahead = across.select(
        *keys, (group + 1).alias("_group"), F.slice("_m", 1, k).alias("_before"), F.col("_off").alias("_taken")
    )

    @F.pandas_udf("e array<bigint>, off double")
    def entered(before: pd.Series, taken: pd.Series, m: pd.Series, off: pd.Series) -> pd.DataFrame:
        if not len(m):
            return pd.DataFrame({"e": [], "off": []})
        x = np.stack(m.to_list()).reshape(-1, k, k)
        rows, offs = x[:, 0].copy(), off.to_numpy(float).copy()
        late = np.flatnonzero(before.notna().to_numpy())
        if len(late):
            rows[late], top = K.max_plus(np.stack(before.iloc[late].to_list()).astype(np.int64), x[late])
            offs[late] += top + taken.to_numpy(float)[late]
        return pd.DataFrame({"e": list(rows), "off": offs})

    entries = materialise(
        within.withColumn("_group", group)
        .join(ahead, [*keys, "_group"], "left")
        .withColumn("_e", entered("_before", "_taken", "_m", "_off"))
        .select(*keys, (F.col("_chunk") + 1).alias("_chunk"), F.col("_e.e").alias("_entry"), F.col("_e.off").alias("_ahead")),
        "entries",
    )
    ready = chunks.join(entries, [*keys, "_chunk"], "left")

    # 3: the state before the chunk for each end state; the best end state of the last chunk.
    @F.pandas_udf("origin array<int>, best int, score double")
    def origins(obs: pd.Series, entry: pd.Series, ahead: pd.Series) -> pd.DataFrame:
        origin = np.empty(len(obs), dtype=object)
        best, score = np.zeros(len(obs), dtype="int32"), np.zeros(len(obs))
        before = ahead.fillna(0.0).to_numpy()
        for at, o in K.slices_of_equal_length(obs):
            mu, back, off = K.log_forward(log_e, log_t, log_s, o, *entry_rows(entry, at))
            top = mu.max(axis=1)
            best[at], score[at] = mu.argmax(axis=1), np.where(top < K.NEVER // 2, -np.inf, (before[at] + off + top) / K.LOG_UNIT)
            sources = np.stack([K.walk_back(back, np.full(len(at), end))[1] for end in range(k)], axis=1)
            for i, row in zip(at, sources):
                origin[i] = row.astype("int32")
        return pd.DataFrame({"origin": origin, "best": best, "score": score})

    maps = materialise(
        ready.withColumn("_o", origins("_obs", "_entry", "_ahead")).select(
            *keys, "_chunk", "_last", F.col("_o.origin").alias("_origin"), "_o.best", "_o.score"
        ),
        "maps",
    )
    ends = maps.filter("_chunk = _last").select(*keys, F.col("best").alias("_best"), F.col("score").alias("log_score"))

    # 4: chain the maps of chunks 1.._last from the end, in groups of `fan`.
    map_schema = T.StructType([*key_fields, T.StructField("_chunk", T.LongType()), T.StructField("_map", T.ArrayType(T.IntegerType()))])
    links_fields = T.StructType([*map_schema.fields, T.StructField("_last", T.LongType())])

    def from_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in batches:
            if not batch.num_rows:
                continue
            maps = batch["_map"].flatten().to_numpy().reshape(-1, k)
            maps = K.running_maps(batch["_first"].to_numpy(zero_copy_only=False), maps, carried)
            carried = maps[-1]
            yield _with_columns(batch, [*names, "_chunk"], _map=_lists(maps), _last=batch["_last"])

    def chained_from_end(df: DataFrame, *by) -> DataFrame:
        rows = df.repartition(spread, *by).sortWithinPartitions(*keys, F.desc("_chunk"))
        return rows.mapInArrow(from_end, links_fields)

    links = maps.filter("_chunk > 0").select(*keys, "_chunk", F.col("_origin").alias("_map"), "_last", group.alias("_group"))
    latest = F.least(F.col("_last"), (F.col("_group") + 1) * fan - 1)
    back_within = materialise(chained_from_end(links.withColumn("_first", F.col("_chunk") == latest), *keys, "_group"), "tails")
    whole = back_within.filter(F.col("_chunk") % fan == 0)
    back_across = chained_from_end(whole.withColumn("_first", group == F.floor(F.col("_last") / fan)), *keys).select(
        *keys, (group - 1).alias("_group"), F.col("_map").alias("_after")
    )
    exits = (
        back_within.drop("_last")
        .withColumn("_group", group)
        .join(back_across, [*keys, "_group"], "left")
        .join(ends, list(keys))
        .select(
            *keys,
            (F.col("_chunk") - 1).alias("_chunk"),
            F.get(
                "_map", F.when(F.col("_after").isNotNull(), F.get("_after", F.col("_best"))).otherwise(F.col("_best"))
            ).alias("_exit"),
        )
    )

    # 5: walk back inside each chunk.
    @F.pandas_udf("array<int>")
    def walked(obs: pd.Series, entry: pd.Series, end: pd.Series) -> pd.Series:
        out = np.empty(len(obs), dtype=object)
        for at, o in K.slices_of_equal_length(obs):
            _, back, _ = K.log_forward(log_e, log_t, log_s, o, *entry_rows(entry, at))
            for i, path in zip(at, K.walk_back(back, end.to_numpy()[at].astype(int))[0]):
                out[i] = path
        return pd.Series(out)

    return (
        ready.join(exits, [*keys, "_chunk"], "left")
        .join(ends, list(keys))
        .select(
            *keys,
            "_chunk",
            "log_score",
            F.posexplode(walked("_obs", "_entry", F.coalesce("_exit", "_best"))).alias("_i", "state"),
        )
        .select(*keys, (F.col("_chunk") * chunk + F.col("_i")).alias("position"), "state", "log_score")
    )


# ---------------------------------------------------------------- sampled paths


def packed_profiles(
    shares: DataFrame, keys: Sequence[str], depth: str, klass: str, share: str, classes: Sequence, deepest_last: bool = True
) -> DataFrame:
    """One row per key: depths in order and their class probabilities.

    A profile has one entry per depth of the probe, whatever the number of
    rows it was averaged from. Decoding runs in array order; where `depth` is a
    height above the tip, pass `deepest_last=False` to run from the surface down.
    """
    by_class = F.map_from_entries(F.collect_list(F.struct(klass, share)))
    rows = shares.groupBy(*keys, depth).agg(by_class.alias("_m")).select(
        *keys,
        F.col(depth).cast("double").alias("depth"),
        F.array(*[F.coalesce(F.try_element_at("_m", F.lit(c)), F.lit(0.0)).cast("double") for c in classes]).alias("p"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("depth", "p")), asc=deepest_last)
    return rows.groupBy(*keys).agg(ordered.alias("_profile")).select(
        *keys,
        F.transform("_profile", lambda s: s.depth).alias("depths"),
        F.transform("_profile", lambda s: s.p).alias("profile"),
    )


def drawn_class(cells, u, share: str = "c", klass: str = "event_type") -> Column:
    """First class whose cumulative share exceeds `u`; the last one at rounding ends.

    cells: array of structs with the cumulative share and the class, in class order.
    """
    cells, u = (F.col(c) if isinstance(c, str) else c for c in (cells, u))
    above = F.filter(cells, lambda s: s[share] > u)
    return F.coalesce(F.get(above, 0), F.element_at(cells, -1))[klass]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A mixing bijection of 32-bit numbers, in 64-bit ones."""
    m = np.uint64(0xFFFFFFFF)
    x = ((x ^ (x >> np.uint64(16))) * np.uint64(0x85EBCA6B)) & m
    x = ((x ^ (x >> np.uint64(13))) * np.uint64(0xC2B2AE35)) & m
    return x ^ (x >> np.uint64(16))


def drawn(key, seed: int, runs: np.ndarray, counters: np.ndarray) -> np.ndarray:
    """32-bit numbers that depend on key, seed, run and counter alone: one row for each run.

    `key` is one number, or one for each run.
    """
    m = np.uint64(0xFFFFFFFF)
    start = _mixed((np.atleast_1d(np.asarray(key)).astype(np.uint64) ^ np.uint64(seed & 0xFFFFFFFF)) & m)
    of_run = _mixed((start + runs.astype(np.uint64)) & m)
    return _mixed((of_run[:, None] + counters.astype(np.uint64)[None, :]) & m)


def key_number(keys: Sequence[str]) -> Column:
    """A 32-bit number of the key columns, from a digest of their texts."""
    texts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *texts).cast("binary")), 1, 8), 16, 10).cast("bigint")


def _sampled(p: np.ndarray, uniform: np.ndarray, row: np.ndarray | None = None) -> np.ndarray:
    """Inverse-CDF draws per depth of the profile `p`, or of `p[row[i]]` for each run; shares are normalised first."""
    if row is None:
        p, row = p[None], np.zeros(len(uniform), np.int64)
    total = p.sum(axis=2, keepdims=True)
    cumulative = np.cumsum(np.divide(p, total, out=np.full_like(p, 1.0 / p.shape[2]), where=total > 0), axis=2)
    chosen = np.zeros(uniform.shape, np.int64)
    for j in range(p.shape[2]):
        chosen += uniform >= cumulative[row, :, j]
    return np.minimum(chosen, p.shape[2] - 1)


def _normal(p: np.ndarray) -> np.ndarray:
    total = p.sum(axis=-1, keepdims=True)
    return np.divide(p, total, out=np.full_like(p, 1.0 / p.shape[-1]), where=total > 0)


#: Observations that are drawn and decoded at once.
_DRAWN_AT_ONCE = 200_000


def sampled_histogram(
    profiles: DataFrame,
    keys: Sequence[str],
    model: HiddenMarkov,
    n_runs: int = 1000,
    runs_per_task: int = 125,
    method: str = "one_way",
    seed: int = 12345,
) -> DataFrame:
    """`(keys, depth, state, n)`: decoded states over sampled observations.

    The runs of a probe are split into slices that Spark spreads over tasks.
    A task decodes the runs of many slices together and returns counts, not paths. A draw
    depends on key, run and place in the profile alone (`drawn`), so the result
    is the same for every `runs_per_task` and in a retried task. `two_ways`
    starts each run at a drawn depth between the first and the last; a profile
    of fewer than three depths has none and is decoded one way.
    """
    if method not in ("one_way", "two_ways"):
        raise ValueError("method must be one_way or two_ways")
    slices = [(i, min(runs_per_task, n_runs - i * runs_per_task)) for i in range(-(-n_runs // runs_per_task))]
    tasks = F.array(*[F.struct(F.lit(i).alias("slice"), F.lit(n).alias("runs")) for i, n in slices])
    # The work is heavy for its bytes, so its partitions must not be merged by size.
    spread = int(profiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = profiles.select(*keys, "depths", "profile", key_number(keys).alias("_key"), F.explode(tasks).alias("_task"))
    work = work.select(
        *keys, "depths", "profile", "_key", F.col("_task.slice").cast("bigint").alias("_slice"), F.col("_task.runs").cast("bigint").alias("_runs")
    ).repartition(spread, *keys, "_slice")
    names = list(keys)
    schema = T.StructType(
        [profiles.schema[c] for c in keys]
        + [
            T.StructField("depth", T.DoubleType()),
            T.StructField("state", T.IntegerType()),
            T.StructField("n", T.LongType()),
        ]
    )
    k = model.transition.shape[0]
    upward = model.reversed

    def decoded(p: np.ndarray, row: np.ndarray, obs: np.ndarray, spare: np.ndarray) -> np.ndarray:
        runs, nd = obs.shape
        if method == "one_way" or nd < 3:
            return K.viterbi(model.emission, model.transition, _normal(p[:, 0])[row], obs, log=True)[0]
        paths = np.empty((runs, nd), dtype=np.int32)
        starts = 1 + (spare % np.uint64(nd - 2)).astype(int)
        for at in np.unique(starts):
            mine = np.flatnonzero(starts == at)
            start = _normal(p[:, at])[row[mine]]
            paths[mine, at:] = K.viterbi(model.emission, model.transition, start, obs[mine, at:], log=True)[0]
            paths[mine, :at] = K.viterbi(model.emission, upward.transition, start, obs[mine, :at][:, ::-1], log=True)[0][:, ::-1]
        return paths

    def tallied(p: np.ndarray, key: np.ndarray, part: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, ...]:
        """Profile, place, state and number of the states that the runs of some profiles of equal length have."""
        nd = p.shape[1]
        row = np.repeat(np.arange(len(p)), runs)
        run = np.concatenate([i * runs_per_task + np.arange(n) for i, n in zip(part.tolist(), runs.tolist())])
        # One number for each depth, and one more for where a run starts.
        numbers = drawn(key[row], seed, run, np.arange(nd + 1))
        paths = decoded(p, row, _sampled(p, numbers[:, :-1] / 2.0**32, row), numbers[:, -1])
        cells = np.bincount((paths + k * (np.arange(nd)[None, :] + nd * row[:, None])).ravel(), minlength=len(p) * nd * k)
        hit = np.flatnonzero(cells)
        return hit // (nd * k), hit // k % nd, hit % k, cells[hit]

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch["profile"].offsets.to_numpy())
            shares = batch["profile"].flatten().flatten().to_numpy(zero_copy_only=False).astype(float)
            shares = shares.reshape(int(lengths.sum()), -1)
            depths = batch["depths"].flatten().to_numpy(zero_copy_only=False).astype(float)
            begin = np.cumsum(lengths) - lengths
            key, part, runs = (batch[c].to_numpy() for c in ("_key", "_slice", "_runs"))
            for nd in np.unique(lengths[lengths > 0]).tolist():
                same = np.flatnonzero(lengths == nd)
                step = max(1, _DRAWN_AT_ONCE // (nd * runs_per_task))
                for at in (same[i : i + step] for i in range(0, len(same), step)):
                    places = begin[at][:, None] + np.arange(nd)
                    row, depth, state, n = tallied(shares[places], key[at], part[at], runs[at])
                    yield _with_columns(
                        batch.select(names).take(pa.array(at[row])),
                        names,
                        depth=pa.array(depths[places[row, depth]]),
                        state=pa.array(state.astype(np.int32)),
                        n=pa.array(n.astype(np.int64)),
                    )

    return work.mapInArrow(sample, schema).groupBy(*keys, "depth", "state").agg(F.sum("n").alias("n"))
