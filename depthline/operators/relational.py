"""Joins, filters, aggregates and set operations on feature tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depthline.functions.columns import contains_ignoring_case, entropy_term, json_flag_is, known
from depthline.operators.quantiles import quantiles_of

# ---------------------------------------------------------------- joins


def join_channels(features: DataFrame, channels: DataFrame, *more: DataFrame) -> DataFrame:
    """Inner join on `(pid, channel)`; Spark picks the physical join from sizes."""
    return reduce(lambda left, right: left.join(right, ["pid", "channel"]), more, features.join(channels, ["pid", "channel"]))


def outer_merge(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer join of feature sets on their keys.

    Every table is hash-partitioned on the same keys, so a chain of n tables
    shuffles each of them once.
    """
    return reduce(lambda left, right: left.join(right, list(keys), "full"), tables)


def remap_regions(
    df: DataFrame, region_map: DataFrame, regions: DataFrame, mapping: str, source: str, target_prefix: str
) -> DataFrame:
    """Add `{prefix}_id` and `{prefix}_acronym` of a coarser hierarchy level.

    `region_map(source_id, mapping, target_id)` and `regions(id, acronym)` are
    small; whether they are broadcast is left to Spark's own size check.
    """
    lookup = (
        region_map.filter(F.col("mapping") == mapping)
        .join(regions.select(F.col("id").alias("target_id"), F.col("acronym").alias("_acronym")), "target_id", "left")
        .select(
            F.col("source_id").alias(source),
            F.col("target_id").alias(f"{target_prefix}_id"),
            F.col("_acronym").alias(f"{target_prefix}_acronym"),
        )
    )
    return df.join(lookup, source, "left")


def exclude_regions(df: DataFrame, column: str, regions: DataFrame, acronyms: Sequence[str]) -> DataFrame:
    """Drop rows whose region id carries one of the acronyms."""
    dropped = regions.filter(F.col("acronym").isin(list(acronyms))).select(F.col("id").alias(column)).distinct()
    return df.join(dropped, column, "left_anti")


def membership_position(df: DataFrame, column: str, members: DataFrame, position: str) -> DataFrame:
    """Add the position of `column` in `members(column, position)`, NULL when absent."""
    return df.join(members.select(column, position), column, "left")


def member_rows(df: DataFrame, members: DataFrame, column: str, keep: bool = True) -> DataFrame:
    return df.join(members.select(column).distinct(), column, "left_semi" if keep else "left_anti")


def missing_keys(wanted: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of `wanted` that `present` does not have."""
    return wanted.select(*keys).distinct().join(present.select(*keys).distinct(), list(keys), "left_anti")


# ---------------------------------------------------------------- filters


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(columns) if columns else None)


def null_unless_good(df: DataFrame, columns: Sequence[str], label: str = "labels") -> DataFrame:
    """Null the columns where the channel is not labelled 0 (or has no label)."""
    return df.withColumns({c: F.when(F.col(label) == 0, F.col(c)) for c in columns})


def catalogue_filter(
    df: DataFrame,
    project: tuple[str, str] | None = None,
    below: tuple[str, float] | None = None,
    not_json: tuple[str, str, str] | None = None,
    json_equals: Sequence[tuple[str, str, str]] = (),
    prefix: tuple[str, str] | None = None,
) -> DataFrame:
    """Rows of a catalogue of recordings that pass all the given conditions.

    project: (column, text) contained in any case; below: (column, limit);
    not_json / json_equals: (column, path, value); prefix: (column, text).
    """
    tests: list[Column] = []
    if project:
        tests.append(contains_ignoring_case(*project))
    if below:
        tests.append(F.col(below[0]) < F.lit(below[1]))
    if not_json:
        tests.append(~json_flag_is(*not_json))
    tests += [json_flag_is(*j) for j in json_equals]
    if prefix:
        tests.append(F.col(prefix[0]).startswith(prefix[1]))
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def first_by_preference(
    df: DataFrame, keys: Sequence[str], preferred: Column, order: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Per key, the first preferred row, or the first row where none is preferred.

    An aggregate rather than a ranked window: it combines map-side, so a key
    with very many rows costs one row per input task.
    """
    rank = F.struct(F.when(preferred, 0).otherwise(1).alias("_miss"), *[F.col(c) for c in order])
    row = F.struct(*[F.col(c) for c in columns])
    return df.groupBy(*keys).agg(F.min_by(row, rank).alias("_row")).select(*keys, "_row.*")


# ---------------------------------------------------------------- aggregates


def depth_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    means: Sequence[str] | Mapping[str, str],
    firsts: Sequence[str] | Mapping[str, str] = (),
    order: Sequence[str] = (),
    counts: Mapping[str, str] | None = None,
) -> DataFrame:
    """Means, first known values and counts per key; rows with a NULL key are dropped.

    Maps give `{source: new name}`. NULL and NaN do not enter the means. A
    first value is the known one of least `order`, whatever the partitioning.
    """
    means = means if isinstance(means, Mapping) else {c: c for c in means}
    firsts = firsts if isinstance(firsts, Mapping) else {c: c for c in firsts}
    if firsts and not order:
        raise ValueError("first values need an order")
    numbers = [F.avg(known(c)).alias(n) for c, n in means.items()]
    picks = [
        F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order, c))).alias(n) for c, n in firsts.items()
    ]
    tallies = [F.count(F.col(c)).alias(n) for c, n in (counts or {}).items()]
    kept = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.filter(kept).groupBy(*keys).agg(*numbers, *tallies, *picks)


def mean_of_numeric(df: DataFrame, keys: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Mean of every numeric column per key."""
    columns = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in keys and f.name not in exclude
    ]
    return depth_aggregate(df, keys, columns)


def count_known(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Number of known values of each column per key."""
    return df.groupBy(*keys).agg(*[F.count(F.col(c)).alias(c) for c in columns])


def summary_statistics(df: DataFrame, features: Sequence[str] | str) -> DataFrame:
    """`(feature, median, q05, q95, dq)`, one row per feature, exact."""
    features = [features] if isinstance(features, str) else list(features)
    quantiles = quantiles_of(df, [], features, [0.5, 0.05, 0.95])

    def at(p: float) -> Column:
        return F.max(F.when(F.col("prob") == p, F.col("quantile")))

    return (
        quantiles.groupBy("feature")
        .agg(at(0.5).alias("median"), at(0.05).alias("q05"), at(0.95).alias("q95"))
        .withColumn("dq", F.col("q95") - F.col("q05"))
    )


def sorted_features(df: DataFrame, value: str, ascending: bool = True) -> DataFrame:
    """Sort by a metric; NaN last when ascending and first when descending."""
    return df.orderBy(F.col(value).asc_nulls_last() if ascending else F.col(value).desc_nulls_first())


def channel_event_features(
    events: DataFrame, keys: Sequence[str], fs: float | Column, trough_offset: int = 42
) -> DataFrame:
    """The 14 waveform features of each channel from its detected events."""
    fs = F.lit(float(fs)) if isinstance(fs, (int, float)) else fs

    def seconds(index: str) -> Column:
        return (F.avg(known(index) - F.lit(float(trough_offset)))) / F.max(fs)

    def mean(name: str) -> Column:
        return F.avg(known(name))

    return events.groupBy(*keys).agg(
        mean("alpha").alias("alpha_mean"),
        F.stddev_pop(known("alpha")).alias("alpha_std"),
        mean("depolarisation_slope").alias("depolarisation_slope"),
        seconds("peak_time_idx").alias("peak_time_secs"),
        mean("peak_val").alias("peak_val"),
        (-mean("invert_sign_peak")).alias("polarity"),
        mean("recovery_slope").alias("recovery_slope"),
        seconds("recovery_time_idx").alias("recovery_time_secs"),
        mean("repolarisation_slope").alias("repolarisation_slope"),
        F.count(known("alpha")).alias("spike_count"),
        seconds("tip_time_idx").alias("tip_time_secs"),
        mean("tip_val").alias("tip_val"),
        seconds("trough_time_idx").alias("trough_time_secs"),
        mean("trough_val").alias("trough_val"),
    )


def modes(df: DataFrame, keys: Sequence[str], state: str, name: str = "state") -> DataFrame:
    """Most frequent state per key, the smallest one on ties, with its count."""
    counts = df.groupBy(*keys, state).agg(F.count(F.lit(1)).alias("n"))
    return modes_of_counts(counts, keys, state, name)


def modes_of_counts(counts: DataFrame, keys: Sequence[str], state: str, name: str = "state") -> DataFrame:
    best = F.min(F.struct((-F.col("n")).alias("_m"), F.col(state).alias("_s"))).alias("_best")
    return counts.groupBy(*keys).agg(best).select(*keys, F.col("_best._s").alias(name), (-F.col("_best._m")).alias("n"))


def top_class(df: DataFrame, keys: Sequence[str], klass: str, score: str, name: str) -> DataFrame:
    """Class of highest score per key; the first class in order wins ties."""
    best = F.min_by(klass, F.struct((-F.col(score)).alias("_s"), F.col(klass).alias("_k")))
    return df.groupBy(*keys).agg(best.alias(name))


def normalised(counts: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Share of `value` within the keys (or of the whole) of a counted table.

    A counted table holds at most one row per class and key, so the window
    over a key is as short as the class list and costs one shuffle of counts.
    """
    total = F.sum(value).over(Window.partitionBy(*keys)) if keys else counts.agg(F.sum(value)).scalar()
    return counts.withColumn(name, F.try_divide(F.col(value).cast("double"), total))


def dense_counts(counts: DataFrame, row: str, column: str, value: str, classes: Sequence) -> DataFrame:
    """Zero-filled `(row, column, value)` for all pairs of a short class list."""
    labels = F.array(*[F.lit(c) for c in classes])
    cells = counts.filter(F.col(row).isin(list(classes)) & F.col(column).isin(list(classes)))
    packed = cells.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(column, value))).alias("_cells"))
    axis = counts.sparkSession.range(1).select(F.explode(labels).alias(row))
    return axis.join(packed, row, "left").select(
        row, F.explode(labels).alias(column), "_cells"
    ).select(row, column, F.coalesce(F.try_element_at("_cells", F.col(column)), F.lit(0)).alias(value))


def confusion_matrix(df: DataFrame, truth: str, predicted: str, classes: Sequence) -> DataFrame:
    """`(truth, predicted, n, share)`, rows normalised, zero-filled."""
    counts = df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    return normalised(dense_counts(counts, truth, predicted, "n", classes), [truth], "n", "share")


def accuracy(df: DataFrame, truth: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    share = F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy")
    total = F.count(F.lit(1)).alias("n")
    return df.groupBy(*keys).agg(share, total) if keys else df.agg(share, total)


def cumulative_share(df: DataFrame, keys: Sequence[str], klass: str, share: str, classes: Sequence, name: str) -> DataFrame:
    """Running sum of class shares in class order, zero-filled over the classes.

    A row has as many entries as there are classes, so the sum is taken over an
    array per key and no window is needed.
    """
    labels = [F.lit(c) for c in classes]
    packed = df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(klass, share))).alias("_shares"))
    values = [F.coalesce(F.try_element_at("_shares", c), F.lit(0.0)) for c in labels]
    running, cells = F.lit(0.0), []
    for label, value in zip(labels, values):
        running = running + value
        cells.append(F.struct(label.alias(klass), value.alias(share), running.alias(name)))
    return packed.select(*keys, F.inline(F.array(*cells)))


def mean_entropy(df: DataFrame, keys: Sequence[str], share: str, n_classes: int, name: str = "entropy") -> DataFrame:
    """Mean over all classes of -p*log2(p); absent classes count as p = 0."""
    return df.groupBy(*keys).agg((F.sum(entropy_term(share)) / F.lit(float(n_classes))).alias(name))


def zscored(df: DataFrame, keys: Sequence[str], columns: Sequence[str], suffix: str = "_z") -> DataFrame:
    """Z-score (population deviation) of each column within the keys.

    Moments come from an aggregate that is joined back, so a large group is
    split by the adaptive skew join instead of sorting in one window task.
    """
    moments = df.groupBy(*keys).agg(
        *[F.avg(known(c)).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(known(c)).alias(f"_d_{c}") for c in columns]
    )
    return (
        df.join(moments, list(keys))
        .withColumns({f"{c}{suffix}": F.try_divide(known(c) - F.col(f"_m_{c}"), F.col(f"_d_{c}")) for c in columns})
        .drop(*[f"_m_{c}" for c in columns], *[f"_d_{c}" for c in columns])
    )


# ---------------------------------------------------------------- set operations


def symmetric_pairs(
    pairs: DataFrame, left: str, right: str, value: str, labels: DataFrame | None = None, diagonal: float | None = 0.0
) -> DataFrame:
    """Both triangles of a pair table given by its upper one, plus a diagonal.

    Only rows with left < right are used. The diagonal takes its keys from
    `labels(left)` or from the pairs themselves.
    """
    upper = pairs.filter(F.col(left) < F.col(right)).select(left, right, F.col(value).cast("double").alias(value))
    both = F.array(
        F.struct(F.col(left).alias(left), F.col(right).alias(right), F.col(value).alias(value)),
        F.struct(F.col(right).alias(left), F.col(left).alias(right), F.col(value).alias(value)),
    )
    full = upper.select(F.inline(both))
    if diagonal is None:
        return full
    if labels is None:
        labels = pairs.select(F.explode(F.array(left, right)).alias(left)).distinct()
    return full.unionByName(
        labels.select(F.col(left), F.col(left).alias(right), F.lit(float(diagonal)).alias(value))
    )


def stacked(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)


def shared_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The given names that `df` has, in the given order."""
    return [n for n in names if n in df.columns]


