"""Exact quantiles for groups of any size, by radix selection."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depthline.functions.columns import known
from depthline.session import materialise

#: Bits that a pass settles; a group has at most 2**BITS counts in a pass.
BITS = 16
_WIDTH = 64
_LOW = np.int64(2**63 - 1)


def order_numbers(values: np.ndarray) -> np.ndarray:
    """Doubles as signed 64-bit numbers in the same order; both zeros are one number."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ _LOW, bits)


def from_order_numbers(numbers: np.ndarray) -> np.ndarray:
    return np.where(numbers < 0, numbers ^ _LOW, numbers).view(np.float64)


@F.arrow_udf(T.ArrayType(T.LongType()))
def _numbered(*columns: pa.Array) -> pa.Array:
    """The order numbers of several columns as one array; NULL and NaN are NULL."""
    parts, masks = [], []
    for c in columns:
        v = c.to_numpy(zero_copy_only=False).astype(float)
        masks.append(np.isnan(v))
        parts.append(order_numbers(np.where(masks[-1], 0.0, v)))
    flat = pa.array(np.stack(parts, axis=1).ravel(), mask=np.stack(masks, axis=1).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(columns), dtype=np.int32)), flat)


@F.arrow_udf(T.DoubleType())
def _valued(numbers: pa.Array) -> pa.Array:
    return pa.array(from_order_numbers(numbers.to_numpy()))


def quantiles_of(df: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """`(keys..., feature, prob, quantile)` of all columns, with linear interpolation, as `percentile`.

    The built-in `percentile` keeps every distinct value of a group in one task.
    Here values become 64-bit numbers of the same order. Each of four passes
    counts 16 bits further, for the values that begin as a wanted rank does, and
    so finds the next 16 bits of every wanted value; the counts are the only rows
    that are shuffled. Without keys the beginnings are constants of the scan's
    filter, a few for each column; with keys they are a table that is joined.
    NULL and NaN don't count; a group without a known value has no rows.
    """
    keys, columns = list(keys), list(columns)
    parts = [*keys, "_c"]
    numbers = _numbered(*[known(F.col(c).cast("double")) for c in columns])
    rows = df.select(*keys, F.posexplode(numbers).alias("_c", "_o")).filter("_o is not null")

    def begin(shift: int) -> Column:
        return F.shiftright("_o", shift) if shift < _WIDTH else F.lit(0).cast("bigint")

    wanted = None
    for shift in range(_WIDTH - BITS, -1, -BITS):
        held = rows.withColumn("_from", begin(shift + BITS))
        if wanted is not None:
            held = _beginning_as(held, wanted, keys)
        counts = held.groupBy(*parts, "_from", begin(shift).alias("_next")).agg(F.count(F.lit(1)).alias("_n"))
        within = Window.partitionBy(*parts, "_from").orderBy("_next").rowsBetween(Window.unboundedPreceding, 0)
        upto = counts.withColumn("_upto", F.sum("_n").over(within))
        if wanted is None:
            wanted = _ranks(counts, parts, probs)
        found = upto.join(wanted, [*parts, "_from"]).filter(
            (F.col("_below") + F.col("_upto") > F.col("_rank")) & (F.col("_below") + F.col("_upto") - F.col("_n") <= F.col("_rank"))
        )
        wanted = materialise(
            found.select(
                *parts, "prob", "_side", "_share", "_rank", F.col("_next").alias("_from"), (F.col("_below") + F.col("_upto") - F.col("_n")).alias("_below")
            ),
            "ranks",
        )
    ends = wanted.withColumn("_v", _valued("_from")).groupBy(*parts, "prob").agg(
        F.max(F.when(F.col("_side") == 0, F.col("_v"))).alias("_at"),
        F.max(F.when(F.col("_side") == 1, F.col("_v"))).alias("_then"),
        F.max("_share").alias("_share"),
    )
    gap = F.when(F.col("_share") > 0, F.col("_share") * (F.col("_then") - F.col("_at"))).otherwise(0.0)
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("_c") + 1)
    return ends.select(*keys, name.alias("feature"), "prob", (F.col("_at") + gap).alias("quantile"))


def _ranks(counts: DataFrame, parts: list[str], probs: Sequence[float]) -> DataFrame:
    """The two ranks around each probability, from the number of values of each group."""
    listed = F.array(*[F.lit(float(p)) for p in probs])
    groups = counts.groupBy(*parts).agg(F.sum("_n").alias("_all")).withColumn("prob", F.explode(listed))
    place = F.col("prob") * (F.col("_all") - 1)
    sides = F.explode(F.array(F.lit(0), F.lit(1))).alias("_side")
    both = groups.select(*parts, "prob", "_all", (place - F.floor(place)).alias("_share"), F.floor(place).alias("_floor"), sides)
    rank = F.least(F.col("_floor") + F.col("_side"), F.col("_all") - 1)
    return both.select(*parts, "prob", "_side", "_share", rank.alias("_rank"), F.lit(0).cast("bigint").alias("_from"), F.lit(0).cast("bigint").alias("_below"))


def _beginning_as(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose first bits are those of a wanted rank of their group."""
    begins = wanted.select(*keys, "_c", "_from").distinct()
    if keys:
        return rows.join(begins, [*keys, "_c", "_from"], "left_semi")
    of_column: dict[int, list[int]] = defaultdict(list)
    for r in begins.collect():  # at most two for each column and probability
        of_column[r["_c"]].append(r["_from"])
    tests = [(F.col("_c") == c) & F.col("_from").isin(values) for c, values in of_column.items()]
    return rows.filter(reduce(lambda a, b: a | b, tests, F.lit(False)))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """`(keys..., prob, quantile)` of one column; see `quantiles_of`."""
    return quantiles_of(df, keys, [value], probs).drop("feature")
