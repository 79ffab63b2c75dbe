"""Ordered operations that stay balanced when one key holds most rows.

A plain window partitioned by the key sends a whole key to one task. Here each
key is cut into blocks by an expression that does not decrease along the order
(a time bucket, an id range). The window runs inside `(key, block)`; what has
to cross a block edge is one small row per block, computed by an aggregate with
map-side combine and joined back on the same `(key, block)` partitioning.
Rows with a NULL key are dropped; a NULL order value stands before all others,
in a block of its own, or in blocks of the next order column where two block
expressions are given. Without a key there is nothing to partition by:
`dense_index` then numbers the rows of a range-partitioned table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthline.session import materialise

_BLOCK = "_block"
_NULL_BLOCK = -(2**62)
#: `monotonically_increasing_id` counts the rows of a partition in its lowest bits.
_ROW_BITS = 33
#: Partitions whose counts one task adds up.
_FAN = 256


def time_block(ts, seconds: int) -> Column:
    """Bucket of a timestamp column, as a whole number."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("bigint")


def range_block(value, width: float) -> Column:
    """Bucket of a numeric column, as a whole number."""
    c = F.col(value) if isinstance(value, str) else value
    return F.floor(c / F.lit(width)).cast("bigint")


def _with_block(df: DataFrame, keys: Sequence[str], block: Column | Sequence[Column]) -> DataFrame:
    first, *rest = [block] if isinstance(block, Column) else list(block)
    placed = F.coalesce(first, F.lit(_NULL_BLOCK))
    if rest:  # rows without a place have their blocks by what they are ordered by next
        placed = F.struct(placed, F.when(first.isNull(), F.coalesce(rest[0], F.lit(_NULL_BLOCK))).otherwise(F.lit(0)))
    out = df.withColumn(_BLOCK, placed)
    for k in keys:
        out = out.filter(F.col(k).isNotNull())
    return out


def dense_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column | Sequence[Column] | None, name: str
) -> DataFrame:
    """Add the 0-based position of each row within its key, or in the whole table where there are no keys.

    `block` cuts a key into blocks; give two expressions, of the first and the
    second order column, where many rows have no first one. It isn't needed
    without keys.
    """
    if not keys:
        return _numbered(df, order, name)
    rows = _with_block(df, keys, block)
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(*keys, _BLOCK)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(across), F.lit(0)))
        .drop("_n")
    )
    return (
        rows.withColumn("_in", F.row_number().over(inside) - 1)
        .join(starts, [*keys, _BLOCK])
        .withColumn(name, (F.col("_in") + F.col("_start")).cast("bigint"))
        .drop("_in", "_start", _BLOCK)
    )


def _numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Positions in the whole table: rows are dealt to ranges, and a range starts after the rows of those before it.

    The ranges are written once, so that they are the same for the counts and
    for the rows. The counts, one for each partition, are added up in groups of
    `_FAN`, and the groups' sums in one row; that small table is broadcast.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = materialise(dealt.withColumn("_id", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_id", _ROW_BITS)
    counts = held.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_group", F.floor(F.col("_part") / _FAN))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_inside", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    sums = counts.groupBy("_group").agg(F.sum("_n").alias("_n"))
    listed = F.sort_array(F.collect_list(F.struct("_group", "_n")))
    running = F.aggregate(
        F.col("_l"),
        F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<struct<_group:bigint,_ahead:bigint>>").alias("out")),
        lambda a, x: F.struct(
            (a["sum"] + x["_n"]).alias("sum"),
            F.concat(a["out"], F.array(F.struct(x["_group"].alias("_group"), a["sum"].alias("_ahead")))).alias("out"),
        ),
    )
    ahead = sums.agg(listed.alias("_l")).select(F.inline(running["out"]))
    starts = counts.join(ahead, "_group").select("_part", (F.col("_inside") + F.col("_ahead")).alias("_start"))
    numbered = held.withColumn("_part", part).join(F.broadcast(starts), "_part")  # a row for each partition
    row = F.col("_id").bitwiseAND(F.lit(2**_ROW_BITS - 1))
    return numbered.withColumn(name, (row + F.col("_start")).cast("bigint")).drop("_id", "_part", "_start")


def next_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, columns: dict[str, str]
) -> DataFrame:
    """Add the following row's value within the key, `{source: new name}`."""
    rows = _with_block(df, keys, block)
    payload = F.struct(*[F.col(c).alias(n) for c, n in columns.items()])
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(_BLOCK)
    heads = (
        rows.groupBy(*keys, _BLOCK)
        .agg(F.min_by(payload, F.struct(*order)).alias("_head"))
        .withColumn("_head", F.lead("_head").over(across))
    )
    joined = rows.withColumn("_next", F.lead(payload).over(inside)).join(heads, [*keys, _BLOCK])
    following = F.coalesce(F.col("_next"), F.col("_head"))
    return joined.withColumn("_next", following).select(
        *df.columns, *[F.col(f"_next.{n}").alias(n) for n in columns.values()]
    )


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: str, name: str
) -> DataFrame:
    """Add the cumulative sum of `value` along the order within the key."""
    rows = _with_block(df, keys, block)
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(*keys, _BLOCK)
        .agg(F.sum(value).alias("_sum"))
        .withColumn("_start", F.coalesce(F.sum("_sum").over(across), F.lit(0)))
        .drop("_sum")
    )
    return (
        rows.withColumn("_in", F.sum(value).over(inside))
        .join(starts, [*keys, _BLOCK])
        .withColumn(name, F.col("_in") + F.col("_start"))
        .drop("_in", "_start", _BLOCK)
    )


def surrounding(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: str, before: str, after: str
) -> DataFrame:
    """Add the nearest known `value` at or before and strictly after each row.

    Rows where `value` is NULL are the ones to be filled. Both directions use a
    frame that only grows, so the cost is linear.
    """
    rows = _with_block(df, keys, block)
    ascending = [F.col(c).asc() for c in order]
    descending = [F.col(c).desc() for c in order]
    up_to_here = (
        Window.partitionBy(*keys, _BLOCK).orderBy(*ascending).rowsBetween(Window.unboundedPreceding, 0)
    )
    from_next = Window.partitionBy(*keys, _BLOCK).orderBy(*descending).rowsBetween(Window.unboundedPreceding, -1)
    position = F.when(F.col(value).isNotNull(), F.struct(*order))
    earlier = Window.partitionBy(*keys).orderBy(F.col(_BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.col(_BLOCK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        rows.groupBy(*keys, _BLOCK)
        .agg(F.max_by(value, position).alias("_tail"), F.min_by(value, position).alias("_head"))
        .withColumn("_carried", F.last("_tail", ignorenulls=True).over(earlier))
        .withColumn("_coming", F.last("_head", ignorenulls=True).over(later))
        .drop("_tail", "_head")
    )
    return (
        rows.withColumn("_b", F.last(value, ignorenulls=True).over(up_to_here))
        .withColumn("_a", F.last(value, ignorenulls=True).over(from_next))
        .join(edges, [*keys, _BLOCK])
        .withColumn(before, F.coalesce("_b", "_carried"))
        .withColumn(after, F.coalesce("_a", "_coming"))
        .drop("_a", "_b", "_carried", "_coming", _BLOCK)
    )
