"""The provided tables in the roles of recordings, channels, regions and states.

Every table is used whole. A probe (`label`) that holds very many channels is
cut into snippets of 384 channels, as a shank has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depthline.operators.ordered import dense_index, range_block
from depthline.operators.relational import depth_aggregate

CHANNELS = 384
FS = 64.0
# Lateral site positions of one shank in micrometres.
LATERAL_UM = (43, 11, 59, 27)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(pid, snippet, channel, axial_um, lateral_um, fs, samples)` from `embeddings`."""
    rows = table(spark, sf_dir, "embeddings").filter(F.col("label").isNotNull())
    placed = dense_index(rows, ["label"], ["vec_id"], range_block("vec_id", 65536), "_i")
    channel = (F.col("_i") % CHANNELS).cast("int")
    return placed.select(
        F.col("label").alias("pid"),
        F.floor(F.col("_i") / CHANNELS).cast("int").alias("snippet"),
        channel.alias("channel"),
        (F.floor(channel / 2) * 20).cast("double").alias("axial_um"),
        F.element_at(F.array(*[F.lit(float(x)) for x in LATERAL_UM]), (channel % 4) + 1).alias("lateral_um"),
        F.lit(FS).alias("fs"),
        F.col("embedding").alias("samples"),
        "vec_id",
    )


TRACES_SQL = """
tr AS (
  SELECT label AS pid, CAST(i // 384 AS INTEGER) AS snippet, CAST(i % 384 AS INTEGER) AS channel,
         CAST(20 * ((i % 384) // 2) AS DOUBLE) AS axial_um,
         CAST([43, 11, 59, 27][CAST(i % 384 % 4 + 1 AS INTEGER)] AS DOUBLE) AS lateral_um,
         embedding, vec_id
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i FROM embeddings WHERE label IS NOT NULL)
),
sm AS (
  SELECT pid, snippet, channel, axial_um, lateral_um, unnest(generate_series(0, len(embedding) - 1)) AS s,
         CAST(unnest(embedding) AS DOUBLE) AS x, len(embedding) AS n
  FROM tr
)
"""


def voltage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature table keyed `(pid, channel)` averaged from `lineitem`."""
    means = depth_aggregate(
        table(spark, sf_dir, "lineitem").withColumn("one", F.lit(1)),
        ["l_suppkey", "l_linenumber"],
        {
            "l_extendedprice": "rms_ap",
            "l_quantity": "rms_lf",
            "l_discount": "peak_val",
            "l_tax": "trough_val",
            "l_partkey": "trough_time_secs",
            "l_orderkey": "peak_time_secs",
        },
        counts={"one": "spike_count"},
    )
    return means.withColumnsRenamed({"l_suppkey": "pid", "l_linenumber": "channel"})


VOLTAGE_SQL = """
voltage AS (
  SELECT l_suppkey AS pid, l_linenumber AS channel, avg(l_extendedprice) AS rms_ap, avg(l_quantity) AS rms_lf,
         avg(l_discount) AS peak_val, avg(l_tax) AS trough_val, count(*) AS spike_count,
         avg(l_partkey) AS trough_time_secs, avg(l_orderkey) AS peak_time_secs
  FROM lineitem GROUP BY ALL
),
channels AS (
  SELECT DISTINCT l_suppkey AS pid, l_linenumber AS channel, CAST(20 * (l_linenumber // 2) AS DOUBLE) AS axial_um,
         s_nationkey AS atlas_id, n_name AS acronym
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
)
"""


def voltage_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel dimension of `voltage`, with the supplier's nation as region."""
    keys = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("pid"), F.col("l_linenumber").alias("channel")
    ).distinct()
    probes = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("s_suppkey").alias("pid"), F.col("s_nationkey").alias("atlas_id"), F.col("n_name").alias("acronym"))
    )
    return keys.join(probes, "pid").select(
        "pid", "channel", (F.floor(F.col("channel") / 2) * 20).cast("double").alias("axial_um"), "atlas_id", "acronym"
    )


def region_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """`(region_map, regions)`: nations map to regions (Cosmos) and to themselves (Beryl).

    Region ids of the two levels are kept apart by an offset of 100.
    """
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    cosmos = nation.select(
        F.col("n_nationkey").alias("source_id"), F.lit("Cosmos").alias("mapping"), (F.col("n_regionkey") + 100).alias("target_id")
    )
    beryl = nation.select(
        F.col("n_nationkey").alias("source_id"), F.lit("Beryl").alias("mapping"), F.col("n_nationkey").alias("target_id")
    )
    regions = nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("acronym")).unionByName(
        region.select((F.col("r_regionkey") + 100).alias("id"), F.col("r_name").alias("acronym"))
    )
    return cosmos.unionByName(beryl), regions
