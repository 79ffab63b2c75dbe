"""Queries on feature tables: joins, filters, aggregates, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from depthline.functions import columns as C
from depthline.operators import relational as R
from depthline.operators.ordered import dense_index, range_block
from depthline.plans import standins as S
from depthline.plans import tables as P
from depthline.plans.registry import query, r
from depthline.schemas import duplicate_keys, violations
from pyspark.sql import types as T


@query(
    "depth_aggregate",
    f"""
WITH raw AS (
  SELECT l_suppkey AS pid, l_linenumber AS depth, avg(l_quantity) AS q, avg(l_extendedprice) AS p, avg(l_discount) AS d,
         first(l_returnflag ORDER BY l_orderkey, l_partkey, l_shipdate, l_returnflag) AS f,
         first(l_partkey ORDER BY l_orderkey, l_partkey, l_shipdate) AS k
  FROM lineitem GROUP BY ALL),
clu AS (
  SELECT l_suppkey AS pid, l_linenumber AS depth, avg(l_quantity) AS q, avg(l_extendedprice) AS p, avg(l_tax) AS t,
         first(l_returnflag ORDER BY l_orderkey, l_partkey, l_shipdate, l_returnflag) AS f
  FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL)
SELECT raw.pid, raw.depth, {r('raw.q')} AS quantity_raw, {r('raw.p')} AS price_raw, {r('raw.d')} AS discount,
       raw.f AS flag_raw, raw.k AS part, {r('clu.q')} AS quantity_cluster, {r('clu.p')} AS price_cluster,
       {r('clu.t')} AS tax, clu.f AS flag_cluster
FROM raw JOIN clu USING (pid, depth)
""",
)
def depth_aggregate(spark, sf_dir):
    rows = S.table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_suppkey": "pid", "l_linenumber": "depth"})
    order = ["l_orderkey", "l_partkey", "l_shipdate"]
    joined = P.join_depths(
        rows,
        rows.filter("l_linestatus = 'F'"),
        ["pid", "depth"],
        {"l_quantity": "quantity_raw", "l_extendedprice": "price_raw", "l_discount": "discount"},
        {"l_returnflag": "flag_raw", "l_partkey": "part"},
        order,
        {"l_quantity": "quantity_cluster", "l_extendedprice": "price_cluster", "l_tax": "tax"},
        {"l_returnflag": "flag_cluster"},
        order,
    )
    measures = ["quantity_raw", "price_raw", "discount", "quantity_cluster", "price_cluster", "tax"]
    return joined.withColumns({c: C.rounded(c) for c in measures})


@query(
    "depth_mean_all",
    f"""
SELECT l_suppkey AS pid, l_linenumber AS depth, {r('avg(l_orderkey)')} AS l_orderkey, {r('avg(l_partkey)')} AS l_partkey,
       {r('avg(l_quantity)')} AS l_quantity, {r('avg(l_extendedprice)')} AS l_extendedprice,
       {r('avg(l_discount)')} AS l_discount, {r('avg(l_tax)')} AS l_tax
FROM lineitem GROUP BY ALL
""",
)
def depth_mean_all(spark, sf_dir):
    rows = S.table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_suppkey": "pid", "l_linenumber": "depth"})
    means = R.mean_of_numeric(rows, ["pid", "depth"])
    return means.select("pid", "depth", *[C.rounded(c).alias(c) for c in means.columns if c not in ("pid", "depth")])


def _event_shapes(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("double")
    v = F.col("value")
    return S.events(spark, sf_dir).select(
        F.col("user_id").alias("channel"),
        F.when(v > 200, F.lit(float("nan"))).otherwise(v).alias("alpha"),
        k.alias("peak_time_idx"),
        v.alias("peak_val"),
        (k + 5).alias("trough_time_idx"),
        (v * -0.5).alias("trough_val"),
        (k - 3).alias("tip_time_idx"),
        (v * -0.25).alias("tip_val"),
        (k + 10).alias("recovery_time_idx"),
        (v * 2).alias("depolarisation_slope"),
        (v * -3).alias("repolarisation_slope"),
        (v * 0.75).alias("recovery_slope"),
        F.when(F.col("event_type").isin("view", "click"), 1.0).otherwise(-1.0).alias("invert_sign_peak"),
    )


@query(
    "channel_event_features",
    f"""
WITH e AS (SELECT user_id AS channel, value AS v, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k,
           CASE WHEN value > 200 THEN NULL ELSE value END AS alpha,
           CASE WHEN event_type IN ('view', 'click') THEN 1.0 ELSE -1.0 END AS s FROM events)
SELECT channel, {r('avg(alpha)')} AS alpha_mean, {r('stddev_pop(alpha)')} AS alpha_std,
       {r('avg(v*2)')} AS depolarisation_slope, {r('avg(k-42)/64')} AS peak_time_secs, {r('avg(v)')} AS peak_val,
       {r('-avg(s)')} AS polarity, {r('avg(v*0.75)')} AS recovery_slope, {r('avg(k+10-42)/64')} AS recovery_time_secs,
       {r('avg(v*-3)')} AS repolarisation_slope, count(alpha) AS spike_count, {r('avg(k-3-42)/64')} AS tip_time_secs,
       {r('avg(v*-0.25)')} AS tip_val, {r('avg(k+5-42)/64')} AS trough_time_secs, {r('avg(v*-0.5)')} AS trough_val
FROM e GROUP BY channel
""",
)
def channel_event_features(spark, sf_dir):
    out = R.channel_event_features(_event_shapes(spark, sf_dir), ["channel"], 64.0)
    return out.select(
        *[F.col(c) if c in ("channel", "spike_count") else C.rounded(c).alias(c) for c in out.columns]
    )


@query(
    "feature_channel_join",
    f"""
WITH {S.TRACES_SQL},
f AS (SELECT pid, snippet, channel, CAST(embedding[1] AS DOUBLE) AS a, CASE WHEN embedding[2] <= 0.15 THEN CAST(embedding[2] AS DOUBLE) END AS b FROM tr),
c AS (SELECT pid, snippet, channel, axial_um, lateral_um, pid * 10 AS atlas_id FROM tr WHERE CAST(embedding[3] AS DOUBLE) > -0.1)
SELECT f.pid, f.snippet, f.channel, {r('f.a', 6)} AS a, {r('f.b', 6)} AS b, axial_um, lateral_um, atlas_id AS "Allen_id"
FROM f JOIN c USING (pid, snippet, channel) WHERE b IS NOT NULL
""",
)
def feature_channel_join(spark, sf_dir):
    rows = S.traces(spark, sf_dir)
    b = F.get("samples", 1).cast("double")
    features = rows.select(
        "pid", "snippet", "channel", F.get("samples", 0).cast("double").alias("a"), F.when(b <= 0.15, b).alias("b")
    )
    channels = rows.filter(F.get("samples", 2).cast("double") > -0.1).select(
        "pid", "snippet", "channel", "axial_um", "lateral_um", (F.col("pid") * 10).alias("atlas_id")
    )
    joined = features.join(channels, ["pid", "snippet", "channel"]).withColumnsRenamed({"atlas_id": "Allen_id"})
    return R.drop_incomplete(joined).withColumns({"a": C.rounded("a", 6), "b": C.rounded("b", 6)})


_PER_TYPE = ["click", "error", "purchase", "signup", "view"]


@query(
    "feature_outer_merge",
    "WITH "
    + ", ".join(
        f"{t} AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n_{t}, {r('avg(value)')} AS mean_{t} FROM events "
        f"WHERE event_type = '{t}' GROUP BY ALL)"
        for t in _PER_TYPE
    )
    + f" SELECT user_id, day, {', '.join(f'n_{t}, mean_{t}' for t in _PER_TYPE)} FROM {_PER_TYPE[0]} "
    + " ".join(f"FULL JOIN {t} USING (user_id, day)" for t in _PER_TYPE[1:]),
)
def feature_outer_merge(spark, sf_dir):
    """One set of features for each event type, over all events; most users lack some type on most days."""
    ev = S.events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    sets = [
        ev.filter(F.col("event_type") == t)
        .groupBy("user_id", "day")
        .agg(F.count(F.lit(1)).alias(f"n_{t}"), C.rounded(F.avg("value")).alias(f"mean_{t}"))
        for t in _PER_TYPE
    ]
    return R.outer_merge(sets, ["user_id", "day"])


@query(
    "region_remap",
    f"""
SELECT s_suppkey AS pid, s_nationkey AS "Allen_id", n_regionkey + 100 AS "Cosmos_id", r_name AS "Cosmos_acronym",
       CASE WHEN s_acctbal < 0 THEN NULL ELSE {r('s_acctbal')} END AS value
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
""",
)
def region_remap(spark, sf_dir):
    region_map, regions = S.region_tables(spark, sf_dir)
    rows = S.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("pid"),
        F.col("s_nationkey").alias("Allen_id"),
        F.when(F.col("s_acctbal") < 0, F.lit(float("-inf"))).otherwise(C.rounded("s_acctbal")).alias("value"),
    )
    return P.prepare_voltage(rows, "Cosmos", region_map, regions).select(
        "pid", "Allen_id", "Cosmos_id", "Cosmos_acronym", "value"
    )


@query(
    "region_exclusion",
    f"""
SELECT c_custkey, c_nationkey, {r('c_acctbal')} AS value FROM customer
WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE'))
""",
)
def region_exclusion(spark, sf_dir):
    nation, region = S.table(spark, sf_dir, "nation"), S.table(spark, sf_dir, "region")
    named = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("id"), F.col("r_name").alias("acronym")
    )
    kept = R.exclude_regions(S.table(spark, sf_dir, "customer"), "c_nationkey", named, ["ASIA", "EUROPE"])
    return kept.select("c_custkey", "c_nationkey", C.rounded("c_acctbal").alias("value"))


@query(
    "dropped_keys",
    "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
)
def dropped_keys(spark, sf_dir):
    customers = S.table(spark, sf_dir, "customer")
    ordered = S.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return R.missing_keys(customers, ordered, ["c_custkey"])


@query(
    "membership_split",
    """
WITH m AS (SELECT c_custkey AS o_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS position
           FROM customer WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer))
SELECT o_orderkey, o_custkey, position, position IS NOT NULL AS is_test FROM orders LEFT JOIN m USING (o_custkey)
""",
)
def membership_split(spark, sf_dir):
    customers = S.table(spark, sf_dir, "customer")
    first = customers.agg(F.min("c_mktsegment")).scalar()
    chosen = customers.filter(F.col("c_mktsegment") == first).select(F.col("c_custkey").alias("o_custkey"))
    members = dense_index(chosen, [], ["o_custkey"], None, "position")
    orders = S.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return R.membership_position(orders, "o_custkey", members, "position").withColumn(
        "is_test", F.col("position").isNotNull()
    )


@query(
    "member_rows",
    f"""
SELECT o_orderkey, {r('o_totalprice')} AS price FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)
""",
)
def member_rows(spark, sf_dir):
    rich = S.table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    kept = R.member_rows(S.table(spark, sf_dir, "orders"), rich, "o_custkey")
    return kept.select("o_orderkey", C.rounded("o_totalprice").alias("price"))


_VOLTAGE = ["rms_ap", "rms_lf", "peak_val", "trough_val", "trough_time_secs", "peak_time_secs"]


@query(
    "voltage_table",
    f"""
WITH {S.VOLTAGE_SQL}
SELECT pid, channel, axial_um, atlas_id AS "Allen_id", acronym AS "Allen_acronym", n_regionkey + 100 AS "Cosmos_id",
       r_name AS "Cosmos_acronym", pid AS pids, spike_count,
       {', '.join(f'{r(c)} AS {c}' for c in _VOLTAGE)}
FROM voltage JOIN channels USING (pid, channel) JOIN nation ON atlas_id = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE trough_val >= 0.039
""",
)
def voltage_table(spark, sf_dir):
    region_map, regions = S.region_tables(spark, sf_dir)
    raw = S.voltage(spark, sf_dir).withColumn(
        "trough_val", F.when(F.col("trough_val") < 0.039, F.lit(float("inf"))).otherwise(F.col("trough_val"))
    )
    out = P.voltage_table(raw, S.voltage_channels(spark, sf_dir), region_map, regions, "Cosmos")
    return out.withColumns({c: C.rounded(c) for c in _VOLTAGE})


@query(
    "modelling_table",
    f"""
WITH {S.VOLTAGE_SQL}
SELECT pid, channel, axial_um, atlas_id, acronym, n_regionkey + 100 AS cosmos_id, n_nationkey AS beryl_id, spike_count,
       {r('20*log10(rms_ap)')} AS rms_ap, {r('20*log10(rms_lf)')} AS rms_lf, {r('peak_val')} AS peak_val,
       {r('trough_val')} AS trough_val, {r('trough_time_secs')} AS trough_time_secs, {r('peak_time_secs')} AS peak_time_secs,
       {r('log10(spike_count+1)')} AS spike_count_log, {r('abs(peak_val/trough_val)')} AS peak_to_trough_ratio,
       {r('ln(abs(peak_val/trough_val))')} AS peak_to_trough_ratio_log,
       {r('trough_time_secs-peak_time_secs')} AS peak_to_trough_duration
FROM voltage JOIN channels USING (pid, channel) JOIN nation ON atlas_id = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name NOT IN ('AFRICA', 'MIDDLE EAST')
""",
)
def modelling_table(spark, sf_dir):
    region_map, regions = S.region_tables(spark, sf_dir)
    out = P.modelling_table(
        S.voltage(spark, sf_dir), S.voltage_channels(spark, sf_dir), region_map, regions, ("AFRICA", "MIDDLE EAST")
    )
    measures = _VOLTAGE + [
        "spike_count_log",
        "peak_to_trough_ratio",
        "peak_to_trough_ratio_log",
        "peak_to_trough_duration",
    ]
    return out.withColumns({c: C.rounded(c) for c in measures})


_SUMMARY = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "summary_stats",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r(f'quantile_cont({c}, 0.5)')} AS median, {r(f'quantile_cont({c}, 0.05)')} AS q05, "
        f"{r(f'quantile_cont({c}, 0.95)')} AS q95, {r(f'quantile_cont({c}, 0.95) - quantile_cont({c}, 0.05)')} AS dq FROM lineitem"
        for c in _SUMMARY
    ),
)
def summary_stats(spark, sf_dir):
    out = R.summary_statistics(S.table(spark, sf_dir, "lineitem"), _SUMMARY)
    return out.withColumns({c: C.rounded(c) for c in ("median", "q05", "q95", "dq")})


@query(
    "catalogue_filter",
    """
SELECT event_id, event_type, 'wide' AS list FROM events
WHERE lower(event_type) LIKE '%ur%' AND value < 50 AND regexp_extract(props, '([0-9]+)', 1) <> '42'
UNION ALL
SELECT event_id, event_type, 'prefixed' AS list FROM events
WHERE event_type LIKE 'si%' AND regexp_extract(props, '([0-9]+)', 1) = '7'
""",
)
def catalogue_filter(spark, sf_dir):
    ev = S.events(spark, sf_dir)
    wide = R.catalogue_filter(
        ev, project=("event_type", "UR"), below=("value", 50.0), not_json=("props", "$.k", "42")
    ).select("event_id", "event_type", F.lit("wide").alias("list"))
    prefixed = R.catalogue_filter(ev, json_equals=[("props", "$.k", "7")], prefix=("event_type", "si")).select(
        "event_id", "event_type", F.lit("prefixed").alias("list")
    )
    return R.stacked([wide, prefixed])


@query(
    "output_key",
    """
SELECT page_id, substr(md5(list_extract(string_split(url, '/'), -1)), 1, 12) AS file_key,
       printf('probe_%s_%08.1f_%04.1f', CAST(page_id AS VARCHAR), page_id * 10 + 0.26, (page_id % 90) + 0.13) AS snippet_key,
       printf('probe_None_%08.1f_%04.1f', page_id * 10 + 0.26, (page_id % 90) + 0.13) AS file_snippet_key
FROM pages
""",
)
def output_key(spark, sf_dir):
    start = F.col("page_id") * 10 + F.lit(0.26)
    length = (F.col("page_id") % 90) + F.lit(0.13)
    none = F.lit(None).cast("string")
    return S.table(spark, sf_dir, "pages").select(
        "page_id",
        C.probe_key(none, "url").alias("file_key"),
        C.snippet_key("page_id", start, length).alias("snippet_key"),
        C.snippet_key(none, start, length).alias("file_snippet_key"),
    )


@query(
    "next_fast_length",
    """
WITH m AS (
  SELECT CAST(pow(2, a) * pow(3, b) * pow(5, c) AS BIGINT) AS m
  FROM generate_series(0, 24) t1(a), generate_series(0, 15) t2(b), generate_series(0, 10) t3(c)
  WHERE pow(2, a) * pow(3, b) * pow(5, c) <= 16777216),
n AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders)
SELECT o_orderkey, n.n, m.m AS fast FROM n ASOF JOIN m ON m.m >= n.n
""",
)
def next_fast_length(spark, sf_dir):
    n = F.floor("o_totalprice").cast("bigint")
    return S.table(spark, sf_dir, "orders").select(
        "o_orderkey", n.alias("n"), C.next_fast_length(n).alias("fast")
    )


@query(
    "next_fast_length_large",
    """
WITH m AS (
  SELECT CAST(pow(2, a) * pow(3, b) * pow(5, c) AS BIGINT) AS m
  FROM generate_series(0, 40) t1(a), generate_series(0, 26) t2(b), generate_series(0, 18) t3(c)
  WHERE pow(2, a) * pow(3, b) * pow(5, c) <= 2199023255552),
n AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * 1000003 AS n FROM orders)
SELECT o_orderkey, n.n, m.m AS fast FROM n ASOF JOIN m ON m.m >= n.n
""",
)
def next_fast_length_large(spark, sf_dir):
    """Lengths far above 10^7, as of hours of samples."""
    n = F.floor("o_totalprice").cast("bigint") * 1_000_003
    return S.table(spark, sf_dir, "orders").select("o_orderkey", n.alias("n"), C.next_fast_length(n).alias("fast"))


@query(
    "index_with_gaps",
    """
WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 7 <> 0 THEN event_id END AS place FROM events)
SELECT event_id, user_id, place, row_number() OVER (PARTITION BY user_id ORDER BY place NULLS FIRST, event_id) - 1 AS position FROM e
""",
)
def index_with_gaps(spark, sf_dir):
    """Positions within a user where some rows have no order value: they stand first."""
    rows = S.table(spark, sf_dir, "events").select("event_id", "user_id")
    rows = rows.withColumn("place", F.when(F.col("event_id") % 7 != 0, F.col("event_id")))
    blocks = [range_block("place", 4096), range_block("event_id", 4096)]
    return dense_index(rows, ["user_id"], ["place", "event_id"], blocks, "position")


@query(
    "zscore_profile",
    f"""
WITH m AS (SELECT l_suppkey AS pid, l_linenumber AS depth, avg(l_quantity) AS q, avg(l_extendedprice) AS p FROM lineitem GROUP BY ALL)
SELECT pid, depth, {r('(q - avg(q) OVER w) / stddev_pop(q) OVER w')} AS quantity_z,
       {r('(p - avg(p) OVER w) / stddev_pop(p) OVER w')} AS price_z
FROM m WINDOW w AS (PARTITION BY pid)
""",
)
def zscore_profile(spark, sf_dir):
    rows = S.table(spark, sf_dir, "lineitem").withColumnsRenamed(
        {"l_suppkey": "pid", "l_linenumber": "depth", "l_quantity": "quantity", "l_extendedprice": "price"}
    )
    out = P.depth_profile(rows, ["quantity", "price"], ["pid"], "depth")
    return out.select("pid", "depth", C.rounded("quantity_z").alias("quantity_z"), C.rounded("price_z").alias("price_z"))


@query(
    "depth_extent",
    "SELECT l_suppkey AS pid, min(l_linenumber) AS depth_min, max(l_linenumber) AS depth_max FROM lineitem GROUP BY 1",
)
def depth_extent(spark, sf_dir):
    rows = S.table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "pid")
    return P.depth_extent(rows, ["pid"], "l_linenumber")


@query(
    "count_by_label",
    """
SELECT coalesce(quality, 0) AS quality, count(CASE WHEN n_chars > 200 THEN n_chars END) AS n_chars, count(lang) AS lang, count(toxic) AS toxic
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1
""",
)
def count_by_label(spark, sf_dir):
    documents, labels = S.table(spark, sf_dir, "documents"), S.table(spark, sf_dir, "labels")
    joined = documents.join(labels, "doc_id", "left").na.fill(0, ["quality"])
    known = joined.withColumn("n_chars", F.when(F.col("n_chars") > 200, F.col("n_chars")))
    return R.count_known(known, ["quality"], ["n_chars", "lang", "toxic"])


@query(
    "label_join",
    """
SELECT doc_id, coalesce(quality, 0) AS labels, coalesce(quality, 0) = 1 AS outside,
       CASE WHEN coalesce(quality, 0) = 0 THEN n_chars END AS n_chars FROM documents LEFT JOIN labels USING (doc_id)
""",
)
def label_join(spark, sf_dir):
    documents, labels = S.table(spark, sf_dir, "documents"), S.table(spark, sf_dir, "labels")
    joined = documents.join(labels.select("doc_id", F.col("quality").alias("labels")), "doc_id", "left")
    flagged = joined.na.fill(0, ["labels"]).withColumn("outside", F.col("labels") == 1)
    return R.null_unless_good(flagged, ["n_chars"]).select("doc_id", "labels", "outside", "n_chars")


@query(
    "sorted_features",
    f"SELECT p_partkey, {r('p_retailprice')} AS value FROM part",
)
def sorted_features(spark, sf_dir):
    rows = S.table(spark, sf_dir, "part").select("p_partkey", C.rounded("p_retailprice").alias("value"))
    return R.sorted_features(rows, "value", ascending=False)


@query(
    "schema_check",
    """
SELECT 'event_type' AS "column", count(*) AS n_bad FROM events
UNION ALL SELECT 'value', count(*) FROM events WHERE value > 300
""",
)
def schema_check(spark, sf_dir):
    rows = S.events(spark, sf_dir).withColumn("value", F.when(F.col("value") <= 300, F.col("value")))
    schema = T.StructType(
        [
            T.StructField("event_id", T.LongType(), False),
            T.StructField("event_type", T.DoubleType(), True),
            T.StructField("value", T.DoubleType(), False),
        ]
    )
    return violations(rows, schema)


@query(
    "key_check",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def key_check(spark, sf_dir):
    return duplicate_keys(S.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "trajectory_pick",
    f"""
SELECT DISTINCT ON (user_id) user_id, event_id, event_type, {r('value')} AS value FROM events
ORDER BY user_id, (event_type = 'purchase') DESC, ts, event_id
""",
)
def trajectory_pick(spark, sf_dir):
    picked = R.first_by_preference(
        S.events(spark, sf_dir),
        ["user_id"],
        F.col("event_type") == "purchase",
        ["ts", "event_id"],
        ["event_id", "event_type", "value"],
    )
    return picked.withColumn("value", C.rounded("value"))


@query(
    "symmetric_matrix",
    """
WITH p AS (SELECT a.n_nationkey AS i, b.n_nationkey AS j, CAST(count(*) AS DOUBLE) AS v FROM orders
           JOIN customer ON o_custkey = c_custkey JOIN nation a ON c_nationkey = a.n_nationkey
           JOIN nation b ON b.n_nationkey = o_orderkey % 25 GROUP BY ALL)
SELECT i, j, v FROM p WHERE i < j UNION ALL SELECT j, i, v FROM p WHERE i < j UNION ALL SELECT n_nationkey, n_nationkey, -1.0 FROM nation
""",
)
def symmetric_matrix(spark, sf_dir):
    pairs = (
        S.table(spark, sf_dir, "orders")
        .join(S.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").alias("i"), (F.col("o_orderkey") % 25).cast("int").alias("j"))
        .agg(F.count(F.lit(1)).alias("v"))
    )
    labels = S.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("i"))
    return R.symmetric_pairs(pairs, "i", "j", "v", labels, -1.0)


@query(
    "grouped_folds",
    """
SELECT c_custkey, CAST(least(floor((row_number() OVER (ORDER BY md5('12345:' || c_custkey), c_custkey) - 1) * 5 / (SELECT count(*) FROM customer)), 4) AS INTEGER) AS fold
FROM customer
""",
)
def grouped_folds(spark, sf_dir):
    from depthline.operators.learn import grouped_folds as folds

    return folds(S.table(spark, sf_dir, "customer"), "c_custkey", 5)


@query(
    "distinct_members",
    "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
)
def distinct_members(spark, sf_dir):
    per_user = S.events(spark, sf_dir).select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "user_id").distinct()
    return per_user.groupBy("day").agg(F.count(F.lit(1)).alias("users"))


