"""Queries on whole jobs: windows, feature merge, targets, files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from depthline.functions import columns as C
from depthline.operators import relational as R
from depthline.plans import features as J
from depthline.plans import queries_signal as SIG
from depthline.plans import standins as S
from depthline.plans.registry import ORACLES, query, r
from depthline.session import fresh_path
from depthline.sources import sinks, store
from depthline.streaming import snippets as T

KEY = ("pid", "snippet", "channel")


def _chunks(spark, sf_dir, size: int = 16):
    """The traces as a recording stored in chunks of `size` samples."""
    rows = S.traces(spark, sf_dir).withColumn("pid", F.concat_ws("-", "pid", "snippet"))
    parts = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("samples") - 1) / size).cast("int")),
        lambda i: F.struct(
            i.alias("chunk"), (i * size).cast("long").alias("n0"), F.slice("samples", i * size + 1, F.lit(size)).alias("samples")
        ),
    )
    return rows.select("pid", "channel", "fs", F.inline(parts))


@query(
    "snippet_window_scan",
    f"""
WITH {S.TRACES_SQL}
SELECT concat_ws('-', pid, snippet) AS pid, channel, count(*) AS n, {r('sum(x)')} AS total, {r('sum(x * (s - 19))')} AS moment
FROM sm WHERE s >= 19 AND s < 39 GROUP BY tr_key, channel
""".replace("GROUP BY tr_key, channel", "GROUP BY pid, snippet, channel"),
)
def snippet_window_scan(spark, sf_dir):
    """Window from 0.25 s (3 samples late) of 0.3 s: 19 samples, read as 20."""
    cut = store.time_window(_chunks(spark, sf_dir), S.FS, 0.25, 0.3, 16, latency=3)
    indexed = cut.select("pid", "channel", F.posexplode("samples").alias("i", "x"))
    return indexed.groupBy("pid", "channel").agg(
        F.count(F.lit(1)).alias("n"),
        C.rounded(F.sum(F.col("x").cast("double"))).alias("total"),
        C.rounded(F.sum(F.col("x").cast("double") * F.col("i"))).alias("moment"),
    )


@query(
    "window_validation",
    """
WITH n AS (SELECT user_id AS pid, count(*) AS ns FROM events GROUP BY 1)
SELECT pid, 'ap' AS band, CAST(pid % 7 - 1.0 AS DOUBLE) AS t_start, CAST(60 AS DOUBLE) AS duration,
       CASE WHEN pid % 7 - 1.0 < 0 THEN 'negative start' ELSE 'beyond the end' END AS reason
FROM n WHERE pid % 7 - 1.0 < 0 OR pid % 7 - 1.0 + 60 > ns / 1.0
""",
)
def window_validation(spark, sf_dir):
    recordings = S.events(spark, sf_dir).groupBy(F.col("user_id").alias("pid")).agg(
        F.count(F.lit(1)).alias("ns"), F.lit("ap").alias("band"), F.lit(1.0).alias("fs"), F.lit(385).alias("nc"), F.lit(1).alias("nsync")
    )
    requests = recordings.select("pid", (F.col("pid") % 7 - 1.0).alias("t_start"), F.lit(60.0).alias("duration"))
    return store.invalid_windows(requests, recordings)


@query(
    "compute_features",
    f"""SELECT * FROM ({ORACLES['band_power']}) FULL JOIN ({ORACLES['csd_features']}) USING (pid, snippet, channel)
FULL JOIN ({ORACLES['cor_ratio']}) USING (pid, snippet, channel) FULL JOIN ({ORACLES['spike_features']}) USING (pid, snippet, channel)""",
)
def compute_features(spark, sf_dir):
    rows = S.traces(spark, sf_dir)
    detection = {"threshold": SIG.THRESHOLD, "radius_um": SIG.RADIUS, "reach": SIG.REACH, "length": SIG.LENGTH}
    out = J.compute_features(
        rows, rows, destriped=True, fs_ap=S.FS, q=2, before=SIG.BEFORE, detection=detection
    )
    places = {"rms_ap": 6, "rms_lf_csd": 8}
    return out.withColumns({c: C.rounded(c, places.get(c, 4)) for c in out.columns if c not in (*KEY, "spike_count")})


def _framed_sql(source: str, size: int, fs: float, suffix: str) -> str:
    """Band powers of `source(pid, snippet, channel, s, x)` as means over frames of `size`, the last of 64 / 20 frames being longer."""
    signal = (
        f"sig AS (SELECT pid, snippet * 10 + fr AS snippet, channel, s - fr * {size} AS s, x, {size} + fr // 2 * {size // 5} AS n, "
        f"{fs} AS fs FROM (SELECT *, least(s // {size}, 2) AS fr FROM ({source})))"
    )
    bands, means = [], []
    for band, (low, high) in SIG.BANDS.items():
        c, w = (low + high) / 2.0, high - low
        weight = f"CASE WHEN abs(f-{c})<{w} THEN (1-cos(pi()*(1-abs(f-{c})/{w})))/2 ELSE 0 END"
        bands.append(f"sum(p*{weight})/nullif(sum({weight}),0) AS {band}")
        means.append(f"{r(f'10*log10(sum(n*{band})/sum(n) FILTER ({band} IS NOT NULL))')} AS psd_{band}{suffix}")
    return (
        f"{signal}, {SIG.SPECTRUM_SQL}, part AS (SELECT pid, snippet // 10 AS snippet, channel, "
        f"{size} + snippet % 10 // 2 * {size // 5} AS n, {', '.join(bands)} FROM psd GROUP BY pid, snippet, channel), "
        f"square AS (SELECT pid, snippet, channel, {r('sqrt(avg(x * x))', 8 if suffix else 4)} AS rms_lf{suffix} FROM ({source}) GROUP BY ALL) "
        f"SELECT pid, snippet, channel, any_value(rms_lf{suffix}) AS rms_lf{suffix}, {', '.join(means)} "
        "FROM part JOIN square USING (pid, snippet, channel) GROUP BY ALL"
    )


_LOW_SQL = f"""{SIG.SM}, {SIG._fir_sql(2)}, low AS (SELECT pid, snippet, channel, axial_um, lateral_um, k AS s, y AS x, n // 2 AS n FROM fir),
{SIG.CSD_CORE.format(source='low')}"""


@query(
    "whole_recordings",
    f"""SELECT concat_ws('-', pid, snippet) AS pid, channel, * EXCLUDE (pid, snippet, channel) FROM (
WITH {SIG.SM}, {_framed_sql('SELECT pid, snippet, channel, s, x FROM sm', 20, 64.0, '')})
LEFT JOIN (WITH {_LOW_SQL}, {_framed_sql('SELECT pid, snippet, channel, s, y AS x FROM csd WHERE y IS NOT NULL', 10, 32.0, '_csd')}) USING (pid, snippet, channel)
FULL JOIN ({ORACLES['cor_ratio']}) USING (pid, snippet, channel) FULL JOIN ({ORACLES['spike_features']}) USING (pid, snippet, channel)""",
)
def whole_recordings(spark, sf_dir):
    """All sets of recordings used to their end: three frames of 20, 20 and 24 samples each."""
    chunks = _chunks(spark, sf_dir)
    layout = S.traces(spark, sf_dir).select(F.concat_ws("-", "pid", "snippet").alias("pid"), "channel", "axial_um", "lateral_um")
    bands = [chunks.select("pid").distinct().select("pid", F.lit(b).alias("band")) for b in ("ap", "lf")]
    recordings = bands[0].unionByName(bands[1]).select(
        "*", F.lit(64).alias("ns"), F.lit(S.FS).alias("fs"), F.lit(385).alias("nc"), F.lit(1).alias("nsync")
    )
    detection = {"threshold": SIG.THRESHOLD, "radius_um": SIG.RADIUS, "reach": SIG.REACH, "length": SIG.LENGTH}
    out = J.compute_windows(
        chunks, chunks, recordings, layout, chunk_samples={"ap": 16, "lf": 16}, lf_latency=0, frame_samples={"ap": 20, "lf": 20},
        destriped=True, fs_ap=S.FS, q=2, before=SIG.BEFORE, detection=detection,
    ).drop("snippet")
    places = {"rms_ap": 6, "rms_lf_csd": 8}
    return out.withColumns({c: C.rounded(c, places.get(c, 4)) for c in out.columns if c not in ("pid", "channel", "spike_count")})


@query(
    "input_shape_check",
    f"""
WITH {S.TRACES_SQL}
SELECT pid, snippet, count(*) AS n_ap, count(*) AS placed_ap, CAST(64 AS DOUBLE) AS fs_ap, count(*) FILTER (CAST(embedding[1] AS DOUBLE) < 0.25) AS n_lf,
       count(*) FILTER (CAST(embedding[1] AS DOUBLE) < 0.25) AS placed_lf, CAST(64 AS DOUBLE) AS fs_lf
FROM tr GROUP BY ALL HAVING count(*) <> count(*) FILTER (CAST(embedding[1] AS DOUBLE) < 0.25)
""",
)
def input_shape_check(spark, sf_dir):
    rows = S.traces(spark, sf_dir)
    return J.unfit_recordings(rows, rows.filter(F.get("samples", 0).cast("double") < 0.25))


@query(
    "target_coordinates",
    f"""
WITH {S.TRACES_SQL},
t AS (SELECT DISTINCT ON (label) label AS pid, embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y, embedding[3]::DOUBLE * 1000 AS z,
        200 + abs(embedding[4]::DOUBLE) * 1000 AS depth, abs(embedding[5]::DOUBLE) * 100 AS theta, embedding[6]::DOUBLE * 300 AS phi
      FROM embeddings ORDER BY label, (vec_id % 5 = 3) DESC, vec_id),
u AS (SELECT *, sin(radians(theta)) * sin(radians(phi)) AS uy, cos(radians(theta)) AS uz, sin(radians(theta)) * cos(radians(phi)) AS ux FROM t),
v AS (SELECT *, uy * cos(radians(-5.0)) - uz * sin(radians(-5.0)) AS vy, uy * sin(radians(-5.0)) + uz * cos(radians(-5.0)) AS vz FROM u),
k AS (SELECT *, x - depth * ux AS tx, y - depth * vy AS ty, z - depth * vz AS tz FROM v)
SELECT pid, snippet, channel, axial_um, {r('tx + (x - tx) * least(axial_um / depth, 1.0)')} AS x_target,
       {r('ty + (y - ty) * least(axial_um / depth, 1.0)')} AS y_target, {r('tz + (z - tz) * least(axial_um / depth, 1.0)')} AS z_target
FROM tr JOIN k USING (pid)
""",
)
def target_coordinates(spark, sf_dir):
    def dim(i):
        return F.get("embedding", i).cast("double")

    tracks = S.table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("pid"),
        F.when(F.col("vec_id") % 5 == 3, "Micro-manipulator").otherwise("Planned").alias("provenance"),
        F.col("vec_id").alias("pos"),
        *[(dim(i) * 1000).alias(a) for i, a in enumerate("xyz")],
        (F.abs(dim(3)) * 1000 + 200).alias("depth"),
        (F.abs(dim(4)) * 100).alias("theta"),
        (dim(5) * 300).alias("phi"),
    )
    channels = S.traces(spark, sf_dir).select(*KEY, "axial_um")
    out = J.add_target_coordinates(channels, tracks)
    return out.withColumns({f"{a}_target": C.rounded(f"{a}_target") for a in "xyz"})


@query(
    "feature_store_round_trip",
    f"""
WITH {S.TRACES_SQL} SELECT pid, snippet, channel, {r('sqrt(avg(x * x))', 6)} AS rms_lf FROM sm GROUP BY ALL
""",
)
def feature_store_round_trip(spark, sf_dir):
    """Write a set for part of the snippets, then reuse it and compute the others."""
    from depthline.operators.signal import rms_by_channel

    rows = S.traces(spark, sf_dir)
    wanted = rows.select("pid", "snippet").distinct()
    root = fresh_path(spark, "store")

    def compute(keys):
        return rms_by_channel(rows.join(keys, ["pid", "snippet"], "left_semi"), "rms_lf")

    sinks.write_features(compute(wanted.filter("pid >= 5")), root, "lf")
    stored = sinks.read_features(spark, root, "lf", like=rows)
    return sinks.reuse_or_compute(wanted, stored, compute).withColumn("rms_lf", C.rounded("rms_lf", 6))


@query(
    "store_windows",
    f"""
WITH {S.TRACES_SQL}, w AS (SELECT pid, snippet * 5000 + t AS snippet, channel, sum(x * x) AS e FROM sm, range(0, 2) q(t)
  WHERE s // 32 = t GROUP BY ALL)
SELECT pid, snippet, channel, {r('sqrt(e / 32)', 6)} AS rms_lf FROM w WHERE pid <> 3 OR snippet % 5000 = 1
""",
)
def store_windows(spark, sf_dir):
    """Store two windows of every probe, one probe after the others and one window twice, and read back what is asked for."""
    from depthline.operators.signal import rms_by_channel

    rows, root = S.traces(spark, sf_dir), fresh_path(spark, "store")
    for late in (0, 1):
        half = rows.withColumns({"snippet": F.col("snippet") * 5000 + late, "samples": F.slice("samples", 1 + 32 * late, 32)})
        sinks.write_features(rms_by_channel(half.filter("pid <> 3"), "rms_lf"), root, "lf", mode="overwrite")
        sinks.write_features(rms_by_channel(half.filter("pid = 3"), "rms_lf"), root, "lf", mode="overwrite")
    sinks.write_features(rms_by_channel(half, "rms_lf"), root, "lf", mode="overwrite")  # again
    most = sinks.read_features(spark, root, "lf").filter("pid <> 3")
    one = sinks.read_features(spark, root, "lf", pid=3).filter("snippet % 5000 = 1")
    return most.unionByName(one).withColumn("rms_lf", C.rounded("rms_lf", 6))


@query(
    "waveform_store",
    f"""WITH {SIG.SM}, {SIG.EVENT_SQL}, {SIG.LOCATED_SQL},
power AS (SELECT e.pid, e.snippet, e.channel, e.s, sum(t.x * t.x) AS energy FROM near e JOIN sm t
  ON t.pid = e.pid AND t.snippet = e.snippet AND t.channel = e.nb AND t.s BETWEEN e.s - {SIG.BEFORE} AND e.s - {SIG.BEFORE} + {SIG.LENGTH} - 1 GROUP BY ALL)
SELECT pid, snippet, channel, CAST(s AS INTEGER) AS sample, string_agg(nb::VARCHAR, ',' ORDER BY nb) AS neighbours, {SIG.LENGTH} AS length,
       {r('any_value(energy)')} AS energy, {r('any_value(ptp) FILTER (nb = channel)', 6)} AS ptp
FROM size JOIN power USING (pid, snippet, channel, s) GROUP BY ALL""",
)
def waveform_store(spark, sf_dir):
    """The job stores waveforms with their channel index and the events, twice; both are read back."""
    rows, root = S.traces(spark, sf_dir), fresh_path(spark, "store")
    detection = {"threshold": SIG.THRESHOLD, "radius_um": SIG.RADIUS, "reach": SIG.REACH, "length": SIG.LENGTH}
    for _ in range(2):
        J.compute_features(
            rows, rows, ["waveforms"], root, destriped=True, fs_ap=S.FS, before=SIG.BEFORE, detection=detection, save_waveforms=True
        )
    waveforms, events = sinks.read_waveforms(spark, root)
    energy = F.aggregate(
        F.flatten("waveform"), F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )
    key = [*KEY, "sample"]
    return waveforms.join(events.select(*key, "ptp"), key).select(
        *key,
        F.array_join(F.transform("neighbours", lambda c: c.cast("string")), ",").alias("neighbours"),
        F.array_max(F.transform("waveform", lambda w: F.size(w))).alias("length"),
        C.rounded(energy).alias("energy"),
        C.rounded("ptp", 6).alias("ptp"),
    )


@query(
    "correlogram_unpack",
    """
WITH c AS (SELECT event_type, hour(ts) AS cluster_id, day(ts) - 1 AS bin, count(*) AS n FROM events GROUP BY ALL)
SELECT t.event_type, CAST(h AS INTEGER) AS cluster_id, CAST(d AS INTEGER) AS bin, CAST(coalesce(n, 0) AS INTEGER) AS n
FROM (SELECT DISTINCT event_type FROM events) t CROSS JOIN range(0, 24) a(h) CROSS JOIN range(0, 31) b(d)
LEFT JOIN c ON c.event_type = t.event_type AND cluster_id = h AND bin = d
""",
)
def correlogram_unpack(spark, sf_dir):
    """Counts packed to flat int32 files, one per event type, and read back."""
    ev = S.events(spark, sf_dir)
    counts = ev.groupBy("event_type", F.hour("ts").alias("cluster_id"), (F.dayofmonth("ts") - 1).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    root = fresh_path(spark, "correlogram")
    sinks.write_flat_matrices(counts, root, "event_type", 24, 31)
    name = F.regexp_extract("path", r"([^/]+)\.bin$", 1)
    return store.read_flat_matrix(spark, root, 24, rows_per_task=10).select(name.alias("event_type"), "cluster_id", "bin", "n")


def _event_stream(spark, sf_dir):
    source = S.table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "stream_snippet_rms",
    f"""
WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, user_id, {r('sqrt(avg(value * value))')} AS rms, count(*) AS n FROM events GROUP BY 1, 2)
SELECT CAST(epoch(window_start) AS BIGINT) AS window_start, user_id, rms, n FROM w
WHERE epoch_ms(window_start) + 3600000 <= (SELECT max(epoch_ms(ts)) - 600000 FROM events)
""",
)
def stream_snippet_rms(spark, sf_dir):
    """Windows closed by the watermark, written by a stream and read back."""
    root = fresh_path(spark, "stream")
    features = T.snippet_rms(_event_stream(spark, sf_dir), "ts", ["user_id"], "value", "1 hour", "10 minutes")
    T.write_closed_windows(features, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    out = spark.read.schema(features.schema).parquet(f"{root}/out")
    return out.select(F.unix_seconds("window_start").alias("window_start"), "user_id", C.rounded("rms").alias("rms"), "n")


@query(
    "incremental_features",
    f"""SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, {r('sqrt(avg(value * value))')} AS rms, count(*) AS n FROM events GROUP BY ALL""",
)
def incremental_features(spark, sf_dir):
    """Snippets requested by a stream; those already stored are not computed again."""
    root = fresh_path(spark, "incremental")
    ev = S.events(spark, sf_dir).withColumn("day", F.to_date("ts").cast("string"))
    requests = _event_stream(spark, sf_dir).withColumn("day", F.to_date("ts").cast("string"))

    def compute(keys):
        rows = ev.join(keys, ["user_id", "day"], "left_semi")
        return rows.groupBy("user_id", "day").agg(
            C.rounded(F.sqrt(F.avg(F.col("value") * F.col("value")))).alias("rms"), F.count(F.lit(1)).alias("n")
        )

    for attempt, asked in (("some", requests.filter("event_type = 'purchase'")), ("all", requests)):
        T.compute_new_snippets(asked, f"{root}/out", f"{root}/{attempt}", compute, ["user_id", "day"]).awaitTermination()
    return spark.read.parquet(f"{root}/out").select("user_id", "day", "rms", "n")


@query(
    "columns_at_hand",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem",
)
def columns_at_hand(spark, sf_dir):
    """Projection by a feature list, keeping only the columns the table has."""
    rows = S.table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", *R.shared_columns(rows, ["l_quantity", "absent", "l_tax"]))
