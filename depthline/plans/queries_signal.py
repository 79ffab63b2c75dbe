"""Queries on traces: spectra, neighbours, referencing, events, geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from depthline.functions import arrays as A
from depthline.functions import columns as C
from depthline.operators import signal as G
from depthline.operators import spatial as X
from depthline.plans import standins as S
from depthline.plans.registry import query, r
from depthline.schemas import BANDS

KEY = ("pid", "snippet", "channel")
SM = S.TRACES_SQL

# Spectrum of `sig(pid, snippet, channel, s, x, n, fs)` by plain sums.
SPECTRUM_SQL = """
mean_x AS (SELECT pid, snippet, channel, avg(x) AS m, any_value(n) AS n, any_value(fs) AS fs FROM sig GROUP BY ALL),
psd AS (
  SELECT sig.pid, sig.snippet, sig.channel, k, k * any_value(sig.fs) / any_value(sig.n) AS f,
         (pow(sum((x - m) * cos(2 * pi() * k * s / sig.n)), 2) + pow(sum((x - m) * sin(2 * pi() * k * s / sig.n)), 2))
           * CASE WHEN k = 0 OR 2 * k = any_value(sig.n) THEN 1 ELSE 2 END / (any_value(sig.fs) * any_value(sig.n)) AS p
  FROM sig JOIN mean_x USING (pid, snippet, channel), range(0, 4096) t(k)
  WHERE k <= sig.n // 2 GROUP BY sig.pid, sig.snippet, sig.channel, k)
"""


def _lf_sql(suffix: str = "") -> str:
    """Select list that turns `psd` and `rms_x` into the lf features."""
    parts = []
    for band, (low, high) in BANDS.items():
        c, w = (low + high) / 2.0, high - low
        weight = f"CASE WHEN abs(f-{c})<{w} THEN (1-cos(pi()*(1-abs(f-{c})/{w})))/2 ELSE 0 END"
        db = f"10*log10(sum(p*{weight})/sum({weight}))"
        parts.append(f"{r(db)} AS psd_{band}{suffix}")
    return (
        f"SELECT pid, snippet, channel, {r('any_value(rms)')} AS rms_lf{suffix}, {', '.join(parts)} "
        "FROM psd JOIN rms_x USING (pid, snippet, channel) GROUP BY ALL"
    )


RMS_SQL = "rms_x AS (SELECT pid, snippet, channel, sqrt(avg(x * x)) AS rms FROM sig GROUP BY ALL)"
RAW_SIG = "sig AS (SELECT pid, snippet, channel, axial_um, lateral_um, s, x, n, 64.0 AS fs FROM sm)"


@query("rms_channel", f"WITH {SM} SELECT pid, snippet, channel, {r('sqrt(avg(x*x))', 6)} AS rms FROM sm GROUP BY ALL")
def rms_channel(spark, sf_dir):
    return G.rms_by_channel(S.traces(spark, sf_dir)).withColumn("rms", C.rounded("rms", 6))


@query("rms_over_chunks", f"WITH {SM} SELECT pid, {r('sqrt(avg(x*x))', 6)} AS rms FROM sm GROUP BY ALL")
def rms_over_chunks(spark, sf_dir):
    return G.rms_over_chunks(S.traces(spark, sf_dir), ["pid"]).withColumn("rms", C.rounded("rms", 6))


@query(
    "periodogram",
    f"WITH {SM}, {RAW_SIG}, {SPECTRUM_SQL} SELECT pid, snippet, channel, CAST(k AS INTEGER) AS k, {r('f')} AS frequency, "
    f"{r('p', 8)} AS density FROM psd",
)
def periodogram(spark, sf_dir):
    return G.spectrum(S.traces(spark, sf_dir)).withColumns(
        {"frequency": C.rounded("frequency"), "density": C.rounded("density", 8)}
    )


@query("band_power", f"WITH {SM}, {RAW_SIG}, {SPECTRUM_SQL}, {RMS_SQL} {_lf_sql()}")
def band_power(spark, sf_dir):
    out = G.lf_features(S.traces(spark, sf_dir))
    return out.withColumns({c: C.rounded(c) for c in out.columns if c not in KEY})


COV_SQL = """
nc AS (SELECT pid, snippet, max(channel) + 1 AS nc FROM tr GROUP BY ALL),
offs AS (
  SELECT pid, snippet, channel AS c, o, nc,
         CASE WHEN channel + o < 0 THEN -(channel + o) WHEN channel + o > nc - 1 THEN 2 * (nc - 1) - (channel + o) ELSE channel + o END AS nb
  FROM tr JOIN nc USING (pid, snippet), range(-8, 9) t(o)),
cov AS (
  SELECT pid, snippet, c, nb, o, any_value(nc) AS nc, sum(a.x * b.x) AS cov
  FROM offs JOIN sm a USING (pid, snippet) JOIN sm b USING (pid, snippet)
  WHERE a.channel = c AND b.channel = nb AND a.s = b.s AND (o = 0 OR nb <> c) GROUP BY ALL)
"""


@query(
    "neighbour_covariance",
    f"WITH {SM}, {COV_SQL} SELECT pid, snippet, c AS channel, CAST(nb AS INTEGER) AS neighbour, CAST(count(*) AS INTEGER) AS multiplicity, "
    f"{r('any_value(cov)', 6)} AS cov FROM cov GROUP BY ALL",
)
def neighbour_covariance(spark, sf_dir):
    out = G.neighbour_covariance(G.banded_covariance(S.traces(spark, sf_dir)))
    return out.drop("nc").withColumn("cov", C.rounded("cov", 6))


@query(
    "neighbour_covariance_narrow",
    f"WITH {SM}, {COV_SQL.replace('range(-8, 9)', 'range(-3, 4)')} SELECT pid, snippet, c AS channel, CAST(nb AS INTEGER) AS neighbour, "
    f"CAST(count(*) AS INTEGER) AS multiplicity, {r('any_value(cov)', 6)} AS cov FROM cov GROUP BY ALL",
)
def neighbour_covariance_narrow(spark, sf_dir):
    out = G.neighbour_covariance(G.banded_covariance(S.traces(spark, sf_dir), 3), half_width=3)
    return out.drop("nc").withColumn("cov", C.rounded("cov", 6))


@query(
    "cor_ratio",
    f"""WITH {SM}, {COV_SQL}, {RAW_SIG}, {RMS_SQL}
SELECT cov.pid, cov.snippet, c AS channel, {r('any_value(rms)', 6)} AS rms_ap,
       CASE WHEN any_value(nc) >= 13 THEN {r('avg(cov) / any_value(cov) FILTER (o = 0)')} END AS cor_ratio
FROM cov JOIN rms_x ON cov.pid = rms_x.pid AND cov.snippet = rms_x.snippet AND cov.c = rms_x.channel GROUP BY ALL""",
)
def cor_ratio(spark, sf_dir):
    out = G.ap_features(S.traces(spark, sf_dir))
    return out.withColumns({"rms_ap": C.rounded("rms_ap", 6), "cor_ratio": C.rounded("cor_ratio")})


def _fir_sql(q: int, source: str = "sm", name: str = "fir") -> str:
    h = 10 * q
    return f"""
taps AS (SELECT m, w / sum(w) OVER () AS h FROM (
  SELECT m, CASE WHEN m = 0 THEN 1.0 ELSE sin(pi() * m / {q}.0) / (pi() * m / {q}.0) END * (0.54 + 0.46 * cos(pi() * m / {h}.0)) AS w
  FROM range({-h}, {h + 1}) t(m))),
{name} AS (
  SELECT pid, snippet, channel, axial_um, lateral_um, CAST(k AS INTEGER) AS k, coalesce(sum(h * x), 0) AS y, any_value(n) AS n
  FROM {source}, range(0, 4096) t(k), taps WHERE k * {q} < n AND k * {q} - m = s GROUP BY ALL)
"""


@query(
    "fir_decimate",
    f"WITH {SM}, {_fir_sql(4)} SELECT pid, snippet, channel, k, {r('y', 6)} AS y FROM fir",
)
def fir_decimate(spark, sf_dir):
    out = G.decimate(S.traces(spark, sf_dir), 4).select(*KEY, F.posexplode("samples").alias("k", "y"))
    return out.withColumn("y", C.rounded("y", 6))


CSD_CORE = """
gaps AS (SELECT pid, snippet, lateral_um, median(g) AS dx FROM (
  SELECT pid, snippet, lateral_um, lead(axial_um) OVER (PARTITION BY pid, snippet, lateral_um ORDER BY axial_um) - axial_um AS g
  FROM tr) GROUP BY ALL),
second AS (
  SELECT pid, snippet, lateral_um, channel, axial_um, s,
         (lag(x) OVER w - 2 * x + lead(x) OVER w) / 3.0 AS d, n
  FROM {source} WINDOW w AS (PARTITION BY pid, snippet, lateral_um, s ORDER BY axial_um)),
csd AS (
  SELECT pid, snippet, channel, s, coalesce(d, lead(d) OVER w, lag(d) OVER w) / (dx * dx) AS y, n
  FROM second JOIN gaps USING (pid, snippet, lateral_um) WINDOW w AS (PARTITION BY pid, snippet, lateral_um, s ORDER BY axial_um))
"""


@query(
    "csd_second_difference",
    f"WITH {SM}, {CSD_CORE.format(source='sm')} SELECT pid, snippet, channel, CAST(s AS INTEGER) AS s, {r('y', 12)} AS csd FROM csd WHERE y IS NOT NULL",
)
def csd_second_difference(spark, sf_dir):
    out = G.current_source_density(S.traces(spark, sf_dir)).select(*KEY, F.posexplode("samples").alias("s", "csd"))
    return out.withColumn("csd", C.rounded("csd", 12))


@query(
    "csd_features",
    f"""WITH {SM}, {_fir_sql(2)}, low AS (SELECT pid, snippet, channel, axial_um, lateral_um, k AS s, y AS x, n // 2 AS n FROM fir),
{CSD_CORE.format(source='low')},
sig AS (SELECT pid, snippet, channel, s, y AS x, n, 32.0 AS fs FROM csd WHERE y IS NOT NULL),
{SPECTRUM_SQL}, {RMS_SQL}, found AS ({_lf_sql('_csd').replace(r('any_value(rms)'), r('any_value(rms)', 8))})
SELECT * FROM (SELECT pid, snippet, channel FROM tr) LEFT JOIN found USING (pid, snippet, channel)""",
)
def csd_features(spark, sf_dir):
    """Channels of columns with fewer than three sites have no density, and NULL features."""
    out = G.csd_features(S.traces(spark, sf_dir), q=2)
    return out.withColumns({c: C.rounded(c, 8 if c == "rms_lf_csd" else 4) for c in out.columns if c not in KEY})


@query(
    "median_reference",
    f"""WITH {SM} SELECT pid, snippet, channel, CAST(s AS INTEGER) AS s, {r('x - median(x) OVER (PARTITION BY pid, snippet, s)', 6)} AS x FROM sm""",
)
def median_reference(spark, sf_dir):
    rows = S.traces(spark, sf_dir).select(*KEY, "samples")
    out = G.median_reference(rows).select(*KEY, F.posexplode("samples").alias("s", "x"))
    return out.withColumn("x", C.rounded("x", 6))


def _with_labels(rows):
    """Dead where the last sample is high, unlabelled where the one before is low."""
    last, previous = (F.element_at("samples", i).cast("double") for i in (-1, -2))
    return rows.withColumn("labels", F.when(last > 0.2, 1).when(previous < -0.2, None).otherwise(0))


LABEL_SQL = (
    "CASE WHEN CAST(embedding[-1] AS DOUBLE) > 0.2 THEN 1 WHEN CAST(embedding[-2] AS DOUBLE) < -0.2 THEN NULL ELSE 0 END"
)


@query(
    "destripe",
    f"""WITH {SM}, lab AS (SELECT pid, snippet, channel, axial_um, lateral_um, coalesce({LABEL_SQL} = 0, false) AS good FROM tr),
near AS (SELECT b.pid, b.snippet, b.channel, g.channel AS nb, sqrt(pow(b.axial_um - g.axial_um, 2) + pow(b.lateral_um - g.lateral_um, 2)) AS d
  FROM lab b JOIN lab g USING (pid, snippet) WHERE NOT b.good AND g.good AND b.channel <> g.channel),
filled AS (SELECT near.pid, near.snippet, near.channel, s, sum(x / d) / sum(1 / d) AS x
  FROM near JOIN sm ON near.pid = sm.pid AND near.snippet = sm.snippet AND near.nb = sm.channel WHERE d <= 60 GROUP BY ALL),
whole AS (SELECT pid, snippet, channel, s, coalesce(filled.x, sm.x) AS x FROM sm LEFT JOIN filled USING (pid, snippet, channel, s))
SELECT pid, snippet, channel, CAST(s AS INTEGER) AS s, {r('x - median(x) OVER (PARTITION BY pid, snippet, s)', 6)} AS x FROM whole""",
)
def destripe(spark, sf_dir):
    rows = _with_labels(S.traces(spark, sf_dir))
    out = G.destripe(rows).select(*KEY, F.posexplode("samples").alias("s", "x"))
    return out.withColumn("x", C.rounded("x", 6))


@query(
    "quality_labels",
    f"""WITH {SM}, {RAW_SIG}, {SPECTRUM_SQL}, {RMS_SQL},
high AS (SELECT pid, snippet, channel, coalesce(sum(p) FILTER (f > 0.8 * 32) / nullif(sum(p), 0), 0) AS high FROM psd GROUP BY ALL),
prev AS (SELECT a.pid, a.snippet, a.channel, sum(a.x * b.x) / nullif(sum(a.x * a.x), 0) AS q FROM sm a JOIN sm b
         ON a.pid = b.pid AND a.snippet = b.snippet AND a.s = b.s AND b.channel = a.channel - 1 GROUP BY ALL),
m AS (SELECT pid, snippet, channel, rms, high, q, median(rms) OVER (PARTITION BY pid, snippet) AS med,
             max(CASE WHEN q < 0.1 THEN 0 ELSE 1 END) OVER (PARTITION BY pid, snippet ORDER BY channel DESC) AS run
      FROM rms_x JOIN high USING (pid, snippet, channel) LEFT JOIN prev USING (pid, snippet, channel))
SELECT pid, snippet, channel, {r('rms', 6)} AS rms, {r('high')} AS high, {r('q')} AS neighbour_ratio,
       CASE WHEN rms < 0.1 * med THEN 1 WHEN high > 0.3 OR rms > 1.15 * med THEN 2 WHEN run = 0 THEN 3 ELSE 0 END AS labels FROM m""",
)
def quality_labels(spark, sf_dir):
    out = G.quality_labels(S.traces(spark, sf_dir), noisy_above=1.15, high_share=0.3)
    return out.withColumns(
        {"rms": C.rounded("rms", 6), "high": C.rounded("high"), "neighbour_ratio": C.rounded("neighbour_ratio")}
    )


@query(
    "conditional_nulling",
    f"WITH {SM} SELECT pid, snippet, channel, CASE WHEN {LABEL_SQL} = 0 THEN {r('CAST(embedding[1] AS DOUBLE)', 6)} END AS value FROM tr",
)
def conditional_nulling(spark, sf_dir):
    from depthline.operators.relational import null_unless_good

    rows = _with_labels(S.traces(spark, sf_dir)).withColumn("value", F.get("samples", 0).cast("double"))
    return null_unless_good(rows, ["value"]).select(*KEY, C.rounded("value", 6).alias("value"))


# Events on the stand-in: threshold 2, +-3 samples, radius 60 um, 8 samples before of 17.
REACH, RADIUS, THRESHOLD, BEFORE, LENGTH = 3, 60.0, 2.0, 8, 17
EVENT_SQL = f"""
lvl AS (SELECT pid, snippet, channel, sqrt(avg(x * x)) AS rms FROM sm GROUP BY ALL),
around AS (
  SELECT pid, snippet, channel, axial_um, lateral_um, s, x, max(abs(x)) OVER w AS top, max(x) OVER w - min(x) OVER w AS ptp
  FROM sm WINDOW w AS (PARTITION BY pid, snippet, channel ORDER BY s ROWS BETWEEN {REACH} PRECEDING AND {REACH} FOLLOWING)),
cand AS (SELECT pid, snippet, channel, axial_um, lateral_um, s, x / rms AS z, ptp FROM around JOIN lvl USING (pid, snippet, channel)
         WHERE abs(x) >= {THRESHOLD} * rms AND abs(x) >= top),
ev AS (SELECT * FROM cand a WHERE NOT EXISTS (SELECT 1 FROM cand b WHERE a.pid = b.pid AND a.snippet = b.snippet
         AND abs(a.s - b.s) <= {REACH} AND sqrt(pow(a.axial_um - b.axial_um, 2) + pow(a.lateral_um - b.lateral_um, 2)) <= {RADIUS}
         AND (abs(b.z) > abs(a.z) OR (abs(b.z) = abs(a.z) AND b.channel < a.channel)))),
near AS (SELECT e.pid, e.snippet, e.channel, e.s, t.channel AS nb, t.axial_um, t.lateral_um FROM ev e JOIN tr t USING (pid, snippet)
         WHERE sqrt(pow(e.axial_um - t.axial_um, 2) + pow(e.lateral_um - t.lateral_um, 2)) <= {RADIUS})
"""


@query(
    "event_detection",
    f"WITH {SM}, {EVENT_SQL} SELECT pid, snippet, channel, CAST(s AS INTEGER) AS sample, {r('z')} AS z, {r('ptp', 6)} AS ptp FROM ev",
)
def event_detection(spark, sf_dir):
    found = G.strongest_events(G.candidate_events(S.traces(spark, sf_dir), THRESHOLD, REACH), RADIUS, REACH)
    return found.select(*KEY, "sample", C.rounded("z").alias("z"), C.rounded("ptp", 6).alias("ptp"))


LOCATED_SQL = f"""
-- Samples outside the snippet count as zero, as in the padded waveform.
size AS (SELECT near.pid, near.snippet, near.channel, near.s, near.nb, any_value(near.axial_um) AS y, any_value(near.lateral_um) AS x,
                greatest(max(sm.x), CASE WHEN count(*) < {2 * REACH + 1} THEN 0 ELSE max(sm.x) END)
                  - least(min(sm.x), CASE WHEN count(*) < {2 * REACH + 1} THEN 0 ELSE min(sm.x) END) AS ptp
         FROM near JOIN sm ON near.pid = sm.pid AND near.snippet = sm.snippet AND near.nb = sm.channel
              AND abs(sm.s - near.s) <= {REACH} GROUP BY ALL)
"""


@query(
    "event_location",
    f"""WITH {SM}, {EVENT_SQL}, {LOCATED_SQL}
SELECT pid, snippet, channel, CAST(s AS INTEGER) AS sample, {r('any_value(ptp) FILTER (nb = channel)', 6)} AS ptp,
       {r('sum(ptp * x) / sum(ptp)')} AS xloc, {r('sum(ptp * y) / sum(ptp)')} AS yloc, CAST(0 AS DOUBLE) AS zloc,
       {r('any_value(ptp) FILTER (nb = channel)', 6)} AS alpha, count(*) AS reached
FROM size GROUP BY ALL""",
)
def event_location(spark, sf_dir):
    events, waveforms = G.detect_events(S.traces(spark, sf_dir), THRESHOLD, RADIUS, REACH, BEFORE, LENGTH)
    reached = waveforms.groupBy(*KEY, "sample").agg(F.count(F.lit(1)).alias("reached"))
    out = events.drop("waveform").join(reached, [*KEY, "sample"])
    return out.withColumns(
        {
            "ptp": C.rounded("ptp", 6),
            "alpha": C.rounded("alpha", 6),
            "xloc": C.rounded("xloc"),
            "yloc": C.rounded("yloc"),
        }
    )


def _shape_sql(source: str, keys: str, fs: float) -> str:
    """Shapes of `source(keys, s, x, n)`, one waveform per key."""
    return f"""
pk AS (SELECT {keys}, arg_min(s, (-abs(x)) * 1000 + s * 1e-9) AS s0, any_value(n) AS n FROM {source} GROUP BY ALL),
pv AS (SELECT {keys}, s0, w.n, x AS peak, CASE WHEN x > 0 THEN 1.0 ELSE -1.0 END AS sg FROM pk JOIN {source} w USING ({keys}) WHERE w.s = s0),
tips AS (SELECT {keys}, arg_min(s, x * sg * 1000 + s * 1e-9) AS s1, min(x * sg) * any_value(sg) AS tip FROM {source} JOIN pv USING ({keys}) WHERE s <= s0 GROUP BY ALL),
trs AS (SELECT {keys}, arg_min(s, x * sg * 1000 + s * 1e-9) AS s2, min(x * sg) * any_value(sg) AS trough FROM {source} JOIN pv USING ({keys}) WHERE s >= s0 GROUP BY ALL),
rec AS (SELECT {keys}, least(s2 + 5, n - 1) AS s3 FROM trs JOIN pk USING ({keys})),
rv AS (SELECT {keys}, s3, x AS recovery FROM rec JOIN {source} USING ({keys}) WHERE s = s3),
shape AS (SELECT {keys}, s0, s1, s2, s3, peak, tip, trough, recovery, sg,
  (peak - tip) / nullif(s0 - s1, 0) * {fs} AS depol, (trough - peak) / nullif(s2 - s0, 0) * {fs} AS repol,
  (recovery - trough) / nullif(s3 - s2, 0) * {fs} AS recov
  FROM pv JOIN tips USING ({keys}) JOIN trs USING ({keys}) JOIN rv USING ({keys}))
"""


_KEYS = "pid, snippet, channel"


@query(
    "waveform_shape",
    f"""WITH {SM}, {_shape_sql('sm', _KEYS, 64.0)}
SELECT pid, snippet, channel, CAST(s0 AS INTEGER) AS peak_time_idx, {r('peak', 6)} AS peak_val, CAST(s1 AS INTEGER) AS tip_time_idx,
  {r('tip', 6)} AS tip_val, CAST(s2 AS INTEGER) AS trough_time_idx, {r('trough', 6)} AS trough_val,
  CAST(s3 AS INTEGER) AS recovery_time_idx, {r('recovery', 6)} AS recovery_val, {r('depol')} AS depolarisation_slope,
  {r('repol')} AS repolarisation_slope, {r('recov')} AS recovery_slope, CAST(-sg AS DOUBLE) AS invert_sign_peak FROM shape""",
)
def waveform_shape(spark, sf_dir):
    out = S.traces(spark, sf_dir).select(*KEY, A.waveform_shape("samples", S.FS).alias("_s")).select(*KEY, "_s.*")
    values = {c: C.rounded(c, 6) for c in out.columns if c.endswith("_val")}
    slopes = {c: C.rounded(c) for c in out.columns if c.endswith("_slope")}
    return out.withColumns({**values, **slopes})


_WF_KEYS = "pid, snippet, channel, sample"


@query(
    "spike_features",
    f"""WITH {SM}, {EVENT_SQL}, {LOCATED_SQL},
alpha AS (SELECT pid, snippet, channel, s AS sample, any_value(ptp) FILTER (nb = channel) AS alpha FROM size GROUP BY ALL),
wf AS (SELECT e.pid, e.snippet, e.channel, e.s AS sample, o AS s, {LENGTH} AS n, coalesce(sm.x, 0) AS x
  FROM ev e CROSS JOIN range(0, {LENGTH}) t(o) LEFT JOIN sm ON sm.pid = e.pid AND sm.snippet = e.snippet AND sm.channel = e.channel
       AND sm.s = e.s - {BEFORE} + o),
{_shape_sql('wf', _WF_KEYS, 64.0)}
SELECT pid, snippet, channel, {r('avg(alpha)')} AS alpha_mean, {r('stddev_pop(alpha)')} AS alpha_std, {r('avg(depol)')} AS depolarisation_slope,
  {r(f'avg(s0 - {BEFORE}) / 64')} AS peak_time_secs, {r('avg(peak)')} AS peak_val, {r('avg(sg)')} AS polarity, {r('avg(recov)')} AS recovery_slope,
  {r(f'avg(s3 - {BEFORE}) / 64')} AS recovery_time_secs, {r('avg(repol)')} AS repolarisation_slope, count(alpha) AS spike_count,
  {r(f'avg(s1 - {BEFORE}) / 64')} AS tip_time_secs, {r('avg(tip)')} AS tip_val, {r(f'avg(s2 - {BEFORE}) / 64')} AS trough_time_secs,
  {r('avg(trough)')} AS trough_val
FROM shape JOIN alpha USING (pid, snippet, channel, sample) GROUP BY ALL""",
)
def spike_features(spark, sf_dir):
    out = G.waveform_features(
        S.traces(spark, sf_dir), S.FS, BEFORE, threshold=THRESHOLD, radius_um=RADIUS, reach=REACH, length=LENGTH
    )
    return out.withColumns({c: C.rounded(c) for c in out.columns if c not in (*KEY, "spike_count")})


@query(
    "radius_neighbours",
    f"""WITH {SM} SELECT a.pid, a.snippet, a.channel, count(*) AS n, string_agg(CAST(b.channel AS VARCHAR), ',' ORDER BY b.channel) AS neighbours,
  {r('sum(b.lateral_um)')} AS sum_x, {r('sum(b.axial_um)')} AS sum_y, CAST(0 AS DOUBLE) AS sum_z
FROM tr a JOIN tr b USING (pid, snippet) WHERE sqrt(pow(a.axial_um - b.axial_um, 2) + pow(a.lateral_um - b.lateral_um, 2)) <= 60 GROUP BY ALL""",
)
def radius_neighbours(spark, sf_dir):
    rows = S.traces(spark, sf_dir)
    near = X.waveform_coordinates(rows.select(*KEY), rows, 60.0)

    def total(i):
        return C.rounded(F.aggregate("coordinates", F.lit(0.0), lambda acc, p: acc + p[i]))

    return near.select(
        *KEY,
        F.size("neighbours").cast("long").alias("n"),
        F.array_join(F.transform("neighbours", lambda c: c.cast("string")), ",").alias("neighbours"),
        total(0).alias("sum_x"),
        total(1).alias("sum_y"),
        total(2).alias("sum_z"),
    )


@query(
    "track_interpolation",
    f"""
WITH knots AS (SELECT user_id, epoch_us(ts) / 1e6 AS d, arg_max(value, event_id) AS v FROM events GROUP BY ALL),
pts AS (SELECT user_id, unnest(generate_series(0, 124)) * 21600.0 + 1704067200.0 AS d FROM (SELECT DISTINCT user_id FROM events)),
seg AS (SELECT user_id, d AS d0, v AS v0, lead(d) OVER w AS d1, lead(v) OVER w AS v1 FROM knots WINDOW w AS (PARTITION BY user_id ORDER BY d)),
ends AS (SELECT user_id, arg_min(v, d) AS first_v FROM knots GROUP BY 1)
SELECT user_id, {r('pts.d')} AS d, {r('coalesce(v0 + coalesce((v1 - v0) * (pts.d - d0) / (d1 - d0), 0), first_v)')} AS v
FROM pts ASOF LEFT JOIN seg ON pts.user_id = seg.user_id AND pts.d >= seg.d0 JOIN ends ON pts.user_id = ends.user_id
""".replace("SELECT user_id, floor", "SELECT pts.user_id, floor"),
)
def track_interpolation(spark, sf_dir):
    ev = S.events(spark, sf_dir)
    knots = ev.groupBy("user_id", (F.unix_micros("ts") / 1e6).alias("d")).agg(F.max_by("value", "event_id").alias("v"))
    hours = F.transform(F.sequence(F.lit(0), F.lit(124)), lambda i: i * F.lit(21600.0) + F.lit(1704067200.0))
    points = ev.select("user_id").distinct().select("user_id", F.explode(hours).alias("d"))
    out = X.interpolate_track(points, knots, ["user_id"], "d", ["v"], block_width=60.0)
    return out.select("user_id", C.rounded("d").alias("d"), C.rounded("v").alias("v"))


@query(
    "coordinate_tilt",
    """
WITH a AS (SELECT vec_id, abs(CAST(embedding[1] AS DOUBLE)) * 100 AS theta, CAST(embedding[2] AS DOUBLE) * 300 AS phi, CAST(embedding[3] AS DOUBLE) AS x FROM embeddings),
u AS (SELECT *, sin(radians(theta)) * cos(radians(phi)) AS ux, sin(radians(theta)) * sin(radians(phi)) AS uy, cos(radians(theta)) AS uz FROM a),
v AS (SELECT *, uy * cos(radians(-5.0)) - uz * sin(radians(-5.0)) AS vy, uy * sin(radians(-5.0)) + uz * cos(radians(-5.0)) AS vz FROM u)
"""
    + f"SELECT vec_id, {r('degrees(acos(greatest(-1.0, least(1.0, vz))))')} AS theta, {r('degrees(atan2(vy, ux))')} AS phi, "
    + f"{r('greatest(-100.0, least(100.0, x * 1000.0 + 5))')} AS x_um FROM v",
)
def coordinate_tilt(spark, sf_dir):
    def dim(i):
        return F.get("embedding", i).cast("double")

    theta, phi = C.tilted_angles(F.abs(dim(0)) * 100, dim(1) * 300, -5.0)
    return S.table(spark, sf_dir, "embeddings").select(
        "vec_id",
        C.rounded(theta).alias("theta"),
        C.rounded(phi).alias("phi"),
        C.rounded(C.clipped(C.affine(dim(2), 1000.0, 5.0), -100.0, 100.0)).alias("x_um"),
    )


def _vox(dim: int) -> str:
    return f"CAST(greatest(0, least(9, floor((CAST(embedding[{dim}] AS DOUBLE) + 0.25) / 0.05 + 0.5))) AS INTEGER)"


@query(
    "voxel_lookup",
    f"""
WITH vol AS (SELECT {_vox(1)} AS ap, {_vox(2)} AS ml, {_vox(3)} AS dv, min(label) AS label FROM embeddings GROUP BY ALL)
SELECT vec_id, ap, ml, dv, vol.label AS label FROM (SELECT vec_id, {_vox(4)} AS ap, {_vox(5)} AS ml, {_vox(6)} AS dv FROM embeddings)
LEFT JOIN vol USING (ap, ml, dv)""",
)
def voxel_lookup(spark, sf_dir):
    rows = S.table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", *[F.get("embedding", i).cast("double").alias(f"x{i}") for i in range(6)]
    )
    axes = [("ap", 0), ("ml", 1), ("dv", 2)]
    volume = rows.groupBy(*[C.voxel_index(f"x{i}", -0.25, 0.05, 10).alias(a) for a, i in axes]).agg(F.min("label").alias("label"))
    points = rows.select("vec_id", "x3", "x4", "x5")
    out = X.voxel_labels(points, volume, [(f"x{i + 3}", a, -0.25, 0.05, 10) for a, i in axes])
    return out.select("vec_id", "ap", "ml", "dv", "label")


# Places of the plane and their values: known sites, the Delaunay triangle of a gap (of its 24 nearest sites, the three
# around it with the least weighted sum of squared distances), or the nearest site where no triangle holds it.
PLANE_SQL = f"""
{SM}, rms AS (SELECT pid, snippet, channel, sqrt(avg(x * x)) AS rms FROM sm GROUP BY ALL),
site AS (SELECT pid, snippet, channel, axial_um AS y, lateral_um AS x, coalesce({LABEL_SQL} = 0, false) AS good, rms,
                CAST(embedding[1] AS DOUBLE) AS first FROM tr JOIN rms USING (pid, snippet, channel)),
known AS (SELECT *, row_number() OVER (PARTITION BY pid, snippet ORDER BY y, x) - 1 AS i FROM site WHERE good),
grid AS (SELECT DISTINCT a.pid, a.snippet, a.y, b.x FROM site a JOIN site b USING (pid, snippet)),
gap AS (SELECT g.* FROM grid g ANTI JOIN known USING (pid, snippet, y, x)),
near AS (
  SELECT gap.pid, gap.snippet, gap.y, gap.x, k.i, k.y - gap.y AS dy, k.x - gap.x AS dx, k.rms, k.first,
         pow(k.y - gap.y, 2) + pow(k.x - gap.x, 2) AS d2
  FROM gap JOIN known k USING (pid, snippet)
  QUALIFY row_number() OVER (PARTITION BY gap.pid, gap.snippet, gap.y, gap.x ORDER BY d2, i) <= 24),
tri AS (
  SELECT a.pid, a.snippet, a.y, a.x, (b.dx - a.dx) * (c.dy - a.dy) - (c.dx - a.dx) * (b.dy - a.dy) AS whole,
         (b.dx * c.dy - c.dx * b.dy) / whole AS wa, (c.dx * a.dy - a.dx * c.dy) / whole AS wb,
         (a.dx * b.dy - b.dx * a.dy) / whole AS wc, wa * a.d2 + wb * b.d2 + wc * c.d2 AS far,
         wa * a.i * a.i + wb * b.i * b.i + wc * c.i * c.i AS num, wa * a.rms + wb * b.rms + wc * c.rms AS rms,
         wa * a.first + wb * b.first + wc * c.first AS first
  FROM near a JOIN near b USING (pid, snippet, y, x) JOIN near c USING (pid, snippet, y, x)
  WHERE a.i < b.i AND b.i < c.i AND (b.dx - a.dx) * (c.dy - a.dy) <> (c.dx - a.dx) * (b.dy - a.dy)),
inside AS (SELECT pid, snippet, y, x, rms, first FROM tri WHERE least(wa, wb, wc) >= -1e-9
  QUALIFY row_number() OVER (PARTITION BY pid, snippet, y, x ORDER BY round(far, 6), round(num, 6)) = 1),
plane AS (
  SELECT pid, snippet, y, x, rms, first FROM known
  UNION ALL SELECT * FROM inside
  UNION ALL (SELECT pid, snippet, y, x, rms, first FROM near ANTI JOIN inside USING (pid, snippet, y, x)
             QUALIFY row_number() OVER (PARTITION BY pid, snippet, y, x ORDER BY d2, i) = 1))
"""


def _smoothing_rows(spark, sf_dir):
    return _with_labels(S.traces(spark, sf_dir)).select(
        *KEY, "axial_um", "lateral_um", "labels", A.rms("samples").alias("rms_ap"), F.get("samples", 0).cast("double").alias("rms_lf")
    )


@query(
    "plane_fill",
    f"WITH {PLANE_SQL} SELECT pid, snippet, y AS axial_um, x AS lateral_um, {r('rms')} AS rms_ap, {r('first')} AS rms_lf FROM plane",
)
def plane_fill(spark, sf_dir):
    out = X.fill_plane(_smoothing_rows(spark, sf_dir), ["rms_ap", "rms_lf"])
    return out.withColumns({c: C.rounded(c) for c in ("rms_ap", "rms_lf")})


@query(
    "tv_denoise",
    f"""WITH RECURSIVE {PLANE_SQL},
cell AS (SELECT pid, snippet, y, x, unnest(['ap', 'lf']) AS name, unnest([rms, first]) AS f FROM plane),
image AS (SELECT *, median(abs(f)) OVER (PARTITION BY pid, snippet, name) AS w FROM cell),
steps AS (
  SELECT pid, snippet, name, y, x, f, w, 0 AS k, 0.0::DOUBLE AS p0, 0.0::DOUBLE AS p1, f AS u,
         NULL::DOUBLE AS ep, false AS done
  FROM image
  UNION ALL
  SELECT pid, snippet, name, y, x, f, w, k + 1, (p0 - 0.25 / w * g0) / (1 + 0.25 / w * sqrt(g0 * g0 + g1 * g1)),
         (p1 - 0.25 / w * g1) / (1 + 0.25 / w * sqrt(g0 * g0 + g1 * g1)), v, e, coalesce(abs(ep - e) <= 2e-4 * ep, false)
  FROM (
    SELECT *, sum((v - f) * (v - f) / 2 + w * sqrt(g0 * g0 + g1 * g1)) OVER (PARTITION BY pid, snippet, name) AS e
    FROM (
      SELECT *, coalesce(lead(v) OVER down - v, 0) AS g0, coalesce(lead(v) OVER across - v, 0) AS g1
      FROM (
        SELECT *, f - w * (p0 - coalesce(lag(p0) OVER down, 0) + p1 - coalesce(lag(p1) OVER across, 0)) AS v
        FROM steps WHERE NOT done AND k < 200
        WINDOW down AS (PARTITION BY pid, snippet, name, x ORDER BY y), across AS (PARTITION BY pid, snippet, name, y ORDER BY x)
      ) WINDOW down AS (PARTITION BY pid, snippet, name, x ORDER BY y), across AS (PARTITION BY pid, snippet, name, y ORDER BY x)
    )
  )
),
last AS (SELECT pid, snippet, name, y, x, u FROM steps
         QUALIFY k = max(k) OVER (PARTITION BY pid, snippet, name))
SELECT s.pid, s.snippet, s.channel, s.y AS axial_um, s.x AS lateral_um, l.labels, {r('a.u')} AS rms_ap, {r('b.u')} AS rms_lf
FROM site s JOIN (SELECT pid, snippet, channel, {LABEL_SQL} AS labels FROM tr) l USING (pid, snippet, channel)
JOIN last a ON a.name = 'ap' AND a.pid = s.pid AND a.snippet = s.snippet AND a.y = s.y AND a.x = s.x
JOIN last b ON b.name = 'lf' AND b.pid = s.pid AND b.snippet = s.snippet AND b.y = s.y AND b.x = s.x""",
)
def tv_denoise(spark, sf_dir):
    out = X.denoise_features(_smoothing_rows(spark, sf_dir), ["rms_ap", "rms_lf"])
    return out.withColumns({c: C.rounded(c) for c in ("rms_ap", "rms_lf")})
