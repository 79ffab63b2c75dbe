"""Feature groups, table schemas and their checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURES_VERSION = "2025.07.01"

# Frequency bands in Hz; they overlap on purpose.
BANDS = {
    "delta": (0.0, 4.0),
    "theta": (4.0, 10.0),
    "alpha": (8.0, 12.0),
    "beta": (15.0, 30.0),
    "gamma": (30.0, 90.0),
    "lfp": (0.0, 90.0),
}

# Column names of the feature groups.
FEATURE_GROUPS = {
    "raw_ap": ["rms_ap", "cor_ratio"],
    "raw_lf": ["rms_lf"] + [f"psd_{band}" for band in BANDS],
    "raw_lf_csd": ["rms_lf_csd"] + [f"psd_{band}_csd" for band in BANDS],
    "waveforms": [
        "alpha_mean",
        "alpha_std",
        "depolarisation_slope",
        "peak_time_secs",
        "peak_val",
        "polarity",
        "recovery_slope",
        "recovery_time_secs",
        "repolarisation_slope",
        "spike_count",
        "tip_time_secs",
        "tip_val",
        "trough_time_secs",
        "trough_val",
    ],
    "micro-manipulator": ["x_target", "y_target", "z_target"],
    "localisation": [],
}
ALL_GROUPS = ("raw_ap", "raw_lf", "raw_lf_csd", "waveforms", "micro-manipulator")
DEFAULT_GROUPS = ("raw_ap", "raw_lf", "localisation", "waveforms")
DENOISED_GROUPS = ("raw_ap", "raw_lf", "raw_lf_csd", "waveforms")
FEATURE_SETS = ("lf", "csd", "ap", "waveforms")

# Probe ids of the benchmark set. Larger sets are read with
# `sources.store.read_pid_sets`.
BENCHMARK_PIDS = [
    "1a276285-8b0e-4cc9-9f0a-a3a002978724",
    "1e104bf4-7a24-4624-a5b2-c2c8289c0de7",
    "5d570bf6-a4c6-4bf1-a14b-2c878c84ef0e",
    "5f7766ce-8e2e-410c-9195-6bf089fea4fd",
    "6638cfb3-3831-4fc2-9327-194b76cf22e1",
    "749cb2b7-e57e-4453-a794-f6230e4d0226",
    "d7ec0892-0a6c-4f4f-9d8f-72083692af5c",
    "da8dfec1-d265-44e8-84ce-6ae9c109b8bd",
    "dab512bd-a02d-4c1f-8dbc-9155a163efc0",
    "dc7e9403-19f7-409f-9240-05ee57cb7aea",
    "e8f9fba4-d151-4b00-bee7-447f0f3e752c",
    "eebcaf65-7fa4-4118-869d-a084e84530e2",
    "fe380793-8035-414e-b000-09bfe5ece92a",
]


def feature_columns(groups: Sequence[str] | str = DEFAULT_GROUPS) -> list[str]:
    """Column names of the given feature groups, in group order.

    Unknown group names add nothing, as callers may list groups that have no
    columns of their own.
    """
    if groups == "all":
        groups = ALL_GROUPS
    return [name for group in groups for name in FEATURE_GROUPS.get(group, [])]


def _doubles(names: Sequence[str], nullable: bool = False) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType(), nullable) for n in names]


def _keyed(fields: Sequence[T.StructField]) -> T.StructType:
    return T.StructType([T.StructField("channel", T.IntegerType(), False), *fields])


LF_SCHEMA = _keyed(_doubles(FEATURE_GROUPS["raw_lf"]))
CSD_SCHEMA = _keyed(_doubles(FEATURE_GROUPS["raw_lf_csd"]))
AP_SCHEMA = _keyed(_doubles(FEATURE_GROUPS["raw_ap"]))
WAVEFORM_SCHEMA = _keyed(
    [
        T.StructField("spike_count", T.LongType(), False, {"denoise_as": "double"})
        if name == "spike_count"
        else T.StructField(name, T.DoubleType(), False)
        for name in FEATURE_GROUPS["waveforms"]
    ]
)
LAYOUT_SCHEMA = _keyed(_doubles(["axial_um", "lateral_um"]) + [T.StructField("labels", T.IntegerType(), True)])
TARGET_SCHEMA = _keyed(_doubles(FEATURE_GROUPS["micro-manipulator"]))
HISTOLOGY_SCHEMA = _keyed(
    _doubles(["x", "y", "z"])
    + [T.StructField("atlas_id", T.LongType(), False), T.StructField("acronym", T.StringType(), False)]
)
RAW_FEATURES_SCHEMA = _keyed(
    [
        field
        for schema in (WAVEFORM_SCHEMA, CSD_SCHEMA, AP_SCHEMA, LF_SCHEMA, LAYOUT_SCHEMA)
        for field in schema.fields
        if field.name != "channel"
    ]
)
SET_SCHEMAS = {"lf": LF_SCHEMA, "csd": CSD_SCHEMA, "ap": AP_SCHEMA, "waveforms": WAVEFORM_SCHEMA}

TRACE_SCHEMA = T.StructType(
    [
        T.StructField("pid", T.StringType(), False),
        T.StructField("band", T.StringType(), False),
        T.StructField("channel", T.IntegerType(), False),
        T.StructField("chunk", T.IntegerType(), False),
        T.StructField("fs", T.DoubleType(), False),
        T.StructField("n0", T.LongType(), False),
        T.StructField("samples", T.ArrayType(T.FloatType()), False),
    ]
)

# Measures of a cluster.
CLUSTER_MEANS = [
    "amp_max",
    "amp_min",
    "amp_median",
    "amp_std_dB",
    "contamination",
    "contamination_alt",
    "drift",
    "missed_spikes_est",
    "noise_cutoff",
    "presence_ratio",
    "presence_ratio_std",
    "slidingRP_viol",
    "spike_count",
    "firing_rate",
    "label",
    "x",
    "y",
    "z",
]

CLUSTER_SCHEMA = T.StructType(
    [T.StructField("pid", T.StringType(), False), T.StructField("cluster_id", T.LongType(), False)]
    + _doubles(["axial_um", *CLUSTER_MEANS], nullable=True)
    + [T.StructField("acronym", T.StringType(), True), T.StructField("atlas_id", T.LongType(), True)]
)


def _require(df: DataFrame, schema: T.StructType) -> None:
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast the columns named by `schema`; other columns pass through.

    A value that cannot be cast becomes NULL, to be reported by `violations`.
    """
    _require(df, schema)
    casts = {f.name: F.col(f.name).try_cast(f.dataType).alias(f.name, metadata=f.metadata or {}) for f in schema.fields}
    return df.select(*[casts.get(c, F.col(c)) for c in df.columns])


def violations(df: DataFrame, schema: T.StructType) -> DataFrame:
    """One row per column that breaks the schema: `(column, n_bad)`.

    Bad means missing (NULL or NaN) in a required column, or present but not
    castable to the declared type. One pass over the data.
    """
    _require(df, schema)
    counts = []
    for f in schema.fields:
        source = F.col(f.name)
        cast = source.try_cast(f.dataType)
        bad = source.isNotNull() & cast.isNull()
        if not f.nullable:
            bad = bad | source.isNull()
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                bad = bad | F.coalesce(F.isnan(cast), F.lit(False))
        counts.append(F.count_if(bad).alias(f.name))
    wide = df.agg(*counts)
    pairs = F.array(
        *[F.struct(F.lit(f.name).alias("column"), F.col(f.name).cast("long").alias("n_bad")) for f in schema.fields]
    )
    return wide.select(F.inline(pairs)).filter("n_bad > 0")


def validate(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Conform `df` and raise when rows break the schema (runs one job)."""
    found = violations(df, schema).collect()
    if found:
        raise ValueError("schema violations: " + ", ".join(f"{r['column']}={r['n_bad']}" for r in found))
    return conform(df, schema)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def verify_tables(voltage: DataFrame, channels: DataFrame, clusters: DataFrame | None = None) -> None:
    """Raise unless the tables carry their key columns and the keys are unique."""
    for name, df, keys in (
        ("voltage", voltage, ["pid", "channel"]),
        ("channels", channels, ["pid", "channel"]),
        ("clusters", clusters, ["pid", "cluster_id"]),
    ):
        if df is None:
            continue
        absent = [k for k in keys if k not in df.columns]
        if absent:
            raise ValueError(f"{name}: key columns {absent} absent")
        if not duplicate_keys(df, keys).isEmpty():
            raise ValueError(f"{name}: duplicate {tuple(keys)} keys")


def checked_sets(requested: Sequence[str] | None) -> list[str]:
    """The requested feature sets, or all; unknown names raise."""
    if requested is None:
        return list(FEATURE_SETS)
    unknown = [s for s in requested if s not in FEATURE_SETS]
    if unknown:
        raise ValueError(f"unknown feature sets {unknown}; choose from {list(FEATURE_SETS)}")
    return [s for s in FEATURE_SETS if s in requested]
