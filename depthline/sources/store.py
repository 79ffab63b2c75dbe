"""Readers: feature store, recordings, time windows, flat binary files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depthline.functions.columns import next_fast_length, sample_index, smooth_lengths
from depthline.operators.relational import catalogue_filter
from depthline.schemas import BENCHMARK_PIDS, CLUSTER_SCHEMA, TRACE_SCHEMA, verify_tables


# File names of a feature store folder.
DENOISED_FEATURES = "raw_ephys_features_denoised.pqt"
RAW_FEATURES = "raw_ephys_features.pqt"
CHANNELS, PROBES, CLUSTERS = "channels.pqt", "probes.pqt", "clusters.pqt"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet scan; with a schema no file footers are read for inference."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def load_tables(spark: SparkSession, root: str, verify: bool = False) -> dict[str, DataFrame]:
    """The feature store of one folder.

    The denoised feature table is preferred to the raw one. Where there is no
    cluster table, an empty one of the same schema stands in.
    """
    denoised, clusters = f"{root}/{DENOISED_FEATURES}", f"{root}/{CLUSTERS}"
    tables = {
        "voltage": read_table(spark, denoised if path_exists(spark, denoised) else f"{root}/{RAW_FEATURES}"),
        "channels": read_table(spark, f"{root}/{CHANNELS}"),
        "probes": read_table(spark, f"{root}/{PROBES}"),
        "clusters": read_table(spark, clusters) if path_exists(spark, clusters) else spark.createDataFrame([], CLUSTER_SCHEMA),
    }
    if verify:
        verify_tables(tables["voltage"], tables["channels"], tables["clusters"])
    return tables


def load_revision(spark: SparkSession, root: str, label: str = "latest", verify: bool = False) -> dict[str, DataFrame]:
    """The feature store of one revision folder under `root`."""
    if not path_exists(spark, f"{root}/{label}"):
        raise FileNotFoundError(f"revision {label} not found under {root}")
    return load_tables(spark, f"{root}/{label}", verify)


def read_pid_sets(spark: SparkSession, path: str | None = None) -> DataFrame:
    """`(set_name, pid)`: the benchmark set, and those of a table at `path`."""
    sets = spark.createDataFrame([("benchmark", p) for p in BENCHMARK_PIDS], "set_name string, pid string")
    return sets if path is None else sets.unionByName(read_table(spark, path, sets.schema))


def wide_catalogue(insertions: DataFrame, project: str, traced_only: bool = False) -> DataFrame:
    """Recordings of a project that pass quality control and are not mock sessions."""
    flags = [("session_json", "$.IS_MOCK", "false")]
    if traced_only:
        flags.append(("json", "$.extended_qc.tracing_exists", "true"))
    return catalogue_filter(
        insertions, project=("project", project), below=("qc", 50), not_json=("json", "$.qc", "CRITICAL"), json_equals=flags
    )


def line_catalogue(insertions: DataFrame, project: str, subject_prefix: str = "FMR") -> DataFrame:
    """Recordings of one animal line, by the prefix of the subject name."""
    return catalogue_filter(
        insertions,
        project=("project", project),
        below=("qc", 50),
        not_json=("json", "$.qc", "CRITICAL"),
        prefix=("subject", subject_prefix),
    )


# ---------------------------------------------------------------- recordings


def recording_traces(traces: DataFrame, channels: DataFrame, pid: Column | str) -> DataFrame:
    """Traces of the chosen recordings with their channel positions."""
    chosen = traces.filter(F.col("pid") == pid) if isinstance(pid, str) else traces.filter(pid)
    return chosen.join(channels, ["pid", "channel"])


def with_channels(computed: DataFrame, cached: DataFrame | None) -> DataFrame:
    """Cached channel rows where there are any, computed rows for the other probes."""
    if cached is None:
        return computed
    return cached.unionByName(computed.join(cached.select("pid").distinct(), "pid", "left_anti"), allowMissingColumns=True)


def invalid_windows(requests: DataFrame, recordings: DataFrame) -> DataFrame:
    """Requests `(pid, t_start, duration)` a recording cannot serve, with the reason.

    recordings: `(pid, band, ns, fs, nc, nsync)`.
    """
    end = F.col("t_start") + F.col("duration")
    reason = (
        F.when(F.col("ns").isNull(), F.lit("no recording"))
        .when(F.col("t_start") < 0, F.lit("negative start"))
        .when(end > F.col("ns") / F.col("fs"), F.lit("beyond the end"))
        .when(F.col("nc") - F.col("nsync") <= 0, F.lit("no channels"))
    )
    joined = requests.join(recordings, "pid", "left").withColumn("reason", reason)
    return joined.filter("reason IS NOT NULL").select("pid", "band", "t_start", "duration", "reason")


def checked_windows(requests: DataFrame, recordings: DataFrame) -> DataFrame:
    """The requests, after raising when any of them is invalid (runs one job)."""
    bad = invalid_windows(requests, recordings).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['pid']}/{r['band']}: {r['reason']}" for r in bad))
    return requests


def fast_length(n: int) -> int:
    """The least 5-smooth number that is not below `n`."""
    limit = 1
    while limit < n:
        limit *= 2
    return min(v for v in smooth_lengths(limit) if v >= n)


def time_window(
    chunks: DataFrame,
    fs: float,
    t0: float,
    duration: float,
    chunk_samples: int,
    latency: int = 0,
    keys: Sequence[str] = ("pid",),
    channels: int | None = None,
) -> DataFrame:
    """One row per channel with the samples of `[t0, t0 + duration)`.

    The window starts at `int(fs*t0 + latency)` and is as long as the next fast
    length. Only the chunks it touches are read: the condition on `chunk` is a
    literal range that reaches the parquet scan, as does the one on `channel`.
    """
    if t0 < 0:
        raise ValueError("the window starts before the recording")
    start = int(fs * t0 + latency)
    stop = start + fast_length(int(fs * duration))
    touched = chunks.filter(F.col("chunk").between(start // chunk_samples, (stop - 1) // chunk_samples))
    if channels is not None:
        touched = touched.filter(F.col("channel") < channels)
    first = F.greatest(F.lit(0), F.lit(start) - F.col("n0"))
    last = F.least(F.size("samples"), F.lit(stop) - F.col("n0"))
    piece = F.slice("samples", (first + 1).cast("int"), F.greatest(F.lit(0), last - first).cast("int"))
    cut = touched.select(*keys, "channel", F.struct("n0", piece.alias("part")).alias("_piece"))
    return cut.groupBy(*keys, "channel").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list("_piece")), lambda s: s.part)).alias("samples")
    ).withColumn("fs", F.lit(float(fs)))


def time_windows(
    chunks: DataFrame, windows: DataFrame, chunk_samples: int, latency: int = 0, keys: Sequence[str] = ("pid", "snippet")
) -> DataFrame:
    """As `time_window`, for a table `(pid, snippet, t_start, duration)` of windows.

    Each window is spread to the chunks that it touches, so the join is on the
    probe, the rate and the chunk, and no other samples are shuffled with it.
    """
    start = sample_index("fs", "t_start", latency)
    length = next_fast_length((F.col("fs") * F.col("duration")).cast("bigint"))
    rates = chunks.select("pid", "fs").distinct()
    placed = windows.join(rates, "pid").withColumns({"_start": start, "_stop": start + length})
    number = chunks.schema["chunk"].dataType
    first_chunk = F.floor(F.greatest(F.lit(0), F.col("_start")) / chunk_samples).cast("bigint")
    last_chunk = F.floor((F.col("_stop") - 1) / chunk_samples).cast("bigint")
    spread = placed.withColumn("chunk", F.explode(F.sequence(first_chunk, last_chunk)))
    spread = spread.withColumn("chunk", F.col("chunk").cast(number))
    touched = chunks.join(spread, ["pid", "fs", "chunk"])
    first = F.greatest(F.lit(0), F.col("_start") - F.col("n0"))
    last = F.least(F.size("samples"), F.col("_stop") - F.col("n0"))
    piece = F.slice("samples", (first + 1).cast("int"), F.greatest(F.lit(0), last - first).cast("int"))
    return (
        touched.select(*keys, "channel", "fs", F.struct("n0", piece.alias("part")).alias("_piece"))
        .groupBy(*keys, "channel")
        .agg(
            F.first("fs").alias("fs"),
            F.flatten(F.transform(F.sort_array(F.collect_list("_piece")), lambda s: s.part)).alias("samples"),
        )
    )


def cut_snippets(chunks: DataFrame, snippet_samples: int, keys: Sequence[str] = ("pid",)) -> DataFrame:
    """Whole recordings as consecutive snippets `(keys, snippet, channel, fs, samples)`.

    A chunk that spans a border gives a piece to each side; a group gathers
    the pieces of one channel in one snippet.
    """
    first, last = F.floor(F.col("n0") / snippet_samples), F.floor((F.col("n0") + F.size("samples") - 1) / snippet_samples)
    spread = chunks.filter(F.size("samples") > 0).withColumn("snippet", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    base = F.col("snippet").cast("long") * snippet_samples
    begin = F.greatest(F.lit(0), base - F.col("n0"))
    end = F.least(F.size("samples"), base + snippet_samples - F.col("n0"))
    piece = F.struct("n0", F.slice("samples", (begin + 1).cast("int"), (end - begin).cast("int")).alias("part"))
    return spread.select(*keys, "snippet", "channel", "fs", piece.alias("_piece")).groupBy(*keys, "snippet", "channel").agg(
        F.first("fs").alias("fs"),
        F.flatten(F.transform(F.sort_array(F.collect_list("_piece")), lambda s: s.part)).alias("samples"),
    )


# ---------------------------------------------------------------- flat binary files


def arrow_uri(path: str) -> str:
    """The same location as Arrow's file systems name it."""
    return "s3://" + path.removeprefix("s3a://") if path.startswith("s3a://") else path


def _read_range(path: str, offset: int, length: int) -> bytes:
    from pyarrow import fs

    filesystem, inner = fs.FileSystem.from_uri(arrow_uri(path))
    with filesystem.open_input_file(inner) as handle:
        return handle.read_at(length, offset)


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """`(path, length)` of files; the contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def read_flat_matrix(spark: SparkSession, path: str, n_rows: int, rows_per_task: int = 256) -> DataFrame:
    """`(path, cluster_id, bin, n)` of int32 matrices of `n_rows` rows.

    The number of bins follows from the file size. Ranges of rows are spread
    over tasks and each task reads its own bytes only, so files may be of any size.
    """
    files = binary_files(spark, path).withColumn("bins", F.floor(F.col("length") / (4 * n_rows)).cast("long"))
    starts = F.sequence(F.lit(0), F.lit(n_rows - 1), F.lit(rows_per_task))
    work = files.select("path", "bins", F.explode(starts).alias("first")).repartition("path", "first")
    schema = "path string, cluster_id int, bin int, n int"

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                count, bins = min(rows_per_task, n_rows - row.first), int(row.bins)
                data = np.frombuffer(_read_range(row.path, row.first * bins * 4, count * bins * 4), dtype="<i4")
                yield pd.DataFrame(
                    {
                        "path": row.path,
                        "cluster_id": np.repeat(np.arange(row.first, row.first + count, dtype="int32"), bins),
                        "bin": np.tile(np.arange(bins, dtype="int32"), count),
                        "n": data,
                    }
                )

    return work.mapInPandas(unpack, schema)


def read_flat_recording(
    spark: SparkSession, path: str, pid: str, band: str, fs: float, n_channels: int, n_sync: int = 1, chunk_samples: int = 30_000
) -> DataFrame:
    """Trace rows of a flat int16 file of `(sample, channel)`; sync channels are left out.

    The file is cut into chunks by offset, so one long recording is read by
    many tasks.
    """
    if not path_exists(spark, path):
        raise RuntimeError(f"recording {path} not found")
    width = 2 * n_channels
    chunks = binary_files(spark, path).select(
        "path", F.explode(F.sequence(F.lit(0), F.ceil(F.col("length") / (width * chunk_samples)).cast("int") - 1)).alias("chunk"), "length"
    ).repartition("path", "chunk")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                offset = row.chunk * chunk_samples * width
                size = min(chunk_samples * width, row.length - offset) // width * width
                block = np.frombuffer(_read_range(row.path, offset, size), dtype="<i2").reshape(-1, n_channels)
                kept = n_channels - n_sync
                yield pd.DataFrame(
                    {
                        "pid": pid,
                        "band": band,
                        "channel": np.arange(kept, dtype="int32"),
                        "chunk": np.int32(row.chunk),
                        "fs": float(fs),
                        "n0": np.int64(row.chunk * chunk_samples),
                        "samples": list(block[:, :kept].T.astype("float32")),
                    }
                )

    return chunks.mapInPandas(unpack, TRACE_SCHEMA)


def recordings_of(traces: DataFrame, n_sync: int = 0) -> DataFrame:
    """`(pid, band, ns, fs, nc, nsync)` counted from trace rows."""
    return traces.groupBy("pid", "band").agg(
        F.max(F.col("n0") + F.size("samples")).alias("ns"),
        F.max("fs").alias("fs"),
        (F.countDistinct("channel") + n_sync).alias("nc"),
        F.lit(n_sync).alias("nsync"),
    )


