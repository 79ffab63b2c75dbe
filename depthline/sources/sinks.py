"""Writers: feature sets, channels, waveforms, predictions, models, flat matrices."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.util import MLReadable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depthline import __version__
from depthline.operators.relational import missing_keys
from depthline.schemas import FEATURES_VERSION
from depthline.session import materialise
from depthline.sources.store import arrow_uri, path_exists


def stamped(df: DataFrame) -> DataFrame:
    """Add the versions of the feature definitions and of this package."""
    return df.withColumns({"features_version": F.lit(FEATURES_VERSION), "package_version": F.lit(__version__)})


#: Stored rows lie in folders of so many consecutive snippets, and of probes by a hash of their id.
SNIPPETS_PER_FOLDER = 4096
PROBE_SHARDS = 64
#: A file has so many rows at most.
ROWS_PER_FILE = 1_000_000
_LAYOUT = ("snippets", "probes")


def _shard(pid: Column) -> Column:
    return F.pmod(F.xxhash64(pid.cast("string")), F.lit(PROBE_SHARDS)).cast("int")


def _block(snippet: Column) -> Column:
    return F.floor(snippet / SNIPPETS_PER_FOLDER).cast("bigint")


def store_rows(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write rows of probes and snippets to `path`: few folders, sorted files of bounded size.

    Rows are dealt out by ranges of folder, probe and snippet, so the statistics
    of a file and its row groups tell which probes and snippets it holds.
    `overwrite` replaces the rows of the probes and snippets that `df` holds:
    only the folders that they lie in are written anew, with the other rows that
    those had. Two runs that write to one folder have to follow each other.
    """
    spark = df.sparkSession
    keys = [k for k in ("pid", "snippet") if k in df.columns]
    block = _block(F.col("snippet")) if "snippet" in keys else F.lit(0).cast("bigint")
    placed = df.withColumn("snippets", block).withColumn("probes", _shard(F.col("pid")))
    if mode == "overwrite" and path_exists(spark, path):
        placed = materialise(placed, "rows")  # read for its folders, its keys and the rows
        touched = placed.select(*_LAYOUT).distinct().collect()  # one row a folder
        earlier = spark.read.parquet(path).filter(
            F.col("snippets").isin(*{r["snippets"] for r in touched}) & F.col("probes").isin(*{r["probes"] for r in touched})
        )
        same = placed.select(*_LAYOUT, *keys).distinct()
        earlier = earlier.join(same.select(*_LAYOUT).distinct(), list(_LAYOUT), "left_semi")
        kept = earlier.withColumns({k: F.col(k).cast(df.schema[k].dataType) for k in keys}).join(same.select(keys), keys, "left_anti")
        # Written before the folders are replaced, as it is read from them.
        placed = placed.unionByName(materialise(kept, "kept"), allowMissingColumns=True)
    order = [*_LAYOUT, *keys]
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", ROWS_PER_FILE)
    writer.partitionBy(*_LAYOUT).parquet(path)


def stored_rows(spark: SparkSession, path: str, pid=None, snippet=None) -> DataFrame | None:
    """What `store_rows` has written, or None; one probe or snippet opens its folders and row groups only."""
    if not path_exists(spark, path):
        return None
    rows = spark.read.parquet(path)
    if pid is not None:
        rows = rows.filter((F.col("probes") == _shard(F.lit(pid))) & (F.col("pid") == F.lit(pid)))
    if snippet is not None:
        rows = rows.filter((F.col("snippets") == snippet // SNIPPETS_PER_FOLDER) & (F.col("snippet") == F.lit(snippet)))
    return rows.drop(*_LAYOUT)


def write_features(df: DataFrame, root: str, feature_set: str, mode: str = "append") -> None:
    """One table per set, with version stamps; see `store_rows` for its layout.

    `overwrite` replaces the rows of the probes and snippets that `df` holds and
    leaves all others alone, so a run can be repeated.
    """
    store_rows(stamped(df), f"{root}/{feature_set}_features.parquet", mode)


def write_traces(traces: DataFrame, path: str, chunks_per_file: int = 64, mode: str = "append") -> None:
    """Trace rows partitioned by band and probe and sorted by chunk.

    A time window then opens the folders of its probes and the row groups of
    its chunks.
    """
    spread = F.floor(F.col("chunk") / chunks_per_file)
    placed = traces.repartition("band", "pid", spread).sortWithinPartitions("band", "pid", "chunk", "channel")
    placed.write.mode(mode).partitionBy("band", "pid").parquet(path)


def read_features(
    spark: SparkSession, root: str, feature_set: str, like: DataFrame | None = None, pid=None, snippet: int | None = None
) -> DataFrame | None:
    """A stored set, or None; of one probe or snippet where given. `pid` and `snippet` have the types of the frame `like`."""
    rows = stored_rows(spark, f"{root}/{feature_set}_features.parquet", pid, snippet)
    if rows is None:
        return None
    if like is not None:
        shared = [k for k in ("pid", "snippet") if k in like.columns and k in rows.columns]
        rows = rows.withColumns({k: F.col(k).cast(like.schema[k].dataType) for k in shared})
    return rows.drop("features_version", "package_version")


def write_if_absent(df: DataFrame, path: str) -> None:
    """Write a table unless something is at the path already."""
    df.write.mode("ignore").parquet(path)


def write_waveforms(waveforms: DataFrame, events: DataFrame, root: str, save: bool = True) -> None:
    """Event table, and one ragged array (neighbour, time) of float samples for each event, with its channel index.

    An event's row has `neighbours`, the channels in reach in ascending order,
    and `waveform`, the samples of each of them. Rows of the probes and snippets
    at hand are replaced, so a repeated run doubles nothing.
    """
    if not save:
        return
    keys = [k for k in ("pid", "snippet", "channel", "sample") if k in waveforms.columns]
    of_event = F.sort_array(F.collect_list(F.struct("neighbour", F.col("waveform").cast("array<float>").alias("w"))))
    ragged = waveforms.groupBy(*keys).agg(of_event.alias("_n")).select(
        *keys, F.transform("_n", lambda n: n.neighbour).alias("neighbours"), F.transform("_n", lambda n: n.w).alias("waveform")
    )
    store_rows(ragged, f"{root}/waveforms.parquet", "overwrite")
    store_rows(events, f"{root}/spikes.parquet", "overwrite")


def read_waveforms(spark: SparkSession, root: str, pid=None, snippet: int | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """`(waveforms, events)` as written by `write_waveforms`."""
    return stored_rows(spark, f"{root}/waveforms.parquet", pid, snippet), stored_rows(spark, f"{root}/spikes.parquet", pid, snippet)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Long predictions, one folder per fold. There are few folds, and a probe may
    hold most rows, so each fold is spread by a hash of its channels."""
    spread = F.pmod(F.xxhash64("pid", "channel"), F.lit(64))
    predictions.repartition("fold", spread).write.mode("overwrite").partitionBy("fold").parquet(path)


def reuse_or_compute(
    wanted: DataFrame, existing: DataFrame | None, compute: Callable[[DataFrame], DataFrame], keys: Sequence[str] = ("pid", "snippet")
) -> DataFrame:
    """Existing rows of the wanted keys, and computed rows of the keys without any."""
    if existing is None:
        return compute(wanted.select(*keys).distinct())
    kept = existing.join(wanted.select(*keys).distinct(), list(keys), "left_semi")
    return kept.unionByName(compute(missing_keys(wanted, existing, keys)), allowMissingColumns=True)


# ---------------------------------------------------------------- models


def model_folder(root: str, meta: dict, identifier: str | None = None, subfolder: str = "") -> str:
    """`{VINTAGE}_{REGION_MAP}_{identifier}/{subfolder}`; the identifier defaults to a hash of the meta data."""
    text = json.dumps(meta, sort_keys=True, default=str)
    identifier = identifier or hashlib.md5(text.encode()).hexdigest()[:8]
    return "/".join(p for p in (root, f"{meta['VINTAGE']}_{meta['REGION_MAP']}_{identifier}", subfolder) if p)


def save_model(spark: SparkSession, root: str, model, meta: dict, subfolder: str = "", identifier: str | None = None) -> str:
    """Persist a model and its meta data; returns the folder."""
    full = {**meta, "MODEL_CLASS": f"{type(model).__module__}.{type(model).__name__}"}
    folder = model_folder(root, full, identifier, subfolder)
    model.write().overwrite().save(f"{folder}/model")
    spark.createDataFrame([(json.dumps(full, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(f"{folder}/meta")
    return folder


def load_model(spark: SparkSession, folder: str) -> tuple[object, dict]:
    """`(model, meta)` of one folder; only classes of `pyspark.ml` are loaded."""
    import importlib

    meta = json.loads(spark.read.text(f"{folder}/meta").first()[0])
    module, _, name = meta["MODEL_CLASS"].rpartition(".")
    if not module.startswith("pyspark.ml."):
        raise ValueError(f"{meta['MODEL_CLASS']} is no class of pyspark.ml")
    kind: type[MLReadable] = getattr(importlib.import_module(module), name)
    return kind.load(f"{folder}/model"), meta


def fold_name(i: int) -> str:
    return f"FOLD{i:02d}"


def load_folds(spark: SparkSession, root: str, n_folds: int = 5) -> tuple[list, list[dict]]:
    loaded = [load_model(spark, f"{root}/{fold_name(i)}") for i in range(n_folds)]
    return [m for m, _ in loaded], [meta for _, meta in loaded]


# ---------------------------------------------------------------- flat matrices


def write_flat_matrices(counts: DataFrame, path: str, group: str, n_rows: int, n_bins: int) -> DataFrame:
    """One int32 file of `(n_rows, n_bins)` per group from `(group, cluster_id, bin, n)`.

    A matrix is dense and of fixed size, so a group is bounded by
    `n_rows * n_bins` cells. Runs the job and returns its `(group, path, bytes)`.
    """
    cells = counts.groupBy(group, "cluster_id", "bin").agg(F.sum("n").alias("n"))
    schema = T.StructType([counts.schema[group], T.StructField("path", T.StringType()), T.StructField("bytes", T.LongType())])

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        matrix = np.zeros((n_rows, n_bins), dtype="<i4")
        matrix[pdf["cluster_id"].to_numpy(int), pdf["bin"].to_numpy(int)] = pdf["n"].to_numpy()
        target = f"{path}/{key[0]}.bin"
        filesystem, inner = fs.FileSystem.from_uri(arrow_uri(target))
        filesystem.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        with filesystem.open_output_stream(inner) as out:
            out.write(matrix.tobytes())
        return pd.DataFrame({group: [key[0]], "path": [target], "bytes": [matrix.nbytes]})

    return materialise(cells.groupBy(group).applyInPandas(write, schema), "matrices")
