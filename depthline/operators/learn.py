"""Region classifier: probe-grouped folds, training, inference, scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthline.operators.ordered import dense_index
from depthline.operators.spatial import denoise_features
from depthline.session import materialise


def grouped_folds(
    df: DataFrame, group: str, n_folds: int = 5, seed: int = 12345, order: Column | None = None
) -> DataFrame:
    """`(group, fold)`: whole groups per fold, sizes as equal as floor(i/n*k) makes them.

    Groups are shuffled by a seeded digest and numbered range by range, so ranking
    them needs no single-task sort. Give `order` for another order.
    """
    members = df.select(group).distinct()
    if order is None:
        order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")).cast("binary"))
    placed = dense_index(members.withColumn("_rank", order), [], ["_rank", group], None, "_pos")
    total = members.agg(F.count(F.lit(1))).scalar()
    fold = F.floor(F.col("_pos") * F.lit(n_folds) / total).cast("int")
    return placed.select(group, F.least(fold, F.lit(n_folds - 1)).alias("fold"))


def class_position(column: str, classes: Sequence) -> Column:
    """0-based position in a short class list, NULL when absent."""
    at = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(column))
    return F.when(at > 0, (at - 1).cast("double"))


@dataclass
class FoldResult:
    models: list
    predictions: DataFrame
    classes: list
    meta: dict = field(default_factory=dict)


def _classifier(seed: int, trees: int, depth: int) -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed, maxMemoryInMB=512
    )


def train_folds(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    keys: Sequence[str],
    n_folds: int = 5,
    seed: int = 713705,
    trees: int = 20,
    depth: int = 5,
    vector: str | None = None,
    parallelism: int = 5,
) -> FoldResult:
    """Fit one model per fold on the other folds and predict the held-out rows.

    `df` carries a `fold` column. Raises when a training fold lacks a class.
    The assembled rows are written once and read by every fit.
    """
    tally = {(r[0], r[1]): r[2] for r in df.groupBy("fold", label).count().collect()}
    classes = sorted({c for _, c in tally})
    for i in range(n_folds):
        lacking = [c for c in classes if not any(f != i and k == c for f, k in tally)]
        if lacking:
            raise ValueError(f"classes {lacking} do not occur outside fold {i}")
    assembled = (
        df.withColumn("_x", F.col(vector))
        if vector
        else VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep").transform(df)
    )
    rows = materialise(
        assembled.select(*keys, "fold", label, class_position(label, classes).alias("_y"), "_x"), "training"
    )

    def fit(i: int):
        return _classifier(seed + i, trees, depth).fit(rows.filter(F.col("fold") != i))

    # The fits do not depend on each other; side by side they fill a cluster better.
    with ThreadPool(min(n_folds, parallelism)) as pool:
        models = pool.map(inheritable_thread_target(df.sparkSession)(fit), range(n_folds))
    held_out = [
        _scored(rows.filter(F.col("fold") == i), model, classes, [*keys, "fold", label]) for i, model in enumerate(models)
    ]
    predictions = reduce(DataFrame.unionByName, held_out)
    meta = {"RANDOM_SEED": seed, "FEATURES": list(features), "CLASSES": classes}
    return FoldResult(models, predictions, classes, meta)


def _scored(rows: DataFrame, model, classes: Sequence, columns: Sequence[str]) -> DataFrame:
    names = F.array(*[F.lit(c) for c in classes])
    return model.transform(rows).select(
        *columns,
        F.element_at(names, (F.col("prediction") + 1).cast("int")).alias("predicted"),
        vector_to_array("probability").alias("probas"),
    )


def long_probabilities(predictions: DataFrame, keys: Sequence[str], classes: Sequence) -> DataFrame:
    """One row per key and class."""
    names = F.array(*[F.lit(c) for c in classes])
    return predictions.select(*keys, F.posexplode("probas").alias("class_index", "proba")).select(
        *keys, "class_index", F.element_at(names, F.col("class_index") + 1).alias("class_id"), "proba"
    )


def infer_regions(
    df: DataFrame,
    models: Sequence,
    metas: Sequence[dict],
    keys: Sequence[str] | None = None,
    denoise: bool = True,
    fac: float = 1.0,
) -> DataFrame:
    """`(fold, keys, probas, predicted_index)` of every fold's model.

    The keys are probe, snippet (where there is one) and channel; each snippet
    of a probe is smoothed by itself.

    Smoothing does not depend on the fold and is done once; the models then
    follow each other over the same rows, so the table is read once.
    """
    keys = list(keys or [k for k in ("pid", "snippet", "channel") if k in df.columns])
    ready = df.withColumn("outside", F.lit(0.0))
    if denoise:
        ready = denoise_features(ready, fac=fac, keys=[k for k in keys if k != "channel"])
    out = ready
    for i, (model, meta) in enumerate(zip(models, metas)):
        assembler = VectorAssembler(inputCols=list(meta["FEATURES"]), outputCol=f"_x{i}", handleInvalid="keep")
        scorer = (
            model.copy()
            .setFeaturesCol(f"_x{i}")
            .setPredictionCol(f"_p{i}")
            .setProbabilityCol(f"_q{i}")
            .setRawPredictionCol(f"_r{i}")
        )
        out = scorer.transform(assembler.transform(out)).drop(f"_x{i}", f"_r{i}")
    folds = F.array(
        *[
            F.struct(
                F.lit(i).alias("fold"),
                vector_to_array(f"_q{i}").alias("probas"),
                F.col(f"_p{i}").cast("int").alias("predicted_index"),
            )
            for i in range(len(models))
        ]
    )
    return out.select(*keys, F.inline(folds))
