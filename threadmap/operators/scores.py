"""How well rows' coordinates tell a target within each route, out of fold, for all routes and folds at once.

One pass sums outer products by route and fold. What a fold is predicted from is all of its route less the
fold itself, so every model comes of the same sums by subtraction; a second pass predicts each row by
the model that hasn't seen it. Targets are told by ridge regression, classes by one for each and the largest of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import save
from .features import spearman
from .replicates import share

#: Classes that are told apart, at most; weight of the ridge, as a share of the mean square of features.
MOST_CLASSES, RIDGE = 1000, 1e-9


def dealt(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """rows with fold, of so many, by a hash of row_id that other engines have too."""
    return rows.withColumn("fold", F.floor(share(seed, "row_id") * n).cast("int"))


def _design(features) -> np.ndarray:
    x = np.array(features.tolist(), float)
    return np.c_[np.ones(len(x)), x]


def fold_sums(rows: DataFrame, classes: list | None) -> DataFrame:
    """route_id, fold, i, j, s: the sums of outer products of (1, features, targets) of rows (route_id, fold, features, target), for i <= j."""
    at = None if classes is None else {c: i for i, c in enumerate(classes)}
    shared = rows.sparkSession.sparkContext.broadcast(at)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for frame in batches:
            for key, part in frame.groupby(["route_id", "fold"]):
                y = part["target"].to_numpy(float)[:, None] if shared.value is None else np.eye(len(shared.value))[[shared.value[t] for t in part["target"]]]
                z = np.c_[_design(part["features"]), y]
                total[key] = total.get(key, 0.0) + z.T @ z
        for (route, fold), m in total.items():
            i, j = np.triu_indices(len(m))
            yield pd.DataFrame({"route_id": route, "fold": fold, "i": i, "j": j, "s": m[i, j]}).astype({c: "int32" for c in ("route_id", "fold", "i", "j")})

    return rows.select("route_id", "fold", "features", "target").mapInPandas(add, "route_id int, fold int, i int, j int, s double").groupBy("route_id", "fold", "i", "j").agg(F.sum("s").alias("s"))


def fold_models(sums: DataFrame, folds: int, targets: int) -> DataFrame:
    """route_id, fold, weights (features x targets, row by row): the model of each fold from all others of its route."""

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        size = int(frame["j"].max()) + 1
        each = np.zeros((folds, size, size))
        each[frame["fold"], frame["i"], frame["j"]] = each[frame["fold"], frame["j"], frame["i"]] = frame["s"]
        p = size - targets
        out = []
        for f in range(folds):
            m = each.sum(0) - each[f]
            ridge = np.eye(p) * RIDGE * max(np.trace(m[:p, :p]) / p, 1e-300)
            ridge[0, 0] = 0.0
            out.append(np.linalg.lstsq(m[:p, :p] + ridge, m[:p, p:], rcond=None)[0].ravel())
        return pd.DataFrame({"route_id": int(frame["route_id"].iloc[0]), "fold": np.arange(folds), "weights": out}).astype({"route_id": "int32", "fold": "int32"})

    return sums.groupBy("route_id").applyInPandas(solve, "route_id int, fold int, weights array<double>")  # sums of a route: folds x features squared


def predicted(rows: DataFrame, models: DataFrame, classes: list | None) -> DataFrame:
    """row_id, route_id, target, prediction of each row by its route's model of the other folds."""
    kind = rows.schema["target"].dataType.simpleString() if classes is not None else "double"
    table = {(r["route_id"], r["fold"]): np.array(r["weights"]) for r in models.toLocalIterator()}  # of routes and folds
    shared = rows.sparkSession.sparkContext.broadcast((table, classes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, classes = shared.value
        for frame in batches:
            for key, part in frame.groupby(["route_id", "fold"]):
                x = _design(part["features"])
                y = x @ table[key].reshape(x.shape[1], -1)
                told = y[:, 0] if classes is None else [classes[i] for i in y.argmax(1)]
                yield pd.DataFrame({"row_id": part["row_id"], "route_id": part["route_id"], "target": part["target"], "prediction": told})

    target = rows.schema["target"].dataType.simpleString()
    return rows.select("row_id", "route_id", "fold", "features", "target").mapInPandas(run, f"row_id long, route_id int, target {target}, prediction {kind}")


def route_classification(rows: DataFrame, routes: int, folds: int = 10, seed: int = 0) -> DataFrame:
    """route_id, n_samples, n_classes, route_purity, accuracy, normalized_accuracy, valid, status for each of so many routes.

    rows: row_id, route_id, features, target (class). normalized_accuracy is 0 at chance among all classes and 1 where all are right. Routes without
    rows, of one class (which are perfect), or with fewer rows than folds are told by their status.
    """
    if folds < 2:
        raise ValueError("two folds at least")
    held = save(dealt(rows.where("target IS NOT NULL").select("row_id", F.col("route_id").cast("int").alias("route_id"), "features", "target"), folds, seed), "score-rows")
    classes = sorted(r[0] for r in held.select("target").distinct().limit(MOST_CLASSES + 1).collect())
    if len(classes) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    chance = 1 / len(classes) if len(classes) > 1 else 0.0
    counted = held.groupBy("route_id").agg(F.count("*").alias("n_samples"), F.count_distinct("target").alias("n_classes"))
    most = held.groupBy("route_id", "target").agg(F.count("*").alias("n")).groupBy("route_id").agg(F.max("n").alias("most"))
    tried = counted.where((F.col("n_classes") > 1) & (F.col("n_samples") >= folds)).select("route_id")
    own = save(held.join(F.broadcast(tried), "route_id", "left_semi"), "scored-rows")
    told = predicted(own, fold_models(fold_sums(own, classes), folds, len(classes)), classes)
    hits = told.groupBy("route_id").agg(F.avg((F.col("target") == F.col("prediction")).cast("double")).alias("a"))
    every = rows.sparkSession.range(routes).select(F.col("id").cast("int").alias("route_id"))
    out = every.join(counted, "route_id", "left").join(most, "route_id", "left").join(hits, "route_id", "left")
    accuracy = F.when(F.col("n_classes") == 1, F.lit(1.0)).otherwise(F.col("a"))
    status = F.when(F.col("n_samples").isNull(), "empty route").when(F.col("n_classes") == 1, "pure route").when(F.col("n_samples") < folds, f"insufficient samples for {folds}-fold classification").otherwise("ok")
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (accuracy - chance) / max(1 - chance, 1e-12)))
    return out.select(
        "route_id", F.coalesce("n_samples", F.lit(0)).alias("n_samples"), F.coalesce("n_classes", F.lit(0)).alias("n_classes"), (F.col("most") / F.col("n_samples")).alias("route_purity"),
        accuracy.alias("accuracy"), F.when(accuracy.isNotNull(), scaled).alias("normalized_accuracy"), accuracy.isNotNull().alias("valid"), status.alias("status"),
    )


def route_regression(rows: DataFrame, routes: int, folds: int = 10, seed: int = 0) -> DataFrame:
    """route_id, n_samples, rank_correlation (of predictions and targets), r2, valid, status for each of so many routes; rows: row_id, route_id, features, target (a number).

    Routes without rows, with one value of the target (no order to keep), or with fewer rows than folds are told by their status.
    """
    if folds < 2:
        raise ValueError("two folds at least")
    held = save(dealt(rows.where("target IS NOT NULL").select("row_id", F.col("route_id").cast("int").alias("route_id"), "features", F.col("target").cast("double").alias("target")), folds, seed), "score-rows")
    counted = held.groupBy("route_id").agg(F.count("*").alias("n_samples"), F.min("target").alias("low"), F.max("target").alias("high"))
    tried = counted.where((F.col("low") < F.col("high")) & (F.col("n_samples") >= folds)).select("route_id")
    own = save(held.join(F.broadcast(tried), "route_id", "left_semi"), "scored-rows")
    told = save(predicted(own, fold_models(fold_sums(own, None), folds, 1), None), "predictions")
    order = spearman(told, "target", "prediction", "route_id").select("route_id", F.col("rho").alias("rank_correlation"))
    off = F.sum(F.pow(F.col("target") - F.col("prediction"), F.lit(2)))
    fit = told.groupBy("route_id").agg((1 - off / (F.var_pop("target") * F.count("*"))).alias("r2"))
    every = rows.sparkSession.range(routes).select(F.col("id").cast("int").alias("route_id"))
    out = every.join(counted, "route_id", "left").join(order, "route_id", "left").join(fit, "route_id", "left")
    status = F.when(F.col("n_samples").isNull(), "empty route").when(F.col("n_samples") < folds, f"insufficient samples for {folds}-fold regression").when(F.col("low") == F.col("high"), "constant target").otherwise("ok")
    return out.select("route_id", F.coalesce("n_samples", F.lit(0)).alias("n_samples"), "rank_correlation", "r2", F.col("r2").isNotNull().alias("valid"), status.alias("status"))
