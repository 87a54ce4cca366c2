"""Features of embedded rows, scores of labels along routes, and count tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import one_hot
from ..sources.tables import save
from .lookups import numbered, tile


def route_features(rows: DataFrame, routes: int, residuals: bool = True) -> DataFrame:
    """row_id, features: the route as one-hot, the position, the residual's norm and, if asked for, the residual."""
    parts = [one_hot(F.col("route_id"), F.lit(routes)), F.array("position", "residual_norm")]
    return rows.select("row_id", F.concat(*parts, *(["residual"] if residuals else [])).alias("features"))


def feature_names(routes: int, dimensions: int) -> list[str]:
    return [*(f"route_{i}" for i in range(routes)), "position", "residual_norm", *(f"residual_{i}" for i in range(dimensions))]


def label_counts(rows: DataFrame, key: str = "route_id", label: str = "label") -> DataFrame:
    return rows.groupBy(key, label).agg(F.count("*").alias("n"))


def purity(rows: DataFrame, key: str = "route_id", label: str = "label") -> DataFrame:
    """key, rows, label (the most frequent, ties to the least) and purity."""
    best = F.max_by(label, F.struct("n", F.negate(label))).alias(label)
    return label_counts(rows, key, label).groupBy(key).agg(F.sum("n").alias("rows"), best, (F.max("n") / F.sum("n")).alias("purity"))


def target_kind(rows: DataFrame, target: str) -> DataFrame:
    """One row, continuous: over 12 distinct values, and some that aren't whole or over 20."""
    d = F.count_distinct(target)
    fractions = F.coalesce(F.bool_or(F.col(target) != F.rint(target)), F.lit(False))
    return rows.agg(d.alias("values"), ((d > 12) & (fractions | (d > 20))).alias("continuous"))


def log_scaled(rows: DataFrame, key: str, score: str, scale: float = 1.0, q: float = 0.95) -> DataFrame:
    """rows with scaled: the sign of the score times log1p of its size over the key's quantile of sizes."""
    reference = rows.groupBy(key).agg(F.percentile(F.abs(F.col(score)), q).alias("reference"))
    sized = F.log1p(F.abs(F.col(score)) / F.greatest("reference", F.lit(1e-12)))
    return rows.join(reference, key).withColumn("scaled", scale * F.signum(score) * sized).drop("reference")


def ranks(rows: DataFrame, column: str, key: str) -> DataFrame:
    """rows with rank: the mean rank among equal values, within the key."""
    w = Window.partitionBy(key).orderBy(column)
    ties = Window.partitionBy(key, column)
    return rows.withColumn("rank", F.rank().over(w) + (F.count("*").over(ties) - 1) / 2)


def spearman(rows: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """key, rho, n: the correlation of mean ranks of both columns."""
    both = ranks(ranks(rows, a, key).withColumnRenamed("rank", "ra"), b, key)
    return both.groupBy(key).agg(F.corr("ra", "rank").alias("rho"), F.count("*").alias("n"))


def folds(rows: DataFrame, n: int = 10, seed: int = 0) -> DataFrame:
    """rows with fold, by a hash of row_id."""
    return rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), "row_id"), F.lit(n)).cast("int"))


def out_of_fold_accuracy(rows: DataFrame, estimator, n: int = 5) -> float:
    """The accuracy of an ML classifier on features (array) and label, each fold predicted from the others."""
    from pyspark.ml.functions import array_to_vector

    dealt = save(folds(rows, n).select("fold", array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label")), "folds")
    parts = [estimator.fit(dealt.where(F.col("fold") != f)).transform(dealt.where(F.col("fold") == f)).select("label", "prediction") for f in range(n)]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    return every.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]


def angular_sectors(points: DataFrame, sectors: int) -> DataFrame:
    """row_id, angle, sector: rows about the mean in order of angle, dealt to sectors of even size, larger ones first."""
    middle = F.broadcast(points.agg(F.avg(F.get("x", F.lit(0))).alias("mx"), F.avg(F.get("x", F.lit(1))).alias("my")))
    angle = F.atan2(F.get("x", F.lit(1)) - F.col("my"), F.get("x", F.lit(0)) - F.col("mx"))
    turned = points.join(middle).select("row_id", angle.alias("angle"))
    order = numbered(turned, "angle", "row_id")
    return order.select("row_id", "angle", tile(F.col("number"), F.col("whole"), sectors).alias("sector"))


def normalized_counts(counts: DataFrame, cell: str, gene: str, count: str, size: float = 1e4) -> DataFrame:
    """cell, gene, value: log1p of a cell's counts at one total size."""
    whole = counts.groupBy(cell).agg(F.sum(count).alias("whole"))
    return counts.join(whole, cell).select(cell, gene, F.log1p(F.col(count) / F.col("whole") * size).alias("value"))


def variable_genes(values: DataFrame, cell: str, gene: str, n: int) -> DataFrame:
    """gene, variance, cells of the n genes of largest population variance, cells without an entry counting as 0."""
    cells = F.broadcast(values.agg(F.count_distinct(cell).alias("all")))
    sums = values.groupBy(gene).agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"), F.count("*").alias("cells"))
    variance = F.col("ss") / F.col("all") - F.pow(F.col("s") / F.col("all"), F.lit(2))
    return sums.join(cells).select(gene, variance.alias("variance"), "cells").orderBy(F.desc(F.round("variance", 9)), gene).limit(n)
