"""Classical scaling: coordinates from distances, fitted on landmarks and found for every row from its distances to them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..sources.tables import subsample

#: Rows that a scaling is fitted on, at most: their distances among each other are one matrix on the driver.
MOST_LANDMARKS = 2000
LEAST_SHARE = 1e-12


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d2 = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        d2 += (a[:, j][:, None] - b[:, j][None]) ** 2
    return d2


@dataclass
class Scaling:
    """The landmarks, the means of their squared distances, and the axes that centred squared distances are multiplied by."""

    landmarks: np.ndarray
    means: np.ndarray
    axes: np.ndarray
    components: int

    def coordinates(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.components))
        if self.axes.shape[1]:
            d2 = _squared(x, self.landmarks)
            out[:, : self.axes.shape[1]] = -0.5 * (d2 - d2.mean(1, keepdims=True) - self.means + self.means.mean()) @ self.axes
        return out


def fitted_scaling(points: DataFrame, components: int = 2, landmarks: int = MOST_LANDMARKS, seed: int = 0) -> Scaling:
    """Classical scaling of a sample of rows (row_id, x), all of them if there are no more than landmarks; directions without extent stay zero.

    An axis's largest landmark coordinate is positive.
    """
    if components < 1 or not 2 <= landmarks <= MOST_LANDMARKS:
        raise ValueError(f"one component or more, and 2 to {MOST_LANDMARKS} landmarks")
    rows = sorted(subsample(points.select("row_id", "x"), landmarks, seed).collect(), key=lambda r: r["row_id"])
    if len(rows) < 2:
        raise ValueError("two rows at least")
    x = np.array([r["x"] for r in rows], float)
    d2 = _squared(x, x)
    means = d2.mean(1)
    values, vectors = np.linalg.eigh(-0.5 * (d2 - means[:, None] - means[None] + means.mean()))
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(LEAST_SHARE, np.abs(values).max() * LEAST_SHARE)]
    vectors = vectors[:, order] * np.sign(vectors[np.abs(vectors[:, order]).argmax(0), order])
    return Scaling(x, means, vectors / np.sqrt(values[order]), components)


def scaled_rows(points: DataFrame, scaling: Scaling) -> DataFrame:
    """The rows with x as their coordinates; each row's hang on its distances to the landmarks alone, not on its batch."""
    shared = points.sparkSession.sparkContext.broadcast(scaling)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for at in range(0, len(frame), 1024):
                part = frame.iloc[at : at + 1024]
                yield part.assign(x=list(shared.value.coordinates(np.array(part["x"].tolist(), float))))

    return points.mapInPandas(run, points.schema)
