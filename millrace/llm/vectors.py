"""Checks and shapes of vector columns that the vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def sound(embedding: Column) -> Column:
    """Whether a vector is neither null nor empty nor holds a null, NaN or infinite component."""
    infinite = [float("inf"), float("-inf")]
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & ~x.cast("double").isin(infinite))
    return F.coalesce(embedding.isNotNull() & (F.size(embedding) > 0) & fine, F.lit(False))


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Rows of equal length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, kind).reshape(len(column), -1)


class Forest:
    """Components of links that arrive in parts, over nodes 0 to n - 1, labelled by least node."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        label = self.label
        while len(x):
            lx, ly = label[x], label[y]
            open_ = lx != ly
            if not open_.any():
                break
            x, y, lx, ly = x[open_], y[open_], lx[open_], ly[open_]
            np.minimum.at(label, np.maximum(lx, ly), np.minimum(lx, ly))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
        self.label = label
