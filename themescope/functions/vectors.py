"""Vector columns: unit length, ML vectors, and Arrow batches as NumPy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

FEATURES = "features"


def with_unit_features(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Add ``features``, the L2-normalised ML vector; a zero vector stays zero."""
    raw = df.withColumn("_raw", array_to_vector(F.col(vector)))
    return Normalizer(inputCol="_raw", outputCol=FEATURES, p=2.0).transform(raw).drop("_raw")


def normalise_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Replace the array column by its unit vector (array of double)."""
    unit = with_unit_features(df, vector)
    return unit.withColumn(vector, vector_to_array(F.col(FEATURES))).drop(FEATURES)


def as_matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of one Arrow batch as a float64 matrix; all vectors must have one length."""
    if len(vectors) == 0:
        return np.zeros((0, 0))
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if vectors.null_count or len(flat) % len(vectors):
        raise ValueError("vectors must be present and of equal length")
    return np.asarray(flat, dtype=np.float64).reshape(len(vectors), -1)
