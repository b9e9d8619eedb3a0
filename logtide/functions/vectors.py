"""Vector helpers on ``array<double>`` columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from ..constants import FEATURE_COLUMNS


def feature_vector(available: Sequence[str],
                   features: Sequence[str] = FEATURE_COLUMNS) -> Column:
    """Model input: the feature columns present, always in the same order, null as 0."""
    names = [name for name in features if name in set(available)]
    if not names:
        raise ValueError("none of the feature columns is present")
    return F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names])


def of_width(vector: Column, width: int | None) -> Column:
    """The vector; an error where its length is not ``width`` (or null, without that)."""
    if width is None:
        return vector
    return F.when(F.size(vector) == width, vector).otherwise(F.raise_error(F.concat(
        F.lit(f"the model takes vectors of {width} values, not of "),
        F.size(vector).cast("string"))))


def flatten_pattern(windows: Column) -> Column:
    """Windows x features to one vector, row by row."""
    return F.flatten(windows)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two vectors of equal length. A zero vector is similar to nothing: 0."""
    return F.coalesce(F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))),
                      F.lit(0.0))
