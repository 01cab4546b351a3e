"""Vectors as arrays of numbers; all sums are in double precision."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def literal(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values)) if len(values) else F.array().cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """The sum of products; a longer vector is cut to the shorter one."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(doubles(a), lambda x: x * x), F.lit(0.0), lambda s, x: s + x))


def normalize(a: Column) -> Column:
    """Scaled to length one; a zero vector stays."""
    return F.when(norm(a) > 0, F.zip_with(doubles(a), F.array_repeat(norm(a), F.size(a)), lambda x, n: x / n)).otherwise(doubles(a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(0.0)


@F.pandas_udf(ArrayType(FloatType()))
def from_blob(blobs: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Little-endian 32-bit floats to a vector, for import."""
    for s in blobs:
        yield s.map(lambda x: None if x is None else np.frombuffer(x, "<f4"))


@F.pandas_udf(BinaryType())
def to_blob(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A vector to little-endian 32-bit floats, for export."""
    for s in vectors:
        yield s.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())
