"""Column expressions over feature vectors (arrays); arithmetic is in double precision."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType, StringType

DOUBLES = "array<double>"


def dot(a: Column, b: Column) -> Column:
    """Inner product; null if either is null or an element is."""
    return F.aggregate(F.zip_with(a.cast(DOUBLES), b.cast(DOUBLES), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """The vector at length 1; null for a zero vector."""
    n = norm(a)
    return F.when(n > 0, F.zip_with(a.cast(DOUBLES), F.array_repeat(n, F.size(a)), lambda x, m: x / m))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine; null where either vector is null or zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def clip(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def zero_to_null(a: Column) -> Column:
    """A feature of zeros alone means no feature."""
    return F.when(F.exists(a, lambda x: x != 0), a)


@pandas_udf(ArrayType(FloatType()))
def decode_feature(encoded: pd.Series) -> pd.Series:
    """Base64 of little-endian 32-bit floats; null stays null."""
    return encoded.map(lambda s: None if s is None else np.frombuffer(base64.b64decode(s), "<f4"))


@pandas_udf(StringType())
def encode_feature(feature: pd.Series) -> pd.Series:
    return feature.map(lambda v: None if v is None else base64.b64encode(np.asarray(v, "<f4").tobytes()).decode())
