"""Vector columns: products, distances, quantisation and composed scores, as higher-order SQL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _pairs(a: Column, b: Column, f) -> Column:
    """Sum of f over the common length of two arrays, in double."""
    n = F.least(F.size(a), F.size(b))
    made = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: f(x.cast("double"), y.cast("double")))
    return F.aggregate(made, F.lit(0.0), lambda s, x: s + x)


def query(values: list[float]) -> Column:
    """A constant vector."""
    return F.array(*(F.lit(float(v)) for v in values))


def dot(a: str | Column, b: str | Column) -> Column:
    return _pairs(_c(a), _c(b), lambda x, y: x * y)


def squared_distance(a: str | Column, b: str | Column) -> Column:
    return _pairs(_c(a), _c(b), lambda x, y: (x - y) * (x - y))


def norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: str | Column, b: str | Column) -> Column:
    """0 if either norm is 0; the square root is exact."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def int8_dot(a: str | Column, b: str | Column) -> Column:
    return dot(a, b).cast("bigint")


def quantize_int8(v: str | Column) -> Column:
    """struct(scale, offset, vector): scale = range / 254, codes from -127, truncated towards zero."""
    low, high = F.array_min(_c(v)).cast("double"), F.array_max(_c(v)).cast("double")
    scale = F.greatest(high - low, F.lit(1e-7)) / 254
    codes = F.transform(_c(v), lambda x: F.greatest(F.lit(-128.0), F.least(F.lit(127.0), (x.cast("double") - low) / scale - 127)).cast("tinyint"))
    return F.struct(scale.alias("scale"), low.alias("offset"), codes.alias("vector"))


def dequantize_int8(q: str | Column) -> Column:
    q = _c(q)
    return F.transform(q["vector"], lambda x: (x.cast("double") + 127) * q["scale"] + q["offset"])


def quantize_4bit(v: str | Column) -> Column:
    """struct(scale, offset, codes): scale = range / 15, codes truncated and held within 0 to 15."""
    low, high = F.array_min(_c(v)).cast("double"), F.array_max(_c(v)).cast("double")
    scale = F.greatest(high - low, F.lit(1e-7)) / 15
    codes = F.transform(_c(v), lambda x: F.greatest(F.lit(0), F.least(F.lit(15), F.floor((x.cast("double") - low) / scale).cast("int"))))
    return F.struct(scale.alias("scale"), low.alias("offset"), codes.alias("codes"))


def pack_nibbles(codes: str | Column) -> Column:
    """Two codes to a byte value, the first in the low half; an odd last code has zero above it."""
    codes = _c(codes)
    at = F.sequence(F.lit(0), F.floor((F.size(codes) - 1) / 2).cast("int"))
    get = lambda i: F.coalesce(F.try_element_at(codes, i), F.lit(0))
    return F.when(F.size(codes) > 0, F.transform(at, lambda i: get(2 * i + 1) + get(2 * i + 2) * 16)).otherwise(F.array().cast("array<int>"))


def unpack_nibbles(packed: str | Column) -> Column:
    return F.flatten(F.transform(_c(packed), lambda b: F.array(b.bitwiseAND(15), F.shiftright(b, 4).bitwiseAND(15))))


def quantize_max(v: str | Column) -> Column:
    """struct(scale, vector): scale = largest magnitude / 127 (1 for zeros), codes truncated towards zero."""
    big = F.array_max(F.transform(_c(v), lambda x: F.abs(x.cast("double"))))
    scale = F.when(big > 0, big / 127).otherwise(1.0)
    return F.struct(scale.alias("scale"), F.transform(_c(v), lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), x.cast("double") / scale)).cast("tinyint")).alias("vector"))


def composed_score(
    vector: str | Column,
    like: list[float],
    weight: float,
    near: list[float] | None = None,
    near_weight: float = 0.0,
    timestamp: str | Column | None = None,
    newest: int | None = None,
    half_life: float = 1.0,
    decay_weight: float = 0.0,
) -> Column:
    """weight * cosine + near_weight / (1 + distance of the first three axes) + decay_weight * 2 ** -(age / half-life).

    A part that is not asked for has weight 0. Without ``newest`` the decay is 0, for the age is then beyond bounds.
    """
    score = F.lit(weight) * cosine(vector, query(like))
    if near is not None:
        score = score + F.lit(near_weight) / (1 + F.sqrt(squared_distance(F.slice(_c(vector), 1, 3), query(near[:3]))))
    if timestamp is not None and newest is not None:
        score = score + F.lit(decay_weight) * F.exp(-F.log(F.lit(2.0)) / max(half_life, 1.0) * (F.lit(float(newest)) - _c(timestamp)))
    return score
