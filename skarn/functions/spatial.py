"""Curves, wrapped axes, hulls and fixed-point units."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def morton_3d(x: str | Column, y: str | Column, z: str | Column, bits: int = 21) -> Column:
    """Interleaved bits of three coordinates, x lowest."""
    key = F.lit(0).cast("bigint")
    for axis, c in enumerate((x, y, z)):
        v = _c(c).cast("bigint")
        for b in range(bits):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(v, b).bitwiseAND(1), 3 * b + axis))
    return key


def _hilbert(x: np.ndarray, y: np.ndarray, z: np.ndarray, bits: int) -> np.ndarray:
    """Skilling's transform of axes to a Hilbert index, for whole arrays."""
    axes = [np.asarray(a, np.int64).copy() for a in (x, y, z)]
    q = np.int64(1) << (bits - 1)
    while q > 1:
        p = q - 1
        for a in axes:
            hit = (a & q) != 0
            swap = np.where(hit, 0, (axes[0] ^ a) & p)
            axes[0] ^= np.where(hit, p, swap)
            if a is not axes[0]:
                a ^= swap
        q >>= 1
    axes[1] ^= axes[0]
    axes[2] ^= axes[1]
    turn, q = np.zeros_like(axes[0]), np.int64(1) << (bits - 1)
    while q > 1:
        turn ^= np.where((axes[2] & q) != 0, q - 1, 0)
        q >>= 1
    key = np.zeros_like(turn)
    for b in range(bits - 1, -1, -1):
        for a in axes:
            key = key << 1 | ((a ^ turn) >> b & 1)
    return key


def hilbert_3d(x: str | Column, y: str | Column, z: str | Column, bits: int = 21) -> Column:
    """Hilbert index of three coordinates of ``bits`` bits; consecutive indices are neighbouring cells."""

    @F.pandas_udf("bigint")
    def key(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(_hilbert(a.to_numpy(), b.to_numpy(), c.to_numpy(), bits))

    return key(_c(x).cast("bigint"), _c(y).cast("bigint"), _c(z).cast("bigint"))


def wrapped_contains(low: float, high: float, value: str | Column, period: float) -> Column:
    """Whether a value lies in an interval of an axis that wraps; an interval with low > high goes round the end."""
    v, a, b = F.pmod(_c(value).cast("double"), F.lit(period)), low % period, high % period
    return (v >= a) & (v <= b) if a <= b else (v >= a) | (v <= b)


def wrapped_distance(a: list[Column], b: list[Column], period: float) -> Column:
    """Euclidean distance where each axis wraps."""
    total = F.lit(0.0)
    for x, y in zip(a, b, strict=True):
        d = F.pmod(F.abs(x - y), F.lit(period))
        d = F.least(d, F.lit(period) - d)
        total = total + d * d
    return F.sqrt(total)


def dop14(x: str | Column, y: str | Column, z: str | Column) -> list[Column]:
    """Projections on the seven axes of a 14-sided hull: the three axes and the four diagonals."""
    x, y, z = _c(x), _c(y), _c(z)
    return [x, y, z, x + y + z, x + y - z, x - y + z, x - y - z]


def in_box(low: list[float], high: list[float], *axes: str | Column) -> Column:
    """Inclusive box; one range test for each axis, so each reaches the scan."""
    test = F.lit(True)
    for a, b, c in zip(low, high, axes, strict=True):
        test = test & _c(c).between(a, b)
    return test


def to_micro(degrees: str | Column) -> Column:
    return F.round(_c(degrees) * 1_000_000).cast("int")


def from_micro(micro: str | Column) -> Column:
    return _c(micro) / F.lit(1_000_000.0)


def wearable_code(value: str | Column) -> Column:
    """value * 256, truncated and held within 16 bits."""
    v = _c(value) * 256
    return F.greatest(F.lit(-32768), F.least(F.lit(32767), F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).cast("int")))


def frame_code(value: str | Column, offset: float, step: float) -> Column:
    """Steps above an offset, rounded half away from zero; 0 without a step."""
    if step == 0:
        return F.lit(0)
    v = (_c(value) - offset) / step
    return F.when(v >= 0, F.floor(v + 0.5)).otherwise(F.ceil(v - 0.5)).cast("int")


def zigzag(delta: str | Column) -> Column:
    """0, -1, 1, -2, ... as 0, 1, 2, 3, ..."""
    d = _c(delta).cast("bigint")
    return F.shiftleft(d, 1).bitwiseXOR(F.shiftright(d, 63))


def quaternion_norm(q: str | Column) -> Column:
    return F.sqrt(F.aggregate(_c(q), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


GEOPOSE = "struct<position:struct<lat:double,lon:double,h:double>,quaternion:struct<x:double,y:double,z:double,w:double>>"


def geopose_json(lat: str | Column, lon: str | Column, h: str | Column, quaternion: str | Column) -> Column:
    """A basic pose as JSON: position, and a unit quaternion (x, y, z, w)."""
    q = _c(quaternion)
    return F.to_json(F.struct(F.struct(_c(lat).alias("lat"), _c(lon).alias("lon"), _c(h).alias("h")).alias("position"), F.struct(*(q[i].alias(n) for i, n in enumerate("xyzw"))).alias("quaternion")))


def geopose(text: str | Column, tolerance: float = 1e-6) -> Column:
    """The pose of a JSON text; null where a part is missing, out of range, or the quaternion is no unit."""
    p = F.from_json(_c(text), GEOPOSE)
    q = F.array(*(p["quaternion"][n] for n in "xyzw"))
    good = p["position"]["lat"].between(-90, 90) & p["position"]["lon"].between(-180, 180) & p["position"]["h"].isNotNull() & (F.abs(quaternion_norm(q) - 1) <= tolerance)
    return F.when(good, p)
