"""Numeric functions as Column expressions: vectors, logistic functions, a counter-based generator, item response."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 4294967295


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = F.coalesce(F.nullif(norm(a), F.lit(0.0)), F.lit(1.0))
    return F.element_at(F.transform(F.array(n), lambda k: F.transform(a, lambda x: x / k)), 1)


def cosine(a: Column, b: Column) -> Column:
    """0 where a side is zero."""
    return dot(a, b) / F.coalesce(F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(1.0))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(a: Column, s: float) -> Column:
    return F.transform(a, lambda x: x * s)


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def softplus(x: Column) -> Column:
    return F.when(x > 20, x).otherwise(F.log1p(F.exp(x)))


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product, by halves so that no step overflows."""
    high = F.shiftrightunsigned(a, 16) * b.bitwiseAND(F.lit(65535))
    return ((a.bitwiseAND(F.lit(65535)) * b) + F.shiftleft(high.bitwiseAND(F.lit(65535)), 16)).bitwiseAND(F.lit(MASK))


def uniform(seed: Column, draw: Column) -> Column:
    """The ``draw``-th (from 1) number in [0, 1) of the 32-bit counter generator mulberry32, independent of any order."""
    state = (seed + draw * F.lit(1831565813)).bitwiseAND(F.lit(MASK)).cast("bigint")
    t = _times(state.bitwiseXOR(F.shiftrightunsigned(state, 15)), state.bitwiseOR(F.lit(1)))
    mixed = (t + _times(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(MASK)).bitwiseXOR(t)
    return mixed.bitwiseXOR(F.shiftrightunsigned(mixed, 14)).bitwiseAND(F.lit(MASK)) / F.lit(4294967296.0)


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of the text's code points below 256."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    return F.aggregate(codes, F.lit(2166136261).cast("bigint"), lambda h, c: _times(h.bitwiseXOR(c), F.lit(16777619).cast("bigint")))


def zipf_volume(rank: Column, head: Column, u1: Column, u2: Column) -> Column:
    """Search volume of a keyword by rank, with noise from two uniform draws."""
    factor = F.when(head, 1.0).otherwise(0.05 + 0.35 * u1)
    return F.greatest(F.lit(30), F.round(60000 / F.pow(rank + 1, F.lit(0.75)) * factor * F.exp((u2 - 0.5) * 0.8))).cast("bigint")


def item_information(a: Column, b: Column, theta: Column) -> Column:
    p = sigmoid(a * (theta - b))
    return a * a * p * (1 - p)
