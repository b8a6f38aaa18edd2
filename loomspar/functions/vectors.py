"""Vector functions on arrays of doubles, in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspar.functions.text import col

Number = float | Column


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def doubles(v: Column | str) -> Column:
    return col(v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def normalise(v: Column) -> Column:
    """Length 1; a zero vector stays zero."""
    n = norm(v)
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def scale(v: Column, by: Number) -> Column:
    return F.transform(v, lambda x: x * by)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def mean_pool(vectors: Column, mask: Column) -> Column:
    """Mean of the vectors (array of arrays) where the mask (array of 0 and 1) is 1; the count is at least 1e-9."""
    kept = F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x * m))
    summed = F.reduce(F.slice(kept, 2, 1 << 20), F.get(kept, F.lit(0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return scale(summed, 1.0 / F.greatest(total(F.transform(mask, lambda m: m.cast("double"))), F.lit(1e-9)))


def fuse(fields: Sequence[Column], weights: Sequence[float], present: Sequence[bool] | None = None, rescale: bool = True) -> Column:
    """Weighted sum of fields, normalised. Fields absent in all rows count as zeros; rescale: the other weights then sum to 1."""
    present = present or [True] * len(fields)
    kept = [(f, w) for f, w, p in zip(fields, weights, present, strict=True) if p]
    whole = sum(w for _, w in kept) if rescale else 1.0
    out = scale(kept[0][0], kept[0][1] / whole)
    for f, w in kept[1:]:
        out = add(out, scale(f, w / whole))
    return normalise(out)
