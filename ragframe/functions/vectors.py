"""Vector building blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_squared(a: Column, b: Column) -> Column:
    """Squared L2 distance summed left to right in double precision; orders
    like the rooted one. Null for a null vector; other lengths raise."""
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(
        F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different length")).cast("double")).otherwise(F.aggregate(
        F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) *
                   (x.cast("double") - y.cast("double"))),
        F.lit(0.0).cast("double"), lambda acc, x: acc + x))


def is_vector(v: Column, dim: Column | int) -> Column:
    """True for a vector of ``dim`` components, none of them null or NaN; never null."""
    return F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))


def parse_vector(c: Column) -> Column:
    """'[0.1, -2, 3e-2]' -> array<float>; malformed text -> null."""
    return F.from_json(c, "array<float>")


def vector_to_text(c: Column) -> Column:
    return F.to_json(c)
