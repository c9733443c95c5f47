"""Array-vector expressions, evaluated in DOUBLE inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vec) -> Column:
    return F.col(vec).cast("array<double>") if isinstance(vec, str) else vec.cast("array<double>")


def dot(a, b) -> Column:
    """Inner product of two array columns."""
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(vec) -> Column:
    return F.sqrt(F.aggregate(as_double(vec), F.lit(0.0), lambda acc, x: acc + x * x))


def unit(vec) -> Column:
    """Row scaled to length one; a zero row stays zero."""
    length = norm(vec)
    return F.transform(as_double(vec), lambda x: F.coalesce(x / F.nullif(length, F.lit(0.0)), F.lit(0.0)))


def cosine_floor(distance) -> Column:
    """Cosine similarity from a cosine distance, floored at zero."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - distance)


def euclidean_radius(cosine: float) -> float:
    """Radius on the unit sphere that equals a cosine threshold."""
    return math.sqrt(max(0.0, 2.0 * (1.0 - cosine)))


def pack_sign_bits(values) -> Column:
    """Integer whose bit b says whether element b is positive."""
    indexed = F.transform(as_double(values), lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L"))
                          * F.pow(F.lit(2.0), i).cast("bigint"))
    return F.aggregate(indexed, F.expr("0L"), lambda acc, x: acc + x)


def hash_bit_count(n_rows: int, target_bucket: int = 2000) -> int:
    """Bits so that a bucket holds about ``target_bucket`` rows; a code is one 64-bit number, so at most 62."""
    return min(62, max(1, math.ceil(math.log2(max(2.0, n_rows / target_bucket)))))


def repeat_recall(single_table_recall: float, repeats: int) -> float:
    """Chance that a true pair shares a bucket in at least one of the repeats."""
    return 1.0 - (1.0 - single_table_recall) ** repeats


def angle_recall(angle: float, repeats: int) -> float:
    """Angle form of the recall model: 1 - (angle / pi) ** repeats."""
    return 1.0 - (angle / math.pi) ** repeats
