"""Numeric expressions; division is guarded, as ANSI mode raises where the semantics have a value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import B, K1


def idf(documents: Column, postings: Column) -> Column:
    """Natural log of documents / (postings + 1): 0 or less for frequent terms; minus infinity without documents."""
    return F.when(documents == 0, F.lit(float("-inf"))).otherwise(F.log(documents.cast("double") / (postings + 1)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def five_numbers(values: Column) -> dict[str, Column]:
    """Sum, least, largest, mean and population variance of an array of doubles, in the array's order; zeros if it is empty.

    Least and largest pass over NaN, as comparisons with it are false.
    """
    n = F.size(values)
    known = F.filter(values, lambda x: ~F.isnan(x))
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    mean = F.when(n > 0, total / n).otherwise(0.0)
    variance = F.aggregate(F.transform(values, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x)
    return {
        "sum": total,
        "min": F.coalesce(F.array_min(known), F.lit(0.0)),
        "max": F.coalesce(F.array_max(known), F.lit(0.0)),
        "mean": mean,
        "variance": F.when(n > 0, variance / n).otherwise(0.0),
    }


def bm25_term(tf: Column, weight: Column, length: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    """One occurrence's share. Without an average length the denominator is infinite (share 0), or not a number for an empty document."""
    tf = tf.cast("double")
    relative = F.when(average == 0, F.when(length > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))).otherwise(length / F.nullif(average, F.lit(0.0)))
    below = tf + k1 * (1 - b + b * relative)
    return F.when(below == 0, F.lit(float("nan"))).otherwise(weight * tf * (k1 + 1) / F.nullif(below, F.lit(0.0)))


def smoothed_cross_entropy(label: Column, p: Column, smoothing: float = 0.1) -> Column:
    """Cross-entropy of two classes (label 0 or 1, p of class 1) with smoothed targets."""
    target = label * (1 - smoothing) + smoothing / 2
    return -(target * F.log(p) + (1 - target) * F.log(1 - p))
