"""Bounded samples of labelled documents, and exact top-k thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled documents that a classifier is fitted to, those whose ids have the smallest hashes. Only the fit is bounded.
FIT_ROWS = 20_000


def smallest_hashes(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """At most bound rows of a table without repeats, those whose keys have the smallest hashes. The rows are counted and
    cut by hash first, so what is sorted in one task has little more than bound rows however large the table is."""
    units = 1 << 30
    h = F.pmod(F.xxhash64(F.lit(11), key), F.lit(units))
    n = rows.count()
    if n > bound:
        rows = rows.where(h < int(units * min(1.0, (bound + 8 * bound**0.5 + 16) / n)))
    return rows.orderBy(h, key).limit(bound)


def with_labels(docs: DataFrame, labels: DataFrame, value: Column, id_col: str = "doc_id", bound: int = FIT_ROWS, name: str = "_label") -> DataFrame:
    """docs with the label value of at most bound documents, null for the others. The sample has at most bound rows of two
    numbers, so it is broadcast. Of several labels of one document the smallest counts; rows without id or value don't."""
    sample = labels.select(F.col("doc_id").alias("_id"), value.alias(name)).where(F.col("_id").isNotNull() & F.col(name).isNotNull())
    sample = smallest_hashes(sample.groupBy("_id").agg(F.min(name).alias(name)), "_id", bound)
    return docs.join(F.broadcast(sample), F.col(id_col) == F.col("_id"), "left").drop("_id")


def kth_largest(df: DataFrame, column: str, k: int, few: int = 20_000) -> float:
    """The k-th largest value of a column without nulls and NaN; -inf if there are fewer rows, inf for k = 0.

    Doubles are numbered in their order; each pass counts the rows in 256 even stretches of the numbers left, so at most
    256 counts come to the driver, and once a stretch has at most `few` rows their values do. Eight passes at most.
    """
    if k <= 0:
        return float("inf")
    import struct

    rows = df.select((F.col(column).cast("double") + 0.0).alias("x"))
    if rows.count() < k:
        return float("-inf")

    def value(bits: int) -> float:
        raw = bits ^ (1 << 63) if bits >> 63 else bits ^ ((1 << 64) - 1)
        return struct.unpack(">d", struct.pack(">Q", raw))[0]

    def bits(x: float) -> int:
        raw = struct.unpack(">Q", struct.pack(">d", x))[0]
        return raw ^ ((1 << 64) - 1) if raw >> 63 else raw | (1 << 63)

    smallest, largest = rows.agg(F.min("x"), F.max("x")).first()
    lo, hi = bits(smallest), bits(largest)
    left = k
    while lo < hi:
        # 255 cuts that are even in the order of bits; rows in a stretch are counted, and the stretch with the k-th is taken.
        cuts = sorted({lo + (hi - lo) * i // 256 for i in range(1, 256)} - {lo})
        edges = F.array(*[F.lit(value(c)) for c in cuts])
        inside = rows.where((F.col("x") >= F.lit(value(lo))) & (F.col("x") <= F.lit(value(hi))))
        counts = dict(inside.groupBy(F.size(F.filter(edges, lambda e: F.col("x") >= e)).alias("b")).count().collect())
        bounds = [lo, *cuts, hi + 1]
        for b in sorted(counts, reverse=True):
            if counts[b] >= left:
                lo, hi = bounds[b], bounds[b + 1] - 1
                if counts[b] <= few:
                    values = sorted((r.x for r in rows.where((F.col("x") >= F.lit(value(lo))) & (F.col("x") <= F.lit(value(hi)))).collect()), reverse=True)
                    return values[left - 1]
                break
            left -= counts[b]
    return value(lo)
