"""Positions in a total order, and the first rows of one, without one task that has all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import written


def numbered(df: DataFrame, key: str, name: str = "position") -> DataFrame:
    """Adds the 0-based position in the order of key, a unique column without nulls.

    Rows are dealt by ranges of the key, sorted and written once with their place in their range; what is counted again is
    a number for each range, which gives the first position of each.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id())
    placed = written(ranged, "numbered")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = sorted(placed.groupBy(part.alias("part")).count().collect())  # a row for each range
    first = accumulate([0] + [r["count"] for r in counts])
    starts = spark.createDataFrame([(r["part"], n) for r, n in zip(counts, first)], "_part long, _first long")
    joined = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return joined.withColumn(name, F.col("_first") + within).drop("_at", "_part", "_first")


def smallest(df: DataFrame, key: str, n: int, few: int = 50_000) -> tuple[DataFrame, int]:
    """The n rows with the smallest key, a text of hex digits, and how many there are (fewer if df has not so many).

    Rows are counted by their next three digits until at most `few` keys of those that decide are left, so at most that
    many texts come to the driver. Rows with equal keys are alike, so of those at the cut any may stay.
    """
    prefix, left, below = "", n, F.lit(False)
    while True:
        inside = df.where(F.col(key).startswith(prefix)) if prefix else df
        counts = dict(inside.groupBy(F.substring(key, len(prefix) + 1, 3).alias("d")).count().collect())
        if not prefix and sum(counts.values()) <= n:
            return df, sum(counts.values())
        for digits in sorted(counts):
            if counts[digits] >= left:
                break
            left -= counts[digits]
        prefix += digits
        below = F.col(key) < prefix
        if counts[digits] <= few or len(digits) < 3:
            keys = sorted(r[0] for r in df.where(F.col(key).startswith(prefix)).select(key).collect())
            cut = keys[left - 1] if left else None
            chosen = df.where(below if cut is None else F.col(key) <= cut)
            return (chosen.limit(n) if cut is not None and keys.count(cut) > 1 else chosen), n


def cuts(df: DataFrame, key: str, runs: int, few: int = 50_000) -> list[str] | None:
    """The keys, texts of hex digits, that `runs` contiguous runs of their order begin with but for the first; the last run
    takes the rest. None if a run would begin amid equal keys. Counts find them, without a sort of all rows."""
    size, open_ = 0, {"": [(-1, 0)]}  # by prefix: the run, and the place in the prefix of its first key
    out: dict[int, str] = {}
    while open_:
        digits = len(next(iter(open_))) + 3
        inside = df if digits == 3 else df.where(F.substring(key, 1, digits - 3).isin(list(open_)))
        counts = sorted(inside.groupBy(F.substring(key, 1, digits).alias("d")).count().collect())
        if not size:
            n = sum(c for _, c in counts)
            size = max(1, n // runs)
            open_ = {"": [(run, run * size) for run in range(1, runs) if run * size < n]}
        found: dict[str, list[tuple[int, int]]] = {}
        many = False
        for prefix, wanted in open_.items():
            below = [(d, c) for d, c in counts if d.startswith(prefix)]
            for run, at in wanted:
                for d, c in below:
                    if at < c:
                        found.setdefault(d, []).append((run, at))
                        many |= c > few and len(d) == digits
                        break
                    at -= c
        if not many:
            keys: dict[str, list[str]] = {d: [] for d in found}
            for (k,) in df.where(F.substring(key, 1, digits).isin(list(found))).select(key).collect() if found else []:
                keys[k[:digits]].append(k)
            edge = False
            for d, wanted in found.items():
                here = sorted(keys[d])
                for run, at in wanted:
                    out[run] = here[at]
                    edge |= at > 0 and here[at - 1] == here[at]
            return None if edge else [out[run] for run in sorted(out)]
        open_ = found
    return []
