"""Pairwise training examples from judged documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import FEATURES
from ..sources.files import written
from .numbering import numbered, smallest


def pair_join(rows: DataFrame, min_diff: int = 3, rid: str = "rid") -> DataFrame:
    """Ordered pairs (i, j) of rows a and b with the same qid whose relevance differs by min_diff at least. Both orders come."""
    if not 1 <= min_diff <= 4:
        raise ValueError("min_diff must be from 1 to 4")
    side = lambda name: rows.select([F.col(c).alias(f"{name}_{c}") for c in rows.columns])
    a, b = side("a"), side("b")
    return a.join(b, (F.col("a_qid") == F.col("b_qid")) & (F.col(f"a_{rid}") != F.col(f"b_{rid}")) & (F.abs(F.col("a_relevance") - F.col("b_relevance")) >= min_diff))


def pairs(rows: DataFrame, min_diff: int = 3, rid: str = "rid") -> DataFrame:
    """qid, i, j, the feature differences and Y: -1 if the first is less relevant, else 1."""
    joined = pair_join(rows, min_diff, rid)
    names = [c for c in FEATURES if c in rows.columns]
    label = F.when(F.col("a_relevance") < F.col("b_relevance"), -1).otherwise(1)
    return joined.select(F.col("a_qid").alias("qid"), F.col(f"a_{rid}").alias("i"), F.col(f"b_{rid}").alias("j"), *[(F.col(f"a_{c}") - F.col(f"b_{c}")).alias(c) for c in names], label.alias("Y"))


def _order(salt: str):
    return F.md5(F.concat_ws(":", F.lit(salt), F.col("qid"), F.col("i"), F.col("j")))


def sample(found: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n pairs, each as likely as another, the same for the same seed: those with the smallest hashes."""
    return smallest(found.withColumn("_o", _order(str(seed))), "_o", n)[0].drop("_o")


def shuffled(found: DataFrame, seed: int = 42) -> DataFrame:
    """A sample in another hash order, numbered from 1."""
    ordered = found.withColumn("_o", F.concat_ws(":", _order(f"shuffle{seed}"), "qid", "i", "j"))
    return numbered(ordered, "_o").withColumn("position", (F.col("position") + 1).cast("int")).drop("_o")


class TooFewPairs(ValueError):
    """There are fewer pairs than asked for."""


def create_examples(rows: DataFrame, n: int = 1_000_000, min_diff: int = 3, seed: int = 42, rid: str = "rid") -> DataFrame:
    """n examples in random order; TooFewPairs if there are not so many. rid tells the rows of a query apart: the pairs are
    drawn and numbered by it, and only the features of those drawn are fetched."""
    rows = written(rows, "judged")
    ids = pairs(rows.select("qid", rid, "relevance"), min_diff, rid)
    drawn, have = smallest(ids.withColumn("_o", _order(str(seed))), "_o", n)
    if have < n:
        raise TooFewPairs(f"{have} pairs, {n} asked for")
    placed = shuffled(drawn.drop("_o"), seed)
    names = [c for c in FEATURES if c in rows.columns]
    side = lambda key, name: rows.select("qid", F.col(rid).alias(key), F.struct(*names).alias(name))
    both = placed.join(side("i", "_a"), ["qid", "i"]).join(side("j", "_b"), ["qid", "j"])
    return both.select("qid", "i", "j", *[(F.col(f"_a.{c}") - F.col(f"_b.{c}")).alias(c) for c in names], "Y", "position")
