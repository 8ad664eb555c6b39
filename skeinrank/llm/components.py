"""Connected components of links, by alternating large-star and small-star steps, each a few joins and aggregations.

Nothing is gathered in one task or on the driver but whether the links have become stars; centres of many links are dealt out. Each step's links are written to
the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop_path, join_dealt, materialize


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One step over links (a > b). Large star: every larger neighbour of a vertex is linked with the smallest vertex
    around; small star: every smaller one and the vertex itself are."""
    both = links.select(F.col("a").alias("v"), F.col("b").alias("w"))
    if large:
        both = both.unionByName(links.select(F.col("b").alias("v"), F.col("a").alias("w")))
    least = both.groupBy("v").agg(F.min("w").alias("m"), F.count("*").alias("n")).select("v", F.least("v", "m").alias("m"), "n")
    joined = join_dealt(both, least, ["v"], "w")  # a star's centre may have a third of all links
    if large:
        out = joined.where("w > v").select(F.col("w").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("w").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("v").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b")


def _settled(links: DataFrame) -> bool:
    """Whether every vertex with a smaller one around has only that one, which has none itself: the links are stars."""
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("up")), F.struct(F.col("b").alias("id"), F.lit(None).cast("long").alias("up")))).alias("e")).select("e.*")
    wrong = ends.groupBy("id").agg(F.min("up").alias("least"), F.max("up").alias("most"), F.count_if(F.col("up").isNull()).alias("below")).where("least < most or (below > 0 and least is not null)")
    return wrong.isEmpty()


def connected_components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """id, component (the smallest id reachable) of every id in links (columns a and b, long, in any order, repeats and
    self-links welcome). Rows with nulls are no links."""
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null")
    alone = links.where("a = b").select(F.col("a").alias("id"))
    links, path = materialize(links.where("a <> b"), "links")
    for _ in range(most_rounds):
        if _settled(links):
            break
        new, new_path = materialize(_stars(_stars(links, True), False).distinct(), "links")
        drop_path(links.sparkSession, path)
        links, path = new, new_path
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("b").alias("id")).unionByName(alone).distinct()
    inner = links.select(F.col("a").alias("id"), F.col("b").alias("component")).distinct()
    return inner.unionByName(roots.join(inner, "id", "left_anti").select("id", F.col("id").alias("component")))
