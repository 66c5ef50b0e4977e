"""Connected components of a table of links, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import drop, save


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Tie neighbours to the smallest one: the larger neighbours of each node, or the smaller ones and the node itself."""
    if large:
        near = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    tied = near.join(least, "a")
    if large:
        out = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) for each node of a table (a bigint, b bigint) of links; root is the smallest node of its component.

    Self-links and nulls are ignored, repeated links count once.  Lineage is cut after each round by a table in the shared folder.
    """
    links = save(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b").distinct(), "links")
    mark = None
    for _ in range(max_rounds):
        after = save(_star(_star(links, True), False), "links")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(links)
        links = after
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(links.select("b", "b").distinct().toDF("node", "root"))
