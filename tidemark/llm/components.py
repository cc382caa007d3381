"""Connected components by alternating large-star and small-star steps; no node's neighbours are ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged


def _star(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """One large-star and one small-star step; edges and the result have a > b."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.where("a > m").select("a", F.col("m").alias("b"))).distinct()
    down = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(down, "a")
    out = small.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b"))).distinct()
    out = staged(out, name)
    stats = out.agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
    return out, tuple(stats)


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, root) of every node of the links (a, b): root is the smallest id it reaches. Loops and repeated links are ignored."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before, stats = None, ()
    while stats != before:  # steps grow with the logarithm of the nodes
        before = stats
        now, stats = _star(now, name)
    roots = now.groupBy("b").agg(F.first("b").alias("root")).select(F.col("b").alias("id"), "root")
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).union(roots)
