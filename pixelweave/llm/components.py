"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(v, label) of every vertex of the edges (a, b), labels being the least vertex of the component.

    Each round a vertex takes the least label among its own and its neighbours',
    then the label of that label, so that long chains shrink by half. Labels are
    kept in the shared folder; rounds end when none changes. The tables are joined
    on a hash of the vertex, dealt out for the join alone, so that Spark can split a
    vertex with very many edges.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        seen = both.select(F.xxhash64("a").alias("k"), "b").join(labels.select(F.xxhash64("v").alias("k"), "label"), "k")
        near = seen.groupBy(F.col("b").alias("v")).agg(F.min("label").alias("near"))
        better = labels.join(near, "v", "left").select("v", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        better = checkpointed(better)
        jump = better.select(F.col("v").alias("label"), F.col("label").alias("jumped"))
        moved = better.withColumn("k", F.xxhash64("label")).join(jump.select(F.xxhash64("label").alias("k"), "jumped"), "k", "left")
        moved = checkpointed(moved.select("v", "old", F.least("label", F.coalesce("jumped", "label")).alias("label")))
        labels = moved.select("v", "label")
        if moved.filter("label != old").isEmpty():
            return labels
