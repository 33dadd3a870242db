"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfgrid.llm.storage import drop, written


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id of the links (a, b); the component is the smallest id within reach.

    Each round takes the smallest label of an id's neighbours and then the label of that label, so the
    number of rounds grows with the logarithm of a component's diameter, not with its size. An id with
    very many links is one key of a join and of a partial aggregation, never a list.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = written(both, "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("id"), F.least("a", "least").alias("component")), "labels")
    while True:
        near = both.join(labels, both.a == labels.id).groupBy(F.col("b").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("via"))
        jump = labels.select(F.col("id").alias("via"), F.col("component").alias("beyond"))
        moved = written(lower.join(jump, "via").select("id", "old", F.least("via", "beyond").alias("component")), "labels")
        drop(labels)
        labels = moved.select("id", "component")
        if moved.where("old != component").isEmpty():
            drop(both)
            return labels
