"""Documents in ascending id order, in parts that tasks read as streams."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_ROWS = 5_000
_LAST = (1 << 63) - 1


def in_parts(docs: DataFrame, with_next: bool = False, part_rows: int = PART_ROWS) -> DataFrame:
    """(part, tail, doc_id, text) sorted by part and id within tasks; parts follow each other in id order.

    Parts are cut at approximate quantiles of the ids and hold about `part_rows` rows; a part lies in one
    task. Rows equal in id are ordered by text, and rows without an id come last. `with_next` ends each part
    by a copy of the row that follows it (`tail` 1); after the last row the first one follows.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("key", F.coalesce("doc_id", F.lit(_LAST)))
    keys = rows.select("key", F.col("key").cast("double").alias("place"))
    parts = max(1, -(-keys.count() // part_rows))
    inner = [k / parts for k in range(1, parts)]
    cuts = sorted(set(keys.approxQuantile("place", inner, 1 / (8 * parts)))) if inner and not keys.isEmpty() else []

    def cut(table: DataFrame) -> DataFrame:
        if not cuts:
            return table.withColumn("part", F.lit(0)).drop("place")
        cutter = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="place", outputCol="cut")
        return cutter.transform(table).withColumn("part", F.col("cut").cast("int")).drop("cut", "place")

    laid = cut(rows.withColumn("place", F.col("key").cast("double"))).withColumn("tail", F.lit(0))
    if with_next:
        # a row per part, a number that follows the rows by `part_rows`
        firsts = sorted((r["part"], r["key"]) for r in cut(keys).groupBy("part").agg(F.min("key").alias("key")).collect())
        ends = [(firsts[k - 1][0], key) for k, (_, key) in enumerate(firsts)]
        following = docs.sparkSession.createDataFrame(ends, "before int, key bigint")
        tails = laid.join(F.broadcast(following), "key").select("doc_id", "text", "key", F.col("before").alias("part"), F.lit(1).alias("tail"))
        laid = laid.select("doc_id", "text", "key", "part", "tail").union(tails)
    return laid.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "tail", "key", "text").select("part", "tail", "doc_id", "text")
