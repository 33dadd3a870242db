"""Shards by proportional stratified interleaving, DataFrame operations only.

Rows are shuffled by a keyed hash and ranked within their source; row r of n gets the fractional rank
(r + 1/2) / n. In the order of fractional ranks every stretch holds the sources in their shares, so
equal cuts give shards that all match the mixture.

Both rankings are exact without a global sort: rows fall into buckets in rank order of about
`BUCKET_ROWS` rows each, are ranked inside their bucket, and are moved by the rows of earlier buckets. A
large source has many buckets, so it is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfgrid.functions.hashing import keyed_hash
from turfgrid.functions.hashing import HASH_BITS
from turfgrid.llm.storage import drop, written

SHARDS = 40
SEED = 41
BUCKET_ROWS = 2_000


def _earlier(buckets: DataFrame, within: list[str]) -> DataFrame:
    """`__before`: rows in the earlier buckets of the same group."""
    order = Window.partitionBy(*[F.col(c) for c in within] or [F.lit(0)]).orderBy("__bucket")
    before = F.sum("__rows").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return buckets.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__rows")


def interleave(table: DataFrame, carry: dict[str, Column], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The columns of `carry` for every row of `table`, with `shard` and `slot` (gapless from 0 in a shard).

    `table` has doc_id, source and text. Shard sizes differ by one row at most. Null is a source of its own,
    after all others. Rows equal in doc_id stand side by side in the shuffle, in the order of a hash of their
    text; rows equal in both may swap slots between runs. An empty table gives no rows.
    """
    place = keyed_hash(seed, F.col("doc_id"))
    rows = table.select("doc_id", F.col("source").alias("__source"), place.alias("__place"), F.xxhash64("text").alias("__tie"), F.struct(*[c.alias(k) for k, c in carry.items()]).alias("__kept"))
    counts = rows.groupBy("__source").agg(F.count("*").alias("__n"))
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("__source").asc_nulls_last()))
    sources = written(counts.withColumn("__number", number), "sources")
    total = sources.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]

    known = sources.withColumnRenamed("__source", "__name")
    numbered = rows.join(known, F.col("__source").eqNullSafe(F.col("__name"))).drop("__source", "__name")
    share = F.col("__place").cast("double") / F.lit(float(1 << HASH_BITS))
    numbered = numbered.withColumn("__bucket", F.floor(share * F.ceil(F.col("__n") / BUCKET_ROWS)))
    sizes = numbered.groupBy("__number", "__bucket").agg(F.count("*").alias("__rows"))
    inside = Window.partitionBy("__number", "__bucket").orderBy("__place", "doc_id", "__tie")
    ranked = numbered.withColumn("__inside", F.row_number().over(inside) - 1).join(_earlier(sizes, ["__number"]), ["__number", "__bucket"])
    rank = F.col("__before") + F.col("__inside")
    ranked = written(ranked.select("__number", "__n", rank.alias("__rank"), "__kept"), "ranked")

    parts = max(1, -(-total // BUCKET_ROWS))
    odd = 2 * F.col("__rank") + 1
    spread = ranked.withColumn("__bucket", F.expr(f"((2 * __rank + 1) * {parts}) div (2 * __n)"))
    sizes = spread.groupBy("__bucket").agg(F.count("*").alias("__rows"))
    inside = Window.partitionBy("__bucket").orderBy((odd / (2 * F.col("__n"))), "__number", "__rank")
    placed = spread.withColumn("__inside", F.row_number().over(inside) - 1).join(_earlier(sizes, []), "__bucket")
    placed = placed.withColumn("__at", F.col("__before") + F.col("__inside"))
    shard = F.expr(f"cast((__at * {shards}) div {max(1, total)} as int)")
    first = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    drop(sources)
    return placed.withColumn("shard", shard).select(*[F.col(f"__kept.{k}").alias(k) for k in carry], "shard", (F.col("__at") - first).alias("slot"))


def shards(docs: DataFrame, number: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Every document with its shard and slot, and what it weighs there; texts are not moved.

    `size` is the UTF-8 bytes of the text plus 16; `text_crc32` is 0 for null and empty texts. Other
    columns of `docs` play no part.
    """
    carry = {
        "doc_id": F.col("doc_id").cast("bigint"),
        "size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 16,
        "text_crc32": F.coalesce(F.crc32("text"), F.lit(0)).cast("bigint"),
    }
    return interleave(docs, carry, number, seed)
