"""Focal and zonal raster operators on long tables (pass_id, ch, y, x, value).

Each grouping contains pass_id. Once a raster lies hashed on pass_id (`by_pass`), a whole chain of
these operators runs without another shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turfgrid.functions import cells as fn
from turfgrid.session import broadcast_if_small

CELL = ("pass_id", "ch", "y", "x")


def by_pass(raster: DataFrame, parts: int) -> DataFrame:
    """Lay a raster out by pass; do it once, before a chain of raster operators."""
    return raster.repartition(parts, "pass_id")


def focal_conv(raster: DataFrame, weights: DataFrame, bias: DataFrame, rows: int, cols: int, k: int) -> DataFrame:
    """k x k cross-correlation with stride 1 and no padding; the result has k-1 fewer rows and columns.

    `weights` is (out_ch, in_ch, dy, dx, w), `bias` is (out_ch, b). Each input cell sends its weighted
    value to the cells it contributes to; they are summed map-side before any shuffle.
    """
    taps = broadcast_if_small(weights.select(F.col("in_ch").alias("ch"), "out_ch", "dy", "dx", "w"))
    y, x = F.col("y") - F.col("dy"), F.col("x") - F.col("dx")
    sums = (
        raster.join(taps, "ch")
        .select("pass_id", F.col("out_ch").alias("ch"), y.alias("y"), x.alias("x"), (F.col("value") * F.col("w")).alias("value"))
        .where(F.col("y").between(0, rows - k) & F.col("x").between(0, cols - k))
        .groupBy(*CELL)
        .agg(F.sum("value").alias("value"))
    )
    shift = broadcast_if_small(bias.select(F.col("out_ch").alias("ch"), "b"))
    return sums.join(shift, "ch").select(*CELL, (F.col("value") + F.col("b")).alias("value"))


def pointwise(raster: DataFrame, weights: DataFrame, bias: DataFrame, rows: int, cols: int) -> DataFrame:
    """Weighted sum over channels at each cell."""
    return focal_conv(raster, weights, bias, rows, cols, 1)


def relu(raster: DataFrame) -> DataFrame:
    return raster.withColumn("value", fn.relu(F.col("value")))


def sigmoid(raster: DataFrame) -> DataFrame:
    return raster.withColumn("value", fn.sigmoid(F.col("value")))


def _padded(index: Column, size: int, p: int) -> Column:
    """Target indexes of a source index; the edges repeat p times outward."""
    low = F.when(index == 0, 0).otherwise(index + p)
    high = F.when(index == size - 1, size - 1 + 2 * p).otherwise(index + p)
    return F.explode(F.sequence(low, high))


def replicate_pad(raster: DataFrame, rows: int, cols: int, p: int) -> DataFrame:
    """Widen by p cells on each side, repeating edge values. Each cell emits its own copies: no join."""
    tall = raster.select("pass_id", "ch", _padded(F.col("y"), rows, p).alias("y"), "x", "value")
    return tall.select("pass_id", "ch", "y", _padded(F.col("x"), cols, p).alias("x"), "value")


def max_pool(raster: DataFrame, rows: int, cols: int, k: int = 2) -> DataFrame:
    """Maximum over k x k blocks; an incomplete last block is left out."""
    whole = raster.where((F.col("y") < rows // k * k) & (F.col("x") < cols // k * k))
    block = [F.floor(F.col(c) / k).cast("int").alias(c) for c in ("y", "x")]
    return whole.groupBy("pass_id", "ch", *block).agg(F.max("value").alias("value"))


def upsample(raster: DataFrame, k: int = 2) -> DataFrame:
    """Nearest-neighbour enlargement: each cell becomes a k x k block."""
    copies = [
        F.struct((F.col("y") * k + dy).alias("y"), (F.col("x") * k + dx).alias("x")) for dy in range(k) for dx in range(k)
    ]
    return raster.select("pass_id", "ch", "value", F.inline(F.array(*copies))).select(*CELL, "value")


def stack_surfaces(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pair two surfaces (pass_id, y, x, value) cell by cell as `a` and `b`."""
    left = first.select("pass_id", "y", "x", F.col("value").alias("a"))
    right = second.select("pass_id", "y", "x", F.col("value").alias("b"))
    return left.join(right, ["pass_id", "y", "x"])


def fuse(first: DataFrame, second: DataFrame, w0: float, w1: float, b: float) -> DataFrame:
    """Weighted sum of two surfaces."""
    value = F.col("a") * F.lit(w0) + F.col("b") * F.lit(w1) + F.lit(b)
    return stack_surfaces(first, second).select("pass_id", "y", "x", value.alias("value"))
