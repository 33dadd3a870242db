"""Focal operators on rasters kept by row: (pass_id, y, planes), one array of cells per channel.

A row of the raster and the k - 1 rows after it lie side by side after one window over the pass, so the number
of rows does not depend on the kernel, and a tap is a shifted, weighted sum of whole arrays. A kernel on rows laid
out by pass (`by_pass`) shuffles nothing; the planner lays them out again before the next kernel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turfgrid.constants import CHANNELS, Pitch
from turfgrid.operators.channels import TENSOR_ROWS, nested_list, raster_batch, tensor_input

SCHEMA = "pass_id bigint, y int, planes array<array<double>>"
MAX_TAPS = 1 << 22


def raster_rows(located: DataFrame, channels: tuple[int, ...] = tuple(range(1, len(CHANNELS) + 1)), pitch: Pitch = Pitch()) -> DataFrame:
    """The given channels of each pass by row, as floats; missing values are 0. The compact pass row travels to the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, TENSOR_ROWS):
                part = batch.slice(low, TENSOR_ROWS)
                planes = np.nan_to_num(raster_batch(part, pitch, channels)).transpose(0, 2, 1, 3).astype(np.float64)
                number = pa.array(np.repeat(np.arange(part.num_rows), pitch.rows))
                y = pa.array(np.tile(np.arange(pitch.rows, dtype=np.int32), part.num_rows))
                lists = nested_list(nested_list(pa.array(planes.ravel()), pitch.cols), len(channels))
                yield pa.RecordBatch.from_arrays([part.column("pass_id").take(number), y, lists], ["pass_id", "y", "planes"])

    return tensor_input(located, "pass_id").mapInArrow(run, SCHEMA)


def by_rows(raster: DataFrame, cols: int, channels: int) -> DataFrame:
    """A long raster (pass_id, ch, y, x, value) as rows; cells and channels that a row lacks are 0.

    The cells of one row of the raster, `cols` of each channel, are gathered at a time. A row without any cell is not made.
    """
    cell = F.struct((F.col("ch") * cols + F.col("x")).cast("int").alias("at"), F.col("value").cast("double").alias("value"))
    held = raster.groupBy("pass_id", F.col("y").cast("int").alias("y")).agg(F.collect_list(cell).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                line = np.repeat(np.arange(part.num_rows), part.column("cells").value_lengths().to_numpy())
                cells = part.column("cells").flatten()
                planes = np.zeros((part.num_rows, channels * cols))
                planes[line, cells.field("at").to_numpy()] = cells.field("value").to_numpy(zero_copy_only=False)
                lists = nested_list(nested_list(pa.array(planes.ravel()), cols), channels)
                yield pa.RecordBatch.from_arrays([part.column("pass_id"), part.column("y"), lists], ["pass_id", "y", "planes"])

    return held.mapInArrow(run, SCHEMA)


def by_cells(rows: DataFrame) -> DataFrame:
    """Rows as a long raster (pass_id, ch, y, x, value)."""
    planes = rows.select("pass_id", "y", F.posexplode("planes").alias("ch", "line"))
    return planes.select("pass_id", "ch", "y", F.posexplode("line").alias("x", "value")).select("pass_id", "ch", "y", "x", "value")


def by_pass(rows: DataFrame, parts: int) -> DataFrame:
    """Lay rows out by pass and in order of y; do it once, before a chain of operators."""
    return rows.repartition(parts, "pass_id").sortWithinPartitions("pass_id", "y")


def load_kernel(weights: DataFrame, bias: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A kernel (out_ch, in_ch, dy, dx, w) and its bias (out_ch, b) as arrays, if it has at most `MAX_TAPS` taps."""
    taps = weights.limit(MAX_TAPS + 1).toArrow().to_pandas()
    if len(taps) > MAX_TAPS:
        raise ValueError(f"a kernel of more than {MAX_TAPS} taps is for the long form, `raster.focal_conv`")
    kernel = np.zeros(tuple(int(taps[c].max()) + 1 for c in ("out_ch", "in_ch", "dy", "dx")))
    kernel[tuple(taps[c] for c in ("out_ch", "in_ch", "dy", "dx"))] = taps["w"]
    shift = np.zeros(kernel.shape[0])
    shifts = bias.limit(MAX_TAPS).toArrow().to_pandas()
    shift[shifts["out_ch"]] = shifts["b"]
    return kernel, shift


def focal_conv(rows: DataFrame, weights: DataFrame, bias: DataFrame, height: int, cols: int) -> DataFrame:
    """k x k cross-correlation over all channels, stride 1, no padding; k is the size of the kernel.

    The result has k - 1 fewer rows and columns. A batch of rows, each with the k - 1 rows after it, is
    multiplied by one matrix per column of the kernel.
    """
    kernel, shift = load_kernel(weights, bias)
    out_ch, in_ch, k, _ = kernel.shape
    width = cols - k + 1
    taps = kernel.transpose(3, 0, 2, 1).reshape(k, out_ch, k * in_ch)
    following = Window.partitionBy("pass_id").orderBy("y")
    band = [(F.lead("planes", dy).over(following) if dy else F.col("planes")).alias(f"b{dy}") for dy in range(k)]
    banded = rows.select("pass_id", "y", *band).where(F.col("y") <= height - k)

    @F.arrow_udf("array<array<double>>")
    def convolved(*lines: pa.Array) -> pa.Array:
        n = len(lines[0])
        stacked = np.concatenate([line.flatten().flatten().to_numpy().reshape(n, in_ch, cols) for line in lines], axis=1)
        total = np.broadcast_to(shift[:, None], (n, out_ch, width)).copy()
        for dx in range(k):
            total += taps[dx] @ stacked[:, :, dx : dx + width]
        return nested_list(nested_list(pa.array(total.ravel()), width), out_ch)

    return banded.select("pass_id", "y", convolved(*[f"b{dy}" for dy in range(k)]).alias("planes"))


def convolve(planes: np.ndarray, kernel: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Whole rasters [passes, in_ch, rows, cols] through a kernel, as `focal_conv` has it.

    Cells other than 0 send their weighted values to the cells they count for; where many are not 0, whole planes are added up.
    """
    n, _, height, cols = planes.shape
    out_ch, in_ch, k, _ = kernel.shape
    high, wide = height - k + 1, cols - k + 1
    total = np.empty((n, out_ch, high, wide))
    total[:] = shift[:, None, None]
    set_cells = np.count_nonzero(planes)
    for dy in range(k) if 16 * set_cells > planes.size else ():
        for dx in range(k):
            total += np.einsum("oi,nihw->nohw", kernel[:, :, dy, dx], planes[:, :, dy : dy + high, dx : dx + wide], optimize=True)
    if 16 * set_cells > planes.size:
        return total
    number, ch, y, x = np.nonzero(planes)
    value = planes[number, ch, y, x].astype(np.float64)
    for dy in range(k):
        for dx in range(k):
            inside = np.flatnonzero((y >= dy) & (y < dy + high) & (x >= dx) & (x < dx + wide))
            for o in range(out_ch):
                np.add.at(total, (number[inside], o, y[inside] - dy, x[inside] - dx), value[inside] * kernel[o, ch[inside], dy, dx])
    return total


def convolved_rows(
    located: DataFrame,
    channels: tuple[int, ...],
    weights: DataFrame,
    bias: DataFrame,
    pitch: Pitch = Pitch(),
    fold: Callable[[np.ndarray], list[pa.Array]] | None = None,
    fields: str = "planes array<array<double>>",
) -> DataFrame:
    """`focal_conv` of `raster_rows`, with the raster of a pass made and convolved in one place: nothing is shuffled or sorted.

    A consumer that reduces the rows can do so there: `fold` takes the convolved rasters of some passes, [passes,
    out_ch, rows, cols], and gives the columns `fields` of their rows, those of a pass after each other.
    """
    kernel, shift = load_kernel(weights, bias)
    out_ch, _, k, _ = kernel.shape
    high, wide = pitch.rows - k + 1, pitch.cols - k + 1

    def lists(rasters: np.ndarray) -> list[pa.Array]:
        return [nested_list(nested_list(pa.array(rasters.transpose(0, 2, 1, 3).ravel()), wide), out_ch)]

    columns = fold or lists

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, TENSOR_ROWS):
                part = batch.slice(low, TENSOR_ROWS)
                rasters = convolve(np.nan_to_num(raster_batch(part, pitch, channels)), kernel, shift)
                number = pa.array(np.repeat(np.arange(part.num_rows), high))
                y = pa.array(np.tile(np.arange(high, dtype=np.int32), part.num_rows))
                yield pa.RecordBatch.from_arrays([part.column("pass_id").take(number), y, *columns(rasters)], names)

    schema = f"pass_id bigint, y int, {fields}"
    names = located.sparkSession.createDataFrame([], schema).columns
    return tensor_input(located, "pass_id").mapInArrow(run, schema)


def pointwise(rows: DataFrame, weights: DataFrame, bias: DataFrame, height: int, cols: int) -> DataFrame:
    """Weighted sum over channels at each cell: a kernel of one cell."""
    return focal_conv(rows, weights, bias, height, cols)


def relu(rows: DataFrame) -> DataFrame:
    return rows.withColumn("planes", F.transform("planes", lambda line: F.transform(line, lambda v: F.greatest(v, F.lit(0.0)))))


def replicate_pad(rows: DataFrame, height: int, p: int) -> DataFrame:
    """Widen by p cells on each side, repeating edge values; edge rows are put out p times more."""

    def wide(line):
        return F.concat(F.array_repeat(F.get(line, F.lit(0)), p), line, F.array_repeat(F.element_at(line, -1), p))

    low = F.when(F.col("y") == 0, 0).otherwise(F.col("y") + p)
    high = F.when(F.col("y") == height - 1, height - 1 + 2 * p).otherwise(F.col("y") + p)
    return rows.select("pass_id", F.explode(F.sequence(low, high).cast("array<int>")).alias("y"), F.transform("planes", wide).alias("planes"))
