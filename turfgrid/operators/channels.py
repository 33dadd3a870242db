"""The 17 raster channels and the destination mask.

Sparse channels are small arrays on the pass row and emit the set cells only. Dense channels are
column expressions over pass x grid. Nothing here shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfgrid.constants import CHANNELS, Pitch
from turfgrid.functions import cells as fn
from turfgrid.operators.grid import beside, at_destination, over_grid, pitch_grid

SPARSE = (1, 2, 8, 9, 12, 13, 14, 15, 16)
FIELDS = (3, 4, 5, 6, 7, 17)
COUNTED = (10, 11)
DENSE = tuple(sorted(FIELDS + COUNTED))

# what a sparse channel holds: at the cells of one side's players, or at the ball's cell
PLAYER_VALUES = {
    1: ("att", "1"),
    2: ("def", "1"),
    13: ("att", "p.vx"),
    14: ("att", "p.vy"),
    15: ("def_moving", "p.vx"),
    16: ("def_moving", "p.vy"),
}
BALL_VALUES = {8: "carrier_vx", 9: "carrier_vy", 12: "carrier_speed"}


def _sparse_entries(channel: int, pitch: Pitch) -> str:
    """Array of set cells of one sparse channel."""

    def entry(cell: str, value: str) -> str:
        y, x = f"int(({cell}) div {pitch.cols})", f"({cell}) % {pitch.cols}"
        return f"struct({channel} channel, {y} y, {x} x, double({value}) value)"

    if channel in PLAYER_VALUES:
        side, value = PLAYER_VALUES[channel]
        return f"transform({side}, p -> {entry('p.cell', value)})"
    return f"array({entry(f'ball_y * {pitch.cols} + ball_x', BALL_VALUES[channel])})"


def sparse_channels(located: DataFrame, channels=SPARSE, pitch: Pitch = Pitch()) -> DataFrame:
    """Set cells of the given sparse channels as (pass_id, channel, y, x, value)."""
    entries = ", ".join(_sparse_entries(c, pitch) for c in channels)
    # the outer form: see `unpivot_slots`
    return located.selectExpr("pass_id", f"inline_outer(concat({entries}))").where("channel is not null")


def outplayed(counts: str, step: str) -> str:
    """Players a ball at this cell has passed; 0 at a cell farther from the goal than the ball."""
    return f"coalesce(get({counts}, {step}), 0)"


def outplayed_here(side: str) -> str:
    """`outplayed` where each pass has one cell: the players are counted, no table of counts is laid out."""
    return f"size(filter({side}, p -> p.step between step and ball_step))"


def with_step_counts(located: DataFrame, sides=("att", "def")) -> DataFrame:
    """Add `<side>_counts`: entry q is the number of occupied cells with q <= step <= ball_step.

    The array is built once per pass from runs of equal counts; a cell then reads its count with one
    lookup instead of a comparison with every player.
    """
    ahead = {f"_{s}": F.expr(f"array_sort(filter(transform({s}, p -> p.step), q -> q <= ball_step))") for s in sides}
    run = "array_repeat(size(_{0}) - i, q - coalesce(get(_{0}, i - 1), -1))"
    counts = {f"{s}_counts": F.expr(f"flatten(transform(_{s}, (q, i) -> {run.format(s)}))") for s in sides}
    return located.withColumns(ahead).withColumns(counts).drop(*ahead)


def dense_value(channel: int, pitch: Pitch) -> str:
    """Value of a dense channel at cell (y, x) of `over_grid`."""
    cosine = fn.cosine_ball_goal("y", "x", "ball_y", "ball_x", pitch)
    return {
        3: fn.distance("y", "x", "ball_y", "ball_x"),
        4: "d_goal",
        5: cosine,
        6: fn.sine_from(cosine),
        7: "a_goal",
        10: f"double({outplayed('att_counts', 'step')})",
        11: f"double({outplayed('def_counts', 'step')})",
        17: fn.distance("y", "x", "ball_y", "ball_x"),  # the pass starts where the ball is
    }[channel]


def _needed(channels) -> list[str]:
    """Pass columns the dense channels read; the rest is not carried through the grid."""
    names = ["pass_id", "ball_y", "ball_x"]
    return names + [n for c, n in ((10, "att_counts"), (11, "def_counts")) if c in channels]


def dense_cells(located: DataFrame, channels=DENSE, pitch: Pitch = Pitch()) -> DataFrame:
    """One row per pass and cell with a column c<k> per dense channel."""
    sides = [side for c, side in ((10, "att"), (11, "def")) if c in channels]
    passes = with_step_counts(located, sides) if sides else located
    rows = over_grid(passes.select(*_needed(channels)), pitch)
    return rows.selectExpr("pass_id", "cell", "y", "x", *[f"{dense_value(c, pitch)} c{c}" for c in channels])


def dense_channels(located: DataFrame, channels=DENSE, pitch: Pitch = Pitch()) -> DataFrame:
    """The given dense channels as (pass_id, channel, y, x, value)."""
    if len(channels) == 1:
        (only,) = channels
        cells = dense_cells(located, channels, pitch)
        return cells.select("pass_id", F.lit(only).alias("channel"), "y", "x", F.col(f"c{only}").alias("value"))
    wide = dense_cells(located, channels, pitch).withColumnsRenamed({f"c{c}": str(c) for c in channels})
    long = wide.unpivot(["pass_id", "y", "x"], [str(c) for c in channels], "channel", "value")
    return long.select("pass_id", F.col("channel").cast("int").alias("channel"), "y", "x", "value")


def channel(located: DataFrame, number: int, pitch: Pitch = Pitch()) -> DataFrame:
    """One channel by number, 1 to 17."""
    build = sparse_channels if number in SPARSE else dense_channels
    return build(located, (number,), pitch)


def destination_mask(located: DataFrame) -> DataFrame:
    """The one set cell of each pass's destination mask."""
    return located.select("pass_id", F.col("dest_y").alias("y"), F.col("dest_x").alias("x"), F.lit(1.0).alias("value"))


def channel_stack(located: DataFrame, pitch: Pitch = Pitch()) -> DataFrame:
    """All 17 channels in one long table of float values; sparse channels hold their set cells only."""
    stack = sparse_channels(located, SPARSE, pitch).unionByName(dense_channels(located, DENSE, pitch))
    return stack.withColumn("value", F.col("value").cast("float"))


def channel_totals(located: DataFrame, totals: dict[str, Callable[[Column, Column], Column]], pitch: Pitch = Pitch()) -> DataFrame:
    """(pass_id, channel, <totals>): aggregates of `channel_stack` by pass and channel, without its long rows.

    `totals` makes an aggregate from the value (a float) and the cell number, one that adds up over rows. Channels
    that depend on the ball's cell and the cell alone are gone through once per ball cell, as many as the pitch has
    cells at most, and a pass takes the line of its ball cell; channels 10 and 11 once per pass.
    """

    def wide(passes: DataFrame, numbers: tuple[int, ...]) -> DataFrame:
        cells = dense_cells(passes, numbers, pitch).withColumns({f"c{c}": F.col(f"c{c}").cast("float") for c in numbers})
        return cells.groupBy("pass_id").agg(*[t(F.col(f"c{c}"), F.col("cell")).alias(f"{n}{c}") for c in numbers for n, t in totals.items()])

    def long(sums: DataFrame, numbers: tuple[int, ...]) -> DataFrame:
        lines = [F.struct(F.lit(c).alias("channel"), *[F.col(f"{n}{c}").alias(n) for n in totals]) for c in numbers]
        return sums.select("pass_id", F.inline(F.array(*lines)))

    ball = F.expr(f"coalesce(cast(ball_y * {pitch.cols} + ball_x as bigint), -1L)")
    tasks = 4 * located.sparkSession.sparkContext.defaultParallelism
    balls = located.select(ball.alias("pass_id")).distinct().repartition(tasks, "pass_id")
    placed = [f"if(pass_id >= 0, int(pass_id {part} {pitch.cols}), null) {name}" for name, part in (("ball_y", "div"), ("ball_x", "%"))]
    by_ball = beside(wide(balls.selectExpr("pass_id", *placed), FIELDS).withColumnRenamed("pass_id", "ball"), pitch)
    names = [f"{n}{c}" for c in FIELDS for n in totals]
    fields = located.select("pass_id", ball.alias("ball")).join(by_ball, "ball").groupBy("pass_id").agg(*[F.sum(n).alias(n) for n in names])
    dense = long(fields, FIELDS).unionByName(long(wide(located, COUNTED), COUNTED))
    set_cells = sparse_channels(located, SPARSE, pitch).withColumn("value", F.col("value").cast("float"))
    cell = F.col("y") * pitch.cols + F.col("x")
    return dense.unionByName(set_cells.groupBy("pass_id", "channel").agg(*[t(F.col("value"), cell).alias(n) for n, t in totals.items()]))


def channel_sums(located: DataFrame, number: int, sums: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]], pitch: Pitch = Pitch()) -> DataFrame:
    """(pass_id, <sums>): per pass the sums, over all cells of a dense channel, of a term in the value times a term in the cell number.

    `sums` gives the two terms by name. A channel of the ball's cell is made and summed once per ball cell, as many as
    the pitch has at most. Channels 10 and 11 drop by one behind each player ahead, so a pass adds, for each of them, what
    the value's term gains there times the sum of the cell's term up to that step. So the work grows with the passes
    and their players, and the cells are gone through for the pitch, not for each pass.
    """
    if number in COUNTED:
        side = "att" if number == COUNTED[0] else "def"
        upto = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        by_step = pitch_grid(located.sparkSession, pitch).groupBy("step").agg(*[F.sum(at(F.col("cell"))).alias(n) for n, (_, at) in sums.items()])
        steps = by_step.select("step", *[F.sum(n).over(upto).alias(n) for n in sums])
        whole = by_step.select(F.lit(-1).alias("step"), *[F.sum(n).alias(n) for n in sums])  # the value is 0 at first, everywhere
        ahead = F.expr(f"coalesce(array_sort(filter(transform({side}, p -> p.step), q -> q <= ball_step)), cast(array() as array<int>))")
        players = "inline(concat(array(struct(-1 step, 0 players)), transform(_ahead, (q, i) -> struct(q step, size(_ahead) - i players))))"
        drops = located.select("pass_id", ahead.alias("_ahead")).selectExpr("pass_id", players).join(beside(steps.unionByName(whole), pitch), "step")
        value = F.col("players").cast("double")

        def gain(of: Callable[[Column], Column]) -> Column:
            return F.when(F.col("players") == 0, of(value)).otherwise(of(value) - of(value - 1))

        return drops.groupBy("pass_id").agg(*[F.sum(gain(of) * F.col(n)).alias(n) for n, (of, _) in sums.items()])

    ball = F.expr(f"coalesce(cast(ball_y * {pitch.cols} + ball_x as bigint), -1L)")
    tasks = 4 * located.sparkSession.sparkContext.defaultParallelism
    balls = located.select(ball.alias("pass_id")).distinct().repartition(tasks, "pass_id")
    placed = [f"if(pass_id >= 0, int(pass_id {part} {pitch.cols}), null) {name}" for name, part in (("ball_y", "div"), ("ball_x", "%"))]
    cells = dense_cells(balls.selectExpr("pass_id", *placed), (number,), pitch)
    by_ball = cells.groupBy(F.col("pass_id").alias("ball")).agg(*[F.sum(of(F.col(f"c{number}")) * at(F.col("cell"))).alias(n) for n, (of, at) in sums.items()])
    lines = located.select("pass_id", ball.alias("ball")).join(beside(by_ball, pitch), "ball")
    return lines.groupBy("pass_id").agg(*[F.sum(n).alias(n) for n in sums])


def values_at_destination(located: DataFrame, number: int, pitch: Pitch = Pitch()) -> DataFrame:
    """(pass_id, y, x, p): a dense channel at each pass's destination; no other cell is made."""
    here = at_destination(with_step_counts(located) if number in (10, 11) else located, pitch)
    return here.selectExpr("pass_id", "y", "x", f"{dense_value(number, pitch)} p")


def stack_cells(located: DataFrame, pitch: Pitch = Pitch()) -> DataFrame:
    """One row per pass and cell with all 17 values c1..c17, zeros included.

    `<side>_at` is an array by cell with the 1-based index of the player there and 0 elsewhere, so a
    cell finds its player with one lookup.
    """
    sides = ("att", "def", "def_moving")
    kept = [c for c in located.columns if c not in sides]
    ordered = with_step_counts(located).withColumns({s: F.expr(f"array_sort({s})") for s in sides})
    run = "concat(array_repeat(0, p.cell - coalesce(get({0}, i - 1).cell, -1) - 1), array(i + 1))"
    indexed = ordered.withColumns({f"{s}_at": F.expr(f"flatten(transform({s}, (p, i) -> {run.format(s)}))") for s in sides})
    rows = over_grid(indexed, pitch).withColumns({f"{s}_no": F.expr(f"coalesce(get({s}_at, cell), 0)") for s in sides})

    values = {c: dense_value(c, pitch) for c in DENSE}
    for c, (side, value) in PLAYER_VALUES.items():
        of_player = value.replace("p.", f"get({side}, {side}_no - 1).")
        values[c] = f"case when {side}_no > 0 then double({of_player}) else 0.0D end"
    for c, value in BALL_VALUES.items():
        values[c] = f"case when y = ball_y and x = ball_x then {value} else 0.0D end"
    return rows.selectExpr(*kept, "cell", "y", "x", *[f"{values[c]} c{c}" for c in sorted(values)])


TENSOR_ROWS = 16  # passes per tensor batch: 8 MB of float32
TENSOR_INPUT = ("ball_y", "ball_x", "ball_step", "carrier_vx", "carrier_vy", "carrier_speed", "att", "def", "def_moving")


def tensor_input(located: DataFrame, *keys: str) -> DataFrame:
    """The compact columns `raster_batch` needs: about 1 KB per pass, where its stack has 470 KB."""
    return located.select(*keys, *TENSOR_INPUT)


def _players(column: pa.Array):
    """Row number, cell, step and velocity of every player in an Arrow list column."""
    rows = np.repeat(np.arange(len(column)), np.asarray(column.value_lengths()))
    players = column.flatten()
    cell, step, vx, vy = (players.field(n).to_numpy(zero_copy_only=False) for n in ("cell", "step", "vx", "vy"))
    return rows, cell, step, vx, vy


@lru_cache(maxsize=8)
def _cell_values(pitch: Pitch) -> tuple[np.ndarray, ...]:
    """Centres of the cells, the way from there to the goal and its length, and the goal step."""
    cy, cx = np.mgrid[0 : pitch.rows, 0 : pitch.cols] + 0.5
    goal_dx, goal_dy = pitch.goal_x - cx, pitch.goal_y - cy
    squares = goal_dx * goal_dx + goal_dy * goal_dy
    return cy, cx, goal_dx, goal_dy, np.sqrt(squares), ((4 * squares - 2) / 8).astype(int)


def raster_batch(batch: pa.RecordBatch, pitch: Pitch, channels: Sequence[int] = tuple(range(1, len(CHANNELS) + 1))) -> np.ndarray:
    """The float32 stacks [passes, channels, rows, cols] of an Arrow batch of `tensor_input` rows; all 17 channels or those asked for."""
    cy, cx, goal_dx, goal_dy, goal_norm, step_of_cell = _cell_values(pitch)
    at = {c: i for i, c in enumerate(channels)}

    def numbers(name):
        return batch.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)

    n = batch.num_rows
    row = np.arange(n)
    planes = np.zeros((n, len(at), pitch.rows, pitch.cols), dtype=np.float32)
    stack = planes.reshape(n, len(at), pitch.cells)
    ball_y, ball_x = numbers("ball_y"), numbers("ball_x")

    def fill(channel, values):
        if channel in at:
            planes[:, at[channel]] = values

    if not at.keys().isdisjoint((3, 5, 6, 17)):
        ball_dx, ball_dy = ball_x[:, None, None] - cx, ball_y[:, None, None] - cy
        to_ball = np.sqrt(ball_dx * ball_dx + ball_dy * ball_dy)
        fill(3, to_ball)
        fill(17, to_ball)
        if 5 in at or 6 in at:
            cosine = np.clip((goal_dx * ball_dx + goal_dy * ball_dy) / (goal_norm * to_ball), -1, 1)
            fill(5, cosine)
            fill(6, np.sqrt(1 - cosine * cosine))
    fill(4, goal_norm)
    if 7 in at:
        fill(7, np.abs(np.arctan2(goal_dy, goal_dx)))
    for channel, name in BALL_VALUES.items():
        if channel in at:
            stack[row, at[channel], (ball_y * pitch.cols + ball_x).astype(int)] = numbers(name)  # NaN where the passer is unknown
    for side, mark, ahead in (("att", 1, 10), ("def", 2, 11)):
        if mark in at or ahead in at:
            rows, cell, step, _, _ = _players(batch.column(side))
            if mark in at:
                stack[rows, at[mark], cell] = 1
            if ahead in at:
                in_front, last = step <= numbers("ball_step")[rows], step_of_cell.max()
                # from the farthest step inwards; a pass has some thousand steps, so they are kept short
                at_step = np.zeros((n, last + 1), np.uint16)
                np.add.at(at_step, (rows[in_front], last - step[in_front]), 1)
                fill(ahead, at_step.cumsum(axis=1, dtype=np.uint16).take(last - step_of_cell, axis=1))
    for side, first in (("att", 13), ("def_moving", 15)):
        if first in at or first + 1 in at:
            rows, cell, _, *speeds = _players(batch.column(side))
            for channel, speed in zip((first, first + 1), speeds, strict=True):
                if channel in at:
                    stack[rows, at[channel], cell] = speed
    return planes


def dense_row(
    located: DataFrame,
    pitch: Pitch = Pitch(),
    fold: Callable[[np.ndarray], list[pa.Array]] | None = None,
    fields: str = "stack array<array<float>>",
    by_plane: Callable[[np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """One row per pass with its stack as an array of 17 planes, each an array of all cells.

    Only for consumers that ask for tensors: 120k numbers per pass are laid out in an Arrow batch,
    which is several times faster than array functions in the JVM. A consumer that reduces the stack can do so where
    it is made: `fold` takes the tensors of some passes, [passes, 17, rows, cols], and gives the columns `fields`, so
    that the 470 KB of a stack need not be handed over. One that reduces each plane by itself gives `by_plane` instead, from
    planes [n, rows, cols] to n numbers; the one field is a list of 17. Passes of a ball cell share the planes that depend
    on it and the cell alone, so a task makes and reduces those once per ball cell, and has many passes for that.
    """

    def lists(stacks: np.ndarray) -> list[pa.Array]:
        return [nested_list(nested_list(pa.array(stacks.ravel()), pitch.cells), len(CHANNELS))]

    columns = fold or lists

    def planes(batches):
        numbers = _plane_numbers(by_plane, pitch) if by_plane else None
        for batch in batches:
            for start in range(0, batch.num_rows, TENSOR_ROWS):
                part = batch.slice(start, TENSOR_ROWS)
                values = [nested_list(pa.array(numbers(part).ravel()), len(CHANNELS))] if numbers else columns(raster_batch(part, pitch))
                yield pa.RecordBatch.from_arrays([part.column("pass_id"), *values], names)

    schema = f"pass_id bigint, {fields}"
    names = located.sparkSession.createDataFrame([], schema).columns
    rows = tensor_input(located, "pass_id")
    if by_plane:
        rows = rows.coalesce(4 * located.sparkSession.sparkContext.defaultParallelism)
    return rows.mapInArrow(planes, schema)


def _plane_numbers(reduce: Callable[[np.ndarray], np.ndarray], pitch: Pitch) -> Callable[[pa.RecordBatch], np.ndarray]:
    """A function from a batch of `tensor_input` to the number of each of the 17 planes of its passes; it keeps those of the ball cells it met."""
    of_ball: dict[float, np.ndarray] = {}
    of_pass = (*SPARSE, *COUNTED)

    def reduced(part: pa.RecordBatch, channels: Sequence[int]) -> np.ndarray:
        stacks = raster_batch(part, pitch, channels)
        return np.stack([reduce(stacks[:, i]) for i in range(len(channels))], axis=1)

    def numbers(part: pa.RecordBatch) -> np.ndarray:
        y, x = (part.column(n).cast(pa.float64()).fill_null(-1.0).to_numpy(zero_copy_only=False) for n in ("ball_y", "ball_x"))
        ball = np.where((y < 0) | (x < 0), -1.0, y * pitch.cols + x)
        balls, first = np.unique(ball, return_index=True)
        new = [i for i, b in enumerate(balls.tolist()) if b not in of_ball]
        if new:
            of_ball.update(zip(balls[new].tolist(), reduced(part.take(pa.array(first[new])), FIELDS), strict=True))
        own = reduced(part, of_pass)
        found = np.empty((part.num_rows, len(CHANNELS)), own.dtype)
        found[:, np.array(of_pass) - 1] = own
        found[:, np.array(FIELDS) - 1] = np.stack([of_ball[b] for b in ball.tolist()])
        return found

    return numbers


def nested_list(values: pa.Array, size: int) -> pa.Array:
    """Cut an Arrow array into lists of equal size."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, size, dtype=np.int32)), values)
