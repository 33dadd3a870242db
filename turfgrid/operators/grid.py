"""The raster's own table and the columns that depend on the cell alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfgrid.constants import MAX_BROADCAST_ROWS, Pitch
from turfgrid.functions.cells import angle_to_goal, distance, goal_step


def pitch_grid(spark: SparkSession, pitch: Pitch = Pitch()) -> DataFrame:
    """All cells with centre, order and distance to the goal, and angle to the goal."""
    cells = spark.range(0, pitch.cells, 1, 1).selectExpr(
        "int(id) cell", f"int(id div {pitch.cols}) y", f"int(id % {pitch.cols}) x"
    )
    return cells.selectExpr(
        "cell",
        "y",
        "x",
        "y + 0.5D cy",
        "x + 0.5D cx",
        f"{goal_step('y', 'x', pitch)} step",
        f"{distance('y', 'x', pitch.goal_y, pitch.goal_x)} d_goal",
        f"{angle_to_goal('y', 'x', pitch)} a_goal",
    )


def beside(grid: DataFrame, pitch: Pitch) -> DataFrame:
    """The grid, broadcast up to a fixed number of cells; a larger raster is left to the planner."""
    return F.broadcast(grid) if pitch.cells <= MAX_BROADCAST_ROWS else grid


def over_grid(located: DataFrame, pitch: Pitch = Pitch()) -> DataFrame:
    """Every pass against every cell. The grid's size is fixed by the pitch."""
    return located.crossJoin(beside(pitch_grid(located.sparkSession, pitch), pitch))


def at_destination(located: DataFrame, pitch: Pitch = Pitch()) -> DataFrame:
    """Every pass with the grid columns of its destination cell only."""
    grid = pitch_grid(located.sparkSession, pitch)
    return located.join(beside(grid, pitch), (grid["y"] == located["dest_y"]) & (grid["x"] == located["dest_x"]))
