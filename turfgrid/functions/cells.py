"""Functions on columns: metres to cells, distances, angles, labels.

Geometry is kept as SQL text: it is used inside array lambdas as well as on columns, and one parsed
expression is built much faster than a tree of column calls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turfgrid.constants import LOG_FLOOR, OUTCOME_LABELS, PITCH_LENGTH, PITCH_WIDTH, Pitch


def missing(value: Column) -> Column:
    return value.isNull() | F.isnan(value)


def is_number(value: str) -> str:
    return f"({value} is not null and not isnan({value}))"


def _bin(metres: str, extent: float, bins: int) -> str:
    scaled = f"({metres} + {extent / 2}D) / {extent}D * {bins}.0D"
    # least/greatest would send NaN and NULL to the far edge
    return f"case when {is_number(metres)} then int(floor(least(greatest({scaled}, 0.0D), {bins - 1}.0D))) end"


def cell_x(metres: str, pitch: Pitch = Pitch()) -> str:
    """Column of the raster for a position along the pitch; off-pitch points go to the edge."""
    return _bin(metres, PITCH_LENGTH, pitch.cols)


def cell_y(metres: str, pitch: Pitch = Pitch()) -> str:
    """Row of the raster for a position across the pitch."""
    return _bin(metres, PITCH_WIDTH, pitch.rows)


def in_bounds(y: str, x: str, pitch: Pitch = Pitch()) -> str:
    return f"({y}) between 0 and {pitch.rows - 1} and ({x}) between 0 and {pitch.cols - 1}"


def encode_outcome(code: Column) -> Column:
    """1 for a completed pass, 0 for the other known codes, NULL for an unknown one."""
    completed = [c for c, label in OUTCOME_LABELS.items() if label == 1]
    failed = [c for c, label in OUTCOME_LABELS.items() if label == 0]
    return F.when(code.isin(completed), 1).when(code.isin(failed), 0)


def speed(vx: Column, vy: Column) -> Column:
    return F.sqrt(vx * vx + vy * vy)


def to_id(value: Column) -> Column:
    """Identifier as bigint; text or fractions that are no number become NULL."""
    return value.try_cast("bigint")


def _length(dy: str, dx: str) -> str:
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


def distance(y: str, x: str, to_y: str, to_x: str) -> str:
    """Distance in cells from the centre of cell (y, x) to an integer index."""
    return _length(f"({y} + 0.5D - {to_y})", f"({x} + 0.5D - {to_x})")


def _to_goal(y: str, x: str, pitch: Pitch) -> tuple[str, str]:
    return f"({pitch.goal_y} - ({y} + 0.5D))", f"({pitch.goal_x} - ({x} + 0.5D))"


def cosine_ball_goal(y: str, x: str, ball_y: str, ball_x: str, pitch: Pitch) -> str:
    """Cosine of the angle at the cell centre between ball and goal; NULL without a ball."""
    gy, gx = _to_goal(y, x, pitch)
    by, bx = f"({ball_y} - ({y} + 0.5D))", f"({ball_x} - ({x} + 0.5D))"
    cosine = f"({gx} * {bx} + {gy} * {by}) / ({_length(gy, gx)} * {_length(by, bx)})"
    # least/greatest pass over NULL
    return f"if({ball_y} is null or {ball_x} is null, cast(null as double), least(greatest({cosine}, -1.0D), 1.0D))"


def sine_from(cosine: str) -> str:
    return f"sqrt(1.0D - {cosine} * {cosine})"


def angle_to_goal(y: str, x: str, pitch: Pitch) -> str:
    gy, gx = _to_goal(y, x, pitch)
    return f"abs(atan2({gy}, {gx}))"


def goal_step(y: str, x: str, pitch: Pitch) -> str:
    """Integer that orders cells by their distance to the goal.

    A cell centre lies an odd number of half cells from the goal index on both axes, so four times the
    squared distance is 2 modulo 8: dropping that remainder gives small integers with the same order
    and the same ties as the distance itself.
    """
    dy, dx = f"(2 * {y} + {1 - 2 * pitch.goal_y})", f"(2 * {x} + {1 - 2 * pitch.goal_x})"
    return f"shiftright({dx} * {dx} + {dy} * {dy} - 2, 3)"


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def relu(value: Column) -> Column:
    return F.greatest(value, F.lit(0.0))


def classify(p: Column, cutoff: float) -> Column:
    return (p >= F.lit(cutoff)).cast("int")


def floored_log(p: Column) -> Column:
    """Natural logarithm, never below the floor of the loss; log of 0 is the floor."""
    return F.when(p <= 0, F.lit(LOG_FLOOR)).otherwise(F.greatest(F.ln(p), F.lit(LOG_FLOOR)))


def cross_entropy(label: Column, p: Column) -> Column:
    label = label.cast("double")
    return -(label * floored_log(p) + (F.lit(1.0) - label) * floored_log(F.lit(1.0) - p))
