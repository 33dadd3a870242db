"""Audit of channel stacks and single planes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turfgrid.constants import CHANNELS, Pitch
from turfgrid.functions.cells import missing
from turfgrid.operators.channels import BALL_VALUES, PLAYER_VALUES, channel


def nan_channels(located: DataFrame, pitch: Pitch = Pitch()) -> DataFrame:
    """Per channel, how many cells and passes hold no number; counted on the pass rows, no cell is made.

    A sparse channel lacks a number where what it holds at a set cell is missing. The channels that depend
    on the ball lack all cells of a pass without a ball; the others always have a number.
    """
    no_ball = "(ball_y is null or ball_x is null)"
    holes = {c: "0" for c in range(1, len(CHANNELS) + 1)}
    holes |= {c: f"if({no_ball}, {pitch.cells}, 0)" for c in (3, 5, 6, 17)}
    for c, (side, value) in PLAYER_VALUES.items():
        if value != "1":
            holes[c] = f"size(filter({side}, p -> {value} is null or isnan({value})))"
    for c, value in BALL_VALUES.items():
        holes[c] = f"if(not {no_ball} and ({value} is null or isnan({value})), 1, 0)"
    counted = located.selectExpr(*[f"cast({t} as bigint) n{c}" for c, t in holes.items()])
    totals = counted.agg(
        *[F.coalesce(F.sum(f"n{c}"), F.lit(0).cast("bigint")).alias(f"cells{c}") for c in holes],
        *[F.count_if(F.col(f"n{c}") > 0).alias(f"passes{c}") for c in holes],
    )
    lines = [
        F.struct(
            F.lit(c).alias("channel"),
            F.lit(name).alias("name"),
            F.col(f"cells{c}").alias("nan_cells"),
            F.col(f"passes{c}").alias("nan_passes"),
            (F.col(f"cells{c}") > 0).alias("has_nan"),
        )
        for c, name in enumerate(CHANNELS, start=1)
    ]
    return totals.select(F.inline(F.array(*lines)))


def pass_audit(carried: DataFrame) -> DataFrame:
    """Counts behind the gaps: passers not found, players without a position, sides without a player."""
    unplaced = F.size(F.filter("slots", lambda s: s["slot_team"].isNotNull() & (missing(s["x"]) | missing(s["y"]))))

    def empty(attacking):
        same = lambda s: F.coalesce(s["slot_team"] == F.col("team_id"), F.lit(False))
        return ~F.exists("slots", lambda s: s["slot_team"].isNotNull() & (same(s) if attacking else ~same(s)))

    return carried.agg(
        F.count("*").alias("passes"),
        F.count_if(F.col("carrier_slot").isNull()).alias("passer_not_found"),
        F.sum(unplaced).alias("players_unplaced"),
        F.count_if(empty(True)).alias("no_attacker"),
        F.count_if(empty(False)).alias("no_defender"),
    )


def channel_slice(located: DataFrame, pass_id: int, number: int, pitch: Pitch = Pitch()) -> DataFrame:
    """One plane of one pass. The pass is picked before its cells are made."""
    return channel(located.where(F.col("pass_id") == pass_id), number, pitch)


def as_matrix(plane: DataFrame, pitch: Pitch = Pitch()) -> DataFrame:
    """A plane as a picture: one row per y, one column per x, 0 where nothing is set."""
    return plane.groupBy("y").pivot("x", list(range(pitch.cols))).agg(F.first("value")).na.fill(0.0)


def rank_scale(surface: DataFrame) -> DataFrame:
    """Map each pass's surface to uniform quantiles."""
    order = Window.partitionBy("pass_id").orderBy("p")
    return surface.withColumn("quantile", F.percent_rank().over(order))
