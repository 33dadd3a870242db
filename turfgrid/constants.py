"""Fixed values of the data model and the pitch geometry."""

from __future__ import annotations

import math
from dataclasses import dataclass

# Outcome codes of a pass and their label.
OUTCOME_LABELS = {"C": 1, "D": 0, "B": 0, "O": 0, "S": 0, "G": 0, "I": 0}

# Pitch size in metres (origin at the centre spot) and attacked goal.
PITCH_LENGTH = 105.0
PITCH_WIDTH = 68.0
GOAL = (52.5, 0.0)

# Training and evaluation settings.
BATCH_SIZE = 32
SPLIT_RATIO = 0.8
SPLIT_SEED = 42
CUTOFF = 0.75
LOG_FLOOR = -100.0
FIRST_BEST_LOSS = 1e12
EPOCHS = 100
LEARNING_RATE = 0.01
WEIGHT_DECAY = 0.01

# The 17 channels of the stack, in order.
CHANNELS = (
    "attackers",
    "defenders",
    "distance_to_ball",
    "distance_to_goal",
    "cosine_ball_goal",
    "sine_ball_goal",
    "angle_to_goal",
    "ball_speed_x",
    "ball_speed_y",
    "attackers_outplayed",
    "defenders_outplayed",
    "carrier_speed",
    "attacker_vx",
    "attacker_vy",
    "defender_vx",
    "defender_vy",
    "distance_to_origin",
)

# A table with more rows than this is not broadcast.
MAX_BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Pitch:
    """A raster over the pitch; cells are numbered row by row."""

    rows: int = 68
    cols: int = 104

    @property
    def cells(self) -> int:
        return self.rows * self.cols

    @property
    def goal_x(self) -> int:
        share = (GOAL[0] + PITCH_LENGTH / 2) / PITCH_LENGTH
        return math.floor(min(max(share * self.cols, 0), self.cols - 1))

    @property
    def goal_y(self) -> int:
        share = (GOAL[1] + PITCH_WIDTH / 2) / PITCH_WIDTH
        return math.floor(min(max(share * self.rows, 0), self.rows - 1))
