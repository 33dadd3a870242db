import os
import tempfile

import pytest
from pyspark.sql import SparkSession

from turfgrid.session import tune

PASSES = (
    "pass_id bigint, game_id bigint, team_id bigint, player_id bigint, pass_outcome_type string, "
    "ball_x_start double, ball_y_start double, ball_x_end double, ball_y_end double, "
    "slots array<struct<slot:bigint, orig_id:bigint, slot_team:bigint, x:double, y:double, vx:double, vy:double>>"
)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    builder = (
        SparkSession.builder.master("local[8]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    session = builder.getOrCreate()
    if not session.sparkContext.getConf().get("spark.checkpoint.dir"):
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="turfgrid-"))
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


@pytest.fixture(scope="session")
def handmade(spark):
    """Passes with the awkward cases: shared cells, off-pitch and unplaced players, a lone side, no passer."""
    nan = float("nan")

    def slot(n, team, x, y, vx=0.0, vy=0.0, who=None):
        return (n, who or 100 + n, team, x, y, vx, vy)

    crowd = [
        slot(1, 1, -10.0, 3.0, 1.0, 2.0),
        slot(2, 1, -10.01, 3.0, 3.0, -4.0),  # same cell as slot 1, later in column order
        slot(3, 1, 60.0, 40.0, 0.5, 0.5),  # off the pitch
        slot(4, 1, 30.0, -12.0, 2.5, 1.5),
        slot(5, None, 1.0, 1.0, 9.0, 9.0),  # empty
        slot(6, 2, 20.0, 5.0, -1.0, 0.0),
        slot(7, 2, 20.0, 5.2, -2.0, 7.0),  # same cell as slot 6
        slot(8, 2, nan, 5.0, -3.0, 1.0),  # no position
        slot(9, 2, 45.0, 0.0, 6.0, -6.0),
        slot(10, 2, 50.0, 2.0, 6.5, -6.5),
        slot(11, 2, -40.0, 2.0, 7.5, -7.5),
    ]
    lone = [slot(1, 1, 0.0, 0.0, 1.0, 1.0), slot(2, 1, 10.0, 10.0, 2.0, 2.0)]
    rows = [
        (1, 1, 1, 104, "C", -10.0, 3.0, 30.0, -12.0, crowd),
        (2, 1, 2, 109, "D", 45.0, 0.0, 53.0, 1.0, crowd),
        (3, 1, 1, 999, "B", 5.0, 5.0, 5.0, 5.0, lone),
        (4, 2, 1, 101, "C", 0.0, 0.0, -52.5, -34.0, lone),
    ]
    return spark.createDataFrame(rows, PASSES)
