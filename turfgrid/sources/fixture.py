"""Synthetic passes derived from the `events` table by integer arithmetic.

The rules are those of FIXTURES.md. They are kept as SQL text so that the Spark job and the oracle
state the same rule; doubles come out bit-equal because only integers are divided.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfgrid.session import task_count

SLOTS = 22


def _passer_slot(e: str) -> str:
    return f"(({e} % 11) + 1 + 11*({e} % 2))"


def _axis(e: str, k: str, mul: int, slot_mul: int, mod: int, half: str) -> str:
    twin = f"(case when {e} % 7 = 0 and {k} in (2, 13) then {k} - 1 else {k} end)"
    return f"(cast(({e}*{mul} + {twin}*{slot_mul}) % {mod} as double)/cast(100 as double) - cast({half} as double))"


def _x(e: str, k: str) -> str:
    return _axis(e, k, 7919, 104729, 10501, "52.5")


def _y(e: str, k: str) -> str:
    return _axis(e, k, 6007, 15485863, 6801, "34")


def _identity(e: str, k: str) -> str:
    swapped = f"(case when {e} % 5 = 0 and {k} in (3, 4) then 7 - {k} else {k} end)"
    substitute = f"(case when {k} % 11 = 5 and {e} % 3 = 0 then 1 else 0 end)"
    return f"(1000*({e} % 16) + 10*{swapped} + {substitute})"


def _end(e: str, mul: int, add: int, mod: int, half: str) -> str:
    metres = f"cast(({e}*{mul} + {add}) % {mod} as double)/cast(100 as double) - cast({half} as double)"
    return f"(case when {e} % 41 = 0 then null else {metres} end)"


def pass_fields(e: str) -> dict[str, str]:
    """SQL text of the scalar columns of a pass, by name."""
    k = _passer_slot(e)
    codes = " ".join(f"when {e} % 12 = {i} then '{c}'" for i, c in enumerate("DBOSGI"))
    return {
        "pass_id": e,
        "game_id": f"({e} % 16)",
        "team_id": f"(1 + {e} % 2)",
        "player_id": f"(case when {e} % 37 = 0 then -1 else {_identity(e, k)} end)",
        "pass_outcome_type": f"(case when {e} % 23 = 0 then null when {e} % 97 = 0 then 'Z' {codes} else 'C' end)",
        "ball_x_start": _x(e, k),
        "ball_y_start": _y(e, k),
        "ball_x_end": _end(e, 4099, 7, 11001, "52.5"),
        "ball_y_end": _end(e, 2053, 11, 6801, "34"),
    }


def slot_fields(e: str, k: str) -> dict[str, str]:
    """SQL text of the fields of slot k of a pass, by name."""
    return {
        "slot": k,
        "orig_id": _identity(e, k),
        "slot_team": f"(case when ({e} + {k}) % 29 = 0 then null when {k} <= 11 then 1 else 2 end)",
        "x": _x(e, k),
        "y": _y(e, k),
        "vx": f"(cast(({e}*31 + {k}*17) % 161 as double)/cast(10 as double) - cast(8 as double))",
        "vy": f"(cast(({e}*13 + {k}*29) % 161 as double)/cast(10 as double) - cast(8 as double))",
    }


_SLOTS_TYPE = "array<struct<slot:bigint,orig_id:bigint,slot_team:bigint,x:double,y:double,vx:double,vy:double>>"


def _slots_of(ids: pa.Array) -> pa.Array:
    """The slots of a batch of passes by the rules of `slot_fields`: a few operations on whole columns of numbers."""
    lacking = np.repeat(ids.is_null().to_numpy(zero_copy_only=False), SLOTS)
    e = np.repeat(ids.fill_null(0).cast(pa.int64()).to_numpy(), SLOTS)
    k = np.tile(np.arange(1, SLOTS + 1, dtype=np.int64), len(ids))
    twin = np.where((e % 7 == 0) & ((k == 2) | (k == 13)), k - 1, k)
    swapped = np.where((e % 5 == 0) & ((k == 3) | (k == 4)), 7 - k, k)
    substitute = (k % 11 == 5) & (e % 3 == 0)

    def left(number: np.ndarray, by: int) -> np.ndarray:
        return np.fmod(number, by)  # as in SQL, with the sign of the number

    def column(values: np.ndarray) -> pa.Array:
        return pa.array(values, mask=lacking)

    fields = {
        "slot": pa.array(k),
        "orig_id": column(1000 * left(e, 16) + 10 * swapped + substitute),
        "slot_team": pa.array(np.where(k <= 11, 1, 2), mask=~lacking & (left(e + k, 29) == 0)),
        "x": column(left(e * 7919 + twin * 104729, 10501) / 100 - 52.5),
        "y": column(left(e * 6007 + twin * 15485863, 6801) / 100 - 34.0),
        "vx": column(left(e * 31 + k * 17, 161) / 10 - 8.0),
        "vy": column(left(e * 13 + k * 29, 161) / 10 - 8.0),
    }
    offsets = pa.array(np.arange(0, len(k) + 1, SLOTS, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def passes_from_ids(ids: DataFrame, column: str = "event_id") -> DataFrame:
    """Passes for a table of ids: narrow, so it also takes a stream.

    The slots are made for a batch of passes at a time; as a lambda for each slot they took most of the time of a job.
    """
    scalars = [F.expr(sql).alias(name) for name, sql in pass_fields(column).items()]
    slots = F.arrow_udf(_slots_of, _SLOTS_TYPE)(F.col(column).cast("bigint"))
    return ids.select(*scalars, slots.alias("slots"))


def fixture_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes of a test data folder.

    Only the 8-byte id is spread over the cluster; the wide rows are made afterwards and keep the
    hash layout on pass_id, so later groupings by pass need no further shuffle.
    """
    ids = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    return passes_from_ids(ids.repartition(task_count(ids), "event_id"))
