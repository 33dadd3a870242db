"""Player slots: wide columns to an array on the pass row, roles, and the passer's own slot.

The array stays on the pass row, so roles, cells and the passer are found without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turfgrid.constants import MAX_BROADCAST_ROWS, PITCH_LENGTH, PITCH_WIDTH, Pitch
from turfgrid.functions.cells import cell_x, cell_y, encode_outcome, goal_step, to_id
from turfgrid.session import scratch_dir

# Prefixes of the wide player columns and the field each one holds.
SLOT_PREFIXES = {
    "x_player_": "x",
    "y_player_": "y",
    "vx_player_": "vx",
    "vy_player_": "vy",
    "team_id_player_": "slot_team",
    "original_pId_player_": "orig_id",
}

SLOT_FIELDS = ("slot", "orig_id", "slot_team", "x", "y", "vx", "vy")


@dataclass(frozen=True)
class SlotColumns:
    """Column names of one slot; a field without a column is absent."""

    ordinal: int
    slot: int
    columns: dict


def discover_slots(columns: list[str]) -> list[SlotColumns]:
    """Find the player slots in a header, in the order of their identity columns; slots without one come after."""
    names, found = set(columns), {}
    for prefix in ("original_pId_player_", "x_player_"):
        for column in columns:
            suffix = column.removeprefix(prefix)
            if column.startswith(prefix) and suffix.isdigit() and suffix not in found:
                fields = {f: p + suffix for p, f in SLOT_PREFIXES.items() if p + suffix in names}
                found[suffix] = SlotColumns(len(found), int(suffix), fields)
    return list(found.values())


def gather_slots(wide: DataFrame) -> DataFrame:
    """Replace the wide player columns by one `slots` array."""
    slots = discover_slots(wide.columns)
    used = {name for s in slots for name in s.columns.values()}

    def field(s: SlotColumns, name: str) -> str:
        if name == "slot":
            return f"bigint({s.slot}) slot"
        value = f"`{s.columns[name]}`" if name in s.columns else "null"
        return f"try_cast({value} as bigint) {name}" if name in ("orig_id", "slot_team") else f"double({value}) {name}"

    array = ", ".join(f"struct({', '.join(field(s, n) for n in SLOT_FIELDS)})" for s in slots)
    kept = [c for c in wide.columns if c not in used]
    return wide.select(*kept, F.expr(f"array({array})").alias("slots"))


def spread_slots(passes: DataFrame, slots: list[int]) -> DataFrame:
    """Inverse of `gather_slots` for given slot numbers: one set of wide columns per slot."""
    kept = [c for c in passes.columns if c != "slots"]
    # most passes list these numbers in this order; in the others a slot is found by a plain search
    order = ", ".join(f"{n}L" for n in slots)
    listed = passes.selectExpr(*kept, "slots", f"slots.slot = cast(array({order}) as array<bigint>) _listed")
    found = [f"if(_listed, {slots.index(n)}, int(array_position(slots.slot, {n}L)) - 1) _at{i}" for i, n in enumerate(slots)]
    wide = [f"get(slots, _at{i}).{field} {prefix}{n}" for i, n in enumerate(slots) for prefix, field in SLOT_PREFIXES.items()]
    return listed.selectExpr(*kept, "slots", *found).selectExpr(*kept, *wide)


def unpivot_slots(passes: DataFrame) -> DataFrame:
    """One row per pass and slot, with the slot's position in column order.

    The outer form keeps the planner from adding a test for empty arrays below, where it would
    compute a derived array a second time.
    """
    exploded = passes.select("pass_id", "game_id", "team_id", F.posexplode_outer("slots").alias("slot_ord", "s"))
    return exploded.where("slot_ord is not null").select("pass_id", "game_id", "team_id", "slot_ord", "s.*")


def is_active(slot_team: Column) -> Column:
    return slot_team.isNotNull()


def side_of(slot_team: Column, team_id: Column) -> Column:
    return F.when(slot_team == team_id, "att").otherwise("def")


def active_slots(slots_long: DataFrame) -> DataFrame:
    """Slots of `unpivot_slots` that hold a player."""
    return slots_long.where(is_active(F.col("slot_team")))


def with_side(slots_long: DataFrame) -> DataFrame:
    return slots_long.withColumn("side", side_of(F.col("slot_team"), F.col("team_id")))


def cast_ids(passes: DataFrame) -> DataFrame:
    return passes.withColumns({c: to_id(F.col(c)) for c in ("player_id", "team_id")})


def _first_slot(field: str, value: str) -> str:
    """The first slot whose field has this value: a search in a list of numbers, as a lambda would work out the value for each slot."""
    return f"get(slots, int(array_position(slots.{field}, {value})) - 1)"


def resolve_passer(passes: DataFrame) -> DataFrame:
    """Add `carrier_slot`: the first slot of the pass row that holds the passer."""
    return passes.withColumn("carrier_slot", F.expr(f"{_first_slot('orig_id', 'player_id')}.slot"))


def resolve_passer_by_game(passes: DataFrame, salts: int = 16, max_broadcast: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Add `carrier_slot` found over the whole game: the first slot, in column order, that ever holds the passer.

    A game is a file: where passes carry their `source_file`, that is the key, whatever its name; passes
    without one go by `game_id`.

    The lookup has one row per game and player, after map-side aggregation, and is written once. It goes to the tasks
    whole while it is small, so the passes stay where they are. Beyond that the passes are salted, as a game may hold
    most of them, and the short lookup is repeated once per salt.
    """
    game = "source_file" if "source_file" in passes.columns else "game_id"
    spark = passes.sparkSession
    found = (
        passes.select(game, F.posexplode_outer("slots").alias("slot_ord", "s"))
        .where(F.col("s.orig_id").isNotNull())
        .groupBy(game, F.col("s.orig_id").alias("player_id"))
        .agg(F.min_by("s.slot", "slot_ord").alias("carrier_slot"))
    )
    path = scratch_dir(spark, "passers")
    found.write.parquet(path)
    lookup = spark.read.schema(found.schema).parquet(path)
    if lookup.count() <= max_broadcast:
        return passes.join(F.broadcast(lookup), [game, "player_id"], "left")
    lookup = lookup.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = passes.withColumn("salt", F.pmod(F.xxhash64("pass_id"), F.lit(salts)).cast("int"))
    return salted.join(lookup, [game, "player_id", "salt"], "left").drop("salt")


def attach_carrier(passes: DataFrame) -> DataFrame:
    """Add the passer's velocity on this pass; NULL when the passer was not found."""
    own = F.expr(_first_slot("slot", "carrier_slot"))
    return passes.withColumn("_own", own).selectExpr(
        *passes.columns,
        "_own.vx carrier_vx",
        "_own.vy carrier_vy",
        "sqrt(_own.vx * _own.vx + _own.vy * _own.vy) carrier_speed",
    )


def with_carrier(passes: DataFrame, compat: bool = False) -> DataFrame:
    """Passer and velocity; `compat` searches the whole game and repeats vx as vy."""
    if not compat:
        return attach_carrier(resolve_passer(passes))
    return attach_carrier(resolve_passer_by_game(passes)).withColumn("carrier_vy", F.col("carrier_vx"))


def build_sample(carried: DataFrame) -> DataFrame:
    """The fields one pass contributes to its raster."""
    return carried.select(
        "pass_id",
        "ball_x_start",
        "ball_y_start",
        "ball_x_end",
        "ball_y_end",
        "pass_outcome_type",
        "team_id",
        "carrier_vx",
        "carrier_vy",
        "carrier_speed",
        "slots",
    )


_PLAYERS = "array<struct<cell:int,step:int,vx:double,vy:double>>"


def _players(attacking: bool, pitch: Pitch) -> Column:
    """Array of the placed players of one side with their cells, in slot order; for a batch of passes at a time."""

    def run(team_id: pa.Array, slot_team: pa.Array, x: pa.Array, y: pa.Array, vx: pa.Array, vy: pa.Array) -> pa.Array:
        held = pc.fill_null(pc.list_value_length(slot_team), 0).to_numpy()
        row = np.repeat(np.arange(len(held)), held)
        team = slot_team.flatten()
        same = pc.fill_null(pc.equal(team, team_id.take(pa.array(row))), False)
        across, along = (pc.fill_null(c.flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False) for c in (y, x))
        side = (same if attacking else pc.invert(same)).to_numpy(zero_copy_only=False)
        chosen = np.flatnonzero(side & team.is_valid().to_numpy(zero_copy_only=False) & ~np.isnan(across) & ~np.isnan(along))
        cells = []
        for metres, extent, bins in ((across[chosen], PITCH_WIDTH, pitch.rows), (along[chosen], PITCH_LENGTH, pitch.cols)):
            cells.append(np.floor(np.clip((metres + extent / 2) / extent * float(bins), 0.0, bins - 1.0)).astype(np.int32))
        cy, cx = cells
        dy, dx = 2 * cy + (1 - 2 * pitch.goal_y), 2 * cx + (1 - 2 * pitch.goal_x)
        step = (dx * dx + dy * dy - 2) >> 3  # as `goal_step`
        taken = pa.array(chosen)
        fields = [pa.array(cy * np.int32(pitch.cols) + cx), pa.array(step), *(v.flatten().cast(pa.float64()).take(taken) for v in (vx, vy))]
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[chosen], minlength=len(held)))]).astype(np.int32)
        players = pa.StructArray.from_arrays(fields, ["cell", "step", "vx", "vy"])
        return pa.ListArray.from_arrays(pa.array(ends), players, mask=slot_team.is_null())

    return F.arrow_udf(run, _PLAYERS)("team_id", *[f"slots.{n}" for n in ("slot_team", "x", "y", "vx", "vy")])


def _one_per_cell(players: str) -> str:
    """Keep the last player of each cell."""
    later = f"slice({players}, i + 2, size({players}))"
    last = f"filter({players}, (p, i) -> not exists({later}, q -> q.cell = p.cell))"
    # most passes have no two players in a cell, which is seen without a look at each pair
    return f"if(size(array_distinct({players}.cell)) = size({players}), {players}, {last})"


def locate(passes: DataFrame, pitch: Pitch = Pitch(), compat: bool = False) -> DataFrame:
    """Compact row per pass with everything its channels need; narrow from end to end.

    `att` and `def` hold one entry per occupied cell (the last slot wins) with its cell, its place in
    the order of distance to the goal, and its velocity. `def_moving` is `def`, or under `compat` only
    the defenders that come no later than the number of attackers.
    """
    columns = [c for c in passes.columns if c != "slots"]
    base = passes.select(
        *columns,
        encode_outcome(F.col("pass_outcome_type")).alias("target"),
        F.expr(cell_y("ball_y_start", pitch)).alias("ball_y"),
        F.expr(cell_x("ball_x_start", pitch)).alias("ball_x"),
        F.expr(cell_y("ball_y_end", pitch)).alias("dest_y"),
        F.expr(cell_x("ball_x_end", pitch)).alias("dest_x"),
        _players(True, pitch).alias("att_all"),
        _players(False, pitch).alias("def_all"),
    )
    moving = "slice(def_all, 1, size(att_all))" if compat else "def_all"
    return base.withColumn("moving_all", F.expr(moving)).selectExpr(
        *columns,
        "target",
        "ball_y",
        "ball_x",
        f"{goal_step('ball_y', 'ball_x', pitch)} ball_step",
        "dest_y",
        "dest_x",
        f"{_one_per_cell('att_all')} att",
        f"{_one_per_cell('def_all')} def",
        f"{_one_per_cell('moving_all')} def_moving",
        "size(att_all) n_att",
        "size(def_all) n_def",
    )
