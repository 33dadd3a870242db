"""Channels against a cell-by-cell count written from their definitions."""

import math
import pathlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turfgrid import Pitch
from turfgrid.functions.cells import missing
from turfgrid.operators import audit, channels, row_raster, surfaces
from turfgrid.operators.audit import as_matrix, channel_slice, nan_channels, pass_audit
from turfgrid.operators.fit import destination_features
from turfgrid.operators.slots import resolve_passer
from turfgrid.plans import jobs
from turfgrid.plans.jobs import prepare
from turfgrid.session import scratch_dir
from turfgrid.sources import tables

PITCH = Pitch()
NAN = float("nan")


def brute_force(row, compat=False):
    """The 17 planes of one collected pass, one cell at a time."""

    def cell(x, y):
        cx = int(min(max((x + 52.5) / 105 * 104, 0), 103))
        cy = int(min(max((y + 34) / 68 * 68, 0), 67))
        return cy, cx

    def to(y, x, point):
        return math.hypot(x + 0.5 - point[1], y + 0.5 - point[0])

    placed = [s for s in row.slots if s.slot_team is not None and not math.isnan(s.x) and not math.isnan(s.y)]
    sides = [[s for s in placed if s.slot_team == row.team_id], [s for s in placed if s.slot_team != row.team_id]]
    ball, goal = cell(row.ball_x_start, row.ball_y_start), cell(52.5, 0.0)
    passer = [s for s in row.slots if s.orig_id == row.player_id]
    vx, vy = (passer[0].vx, passer[0].vy) if passer else (NAN, NAN)
    planes = np.zeros((17, 68, 104))
    planes[7][ball], planes[8][ball], planes[11][ball] = vx, vx if compat else vy, math.hypot(vx, vy)
    for side, mark, velocity in ((0, 0, 12), (1, 1, 14)):
        for number, s in enumerate(sides[side]):
            planes[mark][cell(s.x, s.y)] = 1
            if side == 0 or not compat or number < len(sides[0]):
                planes[velocity][cell(s.x, s.y)] = s.vx
                planes[velocity + 1][cell(s.x, s.y)] = s.vy
    reach = to(*ball, goal)
    for y in range(68):
        for x in range(104):
            planes[2, y, x] = planes[16, y, x] = to(y, x, ball)
            planes[3, y, x] = here = to(y, x, goal)
            gx, gy, bx, by = goal[1] - x - 0.5, goal[0] - y - 0.5, ball[1] - x - 0.5, ball[0] - y - 0.5
            cosine = (gx * bx + gy * by) / (math.hypot(gx, gy) * math.hypot(bx, by))
            planes[4, y, x] = min(max(cosine, -1), 1)
            planes[5, y, x] = math.sqrt(1 - planes[4, y, x] ** 2)
            planes[6, y, x] = abs(math.atan2(gy, gx))
            for side, mark in ((0, 9), (1, 10)):
                cells = {cell(s.x, s.y) for s in sides[side]}
                planes[mark, y, x] = sum(here <= to(*c, goal) <= reach for c in cells)
    return planes


def as_planes(long_rows):
    planes = {}
    for r in long_rows:
        stack = planes.setdefault(r.pass_id, np.zeros((17, 68, 104)))
        stack[r.channel - 1, r.y, r.x] = NAN if r.value is None else r.value
    return planes


@pytest.mark.parametrize("compat", [False, True])
def test_stack_equals_brute_force(handmade, compat):
    found = as_planes(channels.channel_stack(prepare(handmade, PITCH, compat)).collect())
    for row in handmade.collect():
        np.testing.assert_allclose(found[row.pass_id], brute_force(row, compat), rtol=1e-6, atol=1e-6)


def test_wide_cells_and_tensor_equal_brute_force(handmade):
    located = prepare(handmade)
    wide = channels.stack_cells(located).toPandas()
    tensors = {r.pass_id: np.array(r.stack) for r in channels.dense_row(located).collect()}
    for row in handmade.collect():
        want = brute_force(row)
        mine = wide[wide["pass_id"] == row.pass_id].sort_values("cell")
        got = np.stack([mine[f"c{c}"].to_numpy(dtype=float) for c in range(1, 18)]).reshape(17, 68, 104)
        np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(tensors[row.pass_id].reshape(17, 68, 104), want, rtol=1e-6, atol=1e-6)


def test_features_at_the_destination_are_the_planes_there(handmade):
    for r in destination_features(prepare(handmade)).collect():
        row = [p for p in handmade.collect() if p.pass_id == r.pass_id][0]
        want = brute_force(row)[:, r.dest_y, r.dest_x]
        got = [NAN if r[f"c{c}"] is None else r[f"c{c}"] for c in range(1, 18)]
        np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9)


def test_properties(handmade):
    located = prepare(handmade)
    cells = channels.stack_cells(located)
    assert cells.where("abs(c5 * c5 + c6 * c6 - 1) > 1e-9").count() == 0
    assert cells.where("c10 > n_att or c11 > n_def").count() == 0
    mask = channels.destination_mask(located).collect()
    assert len(mask) == 4 and {m.value for m in mask} == {1.0}


def test_audit_and_slice(handmade):
    located = prepare(handmade)
    holes = {r.channel for r in nan_channels(located).collect() if r.has_nan}
    assert holes == {8, 9, 12}
    audit = pass_audit(resolve_passer(handmade)).first()
    assert (audit.passes, audit.passer_not_found, audit.players_unplaced) == (4, 1, 2)
    assert (audit.no_attacker, audit.no_defender) == (0, 2)
    matrix = as_matrix(channel_slice(located, 1, 3)).collect()
    assert len(matrix) == 68 and len(matrix[0]) == 105


def test_totals_by_channel_are_those_of_the_stack(handmade):
    located = jobs.prepare(handmade)
    totals = {"n": lambda v, cell: F.count("*"), "s": lambda v, cell: F.round(F.sum(v.cast("double") * (cell + 1)), 3)}
    stack = channels.channel_stack(located).withColumn("cell", F.col("y") * 104 + F.col("x"))
    want = stack.groupBy("pass_id", "channel").agg(*[t(F.col("value"), F.col("cell")).alias(n) for n, t in totals.items()])
    key = lambda rows: sorted((r.pass_id, r.channel, r.n, r.s) for r in rows if r.s is not None)
    assert key(channels.channel_totals(located, totals).collect()) == key(want.collect())


def test_dense_values_at_the_destination(handmade):
    located = jobs.prepare(handmade)
    cells = channels.stack_cells(located).where("y = dest_y and x = dest_x").collect()
    for number in channels.DENSE:
        got = {r.pass_id: r.p for r in channels.values_at_destination(located, number).collect()}
        assert got == {r.pass_id: r[f"c{number}"] for r in cells}


def test_gaps_are_counted_without_cells(spark, handmade):
    """Against the cells themselves, with lone sides, players without position or velocity, a pass without a ball."""
    nan = "cast('NaN' as double)"
    speed = f"if(pass_id = 2 and s.slot in (3, 9), {nan}, s.vx) as vx, if(s.slot = 4, null, s.vy) as vy"
    changed = handmade.withColumn("slots", F.expr(f"transform(slots, s -> struct(s.slot, s.orig_id, s.slot_team, s.x, s.y, {speed}))"))
    lost = changed.where("pass_id = 1").withColumns({"pass_id": F.lit(9).cast("bigint"), "ball_x_start": F.expr(nan)})
    located = jobs.prepare(changed.unionByName(lost))
    cells = channels.stack_cells(located)
    holes = [F.count_if(missing(F.col(f"c{c}"))).alias(f"c{c}") for c in range(1, 18)]
    by_pass = cells.groupBy("pass_id").agg(*holes).collect()
    found = audit.nan_channels(located)
    got = {r.channel: (r.nan_cells, r.nan_passes, r.has_nan) for r in found.collect()}
    for c in range(1, 18):
        counts = [r[f"c{c}"] for r in by_pass]
        assert got[c] == (sum(counts), sum(n > 0 for n in counts), sum(counts) > 0)
    assert {c for c in got if got[c][2]} == {3, 5, 6, 8, 9, 12, 13, 14, 15, 16, 17}
    assert "Range" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert audit.nan_channels(located.limit(0)).where("nan_cells = 0 and not has_nan").count() == 17


def test_stored_surfaces_join_without_an_exchange(spark, handmade):
    located = jobs.prepare(handmade)
    scored = surfaces.linear_surfaces(located, [0.0, 0.0, 1.0] + [0.0] * 14, 0.0, head="none").select("pass_id", "surface")
    stored = tables.write_bucketed(scored, scratch_dir(spark, "surfaces"), buckets=4)
    wanted = tables.write_bucketed(located.select("pass_id", "dest_y", "dest_x"), scratch_dir(spark, "passes"), buckets=4)
    found = surfaces.stored_pixel(stored, wanted)
    got = {r.pass_id: r.p for r in found.collect()}
    want = {r.pass_id: r.p for r in channels.values_at_destination(located, 3).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in got)
    joined = stored.hint("merge").join(wanted, "pass_id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in joined and "Exchange" not in joined


def test_surfaces_of_one_cell_are_written_small_and_unshuffled(spark, handmade):
    first = jobs.prepare(handmade).where("pass_id = 1").drop("pass_id")
    located = first.crossJoin(spark.range(60).withColumnRenamed("id", "pass_id"))
    coefficients = [0.0, 0.0, -0.03, -0.01, 0.5, 0.0, 0.25] + [0.0] * 10
    scored = surfaces.linear_surfaces(tables.by_game(located), coefficients, 0.5, keys=("pass_id", "game_id"))
    path = scratch_dir(spark, "surfaces")
    tables.write_surfaces(scored, path)
    stored = spark.read.parquet(path)
    sizes = [f.stat().st_size for f in pathlib.Path(path).rglob("*.parquet")]
    assert len(sizes) <= 4 and sum(sizes) < 60 * 7072 * 4 / 10
    assert sorted(map(tuple, stored.select("pass_id", "surface").collect())) == sorted(map(tuple, scored.select("pass_id", "surface").collect()))
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_stored_surfaces_are_neither_sorted_nor_shuffled(spark, handmade):
    located = jobs.prepare(handmade)
    laid = located.repartition(4, "pass_id").sortWithinPartitions("ball_y", "ball_x")
    scored = surfaces.linear_surfaces(laid, [0.0, 0.0, 1.0] + [0.0] * 14, 0.0, head="none").select("pass_id", "surface")
    stored = tables.write_bucketed(scored, scratch_dir(spark, "surfaces"), buckets=4, laid=True, ordered=False, packed=True)
    wanted = tables.write_bucketed(located.select("pass_id", "dest_y", "dest_x"), scratch_dir(spark, "passes"), buckets=4)
    found = surfaces.stored_pixel(stored, wanted)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Exchange" not in plan and "Sort " not in plan
    want = {r.pass_id: r.p for r in channels.values_at_destination(located, 3).collect()}
    got = {r.pass_id: r.p for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in got)


def test_channels_of_the_ball_are_made_once_per_ball_cell(spark, handmade, monkeypatch):
    asked, cells = {}, channels.dense_cells
    monkeypatch.setattr(channels, "dense_cells", lambda passes, numbers, pitch: asked.update({numbers: passes.count()}) or cells(passes, numbers, pitch))
    many = handmade.crossJoin(spark.range(5).withColumnRenamed("id", "again")).withColumn("pass_id", F.expr("10 * pass_id + again")).drop("again")
    many = many.withColumn("ball_x_start", F.expr("if(pass_id = 13, cast('NaN' as double), ball_x_start)"))
    located = jobs.prepare(many.select(handmade.columns))
    totals = {"n": lambda v, cell: F.count("*"), "s": lambda v, cell: F.sum(F.floor(v.cast("double") * 1e6)), "w": lambda v, cell: F.sum(F.floor(v.cast("double") * 1e6) * cell)}
    found = sorted(map(str, channels.channel_totals(located, totals).collect()))
    assert asked == {channels.FIELDS: located.select("ball_y", "ball_x").distinct().count(), channels.COUNTED: located.count()}
    assert asked[channels.FIELDS] < asked[channels.COUNTED]
    stack = channels.channel_stack(located).withColumn("cell", F.expr("y * 104 + x"))
    want = stack.groupBy("pass_id", "channel").agg(*[t(F.col("value"), F.col("cell")).alias(n) for n, t in totals.items()])
    assert found == sorted(map(str, want.collect()))


@pytest.mark.parametrize("number", channels.DENSE)
def test_sums_of_a_dense_channel_need_no_row_per_cell(handmade, number):
    located = prepare(handmade)
    lost = located.where("pass_id = 1").withColumn("pass_id", F.lit(9).cast("bigint"))
    lost = lost.withColumns({c: F.lit(None).cast("int") for c in ("ball_y", "ball_x", "ball_step")})
    located = located.unionByName(lost)
    one = lambda c: F.lit(1).cast("bigint")
    floored = lambda v: F.floor(v * 1e6)
    found = channels.channel_sums(located, number, {"n": (one, one), "s": (floored, one), "w": (floored, lambda c: (c + 1).cast("bigint"))})
    v, cell = F.floor(F.col("value") * 1e6), (F.col("y") * 104 + F.col("x") + 1).cast("bigint")
    cells = channels.channel(located, number).groupBy("pass_id")
    want = cells.agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * cell).alias("w"))
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    assert found.count() == 5


def test_a_stack_is_reduced_where_it_is_made(handmade):
    located = prepare(handmade)

    def sums(stacks):
        return [pa.array(np.nan_to_num(stacks).astype(np.float64).sum(axis=(1, 2, 3)))]

    found = {r.pass_id: r.total for r in channels.dense_row(located, fold=sums, fields="total double").collect()}
    want = {r.pass_id: np.nan_to_num(np.array(r.stack, dtype=np.float32)).astype(np.float64).sum() for r in channels.dense_row(located).collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize(("chosen", "k"), [((1, 2, 13, 14, 15), 5), ((3, 10), 3), ((1, 8), 1)])
def test_rasters_are_convolved_where_they_are_made(spark, handmade, chosen, k):
    located = prepare(handmade)
    i, n = F.col("id"), len(chosen)
    taps = [(F.floor(i / (n * k * k)), "out_ch"), (F.floor(i / (k * k)) % n, "in_ch"), (F.floor(i / k) % k, "dy"), (i % k, "dx")]
    weights = spark.range(2 * n * k * k).select(*[c.cast("int").alias(name) for c, name in taps], ((i * 5 % 9 - 4) / F.lit(8.0)).alias("w"))
    bias = spark.range(2).select(i.cast("int").alias("out_ch"), (i + F.lit(0.25)).alias("b"))
    found = row_raster.convolved_rows(located, chosen, weights, bias)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = row_raster.focal_conv(row_raster.raster_rows(located, chosen), weights, bias, 68, 104)
    key = lambda rows: [r.planes for r in sorted(rows, key=lambda r: (r.pass_id, r.y))]
    assert np.allclose(np.array(key(found.collect())), np.array(key(want.collect())), atol=1e-9)
    assert found.count() == want.count()


def test_planes_are_reduced_where_they_are_made(handmade, monkeypatch):
    """Each plane's own sum is that of the whole stack, and planes of the ball's cell are made once per ball cell."""
    located = jobs.prepare(handmade)
    twice = located.unionByName(located.withColumn("pass_id", F.col("pass_id") + 100))

    def sums(planes):
        return np.nan_to_num(planes.astype(np.float64)).reshape(len(planes), -1).sum(axis=1)

    got = {r.pass_id: r.sums for r in channels.dense_row(twice, fields="sums array<double>", by_plane=sums).collect()}
    want = {r.pass_id: [np.nan_to_num(np.array(p, dtype=np.float32)).astype(np.float64).sum() for p in r.stack] for r in channels.dense_row(twice).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-12, atol=1e-12) for k in got)
    batch = channels.tensor_input(twice, "pass_id").toArrow().combine_chunks().to_batches()[0]
    asked, make = [], channels.raster_batch
    monkeypatch.setattr(channels, "raster_batch", lambda part, pitch, numbers: asked.append((numbers, part.num_rows)) or make(part, pitch, numbers))
    numbers = channels._plane_numbers(sums, Pitch())
    found = [numbers(batch.slice(start, 3)) for start in range(0, batch.num_rows, 3)]
    assert np.allclose(np.concatenate(found), [want[k] for k in batch.column("pass_id").to_pylist()], rtol=1e-12, atol=1e-12)
    balls = set(zip(batch.column("ball_y").to_pylist(), batch.column("ball_x").to_pylist(), strict=True))
    assert sum(n for numbers, n in asked if set(numbers) & set(channels.FIELDS)) == len(balls) < batch.num_rows


def test_counts_ahead_are_those_of_the_players(handmade):
    located = jobs.prepare(handmade)
    batch = channels.tensor_input(located, "pass_id").toArrow().combine_chunks().to_batches()[0]
    planes = channels.raster_batch(batch, Pitch(), channels.COUNTED)
    y, x = np.mgrid[0:68, 0:104]
    step = ((2 * y + 1 - 2 * Pitch().goal_y) ** 2 + (2 * x + 1 - 2 * Pitch().goal_x) ** 2 - 2) // 8
    for i, row in enumerate(batch.to_pylist()):
        for c, side in enumerate(("att", "def")):
            want = sum((step <= p["step"]).astype(int) for p in row[side] if p["step"] <= row["ball_step"])
            np.testing.assert_array_equal(planes[i, c], want + np.zeros_like(step))
