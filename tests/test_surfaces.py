"""Raster operators, the network in both forms, fitted models and registered queries."""

import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from turfgrid import Pitch
from turfgrid.constants import CHANNELS
from turfgrid.operators import channels, fit, raster, row_raster, surfaces
from turfgrid.operators.splits import split
from turfgrid.plans import jobs
from turfgrid.session import scratch_dir
from turfgrid.sources import tables

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402

SMALL = Pitch(20, 24)


@pytest.fixture(scope="module")
def plane(spark):
    cells = spark.range(3 * 6 * 8).selectExpr("id div 48 pass_id", "0 ch", "int(id % 48 div 8) y", "int(id % 8) x", "double(id * 37 % 101 - 50) value")
    return raster.by_pass(cells, 4).cache()


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_identities(spark, plane):
    assert rows(raster.max_pool(raster.upsample(plane), 12, 16)) == rows(plane)
    centre = spark.createDataFrame([(0, 0, 1, 1, 1.0)], "out_ch int, in_ch int, dy int, dx int, w double")
    none = spark.createDataFrame([(0, 0.0)], "out_ch int, b double")
    inner = plane.where("y between 1 and 4 and x between 1 and 6").withColumns({"y": F.col("y") - 1, "x": F.col("x") - 1})
    assert rows(raster.focal_conv(plane, centre, none, 6, 8, 3)) == rows(inner)
    padded = raster.replicate_pad(plane, 6, 8, 2)
    assert padded.count() == 3 * 10 * 12
    want = {(r.pass_id, r.y, r.x): r.value for r in plane.collect()}
    for r in padded.collect():
        assert r.value == want[(r.pass_id, min(max(r.y - 2, 0), 5), min(max(r.x - 2, 0), 7))]
    assert rows(raster.fuse(plane, plane, 1.0, -1.0, 0.5).select("value").distinct()) == [(0.5,)]


def test_raster_chain_shuffles_once(spark, plane):
    weights, bias = surfaces.made_up_weights(spark, (("a", 2, 1, 3), ("b", 1, 2, 1)))
    laid_out = raster.by_pass(plane, 4)
    first = raster.relu(raster.focal_conv(laid_out, weights.where("layer = 'a'"), bias.where("layer = 'a'"), 6, 8, 3))
    pooled = raster.max_pool(raster.replicate_pad(first, 4, 6, 1), 6, 8)
    chain = raster.pointwise(pooled, weights.where("layer = 'b'"), bias.where("layer = 'b'"), 3, 4)
    plan = chain._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_network_on_arrays_equals_network_on_tables(spark, handmade):
    widths = (len(CHANNELS), 2, 3)
    layers = []
    for name, out_ch, in_ch, k in surfaces.NETWORK:
        narrow = {32: widths[1], 64: widths[2]}
        layers.append((name, narrow.get(out_ch, out_ch), narrow.get(in_ch, in_ch), k))
    weights, bias = surfaces.made_up_weights(spark, layers)
    weights, bias = weights.cache(), bias.cache()
    located = jobs.prepare(handmade.where("pass_id in (1, 2)"), SMALL)
    scored = surfaces.score_surfaces(located, weights, bias, "none", SMALL)
    arrays = {r.pass_id: np.array(r.surface) for r in scored.collect()}
    wide = channels.stack_cells(located, SMALL)
    stack = wide.selectExpr("pass_id", "y", "x", f"inline(array({', '.join(f'struct({c - 1} ch, double(float(c{c})) value)' for c in range(1, 18))}))")
    stack = raster.by_pass(stack, 4).cache()
    table = jobs.network_on_tables(stack, weights, bias, SMALL).toPandas()
    for pass_id, surface in arrays.items():
        mine = table[table["pass_id"] == pass_id].sort_values(["y", "x"])["value"].to_numpy()
        assert len(mine) == SMALL.cells
        np.testing.assert_allclose(surface, mine, rtol=1e-3, atol=1e-3)
    shares = surfaces.score_surfaces(located, weights, bias, "softmax", SMALL).collect()
    assert all(abs(sum(r.surface) - 1) < 1e-3 for r in shares)


def test_linear_surface_and_its_pixel(handmade):
    located = jobs.prepare(handmade)
    w = [0.3, -0.2, -0.03, -0.01, 0.5, 0.1, 0.25, 0.02, 0.01, 0.1, -0.1, 0.05, 0.01, 0.02, 0.03, 0.04, 0.001]
    for head in ("sigmoid", "softmax"):
        stored = surfaces.surface_pixel(surfaces.linear_surfaces(located, w, 0.0, head))
        here = jobs.predict_destination(located, fit.SurfaceModel(head, w, 0.0))
        a = {r.pass_id: r.p for r in stored.collect()}
        b = {r.pass_id: r.p for r in here.collect()}
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-5 * max(1e-3, b[k]) + 1e-7 for k in a)
        long = surfaces.unpack_surfaces(stored)
        picked = {r.pass_id: r.p for r in surfaces.pixel(long, located).collect()}
        assert all(abs(picked[k] - a[k]) < 1e-9 for k in a)


def test_selection_fit_lowers_its_loss(spark, handmade):
    located = jobs.prepare(split(handmade, exact=False).withColumn("split", F.lit("train")), SMALL)
    model = fit.fit_selection(located, epochs=4, pitch=SMALL)
    losses = [loss for _, loss, _ in model.history]
    assert abs(losses[0] - np.log(SMALL.cells)) < 1e-9
    assert losses == sorted(losses, reverse=True)


def _normal(frame):
    frame = frame[sorted(frame.columns)]
    frame = frame.astype({c: "float64" for c in frame.columns if frame[c].dtype.kind in "iufb"})
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize(
    "name",
    [
        "completion_by_destination", "f3_rejects", "j1_resolve_passer_by_game", "c6_sine_ball_goal", "c10_attackers_outplayed",
        "c15_defender_vx_compat", "a3_outplayed", "a9_class_report", "w4_split", "w6_batches", "r1_focal_conv", "r12_evaluate", "a1_nan_channels_gappy", "j4_stored_pixel",
        "c8_ball_speed_x", "c9_ball_speed_y_compat", "c12_carrier_speed", "s4_pick_pass", "r6_pointwise_channels", "r10_success_gradient",
    ],
)
def test_registered_query_equals_its_oracle(spark, name):
    db = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        db.sql(f"create view {file.stem} as select * from '{file}'")
    got, want = entry.queries()[name](spark, SF).toPandas(), db.sql(entry.oracle_sql()[name]).df()
    pd.testing.assert_frame_equal(_normal(got), _normal(want), check_dtype=False, rtol=0, atol=0)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_softmax_means_of_far_apart_logits(spark):
    z = [[-900.0, -300.0, 0.0, 511.9], [5000.0, 4999.0, -5000.0, 256.0], [-2000.0, -2001.0, -2000.5, -3000.0]]
    rows = [(i, zi, float(k)) for i, line in enumerate(z) for k, zi in enumerate(line)]
    cells = spark.createDataFrame(rows, "pass_id int, z double, v double")
    for r in surfaces.softmax_means(cells, ["pass_id"], F.col("z"), {"v": F.col("v")}).collect():
        line = np.array(z[r.pass_id])
        share = np.exp(line - line.max())
        assert np.isclose(r.log_total, line.max() + np.log(share.sum())) and np.isclose(r.v, (share @ np.arange(4)) / share.sum())


def test_models_are_stored_as_tables(spark):
    path = scratch_dir(spark, "model")
    model = fit.SurfaceModel("softmax", [0.5] * 17, -1.0, [(0, 1.5, None), (1, 1.25, 1.0)])
    model.write(spark, path)
    assert fit.SurfaceModel.read(spark, path) == model


def test_one_dense_channel_has_no_expand(handmade, capsys):
    channels.channel(jobs.prepare(handmade), 3).explain()
    assert "Expand" not in capsys.readouterr().out


def test_row_rasters_equal_the_long_form(spark, handmade):
    located = jobs.prepare(handmade, SMALL)
    numbers = (1, 3, 10, 13)
    rows = row_raster.by_pass(row_raster.raster_rows(located, numbers, SMALL), 4).cache()
    wide = channels.stack_cells(located, SMALL).na.fill(0.0)
    lines = ", ".join(f"struct({i} ch, double(float(c{c})) value)" for i, c in enumerate(numbers))
    long = wide.selectExpr("pass_id", "y", "x", f"inline(array({lines}))").select("pass_id", "ch", "y", "x", "value").cache()
    key = lambda df: sorted((r.pass_id, r.ch, r.y, r.x, round(r.value, 9)) for r in df.collect())
    assert key(row_raster.by_cells(rows)) == key(long) == key(row_raster.by_cells(row_raster.by_rows(long, SMALL.cols, 4)))
    for k, out_ch in ((5, 2), (3, 3), (1, 2)):
        weights, bias = surfaces.made_up_weights(spark, (("a", out_ch, 4, k),))
        got = row_raster.focal_conv(rows, weights.drop("layer"), bias.drop("layer"), SMALL.rows, SMALL.cols)
        assert key(row_raster.by_cells(got)) == key(raster.focal_conv(long, weights, bias, SMALL.rows, SMALL.cols, k))
        padded = row_raster.replicate_pad(row_raster.relu(got), SMALL.rows - k + 1, k // 2)
        want = raster.replicate_pad(raster.relu(raster.focal_conv(long, weights, bias, SMALL.rows, SMALL.cols, k)), SMALL.rows - k + 1, SMALL.cols - k + 1, k // 2)
        assert key(row_raster.by_cells(padded)) == key(want)


def test_row_rasters_do_not_multiply_by_the_kernel(spark, handmade):
    """A chain of two kernels on rows laid out by pass: one shuffle between them, and no row per tap."""
    laid = row_raster.by_pass(row_raster.raster_rows(jobs.prepare(handmade, SMALL), (1, 2, 3), SMALL), 4)
    one, two = (surfaces.made_up_weights(spark, (("a", n, m, 5),)) for n, m in ((2, 3), (1, 2)))
    first = row_raster.replicate_pad(row_raster.relu(row_raster.focal_conv(laid, *one, SMALL.rows, SMALL.cols)), SMALL.rows - 4, 2)
    second = row_raster.focal_conv(first, *two, SMALL.rows, SMALL.cols)
    plan = second._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ENSURE_REQUIREMENTS") == 1 and "Join" not in plan and "Aggregate" not in plan
    assert second.count() == 4 * (SMALL.rows - 4)


def test_large_kernels_are_refused(spark, monkeypatch):
    monkeypatch.setattr(row_raster, "MAX_TAPS", 3)
    weights, bias = surfaces.made_up_weights(spark, (("a", 1, 1, 3),))
    with pytest.raises(ValueError, match="taps"):
        row_raster.load_kernel(weights, bias)


@pytest.mark.parametrize("shape", [(9, 12, 3, 2), (5, 5, 1, 4), (17, 26, 6, 5), (32, 5, 2, 1), (68, 104, 4, 3)])
def test_tiles_are_the_convolution(shape):
    """Sizes that are no multiple of a tile, several passes, and few tiles at once; in doubles the two ways agree to the last digits."""
    rows, cols, in_ch, out_ch = shape
    draw = np.random.default_rng(1)
    planes, kernel, bias = draw.normal(size=(3, rows, cols, in_ch)), draw.normal(size=(out_ch, in_ch, 5, 5)), draw.normal(size=out_ch)
    want = np.stack([sum(np.einsum("rci,oi->rco", p[dy : dy + rows - 4, dx : dx + cols - 4], kernel[:, :, dy, dx]) for dy in range(5) for dx in range(5)) for p in planes]) + bias
    np.testing.assert_allclose(surfaces._convolve(planes, kernel, bias), want, rtol=1e-10, atol=1e-10)
    np.testing.assert_allclose(surfaces._convolve_tiles(planes, surfaces._tiled(kernel), bias, 5), want, rtol=1e-10, atol=1e-10)


def test_network_goes_by_tiles(monkeypatch):
    """The large kernels of the network are not gone through tap by tap, and a missing value reaches the cells that it reaches tap by tap."""
    draw = np.random.default_rng(2)
    net = {name: (draw.normal(size=(o, i, k, k)).astype(np.float32) / (k * i**0.5), draw.normal(size=o).astype(np.float32)) for name, o, i, k in surfaces.NETWORK}
    stacks = draw.normal(size=(3, len(CHANNELS), Pitch().rows, Pitch().cols)).astype(np.float32)
    stacks[1, 7, 3, 4] = np.nan
    taken, convolve = [], surfaces._convolve
    monkeypatch.setattr(surfaces, "_convolve", lambda planes, kernel, bias: taken.append((kernel.shape[2], len(planes))) or convolve(planes, kernel, bias))
    got = surfaces.network_logits(stacks, surfaces.tile_network(net))
    assert {n for k, n in taken if k == 5} == {1}  # the pass with a missing value
    singly = surfaces.network_logits(stacks, {name: (*layer, None) for name, layer in net.items()})
    assert 0 < np.isnan(got[1]).sum() < Pitch().cells and not np.isnan(got[[0, 2]]).any()
    np.testing.assert_array_equal(np.isnan(got), np.isnan(singly))
    np.testing.assert_allclose(got, singly, rtol=1e-3, atol=1e-3)


@pytest.mark.parametrize("w", [[0.0, 0.0, -0.03, -0.01, 0.5, 0.0, 0.25] + [0.0] * 10, [0.3, -0.2, -0.03, 0.0, 0.5, 0.1, 0.25, 0.02, 0.0, 0.1, 0.0, 0.05, 0.01, 0.02, 0.03, 0.04, 0.001], [0.0] * 17], ids=["fields", "most", "none"])
def test_linear_surfaces_are_sums_of_the_stack(handmade, monkeypatch, w):
    """Channels without a coefficient are not made, and those of the ball's cell once per ball cell; a missing value counts as 0."""
    located = jobs.prepare(handmade)
    twice = located.unionByName(located.withColumn("pass_id", F.col("pass_id") + 100)).coalesce(1).sortWithinPartitions("ball_y", "ball_x")
    batch = channels.tensor_input(twice, "pass_id").toArrow().combine_chunks().to_batches()[0]
    stacks = np.nan_to_num(channels.raster_batch(batch, Pitch()))
    asked, make = [], surfaces.raster_batch
    monkeypatch.setattr(surfaces, "raster_batch", lambda part, pitch, numbers: asked.append((tuple(numbers), part.num_rows)) or make(part, pitch, numbers))
    for head in ("none", "sigmoid", "softmax"):
        want = surfaces._head(np.tensordot(np.array(w), stacks, (0, 1)) + 0.5, head)
        linear = surfaces._Linear(w, 0.5, head, Pitch())
        for _ in range(2):
            np.testing.assert_allclose(linear.surfaces(batch).reshape(want.shape), want, rtol=1e-6, atol=1e-12)
    balls = len(set(zip(batch.column("ball_y").to_pylist(), batch.column("ball_x").to_pylist(), strict=True)))
    by_ball = [n for numbers, n in asked if numbers and set(numbers) <= set(channels.FIELDS)]
    assert by_ball == [balls] * (3 if any(w) else 0)
    assert {c for numbers, _ in asked for c in numbers} == {c for c in range(1, 18) if w[c - 1]}


def test_surfaces_are_stored_without_a_wrap_per_number(spark, handmade, tmp_path):
    scored = surfaces.linear_surfaces(tables.by_game(jobs.prepare(handmade)), [0.0, 0.0, 1.0] + [0.0] * 14, 0.0, head="none", keys=("pass_id", "game_id"))
    tables.write_surfaces(scored, str(tmp_path / "surfaces"))
    for file in (tmp_path / "surfaces").rglob("*.parquet"):
        assert pq.ParquetFile(file).schema.column(pq.ParquetFile(file).schema.names.index("array")).max_definition_level <= 2
    assert spark.conf.get("spark.sql.parquet.writeLegacyFormat") == "false"
    assert spark.read.parquet(str(tmp_path / "surfaces")).selectExpr("size(surface)").distinct().collect() == [(7072,)]
