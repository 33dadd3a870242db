"""Checks, passer lookup, game files and the stream."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import PASSES
from turfgrid.operators import channels, slots, validate
from turfgrid.plans.jobs import prepare
from turfgrid.session import scratch_dir
from turfgrid.sources import fixture, games, tables
from turfgrid.streaming import passes as streaming


def _pass(pass_id, game, player, outcome="C", end=(1.0, 1.0), order=(11, 12)):
    seats = [(i + 1, who, 1, float(i), 0.0, float(i + 1), -float(i)) for i, who in enumerate(order)]
    return (pass_id, game, 1, player, outcome, 0.0, 0.0, *end, seats)


def test_checks(spark):
    rows = [_pass(1, 1, 11), _pass(2, 1, 11, None), _pass(3, 1, 11, "Z"), _pass(4, 1, 11, "D", (None, 1.0)), _pass(5, 1, 11, "S", (float("nan"), 1.0))]
    passes = spark.createDataFrame(rows, PASSES)
    assert [r.pass_id for r in validate.accepted(passes).collect()] == [1]
    reasons = {r.pass_id: r.reject_reason for r in validate.rejected(passes).collect()}
    assert reasons == {2: "no_outcome", 3: "unknown_outcome", 4: "no_destination", 5: "no_destination"}
    with pytest.raises(Exception, match="Invalid pass_outcome_type: Z"):
        validate.require_valid(passes.where("pass_id < 4")).collect()
    with pytest.raises(Exception, match="End coordinates not known"):
        validate.require_valid(passes.where("pass_id in (1, 4)")).collect()


def test_passer_by_row_and_by_game(spark):
    # the players swap seats in pass 2; over the whole game, 12 is first seen in seat 1
    passes = spark.createDataFrame([_pass(1, 1, 12), _pass(2, 1, 12, order=(12, 11)), _pass(3, 2, 12), _pass(4, 2, 77)], PASSES)
    by_row = {r.pass_id: r.carrier_slot for r in slots.resolve_passer(passes).collect()}
    by_game = {r.pass_id: r.carrier_slot for r in slots.resolve_passer_by_game(passes, salts=3).collect()}
    assert by_row == {1: 2, 2: 1, 3: 2, 4: None}
    assert by_game == {1: 1, 2: 1, 3: 2, 4: None}
    carried = {r.pass_id: (r.carrier_vx, r.carrier_vy) for r in slots.with_carrier(passes, compat=True).collect()}
    assert carried[1] == (1.0, 1.0) and carried[4] == (None, None)


def test_game_files(spark, tmp_path):
    """Different column orders and widths, pandas-style numbers and gaps, and files that are not CSV."""
    seat = lambda k: f"x_player_{k},y_player_{k},vx_player_{k},vy_player_{k},team_id_player_{k},original_pId_player_{k}"
    head = "pass_outcome_type,player_id,team_id,ball_x_start,ball_y_start,ball_x_end,ball_y_end"
    (tmp_path / "final_pass_track_4585.csv").write_text(
        f"{head},{seat(3)},{seat(7)}\nC,5,1,0.5,-1.5,10,11,1,2,3,4,1.0,5.0,6,7,8,9,,\nNA,5,1,0,0,1,1,,,,,,,,,,,,\n"
    )
    (tmp_path / "final_pass_track_17.csv").write_text(f"{seat(1)},remark,{head}\n1,NaN,3,4,2.0,9,hello,D,9,2,1,2,,4\n")
    (tmp_path / "notes.txt").write_text("not,a,game\n")
    found = {(r.game_id, r.pass_outcome_type): r for r in games.scan_passes(spark, str(tmp_path)).collect()}
    assert set(found) == {(4585, "C"), (4585, None), (17, "D")}
    first, other = found[(4585, "C")], found[(17, "D")]
    assert (first.player_id, first.team_id, first.ball_y_start, first.ball_x_end) == (5, 1, -1.5, 10.0)
    seats = {s.slot: s for s in first.slots}
    assert (seats[3].orig_id, seats[3].slot_team, seats[3].vy) == (5, 1, 4.0)
    assert seats[7].slot_team is None and seats[7].x == 6.0
    assert other.ball_x_end is None and [s.orig_id for s in other.slots if s.orig_id] == [9]
    sizes = {r.game_id: r.n for r in games.source_stats(spark, str(tmp_path)).collect()}
    assert sizes == {4585: 2, 17: 1}
    one = games.scan_game(spark, str(tmp_path / "final_pass_track_17.csv")).collect()
    assert [r.game_id for r in one] == [17]


HEAD = "pass_outcome_type,player_id,team_id,ball_x_start,ball_y_start,ball_x_end,ball_y_end"


def test_game_files_that_do_not_fit(spark, tmp_path):
    (tmp_path / "one_1.csv").write_text(f"{HEAD}\nC,1,1,0,0,1,1\n")
    (tmp_path / "two_2.csv").write_text(HEAD.replace("pass_outcome_type,", "") + "\n1,1,0,0,1,1\n")
    with pytest.raises(ValueError, match="two_2.csv lacks pass_outcome_type"):
        games.scan_passes(spark, str(tmp_path))
    (tmp_path / "nothing").mkdir()
    (tmp_path / "nothing" / "blank_3.csv").write_text("")
    with pytest.raises(ValueError, match="no pass files"):
        games.scan_passes(spark, str(tmp_path / "nothing"))


def test_a_row_may_hold_the_header_text(spark, tmp_path):
    (tmp_path / "one_1.csv").write_text(f'note,{HEAD}\n"pass_outcome_type, they say",C,1,1,0,0,1,1\n')
    (row,) = games.scan_passes(spark, str(tmp_path)).collect()
    assert (row.pass_outcome_type, row.player_id, row.ball_y_end, row.slots) == ("C", 1, 1.0, [])


def test_pass_ids_do_not_depend_on_splits(spark, tmp_path):
    for game in (3, 1):
        (tmp_path / f"game_{game}.csv").write_text(HEAD + "\n" + "".join(f"C,{i},1,0,0,1,{i}\n" for i in range(400)))
    sizes, found = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    try:
        for size in ("128m", "1500b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found.append(sorted((r.pass_id, r.game_id, r.player_id) for r in games.scan_passes(spark, str(tmp_path)).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", sizes)
    assert found[0] == found[1] and len({r[0] for r in found[0]}) == 800
    assert [r[2] for r in found[0]] == [*range(400), *range(400)]


def test_game_is_the_file(spark, tmp_path):
    """Names without a number, and slots in the order of the identity columns of each file."""
    seats = "original_pId_player_2,original_pId_player_1,x_player_1,team_id_player_1,x_player_2,team_id_player_2,vx_player_2,vx_player_1,vy_player_1,vy_player_2"
    (tmp_path / "home.csv").write_text(f"{HEAD},{seats}\nC,7,1,0,0,1,1,7,7,1,1,2,1,5,6,0,0\n")
    (tmp_path / "away.csv").write_text(f"{HEAD},{seats}\nC,7,1,0,0,1,1,9,7,1,1,2,1,5,6,0,0\n")
    passes = games.scan_passes(spark, str(tmp_path))
    found = {r.source_file.rpartition("/")[2]: r for r in slots.resolve_passer_by_game(passes).collect()}
    assert {k: (r.game_id, r.carrier_slot, [s.slot for s in r.slots]) for k, r in found.items()} == {"home.csv": (None, 2, [2, 1]), "away.csv": (None, 1, [2, 1])}


def test_wide_round_trip(handmade):
    back = slots.gather_slots(slots.spread_slots(handmade, list(range(1, 12))))
    key = lambda df: sorted(str(r) for r in slots.unpivot_slots(df).where(F.col("orig_id").isNotNull()).drop("slot_ord").collect())
    assert key(back) == key(handmade)


def test_stream_equals_batch(spark, handmade):
    source, sink, mark = (scratch_dir(spark, name) for name in ("source", "sink", "mark"))
    handmade.repartition(3).write.parquet(source)
    stream = streaming.stream_table(spark, source, handmade.schema, files_per_trigger=1)
    streaming.append_to(streaming.located_stream(stream), sink, mark).awaitTermination()
    rows = lambda located: sorted(str(r) for r in channels.sparse_channels(located).collect())
    assert rows(tables.read_table(spark, sink)) == rows(prepare(handmade))


def test_spread_slots_search_a_list_of_numbers(spark, handmade):
    from turfgrid.operators.slots import spread_slots

    twice = handmade.withColumn("slots", F.expr("concat(slice(slots, 3, 20), slots)"))  # slot 3 and later stand there twice: the first counts
    odd = twice.withColumn("slots", F.expr("if(pass_id = 4, null, transform(slots, (s, i) -> if(i = 1, null, s)))"))
    wide = spread_slots(odd, [5, 1, 77])
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lambda slots") <= 1 and "filter(slots" not in plan
    for r, w in zip(odd.orderBy("pass_id").collect(), wide.orderBy("pass_id").collect(), strict=True):
        for n in (5, 1, 77):
            own = next((s for s in r.slots or [] if s and s.slot == n), None)
            assert repr([w[f"x_player_{n}"], w[f"vy_player_{n}"], w[f"original_pId_player_{n}"]]) == repr([own.x, own.vy, own.orig_id] if own else [None] * 3)


def test_slots_of_the_fixture_are_those_of_its_rules(spark):
    ids = spark.createDataFrame([(None,), (-37,), (0,), (7,), (29,), (35_000_005,), (1 << 40,)], "event_id bigint")
    fields = ", ".join(
        f"'{n}', cast({sql} as {'bigint' if n in ('slot', 'orig_id', 'slot_team') else 'double'})" for n, sql in fixture.slot_fields("event_id", "k").items()
    )
    want = ids.select(F.expr(f"transform(sequence(1L, {fixture.SLOTS}L), k -> named_struct({fields}))").alias("slots"))
    found = fixture.passes_from_ids(ids)
    assert [r.slots for r in found.collect()] == [r.slots for r in want.collect()]
    # neither the slots nor the passer are worked out by a function of each slot
    plan = slots.attach_carrier(slots.resolve_passer(found)).select("carrier_vx")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


def test_passes_stay_where_they_are_when_a_game_is_searched(spark):
    passes = spark.createDataFrame([_pass(i, i % 3, 11 + i % 2) for i in range(1, 41)], PASSES)
    near, far = (slots.resolve_passer_by_game(passes.repartition(4, "pass_id"), max_broadcast=n) for n in (100, 0))
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    assert sorted((r.pass_id, r.carrier_slot) for r in near.collect()) == sorted((r.pass_id, r.carrier_slot) for r in far.collect())


def test_players_of_odd_passes(spark):
    """No slots, none of a team, positions missing, infinite and off the pitch, velocities missing."""
    nan, inf = float("nan"), float("inf")
    seats = [(1, 1, 1, 0.0, 0.0, nan, 1.0), (2, 2, None, 1.0, 1.0, 1.0, 1.0), None, (3, 3, 1, inf, -inf, None, 2.0), (4, 4, 2, nan, 0.0, 1.0, 1.0), (5, 5, 2, 0.0, None, 1.0, 1.0), (6, 6, 2, 99.0, 99.0, 3.0, 4.0)]
    ends = ("C", 0.0, 0.0, 1.0, 1.0)
    rows = [(1, 1, 1, 1, *ends, seats), (2, 1, None, 1, *ends, seats), (3, 1, 1, 1, *ends, []), (4, 1, 1, 1, *ends, None)]
    found = {r.pass_id: r for r in prepare(spark.createDataFrame(rows, PASSES)).collect()}
    places = lambda players: [(p.cell // 104, p.cell % 104) for p in players]
    assert places(found[1].att) == [(34, 52), (0, 103)] and places(found[1]["def"]) == [(67, 103)]
    assert found[2].att == [] and places(found[2]["def"]) == [(34, 52), (0, 103), (67, 103)]
    assert found[1].att[1].vx is None and found[1].att[0].vx != found[1].att[0].vx and found[1].att[1].vy == 2.0
    assert (found[3].att, found[3]["def"], found[3].n_att) == ([], [], 0) and found[4].att is None and found[4]["def"] is None
    assert found[1].att[1].step == ((2 * 103 + 1 - 2 * 103) ** 2 + (1 - 2 * 34) ** 2 - 2) // 8


def test_lines_of_game_files_are_not_shuffled(spark, tmp_path):
    """Files in several splits, with empty lines between; every pass has its row and no line goes to another task."""
    header = ",".join([*games.PASS_COLUMNS, "original_pId_player_1", "team_id_player_1", "x_player_1", "y_player_1"])
    for name, n in (("1", 3000), ("2", 17)):
        lines = [header, ""] + [f"C,{i},1,{i % 50}.5,0,1,1,{i},1,2.0,3.0" + ("\n" if i % 7 == 0 else "") for i in range(n)]
        (tmp_path / f"{name}.csv").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        scan = games.scan_passes(spark, str(tmp_path))
        assert "Exchange hashpartitioning" not in scan._jdf.queryExecution().executedPlan().toString()
        found = {(r.game_id, r.player_id): r.pass_id for r in scan.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == {(f, i): (f - 1 << 36) + i for f, n in ((1, 3000), (2, 17)) for i in range(n)}


def test_lines_are_read_by_the_batch(spark, tmp_path):
    """Numbers of any spelling come out as `try_cast` has them, in files of different headers, and no expression for each slot is left in the plan."""
    texts = ["1", " -7.5 ", "+5", "1.", ".5", "1e400", "-1e400", "1e-400", "1d", "2.5F", "0x1p3", "-0x.8P1d", "0x1p5000", "Inf", "-infinity", "+NaN", "NaN", "abc", "1_0", "1e", "٣", "9223372036854775807", "-9223372036854775808", "1e19", "-0.0", "#N/A", "", "2.9", "-2.9"]
    seats = "original_pId_player_1,team_id_player_1,x_player_1,y_player_1,vx_player_1,vy_player_1"
    for name, header, line in (("1", f"{HEAD},{seats}", "C,{0},{0},{0},0,1,1,{0},{0},{0},2,3,4"), ("2", f"{seats},{HEAD},original_pId_player_2", "{0},{0},{0},2,3,4,C,{0},{0},{0},0,1,1,6")):
        (tmp_path / f"{name}.csv").write_text("\n".join([header, *(line.format(t) for t in texts)]))
    scan = games.scan_passes(spark, str(tmp_path))
    plan = scan._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "array_sort" not in plan and plan.count("cast(") < 20
    rows = spark.createDataFrame([(i, None if t.strip() in games.MISSING_TEXTS else t.strip()) for i, t in enumerate(texts)], "i int, t string")
    want = {r.i: r for r in rows.selectExpr("i", "try_cast(t as double) d", "try_cast(try_cast(t as double) as bigint) n").collect()}
    found = {(r.game_id, r.pass_id % (1 << 36)): r for r in scan.collect()}
    assert len(found) == 2 * len(texts)
    for (game, i), r in found.items():
        assert [s.slot for s in r.slots] == [1, 2][:game] and r.pass_outcome_type == "C"
        one = r.slots[0]
        assert repr((r.ball_x_start, one.x)) == repr((want[i].d,) * 2), texts[i]
        assert (r.player_id, r.team_id, one.orig_id, one.slot_team) == (want[i].n,) * 4, texts[i]
        assert (one.y, one.vx, one.vy, r.ball_y_end) == (2.0, 3.0, 4.0, 1.0)
        assert game == 1 or (r.slots[1].orig_id, r.slots[1].x) == (6, None)
