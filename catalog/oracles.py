"""SQL for each registered query that SQL can express, written from the definitions.

The statements share the fixture rules and the located passes; everything else is stated afresh, in
plain joins and comparisons, so that it does not repeat the shortcuts of the Spark side.
"""

from __future__ import annotations

from turfgrid.sources.fixture import pass_fields, slot_fields


def _list(fields: dict[str, str]) -> str:
    return ", ".join(f"{sql} {name}" for name, sql in fields.items())


def D(number) -> str:
    """A DOUBLE literal; a bare decimal literal would be DECIMAL."""
    return f"cast({number} as double)"


def cell_x(v: str) -> str:
    return f"cast(floor(least(greatest(({v} + {D(52.5)}) / {D(105)} * {D(104)}, {D(0)}), {D(103)})) as integer)"


def cell_y(v: str) -> str:
    return f"cast(floor(least(greatest(({v} + {D(34)}) / {D(68)} * {D(68)}, {D(0)}), {D(67)})) as integer)"


def fixture(table: str, key: str) -> str:
    return f"""slots as (select unnest(range(1, 23)) k),
passes as materialized (select {_list(pass_fields(f"e.{key}"))} from {table} e),
track as materialized (select e.{key} pass_id, e.{key} % 16 game_id, {_list(slot_fields(f"e.{key}", "k"))} from {table} e cross join slots)"""


FIXTURE = fixture("events", "event_id")

OK = """ok as materialized (select * from passes where pass_outcome_type in ('C', 'D', 'B', 'O', 'S', 'G', 'I')
 and ball_x_end is not null and ball_y_end is not null)"""

# the passer's first slot on the row of the pass
CARRIED = """carried as materialized (select p.pass_id, min(t.slot) carrier_slot, arg_min(t.vx, t.slot) carrier_vx, arg_min(t.vy, t.slot) carrier_vy,
 sqrt(arg_min(t.vx, t.slot) * arg_min(t.vx, t.slot) + arg_min(t.vy, t.slot) * arg_min(t.vy, t.slot)) carrier_speed
 from passes p left join track t on t.pass_id = p.pass_id and t.orig_id = p.player_id group by p.pass_id)"""

# the passer's first slot over the whole game; vx stands for vy
FIRST_SLOT = """named as materialized (select * from passes where pass_outcome_type is not null),
first_slot as materialized (select t.game_id, t.orig_id, min(t.slot) slot from track t join named p on p.pass_id = t.pass_id group by 1, 2)"""
CARRIED_COMPAT = f"""{FIRST_SLOT},
sought as materialized (select p.pass_id, f.slot from named p left join first_slot f on f.game_id = p.game_id and f.orig_id = p.player_id),
carried as materialized (select s.pass_id, s.slot carrier_slot, t.vx carrier_vx, t.vx carrier_vy, sqrt(t.vx*t.vx + t.vy*t.vy) carrier_speed
 from sought s left join track t on t.pass_id = s.pass_id and t.slot = s.slot)"""

_PLACED = f"""located as materialized (select p.*, c.carrier_slot, c.carrier_vx, c.carrier_vy, c.carrier_speed, case when p.pass_outcome_type = 'C' then 1 else 0 end target,
 {cell_x("ball_x_start")} ball_x, {cell_y("ball_y_start")} ball_y, {cell_x("ball_x_end")} dest_x, {cell_y("ball_y_end")} dest_y
 from ok p join carried c on c.pass_id = p.pass_id),
players as (select t.pass_id, t.slot, t.vx, t.vy, case when t.slot_team = p.team_id then 'att' else 'def' end side,
 {cell_x("t.x")} x, {cell_y("t.y")} y from track t join ok p on p.pass_id = t.pass_id where t.slot_team is not null),
numbered as (select *, row_number() over (partition by pass_id, side order by slot) ordinal,
 row_number() over (partition by pass_id, side, y, x order by slot desc) from_last from players)"""
LOCATED = f"{OK}, {CARRIED}, {_PLACED}"
LOCATED_COMPAT = f"{OK}, {CARRIED_COMPAT}, {_PLACED}"

# defenders of the compatible rule: no later than the number of attackers
CUT = """cut as (select n.* exclude (from_last), row_number() over (partition by n.pass_id, n.y, n.x order by n.slot desc) from_last
 from numbered n join (select pass_id, count(*) n_att from players where side = 'att' group by 1) a
 on a.pass_id = n.pass_id where n.side = 'def' and n.ordinal <= a.n_att)"""

GOAL_DISTANCE = f"sqrt((x + {D(0.5)} - 103) * (x + {D(0.5)} - 103) + (y + {D(0.5)} - 34) * (y + {D(0.5)} - 34))"
GRID = f"""cells as (select cast(c // 104 as integer) y, cast(c % 104 as integer) x, c cell from (select unnest(range(0, 7072)) c)),
grid as (select *, {GOAL_DISTANCE} d_goal, abs(atan2(34 - (y + {D(0.5)}), 103 - (x + {D(0.5)}))) a_goal from cells)"""

# players that may count: distinct occupied cells no farther from the goal than the ball; and for each cell the
# number and the number sum of the cells no farther than it
AHEAD = f"""occupied as (select distinct pass_id, side, y, x from players),
ahead as (select o.pass_id, o.side, o.y, o.x, g.d_goal d_player, b.d_goal d_ball from occupied o join located p on p.pass_id = o.pass_id
 join grid g on g.y = o.y and g.x = o.x join grid b on b.y = p.ball_y and b.x = p.ball_x where g.d_goal <= b.d_goal),
reach as (select y, x, count(*) over (order by d_goal) n, sum(cell + 1) over (order by d_goal) w from grid),
pairs as (select a.pass_id, a.side, sum(r.n) n, sum(r.w) w from ahead a join reach r on r.y = a.y and r.x = a.x group by 1, 2)"""

PLANES = """planes as (select vec_id pass_id, 0 ch, cast(i // 8 as integer) y, cast(i % 8 as integer) x, cast(embedding[i + 1] as double) v
 from embeddings, (select unnest(range(0, 64)) i))"""

HISTORY = """history as (select event_type run, cast(datediff('day', date '2024-01-01', cast(ts as date)) as integer) epoch,
 round(max(value), 6) train_loss, round(avg(value), 6) val_loss from events group by 1, 2)"""

PREDICTED = f"""predicted as (select event_id pass_id, event_id // 32 batch_id, event_id % 2 y_true,
 cast(event_id % 1001 as double) / {D(1000)} p from events)"""


def floored_log(p: str) -> str:
    return f"case when {p} <= 0 then {D(-100)} else greatest(ln(case when {p} <= 0 then 1 else {p} end), {D(-100)}) end"


def bce(y: str) -> str:
    return f"-({y} * ({floored_log('p')}) + (1 - {y}) * ({floored_log(f'({D(1)} - p)')}))"


def keyed_hash(seed: int, *keys: str) -> str:
    text = f"'{seed}'" + "".join(f" || ':' || {k}" for k in keys)
    return f"cast('0x' || substr(md5({text}), 1, 12) as bigint)"


def digest(source: str, value: str, keys: str = "pass_id") -> str:
    """Digest over rows of `source` with y and x."""
    v = f"cast(floor(({value}) * {D(1e6)}) as bigint)"
    return (
        f"select {keys}, count(*) n, cast(sum({v}) as bigint) s, cast(sum({v} * (y * 104 + x + 1)) as bigint) w "
        f"from {source} group by {keys}"
    )


def on(*parts: str, select: str) -> str:
    return f"with {', '.join(parts)} {select}"


def six(*names: str) -> str:
    return ", ".join(f"round(cast({n} as double), 6) {n.split('.')[-1]}" for n in names)


BALL_DISTANCE = f"sqrt((x + {D(0.5)} - ball_x) * (x + {D(0.5)} - ball_x) + (y + {D(0.5)} - ball_y) * (y + {D(0.5)} - ball_y))"
_GX, _GY = f"(103 - (x + {D(0.5)}))", f"(34 - (y + {D(0.5)}))"
_BX, _BY = f"(ball_x - (x + {D(0.5)}))", f"(ball_y - (y + {D(0.5)}))"
COSINE = (
    f"least(greatest(({_GX}*{_BX} + {_GY}*{_BY}) / (sqrt({_GX}*{_GX} + {_GY}*{_GY}) * sqrt({_BX}*{_BX} + {_BY}*{_BY})), {D(-1)}), {D(1)})"
)
SINE = f"sqrt({D(1)} - ({COSINE}) * ({COSINE}))"
OVER = "(select l.pass_id, l.ball_x, l.ball_y, g.y, g.x, g.d_goal, g.a_goal from located l cross join grid g)"


def dense(value: str) -> str:
    return on(FIXTURE, LOCATED, GRID, select=digest(OVER, value))


def outplayed_digest(side: str) -> str:
    """A player adds one to every cell that is no farther from the goal than the player."""
    return on(
        FIXTURE, LOCATED, GRID, AHEAD,
        select="select l.pass_id, cast(7072 as bigint) n, cast(coalesce(p.n, 0) * 1000000 as bigint) s, cast(coalesce(p.w, 0) * 1000000 as bigint) w "
        f"from located l left join pairs p on p.pass_id = l.pass_id and p.side = '{side}'",
    )


def occupancy(side: str) -> str:
    return on(FIXTURE, LOCATED, select=f"select distinct pass_id, y, x, {D(1)} \"value\" from players where side = '{side}'")


def at_ball(value: str, compat: bool = False) -> str:
    return on(FIXTURE, LOCATED_COMPAT if compat else LOCATED, select=f'select pass_id, ball_y y, ball_x x, round({value}, 6) "value" from located')


def velocity(side: str, field: str, compat: bool = False) -> str:
    return on(
        FIXTURE, LOCATED, CUT,
        select=f"select pass_id, y, x, round({field}, 6) \"value\" from {'cut' if compat else 'numbered'} where side = '{side}' and from_last = 1",
    )


def _stack(as_tensor: bool, compat: bool = False) -> str:
    """Digest of each channel of each pass with values as FLOAT."""

    def f(v):
        return f"cast(cast({v} as float) as double)"

    micro = lambda v: f"cast(floor({f(v)} * {D(1e6)}) as bigint)"
    cell = "(y * 104 + x + 1)"
    dense_values = {3: "db", 4: "d_goal", 5: "co", 6: "si", 7: "a_goal", 17: "db"}
    sums = ", ".join(f"sum({micro(v)}) s{c}, sum({micro(v)} * {cell}) w{c}" for c, v in dense_values.items())
    over = f"(select *, {BALL_DISTANCE} db, {COSINE} co, {SINE} si from {OVER})"
    parts = [
        FIXTURE, LOCATED_COMPAT if compat else LOCATED, CUT, GRID, AHEAD,
        f"fields as (select pass_id, {sums} from {over} group by pass_id)",
    ]
    movers = "cut" if compat else "numbered"
    rows = [
        f"select pass_id, {c} channel, 7072 n, s{c} s, w{c} w from fields" for c in dense_values
    ] + [
        f"select l.pass_id, {c}, 7072, coalesce(p.n, 0) * 1000000, coalesce(p.w, 0) * 1000000 "
        f"from located l left join pairs p on p.pass_id = l.pass_id and p.side = '{side}'"
        for c, side in ((10, "att"), (11, "def"))
    ]
    set_cells = [
        f"select pass_id, {c} channel, y, x, {v} v from {source} where side = '{side}' and from_last = 1"
        for c, side, v, source in (
            (1, "att", D(1), "numbered"), (2, "def", D(1), "numbered"), (13, "att", "vx", "numbered"), (14, "att", "vy", "numbered"),
            (15, "def", "vx", movers), (16, "def", "vy", movers),
        )
    ] + [
        f"select pass_id, {c}, ball_y, ball_x, {v} from located"
        for c, v in ((8, "carrier_vx"), (9, "carrier_vy"), (12, "carrier_speed"))
    ]
    if as_tensor:
        # a channel without a set cell is a plane of zeros
        every = "(select pass_id, c channel from located cross join (select unnest([1, 2, 8, 9, 12, 13, 14, 15, 16]) c))"
        rows.append(
            f"select e.pass_id, e.channel, 7072, coalesce(sum({micro('v')}), 0), 0 from {every} e "
            f"left join ({' union all '.join(set_cells)}) v on v.pass_id = e.pass_id and v.channel = e.channel group by 1, 2"
        )
        columns = "pass_id, channel, cast(n as bigint) n, cast(s as bigint) s"
    else:
        rows.append(f"select pass_id, channel, count(*), sum({micro('v')}), sum({micro('v')} * {cell}) from ({' union all '.join(set_cells)}) group by 1, 2")
        columns = "pass_id, channel, cast(n as bigint) n, cast(s as double) s, cast(w as double) w"
    return on(*parts, select=f"select {columns} from ({' union all '.join(rows)})")


SCANNED = """scanned as (select p.*, t.n_slots, t.sx, t.svy, t.sid, t.steam from passes p join (
 select pass_id, count(*) n_slots, cast(sum(round(x * 100)) as bigint) sx, cast(sum(round(vy * 10)) as bigint) svy,
 cast(sum(orig_id) as bigint) sid, cast(coalesce(sum(slot_team), 0) as bigint) steam from track group by 1) t on t.pass_id = p.pass_id)"""

CLASSES = """pairs as (select quality t, toxic p, count(*) n from labels group by 1, 2),
classes as (select c label, coalesce((select sum(n) from pairs where t = c and p = c), 0) hits,
 coalesce((select sum(n) from pairs where t = c), 0) support, coalesce((select sum(n) from pairs where p = c), 0) named
 from (select t c from pairs union select p from pairs)),
scores as (select label, support, hits, case when named = 0 then 0 else cast(hits as double) / named end "precision",
 case when support = 0 then 0 else cast(hits as double) / support end recall,
 case when support + named = 0 then 0 else 2 * cast(hits as double) / (support + named) end f1 from classes)"""

REPORT = """select cast(label as varchar) label, round("precision", 6) "precision", round(recall, 6) recall, round(f1, 6) f1, cast(support as bigint) support from scores
 union all select 'accuracy', null, null, round(cast(sum(hits) as double) / sum(support), 6), cast(sum(support) as bigint) from scores
 union all select 'macro avg', round(avg("precision"), 6), round(avg(recall), 6), round(avg(f1), 6), cast(sum(support) as bigint) from scores
 union all select 'weighted avg', round(sum("precision" * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
 round(sum(f1 * support) / sum(support), 6), cast(sum(support) as bigint) from scores"""

FUSED_LOGIT = f"({D(0.5)} - {D(0.03)} * ({BALL_DISTANCE}) - {D(0.01)} * d_goal + {D(0.5)} * ({COSINE}) + {D(0.25)} * a_goal)"

NAMES = """names as (select unnest(['attackers', 'defenders', 'distance_to_ball', 'distance_to_goal', 'cosine_ball_goal', 'sine_ball_goal',
 'angle_to_goal', 'ball_speed_x', 'ball_speed_y', 'attackers_outplayed', 'defenders_outplayed', 'carrier_speed', 'attacker_vx',
 'attacker_vy', 'defender_vx', 'defender_vy', 'distance_to_origin']) "name", unnest(range(1, 18)) channel)"""

# passes with gaps: no number is NULL here, whether it was NULL or NaN
GAPPY = f"""holed as (select pass_id, slot, orig_id, case when pass_id % 31 = 0 then 1 + pass_id % 2 else slot_team end slot_team,
 case when (pass_id + slot) % 19 = 0 then null else x end x, y, case when (pass_id + slot) % 17 = 0 then null else vx end vx,
 case when (pass_id + slot) % 13 = 0 then null else vy end vy from track),
lot as materialized (select p.pass_id, p.team_id, case when p.pass_id % 29 <> 0 then {cell_x("p.ball_x_start")} end ball_x,
 arg_min(t.vx, t.slot) filter (t.slot = s.slot) carrier_vx, arg_min(t.vy, t.slot) filter (t.slot = s.slot) carrier_vy
 from passes p left join (select h.pass_id, min(h.slot) slot from holed h join passes q on q.pass_id = h.pass_id and h.orig_id = q.player_id group by 1) s on s.pass_id = p.pass_id
 left join holed t on t.pass_id = p.pass_id
 where p.pass_outcome_type in ('C', 'D', 'B', 'O', 'S', 'G', 'I') and p.ball_x_end is not null and p.ball_y_end is not null group by p.pass_id, p.team_id, p.ball_x_start),
placed as (select h.*, case when h.slot_team = l.team_id then 'att' else 'def' end side, {cell_x("h.x")} cx, {cell_y("h.y")} cy
 from holed h join lot l on l.pass_id = h.pass_id where h.slot_team is not null and h.x is not null),
standing as (select * from placed qualify row_number() over (partition by pass_id, side, cy, cx order by slot desc) = 1)"""

# all channels at the cells of a relation (pass_id, ball_x, ball_y, y, x, d_goal, a_goal): counts of the players ahead
# that are no nearer to the goal than the cell, and what stands at the cells of players and ball
MARKS = """lists as (select pass_id, coalesce(list(d_player) filter (side = 'att'), []) att, coalesce(list(d_player) filter (side = 'def'), []) dfn from ahead group by 1),
marks as (select pass_id, y, x, sum(c1) c1, sum(c2) c2, sum(c8) c8, sum(c9) c9, sum(c12) c12, sum(c13) c13, sum(c14) c14, sum(c15) c15, sum(c16) c16 from (
 select pass_id, y, x, 1 c1, 0 c2, 0 c8, 0 c9, 0 c12, vx c13, vy c14, 0 c15, 0 c16 from numbered where side = 'att' and from_last = 1
 union all select pass_id, y, x, 0, 1, 0, 0, 0, 0, 0, vx, vy from numbered where side = 'def' and from_last = 1
 union all select pass_id, ball_y, ball_x, 0, 0, coalesce(carrier_vx, 0), coalesce(carrier_vy, 0), coalesce(carrier_speed, 0), 0, 0, 0, 0 from located) group by 1, 2, 3)"""


def stacked(name: str, source: str, extra: str = "") -> str:
    set_cells = ", ".join(f"coalesce(m.c{c}, 0) c{c}" for c in (1, 2, 8, 9, 12, 13, 14, 15, 16))
    ahead = ", ".join(f"coalesce(len(list_filter(t.{side}, lambda d: d >= o.d_goal)), 0) c{c}" for c, side in ((10, "att"), (11, "dfn")))
    # only what the lists and marks lack is stated of the cell itself
    own = f"{BALL_DISTANCE} c3, d_goal c4, {COSINE} c5, {SINE} c6, a_goal c7, {BALL_DISTANCE} c17"
    return (
        f"{name} as (select o.*, {set_cells}, {ahead} from (select *, {own} from {source}) o "
        f"left join lists t on t.pass_id = o.pass_id left join marks m on m.pass_id = o.pass_id and m.y = o.y and m.x = o.x)"
    )


# Made-up coefficients of all channels, as in the queries.
EVERY = [0.3, -0.2, -0.03, -0.01, 0.5, 0.1, 0.25, 0.02, 0.01, 0.1, -0.1, 0.05, 0.01, 0.02, 0.03, 0.04, 0.001]
EVERY_LOGIT = " + ".join(f"{D(w)} * c{c}" for c, w in enumerate(EVERY, 1))
AT_AIM = "(select l.pass_id, l.target, l.ball_x, l.ball_y, g.y, g.x, g.d_goal, g.a_goal from located l join grid g on g.y = l.dest_y and g.x = l.dest_x)"
TRAIN = f"""train as (select pass_id from (select pass_id, row_number() over (order by {keyed_hash(42, "pass_id")}, pass_id) r from passes)
 where r > ceil((select count(*) from passes) * {D(0.2)}))"""

SHARES = [
    MARKS, stacked("aims", AT_AIM), stacked("cellwise", OVER),
    f"totals as (select pass_id, sum(e) t, {', '.join(f'sum(e * c{c}) e{c}' for c in range(1, 18))} from (select *, exp({EVERY_LOGIT}) e from cellwise) group by 1)",
]


def selection_gradient() -> str:
    lines = " union all ".join(
        f"select 'c{c}' \"name\", round(avg(e{c} / t - c{c}) / case when stddev_pop(c{c}) > 0 then stddev_pop(c{c}) else 1 end"
        f" + {D(0.01)} * {D(w)} * case when stddev_pop(c{c}) > 0 then stddev_pop(c{c}) else 1 end, 6) gradient from judged"
        for c, w in enumerate(EVERY, 1)
    )
    return on(
        FIXTURE, LOCATED, GRID, AHEAD, *SHARES, TRAIN,
        f"judged as materialized (select a.*, s.* exclude (pass_id), ln(s.t) - ({EVERY_LOGIT}) loss from aims a join totals s on s.pass_id = a.pass_id join train r on r.pass_id = a.pass_id)",
        select=f"{lines} union all select 'loss', round(avg(loss), 6) from judged",
    )


def success_gradient() -> str:
    # the square of 25 cells round the destination, moved inside the pitch
    square = f"""(select l.pass_id, l.ball_x, l.ball_y, g.y, g.x, g.d_goal, g.a_goal from located l join grid g
 on abs(g.y - least(greatest(l.dest_y, 2), 65)) <= 2 and abs(g.x - least(greatest(l.dest_x, 2), 101)) <= 2)"""
    logit = f"{D(0.25)} + {EVERY_LOGIT} + " + " + ".join(f"{D(0.5 * w)} * m{c}" for c, w in enumerate(EVERY, 1))
    lines = []
    for name, w in [(f"c{c}", w) for c, w in enumerate(EVERY, 1)] + [(f"m{c}", 0.5 * w) for c, w in enumerate(EVERY, 1)]:
        scale = f"case when stddev_samp({name}) > 0 then stddev_samp({name}) else 1 end"
        lines.append(f"select '{name}' \"name\", round(avg((p - target) * {name}) / {scale} + {D(0.01)} * {D(w)} * {scale}, 6) gradient from judged")
    lines += ["select 'intercept', round(avg(p - target), 6) from judged", f"select 'loss', round(avg({bce('target')}), 6) from judged"]
    return on(
        FIXTURE, LOCATED, GRID, AHEAD, MARKS, TRAIN, stacked("aims", AT_AIM), stacked("squares", square),
        f"means as (select pass_id, {', '.join(f'avg(cast(c{c} as double)) m{c}' for c in range(1, 18))} from squares group by 1)",
        f"judged as materialized (select *, 1 / (1 + exp(-({logit}))) p from aims join means using (pass_id) join train using (pass_id))",
        select=" union all ".join(lines),
    )


def flat(names: list[str]) -> str:
    """A fit has ended where the slope is zero for every name."""
    return f"select unnest({names!r}) \"name\", {D(0)} gradient"


RANDOM = f"""noise as (select event_id pass_id, i, sqrt(-2 * ln((cast({keyed_hash(42, "event_id", "i", "'r'")} as double) + {D(0.5)}) / {D(2**48)}))
 * cos(2 * pi() * ((cast({keyed_hash(42, "event_id", "i", "'a'")} as double) + {D(0.5)}) / {D(2**48)})) v
 from events cross join (select unnest(range(0, 64)) i))"""


def _orders_passes() -> str:
    fields = pass_fields("o.o_orderkey")
    return ", ".join(f"{fields[c]} {c}" for c in ("pass_outcome_type", "player_id"))


def _kernel_sum(out_ch: int, k: int) -> str:
    size = 8 - k + 1
    return on(
        PLANES,
        f"taps as (select i // {k * k} oc, (i // {k}) % {k} dy, i % {k} dx, cast((i * 5) % 9 - 4 as double) / 8 w from (select unnest(range(0, {out_ch * k * k})) i))",
        select=f"""select c.pass_id, cast(oc as integer) ch, c.y, c.x, round(sum(p.v * w) + cast(oc as double) / 4, 6) "value"
 from (select distinct pass_id, y, x from planes where y < {size} and x < {size}) c join taps on true
 join planes p on p.pass_id = c.pass_id and p.y = c.y + dy and p.x = c.x + dx group by c.pass_id, oc, c.y, c.x""",
    )


def _convolved(out_ch: int, k: int) -> str:
    """Sums over the results of a kernel on channels 1, 2, 13, 14 and 15: each set cell sends its value through each tap."""
    height, width, n = 68 - k + 1, 104 - k + 1, 5 * k * k
    f = lambda v: f"cast(cast({v} as float) as double)"
    set_cells = " union all ".join(
        f"select pass_id, {i} ic, y, x, {v} v from numbered where side = '{side}' and from_last = 1"
        for i, (side, v) in enumerate((("att", D(1)), ("def", D(1)), ("att", f("vx")), ("att", f("vy")), ("def", f("vx"))))
    )
    return on(
        FIXTURE, LOCATED,
        f"taps as (select i // {n} oc, (i // {k * k}) % 5 ic, (i // {k}) % {k} dy, i % {k} dx, cast((i * 5) % 9 - 4 as double) / 8 w from (select unnest(range(0, {out_ch * n})) i))",
        f"sent as (select pass_id, oc, v * w v, (y - dy) * {width} + x - dx + 1 p from ({set_cells}) c join taps t on t.ic = c.ic where y - dy between 0 and {height - 1} and x - dx between 0 and {width - 1})",
        f"sums as (select pass_id, oc, sum(v) s, sum(v * p) w from sent group by 1, 2)",
        select=f"""select l.pass_id, cast(o.oc as integer) ch, cast({height} as bigint) n, round(coalesce(s, 0) + cast(o.oc as double) / 4 * {height * width}, 3) s,
 round(coalesce(w, 0) + cast(o.oc as double) / 4 * {height * width * (height * width + 1) // 2}, 1) w
 from located l cross join (select unnest(range(0, {out_ch})) oc) o left join sums s on s.pass_id = l.pass_id and s.oc = o.oc""",
    )


SPLIT_HASH = keyed_hash(42, "pass_id")
_SPLIT_LIMIT = int((1 - 0.8) * (1 << 48))

ORACLES = {
    "completion_by_destination": on(
        FIXTURE, LOCATED, select="select dest_y, dest_x, count(*) n, round(avg(target), 6) share from located group by 1, 2"
    ),
    "s1_scan_passes": on(FIXTURE, SCANNED, select="select * exclude (pass_id) from scanned"),
    "s2_scan_game": on(
        FIXTURE, SCANNED,
        select="select * exclude (pass_id) from scanned where game_id = (select game_id from passes group by 1 order by count(*) desc, game_id limit 1)",
    ),
    "s3_source_stats": on(FIXTURE, select="select game_id, count(*) n from passes group by 1"),
    "s4_pick_pass": on(FIXTURE, select="select pass_id, game_id, pass_outcome_type from passes order by pass_id limit 1 offset 122"),
    "s5_write_loss": on(HISTORY, select="select * from history"),
    "s6_write_metrics": on(
        CLASSES, select='select round(cast(sum(hits) as double) / sum(support), 6) accuracy, round(avg("precision"), 6) "precision", round(avg(recall), 6) recall, round(avg(f1), 6) f1 from scores'
    ),
    "s7_write_surfaces": on(
        FIXTURE, LOCATED, GRID,
        select=f"""select o.pass_id, l.game_id, count(*) n, round(sum(cast(cast(1 / (1 + exp(-{FUSED_LOGIT})) as float) as double)), 2) total
 from {OVER} o join (select pass_id, game_id from located) l on l.pass_id = o.pass_id group by 1, 2""",
    ),
    "s8_random_stack": on(
        RANDOM,
        select="select pass_id, count(*) n, round(sum(v), 4) total, round(sum(v * v), 4) squares, round(sum(v * (i + 1)), 4) weighted from noise group by 1",
    ),
    "f1_drop_unlabelled": on(FIXTURE, select="select pass_id, pass_outcome_type from passes where pass_outcome_type is not null"),
    "f2_check_outcome": on(
        FIXTURE,
        "codes as (select unnest(['C', 'D', 'B', 'O', 'S', 'G', 'I']) code)",
        select="select pass_id, pass_outcome_type from passes anti join codes on code = pass_outcome_type where pass_outcome_type is not null",
    ),
    "f3_check_destination": on(FIXTURE, select="select pass_id, game_id from passes where ball_x_end is null or ball_y_end is null"),
    "f3_rejects": on(
        FIXTURE,
        select="""select pass_id, case when pass_outcome_type is null then 'no_outcome' when pass_outcome_type = 'Z' then 'unknown_outcome' else 'no_destination' end reject_reason
 from passes where pass_outcome_type is null or pass_outcome_type = 'Z' or ball_x_end is null""",
    ),
    "f4_active_slots": on(FIXTURE, select="select pass_id, slot, cast(slot_team as bigint) slot_team from track where slot_team is not null"),
    "f5_side": on(
        FIXTURE,
        select="select t.pass_id, slot, case when slot_team = team_id then 'att' else 'def' end side from track t join passes p on p.pass_id = t.pass_id where slot_team is not null",
    ),
    "f6_in_bounds": on(
        FIXTURE,
        select=f"select pass_id, count(*) filter ({cell_y('y')} between 0 and 67 and {cell_x('x')} between 0 and 103) inside, count(*) n from track group by 1",
    ),
    "f7_resolvable": on(
        FIXTURE, select="select p.pass_id, exists (select 1 from track t where t.pass_id = p.pass_id and t.orig_id = p.player_id) resolved from passes p"
    ),
    "p1_discover_slots": on(
        FIXTURE, select="select cast(slot - 1 as integer) ordinal, cast(slot as integer) slot, 6 fields, count(slot_team) players from track group by slot"
    ),
    "p2_unpivot_slots": on(
        FIXTURE, select="select pass_id, cast(slot - 1 as integer) slot_ord, slot, orig_id, cast(slot_team as double) slot_team, x, y, vx, vy from track"
    ),
    "p3_encode_outcome": on(
        FIXTURE, select="select pass_id, cast(case when pass_outcome_type = 'C' then 1 when pass_outcome_type in ('D', 'B', 'O', 'S', 'G', 'I') then 0 end as double) label from passes"
    ),
    "p4_cell_of": on(
        FIXTURE,
        select=f"""select pass_id, {cell_x('ball_x_start')} start_x, {cell_y('ball_y_start')} start_y,
 cast(case when ball_x_end is not null then {cell_x('ball_x_end')} end as double) end_x,
 cast(case when ball_y_end is not null then {cell_y('ball_y_end')} end as double) end_y from passes""",
    ),
    "p5_cast_ids": on(FIXTURE, select="select pass_id, cast(case when player_id >= 0 then player_id end as double) player_id, team_id from passes"),
    "p6_speed": on(FIXTURE, select="select pass_id, slot, round(sqrt(vx*vx + vy*vy), 6) speed from track"),
    "p7_build_sample": on(
        FIXTURE, LOCATED,
        select=f"select pass_id, ball_x_start, ball_y_start, ball_x_end, ball_y_end, pass_outcome_type, team_id, {six('carrier_vx', 'carrier_vy', 'carrier_speed')} from located",
    ),
    "p8_to_float": on(
        FIXTURE, LOCATED,
        select="select pass_id, "
        + ", ".join(f"floor(cast(cast({c} as float) as double) * {D(1e6)}) {c}" for c in ("carrier_vx", "carrier_speed"))
        + " from located",
    ),
    "p9_pitch_grid": on(
        FIXTURE, LOCATED, GRID,
        select=f"""select cast(g.cell as integer) cell, g.y, g.x, g.y + {D(0.5)} cy, g.x + {D(0.5)} cx, count(l.pass_id) n
 from grid g left join located l on l.dest_y = g.y and l.dest_x = g.x group by 1, 2, 3, 4, 5""",
    ),
    "j1_resolve_passer": on(
        FIXTURE, select="select p.pass_id, cast(min(t.slot) as double) carrier_slot from passes p left join track t on t.pass_id = p.pass_id and t.orig_id = p.player_id group by 1"
    ),
    "j1_resolve_passer_by_game": on(
        FIXTURE,
        FIRST_SLOT,
        select="select p.pass_id, cast(f.slot as double) carrier_slot from named p left join first_slot f on f.game_id = p.game_id and f.orig_id = p.player_id",
    ),
    "j2_attach_carrier": on(
        FIXTURE, CARRIED,
        select=f"select c.pass_id, {six('c.carrier_vx', 'c.carrier_vy', 'c.carrier_speed')} from carried c join passes p on p.pass_id = c.pass_id where p.pass_outcome_type is not null",
    ),
    "j2_attach_carrier_compat": on(FIXTURE, CARRIED_COMPAT, select=f"select pass_id, {six('carrier_vx', 'carrier_vy', 'carrier_speed')} from carried"),
    "j3_over_grid": dense(f"(y + {D(0.5)} - ball_y) + (x + {D(0.5)} - ball_x) / 4"),
    "j4_pixel": on(
        FIXTURE, LOCATED,
        select=f"select pass_id, y, x, round({BALL_DISTANCE}, 6) p from (select pass_id, dest_y y, dest_x x, ball_y, ball_x from located)",
    ),
    "j4_stored_pixel": on(
        FIXTURE, LOCATED,
        select=f"select pass_id, y, x, round(cast(cast({BALL_DISTANCE} as float) as double), 6) p from (select pass_id, dest_y y, dest_x x, ball_y, ball_x from located)",
    ),
    "j5_stack_surfaces": on(PLANES, select="select pass_id, y, x, round(v, 6) a, round(greatest(v, 0), 6) b from planes"),
    "c1_attackers": occupancy("att"),
    "c2_defenders": occupancy("def"),
    "c3_distance_to_ball": dense(BALL_DISTANCE),
    "c4_distance_to_goal": dense("d_goal"),
    "c5_cosine_ball_goal": dense(COSINE),
    "c6_sine_ball_goal": dense(SINE),
    "c7_angle_to_goal": dense("a_goal"),
    "c8_ball_speed_x": at_ball("carrier_vx"),
    "c9_ball_speed_y": at_ball("carrier_vy"),
    "c8_ball_speed_x_compat": at_ball("carrier_vx", compat=True),
    "c9_ball_speed_y_compat": at_ball("carrier_vy", compat=True),
    "c10_attackers_outplayed": outplayed_digest("att"),
    "c11_defenders_outplayed": outplayed_digest("def"),
    "c12_carrier_speed": at_ball("carrier_speed"),
    "c12_carrier_speed_compat": at_ball("carrier_speed", compat=True),
    "c13_attacker_vx": velocity("att", "vx"),
    "c14_attacker_vy": velocity("att", "vy"),
    "c15_defender_vx": velocity("def", "vx"),
    "c15_defender_vx_compat": velocity("def", "vx", compat=True),
    "c16_defender_vy": velocity("def", "vy"),
    "c16_defender_vy_compat": velocity("def", "vy", compat=True),
    "c17_distance_to_origin": dense(BALL_DISTANCE),
    "c18_destination_mask": on(
        FIXTURE, OK, select=f'select pass_id, {cell_y("ball_y_end")} y, {cell_x("ball_x_end")} x, {D(1)} "value" from ok'
    ),
    "c19_channel_stack": _stack(as_tensor=False),
    "c19_channel_stack_compat": _stack(as_tensor=False, compat=True),
    "c20_dense_row": _stack(as_tensor=True),
    "a1_nan_channels": on(
        FIXTURE, LOCATED,
        NAMES,
        "holes as (select 8 channel, count(*) n from located where carrier_vx is null union all select 9, count(*) from located where carrier_vy is null "
        "union all select 12, count(*) from located where carrier_speed is null)",
        select='select cast(k.channel as integer) channel, "name", coalesce(n, 0) nan_cells, coalesce(n, 0) nan_passes, coalesce(n, 0) > 0 has_nan from names k left join holes h on h.channel = k.channel',
    ),
    "a1_nan_channels_gappy": on(
        FIXTURE, GAPPY, NAMES,
        """holes as (select 8 channel, count(*) n from lot where carrier_vx is null and ball_x is not null union all select 9, count(*) from lot where carrier_vy is null and ball_x is not null
 union all select 12, count(*) from lot where (carrier_vx is null or carrier_vy is null) and ball_x is not null
 union all select unnest([3, 5, 6, 17]), 7072 * count(*) from lot where ball_x is null
 union all select case side when 'att' then 13 else 15 end, count(*) from standing where vx is null group by side
 union all select case side when 'att' then 14 else 16 end, count(*) from standing where vy is null group by side)""",
        """with_gap as (select 8 channel, count(*) p from lot where carrier_vx is null and ball_x is not null union all select 9, count(*) from lot where carrier_vy is null and ball_x is not null
 union all select 12, count(*) from lot where (carrier_vx is null or carrier_vy is null) and ball_x is not null
 union all select unnest([3, 5, 6, 17]), count(*) from lot where ball_x is null
 union all select case side when 'att' then 13 else 15 end, count(distinct pass_id) from standing where vx is null group by side
 union all select case side when 'att' then 14 else 16 end, count(distinct pass_id) from standing where vy is null group by side)""",
        select="""select cast(k.channel as integer) channel, "name", cast(coalesce(n, 0) as bigint) nan_cells, cast(coalesce(p, 0) as bigint) nan_passes, coalesce(n, 0) > 0 has_nan
 from names k left join holes h on h.channel = k.channel left join with_gap g on g.channel = k.channel""",
    ),
    "a1_pass_audit": on(
        FIXTURE, LOCATED,
        select="""select count(*) passes, count(*) filter (carrier_slot is null) passer_not_found, cast(0 as bigint) players_unplaced,
 count(*) filter (not exists (select 1 from players q where q.pass_id = l.pass_id and side = 'att')) no_attacker,
 count(*) filter (not exists (select 1 from players q where q.pass_id = l.pass_id and side = 'def')) no_defender from located l""",
    ),
    "a2_channel_slice": on(
        FIXTURE, LOCATED, GRID, AHEAD,
        select="""select g.y, g.x, count(a.d_player) "value" from grid g
 left join (select * from ahead where side = 'def' and pass_id = (select min(pass_id) from located)) a on g.d_goal <= a.d_player group by 1, 2""",
    ),
    "a3_outplayed": on(
        FIXTURE, LOCATED, GRID, AHEAD,
        select="""select l.pass_id, cast(count(*) filter (a.side = 'att') as integer) att, cast(count(*) filter (a.side = 'def') as integer) "def"
 from located l join grid g on g.y = l.dest_y and g.x = l.dest_x left join ahead a on a.pass_id = l.pass_id and a.d_player >= g.d_goal group by 1""",
    ),
    "a4_confusion": "select quality y_true, toxic y_pred, count(*) n from labels group by 1, 2",
    "a5_accuracy": "select round(avg(case when quality = toxic then 1.0 else 0.0 end), 6) accuracy from labels",
    "a6_macro_precision": on(CLASSES, select='select round(avg("precision"), 6) macro_precision from scores'),
    "a7_macro_recall": on(CLASSES, select="select round(avg(recall), 6) macro_recall from scores"),
    "a8_macro_f1": on(CLASSES, select="select round(avg(f1), 6) macro_f1 from scores"),
    "a9_class_report": on(CLASSES, select=REPORT),
    "a10_batch_bce": on(PREDICTED, select=f"select batch_id, round(avg({bce('y_true')}), 6) loss from predicted group by 1"),
    "a11_epoch_loss": on(
        PREDICTED, select=f"select round(avg(loss), 6) loss from (select batch_id, avg({bce('y_true')}) loss from predicted group by 1)"
    ),
    "a12_selection_loss": on(PREDICTED, select=f"select batch_id, round(avg({bce(D(1))}), 6) loss from predicted group by 1"),
    "w1_checkpoints": on(
        HISTORY,
        select="""select run, epoch, val_loss, val_loss < 1e12 and not exists
 (select 1 from history b where b.run = a.run and b.epoch < a.epoch and b.val_loss <= a.val_loss) kept from history a""",
    ),
    "w2_best_epoch": on(
        HISTORY, select="select distinct on (run) run, epoch, val_loss from history where val_loss < 1e12 order by run, val_loss, epoch"
    ),
    "w3_surface_softmax": on(
        PLANES, select="select p.pass_id, y, x, round(exp(v) / t, 6) p from planes p join (select pass_id, sum(exp(v)) t from planes group by 1) s on s.pass_id = p.pass_id"
    ),
    "w3_surface_softmax_compat": on(
        PLANES,
        select="select p.pass_id, y, x, round(exp(v) / t, 6) p from planes p join (select pass_id // 32 b, sum(exp(v)) t from planes group by 1) s on s.b = p.pass_id // 32",
    ),
    "w4_split": on(
        FIXTURE, OK,
        select=f"""select pass_id, case when row_number() over (order by {SPLIT_HASH}, pass_id) <= ceil((select count(*) from ok) * {D(0.2)}) then 'validation' else 'train' end split from ok""",
    ),
    "w4_split_by_hash": on(FIXTURE, OK, select=f"select pass_id, case when {SPLIT_HASH} < {_SPLIT_LIMIT} then 'validation' else 'train' end split from ok"),
    "w4_split_by_game": on(
        FIXTURE, select=f"select pass_id, case when {keyed_hash(42, 'game_id')} < {_SPLIT_LIMIT} then 'validation' else 'train' end split from passes"
    ),
    "w5_route_test": on(
        FIXTURE,
        f"routed as (select 'train' split, pass_outcome_type, player_id from passes union all select 'test', {_orders_passes()} from orders o)",
        select="select split, pass_outcome_type, count(*) n, cast(sum(player_id) as bigint) players from routed group by 1, 2",
    ),
    "w6_batches": on(FIXTURE, OK, select="select pass_id, (row_number() over (order by pass_id) - 1) // 32 batch_id from ok"),
    "w6_batches_shuffled": on(FIXTURE, OK, select=f"select pass_id, (row_number() over (order by {SPLIT_HASH}, pass_id) - 1) // 32 batch_id from ok"),
    "w7_sample_pass": on(FIXTURE, select=f"select pass_id, game_id from passes order by {keyed_hash(7, 'pass_id')}, pass_id limit 1"),
    "w8_row_count": on(FIXTURE, OK, select="select count(*) n from ok"),
    "r1_focal_conv": _kernel_sum(2, 3),
    "r1_focal_conv_channels": _convolved(2, 5),
    "r6_pointwise_channels": _convolved(3, 1),
    "r2_relu": on(PLANES, select='select pass_id, ch, y, x, round(greatest(v, 0), 6) "value" from planes'),
    "r3_replicate_pad": on(
        PLANES, "wide as (select cast(i // 12 as integer) y, cast(i % 12 as integer) x from (select unnest(range(0, 144)) i))",
        select='select pass_id, ch, w.y, w.x, round(v, 6) "value" from wide w join planes p on p.y = least(greatest(w.y - 2, 0), 7) and p.x = least(greatest(w.x - 2, 0), 7)',
    ),
    "r4_max_pool": on(PLANES, select='select pass_id, ch, y // 2 y, x // 2 x, round(max(v), 6) "value" from planes group by 1, 2, 3, 4'),
    "r5_upsample": on(
        PLANES, "wide as (select cast(i // 16 as integer) y, cast(i % 16 as integer) x from (select unnest(range(0, 256)) i))",
        select='select pass_id, ch, w.y, w.x, round(v, 6) "value" from wide w join planes p on p.y = w.y // 2 and p.x = w.x // 2',
    ),
    "r6_pointwise": _kernel_sum(3, 1),
    "r7_fuse": on(PLANES, select=f'select pass_id, y, x, round(v * {D(0.5)} + greatest(v, 0) * {D(-0.25)} + {D(0.125)}, 6) "value" from planes'),
    "r8_sigmoid": on(PLANES, select='select pass_id, ch, y, x, round(1 / (1 + exp(-v)), 6) "value" from planes'),
    "r10_success_gradient": success_gradient(),
    "r10_fit_success": flat([f"{p}{c}" for p in "cm" for c in range(1, 18)] + ["intercept"]),
    "r10_selection_gradient": selection_gradient(),
    "r10_fit_selection": flat([f"c{c}" for c in range(1, 18)]),
    "r11_classify": on(PREDICTED, select=f"select pass_id, case when p >= {D(0.75)} then 1 else 0 end y_pred from predicted"),
    "r12_evaluate": on(
        FIXTURE, LOCATED, GRID,
        f"judged as (select target t, case when 1 / (1 + exp(-({FUSED_LOGIT} + 1))) >= {D(0.75)} then 1 else 0 end p "
        "from (select l.target, l.ball_x, l.ball_y, g.* from located l join grid g on g.y = l.dest_y and g.x = l.dest_x))",
        CLASSES.replace("select quality t, toxic p, count(*) n from labels group by 1, 2", "select t, p, count(*) n from judged group by 1, 2"),
        select='select round(cast(sum(hits) as double) / sum(support), 6) accuracy, round(avg("precision"), 6) "precision", round(avg(recall), 6) recall, round(avg(f1), 6) f1 from scores',
    ),
    "r12_selection_pixel": on(
        FIXTURE, LOCATED, GRID,
        f"totals as (select pass_id, sum(exp({FUSED_LOGIT})) t from {OVER} group by 1)",
        select=f"""select l.pass_id, round(1000 * exp({FUSED_LOGIT}) / t, 6) p_mille
 from (select l.pass_id, l.ball_x, l.ball_y, g.* from located l join grid g on g.y = l.dest_y and g.x = l.dest_x) l join totals s on s.pass_id = l.pass_id""",
    ),
    "r12_selection_pixel_players": on(
        FIXTURE, LOCATED, GRID, AHEAD, *SHARES,
        select=f"select a.pass_id, round(1000 * exp({EVERY_LOGIT}) / t, 6) p_mille from aims a join totals s on s.pass_id = a.pass_id",
    ),
    "r12_report_test": on(
        fixture("orders", "o_orderkey"), LOCATED, GRID,
        f"judged as (select target t, case when 1 / (1 + exp(-({FUSED_LOGIT} + 1))) >= {D(0.75)} then 1 else 0 end p "
        "from (select l.target, l.ball_x, l.ball_y, g.* from located l join grid g on g.y = l.dest_y and g.x = l.dest_x))",
        CLASSES.replace("select quality t, toxic p, count(*) n from labels group by 1, 2", "select t, p, count(*) n from judged group by 1, 2"),
        select=REPORT,
    ),
    "r12_evaluate_selection": on(
        FIXTURE, LOCATED, GRID,
        f"totals as (select pass_id, sum(exp({FUSED_LOGIT})) t from {OVER} group by 1)",
        f"""judged as (select 1 t, case when exp({FUSED_LOGIT}) / t >= {D(0.0002)} then 1 else 0 end p
 from (select l.pass_id, l.ball_x, l.ball_y, g.* from located l join grid g on g.y = l.dest_y and g.x = l.dest_x) l join totals s on s.pass_id = l.pass_id)""",
        CLASSES.replace("select quality t, toxic p, count(*) n from labels group by 1, 2", "select t, p, count(*) n from judged group by 1, 2"),
        select='select round(cast(sum(hits) as double) / sum(support), 6) accuracy, round(avg("precision"), 6) "precision", round(avg(recall), 6) recall, round(avg(f1), 6) f1 from scores',
    ),
    "r13_rank_scale": on(PLANES, select="select pass_id, y, x, round(percent_rank() over (partition by pass_id order by v), 6) quantile from planes"),
    "stream_passer_by_game": on(
        FIXTURE, LOCATED_COMPAT,
        select="select game_id, player_id, cast(carrier_slot as double) carrier_slot, count(*) n, round(sum(carrier_vx), 3) vx from located group by 1, 2, 3",
    ),
    "stream_sparse_channels": on(
        FIXTURE, LOCATED,
        "set_cells as (select pass_id, 1 channel, y, x, 1 v from numbered where side = 'att' and from_last = 1 "
        + "".join(
            f"union all select pass_id, {c}, y, x, {v} from numbered where side = '{s}' and from_last = 1 "
            for c, s, v in ((2, "def", "1"), (13, "att", "vx"), (14, "att", "vy"), (15, "def", "vx"), (16, "def", "vy"))
        )
        + "".join(
            f"union all select pass_id, {c}, ball_y, ball_x, {v} from located " for c, v in ((8, "carrier_vx"), (9, "carrier_vy"), (12, "carrier_speed"))
        )
        + ")",
        select='select pass_id, channel, y, x, round(cast(v as double), 6) "value" from set_cells',
    ),
}
