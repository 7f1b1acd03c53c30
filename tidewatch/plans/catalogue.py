"""Registered queries of the stream engine: a specification each, and the SQL that says the same.

Streams over ``events`` are ordered by (ts, event_id); ``v`` is the value in hundredths.
Event streams carry event_id, periodic ones the time ``t`` of the tick; time starts at
midnight before the first event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.fold import fold
from .compiler import SEQ, TS, Plan, compile_spec

INPUTS = """input v: Int64
input value: Float64
input user_id: Int64
input event_type: String
input err: Int64
input clk: Int64
"""
#: Added before rounding on both sides, so that means of hundredths don't lie between two roundings.
OFF_TIES = 3.3e-9
#: The same columns in SQL.
Q = """with raw as (select event_id, ts, user_id, event_type, value, cast(round(value * 100) as bigint) as v,
  case when event_type = 'error' then cast(round(value * 100) as bigint) end as err,
  case when event_type = 'click' then cast(round(value * 100) as bigint) end as clk from events),
q as (select *, date_trunc('day', (select min(ts) from raw)) as origin, row_number() over (order by ts, event_id) as rn from raw)
"""


def _tick(hours: int, name: str = "tick") -> str:
    return f""", {name} as (select origin + n * interval {hours} hour as t from (select min(origin) as origin, max(ts) as hi from q), range(1, 100000) r(n) where origin + n * interval {hours} hour <= hi)
"""


TICKS = Q + _tick(1)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with time since midnight before the first one and the columns of INPUTS."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    start = raw.agg(F.date_trunc("day", F.min("ts"))).first()[0]
    return _inputs(raw, _micros(F.col("ts")) - _micros(F.lit(start)))


def untimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` for specifications without deadlines, where time is an order only."""
    return _inputs(spark.read.parquet(f"{sf_dir}/events.parquet"), _micros(F.col("ts")))


def _micros(ts):
    return F.unix_micros(ts.cast("timestamp"))


def _inputs(raw: DataFrame, since) -> DataFrame:
    v = F.round(F.col("value") * 100).cast("bigint")
    return raw.select((since * 1000).alias(TS), F.col("event_id").alias(SEQ), v.alias("v"), "value", "user_id", "event_type", F.when(F.col("event_type") == "error", v).alias("err"), F.when(F.col("event_type") == "click", v).alias("clk"))


def origin(spark, sf_dir: str, table: str = "events", col: str = "ts"):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").agg(F.date_trunc("day", F.min(col))).first()[0]


def _time(df: DataFrame, start) -> DataFrame:
    """``ts`` to the timestamp ``t``."""
    return df.withColumn("t", F.timestamp_micros(_micros(F.lit(start)) + F.call_function("div", F.col("ts"), F.lit(1000))).cast("timestamp_ntz"))


def _of_events(spec: str, *names: str):
    """The named event streams by event_id, all cycles in which one of them has a value."""

    def run(spark, sf_dir):
        plan = compile_spec(INPUTS + spec, untimed(spark, sf_dir))
        return plan.table(*names).select(F.col("seq").alias("event_id"), *names)

    return run


def _of_ticks(spec: str, *names: str):
    """The named periodic streams by time."""

    def run(spark, sf_dir):
        start = origin(spark, sf_dir)
        raw = spark.read.parquet(f"{sf_dir}/events.parquet")
        plan = compile_spec(INPUTS + spec, _inputs(raw, _micros(F.col("ts")) - _micros(F.lit(start))))
        return _time(plan.table(*names), start).select("t", *names)

    return run


def _keyed(spec: str, name: str, ticks: bool | None = False):
    """A parameterised stream, by event_id or time and parameters. ticks: None for event streams of specifications with deadlines."""

    def run(spark, sf_dir):
        start = None if ticks is False else origin(spark, sf_dir)
        raw = spark.read.parquet(f"{sf_dir}/events.parquet")
        rows = untimed(spark, sf_dir) if ticks is False else _inputs(raw, _micros(F.col("ts")) - _micros(F.lit(start)))
        plan = compile_spec(INPUTS + spec, rows)
        keys = plan.keyed[name].keys
        df = plan.stream(name)
        return _time(df, start).select("t", *keys, "value") if ticks else df.select(F.col("seq").alias("event_id"), *keys, "value")

    return run


def _folded(spec: str, name: str):
    """An event stream with whole numbers, as an ordered fold."""

    def run(spark, sf_dir):
        changes = fold(INPUTS + spec, untimed(spark, sf_dir))
        return changes.filter((F.col("stream") == name) & (F.col("change") == "Value")).select(F.col("seq").alias("event_id"), F.col("value").cast("bigint").alias(name))

    return run


def _flagship(spark, sf_dir: str) -> DataFrame:
    return _keyed(FLAGSHIP, "busy", ticks=True)(spark, sf_dir)


FLAGSHIP = """output seen(e) spawn with event_type eval when e == event_type with v
output busy(e) spawn with event_type eval @Global(1h) with seen(e).aggregate(over: 24h, using: count)
"""


def flagship(spark, sf_dir: str) -> DataFrame:
    """Sliding daily counts per event type on hourly ticks, where they pass a threshold."""
    return _flagship(spark, sf_dir).filter("value > 5")


def _catalogue() -> dict[str, tuple]:
    c: dict[str, tuple] = {}
    add = lambda name, run, sql: c.__setitem__(name, (run, sql))
    e = lambda cols: f"{Q} select event_id, {cols} from q"

    add("const_project", _of_events("output o := v * 2 + 1", "o"), e("v * 2 + 1 as o"))
    add("arith_mix", _of_events("output a := v / 7\noutput b := v % 7\noutput c := v ** 2\noutput d := -v", "a", "b", "c", "d"), e("v // 7 as a, v % 7 as b, v * v as c, -v as d"))
    add("bit_ops", _of_events("output a := user_id & 6\noutput b := user_id | 1\noutput c := user_id ^ 5\noutput d := user_id << 2\noutput e := user_id >> 1", "a", "b", "c", "d", "e"), e("user_id & 6 as a, user_id | 1 as b, xor(user_id, 5) as c, user_id << 2 as d, user_id >> 1 as e"))
    add("compare_bool", _of_events('output a := v > 1000 && user_id != 7 || event_type == "click"\noutput b := !(v <= 500)', "a", "b"), e("(v > 1000 and user_id <> 7 or event_type = 'click') as a, not (v <= 500) as b"))
    add("if_else", _of_events("output o := if v > 1000 then 1 else 0", "o"), e("case when v > 1000 then 1 else 0 end as o"))

    def rounded(names):
        return lambda df: df.select("event_id", *[F.round(F.col(n) + OFF_TIES, 6).alias(n) for n in names])

    names = ["a", "b", "c", "d", "f", "g", "h"]
    run = _of_events("import math\noutput a := sqrt(abs(value))\noutput b := sin(value)\noutput c := cos(value)\noutput d := arctan(value)\noutput f := abs(value)\noutput g := round(value, 1)\noutput h := value / 3.0", *names)
    add("math_fn", lambda s, d: rounded(names)(run(s, d)), e(", ".join(f"round({x} + {OFF_TIES}, 6) as {n}" for x, n in zip(["sqrt(abs(value))", "sin(value)", "cos(value)", "atan(value)", "abs(value)", "round(value, 1)", "value / 3.0"], names, strict=True))))
    add("min_max_fn", _of_events("output a := min(v, user_id)\noutput b := max(v, user_id)", "a", "b"), e("least(v, user_id) as a, greatest(v, user_id) as b"))
    add("regex_match", _of_events('import regex\noutput m := event_type.matches(regex: "^c")', "m"), e("regexp_matches(event_type, '^c') as m"))
    add("tuple_access", _of_events("output t := (user_id, (v, value))\noutput o := t.1.0 + t.0", "o"), e("v + user_id as o"))
    add("casts", _of_events("output a := cast<Int64>(value)\noutput b := cast<Float64>(v)", "a", "b"), e("cast(trunc(value) as bigint) as a, cast(v as double) as b"))
    add("filter_eval", _of_events('output o eval when event_type == "error" with v', "o"), f"{Q} select event_id, v as o from q where event_type = 'error'")
    add("multi_clause", _of_events('output o eval when v > 10000 with 3 eval when event_type == "error" with 2 eval when v > 1000 with 1', "o"), f"{Q} select * from (select event_id, case when v > 10000 then 3 when event_type = 'error' then 2 when v > 1000 then 1 end as o from q) where o is not null")
    add("ac_conj", _of_events("output a @(err && v) := err + v", "a"), f"{Q} select event_id, err + v as a from q where err is not null")
    add("ac_disj", _of_events("output a @(err || clk) := err.hold(or: 0) + clk.hold(or: 0)", "a"), f"{Q} select event_id, a from (select event_id, coalesce(last_value(err ignore nulls) over w, 0) + coalesce(last_value(clk ignore nulls) over w, 0) as a, err, clk from q window w as (order by rn)) where err is not null or clk is not null")
    add("offset_1", _of_events("output o := v.offset(by: -1).defaults(to: 0)", "o"), e("coalesce(lag(v) over (order by rn), 0) as o"))
    add("offset_5_default", _of_events("output o := v.offset(by: -5).defaults(to: -1)", "o"), e("coalesce(lag(v, 5) over (order by rn), -1) as o"))
    add("offset_sparse", _of_events("output o @v := err.offset(by: -2).defaults(to: -1)", "o"), f"""{Q}, l as (select *, case when err is not null then lag(err, 2) over (partition by err is not null order by rn) end as two, case when err is not null then lag(err, 1) over (partition by err is not null order by rn) end as one, count(err) over (order by rn) as n from q)
        select event_id, coalesce(case when err is not null then two else (select one from l b where b.n = a.n and b.err is not null) end, -1) as o from l a""")
    add("hold_sparse", _of_events("output o @v := err.hold(or: 0)", "o"), e("coalesce(last_value(err ignore nulls) over (order by rn), 0) as o"))
    add("get_fresh", _of_events("output a @v := err.get().defaults(to: -1)\noutput b @v := err.is_fresh()", "a", "b"), e("coalesce(err, -1) as a, err is not null as b"))
    add("counter", _of_events("output x @v := x.offset(by: -1).defaults(to: 0) + 1", "x"), e("rn as x"))
    add("running_sum", _of_events("output x := x[-1].defaults(to: 5) + v", "x"), e("cast(5 + sum(v) over (order by rn) as bigint) as x"))
    add("running_max", _of_events("output x := max(x[-1].defaults(to: 0), v)\noutput y := min(y[-1].defaults(to: 100000), v)", "x", "y"), e("greatest(0, max(v) over (order by rn)) as x, least(100000, min(v) over (order by rn)) as y"))
    add("running_bool", _of_events("output x := x[-1].defaults(to: true) && v < 40000\noutput y := y[-1].defaults(to: false) || v > 40000", "x", "y"), e("bool_and(v < 40000) over (order by rn) as x, bool_or(v > 40000) over (order by rn) as y"))
    add("reset_counter", _of_events('output x := if event_type == "signup" then 0 else x[-1].defaults(to: 0) + v', "x"), f"{Q}, s as (select *, count(*) filter (event_type = 'signup') over (order by rn) as seg from q) select event_id, cast(sum(case when event_type = 'signup' then 0 else v end) over (partition by seg order by rn) as bigint) as x from s")
    add("toggle", _of_events("output x @v := !x[-1].defaults(to: false)", "x"), e("rn % 2 = 1 as x"))
    add("format_msg", lambda s, d: compile_spec(INPUTS + 'trigger eval when v > 10000 with "user {} did {} at {}".format(user_id, event_type, value)', untimed(s, d)).triggers().select(F.col("seq").alias("event_id"), "message"), f"{Q} select event_id, 'user ' || user_id || ' did ' || event_type || ' at ' || case when value = floor(value) then cast(cast(value as bigint) as varchar) else cast(value as varchar) end as message from q where v > 10000")
    add("trigger_union", lambda s, d: compile_spec(INPUTS + 'trigger v > 10000 "big"\ntrigger event_type == "error" "error"\ntrigger v < 100 && user_id > 3 "small"', untimed(s, d)).triggers().select(F.col("seq").alias("event_id"), "trigger", "message"), f"{Q} select event_id, 0 as trigger, 'big' as message from q where v > 10000 union all select event_id, 1, 'error' from q where event_type = 'error' union all select event_id, 2, 'small' from q where v < 100 and user_id > 3")

    # periodic streams
    add("tick_hold_1h", _of_ticks("output o @1h := v.hold(or: 0)", "o"), f"{TICKS} select t, coalesce((select arg_max(v, rn) from q e where e.ts <= tick.t), 0) as o from tick")
    add("tick_multi_rate", _of_ticks("output b @1h := v.hold(or: 0)\noutput c @2h := err.hold(or: 0)\noutput d @2h := b + c", "d"), f"{Q}{_tick(2)} select t, coalesce((select arg_max(v, rn) from q e where e.ts <= tick.t), 0) + coalesce((select arg_max(err, rn) from q e where e.ts <= tick.t and err is not null), 0) as d from tick")
    over = lambda agg, cond="": f"{TICKS} select t, {agg} as o from tick left join q on q.ts > t - interval 6 hour and q.ts <= t {cond} group by t"
    for name, using, sql in (
        ("win_count", "count", "count(v)"), ("win_sum", "sum", "cast(coalesce(sum(v), 0) as bigint)"), ("win_avg_int", "avg", "cast(sum(v) as bigint) // count(v)"),
        ("win_min", "min", "min(v)"), ("win_max", "max", "max(v)"), ("win_last", "last", "arg_max(v, rn)"),
    ):
        keep = "" if name in ("win_count", "win_sum") else "having count(v) > 0"
        add(name, _of_ticks(f"output o @1h := v.aggregate(over: 6h, using: {using})", "o"), f"{over(sql)} {keep}")
    for name, source, using, sql in (
        ("win_avg_float", "value", "avg", "avg(value)"), ("win_var", "value", "var", "coalesce(var_pop(value), 0)"), ("win_sd", "value", "sd", "coalesce(stddev_pop(value), 0)"),
        ("win_cov", "pair", "cov", "covar_pop(value, cast(user_id as double))"),
    ):
        run1 = _of_ticks(f"output pair := (value, cast<Float64>(user_id))\noutput o @1h := {source}.aggregate(over: 6h, using: {using})", "o")
        keep = "" if using in ("var", "sd") else "having count(v) > 0"
        add(name, lambda s, d, r=run1: r(s, d).select("t", F.round(F.col("o") + OFF_TIES, 6).alias("o")), f"{over(f'round({sql} + {OFF_TIES}, 6)')} {keep}")
    pct = lambda p: f"case when n * {p} % 100 = 0 and n * {p} // 100 < n then (l[greatest(1, n * {p} // 100)] + l[least(n, greatest(1, n * {p} // 100) + 1)]) // 2 when n * {p} % 100 = 0 then l[n] else l[greatest(1, cast(ceil(n * {p} / 100.0) as bigint))] end"
    for name, using, p in (("win_med", "med", 50), ("win_pctl25", "pctl25", 25)):
        add(name, _of_ticks(f"output o @1h := v.aggregate(over: 6h, using: {using})", "o"), f"{TICKS} select t, {pct(p)} as o from (select t, list_sort(list(v)) as l, count(v) as n from tick join q on q.ts > t - interval 6 hour and q.ts <= t group by t)")
    add("win_forall", _of_ticks("output b := v < 30000\noutput o @1h := b.aggregate(over: 6h, using: forall)", "o"), over("coalesce(bool_and(v < 30000), true)"))
    add("win_exists", _of_ticks("output b := v > 30000\noutput o @1h := b.aggregate(over: 6h, using: exists)", "o"), over("coalesce(bool_or(v > 30000), false)"))
    add("win_sum_bool", _of_ticks("output b := v > 3000\noutput o @1h := b.aggregate(over: 6h, using: sum)", "o"), over("count(*) filter (v > 3000)"))
    run2 = _of_ticks("output o @1h := value.aggregate(over: 6h, using: integral)", "o")
    add("win_integral", lambda s, d: run2(s, d).select("t", F.round("o", 3).alias("o")), f"""{TICKS}, p as (select t, q.ts, value, lag(value) over w as lv, lag(q.ts) over w as lt from tick join q on q.ts > t - interval 6 hour and q.ts <= t window w as (partition by t order by rn)),
        a as (select t, sum((value + lv) * (epoch_us(ts) - epoch_us(lt)) / 2e6) as x from p group by t) select tick.t, round(coalesce(x, 0), 3) as o from tick left join a on a.t = tick.t""")
    add("win_exactly", _of_ticks("output o @1h := v.aggregate(over_exactly: 24h, using: count)", "o"), f"{TICKS} select t, count(v) as o from tick left join q on q.ts > t - interval 24 hour and q.ts <= t where t - (select min(origin) from q) >= interval 24 hour group by t")
    add("win_tumbling", _of_ticks("output o @6h := v.aggregate(over: 6h, using: sum)", "o"), f"{Q}{_tick(6)} select t, cast(coalesce(sum(v), 0) as bigint) as o from tick left join q on q.ts > t - interval 6 hour and q.ts <= t group by t")
    add("win_sparse_pane", _of_ticks("output o @2h := err.aggregate(over: 5h, using: max).defaults(to: -1)", "o"), f"{Q}{_tick(2)} select t, coalesce(max(err), -1) as o from tick left join q on q.ts > t - interval 5 hour and q.ts <= t group by t")
    add("tick_trigger", lambda s, d: _time((p := compile_spec(INPUTS + 'output n @1h := v.aggregate(over: 6h, using: count)\ntrigger n > 3 "busy"\ntrigger n == 0 "idle"', events(s, d))).triggers(), origin(s, d)).select("t", "message"), f"{TICKS}, n as (select t, count(v) as n from tick left join q on q.ts > t - interval 6 hour and q.ts <= t group by t) select t, 'busy' as message from n where n > 3 union all select t, 'idle' from n where n = 0")

    # count windows
    rows = "over (order by rn rows between 9 preceding and current row)"
    add("disc_sum_10", _of_events("output o := v.aggregate(over_discrete: 10, using: sum)", "o"), e(f"cast(sum(v) {rows} as bigint) as o"))
    add("disc_stats", _of_events("output a := v.aggregate(over_discrete: 10, using: avg).defaults(to: 0)\noutput b := v.aggregate(over_discrete: 10, using: min).defaults(to: 0)\noutput c := v.aggregate(over_discrete: 10, using: max).defaults(to: 0)\noutput d := v.aggregate(over_discrete: 10, using: count)\noutput f := v.aggregate(over_discrete: 10, using: last).defaults(to: 0)", "a", "b", "c", "d", "f"), e(f"cast(sum(v) {rows} as bigint) // count(v) {rows} as a, min(v) {rows} as b, max(v) {rows} as c, count(v) {rows} as d, v as f"))
    run3 = _of_events("output o := value.aggregate(over_discrete: 10, using: var)\noutput p := value.aggregate(over_discrete: 10, using: sd)", "o", "p")
    add("disc_var", lambda s, d: run3(s, d).select("event_id", F.round(F.col("o") + OFF_TIES, 6).alias("o"), F.round(F.col("p") + OFF_TIES, 6).alias("p")), e(f"round(var_pop(value) {rows} + {OFF_TIES}, 6) as o, round(stddev_pop(value) {rows} + {OFF_TIES}, 6) as p"))
    add("disc_sparse", _of_events("output o @v := err.aggregate(over_discrete: 3, using: sum)", "o"), f"{Q}, r as (select rn, sum(err) over (order by rn rows between 2 preceding and current row) as s from q where err is not null) select event_id, cast(coalesce(last_value(s ignore nulls) over (order by q.rn), 0) as bigint) as o from q left join r on r.rn = q.rn")
    add("disc_wait", _of_events("output o := v.aggregate(over_exactly_discrete: 10, using: sum).defaults(to: -1)", "o"), e(f"case when rn >= 10 then cast(sum(v) {rows} as bigint) else -1 end as o"))
    add("disc_med", _of_events("output o := v.aggregate(over_discrete: 5, using: med).defaults(to: 0)", "o"), f"{Q}, w as (select event_id, list_sort(list(v) over (order by rn rows between 4 preceding and current row)) as l, count(v) over (order by rn rows between 4 preceding and current row) as n from q) select event_id, {pct(50)} as o from w")

    # parameterised streams
    per = "over (partition by user_id order by rn)"
    k = lambda cols: f"{Q} select event_id, user_id as u, {cols} as value from q"
    add("param_count", _keyed("output b(u) spawn with user_id eval when u == user_id with b(u).offset(by: -1).defaults(to: 0) + 1", "b"), k(f"count(*) {per}"))
    add("param_running_sum", _keyed("output b(u) spawn with user_id eval when u == user_id with b(u)[-1].defaults(to: 0) + v", "b"), k(f"cast(sum(v) {per} as bigint)"))
    add("param_filtered_spawn", _keyed('output b(u) spawn with user_id when event_type == "purchase" eval when u == user_id && v > 500 with v', "b"), f"{Q} select event_id, user_id as u, v as value from (select *, count(*) filter (event_type = 'purchase') {per} as born from q) where born > 0 and v > 500")
    add("param_two_keys", _keyed("output b(u, e) spawn with (user_id, event_type) eval when u == user_id && e == event_type with max(b(u, e)[-1].defaults(to: 0), v)", "b"), f"{Q} select event_id, user_id as u, event_type as e, greatest(0, max(v) over (partition by user_id, event_type order by rn)) as value from q")
    add("param_close_reset", _keyed("output b(u) spawn with user_id close when b(u) == 5 eval when u == user_id with b(u)[-1].defaults(to: 0) + 1", "b"), k(f"(row_number() {per} - 1) % 5 + 1"))
    add("param_close_event", _keyed('output b(u) spawn with user_id close @v when event_type == "signup" eval when u == user_id with b(u)[-1].defaults(to: 0) + v', "b"), f"{Q}, s as (select *, count(*) filter (event_type = 'signup') over (order by rn rows between unbounded preceding and 1 preceding) as seg from q) select event_id, user_id as u, cast(sum(v) over (partition by user_id, seg order by rn) as bigint) as value from s")
    add("param_lookup_hold", _of_events("output b(u) spawn with user_id eval when u == user_id with b(u)[-1].defaults(to: 0) + v\noutput o @v := b(3).hold(or: -1)", "o"), e("coalesce(cast(sum(case when user_id = 3 then v end) over (order by rn) as bigint), -1) as o"))
    add("param_lookup_fresh", _of_events("output b(u) spawn with user_id eval when u == user_id with v\noutput o @v := b(3).is_fresh()", "o"), e("user_id = 3 as o"))
    add("param_window_target", _of_ticks("output b(u) spawn with user_id eval when u == user_id with v\noutput o @1h := b(3).aggregate(over: 24h, using: sum)", "o"), f"{TICKS} select t, cast(coalesce(sum(v), 0) as bigint) as o from tick left join q on q.ts > t - interval 24 hour and q.ts <= t and user_id = 3 group by t")
    both = "output b(u) spawn with user_id eval when u == user_id with v\noutput w(u) spawn with user_id eval @{} with b(u).aggregate(over: 24h, using: {})"
    add("param_window_both", _keyed(both.format("Global(6h)", "count"), "w", ticks=True), f"{Q}{_tick(6)}, s as (select user_id as u, min(ts) as born from q group by user_id) select t, u, count(v) as value from tick join s on born <= t left join q on q.user_id = u and q.ts > t - interval 24 hour and q.ts <= t group by t, u")
    add("param_local_tick", _keyed(both.format("6h", "sum"), "w", ticks=True), f"{Q}, s as (select user_id as u, min(ts) as born from q group by user_id), lt as (select u, born, born + n * interval 6 hour as t from s, range(1, 1000) r(n) where born + n * interval 6 hour <= (select max(ts) from q)) select t, u, cast(coalesce(sum(v), 0) as bigint) as value from lt left join q on q.user_id = u and q.ts > t - interval 24 hour and q.ts <= t and q.ts >= born group by t, u")

    first = lambda s, d: compile_spec(INPUTS + "output b(u) spawn with user_id eval when u == user_id with v", untimed(s, d)).changes().filter("change = 'Spawn'").select(F.col("seq").alias("event_id"), F.col("params").cast("bigint").alias("u"))
    add("param_first_spawn", first, f"{Q} select event_id, user_id as u from (select *, row_number() {per} as k from q) where k = 1")
    add("param_lag", _keyed("output b(u) spawn with user_id eval when u == user_id with v\noutput c(u) spawn with user_id eval when u == user_id with b(u).offset(by: -1).defaults(to: 0)", "c"), k(f"coalesce(lag(v) {per}, 0)"))
    add("param_lookup_value", _of_events("output b(u) spawn with user_id eval when u == user_id with b(u)[-1].defaults(to: 0) + v\noutput o @v := b(user_id % 7).hold(or: -1)", "o"), f"{Q}, s as (select user_id, rn, cast(sum(v) {per} as bigint) as total from q) select event_id, coalesce(s.total, -1) as o from q asof left join s on s.user_id = q.user_id % 7 and s.rn <= q.rn")
    add("param_all_instances", _keyed("output d(e) spawn with event_type eval @v when v > 20000 with v", "d"), f"{Q}, s as (select event_type as e, min(rn) as born from q group by event_type) select event_id, e, v as value from q join s on born <= rn where v > 20000")
    add("param_timed_close", _keyed("output b(u) spawn with user_id close @Global(24h) when v.hold(or: 0) > 5000 eval when u == user_id with b(u)[-1].defaults(to: 0) + v", "b", ticks=None), f"""{Q}{_tick(24)}, c as (select t from tick where (select arg_max(v, rn) from q e where e.ts <= tick.t) > 5000),
        s as (select q.*, (select count(*) from c where c.t < q.ts) as seg from q) select event_id, user_id as u, cast(sum(v) over (partition by user_id, seg order by rn) as bigint) as value from s""")
    add("unit_spawn", _of_events('output s spawn when event_type == "signup" close @v when event_type == "error" eval @v with v', "s"), f"""{Q}, l as (select *, count(*) filter (event_type = 'error') over (order by rn rows between unbounded preceding and 1 preceding) as life from q)
        select event_id, v as s from (select *, count(*) filter (event_type = 'signup') over (partition by life order by rn) as born from l) where born > 0""")

    # instance aggregations
    b = "output b(u) spawn with user_id eval when u == user_id with v\n"
    feed = f"{Q}, f as (select *, lag(v) over (partition by user_id order by rn) as old from q)"
    for name, using, sql in (
        ("inst_count_all", "count", "count(*) filter (old is null) over w"), ("inst_sum_all", "sum", "cast(sum(v - coalesce(old, 0)) over w as bigint)"),
        ("inst_avg", "avg", "cast(sum(v - coalesce(old, 0)) over w as bigint) // count(*) filter (old is null) over w"),
    ):
        add(name, _of_events(f"{b}output o @v := b.aggregate(over_instances: all, using: {using})", "o"), f"{feed} select event_id, {sql} as o from f window w as (order by rn)")
    boolean = "output b(u) spawn with user_id eval when u == user_id with v > 200\n"
    fb = f"{Q}, f as (select *, lag(v) over (partition by user_id order by rn) as old from q)"
    add("inst_forall", _of_events(f"{boolean}output o @v := b.aggregate(over_instances: all, using: forall)", "o"), f"{fb} select event_id, sum((v <= 200)::int - coalesce((old <= 200)::int, 0)) over (order by rn) = 0 as o from f")
    add("inst_exists", _of_events("output b(u) spawn with user_id eval when u == user_id with v > 40000\noutput o @v := b.aggregate(over_instances: all, using: exists)", "o"), f"{fb} select event_id, sum((v > 40000)::int - coalesce((old > 40000)::int, 0)) over (order by rn) > 0 as o from f")
    typed = 'output b(e) spawn with event_type eval when e == event_type with v\n'
    latest = f"{Q}, s as (select event_type, rn as lo, coalesce(lead(rn) over (partition by event_type order by rn), 9223372036854775807) as hi, v from q)"
    for name, using, sql in (("inst_min", "min", "min(s.v)"), ("inst_max", "max", "max(s.v)")):
        add(name, _of_events(f"{typed}output o @v := b.aggregate(over_instances: all, using: {using})", "o"), f"{latest} select event_id, {sql} as o from q join s on s.lo <= q.rn and q.rn < s.hi group by event_id")
    ftyped = "output b(e) spawn with event_type eval when e == event_type with value\n"
    flatest = latest.replace("hi, v from q", "hi, value as v from q")
    for name, using, sql in (("inst_var", "var", "coalesce(var_pop(s.v), 0)"), ("inst_sd", "sd", "coalesce(stddev_pop(s.v), 0)"), ("inst_median", "med", "quantile_cont(s.v, 0.5)")):
        run4 = _of_events(f"{ftyped}output o @v := b.aggregate(over_instances: all, using: {using})", "o")
        add(name, lambda s, d, r=run4: r(s, d).select("event_id", F.round(F.col("o") + OFF_TIES, 6).alias("o")), f"{flatest} select event_id, round({sql} + {OFF_TIES}, 6) as o from q join s on s.lo <= q.rn and q.rn < s.hi group by event_id")
    add("inst_fresh_sum", _of_events(f"{b}output o @v := b.aggregate(over_instances: fresh, using: sum)", "o"), e("v as o"))
    add("inst_where", _of_events(f"{b}output o @v := b.aggregate(over_instances: all(where: (u) => u > 5), using: sum)", "o"), f"{feed} select event_id, cast(coalesce(sum(v - coalesce(old, 0)) filter (user_id > 5) over (order by rn), 0) as bigint) as o from f")
    add("inst_distinct_users", _of_events("output s(u) spawn with user_id eval when u == user_id with true\noutput o @v := s.aggregate(over_instances: all, using: count)", "o"), f"{feed} select event_id, count(*) filter (old is null) over (order by rn) as o from f")

    group = "output k(e, u) spawn with (event_type, user_id) eval when e == event_type && u == user_id with v\noutput g(e) spawn with event_type eval when e == event_type with k.aggregate(over_instances: all(where: (x, y) => x == e), using: sum)"
    add("inst_group_by", _keyed(group, "g"), f"{Q}, f as (select *, lag(v) over (partition by event_type, user_id order by rn) as old from q) select event_id, event_type as e, cast(sum(v - coalesce(old, 0)) over (partition by event_type order by rn) as bigint) as value from f")
    add("fold_general", _folded("output x := (x[-1].defaults(to: 0) * 3 + v) % 1000", "x"), f"""with recursive p(k, up, down) as (select 0, 1, 1 union all select k + 1, up * 3 % 1000, down * 667 % 1000 from p where k < 99), {Q.removeprefix("with ")},
        s as (select q.*, sum(v % 1000 * p.down) over (order by rn) as total from q join p on p.k = rn % 100)
        select event_id, cast(total % 1000 * p.up % 1000 as bigint) as x from s join p on p.k = rn % 100""")

    # representations
    add("changes_feed", lambda s, d: compile_spec(INPUTS + "output b(u) spawn with user_id eval when u == user_id with v\noutput big eval when v > 10000 with v", untimed(s, d)).changes().select(F.col("seq").alias("event_id"), "stream", "change", "params", "value"), f"""{Q}, f as (select *, row_number() over (partition by user_id order by rn) as k from q)
        select event_id, 'b' as stream, 'Value' as change, user_id::varchar as params, v::varchar as value from f union all select event_id, 'b', 'Spawn', user_id::varchar, null from f where k = 1 union all select event_id, 'big', 'Value', null, v::varchar from f where v > 10000""")
    add("flagship_busy_types", flagship, f"{TICKS}, s as (select event_type as e, min(ts) as born from q group by event_type) select * from (select t, e, count(v) as value from tick join s on born <= t left join q on q.event_type = e and q.ts > t - interval 24 hour and q.ts <= t group by t, e) where value > 5")
    return c


def _orders(spark, sf_dir: str) -> DataFrame:
    """Weekly value of orders per priority on daily ticks."""
    start = origin(spark, sf_dir, "orders", "o_orderdate")
    raw = spark.read.parquet(f"{sf_dir}/orders.parquet")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    rows = raw.select(((_micros(F.col("o_orderdate")) - _micros(F.lit(start))) * 1000).alias(TS), F.col("o_orderkey").alias(SEQ), cents.alias("price"), F.col("o_orderpriority").alias("priority"))
    spec = """input price: Int64
    input priority: String
    output o(p) spawn with priority eval when p == priority with price
    output w(p) spawn with priority eval @Global(1d) with o(p).aggregate(over: 7d, using: sum)"""
    plan: Plan = compile_spec(spec, rows)
    return _time(plan.stream("w"), start).select("t", F.col("p").alias("priority"), F.col("value").alias("week"))


ORDERS = """with q as (select o_orderdate as ts, cast(round(o_totalprice * 100) as bigint) as v, o_orderpriority as p from orders),
b as (select date_trunc('day', min(ts)) as origin, max(ts) as hi from q), tick as (select origin + n * interval 1 day as t from b, range(1, 10000) r(n) where origin + n * interval 1 day <= hi),
s as (select p, min(ts) as born from q group by p),
d as (select p, case when ts = date_trunc('day', ts) then date_trunc('day', ts) else date_trunc('day', ts) + interval 1 day end as day, sum(v) as v from q group by 1, 2)
select t, s.p as priority, cast(coalesce(sum(v), 0) as bigint) as week from tick join s on born <= t or t <= date_trunc('day', born) and false left join d on d.p = s.p and d.day > t - interval 7 day and d.day <= t and d.day >= (select origin from b) + interval 0 day group by t, s.p"""


def _lineitem(spark, sf_dir: str) -> DataFrame:
    """Running quantity per supplier in order of shipping."""
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    seq = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    rows = raw.select((_micros(F.col("l_shipdate")) * 1000).alias(TS), seq.alias(SEQ), F.col("l_suppkey").alias("supp"), F.col("l_quantity").cast("bigint").alias("qty"))
    spec = """input supp: Int64
    input qty: Int64
    output r(s) spawn with supp eval when s == supp with r(s)[-1].defaults(to: 0) + qty"""
    out = compile_spec(spec, rows).stream("r")
    return out.select(F.call_function("div", F.col("seq"), F.lit(8)).alias("l_orderkey"), (F.col("seq") % 8).cast("int").alias("l_linenumber"), F.col("s").alias("l_suppkey"), F.col("value").alias("running"))


LINEITEM = "select l_orderkey, l_linenumber, l_suppkey, cast(sum(cast(l_quantity as bigint)) over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber rows unbounded preceding) as bigint) as running from lineitem"


def _customers(spark, sf_dir: str) -> DataFrame:
    """Orders with the balance that their customer has at the time: two kinds of events, and instances by a value of the other kind."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    start = origin(spark, sf_dir, "orders", "o_orderdate")
    states = read("customer").select(F.lit(0).cast("bigint").alias(TS), F.col("c_custkey").alias(SEQ), F.col("c_custkey").alias("cust"), cents("c_acctbal").alias("bal"))
    orders = read("orders").select(((_micros(F.col("o_orderdate")) - _micros(F.lit(start))) * 1000 + 1).alias(TS), F.col("o_orderkey").alias(SEQ), F.col("o_custkey").alias("buyer"), cents("o_totalprice").alias("price"))
    spec = """input cust: Int64
    input bal: Int64
    input buyer: Int64
    input price: Int64
    output state(c) spawn with cust eval when c == cust with bal
    output left @(buyer && price) := state(buyer).hold(or: 0) - price"""
    plan = compile_spec(spec, states.unionByName(orders, allowMissingColumns=True))
    return plan.stream("left").select(F.col("seq").alias("o_orderkey"), F.col("value").alias("left_over"))


CUSTOMERS = """select o_orderkey, coalesce(cast(round(c_acctbal * 100) as bigint), 0) - cast(round(o_totalprice * 100) as bigint) as left_over
from orders left join customer on c_custkey = o_custkey"""


def queries():
    found = {name: run for name, (run, _) in _catalogue().items()}
    return {**found, "orders_daily_window": _orders, "lineitem_running_qty": _lineitem, "customer_enrich_asof": _customers}


def oracle_sql():
    found = {name: sql for name, (_, sql) in _catalogue().items()}
    return {**found, "orders_daily_window": ORDERS, "lineitem_running_qty": LINEITEM, "customer_enrich_asof": CUSTOMERS}
