"""From a specification to DataFrames.

The cycle table has one row per event and per distinct deadline of a periodic stream,
ordered by (ts, kind, seq): at equal times events come before deadlines. An unkeyed
stream is a nullable column of it, null meaning no value in this cycle. A parameterised
stream is a relation with its parameters as columns. What has no relational form raises
``NotRelational``; ``tidewatch.api`` then runs the specification as an ordered fold.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aggregates, scalar
from ..lang.analysis import Analysis, base_type, is_tick, period_of, target, walk
from ..lang.syntax import E, SpecError, Stream, parse
from .trace import SLICE, Trace, slices

TS, KIND, SEQ = "__ts", "__kind", "__seq"
ORDER = [TS, KIND, SEQ]


class NotRelational(SpecError):
    """The specification needs the ordered fold."""


@dataclass
class Keyed:
    """Values of a parameterised stream: order columns, parameters, ``life``, ``value``; when instances are born and end (``ends``: order columns and parameters)."""

    df: DataFrame
    keys: list[str]
    closes: str | None = None  # column of the cycle table: how many closes came before
    every: int | None = None  # instances close at this many values
    births: DataFrame | None = None
    ends: DataFrame | None = None
    given: tuple = ()  # what instances are spawned with


@dataclass
class Unit:
    """Columns of the cycle table about a spawned stream without parameters: whether it lives, where it is born and ends, and the number of its life."""

    lives: str
    births: str
    ends: str | None
    life: str | None


@dataclass
class Plan:
    spec: object
    analysis: Analysis
    trace: Trace
    keyed: dict[str, Keyed] = field(default_factory=dict)
    units: dict[str, Unit] = field(default_factory=dict)

    def stream(self, name: str) -> DataFrame:
        """ts, kind, seq, parameters, value; one row per value."""
        if name in self.keyed:
            k = self.keyed[name]
            return k.df.select(F.col(TS).alias("ts"), F.col(KIND).alias("kind"), F.col(SEQ).alias("seq"), *k.keys, F.col("value"))
        return self.trace.df.filter(F.col(_c(name)).isNotNull()).select(F.col(TS).alias("ts"), F.col(KIND).alias("kind"), F.col(SEQ).alias("seq"), F.col(_c(name)).alias("value"))

    def table(self, *names: str) -> DataFrame:
        """The cycle table with the named streams as columns, cycles without any of them left out."""
        cols = [F.col(_c(n)).alias(n) for n in names]
        held = F.lit(False)
        for n in names:
            held = held | F.col(_c(n)).isNotNull()
        return self.trace.df.filter(held).select(F.col(TS).alias("ts"), F.col(KIND).alias("kind"), F.col(SEQ).alias("seq"), *cols)

    def triggers(self) -> DataFrame:
        """ts, kind, seq, trigger (its number), message."""
        out = []
        for i, s in enumerate(self.spec.triggers):
            out.append(F.struct(F.lit(i).alias("trigger"), F.col(_c(s.name)).alias("message")))
        if not out:
            raise SpecError("the specification has no trigger")
        hits = F.filter(F.array(*out), lambda x: x["message"].isNotNull())
        rows = self.trace.df.select(F.col(TS).alias("ts"), F.col(KIND).alias("kind"), F.col(SEQ).alias("seq"), F.explode(hits).alias("hit"))
        return rows.select("ts", "kind", "seq", "hit.trigger", "hit.message")

    def changes(self) -> DataFrame:
        """Spawn, Value and Close rows: ts, kind, seq, stream, change, params, value (as text)."""
        parts = []
        for s in self.spec.outputs:
            show = scalar.text(F.col("value"), self.analysis.stream_type(s) or "str")
            if s.name in self.keyed:
                k = self.keyed[s.name]
                params = F.concat_ws(", ", *[F.col(p).cast("string") for p in k.keys])
                when = [F.col(TS).alias("ts"), F.col(KIND).alias("kind"), F.col(SEQ).alias("seq"), F.lit(s.name).alias("stream")]
                parts.append(k.df.select(*when, F.lit("Value").alias("change"), params.alias("params"), show.alias("value")))
                for change, rows in (("Spawn", k.births), ("Close", k.ends)):
                    if rows is not None:
                        parts.append(rows.select(*when, F.lit(change).alias("change"), params.alias("params"), F.lit(None).cast("string").alias("value")))
            else:
                what = lambda rows, change, value: rows.select("ts", "kind", "seq", F.lit(s.name).alias("stream"), F.lit(change).alias("change"), F.lit(None).cast("string").alias("params"), value.alias("value"))  # noqa: E731, B023
                parts.append(what(self.stream(s.name), "Value", show))
                if s.name in self.units:
                    u = self.units[s.name]
                    for change, c in (("Spawn", u.births), ("Close", u.ends)):
                        if c is not None:
                            marked = self.trace.df.filter(F.col(c)).select(F.col(TS).alias("ts"), F.col(KIND).alias("kind"), F.col(SEQ).alias("seq"))
                            parts.append(what(marked, change, F.lit(None).cast("string")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def _c(name: str) -> str:
    return "s_" + name.replace("::", "__")


class Compiler:
    """events: ``__ts`` (nanoseconds since the start), ``__seq`` and a column per input."""

    def __init__(self, text: str, events: DataFrame, slice_rows: int | None = None, end: int | None = None):
        self.spec = parse(text)
        self.an = Analysis(self.spec)
        self.keyed: dict[str, Keyed] = {}
        self.units: dict[str, Unit] = {}
        self.end = end
        missing = [s.name for s in self.spec.inputs if s.name not in events.columns]
        if missing:
            raise SpecError(f"inputs without a column: {missing}")
        types = {s.name: scalar.sql_type(self.an.stream_type(s)) for s in self.spec.inputs}
        cols = [F.col(f"`{s.name}`").cast(types[s.name]).alias(_c(s.name)) for s in self.spec.inputs]
        rows = events.select(F.col(TS), F.lit(0).alias(KIND), F.col(SEQ), *cols)
        periods = sorted(self.an.periods())
        ordered = bool(periods) or self._needs_order()
        if ordered:
            low, high, n = rows.agg(F.min(TS), F.max(TS), F.count(F.lit(1))).first()
            high = max(high or 0, self.end or 0)
            self.low, self.end, self.n = low or 0, high, n
            if periods:
                rows = self._with_ticks(rows, periods, high)
            rows, n_slices = slices(rows, TS, low or 0, high, n, *([slice_rows] if slice_rows else []))
        else:
            n_slices = 1
            rows = rows.withColumn(SLICE, F.lit(0))
        self.trace = Trace(rows, ORDER, None, n_slices)

    def _needs_order(self) -> bool:
        return any(x.kind == "method" and x.value in ("hold", "offset", "aggregate") for s in self.spec.outputs for c in (s.spawn, *s.evals, s.close) if c for e in (c.when, c.value) if e for x in walk(e)) or any(s.spawn for s in self.spec.outputs)

    def _with_ticks(self, rows: DataFrame, periods: list[int], high: int) -> DataFrame:
        ticks = None
        for p in periods:
            n = high // p
            one = rows.sparkSession.range(1, n + 1).select((F.col("id") * F.lit(p)).alias(TS))
            ticks = one if ticks is None else ticks.unionByName(one)
        if len(periods) > 1:
            ticks = ticks.distinct()
        return rows.unionByName(ticks.select(TS, F.lit(1).alias(KIND), F.col(TS).alias(SEQ)), allowMissingColumns=True)

    def run(self) -> Plan:
        for s in self.an.order:
            if s.params:
                self._keyed(s)
            else:
                self._plain(s)
        return Plan(self.spec, self.an, self.trace, self.keyed, self.units)

    # activation
    def active(self, p: E) -> Column:
        if is_tick(p):
            if p.kind == "call" and p.value == "Local":
                raise NotRelational("local frequencies")
            return (F.col(KIND) == 1) & (F.col(TS) % F.lit(period_of(p)) == 0)
        if p.kind == "const":
            return F.col(KIND) == 0
        return self._fresh(p)

    def _fresh(self, p: E) -> Column:
        if p.kind == "name":
            return F.col(_c(p.value)).isNotNull()
        a, b = (self._fresh(x) for x in p.args)
        return a & b if p.value == "&&" else a | b

    def _closing(self, s: Stream, env: Env) -> tuple[Column, Column, str]:
        """Of closes that hit all instances: their marks, how many there were up to each cycle, and before it (they take effect after their cycle) as the name of a column."""
        if s.close.pacing is not None and is_tick(s.close.pacing) and not (s.close.pacing.kind == "call" and s.close.pacing.value == "Global"):
            raise NotRelational(f"{s.name} closes at deadlines that count from its spawn")
        mark = self.active(self.an.pacing(s, s.close)) & F.coalesce(env.col(s.close.when), F.lit(False))
        done = self.trace._new(F.when(mark, F.lit(1)))
        total = self.trace.running(done, "sum")
        return done, total, self.trace._named(F.coalesce(total, F.lit(0)) - F.coalesce(done, F.lit(0)))

    def _unit(self, s: Stream, env: Env) -> Column:
        """Whether the one instance of a spawned stream without parameters lives; a life begins with the first spawn after a close."""
        own = {x.value for c in (s.spawn, s.close) if c for e in (c.when, c.value) if e for x in walk(e) if x.kind in ("name", "call")}
        if s.name in own or any(is_tick(p := self.an.pacing(s, c)) and p.kind == "duration" for c in s.evals):
            raise NotRelational(f"the life of {s.name} depends on its own value or clock")
        if any(x.kind == "method" and x.args and target(x.args[0], self.spec) == s.name and x.value in ("offset", "aggregate") for o in self.spec.outputs for c in (o.spawn, *o.evals, o.close) if c for e in (c.when, c.value) if e for x in walk(e)):
            raise NotRelational(f"the past of {s.name}, which is spawned without parameters")
        spawns = self.active(self.an.pacing(s, s.spawn))
        if s.spawn.when is not None:
            spawns = spawns & F.coalesce(env.col(s.spawn.when), F.lit(False))
        life, done = F.lit(0), None
        if s.close is not None:
            done, _, name = self._closing(s, env)
            life = F.col(name)
        n = self.trace.running_in(F.when(spawns, F.lit(1)), life)
        lives = self.trace._named(F.coalesce(n > 0, F.lit(False)))
        births = self.trace._named(F.when(F.col(lives) & spawns & (n == 1), F.lit(True)))
        ends = None if done is None else self.trace._named(F.when(F.col(lives) & done.isNotNull(), F.lit(True)))
        self.units[s.name] = Unit(lives, births, ends, None if s.close is None else name)
        return F.col(lives)

    # plain streams
    def _plain(self, s: Stream) -> None:
        parts = []
        own_past = any(x.kind == "method" and x.value == "offset" and target(x.args[0], self.spec) == s.name for c in s.evals for e in (c.when, c.value) if e for x in walk(e))
        kind = self.an.stream_type(s)
        env = Env(self, self.trace, {})
        lives = self._unit(s, env) if s.spawn else None
        if own_past:
            if lives is not None:
                raise NotRelational(f"{s.name} is spawned and reads its own past")
            if len(s.evals) > 1:
                raise NotRelational(f"{s.name} reads its own past in several clauses")
            value = self._recursive(s, env)
        else:
            for c in s.evals:
                on = self.active(self.an.pacing(s, c))
                if c.when is not None:
                    on = on & F.coalesce(env.col(c.when), F.lit(False))
                if lives is not None:
                    on = on & lives
                v = env.col(c.value) if c.value is not None else F.lit(True)
                parts.append(F.when(on, v))
            value = F.coalesce(*parts)
        if kind and kind != "str":
            value = value.cast(scalar.sql_type(kind)) if not isinstance(kind, tuple) else value
        self.trace.df = self.trace.df.withColumn(_c(s.name), value)

    def _recursive(self, s: Stream, env: Env) -> Column:
        c = s.evals[0]
        on = self.active(self.an.pacing(s, c))
        if c.when is not None:
            if self._reads_past(c.when, s):
                raise NotRelational(f"{s.name}'s filter reads its own past")
            on = on & F.coalesce(env.col(c.when), F.lit(False))
        return env.accumulate(s, c.value, on)

    def _reads_past(self, e: E, s: Stream) -> bool:
        return any(x.kind == "method" and x.value == "offset" and target(x.args[0], self.spec) == s.name for x in walk(e))

    # parameterised streams
    def _keyed(self, s: Stream) -> None:
        names = [p for p, _ in s.params]
        if s.spawn is None or s.spawn.value is None:
            raise NotRelational(f"{s.name} has no spawn expression")
        given = s.spawn.value.args if s.spawn.value.kind == "tuple" and len(names) > 1 else (s.spawn.value,)
        base = Env(self, self.trace, {})
        spawn_on = self.active(self.an.pacing(s, s.spawn))
        if s.spawn.when is not None:
            spawn_on = spawn_on & F.coalesce(base.col(s.spawn.when), F.lit(False))
        if len(s.evals) != 1:
            raise NotRelational(f"{s.name} has several eval clauses")
        c = s.evals[0]
        pace = self.an.pacing(s, c)
        if is_tick(pace):
            return self._keyed_ticks(s, names, [self.trace._new(F.when(spawn_on, base.col(g))) for g in given], c, pace)
        # an instance lives from its spawn on; later cycles needn't meet the condition of the spawn
        key_cols = [self.trace._new(base.col(g)) for g in given]
        spawns = self.trace._new(spawn_on)
        always = s.spawn.when is None and self._implies(pace, self.an.pacing(s, s.spawn))
        rest = self._own_key(c.when, names, given)
        for_all = rest is None  # no filter that names the own key: all instances are evaluated
        if for_all:
            rest = [] if c.when is None else [c.when]
        # all that rows need of the cycle table, then the key columns
        life, closes, every = F.lit(0), None, None
        if s.close is not None:
            every = self._closes_itself(s, c)
            if every is not None and (for_all or not always):
                raise NotRelational(f"{s.name} closes itself and is spawned under a condition or evaluated for all instances")
            if every is None:
                if any(t == s.name or t in names for e in [s.close.when] for x in walk(e) for t in [x.value] if x.kind in ("name", "call")):
                    raise NotRelational(f"{s.name} is closed by its own value")
                done, total, closes = self._closing(s, base)
                life = F.col(closes)
        on = self.trace._new(self.active(pace))
        env = Env(self, self.trace, {})
        # what the clause reads of unkeyed streams must be a column before rows are taken out
        where = [env.outer(x, s.name, names) for x in rest]
        value = env.outer(c.value, s.name, names) if c.value is not None else E("const", True)
        df = self.trace.df.withColumn("__life", life)
        for n, k in zip(names, key_cols, strict=True):
            df = df.withColumn(f"__k_{n}", k)
        keys = [f"__k_{n}" for n in names]
        some = df.filter(F.col(keys[0]).isNotNull())
        lives = None
        if for_all:
            lives = some.filter(spawns).groupBy(*keys, "__life").agg(F.min(F.struct(*ORDER)).alias("__from"))
            if closes is not None:
                marks = self.trace.df.filter(done.isNotNull()).select(F.struct(*ORDER).alias("__next"), total.alias("__n"))
                lives = lives.join(marks, F.col("__life") + 1 == F.col("__n"), "left")
            else:
                lives = lives.withColumn("__next", F.lit(None).cast(lives.schema["__from"].dataType))
            some = self._during(self.trace.df.filter(on), lives.select(*keys, "__life", "__from", "__next"))
        rows = Trace(some, ORDER, [*keys, "__life"])
        inner = Env(self, rows, dict(zip(names, keys, strict=True)), self.an.param_types(s), s.name)
        inner.given = () if for_all else tuple(given)
        is_on = on
        if not always and not for_all:
            is_on = is_on & F.coalesce(rows.running(F.when(spawns, F.lit(True)), "or"), F.lit(False))
        for x in where:
            is_on = is_on & F.coalesce(inner.col(x), F.lit(False))
        if every is not None:
            n = rows.running(F.when(is_on, F.lit(1)), "sum")
            count = rows._new(F.when(is_on, (n - 1) % every + 1))
            before = F.coalesce(n, F.lit(0)) - F.when(is_on, F.lit(1)).otherwise(F.lit(0))
            rows.df = rows.df.withColumn("__life", F.call_function("div", before, F.lit(every)).cast("bigint"))
            v = count.cast("bigint")
        elif self._reads_past(value, s):
            v = inner.accumulate(s, value, is_on)
        else:
            v = F.when(is_on, inner.col(value))
        v = rows._new(v)
        kept = rows.df.filter(v.isNotNull()).withColumn("value", v)
        named = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
        out = kept.select(*ORDER, SLICE, *named, F.col("__life").alias("life"), "value")
        first = rows.df.filter(spawns).groupBy(*keys, "__life").agg(F.min(F.struct(*ORDER)).alias("__from")) if lives is None else lives
        births = first.select("__from.*", *named, F.col("__life").alias("life"))
        ends = None
        if every is not None:
            ends = out.filter(F.col("value") == every).select(*ORDER, *names, "life")
        elif closes is not None:  # the n-th close ends what was born after the one before it
            marks = self.trace.df.filter(done.isNotNull()).select(*ORDER, total.alias("__n"))
            ends = births.select(*names, "life").join(marks, F.col("life") + 1 == F.col("__n")).select(*ORDER, *names, "life")
        self.keyed[s.name] = Keyed(out, names, closes, every, births, ends, () if for_all else tuple(given))

    def _during(self, cycles: DataFrame, lives: DataFrame) -> DataFrame:
        """Each cycle with each life (``__from``, ``__next``: its last cycle) it falls into: an equi-join by pages of time."""
        pages = max(256, self.n // 100_000)
        page = max(1, (self.end - self.low + 1) // pages)
        at = lambda ts: F.call_function("div", ts - F.lit(self.low), F.lit(page))
        last = at(F.coalesce(F.col(f"__next.{TS}"), F.lit(self.end)))
        paged = lives.withColumn("__page", F.explode(F.sequence(at(F.col(f"__from.{TS}")), last)))
        now = F.struct(*ORDER)
        joined = cycles.withColumn("__page", at(F.col(TS))).join(paged, "__page")
        return joined.filter((F.col("__from") <= now) & (F.col("__next").isNull() | (now <= F.col("__next")))).drop("__page", "__from", "__next")

    def _implies(self, p: E, q: E) -> bool:
        """Whether cycles of event-based pacing p are cycles of q."""
        if q.kind == "const" or p == q:
            return True
        if q.kind == "bin":
            return (all if q.value == "&&" else any)(self._implies(p, x) for x in q.args)
        if p.kind == "bin":
            return (any if p.value == "&&" else all)(self._implies(x, q) for x in p.args)
        return False

    def _own_key(self, when: E | None, names: list[str], given) -> list[E] | None:
        """The filter without ``p == k`` for every parameter; None if some parameter has no such part."""
        parts: list[E] = []

        def split(e: E):
            if e.kind == "bin" and e.value == "&&":
                for x in e.args:
                    split(x)
            else:
                parts.append(e)

        if when is not None:
            split(when)
        for n, g in zip(names, given, strict=True):
            hit = next((p for p in parts if p.kind == "bin" and p.value == "==" and {p.args[0], p.args[1]} == {E("name", n), g}), None)
            if hit is None:
                return None
            parts.remove(hit)
        return parts

    def _closes_itself(self, s: Stream, c) -> int | None:
        """n for a counter that closes when it reaches n."""
        e = s.close.when
        own = lambda x: target(x, self.spec) == s.name
        if not (e and e.kind == "bin" and e.value == "==" and own(e.args[0]) and e.args[1].kind == "const"):
            return None
        v = c.value
        counts = v is not None and v.kind == "bin" and v.value == "+" and v.args[1] == E("const", 1) and self._past_default(v.args[0], s) == E("const", 0)
        return e.args[1].value if counts else None

    def _past_default(self, e: E, s: Stream) -> E | None:
        """c of ``s.offset(by: -1).defaults(to: c)``."""
        if e.kind == "method" and e.value == "defaults" and (o := e.args[0]).kind == "method" and o.value == "offset" and target(o.args[0], self.spec) == s.name and (o.arg("by") or o.args[1]) == E("const", -1):
            return e.arg("to")
        return None

    def _keyed_ticks(self, s: Stream, names, key_cols, c, pace) -> None:
        """Instances evaluated at ticks, global or from their spawn on: each instance is joined with its ticks."""
        if s.close is not None or c.when is not None:
            raise NotRelational("closed or filtered periodic instances")
        local = pace.kind != "call" or pace.value != "Global"
        period = period_of(pace)
        df = self.trace.df
        for n, k in zip(names, key_cols, strict=True):
            df = df.withColumn(n, k)
        born = df.filter(F.col(names[0]).isNotNull()).groupBy(*names).agg(F.min(F.struct(*ORDER)).alias("born"))
        first = F.col(f"born.{TS}") + period if local else (F.call_function("div", F.col(f"born.{TS}") - 1, F.lit(period)) + 1) * period
        first = F.when(F.col(f"born.{TS}") <= 0, F.lit(period)).otherwise(first) if not local else first
        grid = born.filter(first <= self.end).select(*names, F.col(f"born.{TS}").alias("__born"), F.explode(F.sequence(first, F.lit(self.end), F.lit(period))).alias(TS))
        w = c.value
        inner = w.args[0] if w.kind == "method" and w.value == "defaults" else w
        if not (inner.kind == "method" and inner.value == "aggregate" and inner.arg("over") is not None):
            raise NotRelational("periodic instances other than windows")
        span, name = inner.arg("over").value, aggregates.canonical(inner.arg("using").value)
        t = target(inner.args[0], self.spec)
        kind = self.an.stream_type(self.spec[t])
        if t in self.keyed:
            source = self.keyed[t]
            if [x.value for x in inner.args[0].args] != names:
                raise NotRelational("window over another instance")
            on = dict(zip(source.keys, names, strict=True))
            values = source.df.select(F.col(TS).alias("__t"), *[F.col(k).alias(n) for k, n in on.items()], F.struct(*ORDER).alias("__o"), F.col("value").alias("__v"))
        else:
            raise NotRelational("periodic windows of instances over unkeyed streams")
        # each value goes to the ticks whose window it is in; values that merge, as partial results of their pane
        values = values.join(born.select(*names, F.col(f"born.{TS}").alias("__born")), names)
        pane = F.ceil((F.col("__t") - (F.col("__born") if local else F.lit(0))) / period).cast("bigint")
        values = values.withColumn("__pane", F.greatest(F.lit(0), pane)).filter((F.col("__t") >= F.col("__born")) if local else F.lit(True))
        base = F.col("__born") if local else F.lit(0).cast("bigint")
        # what comes at the start itself is a pane of its own, before the first tick
        start = base + F.greatest(F.lit(1), F.col("__pane")) * period
        parts = aggregates.partials(name, F.col("__v"), kind, F.col("__o")) if span % period == 0 else None
        if parts is not None:
            hits = values.groupBy(*names, "__born", "__pane").agg(*[p.alias(c) for c, p in parts.items()])
            last = F.least(F.lit(self.end), base + F.col("__pane") * period + span - period)
        else:
            hits, last = values, F.least(F.lit(self.end), F.col("__t") + span - 1)
        kept = list(parts) if parts is not None else ["__t", "__o", "__v"]
        hits = hits.withColumn("__start", start).withColumn("__last", last).filter("__start <= __last")
        hits = hits.select(*names, *kept, F.explode(F.sequence("__start", "__last", F.lit(period))).alias(TS))
        whole = aggregates.merged(name, kind, F.col) if parts is not None else aggregates.over_rows(name, F.col("__v"), kind, F.col("__o"), F.col("__t"))
        agg = hits.groupBy(*names, TS).agg(whole.alias("value"))
        out = grid.join(agg, [*names, TS], "left")
        value = aggregates.when_empty(name, F.col("value"), kind)
        if w is not inner:
            value = F.coalesce(value, F.lit(w.arg("to").value))
        out = out.select(F.col(TS), F.lit(1).alias(KIND), F.col(TS).alias(SEQ), F.lit(0).alias(SLICE), *names, F.lit(0).alias("life"), value.alias("value")).filter(F.col("value").isNotNull())
        births = born.select("born.*", *names)
        self.keyed[s.name] = Keyed(out, names, births=births)


class Env:
    """Expressions to columns of a trace."""

    def __init__(self, compiler: Compiler, trace: Trace, params: dict[str, str], param_types: dict | None = None, own: str | None = None):
        self.c, self.trace, self.params, self.types, self.own = compiler, trace, params, param_types or {}, own
        self.spec, self.an = compiler.spec, compiler.an
        self.given: tuple = ()

    def type(self, e: E):
        if e.kind == "column":
            return e.value[1]
        return self.an.type_of(e, {**self.types})

    def outer(self, e: E, own: str, names: list[str]) -> E:
        """e with accesses of unkeyed streams made columns of the cycle table."""
        t = target(e.args[0], self.spec) if e.kind == "method" and e.args else target(e, self.spec)
        if t in self.c.keyed and e.kind == "method" and any(x.kind == "name" and x.value in names for y in (*e.args[0].args, *(z for k, z in e.named if k == "over_instances" for _, z in z.named)) for x in walk(y)):
            return e  # an access by the instance's own parameters
        if t is not None and t != own and t not in names and e.kind == "method" and e.value in ("hold", "offset", "get", "is_fresh", "aggregate"):
            rest = tuple((k, x) for k, x in e.named if k not in ("or",))
            bare = E("method", e.value, e.args, rest)
            out: E = E("column", (self.trace._new(self.col(bare)), self.type(e)))
            return E("method", "defaults", (out,), (("to", self.outer(e.arg("or"), own, names)),)) if e.arg("or") is not None else out
        if e.kind == "name" and e.value in names or not e.args and not e.named:
            return e
        if t == own and e.kind == "method":
            return e
        return E(e.kind, e.value, tuple(self.outer(x, own, names) for x in e.args), tuple((k, self.outer(x, own, names) if isinstance(x, E) else x) for k, x in e.named))

    def col(self, e: E) -> Column:
        k = e.kind
        if k == "column":
            return e.value[0]
        if k == "const":
            return F.lit(e.value)
        if k == "name" and e.value in self.params:
            return F.col(self.params[e.value])
        if k in ("name", "call") and (t := target(e, self.spec)):
            if t in self.c.keyed:
                return self._instance(t, e.args) if self._constant(e.args) else self._instance_now(t, e.args)
            return F.col(_c(t))
        if k == "tuple":
            return F.struct(*[self.col(x).alias(f"_{i}") for i, x in enumerate(e.args)])
        if k == "item":
            return self.col(e.args[0])[f"_{e.value}"]
        if k == "if":
            c, a, b = e.args
            return F.when(self.col(c), self._as(a, e)).otherwise(self._as(b, e))
        if k == "un":
            return scalar.unary(e.value, self.col(e.args[0]))
        if k == "bin":
            a, b = e.args
            ta, tb = self.type(a), self.type(b)
            if "uint" in (ta, tb) and self.type(e) == "uint":
                ta = tb = "uint"
            return scalar.binary(e.value, self.col(a), self.col(b), ta, tb, b.value if b.kind == "const" else None)
        if k == "call":
            return self._function(e.value, e.args, e.named)
        if k == "method":
            return self._method(e)
        raise SpecError(f"{k} can't stand here")

    def _as(self, x: E, whole: E) -> Column:
        a, kind = self.col(x), self.type(whole)
        return a.cast("double") if kind == "float" and self.type(x) in scalar.INTS else a

    def _function(self, name: str, args, named) -> Column:
        to = dict(named).get("type")
        args = [*args, *(x for k, x in named if k != "type")]
        consts = [x.value if x.kind == "const" else None for x in args]
        return scalar.function(name, [(self.col(x), self.type(x)) for x in args], consts, base_type(to.value) if to is not None else None)

    def _method(self, e: E) -> Column:
        name, x = e.value, e.args[0]
        if name == "defaults":
            return F.coalesce(self.col(x), self.col(e.arg("to") or e.args[1]))
        if name == "hold":
            held = self._held(x)
            return F.coalesce(held, self.col(e.arg("or"))) if e.arg("or") is not None else held
        if name == "get":
            return self.col(x)
        if name == "is_fresh":
            return self.col(x).isNotNull()
        if name == "offset":
            self._own_rows(x)
            return self.trace.previous(self.col(x), -(e.arg("by") or e.args[1]).value)
        if name == "aggregate":
            return self._aggregate(e)
        return self._function(name, e.args, e.named)

    def _constant(self, args) -> bool:
        return self.trace.keys is None and all(a.kind == "const" for a in args)

    def _own_rows(self, x: E) -> None:
        """Earlier values of an instance by values can be counted only where every one of them has a row here: in instances that are spawned with the same."""
        t = target(x, self.spec)
        if t in self.c.keyed and not self._constant(x.args):
            k = self.c.keyed[t]
            if not k.given or k.given != self.given or [a.value for a in x.args] != list(self.params) or k.closes is not None or k.every:
                raise NotRelational(f"the past of an instance of {t} by values")

    def _by_keys(self, t: str, args) -> dict[str, Column]:
        """Columns of this trace with the parameters of the instance that is read."""
        k = self.c.keyed[t]
        if k.every or self.trace.keys is not None and not all(a.kind == "const" or a.kind == "name" and a.value in self.params for a in args):
            raise NotRelational(f"an instance of {t} by values of an instance")
        return {n: self.trace._new(self.col(a)) for n, a in zip(k.keys, args, strict=True)}

    def _instance_now(self, t: str, args) -> Column:
        """The present value of an instance by parameters that are values."""
        k, keys = self.c.keyed[t], self._by_keys(t, args)
        self.trace.n += 1
        mark = f"__i{self.trace.n}_{len(self.trace.df.columns)}"
        own = k.df.select(*ORDER, *[F.col(n).alias(f"{mark}_{n}") for n in keys], F.col("value").alias(mark))
        self.trace.df = self.trace.df.withColumns({f"{mark}_{n}": c for n, c in keys.items()}).join(own, [*ORDER, *[f"{mark}_{n}" for n in keys]], "left").drop(*[f"{mark}_{n}" for n in keys])
        return F.col(mark)

    def _held(self, x: E) -> Column:
        t = target(x, self.spec)
        if t in self.c.keyed and not self._constant(x.args):
            k = self.c.keyed[t]
            return self.trace.latest(k.df, self._by_keys(t, x.args), {"value": "last"}, k.ends)["value"]
        if t in self.c.units and self.c.units[t].life is not None:
            if self.trace.keys is not None:
                raise NotRelational(f"{t} closes")
            life = F.col(self.c.units[t].life)
            last = self.trace.running(F.when(self.col(x).isNotNull(), F.struct(life.alias("life"), self.col(x).alias("value"))), "last")
            return F.when(last["life"] == life, last["value"])
        if t in self.c.keyed and self.c.keyed[t].closes is not None:
            k = self.c.keyed[t]
            v = self._instance(t, x.args, with_life=True)
            last = self.trace.running(v, "last")
            return F.when(last["life"] == F.col(k.closes), last["value"])
        if t in self.c.keyed and self.c.keyed[t].every:
            # after its last value an instance is gone, from the next cycle on
            n = self.c.keyed[t].every
            v = self._instance(t, x.args)
            last = self.trace.running(v, "last")
            return F.when((last < n) | v.isNotNull(), last)
        return self.trace.running(self.col(x), "last")

    def _instance(self, t: str, args, with_life: bool = False) -> Column:
        """Values of one instance, by constant parameters, as a column of the trace."""
        k = self.c.keyed[t]
        if self.trace.keys is not None or any(a.kind != "const" for a in args):
            raise NotRelational(f"an instance of {t} that isn't constant")
        own = k.df
        for n, a in zip(k.keys, args, strict=True):
            own = own.filter(F.col(n) == F.lit(a.value))
        self.trace.n += 1
        name = f"__i{self.trace.n}_{len(self.trace.df.columns)}"
        v = F.struct("life", "value") if with_life else F.col("value")
        self.trace.df = self.trace.df.join(own.select(*ORDER, v.alias(name)), ORDER, "left")
        return F.col(name)

    # recursion
    def accumulate(self, s: Stream, e: E, on: Column) -> Column:
        """A stream of its own previous value, where that is a running aggregate."""
        past = lambda x: self.c._past_default(x, s)
        mine = lambda x: self.c._reads_past(x, s)
        if e.kind == "bin" and e.value in ("+", "&&", "||", "-"):
            a, b = e.args
            if mine(b) and not mine(a) and e.value != "-":
                a, b = b, a
            start = past(a)
            if start is not None and not mine(b):
                x = self.trace._new(F.when(on, self.col(b)))
                if e.value in "+-":
                    total = self.trace.running(x, "sum")
                    total = self.col(start) + (total if e.value == "+" else -total)
                else:
                    every = self.trace.running(x, "and" if e.value == "&&" else "or")
                    total = (self.col(start) & every) if e.value == "&&" else (self.col(start) | every)
                return F.when(x.isNotNull(), total)
        if e.kind == "call" and e.value in ("min", "max"):
            a, b = e.args if past(e.args[0]) is not None else e.args[::-1]
            start = past(a)
            if start is not None and not mine(b):
                x = self.trace._new(F.when(on, self.col(b)))
                best = self.trace.running(x, e.value)
                return F.when(x.isNotNull(), (F.least if e.value == "min" else F.greatest)(self.col(start), best))
        if e.kind == "un" and e.value == "!" and past(e.args[0]) is not None:
            n = self.trace.running(F.when(on, F.lit(1)), "sum")
            start = self.col(past(e.args[0]))
            return F.when(on, F.when(n % 2 == 1, ~start).otherwise(start))
        if e.kind == "if" and not mine(e.args[0]) and not mine(e.args[1]) and e.args[2].kind == "bin" and e.args[2].value == "+":
            a, b = e.args[2].args
            start = past(a)
            if start is not None and not mine(b):
                reset = self.trace._new(F.when(on, self.col(e.args[0])))
                part = self.trace._new(F.coalesce(self.trace.running(F.when(reset, F.lit(1)), "sum"), F.lit(0)))
                x = self.trace._new(F.when(on, F.when(reset, self.col(e.args[1])).otherwise(self.col(b))))
                total = self.trace.running_in(x, part)
                return F.when(x.isNotNull(), F.when(part == 0, self.col(start) + total).otherwise(total))
        raise NotRelational(f"{s.name} is no running aggregate")

    # windows
    def _aggregate(self, e: E) -> Column:
        name = aggregates.canonical(e.arg("using").value)
        x, kind = e.args[0], self.type(e.args[0])
        if (n := e.arg("over_discrete") or e.arg("over_exactly_discrete")) is not None:
            self._own_rows(x)
            held = self._framed(x, n.value, name, kind)
            value = held[name] if name in aggregates.FRAMED else aggregates.over_array(name, held["values"], kind)
            value = aggregates.when_empty(name, value, kind)
            return value if e.arg("over_discrete") is not None else F.when(held["n"] == n.value, value)
        if e.arg("over_instances") is not None:
            return self._instances(e, name, kind)
        exact = e.arg("over_exactly")
        return self._time_window(x, (exact or e.arg("over")).value, name, kind, exact is not None)

    def _framed(self, x: E, n: int, name: str, kind) -> Column:
        """A struct of aggregations over the last n values of x: of a stream by name all that the specification asks for, at once."""
        if x.kind == "name" and (x.value, n) in self.trace.framed:
            return self.trace.framed[x.value, n]
        names = {name}
        if x.kind == "name":
            for e in (y for s in self.spec.outputs for c in (s.spawn, *s.evals, s.close) if c for z in (c.when, c.value) if z for y in walk(z)):
                size = (e.arg("over_discrete") or e.arg("over_exactly_discrete")) if e.kind == "method" and e.value == "aggregate" else None
                if size is not None and e.args[0] == x and size.value == n:
                    names.add(aggregates.canonical(e.arg("using").value))
        over = {a: (lambda v, w, a=a: aggregates.over_frame(a, v, kind, w)) for a in sorted(names) if a in aggregates.FRAMED}
        if len(over) < len(names):
            over["values"] = lambda v, w: F.collect_list(v).over(w)
        held = self.trace.frame(self.col(x), n, over)
        if x.kind == "name":
            self.trace.framed[x.value, n] = held
        return held

    def _time_window(self, x: E, span: int, name: str, kind, exactly: bool) -> Column:
        """Values of (t - span, t] at every tick t, through panes where partial results merge."""
        if self.trace.keys is not None:
            raise NotRelational("time windows of instances")
        t = target(x, self.spec)
        started = F.lit(0)
        if t in self.c.keyed:
            k = self.c.keyed[t]
            rows = k.df
            for n, a in zip(k.keys, x.args, strict=True):
                if a.kind != "const":
                    raise NotRelational("windows over an instance that isn't constant")
                rows = rows.filter(F.col(n) == F.lit(a.value))
            if exactly:
                raise NotRelational("exact windows over instances")
            rows = rows.select(*ORDER, F.col("value").alias("__v"))
        else:
            rows = self.trace.df.filter(self.col(x).isNotNull()).select(*ORDER, self.col(x).alias("__v"))
        periods = sorted(self.c.an.periods())
        step = periods[0]
        if any(p % step for p in periods):
            raise NotRelational("time windows over periods that are no multiples")
        end = self.c.end
        order, v = F.struct(*ORDER), F.col("__v")
        parts = aggregates.partials(name, v, kind, order) if span % step == 0 else None
        self.trace.n += 1
        out = f"__w{self.trace.n}_{len(self.trace.df.columns)}"
        first = F.greatest(F.lit(1), F.ceil(F.col(TS) / step)).cast("bigint") * step
        if parts is not None:
            # what comes at the start itself is a pane of its own, before the first tick
            panes = rows.groupBy((F.greatest(F.lit(0), F.ceil(F.col(TS) / step)).cast("bigint") * step).alias("__pane")).agg(*[p.alias(c) for c, p in parts.items()])
            last = F.least(F.lit(end // step * step), F.col("__pane") + span - step)
            panes = panes.withColumn("__first", F.greatest(F.col("__pane"), F.lit(step))).withColumn("__last", last).filter("__first <= __last")
            hits = panes.select(*parts, F.explode(F.sequence("__first", "__last", F.lit(step))).alias(TS)) if end >= step else None
            agg = hits.groupBy(TS).agg(aggregates.merged(name, kind, F.col).alias(out)) if hits is not None else None
        else:
            last = F.least(F.lit(end), F.col(TS) + span - 1)
            hits = rows.withColumn("__at", first).filter(F.col("__at") <= last)
            hits = hits.select(order.alias("__o"), F.col(TS).alias("__t"), "__v", F.explode(F.sequence("__at", last, F.lit(step))).alias("__tick"))
            agg = hits.groupBy(F.col("__tick").alias(TS)).agg(aggregates.over_rows(name, v, kind, F.col("__o"), F.col("__t")).alias(out))
        if agg is None:
            return aggregates.when_empty(name, F.lit(None).cast("double"), kind)
        agg = agg.withColumn(KIND, F.lit(1))
        self.trace.df = self.trace.df.join(agg, [TS, KIND], "left")
        value = aggregates.when_empty(name, F.col(out), kind)
        return F.when(F.col(TS) - started >= span, value) if exactly else value

    def _instances(self, e: E, name: str, kind) -> Column:
        """Over the latest values of instances: a feed of changes for what can be taken back, an aggregate of the cycle for fresh ones."""
        t = target(e.args[0], self.spec)
        if t not in self.c.keyed:
            raise NotRelational("instances of a stream that isn't keyed")
        k = self.c.keyed[t]
        which = e.arg("over_instances")
        # values and ends (of no value, in force from the next cycle on) of instances
        rows = k.df.select(*ORDER, *k.keys, "life", "value", F.lit(0).alias("__tag"))
        if k.ends is not None and which.value != "fresh":
            rows = rows.unionByName(k.ends.select(*ORDER, *k.keys, "life", F.lit(1).alias("__tag")), allowMissingColumns=True)
        of: dict[str, Column] = {}  # parameters of the instances that must be the caller's
        if which.kind == "call":
            body = which.named[0][1]
            names = body.value
            condition, equal = self._grouping(body, t)
            if self.trace.keys is not None and not equal:
                raise NotRelational("an aggregate over instances for each instance")
            of = {k.keys[names.index(n)]: F.col(self.params[p]) for n, p in equal}
            body = E("lambda", names, (condition,))
            inner = Env(self.c, Trace(rows, ORDER, []), dict(zip(names, k.keys, strict=True)), self.an.param_types(self.spec[t]))
            if any(target(x, self.spec) and x.value not in names for x in walk(body.args[0])):
                raise NotRelational("a condition on instances that reads streams")
            rows = rows.filter(inner.col(body.args[0]))
        elif self.trace.keys is not None:
            raise NotRelational("an aggregate over instances for each instance")
        self.trace.n += 1
        out = f"__a{self.trace.n}_{len(self.trace.df.columns)}"
        if of and (which.value == "fresh" or name not in ("forall", "exists", "count", "sum", "avg")):
            raise NotRelational(f"{name} over groups of instances")
        if which.value == "fresh":
            agg = rows.groupBy(*ORDER).agg(aggregates.over_rows(name, F.col("value"), kind, F.col(TS), F.col(TS)).alias(out))
            self.trace.df = self.trace.df.join(agg, ORDER, "left")
            return aggregates.when_empty(name, F.col(out), kind)
        if of and k.ends is not None:
            raise NotRelational("groups of instances that close")
        feed = rows.withColumn("__old", F.lag("value").over(Window.partitionBy(*k.keys, "life").orderBy(*ORDER, "__tag")))
        one = lambda c: F.when(c.isNull(), F.lit(0)).otherwise(F.lit(1))
        add = lambda now, old: (F.coalesce(now, F.lit(0)) - F.coalesce(old, F.lit(0)))
        v, old = F.col("value"), F.col("__old")
        if name in ("forall", "exists"):
            bad = name == "forall"
            hit = lambda c: F.when(c == F.lit(not bad), F.lit(1)).otherwise(F.lit(0))
            delta = {"d": hit(v) - hit(old)}
        elif name == "count":
            delta = {"d": one(v) - one(old)}
        elif name in ("sum", "avg"):
            delta = {"d": add(v, old), "n": one(v) - one(old)}
        elif name in ("min", "max", "var", "sd", "product") or name.startswith("pctl"):
            return self._validity(rows, k, name, kind, out)
        else:
            raise NotRelational(f"{name} over instances")
        now, later = F.col("__tag") == 0, F.col("__tag") == 1
        sums = [F.sum(F.when(now, c)).alias(f"{out}{n}") for n, c in delta.items()]
        if k.ends is not None:
            sums += [F.sum(F.when(later, c)).alias(f"{out}{n}_later") for n, c in delta.items()]
        agg = feed.groupBy(*ORDER, *of).agg(*sums)
        if of:
            found = self.trace.latest(agg, of, {f"{out}{n}": "sum" for n in delta})
            total = {n: found[f"{out}{n}"] for n in delta}
        else:
            self.trace.df = self.trace.df.join(agg, ORDER, "left")
            total = {n: self.trace.running(F.col(f"{out}{n}"), "sum") for n in delta}
            if k.ends is not None:
                for n in delta:
                    after = F.coalesce(self.trace.running(F.col(f"{out}{n}_later"), "sum") - F.coalesce(f"{out}{n}_later", F.lit(0)), F.lit(0))
                    total[n] = self.trace._new(total[n] + after)
        if name == "forall":
            return F.coalesce(total["d"] == 0, F.lit(True))
        if name == "exists":
            return F.coalesce(total["d"] > 0, F.lit(False))
        if name == "avg":
            return F.when(total["n"] > 0, scalar.quotient(total["d"], total["n"], kind))
        return aggregates.when_empty(name, total["d"], kind)

    def _grouping(self, body: E, t: str) -> tuple[E, list[tuple[str, str]]]:
        """A condition on instances without its parts ``x == p`` for a parameter p of the caller, and these as (x, p)."""
        rest, equal = [], []

        def split(e: E):
            if e.kind == "bin" and e.value == "&&":
                for x in e.args:
                    split(x)
                return
            if e.kind == "bin" and e.value == "==" and all(x.kind == "name" for x in e.args):
                a, b = (x.value for x in e.args)
                a, b = (a, b) if a in body.value else (b, a)
                if a in body.value and b in self.params and b not in body.value:
                    equal.append((a, b))
                    return
            rest.append(e)

        split(body.args[0])
        out = rest[0] if rest else E("const", True)
        for e in rest[1:]:
            out = E("bin", "&&", (out, e))
        return out, equal

    def _validity(self, rows: DataFrame, k: Keyed, name: str, kind, out: str) -> Column:
        """For what can't be taken back: every value holds from its cycle to the one before the instance's next, or to its end.

        Cycles are numbered and their ranges cut into the nodes of a tree of width WIDTH, as
        those of a segment tree are. A value is aggregated into the few nodes that make up
        its range, a cycle reads the nodes above it; so no cycle meets all instances.
        Percentiles need the values themselves.
        """
        number = self.trace._named(self.trace.running(F.lit(1), "count") - 1)
        cycles = self.trace.df.select(*ORDER, F.col(number).alias("__now"))
        levels = max(1, math.ceil(math.log(max(2, self.c.n + 1), WIDTH)) + 1)
        w = Window.partitionBy(*k.keys, "life").orderBy("__now", "__tag")
        after = F.coalesce(F.lead(F.col("__now") + F.col("__tag")).over(w), F.lit(2**62))
        last = rows.join(cycles, ORDER).withColumn("__stop", after).filter("__tag = 0")
        spans = last.select("value", F.explode(_nodes(F.col("__now"), F.least(F.col("__stop"), F.lit(WIDTH**levels)), levels)).alias("__node"))
        above = F.array(*[F.lit(i << 56) + F.call_function("div", F.col("__now"), F.lit(WIDTH**i)) for i in range(levels)])
        places = cycles.select(*ORDER, F.explode(above).alias("__node"))
        if name.startswith("pctl"):
            agg = places.join(spans, "__node").groupBy(*ORDER).agg(F.percentile("value", int(name[4:]) / 100).alias(out))
        else:
            v = F.col("value")
            parts = {"v": aggregates.over_rows(name, v, kind)} if name in ("min", "max", "product") else {"n": F.count(v), "m": F.avg(v), "q": F.var_pop(v) * F.count(v)}
            per_node = spans.groupBy("__node").agg(*[p.alias(f"__{c}") for c, p in parts.items()])
            hits = places.join(per_node, "__node").groupBy(*ORDER)
            if name in ("min", "max", "product"):
                agg = hits.agg({"min": F.min, "max": F.max, "product": F.product}[name]("__v").alias(out))
            else:
                agg = hits.agg(F.collect_list(F.struct("__n", "__m", "__q")).alias("l")).select(*ORDER, aggregates.merged_variance("l", name).alias(out))
        self.trace.df = self.trace.df.join(agg, ORDER, "left")
        return aggregates.when_empty(name, F.col(out), kind)


#: Children of a node of the tree over cycles.
WIDTH = 16


def _nodes(start: Column, stop: Column, levels: int) -> Column:
    """The nodes (level << 56 | place) that make up the places from start up to before stop."""
    empty = F.expr("cast(array() as array<bigint>)")

    def run(first, end, level):
        return F.when(first < end, F.transform(F.sequence(first, F.greatest(first, end - 1)), lambda i: level * F.lit(1 << 56) + i)).otherwise(empty)

    def step(acc, level):
        up = F.call_function("div", acc["l"] + (WIDTH - 1), F.lit(WIDTH)) * WIDTH
        down = F.call_function("div", acc["r"], F.lit(WIDTH)) * WIDTH
        whole = up >= down
        own = F.when(whole, run(acc["l"], acc["r"], level)).otherwise(F.concat(run(acc["l"], up, level), run(down, acc["r"], level)))
        to = lambda c: F.when(whole, F.lit(0).cast("bigint")).otherwise(F.call_function("div", c, F.lit(WIDTH)))
        return F.struct(to(up).alias("l"), to(down).alias("r"), F.concat(acc["nodes"], own).alias("nodes"))

    begin = F.struct(start.cast("bigint").alias("l"), stop.cast("bigint").alias("r"), empty.alias("nodes"))
    return F.aggregate(F.array(*[F.lit(i).cast("bigint") for i in range(levels)]), begin, step, lambda acc: acc["nodes"])


def compile_spec(text: str, events: DataFrame, **options) -> Plan:
    return Compiler(text, events, **options).run()
