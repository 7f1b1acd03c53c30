"""What slices take over from those before them: right on sparse traces, and without the plan growing with every stream."""

import random

import pytest

from tidewatch.plans.compiler import compile_spec
from tidewatch.plans.trace import slices
from tidewatch.streaming import machine

S = 1_000_000_000
HEAD = "input a: Int64\ninput f: Float64\n"
STATS = "\n".join(f"output {n} := a.aggregate(over_discrete: 10, using: {n}).defaults(to: 0)" for n in ("avg", "min", "max", "count", "last"))


def frame(spark, rows):
    return spark.createDataFrame([(t, i, r["a"], r["f"]) for i, (t, r) in enumerate(rows)], "__ts long, __seq long, a long, f double")


def bursts(seed):
    """Bursts with pauses longer than a slice, and stretches without a value of a."""
    r = random.Random(seed)
    t, out = 0, []
    for k in range(80):
        t += r.choice([0, 1, 1, 2]) * S + (200 * S if k % 25 == 24 else 0)
        out.append((t, {"a": r.randint(-9, 9) if k < 30 or k > 55 and r.random() < 0.5 else None, "f": r.randint(-20, 20) / 8 if r.random() < 0.5 else None}))
    return out


@pytest.mark.parametrize("slice_rows", [3, 9, 1000])
def test_count_windows_and_offsets_over_slices(spark, slice_rows):
    spec = HEAD + STATS + """
    output v @true := f.aggregate(over_discrete: 7, using: var)
    output sd := f.aggregate(over_discrete: 7, using: sd)
    output m @true := a.aggregate(over_discrete: 7, using: med).defaults(to: -1)
    output s @true := a.aggregate(over_discrete: 7, using: sum)
    output x @true := a.aggregate(over_exactly_discrete: 20, using: sum).defaults(to: -1)
    output o @true := a.offset(by: -4).defaults(to: -99)
    output p := f.offset(by: -1).defaults(to: 0.5)
    output big := a > 3
    output e @true := big.aggregate(over_discrete: 4, using: exists)"""
    rows = bursts(slice_rows)
    plan = compile_spec(spec, frame(spark, rows), slice_rows=slice_rows)
    want: dict = {}
    for ts, changes in machine.run(spec, rows):
        for c in changes:
            want.setdefault(c.stream, []).append((ts, c.value))
    names = [s.name for s in plan.spec.outputs]
    got = plan.table(*names).orderBy("ts", "kind", "seq").collect()
    for n in names:
        mine = [(r["ts"], r[n]) for r in got if r[n] is not None]
        assert [t for t, _ in mine] == [t for t, _ in want[n]], n
        assert [v for _, v in mine] == pytest.approx([v for _, v in want[n]], abs=1e-9), n


def test_a_plan_holds_the_trace_once(spark):
    plan = compile_spec(HEAD + STATS + "\noutput h @true := a.hold(or: 0) + f.hold(or: 0.0)\noutput n := n[-1].defaults(to: 0) + a\noutput o := a.offset(by: -3).defaults(to: 0)", frame(spark, bursts(1)), slice_rows=9)
    logical = plan.trace.df._jdf.queryExecution().logical()
    assert logical.collectLeaves().size() < 12 and plan.trace.df.count() == 80


def test_a_task_of_a_count_window_holds_few_rows(spark):
    _, n = slices(spark.range(1).withColumnRenamed("id", "__ts"), "__ts", 0, 10**9, 600_000)
    assert n >= 3
    plan = compile_spec(HEAD + "output v := f.aggregate(over_discrete: 10, using: var)\noutput d := f.aggregate(over_discrete: 10, using: sd)", frame(spark, bursts(2)), slice_rows=9)
    assert "array" not in ", ".join(t for _, t in plan.trace.df.dtypes)  # no rows with all their window's values
    assert plan.trace.df.rdd.getNumPartitions() >= 9  # slices aren't put together
