"""Ordered folds over ranges of a trace."""

import random

import pyarrow as pa
import pytest

from tidewatch.streaming import fold, machine
from tidewatch.streaming.machine import show

SPEC = "input a: Int64\ninput f: Float64\noutput x := (x[-1].defaults(to: 0) * 3 + a) % 1000\noutput n @2s := f.hold(or: 0.0)"


def batch(*rows):
    return pa.RecordBatch.from_pylist([dict(zip(("__ts", "__seq", "__range"), r, strict=True)) for r in rows])


def test_ranges_come_sorted_and_the_first_waits_for_its_turn():
    batches = [batch((31, 0, 3), (30, 0, 3)), batch((32, 0, 3), (2, 1, 0)), batch((2, 0, 0), (1, 5, 0), (11, 0, 1)), batch((10, 9, 1), (41, 0, 4))]
    got = [(r["__ts"], r["__seq"]) for b in fold.in_turn(batches) for r in b.to_pylist()]
    assert got == [(1, 5), (2, 0), (2, 1), (10, 9), (11, 0), (30, 0), (31, 0), (32, 0), (41, 0)]
    assert [r["__ts"] for b in fold.in_turn([batch((9, 0, 7)), batch((1, 0, 2))]) for r in b.to_pylist()] == [1, 9]
    assert list(fold.in_turn([])) == []
    with pytest.raises(RuntimeError):
        list(fold.in_turn([batch((1, 0, 1)), batch((3, 0, 3)), batch((2, 0, 2))]))


def test_a_fold_goes_through_ranges(spark, monkeypatch):
    monkeypatch.setattr(fold, "RANGE_ROWS", 7)
    r = random.Random(3)
    rows = [(i // 3 * 10**9, i, r.randint(0, 99) if r.random() < 0.7 else None, r.randint(0, 9) / 4) for i in range(60)]
    shuffled = r.sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, "__ts long, __seq long, a long, f double").repartition(5)
    folded = fold.fold(SPEC, df)
    got = [(x["ts"], x["stream"], x["value"]) for x in folded.filter("change = 'Value'").collect()]
    want = [(ts, c.stream, show(c.value)) for ts, changes in machine.run(SPEC, [(t, {"a": a, "f": f}) for t, _, a, f in rows]) for c in changes if c.kind == "Value"]
    assert got == want
    assert "Sort" not in folded._jdf.queryExecution().executedPlan().toString()  # the whole trace is never sorted in the task that folds it
