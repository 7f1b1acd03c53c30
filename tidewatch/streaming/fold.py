"""Specifications as ordered folds: over whole traces, per key, and over live streams."""

from __future__ import annotations

import pickle

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lang.analysis import Analysis
from ..lang.syntax import SpecError, parse
from .machine import Machine, show

SCHEMA = "ts long, kind int, seq long, stream string, change string, params string, value string"
COLUMNS = ["ts", "kind", "seq", "stream", "change", "params", "value"]
#: Events of an unkeyed trace that the folding task sorts at a time, and the rows that it makes Python objects of at a time.
RANGE_ROWS, BATCH_ROWS = 250_000, 10_000


def _plain(v):
    return tuple(_plain(x) for x in v.values()) if isinstance(v, dict) else v


def rows_of(cycles) -> list[tuple]:
    return [(ts, *c.cycle, c.stream, c.kind, ", ".join(map(show, c.params)), None if c.kind != "Value" else show(c.value)) for ts, changes in cycles for c in changes]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.string()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=COLUMNS)


def in_turn(batches):
    """Record batches of the ranges (``__range``) of a trace, sorted by time and place; one range is held at a time.

    A task that takes all partitions takes them in their order, except that the first one
    with a preferred host may come before others: the first range waits for its turn.
    """

    def runs():
        at, held = None, []
        for batch in batches:
            ids = batch.column("__range")
            for k in pc.unique(ids).to_pylist():
                if k != at and held:
                    yield at, held
                    held = []
                at = k
                held.append(batch.filter(pc.equal(ids, k)))
        if held:
            yield at, held

    def ordered():
        first = None
        for n, run in enumerate(runs()):
            if n == 0:
                first = run
                continue
            if first is not None and first[0] < run[0]:
                yield first
                first = None
            yield run
        if first is not None:
            yield first

    last = -1
    for k, held in ordered():
        if k <= last:
            raise RuntimeError(f"range {k} of the trace came after range {last}")
        last = k
        table = pa.Table.from_batches(held).drop_columns(["__range"])
        held.clear()
        yield from table.sort_by([("__ts", "ascending"), ("__seq", "ascending")]).to_batches(max_chunksize=BATCH_ROWS)


def fold(text: str, events: DataFrame, keys: list[str] | None = None, end: int | None = None) -> DataFrame:
    """All changes of a trace: ts, kind and seq of the cycle, stream, change, params, value (as messages show it).

    Without keys the specification relates all events, and one task folds them in order,
    holding only what the specification looks back to: the trace is cut into ranges of its
    order, which go through that task one after another. With keys every key is a trace of
    its own, and keys are dealt over all tasks; all end at ``end`` (else at the last event).
    """
    inputs = [s.name for s in parse(text).inputs]
    keys = keys or []
    high, n = events.agg(F.max("__ts"), F.count(F.lit(1))).first()
    if end is None:
        end = high or 0
    rows = events.select("__ts", "__seq", *[F.col(f"`{i}`") for i in inputs], *[F.col(f"`{k}`").alias(f"__key{n}") for n, k in enumerate(keys)])
    names = [f"__key{n}" for n in range(len(keys))]
    if names:
        ordered = rows.repartition(*names).sortWithinPartitions(*names, "__ts", "__seq")
    else:
        ranges = rows.repartitionByRange(max(1, -(-n // RANGE_ROWS)), "__ts", "__seq")
        ordered = ranges.withColumn("__range", F.spark_partition_id()).coalesce(1)

    def run(batches):
        machine, at = None, None
        for batch in batches if names else in_turn(batches):
            out: list[tuple] = []
            for r in batch.to_pylist():
                key = tuple(r[n] for n in names)
                if machine is None or key != at:
                    if machine is not None:
                        out += rows_of(machine.advance(end))
                    machine, at = Machine(text), key
                out += rows_of(machine.event(r["__ts"], {i: _plain(r[i]) for i in inputs}, r["__seq"]))
            yield _batch(out)
        if machine is not None:
            yield _batch(rows_of(machine.advance(end)))

    return ordered.mapInArrow(run, SCHEMA)


def live(text: str, stream: DataFrame, keys: list[str], timeout_ms: int | None = None, late: str = "raise", delay_ms: int = 0) -> DataFrame:
    """A streaming DataFrame of changes. stream: ``__ts``, ``__seq``, inputs and keys (a constant column for one global trace).

    Each key keeps its machine, with its clock, in the state store. Events of a batch are
    taken in order; deadlines before an event run when it comes, and where ``timeout_ms`` is
    given those that passed without an event run when the time is up. With ``delay_ms`` events
    are held until one so much later has come (or the time is up), and taken in order of
    time: a watermark. An event before the clock ends the query, or is left out where
    ``late`` is "drop".
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    analysis = Analysis(parse(text))
    kinds = {s.name: analysis.stream_type(s) for s in analysis.spec.inputs}
    inputs, whole = list(kinds), [n for n, t in kinds.items() if t in ("int", "uint")]
    if late not in ("raise", "drop"):
        raise SpecError(f"late events are raised or dropped, not {late}")
    # whole numbers go as text: pandas would make those of a column with nulls floats
    stream = stream.select([F.col(f"`{c}`").cast("string").alias(c) if c in whole and c not in keys else F.col(f"`{c}`") for c in stream.columns])

    def value(name, x):
        if x is None or x is pd.NA or isinstance(x, float) and x != x:
            return None
        return int(x) if name in whole else _plain(x.item() if hasattr(x, "item") else x)

    def step(key, parts, state):
        kept, held = pickle.loads(state.get[0]) if state.exists else (None, [])
        machine = Machine(text) if kept is None else Machine.restore(text, kept)
        out: list[tuple] = []
        if state.hasTimedOut:
            limit = machine.now + timeout_ms * 1_000_000
        else:
            rows = pd.concat(list(parts)).to_dict("records")
            held += [(int(r["__ts"]), int(r["__seq"]), {i: value(i, r[i]) for i in inputs}) for r in rows]
            limit = max(ts for ts, _, _ in held) - delay_ms * 1_000_000
        held.sort(key=lambda e: e[:2])
        ready = sum(ts <= limit for ts, _, _ in held)
        for ts, seq, row in held[:ready]:
            if ts >= machine.now or late == "raise":
                out += rows_of(machine.event(ts, row, seq))
        if state.hasTimedOut:
            out += rows_of(machine.advance(limit))
        state.update((pickle.dumps((machine.state(), held[ready:])),))
        if timeout_ms is not None:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=COLUMNS)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms is not None else GroupStateTimeout.NoTimeout
    return stream.groupBy(*keys).applyInPandasWithState(step, SCHEMA, "machine binary", "append", timeout)
