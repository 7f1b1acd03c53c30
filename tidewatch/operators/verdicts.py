"""Representations of what happens in a cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..plans.compiler import ORDER, Plan, _c


def incremental(plan: Plan) -> DataFrame:
    """Changed outputs: ts, kind, seq, stream, change, params, value."""
    return plan.changes()


def total_incremental(plan: Plan) -> DataFrame:
    """Changed inputs and outputs, triggers among them."""
    out = plan.changes()
    for s in plan.spec.inputs:
        show = scalar.text(F.col("value"), plan.analysis.stream_type(s))
        out = out.unionByName(plan.stream(s.name).select("ts", "kind", "seq", F.lit(s.name).alias("stream"), F.lit("Value").alias("change"), F.lit(None).cast("string").alias("params"), show.alias("value")))
    return out


def total(plan: Plan, *names: str) -> DataFrame:
    """The last value of every unkeyed stream (or of the named ones) at every cycle."""
    names = names or tuple(s.name for s in plan.spec.streams if s.name not in plan.keyed)
    trace = plan.trace
    held = {n: trace.running(F.col(_c(n)), "last") for n in names}
    return trace.df.select(*[F.col(o).alias(o.strip("_")) for o in ORDER], *[c.alias(n) for n, c in held.items()])


def trigger_messages(plan: Plan) -> DataFrame:
    """ts, kind, seq, trigger, message."""
    return plan.triggers()
