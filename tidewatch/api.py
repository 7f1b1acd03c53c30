"""Entry point of the stream engine: a specification, a trace, a result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lang.analysis import Analysis, is_tick, period_of
from .lang.syntax import parse
from .plans.compiler import NotRelational, Plan, compile_spec
from .streaming.fold import fold


@dataclass
class Result:
    """What a specification says about a trace. plan is None where it ran as an ordered fold."""

    text: str
    plan: Plan | None
    folded: DataFrame | None

    def changes(self) -> DataFrame:
        """ts, kind and seq of the cycle, stream, change, params, value (as messages show it); ordered by the first three."""
        if self.plan is not None:
            return self.plan.changes().select("ts", "kind", "seq", "stream", "change", F.coalesce("params", F.lit("")).alias("params"), "value")
        return self.folded

    def triggers(self) -> DataFrame:
        """ts, message."""
        if self.plan is not None:
            return self.plan.triggers().select("ts", "message")
        names = [s.name for s in parse(self.text).triggers]
        return self.folded.filter(F.col("stream").isin(*names) & (F.col("change") == "Value")).select("ts", F.col("value").alias("message"))


def monitor(text: str, events: DataFrame, keys: list[str] | None = None, **options) -> Result:
    """Run a specification over events (``__ts``, ``__seq``, a column per input).

    With ``keys`` every key is a trace of its own. What has no relational form is folded in order.
    """
    if keys:
        return Result(text, None, fold(text, events, keys))
    try:
        return Result(text, compile_spec(text, events, **options), None)
    except NotRelational:
        return Result(text, None, fold(text, events))


class Spec:
    """A specification that can be asked about itself."""

    def __init__(self, text: str):
        self.text, self.spec = text, parse(text)
        self.analysis = Analysis(self.spec)

    def inputs(self) -> dict:
        return {s.name: self.analysis.stream_type(s) for s in self.spec.inputs}

    def outputs(self) -> dict:
        return {s.name: self.analysis.stream_type(s) for s in self.spec.outputs if s.kind == "output"}

    def triggers(self) -> list[str]:
        return [s.name for s in self.spec.triggers]

    def period(self, name: str) -> int | None:
        """Nanoseconds between evaluations of a periodic stream."""
        p = self.analysis.stream_pacing(self.spec[name])
        return period_of(p) if is_tick(p) else None

    def monitor(self, events: DataFrame, **options) -> Result:
        return monitor(self.text, events, **options)
