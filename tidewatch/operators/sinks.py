"""Verdicts as files and text: CSV, JSON lines, a log, statistics; filters by verbosity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..lang.syntax import SpecError
from ..plans.compiler import Plan
from ..sources import times

LEVELS = ("silent", "violations", "warnings", "public", "outputs", "streams", "debug")


def visible(plan_or_spec, verbosity: str, tags: dict[str, str] | None = None, debug: tuple[str, ...] = ()) -> list[str]:
    """Streams that a verbosity shows: triggers from violations on, outputs and inputs later; tags move a stream to another level."""
    if verbosity not in LEVELS:
        raise SpecError(f"unknown verbosity {verbosity}")
    spec = getattr(plan_or_spec, "spec", plan_or_spec)
    usual = {"trigger": "violations", "output": "outputs", "input": "streams"}
    level = lambda s: (tags or {}).get(s.name, usual[s.kind])
    return [s.name for s in spec.streams if LEVELS.index(level(s)) <= LEVELS.index(verbosity) or s.name in debug]


def csv_rows(plan: Plan, names: list[str], time_format: str = "relative") -> DataFrame:
    """``time`` and the named streams as text, ``#`` where there is no value; cycles without any value are left out."""
    keyed = [n for n in names if n in plan.keyed]
    if keyed:
        raise SpecError(f"CSV has no place for parameters of {keyed}")
    cell = lambda n: F.coalesce(scalar.text(F.col(n), plan.analysis.stream_type(plan.spec[n]) or "str"), F.lit("#")).alias(n)
    return plan.table(*names).select(times.shown(F.col("ts"), time_format).alias("time"), *[cell(n) for n in names])


def write_csv(plan: Plan, names: list[str], path: str, time_format: str = "relative") -> None:
    csv_rows(plan, names, time_format).write.csv(path, header=True)


def json_rows(changes: DataFrame, time_format: str = "relative") -> DataFrame:
    """One JSON object (``value``) per cycle (ts, kind, seq): time, and per stream the instances with what happened to them."""
    change = lambda k: F.max(F.when(F.col("change") == k, F.lit(True)))
    per = changes.groupBy("ts", "kind", "seq", "stream", "params").agg(change("Spawn").alias("spawn"), F.max(F.when(F.col("change") == "Value", F.col("value"))).alias("eval"), change("Close").alias("close"))
    one = F.struct(F.when(F.col("params") != "", F.col("params")).alias("instance"), "spawn", "eval", "close")
    streams = per.groupBy("ts", "kind", "seq", "stream").agg(F.sort_array(F.collect_list(one)).alias("instances"))
    cycles = streams.groupBy("ts", "kind", "seq").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("stream", "instances")))).alias("streams"))
    return cycles.select("ts", "kind", "seq", F.to_json(F.struct(times.shown(F.col("ts"), time_format).alias("time"), "streams"), {"ignoreNullFields": "true"}).alias("value"))


def log_rows(changes: DataFrame, triggers: list[str], time_format: str = "relative") -> DataFrame:
    """Lines of a log: ``[time][Output][name(params)][Value] = v``, ``[time][Trigger][#i][Value] = "message"``."""
    number = F.coalesce(*[F.when(F.col("stream") == n, F.lit(i)) for i, n in enumerate(triggers)], F.lit(-1))
    name = F.concat(F.col("stream"), F.when(F.coalesce("params", F.lit("")) != "", F.concat(F.lit("("), F.col("params"), F.lit(")"))).otherwise(F.lit("")))
    is_trigger = number >= 0
    who = F.when(is_trigger, F.concat(F.lit("[Trigger][#"), number.cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("[Output]["), name, F.lit("]")))
    value = F.when(F.col("change") == "Value", F.concat(F.lit(" = "), F.when(is_trigger, F.concat(F.lit('"'), F.col("value"), F.lit('"'))).otherwise(F.col("value")))).otherwise(F.lit(""))
    return changes.select("ts", "kind", "seq", F.concat(F.lit("["), times.shown(F.col("ts"), time_format), F.lit("]"), who, F.lit("["), F.col("change"), F.lit("]"), value).alias("value"))


def statistics(changes: DataFrame, triggers: list[str]) -> DataFrame:
    """Values per stream, and for triggers their number."""
    return changes.filter("change = 'Value'").groupBy("stream").agg(F.count(F.lit(1)).alias("n")).withColumn("is_trigger", F.col("stream").isin(*triggers) if triggers else F.lit(False))


def discard(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()
