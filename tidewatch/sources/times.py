"""Representations of time as expressions for nanoseconds since the start (``__ts``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lang.syntax import SpecError

FORMATS = ("relative_nanos", "relative_float", "offset_nanos", "offset_float", "absolute_float", "absolute_rfc", "delay", "realtime")
ALIASES = {"relative": "relative_float", "relative-secs": "relative_float", "relative-nanos": "relative_nanos", "offset": "offset_float", "offset-secs": "offset_float", "offset-nanos": "offset_nanos", "absolute": "absolute_float", "unix": "absolute_float", "absolute-rfc": "absolute_rfc", "rfc3339": "absolute_rfc", "absolute-rfc3339": "absolute_rfc"}
NANOS = 1_000_000_000
#: Numbers of the order that a block of rows spans; ids that follow a scan are dense within each of its parts.
BLOCK = 2_000_000


def exact_nanos(seconds: Column) -> Column:
    """Decimal seconds, as text or number, to whole nanoseconds without a double in between."""
    return (seconds.cast("string").cast("decimal(28,9)") * F.lit(NANOS)).cast("bigint")


def _summed(df: DataFrame, step: Column, order: str) -> DataFrame:
    """``df`` with ``__ts``, the sum of steps up to each row, by blocks of the order: one short row per block is summed in one place."""
    rows = df.withColumn("__block", F.call_function("div", F.col(order), F.lit(BLOCK))).withColumn("__step", step)
    per = rows.groupBy("__block").agg(F.sum("__step").alias("__own"))
    per = per.select("__block", F.coalesce(F.sum("__own").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.sum("__step").over(Window.partitionBy("__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(per, "__block").withColumn("__ts", within + F.col("__before")).drop("__block", "__step", "__before")


def with_time(df: DataFrame, how: str, column: str | None = None, start: float | str | None = None, delay_ns: int = NANOS, order: str = "__seq") -> DataFrame:
    """``df`` with ``__ts``. start: of absolute times, else the first event; delay_ns: between events, for ``delay``."""
    how = ALIASES.get(how, how)
    if how not in FORMATS:
        raise SpecError(f"unknown time format {how}")
    if how == "delay":
        return _summed(df, F.lit(delay_ns).cast("bigint"), order).withColumn("__ts", F.col("__ts") - F.lit(delay_ns))
    if how == "realtime":
        return df.withColumn("__ts", F.unix_micros(F.current_timestamp()) * 1000)
    col = F.col(column)
    if how == "relative_nanos":
        return df.withColumn("__ts", col.cast("bigint"))
    if how == "relative_float":
        return df.withColumn("__ts", exact_nanos(col))
    if how in ("offset_nanos", "offset_float"):
        step = col.cast("bigint") if how == "offset_nanos" else exact_nanos(col)
        return _summed(df, step, order)
    if how == "absolute_rfc":
        at = F.unix_micros(F.to_timestamp(col)) * 1000
        first = None if start is None else F.unix_micros(F.to_timestamp(F.lit(start))) * 1000
    else:
        at = exact_nanos(col)
        first = None if start is None else exact_nanos(F.lit(str(start)))
    df = df.withColumn("__ts", at)
    if first is None:
        low = df.agg(F.min("__ts")).first()[0]
        first = F.lit(low if low is not None else 0)
    return df.withColumn("__ts", F.col("__ts") - first)


def text(ns: Column) -> Column:
    """The canonical text of a time: seconds and nine digits."""
    return F.concat(F.call_function("div", ns, F.lit(NANOS)).cast("string"), F.lit("."), F.lpad((ns % NANOS).cast("string"), 9, "0"))


def shown(ns: Column, how: str, start_ns: int = 0) -> Column:
    """A time in an output format."""
    how = ALIASES.get(how, how)
    if how == "relative_nanos":
        return ns.cast("string")
    if how == "absolute_float":
        return text(ns + F.lit(start_ns))
    if how == "absolute_rfc":
        return F.date_format(F.timestamp_micros(F.call_function("div", ns + F.lit(start_ns), F.lit(1000))), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return text(ns)
