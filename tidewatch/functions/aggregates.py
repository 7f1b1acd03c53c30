"""Window aggregations of the language.

Each is given in three forms: over rows of a group, over an array of values in order, and
where partial results can be merged, as partials of a pane and their merge. Empty
windows: count, sum and integral 0, var and sd 0, forall true, exists false, others null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang.syntax import SpecError
from .scalar import INTS, quotient

ALIASES = {"average": "avg", "med": "pctl50", "median": "pctl50", "variance": "var", "stddev": "sd", "covariance": "cov"}


def canonical(name: str) -> str:
    name = ALIASES.get(name, name)
    if name not in ("count", "sum", "avg", "min", "max", "last", "var", "sd", "cov", "forall", "exists", "integral", "product") and not re.fullmatch(r"pctl\d+", name):
        raise SpecError(f"unknown aggregation {name}")
    return name


def when_empty(name: str, a: Column, kind) -> Column:
    if name in ("count",) or name == "sum" and kind in (*INTS, "bool"):
        return F.coalesce(a, F.lit(0).cast("bigint"))
    if name in ("sum", "integral", "var", "sd"):
        return F.coalesce(a, F.lit(0.0))
    if name == "product":
        return F.coalesce(a, F.lit(1.0))
    if name == "forall":
        return F.coalesce(a, F.lit(True))
    return F.coalesce(a, F.lit(False)) if name == "exists" else a


def rank_percentile(values: Column, p: int, kind) -> Column:
    """Window percentile of a sorted array: with i = n * p / 100, the mean of the i-th and the next value if i is whole, else the value at the next rank."""
    n = F.size(values)
    scaled = n * p
    low = F.greatest(F.lit(1), F.call_function("div", scaled, F.lit(100)).cast("int"))
    up = F.least(n, low + 1)
    exact = scaled % 100 == 0
    nearest = F.greatest(F.lit(1), F.least(n, F.ceil(scaled / 100).cast("int")))
    total = F.element_at(values, low) + F.element_at(values, up)
    mean = quotient(total, F.lit(2), kind if kind in INTS else "float")
    return F.when(n > 0, F.when(exact & (low < n), mean).otherwise(F.element_at(values, F.when(exact, n).otherwise(nearest).cast("int"))))


def over_rows(name: str, x: Column, kind, order: Column | None = None, time: Column | None = None) -> Column:
    """As an aggregate of a group (or of a frame); null rows don't count. time is in nanoseconds."""
    if name == "count":
        return F.count(x)
    if name == "sum":
        return F.count_if(x) if kind == "bool" else F.sum(x)
    if name == "avg":
        return quotient(F.sum(x), F.count(x), kind) if kind in INTS else F.avg(x)
    if name in ("min", "max"):
        return F.min(x) if name == "min" else F.max(x)
    if name == "last":
        return F.max_by(x, F.when(x.isNotNull(), order))
    if name == "var":
        return F.var_pop(x)
    if name == "sd":
        return F.stddev_pop(x)
    if name == "cov":
        return F.covar_pop(x["_0"], x["_1"])
    if name == "forall":
        return F.bool_and(x)
    if name == "exists":
        return F.bool_or(x)
    if name == "product":
        return F.product(x)
    if name == "integral":
        return integral(F.sort_array(F.collect_list(F.when(x.isNotNull(), F.struct(order.alias("o"), time.alias("t"), x.cast("double").alias("x"))))))
    return rank_percentile(F.sort_array(F.collect_list(x)), int(name[4:]), kind)


#: What ``over_frame`` knows.
FRAMED = ("count", "sum", "avg", "min", "max", "last", "var", "sd", "forall", "exists")


def over_frame(name: str, x: Column, kind, w) -> Column:
    """Over the frame of a window in which no value is null (names of FRAMED)."""
    plain = {"count": F.count, "min": F.min, "max": F.max, "var": F.var_pop, "sd": F.stddev_pop, "forall": F.bool_and, "exists": F.bool_or, "last": F.last}
    if name in plain:
        return plain[name](x).over(w)
    if name == "sum":
        return (F.count_if(x) if kind == "bool" else F.sum(x)).over(w)
    if name == "avg":
        return quotient(F.sum(x).over(w), F.count(x).over(w), kind) if kind in INTS else F.avg(x).over(w)
    raise SpecError(f"{name} over a frame")


def integral(points: Column) -> Column:
    """Trapezoids between neighbouring points (t in nanoseconds, x), in seconds."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("bigint").alias("t"), F.lit(None).cast("double").alias("x"))
    step = lambda a, p: F.struct((a["sum"] + F.coalesce((p["x"] + a["x"]) * (p["t"] - a["t"]) / 2e9, F.lit(0.0))).alias("sum"), p["t"].alias("t"), p["x"].alias("x"))
    return F.aggregate(points, start, step, lambda a: a["sum"])


def over_array(name: str, values: Column, kind) -> Column:
    """Over an array of values in order of time; null for an empty one (see when_empty)."""
    n = F.size(values)
    total = F.aggregate(values, F.lit(0).cast("bigint") if kind in INTS else F.lit(0.0), lambda a, x: a + x) if kind not in ("bool", "str") and not isinstance(kind, tuple) else None
    mean = lambda f: F.aggregate(values, F.lit(0.0), lambda a, x: a + f(x)) / n
    if name == "count":
        return n.cast("bigint")
    if name == "sum":
        out = F.size(F.filter(values, lambda x: x)).cast("bigint") if kind == "bool" else total
    elif name == "avg":
        out = quotient(total, n.cast("bigint"), kind) if kind in INTS else total / n
    elif name in ("min", "max"):
        out = F.array_min(values) if name == "min" else F.array_max(values)
    elif name == "last":
        out = F.element_at(values, -1)
    elif name in ("var", "sd"):
        m = mean(lambda x: x.cast("double"))
        v = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / n
        out = F.sqrt(v) if name == "sd" else v
    elif name == "cov":
        a, b = mean(lambda x: x["_0"]), mean(lambda x: x["_1"])
        out = F.aggregate(values, F.lit(0.0), lambda s, x: s + (x["_0"] - a) * (x["_1"] - b)) / n
    elif name == "forall":
        out = F.forall(values, lambda x: x)
    elif name == "exists":
        out = F.exists(values, lambda x: x)
    elif name == "product":
        out = F.aggregate(values, F.lit(1.0), lambda a, x: a * x)
    else:
        out = rank_percentile(F.array_sort(values), int(name[4:]), kind)
    return F.when(n > 0, out)


#: Aggregations whose panes merge: partial aggregates of a pane.
def partials(name: str, x: Column, kind, order: Column) -> dict[str, Column] | None:
    if name == "avg":
        return {"s": F.sum(x), "n": F.count(x)}
    if name == "last":
        return {"l": F.max(F.when(x.isNotNull(), F.struct(order.alias("o"), x.alias("v"))))}
    if name in ("count", "sum", "min", "max", "forall", "exists"):
        return {"v": over_rows(name, x, kind, order)}
    return None


def merged(name: str, kind, col) -> Column:
    """Merge of partials; col: name -> Column."""
    if name == "avg":
        return quotient(F.sum(col("s")), F.sum(col("n")), kind) if kind in INTS else F.sum(col("s")) / F.sum(col("n"))
    if name == "last":
        return F.max(col("l"))["v"]
    return {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max, "forall": F.bool_and, "exists": F.bool_or}[name](col("v"))


def merged_variance(parts: str, name: str) -> Column:
    """Variance or deviation from an array of (count, mean, sum of squares about the mean) of groups apart."""
    n = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a + x["__n"])
    mean = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x["__n"] * x["__m"]) / n
    var = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x["__q"] + x["__n"] * (x["__m"] - mean) * (x["__m"] - mean)) / n
    return F.when(n > 0, F.sqrt(var) if name == "sd" else var)
