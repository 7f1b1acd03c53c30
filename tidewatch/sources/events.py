"""Sources of events: CSV files and text, Parquet, JSON records, and records of several kinds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import sql_type
from ..lang.analysis import base_type
from ..lang.syntax import Spec, SpecError, parse
from .times import with_time

TIME_NAMES = ("time", "ts", "timestamp")


def typed(cell: Column, kind) -> Column:
    """A trimmed text cell as a value; ``#`` is no value, bytes are hex, unsigned numbers may be written 0.0."""
    cell = F.trim(cell)
    cell = F.when((cell != "#") & (cell != ""), cell) if kind != "str" else F.when(cell != "#", cell)
    if isinstance(kind, tuple):
        raise SpecError("tuples can't be read from text")
    if kind == "bytes":
        return F.unhex(cell)
    if kind == "uint":
        value = F.regexp_replace(cell, r"\.0+$", "").cast("bigint")
        return F.when(value < 0, F.raise_error(F.lit("negative value for an unsigned input"))).otherwise(value)
    if kind == "float":
        value = cell.cast("double")
        return F.when(F.isnan(value), F.raise_error(F.lit("NaN is no value"))).otherwise(value)
    return cell.cast(sql_type(kind))


def _inputs(raw: DataFrame, spec: Spec) -> list[Column]:
    missing = [s.name for s in spec.inputs if s.name not in raw.columns]
    if missing:
        raise SpecError(f"columns missing for inputs {missing}")
    return [typed(F.col(f"`{s.name}`"), base_type(s.type)).alias(s.name) for s in spec.inputs]


def _timed(raw: DataFrame, spec: Spec, how: str, column: str | int | None, **options) -> DataFrame:
    names = raw.columns
    if isinstance(column, int):
        column = names[column - 1]
    if column is None and how not in ("delay", "realtime"):
        column = next((c for c in names if c.strip().lower() in TIME_NAMES), None)
        if column is None:
            raise SpecError("no column named time, ts or timestamp")
    cols = _inputs(raw, spec)
    timed = raw.select("__seq", *cols, *([F.trim(F.col(f"`{column}`")).alias("__time")] if column else []))
    return with_time(timed, how, "__time", **options).drop("__time")


def read_csv(spark: SparkSession, path: str, spec: str, time: str = "relative", time_column: str | int | None = None, **options) -> DataFrame:
    """A CSV trace with a header; further columns are ignored, events keep the order of the file."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    raw = raw.toDF(*[c.strip() for c in raw.columns]).withColumn("__seq", F.monotonically_increasing_id())
    return _timed(raw, parse(spec), time, time_column, **options)


def from_text(spark: SparkSession, text: str, spec: str, time: str = "relative", time_column: str | int | None = None, **options) -> DataFrame:
    """A CSV trace held in memory."""
    lines = [x for x in text.splitlines() if x.strip()]
    head = [c.strip() for c in lines[0].split(",")]
    rows = [(i, *[c.strip() for c in x.split(",")]) for i, x in enumerate(lines[1:])]
    schema = T.StructType([T.StructField("__seq", T.LongType())] + [T.StructField(c, T.StringType()) for c in head])
    return _timed(spark.createDataFrame(rows, schema), parse(spec), time, time_column, **options)


def from_table(df: DataFrame, inputs: dict[str, Column | str], ts_ns: Column, order: Column) -> DataFrame:
    """Rows of any DataFrame as events: an expression per input, the time, and the order among equal times."""
    return df.select(ts_ns.cast("bigint").alias("__ts"), order.alias("__seq"), *[(F.expr(x) if isinstance(x, str) else x).alias(n) for n, x in inputs.items()])


def padded(df: DataFrame, spec: str) -> DataFrame:
    """Positional records: columns in the order of the inputs; those that lack are never fresh."""
    inputs = parse(spec).inputs
    own = [c for c in df.columns if not c.startswith("__")]
    if len(own) > len(inputs):
        raise SpecError(f"{len(own)} columns for {len(inputs)} inputs")
    cols = [F.col(f"`{own[i]}`") if i < len(own) else F.lit(None).cast(sql_type(base_type(s.type))) for i, s in enumerate(inputs)]
    return df.select("__ts", "__seq", *[c.alias(s.name) for c, s in zip(cols, inputs, strict=True)])


def merged(parts: dict[str, DataFrame], prefix: bool = False, rename: dict[str, str] | None = None, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Records of several kinds as one trace: columns of equal names merge, others are null where a kind lacks them."""
    out = []
    for kind, df in parts.items():
        keep = [c for c in df.columns if c not in ignore]
        name = lambda c: c if c.startswith("__") else (rename or {}).get(c, f"{kind}::{c}" if prefix else c)  # noqa: E731, B023
        out.append(df.select(*[F.col(f"`{c}`").alias(name(c)) for c in keep]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def from_json(df: DataFrame, payload: str, spec: str, time_field: str, how: str = "relative", senders: list[str] | None = None, sender_col: str = "sender") -> DataFrame:
    """Records in JSON, as sockets and datagrams bring them; ``senders`` is a list of those allowed."""
    if senders is not None:
        df = df.filter(F.col(sender_col).isin(*senders))
    s = parse(spec)
    fields = [*(x.name for x in s.inputs), time_field]
    schema = T.StructType([T.StructField(f, T.StringType()) for f in dict.fromkeys(fields)])
    raw = df.withColumn("__seq", F.monotonically_increasing_id()).select("__seq", F.from_json(F.col(payload).cast("string"), schema, {"mode": "FAILFAST"}).alias("r")).select("__seq", "r.*")
    return _timed(raw, s, how, time_field)
