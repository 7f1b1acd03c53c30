"""Operations along the order of a trace, without putting a long trace into one task.

An unkeyed trace has no column to partition a window by. It is cut into slices of equal
time; windows run within slices. What a slice takes over from those before it is computed
at once, taken to the driver and put back as a small table: one row per slice (a last
value, a sum) is joined, the last n values are rows of the next slice for a while. So a
plan holds the trace once, however many streams carry something over. Keyed relations are
partitioned by their key instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of an unkeyed trace that one slice should hold, and the most slices (rows of the carried table).
SLICE_ROWS, MAX_SLICES = 250_000, 4096
SLICE = "__slice"


class Trace:
    """A DataFrame with order columns; methods add columns to ``df`` and return them."""

    def __init__(self, df: DataFrame, order: list[str], keys: list[str] | None = None, slices: int = 1):
        self.df, self.order, self.keys, self.slices = df, order, keys, slices
        self.n = 0
        self.framed: dict[tuple[str, int], Column] = {}

    @property
    def sliced(self) -> bool:
        return self.slices > 1 and self.keys is None

    def _new(self, col: Column) -> Column:
        self.n += 1
        name = f"__x{self.n}_{len(self.df.columns)}"
        self.df = self.df.withColumn(name, col)
        return F.col(name)

    def _named(self, col: Column) -> str:
        """The name of a new column."""
        name = f"__x{self.n + 1}_{len(self.df.columns)}"
        self._new(col)
        return name

    @property
    def part(self) -> list:
        return [F.col(k) for k in self.keys] if self.keys is not None else [F.col(SLICE)]

    def window(self, *more):
        return Window.partitionBy(*self.part, *more).orderBy(*self.order)

    def ord(self) -> Column:
        return F.struct(*self.order)

    def _carried(self, own: Column, over) -> Column | None:
        """over(window of earlier slices) of a per-slice aggregate, on every row."""
        if not self.sliced:
            return None
        per = self.df.groupBy(SLICE).agg(own.alias("own"))
        return self._joined(per.select(SLICE, over(F.col("own"), Window.orderBy(SLICE))))

    def _joined(self, per: DataFrame) -> Column:
        """The second column of a table with one short row per slice, at most MAX_SLICES of them, on every row."""
        self.n += 1
        name = f"__c{self.n}_{len(self.df.columns)}"
        per = per.toDF(SLICE, name)
        self.df = self.df.join(F.broadcast(_at_hand(per, per.collect())), SLICE, "left")
        return F.col(name)

    def running(self, x: Column, how: str) -> Column:
        """last, sum, count, min, max, and, or of the non-null values up to each row."""
        x = self._new(x)
        w = self.window().rowsBetween(Window.unboundedPreceding, 0)
        one = {"last": lambda c: F.last(c, ignorenulls=True), "sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "and": F.bool_and, "or": F.bool_or}[how]
        before = lambda c, s: one(c).over(s.rowsBetween(Window.unboundedPreceding, -1)) if how != "count" else F.sum(c).over(s.rowsBetween(Window.unboundedPreceding, -1))
        own = F.max_by(x, F.when(x.isNotNull(), self.ord())) if how == "last" else one(x)
        earlier = self._carried(own, before)
        local = self._new(one(x).over(w))
        if earlier is None:
            return local
        merge = {"last": lambda a, b: F.coalesce(b, a), "sum": lambda a, b: F.coalesce(a + b, a, b), "count": lambda a, b: F.coalesce(a, F.lit(0)) + b, "min": F.least, "max": F.greatest, "and": lambda a, b: F.coalesce(a & b, a, b), "or": lambda a, b: F.coalesce(a | b, a, b)}[how]
        return self._new(merge(earlier, local))

    def running_in(self, x: Column, part: Column) -> Column:
        """Sum of the values of x up to each row since ``part``, a count that never falls, was what it is there. No sum goes over a change of it, so nothing is subtracted."""
        x, part = self._new(x), self._new(part)
        local = self._new(F.sum(x).over(self.window(part).rowsBetween(Window.unboundedPreceding, 0)))
        if not self.sliced:
            return local
        per = self.df.groupBy(SLICE, part.alias("part")).agg(F.sum(x).alias("own")).groupBy(SLICE).agg(F.max("part").alias("last"), F.max_by("own", "part").alias("own"))
        carried = F.struct("last", F.sum("own").over(Window.partitionBy("last").orderBy(SLICE)).alias("sum"))
        upto = self._joined(per.withColumn("upto", carried).select(SLICE, F.lag("upto").over(Window.orderBy(SLICE))))
        earlier = F.when(upto["last"] == part, upto["sum"])
        return self._new(F.coalesce(earlier + local, earlier, local))

    def latest(self, values: DataFrame, keys: dict[str, Column], columns: dict[str, str], ends: DataFrame | None = None) -> dict[str, Column]:
        """For every row the last values, or running sums, of another relation with the row's key, up to the row's cycle.

        values: order columns, keys and ``columns`` (name: "last" or "sum"); keys: their names,
        with the row's own columns; ends: order columns and keys of when a last value ends,
        from the next cycle on. Both relations are united and partitioned by the key, so
        neither is joined with the other's range. Rows without a key are spread.
        """
        self.n += 1
        mark = f"__l{self.n}_{len(self.df.columns)}"
        own = self.df.withColumns({f"{mark}_{k}": c for k, c in keys.items()}).withColumn(f"{mark}_tag", F.lit(1))
        parts = [f"{mark}_{k}" for k in keys]
        named = {c: f"{mark}_v_{c}" for c in columns}
        held = lambda c, how: F.struct(F.col(c).alias("v")) if how == "last" else F.col(c)
        other = values.select(*self.order, *[F.col(k).alias(f"{mark}_{k}") for k in keys], *[held(c, how).alias(named[c]) for c, how in columns.items()], F.lit(0).alias(f"{mark}_tag"))
        both = own.unionByName(other, allowMissingColumns=True)
        if ends is not None:
            empty = [F.struct(F.lit(None).cast(values.schema[c].dataType).alias("v")).alias(named[c]) for c in columns]
            both = both.unionByName(ends.select(*self.order, *[F.col(k).alias(f"{mark}_{k}") for k in keys], *empty, F.lit(2).alias(f"{mark}_tag")), allowMissingColumns=True)
        lost = F.lit(False)
        for p in parts:
            lost = lost | F.col(p).isNull()
        both = both.withColumn(f"{mark}_spread", F.when(lost, F.pmod(F.xxhash64(*self.order), F.lit(256))).otherwise(F.lit(0).cast("bigint")))
        w = Window.partitionBy(*parts, f"{mark}_spread").orderBy(*self.order, f"{mark}_tag").rowsBetween(Window.unboundedPreceding, 0)
        over = {c: (F.last(named[c], ignorenulls=True) if how == "last" else F.sum(named[c])).over(w) for c, how in columns.items()}
        both = both.withColumns({f"{mark}_o_{c}": x for c, x in over.items()}).filter(F.col(f"{mark}_tag") == 1)
        self.df = both.drop(*parts, *named.values(), f"{mark}_tag", f"{mark}_spread")
        return {c: F.col(f"{mark}_o_{c}")["v"] if how == "last" else F.col(f"{mark}_o_{c}") for c, how in columns.items()}

    def _halo(self, x: str, n: int) -> str:
        """Gives every slice the last n values of x before it, as rows of their own, and returns the name of the column that marks these."""
        back = Window.partitionBy(SLICE).orderBy(*[F.desc(c) for c in self.order])
        values = self.df.filter(F.col(x).isNotNull()).select(SLICE, *self.order, x)
        own: dict[int, list[tuple]] = {}
        for r in values.withColumn("__r", F.row_number().over(back)).filter(F.col("__r") <= n).orderBy(SLICE, *self.order).drop("__r").collect():
            own.setdefault(r[0], []).append(tuple(r)[1:])
        rows: list[tuple] = []
        tail: list[tuple] = []
        for i in range(self.slices):
            rows += [(i, *r) for r in tail]
            tail = (tail + own.get(i, []))[-n:]
        self.n += 1
        mark = f"__h{self.n}_{len(self.df.columns)}"
        before = _at_hand(values, rows).withColumn(mark, F.lit(True))
        # numbered, so that slices aren't coalesced into large tasks
        self.df = self.df.unionByName(before, allowMissingColumns=True).repartition(2 * self.slices, SLICE)
        return mark

    def lasting(self, x: Column, n: int, over: Callable) -> tuple[Column, Column]:
        """Whether x has a value, and over(x, window of the rows with one) as of its last value; ``over`` looks at n values before a row at most."""
        name = self._named(x)
        mark = self._halo(name, n) if self.sliced else None
        x = F.col(name)
        fresh = x.isNotNull()
        value = self._new(F.when(fresh, over(x, self.window(fresh))))
        held = self._new(F.last(value, ignorenulls=True).over(self.window().rowsBetween(Window.unboundedPreceding, 0)))
        if mark is not None:
            self.df = self.df.filter(F.col(mark).isNull()).drop(mark)
        return fresh, held

    def frame(self, x: Column, n: int, over: dict[str, Callable]) -> Column:
        """A struct of over(x, window) of the last n values of x by name, and their number ``n``, as of its last value."""

        def values(x, w):
            w = w.rowsBetween(-(n - 1), 0)
            return F.struct(*[f(x, w).alias(name) for name, f in over.items()], F.count(x).over(w).alias("n"))

        return self.lasting(x, n, values)[1]

    def previous(self, x: Column, n: int) -> Column:
        """The n-th value before the present one; where x is null, counted from the last value on."""
        fresh, held = self.lasting(x, n, lambda x, w: F.struct(F.lag(x, n).over(w).alias("fresh"), (x if n == 1 else F.lag(x, n - 1).over(w)).alias("later")))
        return self._new(F.when(fresh, held["fresh"]).otherwise(held["later"]))


def _at_hand(like: DataFrame, rows: list) -> DataFrame:
    """Rows that the driver has, with the columns of another DataFrame."""
    return like.sparkSession.createDataFrame(rows, like.schema)


def slices(df: DataFrame, ts: str, low: int, high: int, rows: int, slice_rows: int = SLICE_ROWS) -> tuple[DataFrame, int]:
    """``df`` with the slice of each row, and how many there may be."""
    n = min(MAX_SLICES, max(1, -(-rows // slice_rows)))
    if n == 1:
        return df.withColumn(SLICE, F.lit(0)), 1
    width = max(1, -(-(high - low + 1) // n))
    return df.withColumn(SLICE, F.call_function("div", F.col(ts) - F.lit(low), F.lit(width)).cast("int")), n
