"""Scalar operators and functions of the language as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang.syntax import SpecError

INTS = ("int", "uint")


def sql_type(t) -> str:
    if isinstance(t, tuple):
        return "struct<" + ",".join(f"_{i}:{sql_type(x)}" for i, x in enumerate(t)) + ">"
    return {"int": "bigint", "uint": "bigint", "float": "double", "bool": "boolean", "str": "string", "bytes": "binary", "fixed": "decimal(38,10)"}[t]


def quotient(a: Column, b: Column, kind) -> Column:
    """Integers truncate; a float over zero is infinite (and null for 0/0)."""
    if kind in INTS:
        return F.call_function("div", a, b)
    if kind == "fixed":
        return a / b
    edge = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
    return F.when(b == 0, edge).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def power(a: Column, b: Column, exponent: int | None) -> Column:
    """Whole powers by multiplication, which is exact and fails where the result has no room."""
    one = F.lit(1).cast("bigint")
    if exponent is not None and 0 <= exponent <= 64:
        out = None
        for bit in bin(exponent)[2:]:
            out = a if out is None and bit == "1" else out if out is None else out * out * a if bit == "1" else out * out
        return one if out is None else F.when(a.isNotNull(), out)
    negative = F.raise_error(F.lit("a whole power with a negative exponent")).cast("bigint")
    return F.when(b < 0, negative).when(b == 0, one).otherwise(F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(b, F.lit(1))), one, lambda acc, _: acc * a))


def binary(op: str, a: Column, b: Column, ta, tb, constant=None) -> Column:
    """constant: the value of b, if it is one. Equality is also that of missing values."""
    kind = "float" if "float" in (ta, tb) else "fixed" if "fixed" in (ta, tb) else "uint" if ta == tb == "uint" else "int" if ta in INTS else ta or tb
    if op in ("&&", "||"):
        return a & b if op == "&&" else a | b
    if op in ("==", "!="):
        same = a.eqNullSafe(b)
        return same if op == "==" else ~same
    if op in ("<", "<=", ">", ">="):
        if "bool" in (ta, tb) or isinstance(ta, tuple):
            raise SpecError(f"{op} doesn't order {ta}")
        return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    if op == "-" and kind == "uint":
        below = F.raise_error(F.concat(F.lit("an unsigned difference below 0: "), a.cast("string"), F.lit(" - "), b.cast("string"))).cast("bigint")
        return F.when(a < b, below).otherwise(a - b)
    if op in ("+", "-", "*"):
        return {"+": a + b, "-": a - b, "*": a * b}[op]
    if op == "/":
        return quotient(a, b, kind)
    if op == "%":
        return a % b
    if op == "**":
        return power(a, b, constant) if kind in INTS else F.pow(a, b)
    if op in ("&", "|", "^") and kind == "bool":
        if op == "^":
            raise SpecError("^ isn't defined on Bool")
        return a & b if op == "&" else a | b
    if op in ("&", "|", "^"):
        return {"&": a.bitwiseAND, "|": a.bitwiseOR, "^": a.bitwiseXOR}[op](b)
    if op in ("<<", ">>"):
        name = "shiftleft" if op == "<<" else "shiftrightunsigned" if ta == "uint" else "shiftright"
        return F.call_function(name, a, b.cast("int"))
    raise SpecError(f"unknown operator {op}")


def unary(op: str, a: Column) -> Column:
    return ~a if op == "!" else -a if op == "-" else F.bitwise_not(a)


def text(a: Column, kind) -> Column:
    """A value as messages show it: whole floats without a point, tuples in brackets, bytes in hex."""
    if kind == "float":
        return F.when((a == F.floor(a)) & (F.abs(a) < 1e15), a.cast("bigint").cast("string")).otherwise(a.cast("string"))
    if kind == "bytes":
        return F.hex(a)
    if isinstance(kind, tuple):
        return F.concat(F.lit("("), F.concat_ws(", ", *[text(a[f"_{i}"], k) for i, k in enumerate(kind)]), F.lit(")"))
    return a.cast("string")


def formatted(template: str, args: list[tuple[Column, object]]) -> Column:
    parts = template.replace("{{}}", "{}").split("{}")
    out = [F.lit(parts[0])]
    for (a, kind), tail in zip(args, parts[1:], strict=True):
        out += [text(a, kind), F.lit(tail)]
    return F.concat(*out)


def cast(a: Column, kind, to) -> Column:
    if kind == to:
        return a
    if kind == "float" and to in INTS:  # truncates and saturates
        low = 0.0 if to == "uint" else -9.223372036854775e18
        return F.least(F.greatest(a, F.lit(low)), F.lit(9.223372036854774e18)).cast("bigint")
    if kind == "int" and to == "uint":  # values above the signed range have no column type here
        return F.when(a < 0, F.raise_error(F.concat(F.lit("no unsigned value: "), a.cast("string"))).cast("bigint")).otherwise(a)
    if kind == "fixed" and to in INTS:
        return F.bround(a, 0).cast("bigint")
    return a.cast(sql_type(to))


NAMED = {"sqrt": F.sqrt, "sin": F.sin, "cos": F.cos, "tan": F.tan, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "abs": F.abs}


def function(name: str, args: list[tuple[Column, object]], consts: list, to=None) -> Column:
    """args: columns with types; consts: the constant value of each argument, if it is one."""
    cols = [a for a, _ in args]
    if name in NAMED:
        return NAMED[name](cols[0])
    if name in ("min", "max"):
        return (F.least if name == "min" else F.greatest)(*cols)
    if name == "matches":
        return F.decode(cols[0], F.lit("ISO-8859-1")).rlike(consts[1]) if args[0][1] == "bytes" else cols[0].rlike(consts[1])
    if name == "at":
        return F.when((cols[1] >= 0) & (cols[1] < F.octet_length(cols[0])), F.conv(F.hex(F.substr(cols[0], (cols[1] + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint"))
    if name == "format":
        return formatted(consts[0], args[1:])
    if name == "round":
        return F.round(cols[0], consts[1])
    if name in ("cast", "widen"):
        return cast(cols[0], args[0][1], to or args[0][1])
    raise SpecError(f"unknown function {name}")
