"""Binding: syntax trees to typed Spark columns.

Types are INT64, VARCHAR and BOOLEAN. There are no implicit casts and no nulls.
Integers wrap around, for which the session must have ANSI mode off.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.problems import Collector, Invalid
from ..plans.request import Binary, Call, ColumnRef, Expr, Literal, Unary

INT64, VARCHAR, BOOLEAN = "INT64", "VARCHAR", "BOOLEAN"
SPARK_TYPE = {INT64: "bigint", VARCHAR: "string", BOOLEAN: "boolean"}
#: The number by which messages name a type.
NUMBER = {INT64: 0, VARCHAR: 1, BOOLEAN: 2}


@dataclass(frozen=True)
class Typed:
    """A column with its type; ``build`` needs an active Spark session, binding doesn't."""

    type: str
    build: Callable[[], Column]


def _fail(message: str, type_: str) -> Column:
    return F.raise_error(F.lit(message)).cast(SPARK_TYPE[type_])


def _divide(a: Column, b: Column) -> Column:
    # div truncates toward zero; / would give a double.
    return F.when(b == 0, _fail("division by zero", INT64)).otherwise(F.call_function("div", a, b))


_ARITHMETIC = {"ADD": operator.add, "SUBTRACT": operator.sub, "MULTIPLY": operator.mul, "DIVIDE": _divide}
_COMPARISON = {
    "EQUAL": operator.eq, "NOT_EQUAL": operator.ne, "LESS_THAN": operator.lt,
    "LESS_EQUAL": operator.le, "GREATER_THAN": operator.gt, "GREATER_EQUAL": operator.ge,
}
_LOGIC = {"AND": operator.and_, "OR": operator.or_}
#: Comparing two BOOLEANs passes the type check and fails when it runs.
_NO_COMPARISON = "comparison not implemented for this type"


@cache
def _upper_guard() -> tuple[str, str, str]:
    """Characters whose full upper case isn't their simple one, stand-ins, and the simple ones.

    Spark maps them to several characters; the simple mapping keeps to one: the
    title case where that is a single character, else the character itself.
    """
    special = [chr(c) for c in range(0x80, 0x1_0000) if len(chr(c).upper()) > 1]
    held = "".join(chr(0xF_0000 + i) for i in range(len(special)))
    simple = "".join(c.title() if len(c.title()) == 1 else c for c in special)
    return "".join(special), held, simple


def _upper(c: Column) -> Column:
    # Most texts need no guard, and most others only that for one letter; a translation of all is slow.
    special, held, simple = _upper_guard()
    rare = [x for x in special if x != "ß"]
    one = F.replace(F.upper(F.replace(c, F.lit("ß"), F.lit(held[0]))), F.lit(held[0]), F.lit("ß"))
    every = F.translate(F.upper(F.translate(c, special, held)), held, simple)
    return (
        F.when(F.octet_length(c) == F.char_length(c), F.upper(c))
        .when(c.rlike(f"[{rare[0]}-{rare[-1]}]") & c.rlike(_ranges(rare)), every)
        .when(F.contains(c, F.lit("ß")), one)
        .otherwise(F.upper(c))
    )


def _ranges(letters: list[str]) -> str:
    """A character class of a few ranges that hold all of the letters, and perhaps some between them."""
    parts = [[letters[0], letters[0]]]
    for x in letters[1:]:
        if ord(x) - ord(parts[-1][1]) <= 32:
            parts[-1][1] = x
        else:
            parts.append([x, x])
    return "[" + "".join(f"{a}-{b}" for a, b in parts) + "]"


def _lower(c: Column) -> Column:
    # Simple mappings: a final sigma is no exception, and a dotted capital I loses its dot.
    guarded = F.replace(F.replace(c, F.lit("Σ"), F.lit("σ")), F.lit("İ"), F.lit("i"))
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.lower(guarded))


def _strlen(c: Column) -> Column:
    return F.octet_length(c).cast("bigint")


class Binder:
    """Binds expressions over one table's columns, or over none."""

    def __init__(self, table: str, columns: Mapping[str, str], column: Callable[[str], Column] | None = None):
        self.table = table
        self.columns = columns
        self.column = column or (lambda name: F.col(f"`{name.replace('`', '``')}`"))

    def bind(self, e: Expr) -> Typed:
        """The typed column of an expression; Invalid with all problems of its parts."""
        match e:
            case ColumnRef():
                return self._column(e)
            case Literal():
                return self._literal(e.value)
            case Binary():
                return self._binary(e)
            case Unary():
                return self._unary(e)
            case Call():
                return self._call(e)
        raise Invalid(("expression cannot be nil", ""))

    def _column(self, e: ColumnRef) -> Typed:
        if e.table and e.table != self.table:
            raise Invalid((f"column {e.column} refers to table {e.table}, but query is on table {self.table}", ""))
        if e.column not in self.columns:
            raise Invalid((f"column {e.column} not found in table {self.table}", ""))
        return Typed(self.columns[e.column], lambda: self.column(e.column))

    def _literal(self, value: object) -> Typed:
        if isinstance(value, bool):
            return Typed(BOOLEAN, lambda: F.lit(value))
        if isinstance(value, str):
            return Typed(VARCHAR, lambda: F.lit(value))
        if isinstance(value, float) and value.is_integer():
            value = int(value)
        if isinstance(value, int) and -(2**63) <= value < 2**63:
            return Typed(INT64, lambda: F.lit(value).cast("bigint"))
        raise Invalid((f"unsupported literal type: {type(value).__name__} (value: {value})", ""))

    def _binary(self, e: Binary) -> Typed:
        found = Collector()
        a, b = found.of(self.bind, e.left), found.of(self.bind, e.right)
        found.check()
        op = e.operator
        if op in _ARITHMETIC:
            if (a.type, b.type) != (INT64, INT64):
                raise Invalid((f"operator {op} requires INT64, got {NUMBER[a.type]} and {NUMBER[b.type]}", ""))
            return Typed(INT64, lambda: _ARITHMETIC[op](a.build(), b.build()))
        if op in _COMPARISON:
            if a.type != b.type:
                raise Invalid((f"comparison {op} requires the same types, got {NUMBER[a.type]} and {NUMBER[b.type]}", ""))
            if a.type == BOOLEAN:
                return Typed(BOOLEAN, lambda: _fail(_NO_COMPARISON, BOOLEAN))
            return Typed(BOOLEAN, lambda: _COMPARISON[op](a.build(), b.build()))
        if op in _LOGIC:
            if (a.type, b.type) != (BOOLEAN, BOOLEAN):
                raise Invalid((f"logical operator {op} requires BOOLEAN", ""))
            return Typed(BOOLEAN, lambda: _LOGIC[op](a.build(), b.build()))
        raise Invalid((f"unknown binary operator: {op}", ""))

    def _unary(self, e: Unary) -> Typed:
        a = self.bind(e.operand)
        if e.operator == "NOT":
            if a.type != BOOLEAN:
                raise Invalid((f"NOT operator requires BOOLEAN, got {NUMBER[a.type]}", ""))
            return Typed(BOOLEAN, lambda: ~a.build())
        if e.operator == "MINUS":
            if a.type != INT64:
                raise Invalid((f"MINUS operator requires INT64, got {NUMBER[a.type]}", ""))
            return Typed(INT64, lambda: -a.build())
        raise Invalid((f"unknown unary operator: {e.operator}", ""))

    def _call(self, e: Call) -> Typed:
        found = Collector()
        args = [found.of(self.bind, x) for x in e.arguments]
        found.check()
        name, types = e.function, [a.type for a in args]
        if name == "STRLEN":
            if len(args) != 1:
                raise Invalid((f"STRLEN expects 1 argument, got {len(args)}", ""))
            if types[0] != VARCHAR:
                raise Invalid((f"STRLEN argument must be VARCHAR, got {NUMBER[types[0]]}", ""))
            return Typed(INT64, lambda: _strlen(args[0].build()))
        if name == "CONCAT":
            if len(args) < 2:
                raise Invalid(("CONCAT expects at least 2 arguments", ""))
            for i, t in enumerate(types):
                if t != VARCHAR:
                    raise Invalid((f"CONCAT argument {i} must be VARCHAR, got {NUMBER[t]}", ""))
            return Typed(VARCHAR, lambda: F.concat(*(a.build() for a in args)))
        if name in ("UPPER", "LOWER"):
            if types != [VARCHAR]:
                raise Invalid((f"{name} expects 1 VARCHAR argument", ""))
            return Typed(VARCHAR, lambda: (_upper if name == "UPPER" else _lower)(args[0].build()))
        if name == "REPLACE":
            if len(args) != 3:
                raise Invalid(("REPLACE expects 3 arguments (source, old, new)", ""))
            if set(types) != {VARCHAR}:
                raise Invalid(("REPLACE arguments must be VARCHAR", ""))
            return Typed(VARCHAR, lambda: F.replace(*(a.build() for a in args)))
        raise Invalid((f"unknown function: {name}", ""))
