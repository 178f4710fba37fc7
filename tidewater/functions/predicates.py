"""Row predicates with the rules of PostgreSQL's WHERE clause, as Spark columns.

An expression is a pair: its value and whether evaluating it fails (division by zero,
overflow, bad shift count). All parts are evaluated, so a failure anywhere makes the
row not match, even under IS NULL or OR: ``match = not error and value is true``.
Operands of kinds that do not fit give null, as do nulls. Nothing here raises at run
time, so Catalyst may reorder freely, and a plain comparison stays a plain column that
is pushed to the scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
#: Texts that stand for truth values (fixed values).
TRUE, FALSE = ("t", "true", "y", "yes", "on", "1"), ("f", "false", "n", "no", "off", "0")


class UnsupportedPredicate(ValueError):
    """The predicate has a form that is not part of the language."""


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.IntegralType):
        return "int"
    if isinstance(data_type, T.NumericType):
        return "float"
    if isinstance(data_type, T.ArrayType):
        return f"array:{kind_of(data_type.elementType)}"
    names = {T.StringType: "text", T.BooleanType: "bool", T.TimestampType: "time", T.DateType: "time"}
    return next((n for t, n in names.items() if isinstance(data_type, t)), "other")


def null() -> Column:
    return F.lit(None).cast("boolean")


@dataclass(frozen=True)
class Key:
    """A value that a row must have: in the column itself or, ``inside``, in its array.
    ``value`` is a number, a text or a truth value, as the column's kind asks."""

    column: str
    value: float | str | bool
    inside: bool = False


class Expr:
    """Value, error and kind of an expression, and what an index can use of it: the column
    or the constant that it is, and for a condition its ``keys``, of which matching rows
    have one at least (None: no such keys). ``exact``: having one of them is the condition."""

    def __init__(self, value: Column, kind: str, errors: tuple[Column, ...] = (), column: str | None = None, constant: tuple = (), keys: tuple[Key, ...] | None = None, exact: bool = False, literal: bool = False):
        self.value, self.kind, self.errors = value, kind, errors
        self.column, self.constant, self.keys, self.exact, self.literal = column, constant, keys, exact, literal

    def __bool__(self):
        raise UnsupportedPredicate("and, or, not and chained comparisons: write & | ~ and parentheses")

    def _keyed(self, keys: tuple[Key, ...] | None, exact: bool) -> Expr:
        self.keys, self.exact = keys, exact and keys is not None
        return self

    @property
    def number(self) -> bool:
        return self.kind in ("int", "float")

    def _with(self, value: Column, kind: str, *others: Expr, error: Column | None = None) -> Expr:
        errors = sum((o.errors for o in others), self.errors)
        return Expr(value, kind, errors + ((F.coalesce(error, F.lit(False)),) if error is not None else ()))

    # comparison
    def _compare(self, other, op) -> Expr:
        other = lit(other)
        return self._with(_compared(self.value, self.kind, other.value, other.kind, op), "bool", other)

    def __eq__(self, other):  # type: ignore[override]
        other = lit(other)
        keys = _key(self, self.kind, other, False) or _key(other, other.kind, self, False)
        return self._compare(other, lambda a, b: a == b)._keyed(keys, True)

    def __ne__(self, other):  # type: ignore[override]
        return self._compare(other, lambda a, b: a != b)

    def __lt__(self, other):
        return self._compare(other, lambda a, b: a < b)

    def __le__(self, other):
        return self._compare(other, lambda a, b: a <= b)

    def __gt__(self, other):
        return self._compare(other, lambda a, b: a > b)

    def __ge__(self, other):
        return self._compare(other, lambda a, b: a >= b)

    __hash__ = None  # type: ignore[assignment]

    # logic
    def _truth(self) -> Column:
        return self.value if self.kind == "bool" else null()

    def __and__(self, other):
        keys = self.keys if self.keys is not None else other.keys  # either narrows
        return self._with(self._truth() & other._truth(), "bool", other)._keyed(keys, False)

    def __or__(self, other):
        keys = None if self.keys is None or other.keys is None else tuple(dict.fromkeys((*self.keys, *other.keys)))
        return self._with(self._truth() | other._truth(), "bool", other)._keyed(keys, self.exact and other.exact)

    def __invert__(self):
        return self._with(~self._truth(), "bool")

    # arithmetic
    def _arith(self, other, name, sign) -> Expr:
        other = lit(other)
        if not (self.number and other.number):
            return self._with(F.lit(None).cast("double"), "float", other)
        if self.kind == other.kind == "int":
            a, b = self.value.cast("long"), other.value.cast("long")
            out = getattr(F, name)(a, b)
            return self._with(out, "int", other, error=a.isNotNull() & b.isNotNull() & out.isNull())
        a, b = self.value.cast("double"), other.value.cast("double")
        out, inf = sign(a, b), F.lit(float("inf"))
        return self._with(out, "float", other, error=(F.abs(out) == inf) & (F.abs(a) != inf) & (F.abs(b) != inf))

    def __add__(self, other):
        return self._arith(other, "try_add", lambda a, b: a + b)

    def __sub__(self, other):
        return self._arith(other, "try_subtract", lambda a, b: a - b)

    def __mul__(self, other):
        return self._arith(other, "try_multiply", lambda a, b: a * b)

    def _divide(self, other, whole, part) -> Expr:
        other = lit(other)
        if not (self.number and other.number):
            return self._with(F.lit(None).cast("double"), "float", other)
        to = "long" if self.kind == other.kind == "int" else "double"
        a, b = self.value.cast(to), other.value.cast(to)
        out = (whole if to == "long" else part)(a, F.nullif(b, F.lit(0).cast(to)))
        return self._with(out, "int" if to == "long" else "float", other, error=a.isNotNull() & (b == 0))

    def __truediv__(self, other):
        return self._divide(other, lambda a, b: F.call_function("div", a, b), lambda a, b: a / b)

    def __mod__(self, other):
        return self._divide(other, lambda a, b: a % b, lambda a, b: a % b)

    def __neg__(self):
        if not self.number:
            return self._with(F.lit(None).cast("double"), "float")
        return Expr(F.lit(0).cast("long"), "int") - self if self.kind == "int" else self._with(-self.value, "float")

    def _bits(self, other, op) -> Expr:
        other = lit(other)
        if self.kind != "int" or other.kind != "int":
            return self._with(F.lit(None).cast("long"), "int", other)
        return self._with(op(self.value.cast("long"), other.value.cast("long")), "int", other)

    def bit_and(self, other):
        return self._bits(other, lambda a, b: a.bitwiseAND(b))

    def bit_or(self, other):
        return self._bits(other, lambda a, b: a.bitwiseOR(b))

    def bit_xor(self, other):
        return self._bits(other, lambda a, b: a.bitwiseXOR(b))

    def _shift(self, count, name) -> Expr:
        if isinstance(count, int) and not 0 <= count <= 63:
            raise UnsupportedPredicate(f"shift by {count}")
        count = lit(count)
        if self.kind != "int" or count.kind != "int":
            return self._with(F.lit(None).cast("long"), "int", count)
        fine = count.value.between(0, 63)
        out = F.call_function(name, self.value.cast("long"), F.when(fine, count.value).cast("int"))
        return self._with(out, "int", count, error=self.value.isNotNull() & ~fine)

    def shift_left(self, count):
        return self._shift(count, "shiftleft")

    def shift_right(self, count):
        return self._shift(count, "shiftright")

    # tests
    def is_null(self):
        return self._with(self.value.isNull(), "bool")

    def is_not_null(self):
        return self._with(self.value.isNotNull(), "bool")

    def is_true(self):
        return self._with(F.coalesce(self._truth(), F.lit(False)), "bool")

    def is_false(self):
        return self._with(F.coalesce(~self._truth(), F.lit(False)), "bool")

    def is_unknown(self):
        return self._with(self.value.isNull(), "bool")

    def is_in(self, *items):
        if not items:
            raise UnsupportedPredicate("IN of no values")
        return reduce(lambda a, b: a | b, [self == i for i in items])

    def between(self, low, high):
        return (self >= low) & (self <= high)

    def like(self, pattern: str, any_case: bool = False):
        if not isinstance(pattern, str):
            raise UnsupportedPredicate("a pattern is a text")
        if self.kind != "text":
            return self._with(null(), "bool")
        # escape pairs are taken whole, from the left; a lone backslash at the end, and one
        # before another letter, stand for themselves and for nothing
        pattern = re.sub(r"\\(.?)", lambda m: "\\" + (m[1] or "\\") if m[1] in ("", "%", "_", "\\") else m[1], pattern, flags=re.DOTALL)
        return self._with((self.value.ilike if any_case else self.value.like)(pattern), "bool")

    def ilike(self, pattern: str):
        return self.like(pattern, True)

    # arrays
    def _members(self, other: Expr, test) -> Expr:
        if not (self.literal or other.literal):
            raise UnsupportedPredicate("one side of @>, <@ and && is an array of constants or expressions")
        if not (self.kind.startswith("array") and other.kind.startswith("array")):
            return self._with(null(), "bool", other)
        known = self.value.isNotNull() & other.value.isNotNull()
        return self._with(F.when(known, test(self, other)), "bool", other)

    def contains(self, other):
        """Every member of ``other`` equals a member of this; a null equals nothing."""
        other = lit(other)
        keys = None
        if other.constant and other.constant[0] and self.column:  # any one of the members narrows
            keys = _key(self, self.kind.partition(":")[2], lit(other.constant[0][0]), True)
        return self._members(other, lambda a, b: F.forall(b.value, lambda x: F.coalesce(F.exists(a.value, lambda y: x == y), F.lit(False))))._keyed(keys, len(other.constant[0]) == 1 if keys else False)

    def contained_in(self, other):
        return lit(other).contains(self)

    def overlaps(self, other):
        return self._members(lit(other), lambda a, b: F.coalesce(F.arrays_overlap(a.value, b.value), F.lit(False)))

    def _quantified(self, items: Expr, op, every: bool) -> Expr:
        items = lit(items)
        if not items.kind.startswith("array"):
            return self._with(null(), "bool", items)
        inner = items.kind.partition(":")[2]
        found = (F.forall if every else F.exists)(items.value, lambda y: _compared(self.value, self.kind, y, inner, op))
        return self._with(F.when(self.value.isNotNull(), found), "bool", items)

    def any_of(self, items, op=None):
        items = lit(items)
        keys = _key(items, items.kind.partition(":")[2], self, True) if op is None else None
        return self._quantified(items, op or (lambda a, b: a == b), False)._keyed(keys, True)

    def all_of(self, items, op=lambda a, b: a == b):
        return self._quantified(items, op, True)

    # text
    def lower(self):
        return self._with(F.lower(self.value) if self.kind == "text" else F.lit(None).cast("string"), "text")

    def upper(self):
        return self._with(F.upper(self.value) if self.kind == "text" else F.lit(None).cast("string"), "text")

    def keeps(self) -> Column:
        """The same as a filter's condition, where null drops the row as well; in this
        form comparisons reach the scan."""
        truth = self._truth()
        return ~reduce(lambda a, b: a | b, self.errors) & truth if self.errors else truth

    def match(self) -> Column:
        """True exactly for rows where the expression is true and nothing failed, else false."""
        truth = self._truth()
        if not self.errors:
            return F.coalesce(truth, F.lit(False))
        return ~reduce(lambda a, b: a | b, self.errors) & F.coalesce(truth, F.lit(False))


def _key(column: Expr, kind: str, constant: Expr, inside: bool) -> tuple[Key, ...] | None:
    """The key of ``column = constant``, in the form that the column's kind asks for, or
    None where equality is no equality of keys (texts read as numbers or times, nulls)."""
    if not column.column or not constant.constant or inside != column.kind.startswith("array"):
        return None
    value = constant.constant[0]
    if kind in ("int", "float"):
        if isinstance(value, str):
            value = float(value) if re.match(NUMBER, value) and not inside else None
        value = None if isinstance(value, bool) or not isinstance(value, (int, float)) else float(value)
    elif kind == "bool":
        if isinstance(value, str) and not inside:
            low = value.strip(" ").lower()
            value = True if low in TRUE else False if low in FALSE else None
        value = value if isinstance(value, bool) else None
    else:
        value = value if kind == "text" and isinstance(value, str) else None
    return None if value is None else (Key(column.column, value, inside),)


def key_text(value: Column, kind: str) -> Column:
    """A row's value (and an index's) as the text by which both meet: equal numbers give
    equal texts, whatever their types."""
    if kind in ("int", "float"):
        return F.concat(F.lit("n:"), (value.cast("double") + F.lit(0.0)).cast("string"))
    return F.concat(F.lit("b:" if kind == "bool" else "s:"), value.cast("string"))


def _as_number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def _as_truth(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)


def _compared(a: Column, a_kind: str, b: Column, b_kind: str, op) -> Column:
    if a_kind == b_kind or {a_kind, b_kind} <= {"int", "float"}:
        return op(a, b)
    for x, y in ((a_kind, b_kind), (b_kind, a_kind)):
        if x != "text":
            continue
        cast = {"int": _as_number, "float": _as_number, "bool": _as_truth, "time": lambda t: t.try_cast("timestamp")}.get(y)
        if cast:
            return op(cast(a), b) if x == a_kind else op(a, cast(b))
    return null()


def lit(value) -> Expr:
    """A constant; expressions are returned as they are. Parameters are texts."""
    if isinstance(value, Expr):
        return value
    if value is None:
        return Expr(F.lit(None), "null")
    if not isinstance(value, (bool, int, float, str, list, tuple)):
        raise UnsupportedPredicate(f"a constant of type {type(value).__name__}")
    if isinstance(value, int) and not -(2**63) <= value < 2**63:
        raise UnsupportedPredicate(f"{value} does not fit 64 bits")
    if isinstance(value, (list, tuple)):
        inner = lit(next((v for v in value if v is not None), None)).kind
        kind = {"int": "bigint", "float": "double", "bool": "boolean"}.get(inner, "string")
        return Expr(F.array(*(F.lit(v) for v in value)).cast(f"array<{kind}>"), f"array:{inner}", constant=(list(value),), literal=True)
    kind = "bool" if isinstance(value, bool) else "int" if isinstance(value, int) else "float" if isinstance(value, float) else "text"
    return Expr(F.lit(value).cast("long") if kind == "int" else F.lit(value), kind, constant=(value,))


def array(*items: Expr) -> Expr:
    return Expr(F.array(*(i.value for i in items)), f"array:{items[0].kind}", sum((i.errors for i in items), ()), literal=True)


def _pick(name: str, items) -> Expr:
    items = [lit(i) for i in items]
    value = items[0].value if len(items) == 1 else getattr(F, name)(*(i.value for i in items))
    return Expr(value, items[0].kind, sum((i.errors for i in items), ()))


def coalesce(*items) -> Expr:
    return _pick("coalesce", items)


def greatest(*items) -> Expr:
    return _pick("greatest", items)


def least(*items) -> Expr:
    return _pick("least", items)


class Row:
    """The columns of a table (or of a struct column of it, ``within``) as expressions.
    ``name``, ``table.name`` and ``schema.table.name`` are the same; unknown names fail."""

    def __init__(self, df: DataFrame, within: str | None = None):
        schema = df.schema[within].dataType if within else df.schema
        self.kinds, self.within = {f.name: kind_of(f.dataType) for f in schema}, within

    def __getitem__(self, name: str) -> Expr:
        name = name.rpartition(".")[2]
        if name not in self.kinds:
            raise UnsupportedPredicate(f"unknown column {name}")
        return Expr(F.col(f"{self.within}.{name}" if self.within else name), self.kinds[name], column=name)


def where(df: DataFrame, predicate=None) -> DataFrame:
    """The rows of ``df`` that match ``predicate(Row)``; without one, all."""
    return df if predicate is None else df.where(predicate(Row(df)).keeps())
