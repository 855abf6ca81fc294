"""Scalar expressions: checked types, three-valued logic, NULL for a division by zero.

Every function takes and returns ``Typed`` texts of Spark SQL, so a whole statement reaches
the planner at once.  They use Catalyst's own expressions only: filters reach the scan and
all of it runs in generated code.
"""

from __future__ import annotations

import datetime
import math
from dataclasses import dataclass

from ..errors import QueryError
from .types import BOOL, DATE, FLOAT, INT, NULL, NUMERIC, SPARK, STRING

_SPARK_LITERAL = {"int": INT, "float": FLOAT, "string": STRING, "bool": BOOL, "null": NULL}
EPOCH = datetime.date(1970, 1, 1)


@dataclass(frozen=True)
class Typed:
    text: str
    kind: str
    #: Of a literal, its value.
    value: object = None
    literal: bool = False

    def cast(self, kind: str) -> Typed:
        if self.kind == kind:
            return self
        if self.literal and kind == FLOAT and self.kind == INT:
            return constant(float(self.value), "float")
        return Typed(f"CAST({self.text} AS {SPARK[kind].simpleString()})", kind)


def name(column: str) -> str:
    """A column's name as Spark SQL has it."""
    return "`" + column.replace("`", "``") + "`"


def quoted(value: str) -> str:
    """A string as Spark SQL has it; ``${`` would be a variable to the parser."""
    parts = value.replace("\\", "\\\\").replace("'", "\\'").split("${")
    return "'" + parts[0] + "'" if len(parts) == 1 else "concat(" + ", '$', ".join(f"'{'{' * (k > 0)}{p}'" for k, p in enumerate(parts)) + ")"


def constant(value: object, kind: str) -> Typed:
    match kind:
        case "int":
            text = f"{value}L" if value >= 0 else f"({value}L)" if value > -(1 << 63) else f"({value + 1}L - 1L)"
        case "float":
            text = f"({value!r}D)" if math.isfinite(value) else f"CAST('{value}' AS double)"
        case "string":
            text = quoted(value)
        case _:
            text = "NULL" if value is None else str(value).upper()
    return Typed(text, _SPARK_LITERAL[kind], value, True)


def boolean(x: Typed, what: str) -> str:
    if x.kind not in (BOOL, NULL):
        raise QueryError(f"{what} needs a condition, not {x.kind}")
    return x.cast(BOOL).text


def _date(text: str) -> Typed:
    try:
        if len(text) != 10:
            raise ValueError
        day = datetime.date.fromisoformat(text)
    except ValueError:
        raise QueryError(f"{text!r} is not a date (YYYY-MM-DD)") from None
    return _literal_date(day)


def _literal_date(day: datetime.date) -> Typed:
    return Typed(f"DATE'{day.isoformat()}'", DATE, day, True)


def _day(days: Typed) -> Typed:
    """A whole number as days since 1970-01-01."""
    if days.literal:
        try:
            return _literal_date(EPOCH + datetime.timedelta(days=days.value))
        except OverflowError:
            pass
    return days


def matched(a: Typed, b: Typed, what: str) -> tuple[Typed, Typed]:
    """Two operands of one type: numbers are promoted; texts and numbers beside a date are read as dates."""
    if a.kind == b.kind:
        return a, b
    if NULL in (a.kind, b.kind):
        kind = b.kind if a.kind == NULL else a.kind
        return a.cast(kind), b.cast(kind)
    if a.kind in NUMERIC and b.kind in NUMERIC:
        return a.cast(FLOAT), b.cast(FLOAT)
    if DATE in (a.kind, b.kind):
        other = b if a.kind == DATE else a
        if other.kind == STRING and other.literal:
            other = _date(other.value)
        elif other.kind == INT:
            other = _day(other)
        if other.kind == DATE:
            return (a, other) if a.kind == DATE else (other, b)
        if other.kind == INT:  # a computed number of days, or one beyond all dates
            days = lambda x: Typed(f"CAST(unix_date({x.text}) AS bigint)", INT) if x.kind == DATE else x
            return days(a), days(b)
    raise QueryError(f"{what} cannot be applied to {a.kind} and {b.kind}")


def compare(op: str, a: Typed, b: Typed) -> Typed:
    a, b = matched(a, b, op)
    return Typed(f"({a.text} {op} {b.text})", BOOL)


def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    for x in (a, b):
        if x.kind not in (*NUMERIC, NULL):
            raise QueryError(f"{op} cannot be applied to {a.kind} and {b.kind}")
    kind = FLOAT if FLOAT in (a.kind, b.kind) else INT
    a, b = a.cast(kind), b.cast(kind)
    if op != "/":
        return Typed(f"({a.text} {op} {b.text})", kind)
    if kind == INT:  # truncates
        return Typed(f"({a.text} DIV nullif({b.text}, 0L))", INT)
    return Typed(f"try_divide({a.text}, {b.text})", FLOAT)


def negative(x: Typed) -> Typed:
    if x.kind not in (*NUMERIC, NULL):
        raise QueryError(f"- cannot be applied to {x.kind}")
    if x.literal and x.kind in NUMERIC and x.value != -(1 << 63):
        return constant(-x.value, "int" if x.kind == INT else "float")
    x = x.cast(INT) if x.kind == NULL else x
    return Typed(f"(- {x.text})", x.kind)


def negation(x: Typed) -> Typed:
    return _turned(boolean(x, "NOT"), True)


def both(a: Typed, b: Typed) -> Typed:
    return Typed(f"({boolean(a, 'AND')} AND {boolean(b, 'AND')})", BOOL)


def either(a: Typed, b: Typed) -> Typed:
    return Typed(f"({boolean(a, 'OR')} OR {boolean(b, 'OR')})", BOOL)


def is_null(x: Typed, negated: bool) -> Typed:
    return Typed(f"({x.text} IS {'NOT ' * negated}NULL)", BOOL)


def _turned(text: str, negated: bool) -> Typed:
    return Typed(f"(NOT {text})" if negated else text, BOOL)


def between(x: Typed, low: Typed, high: Typed, negated: bool) -> Typed:
    return _turned(both(compare(">=", x, low), compare("<=", x, high)).text, negated)


def within(x: Typed, items: list[Typed], negated: bool) -> Typed:
    """IN with literals: NULL where nothing is equal and a NULL is in the list."""
    kinds = {i.kind for i in items}
    if x.kind == INT and FLOAT in kinds:
        x = x.cast(FLOAT)
    pairs = [matched(x, i, "IN") for i in items]
    subject = pairs[0][0]
    if any(a.kind != subject.kind for a, _ in pairs):
        # days beyond all dates beside dates: each is compared in its own way
        return _turned("(" + " OR ".join(compare("=", x, item).text for item in items) + ")", negated)
    return _turned(f"({subject.text} IN ({', '.join(b.text for _, b in pairs)}))", negated)


def like(x: Typed, pattern: str, negated: bool) -> Typed:
    if x.kind not in (STRING, NULL):
        raise QueryError(f"LIKE cannot be applied to {x.kind}")
    # a backslash is an ordinary sign in the dialect
    return _turned(f"({x.cast(STRING).text} LIKE {quoted(pattern.replace(chr(92), chr(92) * 2))})", negated)


def case(branches: list[tuple[Typed, Typed]], otherwise: Typed | None) -> Typed:
    values = [v for _, v in branches] + ([otherwise] if otherwise else [])
    kinds = {v.kind for v in values} - {NULL}
    if len(kinds) > 1:
        raise QueryError(f"the branches of CASE have no common type: {', '.join(sorted(kinds))}")
    kind = kinds.pop() if kinds else NULL
    shown = lambda v: v.text if kind == NULL else v.cast(kind).text
    whens = " ".join(f"WHEN {boolean(c, 'WHEN')} THEN {shown(v)}" for c, v in branches)
    return Typed(f"(CASE {whens}{f' ELSE {shown(otherwise)}' if otherwise else ''} END)", kind)
