"""Aggregate functions: what they take, what they return, and how nulls count."""

from __future__ import annotations

from ..errors import QueryError
from .scalars import Typed
from .types import BOOL, DATE, FLOAT, INT, NULL, NUMERIC, STRING


def aggregate(function: str, argument: Typed | None, distinct: bool = False) -> Typed:
    """COUNT gives 0 and the others NULL where no value is left; AVG is always FLOAT64.

    A sum of whole numbers beyond 64 bits is an error, as everywhere in ANSI mode.
    """
    if distinct and function != "COUNT":
        raise QueryError(f"{function}(DISTINCT ...) is not supported")
    if argument is None:
        if function != "COUNT" or distinct:
            raise QueryError(f"{function}(*) is not supported")
        return Typed("count(1)", INT)
    x, kind = argument.text, argument.kind
    match function:
        case "COUNT":
            return Typed(f"count({'DISTINCT ' * distinct}{x})", INT)
        case "SUM" | "AVG":
            if kind not in (*NUMERIC, NULL):
                raise QueryError(f"{function} cannot be applied to {kind}")
            if kind == NULL:
                x, kind = argument.cast(INT).text, INT
            return Typed(f"sum({x})", kind) if function == "SUM" else Typed(f"avg({x})", FLOAT)
        case "MIN" | "MAX":
            if kind not in (INT, FLOAT, BOOL, STRING, DATE):
                raise QueryError(f"{function} cannot be applied to {kind}")
            return Typed(f"{function.lower()}({x})", kind)
    raise QueryError(f"function {function} is not supported")
