"""Relational operators as nested statements of Spark SQL.

Each takes and returns the text of a query, so that a plan of any depth is analysed and
planned once.  Catalyst finds the physical form: partial and final aggregates around an
exchange, broadcast or shuffled joins by measured size, top-k without a full sort.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from ..errors import QueryError
from ..functions.scalars import name


def _list(named: Mapping[str, str]) -> str:
    return ", ".join(f"{text} AS {name(n)}" for n, text in named.items()) or "1"


def scan(view: str, columns: Mapping[str, str]) -> str:
    """Some columns of a table: only these are read."""
    return f"SELECT {_list(columns)} FROM {name(view)}"


def filtered(query: str, conditions: Sequence[str]) -> str:
    """Rows for which all conditions are true; neither false nor NULL."""
    return f"SELECT * FROM ({query}) WHERE {' AND '.join(conditions)}" if conditions else query


def project(query: str, named: Mapping[str, str]) -> str:
    return f"SELECT {_list(named)} FROM ({query})"


def hash_join(build: str, probe: str, keys: Sequence[tuple[str, str]]) -> str:
    """Inner join on pairs of keys; a NULL key matches nothing; the build side's columns come first.

    No side is forced into a broadcast: the planner does that below the session's size
    threshold, from statistics or at run time, and shuffles both sides beyond it.
    """
    if not keys:
        raise QueryError("a join needs a pair of keys: cross joins are not supported")
    return f"SELECT * FROM ({build}) JOIN ({probe}) ON {' AND '.join(f'{a} = {b}' for a, b in keys)}"


def aggregate(query: str, keys: Mapping[str, str], values: Mapping[str, str]) -> str:
    """Grouped, or without keys one row even for no input; NULL is a group of its own; without values the distinct keys."""
    if not values:
        return f"SELECT DISTINCT {_list(keys)} FROM ({query})"
    return project(query, {**keys, **values}) + (f" GROUP BY {', '.join(keys.values())}" if keys else "")


def distinct(query: str) -> str:
    return f"SELECT DISTINCT * FROM ({query})"


def ordered(query: str, keys: Sequence[tuple[str, bool]]) -> str:
    """Sorted by (column, descending) pairs, NULLs first either way."""
    return f"SELECT * FROM ({query}) ORDER BY {', '.join(f'{k} {'DESC' if d else 'ASC'} NULLS FIRST' for k, d in keys)}"


def limit(query: str, n: int) -> str:
    """The first rows; after ``ordered``, Catalyst keeps ``n`` a partition and merges them."""
    return f"SELECT * FROM ({query}) LIMIT {n}"
