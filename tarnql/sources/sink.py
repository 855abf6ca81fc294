"""Results to Parquet, and as aligned text."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame

#: Rows whose widths set the columns' widths.
LOOKED_AT = 1000


def unique_names(names: list[str]) -> list[str]:
    """Headers may repeat in a result, columns of a file may not: later ones get a number."""
    out: list[str] = []
    for name in names:
        new, k = name, 1
        while new in out or (k > 1 and new in names):
            k += 1
            new = f"{name}_{k}"
        out.append(new)
    return out


def write_table(df: DataFrame, path: str, replace: bool = False, row_group_bytes: int | None = None) -> None:
    """Writes ``df``; a failed job leaves nothing that a reader would see (Spark's commit protocol)."""
    writer = df.toDF(*unique_names(df.columns)).write.mode("overwrite" if replace else "errorifexists")
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    writer.parquet(path)


def value(x: object) -> str:
    match x:
        case None:
            return "NULL"
        case bool():
            return str(x).lower()
        case float():
            return f"{x:g}" if x == x and abs(x) != float("inf") else {"nan": "NaN", "inf": "+Inf", "-inf": "-Inf"}[str(x)]
        case datetime.date():
            return x.isoformat()
    return str(x)


def aligned(df: DataFrame) -> Iterator[str]:
    """Header and rows, padded to the widths of the first rows; later rows are fetched as they are printed."""
    rows = ([value(x) for x in r] for r in df.toLocalIterator(prefetchPartitions=True))
    first = [list(df.columns)]
    for r in rows:
        first.append(r)
        if len(first) > LOOKED_AT:
            break
    widths = [max(map(len, column)) for column in zip(*first)]
    pad = lambda r: "  ".join(x.ljust(w) for x, w in zip(r, widths)).rstrip()
    yield from map(pad, first)
    yield from map(pad, rows)
