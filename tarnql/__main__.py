"""python -m tarnql [--workers=N | --workers N | -w N] FILE... "SELECT ..."
python -m tarnql fsck PATH

Each file is a table named after it.  Rows go to standard output, their number to standard error;
columns are as wide as their first 1000 rows.  Bounds that fsck shows end after 60 signs.
"""

from __future__ import annotations

import os
import sys

from pyspark.errors import PySparkException

from .errors import QueryError
from .plans.lower import query
from .session import session
from .sources.catalog import Catalog
from .sources.fsck import fsck
from .sources.sink import aligned


def options(args: list[str]) -> tuple[int, list[str]]:
    """The number of workers (all cores unless given) and the other arguments."""
    workers, rest = os.cpu_count() or 1, []
    it = iter(args)
    for a in it:
        name, eq, given = a.partition("=")
        if a in ("--workers", "-w"):
            given = next(it, "")
        elif not (name == "--workers" and eq):
            rest.append(a)
            continue
        if not given.isdigit() or not int(given):
            raise QueryError(f"--workers needs a positive number, not {given!r}")
        workers = int(given)
    return workers, rest


def _session(workers: int):
    return session(workers, **{"spark.ui.showConsoleProgress": "false", "spark.ui.enabled": "false"})


def main(args: list[str]) -> int:
    try:
        workers, rest = options(args)
        if len(rest) < 2:
            print(__doc__, file=sys.stderr)
            return 2
        if rest[0] == "fsck" and len(rest) == 2:
            report = fsck(_session(workers), rest[1])
            for line in report.lines:
                print(line)
            print(f"{report.errors} errors", file=sys.stderr)
            return int(report.errors > 0)
        *files, text = rest
        tables: dict[str, str] = {}
        for f in files:
            name = os.path.splitext(os.path.basename(f.rstrip("/")))[0]
            if name in tables:
                raise QueryError(f"two files are named {name}")
            tables[name] = f
        df = query(_session(workers), Catalog(tables, dates=True), text)
        n = -1
        for line in aligned(df):
            print(line)
            n += 1
        print(f"({n} {'row' if n == 1 else 'rows'})", file=sys.stderr)
        return 0
    except (QueryError, PySparkException) as e:
        print(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
