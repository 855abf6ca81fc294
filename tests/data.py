"""Seeded tables with NULLs, and the comparison with another engine."""

import datetime
import math
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
EPOCH = datetime.date(1970, 1, 1)


def orders_and_items(folder, seed=42, n=500):
    r = random.Random(seed)
    maybe = lambda x: None if r.random() < 0.15 else x
    orders, items = [], []
    for k in range(1, n + 1):
        orders.append(
            (k, maybe(r.randint(1, 50)), maybe(round(r.uniform(0.01, 9999.99), 2)), maybe(r.choice(WORDS)), maybe(r.random() < 0.5), maybe(EPOCH + datetime.timedelta(r.randint(15000, 19999))))
        )
        for _ in range(r.randint(2, 4) if r.random() < 0.6 else 0):
            items.append((len(items) + 1, k, maybe(r.randint(1, 20)), maybe(round(r.uniform(0.01, 100), 2)), maybe(r.choice(WORDS[:5]))))
    kinds = {
        "orders": (orders, [("order_id", pa.int64()), ("customer_id", pa.int64()), ("amount", pa.float64()), ("status", pa.string()), ("is_express", pa.bool_()), ("order_date", pa.date32())]),
        "items": (items, [("item_id", pa.int64()), ("order_id", pa.int64()), ("quantity", pa.int64()), ("price", pa.float64()), ("category", pa.string())]),
    }
    for name, (rows, fields) in kinds.items():
        columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)]
        pq.write_table(pa.table(columns, names=[n for n, _ in fields]), f"{folder}/{name}.parquet", row_group_size=128)


def duck(folder):
    import pathlib

    con = duckdb.connect()
    for p in sorted(pathlib.Path(folder).glob("*.parquet")):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, datetime.datetime):
        return x.date()
    return float(x) if type(x).__name__ == "Decimal" else x


def same(a, b) -> bool:
    a, b = plain(a), plain(b)
    if a is None or b is None or isinstance(a, bool) or isinstance(b, bool) or isinstance(a, str):
        return a == b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def assert_same(got, wanted, ordered=False):
    got, wanted = [tuple(r) for r in got], [tuple(r) for r in wanted]
    assert len(got) == len(wanted), (len(got), len(wanted))
    if not ordered:
        key = lambda r: [(x is not None, str(type(x)) if x is None else "", round(x, 6) if isinstance(x, float) else plain(x)) if not isinstance(x, (int, float)) or isinstance(x, bool) else (True, "", round(float(x), 6)) for x in r]
        text = lambda r: str(key(r))
        got, wanted = sorted(got, key=text), sorted(wanted, key=text)
    for g, w in zip(got, wanted):
        assert len(g) == len(w) and all(map(same, g, w)), (g, w)
