"""Catalog, ingestion, writing, integrity check, command line."""

import json
import shutil

import pytest

from tarnql import Catalog, QueryError, query
from tarnql.__main__ import main, options
from tarnql.sources.fsck import fsck
from tarnql.sources.ingest import SCHEMAS, ingest
from tarnql.sources.sink import aligned, unique_names, value, write_table

TESTDATA = "/root/testdata/sf0.001"


def test_catalog(spark, tmp_path):
    config = tmp_path / "catalog.json"
    config.write_text(json.dumps({"tables": [{"name": "r", "path": f"{TESTDATA}/region.parquet"}]}))
    catalog = Catalog.open(str(config))
    assert catalog.names == ["r"] and "r_name" in catalog.schema(spark, "r").names
    assert Catalog.open().names == []
    catalog.register("n", f"{TESTDATA}/nation.parquet")
    assert query(spark, catalog, "SELECT COUNT(*) FROM n, r WHERE n_regionkey = r_regionkey").first()[0] == 25
    catalog.register("n", f"{TESTDATA}/region.parquet")
    assert query(spark, catalog, "SELECT COUNT(*) FROM n").first()[0] == 5
    assert Catalog.single(spark, "x", f"{TESTDATA}/region.parquet").names == ["x"]
    catalog.register_views(spark)
    assert spark.sql("SELECT COUNT(*) FROM r").first()[0] == 5
    for bad in (lambda: Catalog.open(str(tmp_path / "none.json")), lambda: Catalog.single(spark, "x", str(tmp_path / "none.parquet")), lambda: Catalog().path("x")):
        with pytest.raises(QueryError):
            bad()
    config.write_text("[1]")
    with pytest.raises(QueryError):
        Catalog.open(str(config))


def test_folders_of_any_file_system(spark, tmp_path):
    assert "orders" in Catalog.folder(f"file://{TESTDATA}").names and Catalog.folder(f"file://{TESTDATA}").names == Catalog.folder(TESTDATA).names
    assert Catalog.folder(str(tmp_path / "none")).names == []
    assert query(spark, Catalog.folder(f"file://{TESTDATA}"), "SELECT COUNT(*) FROM region").first()[0] == 5


def test_a_damaged_page_ends_a_query(spark, tmp_path):
    spark.range(5000).selectExpr("id", "id * 7 % 1000 AS v").coalesce(1).write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(str(tmp_path / "t"))
    (part,) = (tmp_path / "t").glob("*.parquet")
    (tmp_path / "t" / f".{part.name}.crc").unlink()
    query(spark, Catalog.single(spark, "t", str(part)), "SELECT SUM(v) FROM t").collect()
    content = bytearray(part.read_bytes())
    place = content.index((21).to_bytes(8, "little"), 5000 * 8)  # a value of the second column
    content[place] ^= 1
    part.write_bytes(content)
    assert query(spark, Catalog.single(spark, "t", str(part)), "SELECT SUM(id) FROM t").first()[0] == 4999 * 2500
    with pytest.raises(Exception, match="(?i)crc|checksum|corrupt"):
        query(spark, Catalog.single(spark, "t", str(part)), "SELECT SUM(v) FROM t").collect()


def test_ranges_of_a_scan(spark):
    catalog = Catalog.folder(TESTDATA)
    whole = sorted(catalog.table(spark, "orders").collect())
    parts = [catalog.rows(spark, "orders", 0, 400), catalog.rows(spark, "orders", 400, 401), catalog.rows(spark, "orders", 401)]
    assert [p.count() for p in parts] == [400, 1, len(whole) - 401] and sorted(r for p in parts for r in p.collect()) == whole


def test_ingest(spark, tmp_path):
    (tmp_path / "nation.tbl").write_text("0|ALGERIA|0|a \"quoted\" comment|\n1|ÄGYPTEN|4||\n", encoding="utf-8")
    ingest(spark, str(tmp_path / "nation.tbl"), "nation", str(tmp_path / "nation.parquet"))
    rows = spark.read.parquet(str(tmp_path / "nation.parquet")).orderBy("n_nationkey").collect()
    assert [tuple(r) for r in rows] == [(0, "ALGERIA", 0, 'a "quoted" comment'), (1, "ÄGYPTEN", 4, "")]
    (tmp_path / "orders.tbl").write_text("7|3|F|1.5|1996-01-02|1-URGENT|c|0|x|\n")
    ingest(spark, str(tmp_path / "orders.tbl"), "orders", str(tmp_path / "orders.parquet"))
    assert str(spark.read.parquet(str(tmp_path / "orders.parquet")).first().o_orderdate) == "1996-01-02"
    for bad in ("0|A|x|c|\n", "0|A|0|c|more|\n", "0|A||c|\n"):
        (tmp_path / "bad.tbl").write_text(bad)
        with pytest.raises(Exception):
            ingest(spark, str(tmp_path / "bad.tbl"), "nation", str(tmp_path / "bad.parquet"))
    for table, schema in SCHEMAS.items():  # two lines of each of the eight tables
        made = [[{"long": str(k), "double": f"{k}.5", "string": f"s{k} {f.name}", "date": f"1996-02-2{k}"}[{"bigint": "long"}.get(f.dataType.simpleString(), f.dataType.simpleString())] for f in schema] for k in (1, 2)]
        (tmp_path / "some.tbl").write_text("".join("|".join(line) + "|\n" for line in made))
        ingest(spark, str(tmp_path / "some.tbl"), table, str(tmp_path / f"all_{table}.parquet"))
        got = spark.read.parquet(str(tmp_path / f"all_{table}.parquet"))
        assert got.columns == schema.names and sorted([str(x) for x in r] for r in got.collect()) == made
    assert {t: len(s) for t, s in SCHEMAS.items()} == dict(region=3, nation=4, supplier=7, customer=8, part=9, partsupp=5, orders=9, lineitem=16)


def test_written_headers_are_unique(spark, tmp_path):
    assert unique_names(["a", "a", "b", "a_2", "a"]) == ["a", "a_3", "b", "a_2", "a_4"]
    df = query(spark, Catalog.folder(TESTDATA), "SELECT COUNT(*), COUNT(*) FROM region")
    write_table(df, str(tmp_path / "out.parquet"))
    assert spark.read.parquet(str(tmp_path / "out.parquet")).columns == ["COUNT_*", "COUNT_*_2"]
    with pytest.raises(Exception):
        write_table(df, str(tmp_path / "out.parquet"))


def test_fsck(spark, tmp_path):
    good = fsck(spark, f"{TESTDATA}/orders.parquet")
    assert any("o_totalprice double: 1500 rows" in line for line in good.lines) and good.errors == 0
    path = tmp_path / "orders.parquet"
    shutil.copy(f"{TESTDATA}/orders.parquet", path)
    path.chmod(0o644)
    content = bytearray(path.read_bytes())
    content[200:400] = bytes(200)
    path.write_bytes(content)
    bad = fsck(spark, str(path))
    lines = list(bad.lines)
    assert bad.errors >= 1 and sum("ERROR" in line for line in lines) == bad.errors < len(lines) - 1
    path.write_bytes(bytes(content[:-20]))
    broken = fsck(spark, str(path))
    assert any("footer" in line for line in broken.lines) and broken.errors == 1
    empty = fsck(spark, str(tmp_path / "nothing*"))
    try:
        list(empty.lines)
    except Exception:
        pass


def test_command_line(spark, capsys):
    assert options(["--workers=3", "a"]) == (3, ["a"]) and options(["-w", "2", "a"]) == (2, ["a"]) and options(["--workers", "4", "b"]) == (4, ["b"])
    with pytest.raises(QueryError):
        options(["--workers=x"])
    assert [value(x) for x in (None, True, 0.1, 1e21, 3, "x", float("nan"))] == ["NULL", "true", "0.1", "1e+21", "3", "x", "NaN"]
    df = query(spark, Catalog.folder(TESTDATA), "SELECT r_name, r_regionkey FROM region ORDER BY r_regionkey LIMIT 1")
    assert list(aligned(df)) == ["r_name  r_regionkey", "AFRICA  0"]
    assert main([f"{TESTDATA}/region.parquet", f"{TESTDATA}/region.parquet", "SELECT 1 FROM region"]) == 1
    assert "two files" in capsys.readouterr().err
    assert main([]) == 2
    assert main(["-w", "2", f"{TESTDATA}/region.parquet", "SELECT r_name, r_regionkey / 0 AS q FROM region ORDER BY r_name DESC LIMIT 1"]) == 0
    shown = capsys.readouterr()
    assert shown.out.split() == ["r_name", "q", "MIDDLE", "EAST", "NULL"] and shown.err.endswith("\n(1 row)\n")
    assert main([f"{TESTDATA}/region.parquet", "SELECT nothing FROM region"]) == 1 and "unknown column" in capsys.readouterr().err
    assert main(["fsck", f"{TESTDATA}/region.parquet"]) == 0
