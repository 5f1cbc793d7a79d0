"""A file in many blocks equals the one-task reader and Python's csv module."""

import csv
import io
import random

import pytest

from scrubwell.sources import readers, split_csv

SCHEMA = "k long, a string, b string"


def written(path, rows, sep, end, header):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, delimiter=sep, lineterminator=end)
        if header:
            w.writerow(["k", "a\nx", "b"])
        for r in rows:
            w.writerow(["" if x is None else x for x in r])


def some_rows(n, seed, long=False):
    r = random.Random(seed)
    bits = ["a", "b c", '"', '""', ",", "\t", "\n", "\r\n", "\n\n", "é", "'", " ", "x" * 40]
    text = lambda: "".join(r.choice(bits) for _ in range(r.randint(0, 60 if long else 9))) or None
    return [(k, text(), text()) for k in range(n)]


@pytest.fixture
def small_blocks(spark):
    yield lambda size: (spark.conf.set("spark.sql.files.maxPartitionBytes", str(size)), spark.conf.set("spark.sql.files.openCostInBytes", "1"))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size,sep,end,header,long", [(96, ",", "\n", True, False), (1000, "\t", "\r\n", True, True), (311, ",", "\n", False, True), (1 << 20, ",", "\n", True, True)])
def test_blocks_equal_one_task(spark, tmp_path, small_blocks, size, sep, end, header, long):
    expected = []
    for k in range(3):
        rows = some_rows(30, k, long)
        written(tmp_path / f"{k}.csv", rows, sep, end, header)
        with open(tmp_path / f"{k}.csv", newline="", encoding="utf-8") as f:
            parsed = [x for x in csv.reader(f, delimiter=sep) if x]
        expected += [(int(x[0]), x[1] or None, x[2] or None) for x in parsed[header:]]
    small_blocks(size)
    schema = spark.createDataFrame([], SCHEMA).schema
    got = [tuple(r) for r in split_csv.read(spark, str(tmp_path), schema, header, sep).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str) and len(got) == 90
    one = spark.read.schema(schema).options(header=header, sep=sep, multiLine=True, quote='"', escape='"').csv(str(tmp_path))
    if end == "\n" and not long:  # the one-task reader takes the first line break it meets for that of all records
        same = lambda rows: sorted((r[0], *((x or "").replace("\r\n", "\n") for x in r[1:])) for r in rows)
        assert same(got) == same(map(tuple, one.collect()))


def test_odd_records(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_bytes('k,a,b\n1,5" nail,x\n\n2,"open\nand ""shut"" ",y,surplus\n3\nno number,a,b\n4,"","q"tail\n5,"never closed\n6,a,b\n'.encode())
    (tmp_path / "b.csv").write_bytes(b"")
    (tmp_path / "c.csv").write_bytes(b"k,a,b")
    small_blocks(8)
    schema = spark.createDataFrame([], SCHEMA).schema
    got = sorted((tuple(r) for r in split_csv.read(spark, str(tmp_path), schema).collect()), key=str)
    assert got == sorted([(1, '5" nail', "x"), (2, 'open\nand "shut" ', "y"), (3, None, None), (None, "a", "b"), (4, None, "qtail"), (5, "never closed\n6,a,b", None)], key=str)


def test_a_line_ends_inside():
    for line, inside, end in [("a,b", False, False), ("a,b", True, True), ('a,"b', False, True), ('b",c', True, False), ('""', True, True), ('"",', True, True), ('"', True, False), ('a"b,"c', False, True), ('"a"b"c,"', False, True), ("", True, True)]:
        assert split_csv.ends_inside(line, inside, ",") is end, line
    rows = list(csv.reader(io.StringIO('"a""b",c"d,"e,f"g\n')))
    assert split_csv._fields('"a""b",c"d,"e,f"g', ",") == rows[0]


def test_readers_use_blocks(spark, tmp_path):
    written(tmp_path / "x.csv", some_rows(20, 9), ",", "\n", True)
    assert readers.read_csv(spark, str(tmp_path), spark.createDataFrame([], SCHEMA).schema).count() == 20
